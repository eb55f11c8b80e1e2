import duckdb
import pytest

from scriptorium.llm.mixing import ORACLE, mix, mixed


def shared(sizes, weights=(5, 2, 1), most=3):
    """Round by round: whatever is above its cap stops there, the excess goes on by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        rest = sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / rest for s in order}
        above = {s for s in order if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def run(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("intervals", [None, 1, 4000])
def test_targets_and_takes(spark, intervals):
    rows = [(i, "word " * (i % 37), ["b", "a", None, "Z", "é", "tiny"][min(5, i % 7)]) for i in range(900)] + [(1000, "one two", "alone")]
    found = mix(run(spark, rows), intervals=intervals).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    of = {i: s for i, _, s in rows}
    sizes = {}
    for i, s in of.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    target = shared(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]])
        assert r.taken == r["size"] * r.copies and r.copies <= 3
        taken[of[r.doc_id]] += r.taken
    assert len(found) == len(rows)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in of if of[i] == s) / 2 + 1e-6


def test_reruns_agree_and_intervals_do_not_matter(spark):
    rows = run(spark, [(i, "w " * (i % 11 + 1), f"s{i % 4}") for i in range(500)])
    a, b, c = (sorted((r.doc_id, r.taken) for r in mix(rows.repartition(n), intervals=k).collect()) for n, k in ((1, None), (7, None), (3, 2)))
    assert a == b == c


def test_like_the_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = con.execute(ORACLE)
    names = [d[0] for d in cursor.description]
    expected = sorted(tuple(dict(zip(names, r))[c] for c in ("doc_id", "size", "source_size", "taken", "copies")) for r in cursor.fetchall())
    found = sorted((r.doc_id, r["size"], r.source_size, r.taken, r.copies) for r in mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect())
    assert found == expected


def test_no_python_in_the_plan(spark, sf_dir):
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark, odd, documents):
    found = mix(odd).collect()
    assert len(found) == odd.count() and all(r.taken == 0 for r in found if r.doc_id in (2, 3, 7))
    assert mix(odd.limit(0)).isEmpty()
    nothing = mix(documents("", None)).collect()
    assert [(r["size"], r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_mixed_repeats_rows(spark, documents):
    rows = documents(*["a b c"] * 9)
    taken = {r.doc_id: r.copies for r in mix(rows).collect()}
    found = mixed(rows)
    assert found.columns == rows.columns
    assert {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
