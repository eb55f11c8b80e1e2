"""Every registered query with SQL against DuckDB on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from scriptorium.plans import catalog, panel_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = catalog.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in places) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr) == expected


# --- queries that SQL cannot follow: what must hold of their rows ---


def test_quotes_are_verified_over_whole_texts(spark, sf_dir):
    found = {r.ms_id: r.grounded for r in catalog.queries()["f_06_verified"](spark, sf_dir).collect()}
    long = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") > 200}
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(found[i] for i in long if i % 3 == 0) and not any(found[i] for i in long if i % 3 == 2)


def test_faults_are_tallied(spark, sf_dir):
    found = {r.fault: (r.applied, r.detected) for r in catalog.queries()["e_22_fault_tally"](spark, sf_dir).collect()}
    assert set(found) == {"drop", "truncate", "duplicate"} and all(0 < d <= a for a, d in found.values())
    assert found["duplicate"][0] == found["duplicate"][1]


def test_a_caption_goes_to_one_table(spark, sf_dir):
    rows = [r.asDict() for r in catalog.queries()["d_04_table_captions"](spark, sf_dir).collect()]
    taken = [(r["ms_id"], r["at"]) for r in rows if r.get("at") is not None]
    assert rows and len(taken) == len(set(taken))


def test_clusters_are_ranked(spark, sf_dir):
    ranks = {}
    for r in catalog.queries()["f_07_clusters"](spark, sf_dir).collect():
        assert r.agreement >= 1 and r.severity in ("major", "minor") and 0 <= r.specificity <= 1
        ranks.setdefault(r.ms_id, []).append((r["rank"], -r.agreement))
    assert ranks and all([a for _, a in sorted(x)] == sorted(a for _, a in x) for x in ranks.values())


def test_predictions_beat_chance(spark, sf_dir):
    counts = {(r.is_heading, r.predicted): r.n for r in catalog.queries()["k_03_predictions"](spark, sf_dir).collect()}
    right = sum(n for (y, p), n in counts.items() if str(y).lower() == str(p).lower())
    assert right > 0.6 * sum(counts.values()) > 0


def test_heading_model_learns_from_whole_lines(spark, tmp_path, monkeypatch):
    same = "These words stand at the beginning of two lines, so only what follows tells one from the other: "
    spark.createDataFrame([(1, f"Title\n{same}wind {'and water ' * 300}"), (2, f"{same}heat"), (3, "not labelled")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(panel_queries.learn, "cross_validated", lambda rows, *_, **__: rows)
    found = {tuple(r) for r in catalog.queries()["k_02_heading_model"](spark, str(tmp_path)).collect()}
    assert found == {("Title", True), (f"{same}wind {'and water ' * 300}".strip(), False), (f"{same}heat", False)}
