import random

from pyspark.sql import functions as F

from scriptorium.operators import tree


def test_parents_like_a_stack(spark):
    draw = random.Random(1)
    rows, expected = [], {}
    for ms in range(30):
        stack = []
        for n in range(draw.randint(0, 25)):
            level = draw.randint(1, 6)
            while stack and stack[-1][1] >= level:
                stack.pop()
            expected[ms, n] = stack[-1][0] if stack else None
            stack.append((n, level))
            rows.append((ms, n, level))
    found = tree.parents(spark.createDataFrame(rows, "ms_id int, ord int, level int")).collect()
    assert {(r.ms_id, r.ord): r.parent_ord for r in found} == expected


def claimed(ranges):
    out, last = [], -1
    for seq, start, end in sorted((r for r in ranges if r[2] >= r[1]), key=lambda r: (r[1], r[0])):
        start = max(start, last + 1)
        if start <= end:
            out.append((seq, start, end))
            last = end
    return sorted(out)


def test_claims_like_a_greedy_walk(spark):
    draw = random.Random(2)
    sets = {ms: [(n, s := draw.randint(0, 20), s + draw.randint(-2, 8)) for n in range(draw.randint(0, 9))] for ms in range(60)}
    rows = [(ms, n, "r", s, e, "") for ms, rs in sets.items() for n, s, e in rs]
    found = tree.claims(spark.createDataFrame(rows, "ms_id int, seq int, role string, start int, end int, title string")).collect()
    got = {ms: sorted((r.seq, r.start, r.end) for r in found if r.ms_id == ms) for ms in sets}
    assert got == {ms: claimed(rs) for ms, rs in sets.items()}


def corpus(spark):
    sections = [(1, 0, 1, "abstract", "Abstract"), (1, 1, 1, "introduction", "Intro"), (1, 2, 2, "unknown", "Aims"), (2, 0, 1, "unknown", "Only")]
    blocks = [(1, 0, 0, "paragraph", "a"), (1, 1, 0, "paragraph", "b"), (1, 1, 1, "figure_ref", "c"), (1, 2, 0, "paragraph", "d"), (2, 0, 0, "paragraph", None)]
    return spark.createDataFrame(sections, "ms_id int, sec_ord int, level int, role string, title_raw string"), spark.createDataFrame(blocks, "ms_id int, sec_ord int, blk_ord int, kind string, text string")


def test_flatten_and_rebuild_lose_nothing(spark):
    sections, blocks = corpus(spark)
    rows = tree.flatten(sections, blocks)
    assert [(r.ms_id, r.idx, r.text) for r in rows.orderBy("ms_id", "idx").collect()] == [(1, 0, "Abstract"), (1, 1, "a"), (1, 2, "Intro"), (1, 3, "b"), (1, 4, "c"), (1, 5, "Aims"), (1, 6, "d"), (2, 0, "Only"), (2, 1, None)]
    built = tree.rebuild(rows, ["abstract", "introduction"])
    back = built.where("NOT is_heading").groupBy("ms_id").count().exceptAll(blocks.groupBy("ms_id").count())
    assert back.isEmpty() and built.count() == rows.count()
    assert {(r.ms_id, r.idx): (r.section_ord, r.parent_ord) for r in built.where("is_heading").collect()} == {(1, 0): (0, None), (1, 2): (2, None), (1, 5): (5, 2), (2, 0): (0, None)}


def test_ranges_keep_every_block_and_other_roles(spark):
    sections, blocks = corpus(spark)
    rows = tree.flatten(sections, blocks)
    ranges = spark.createDataFrame([(1, 1, "abstract", 1, 1, ""), (1, 2, "methods", 1, 4, "")], "ms_id int, seq int, role string, start int, end int, title string")
    found = {(r.ms_id, r.idx): r for r in tree.apply_ranges(rows, ranges).collect()}
    assert len(found) == rows.count()
    assert found[1, 1].role == "abstract" and found[1, 1].title == "Abstract" and found[1, 0].dropped
    assert found[1, 3].role == "methods" and found[1, 2].section == 2  # the second range is cut to begin at 2
    assert found[1, 6].role == "unknown" and found[2, 1].title == "Only"


def test_preamble_without_headings(spark):
    rows = spark.createDataFrame([(1, 0, False, 0, None, "paragraph", "x")], "ms_id int, idx int, is_heading boolean, level int, role string, kind string, text string")
    assert tree.rebuild(rows, []).first().section_ord == -1


def test_title_wrapper(spark):
    rows = [(1, 0, 1, "unknown", "A Study of Winds"), (1, 1, 2, "introduction", "Introduction"), (1, 2, 2, "results", "Results"), (1, 3, 3, "unknown", "Detail"), (2, 0, 1, "unknown", "Other"), (2, 1, 2, "introduction", "Introduction"), (2, 2, 2, "results", "Results")]
    sections = spark.createDataFrame(rows, "ms_id int, sec_ord int, level int, role string, title_raw string")
    titles = spark.createDataFrame([(1, "A study of winds"), (2, "Nothing alike")], "ms_id int, title string")
    found = {(r.ms_id, r.sec_ord): r for r in tree.unwrap_title(sections, titles, ["introduction", "methods", "results"]).collect()}
    assert found[1, 0].unwrapped and found[1, 1].parent_ord is None and found[1, 1].level == 1 and found[1, 3].parent_ord == 2 and found[1, 3].level == 2
    assert not found[2, 0].unwrapped and found[2, 1].parent_ord == 0


def test_continued_entries(spark):
    rows = spark.createDataFrame([(1, 0, "[1] a", True), (1, 1, "b", False), (1, 2, "[2] c", True), (2, 0, "x", False), (2, 1, "y", False)], "ms_id int, idx int, text string, is_marked boolean")
    assert sorted((r.ms_id, r.text) for r in tree.continued(rows).collect()) == [(1, "[1] a b"), (1, "[2] c"), (2, "x"), (2, "y")]


def test_edits_mark_only_what_changed(spark):
    rows = spark.createDataFrame([(1, 0, "t", "paragraph", False, 1, None, "heuristic", 0.5), (1, 1, "u", "heading", True, 1, "methods", "heuristic", 0.5)], "ms_id int, idx int, text string, kind string, is_heading boolean, level int, role string, source string, confidence double")
    edits = spark.createDataFrame([(1, 0, True, 2, "results"), (1, 1, True, 1, "methods")], "ms_id int, idx int, heading boolean, level int, role string")
    found = {r.idx: r for r in tree.apply_edits(rows, edits).collect()}
    assert found[0].source == "explicit" and found[0].is_heading and found[1].source == "heuristic"


def test_empty_tables(spark):
    sections, blocks = corpus(spark)
    assert tree.flatten(sections.limit(0), blocks.limit(0)).isEmpty()
    assert tree.parents(sections.limit(0).select("ms_id", F.col("sec_ord").alias("ord"), "level")).isEmpty()
