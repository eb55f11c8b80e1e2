from pyspark.sql import functions as F

from scriptorium.operators import floats, frontmatter, layout, mining, render
from scriptorium.plans import catalog

CELL = "ms_id int, tab_id string, row int, col int, n_math int, text string, latex string, has_non_paragraph boolean"


def table(spark, rows, tab="t"):
    cells = [(1, tab, r, c, n, t, "a=b" if n else None, False) for r, row in enumerate(rows) for c, (n, t) in enumerate(row)]
    return spark.createDataFrame(cells, CELL)


def test_equation_layouts(spark):
    is_layout = lambda rows: not floats.equation_layouts(table(spark, rows)).isEmpty()
    assert is_layout([[(1, ""), (0, "(3)")]]) and is_layout([[(0, ""), (1, ""), (0, "(A.2)")], [(0, ""), (1, ""), (0, "")]])
    assert not is_layout([[(1, "")]]) and not is_layout([[(1, ""), (0, "x")]]) and not is_layout([[(0, "sym"), (1, ""), (0, "(1)")]]) and not is_layout([[(1, ""), (1, ""), (0, "(1)")]])


def test_captions_go_to_one_table_each(spark):
    stream = [(0, "paragraph", None, "Table 1. First"), (1, "table", "a", ""), (2, "table", "b", ""), (3, "paragraph", None, "Table 2. Second"), (4, "table", "c", "")]
    rows = spark.createDataFrame([(1, *r) for r in stream], "ms_id int, idx int, kind string, float_id string, text string")
    found = {r.float_id: r["at"] for r in floats.consumed_captions(rows).collect()}
    assert found == {"a": 0, "b": 3, "c": None}


def test_nearest_caption_prefers_its_own_paragraph_then_below(spark):
    paragraphs = spark.createDataFrame([(1, 0, "Figure 1. Above"), (1, 1, "words"), (1, 2, "Figure 2. Below"), (1, 9, "see Fig. 3: inside")], "ms_id int, idx int, text string")
    figures = spark.createDataFrame([(1, "x", 1), (1, "y", 9), (1, "z", 20)], "ms_id int, float_id string, idx int")
    found = {r.float_id: r.number for r in floats.nearest_captions(figures, paragraphs).collect()}
    assert found == {"x": "2", "y": "3", "z": None}


def test_anchors(spark):
    long = lambda s: f"{s} is a paragraph that is long enough to be found again"
    stream = spark.createDataFrame([(1, 0, long("first")), (1, 1, long("second")), (1, 2, "Figure 1. A caption that is found in the text itself")], "ms_id int, pos int, text string")
    source = spark.createDataFrame([(1, 0, long("first")), (1, 1, ""), (1, 2, long("second")), (1, 3, "")], "ms_id int, idx int, text string")
    figures = spark.createDataFrame([(1, "f1", 1, "Figure 1. A caption that is found in the text"), (1, "f2", 3, "")], "ms_id int, fig_id string, para_index int, caption string")
    found = {r.fig_id: (r.pos, r.method) for r in floats.anchors(figures, stream, source).collect()}
    assert found == {"f1": (2, "caption"), "f2": (2, "neighbour")}
    alone = floats.anchors(figures.where("fig_id = 'f2'"), stream, source.withColumn("text", F.lit(""))).first()
    assert alone.method == "estimated"
    merged = floats.inserted(stream, spark.createDataFrame([(1, 1, "f2")], "ms_id int, pos int, fig_id string"), stream.where("pos = 2").select("ms_id", "pos"))
    assert [r.fig_id for r in merged.orderBy("new_pos").collect()] == [None, "f2", None]


def test_front_matter(spark):
    lines = ["DIAGNOSTICA, 20xx, Vol. xx", "A study of many winds over one sea", "Ann Miller¹*, Carl Stone², Eve Long²", "1 University of Somewhere, Oslo, Norway", "2 Institute, Bergen", "contact a@b.org"]
    rows = spark.createDataFrame([(1, i, t, "") for i, t in enumerate(lines)], "ms_id int, idx int, text string, style string")
    none = spark.createDataFrame([(1, "")], "ms_id int, title string")
    found = frontmatter.title(none, rows).first()
    assert (found.title, found.method) == (lines[1], "heuristic")
    assert frontmatter.title(spark.createDataFrame([(1, "Own")], "ms_id int, title string"), rows).first().method == "explicit"
    people = frontmatter.authors(rows).orderBy("ord").collect()
    assert [(p.given, p.family, p.corresponding, p.affiliation_ids) for p in people] == [("Ann", "Miller", True, ["aff1"]), ("Carl", "Stone", False, ["aff2"]), ("Eve", "Long", False, ["aff2"])]
    places = {p.aff_id: p.country for p in frontmatter.affiliations(rows).collect()}
    assert places["aff1"] == "Norway" and places["aff2"] == "Bergen"


def test_keywords_are_not_part_of_the_abstract(spark):
    rows = spark.createDataFrame([(1, 0, "We did it."), (1, 1, "Keywords: in the middle"), (1, 2, "It worked."), (1, 3, "Key words: a; b")], "ms_id int, blk_ord int, text string")
    found = frontmatter.abstract(rows).first()
    assert found.abstract_raw == "We did it. Keywords: in the middle It worked." and found.split_keywords == 1


def test_reference_list(spark):
    entries = ["[1] A. Miller (2019). One thing and another,", "continued here.", "[2] C. Stone, Other 2020."]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(entries)], "ms_id int, idx int, text string")
    found = frontmatter.references(rows).orderBy("ord").collect()
    assert [(r.ref_id, r.year) for r in found] == [("ref1", 2019), ("ref2", 2020)] and "continued" in found[0].raw


def test_nothing_is_mined_from_nothing(spark):
    assert mining.mined(spark.createDataFrame([(1, ""), (2, "Plain words. 250 words somewhere.")], "ms_id int, text string")).isEmpty()


def test_spelled_numbers_and_look_back(spark):
    rows = spark.createDataFrame([(1, "Abstract\n(250 words max.)\nGive a minimum of three to a maximum of six keywords.")], "ms_id int, text string")
    found = {r.what: (r.low, r.high) for r in mining.mined(rows).collect()}
    assert found["abstract_words"] == (None, 250) and found["keyword_range"] == (3, 6)


def test_runs_nest(spark):
    run = "kind string, text string, bold boolean, italic boolean, superscript boolean, subscript boolean, smallcaps boolean, code boolean, url string, target_id string, ref_ids array<string>"
    make = lambda kind, text, bold=False, italic=False, url=None, refs=(): (kind, text, bold, italic, False, False, False, False, url, "t1", list(refs))
    rows = spark.createDataFrame([([make("text", "a&b", True, True), make("math", "x^2"), make("math", "_{}"), make("cite", "", refs=["ref1", "ref 2"]), make("link", "here", url="http://u")],)], f"runs array<struct<{run.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array', ':array')}>>")
    text = rows.select(render.inlines(F.col("runs")).alias("x"), render.plain_text(F.col("runs")).alias("p")).first()
    assert text.x == "\\textbf{\\emph{a\\&b}}$x^2$[equation]\\cite{ref1,ref2}\\href{http://u}{here}" and text.p == "a&b$x^2$$_{}$here"


def test_bibtex_says_what_is_missing(spark):
    people = "authors array<struct<family:string,given:string>>"
    rows = spark.createDataFrame([(1, 1, "ref1", 0.9, [("Miller", "A.")], "T", 2019, "", "", "", "10.1/x", ""), (1, 2, "ref2", 0.2, [], "", None, "", "", "", "", "")], f"ms_id int, ord int, ref_id string, confidence double, {people}, title string, year int, volume string, issue string, page string, doi string, url string")
    found = render.bibtex(rows).first()
    assert (found.kept, found.total, found.missing) == (1, 2, ["ref2"]) and "author = {Miller, A.}" in found.bibtex and "ref2" not in found.bibtex


def test_logos_and_blanks_go(spark):
    rows = spark.createDataFrame([(1, 0, "", False, 0.0), (1, 1, "", True, 20.0), (1, 2, "ISSN 1", False, 0.0), (1, 3, "The Title", False, 0.0), (1, 4, "", True, 20.0), (1, 5, "", False, 0.0)], "ms_id int, idx int, text string, has_drawing boolean, width_mm double")
    titles = spark.createDataFrame([(1, "the  title")], "ms_id int, title string")
    assert {r.idx: r.reason for r in layout.removals(rows, titles).collect()} == {0: "leading blank", 1: "logo", 2: "ISSN line"}
    assert layout.cleaned(rows, titles).count() == 3


def test_columns(spark):
    sections = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 1), (3, 0, 2)], "ms_id int, part int, columns int")
    wanted = spark.createDataFrame([(1, 2, True), (2, 2, True), (3, 1, False)], "ms_id int, want int, has_body boolean")
    assert {(r.ms_id, r.part): r.action for r in layout.columns_plan(sections, wanted).collect()} == {(1, 0): "keep", (1, 1): "keep", (2, 0): "split", (3, 0): "collapse"}


def test_styles(spark):
    s = "style_id string, name string, props string"
    merged = layout.merged_styles(spark.createDataFrame([("a", "Normal", "t"), ("b", "Own", "t")], s), spark.createDataFrame([("x", "normal ", "s"), ("b", "Heading", "s")], s))
    assert {r.style_id: (r.props, r.origin) for r in merged.collect()} == {"a": ("s", "both"), "b": ("t", "target"), "bX": ("s", "template")}
    links = layout.remapped(spark.createDataFrame([("bX", "x"), ("bX", "gone")], "style_id string, refers_to string"), merged).collect()
    assert [(r.style_id, r.refers_to) for r in links] == [("bX", "a")]


def test_widths(spark):
    cells = spark.createDataFrame([(1, "t", 0, 0, "wide cell", 2), (1, "t", 0, 1, "x", 1), (1, "t", 1, 0, "ab", 1), (1, "t", 1, 1, "cdef", 1), (1, "t", 1, 2, "g", 1)], "ms_id int, tab_id string, row int, col int, text string, colspan int")
    widths = {r.column: r.width for r in floats.column_widths(cells).collect()}
    assert widths == {0: 9, 1: 4, 2: 3} and floats.natural_widths(floats.column_widths(cells)).first().natural == 22


def test_labels_leave_runs(spark):
    rows = spark.createDataFrame([([("text", "Fig. 3"), ("text", ": A curve"), ("math", "x")], 8), ([("math", "y"), ("text", "ab")], 3), ([], 2)], "runs array<struct<kind:string,text:string>>, n int")
    found = rows.select(render.without_label(F.col("runs"), F.col("n")).alias("r")).collect()
    assert [[tuple(x) for x in r.r] for r in found] == [[("text", "A curve"), ("math", "x")], [("math", "y"), ("text", "ab")], []]


def test_no_table_of_paragraphs_is_broadcast(spark):
    stream = spark.createDataFrame([(1, j, f"paragraph {j} is long enough to be found again") for j in range(120)], "ms_id int, pos int, text string")
    source = spark.createDataFrame([(1, j, f"paragraph {j} is long enough to be found again" if j in (0, 50, 99) else "") for j in range(120)], "ms_id int, idx int, text string")
    figures = spark.createDataFrame([(1, f"f{p}", p, "") for p in (24, 25, 26, 50, 74, 75, 119)], "ms_id int, fig_id string, para_index int, caption string")
    placed = floats.anchors(figures, stream, source)
    put = floats.inserted(stream, placed, stream.where("pos = 3").select("ms_id", "pos"))
    for found in (placed, put):
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.fig_id: (r.pos, r.method) for r in placed.collect()} == {
        "f24": (1, "neighbour"), "f25": (25, "estimated"), "f26": (50, "neighbour"), "f50": (50, "estimated"), "f74": (51, "neighbour"), "f75": (99, "neighbour"), "f119": (100, "neighbour"),
    }
    assert put.count() == 120 - 1 + 7


def test_the_issues_of_floats_broadcast_nothing(spark, sf_dir):
    found = catalog.queries()["m_float_issues"](spark, sf_dir)
    assert not found.isEmpty() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
