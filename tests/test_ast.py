import json

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import floats, tree, views
from scriptorium.sources import ast


def s(text):
    return {"t": "Str", "c": text}


SP = {"t": "Space"}


def para(*nodes):
    return {"t": "Para", "c": list(nodes)}


def cell(*blocks, span=1):
    return [["", [], []], {"t": "AlignRight"}, 1, span, list(blocks)]


MATH = {"t": "Math", "c": [{"t": "InlineMath"}, "a=b"]}
TABLE = {"t": "Table", "c": [["", [], []], [None, [para(s("Table"), SP, s("1"))]], [], [[], [[[], [cell(para(s("x")), span=2)]]]], [[[], 0, [], [[[], [cell(para(MATH)), cell(para(s("(3)")))]]]]], [[], []]]}
DOCUMENT = {"blocks": [
    {"t": "Header", "c": [1, ["", [], []], [s("Methods")]]},
    para({"t": "Strong", "c": [s("bold"), SP, {"t": "Emph", "c": [s("both")]}]}, MATH, {"t": "Quoted", "c": [{"t": "DoubleQuote"}, [s("q")]]}, {"t": "SoftBreak"}, {"t": "Image", "c": [["", [], []], [], ["m/a.png", ""]]}),
    {"t": "BlockQuote", "c": [para(s("indented"))]},
    {"t": "BulletList", "c": [[para(s("one"))], [para(s("two")), {"t": "OrderedList", "c": [[1, {}, {}], [[para(s("deep"))]]]}]]},
    {"t": "Div", "c": [["", [], []], [{"t": "CodeBlock", "c": [["", ["py"], []], "x = 1"]}]]},
    {"t": "DefinitionList", "c": [[[s("term")], [[para(s("meaning"))]]]]},
    {"t": "LineBlock", "c": [[s("l1")], [s("l2")]]}, {"t": "HorizontalRule"}, {"t": "RawBlock", "c": ["tex", "\\x"]}, {"t": "Strange", "c": 1}, TABLE,
    para(s("see"), SP, {"t": "Link", "c": [["", [], []], [s("here")], ["http://u", ""]]}, {"t": "Cite", "c": [[{"citationId": "k1"}], [s("[1]")]]}, {"t": "Note", "c": []}, {"t": "Code", "c": [["", [], []], "f()"]}),
]}


def records(spark):
    trees = [("a", json.dumps(DOCUMENT)), ("b", "no json"), ("c", '{"blocks": []}'), ("d", None)]
    return ast.rows(spark.createDataFrame(trees, "ms_id string, tree string")).cache()


def test_blocks_in_order(spark):
    rows = ast.blocks(records(spark)).where("ms_id = 'a'").orderBy("seq").collect()
    top = [(r.kind, r.text) for r in rows if r.parent is None]
    assert top == [
        ("paragraph", "bold both$a=b$“q” "), ("paragraph", "indented"), ("list", "BulletList"), ("code", "x = 1"), ("paragraph", "term"), ("paragraph", "meaning"), ("paragraph", "l1"), ("paragraph", "l2"),
        ("raw", "\\x"), ("raw", '{"t": "Strange", "c": 1}'), ("table_ref", "Table 1"), ("paragraph", "see here[1]f()"),
    ]
    assert [(r.text, r.item) for r in rows if r.parent is not None][:2] == [("one", 0), ("two", 1)] and any(r.text == "deep" for r in rows)
    runs = rows[0].inlines
    assert [(r.text, r.bold, r.italic) for r in runs[:3]] == [("bold", True, False), (" ", True, False), ("both", True, True)]
    assert rows[-1].inlines[2].url == "http://u" and rows[-1].inlines[3].ref_ids == ["k1"] and rows[-1].inlines[-1].code
    assert ast.images(DOCUMENT) == ["m/a.png"]


def test_issues_of_trees(spark):
    found = {(r.ms_id, r.code) for r in ast.issues(records(spark)).collect()}
    assert found == {("a", "blockquote_unwrapped"), ("a", "unhandled_block"), ("b", "unreadable_tree"), ("d", "unreadable_tree")}


def test_cells(spark):
    rows = ast.cells(records(spark)).orderBy("row", "col").collect()
    assert [(r["row"], r["col"], r.colspan, r.align, r.n_math, r.text, r.latex) for r in rows] == [(0, 0, 2, "right", 0, "x", None), (1, 0, 1, "right", 1, "", "a=b"), (1, 1, 1, "right", 0, "(3)", None)]
    assert floats.equation_layouts(ast.cells(records(spark)).where("row = 1")).first().number_raw == "3"


def test_headings_feed_the_tree(spark):
    assert [(r.title_raw, r.parent_ord) for r in tree.parents(ast.headings(records(spark))).collect()] == [("Methods", None)]
    assert views.numbered_display(ast.blocks(records(spark))).where("ms_id = 'a'").first().formulas == 1


def test_folding(spark):
    rows = spark.createDataFrame([("é and 𝜸 𝐀 𝚪 𝐗 𝟗", ), (None,), ("ﬁ ½ ☃",), ("é",)], "t string").select(T.folded(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["é and $\\boldsymbol{\\gamma}$ $\\boldsymbol{A}$ $\\boldsymbol{\\Gamma}$ $\\boldsymbol{X}$ $\\boldsymbol{9}$", None, "fi 12 ", "e"]


def test_markers_and_names(spark):
    row = spark.range(1).select(T.clean_name(F.lit("Miller*1")).alias("a"), T.without_marker(F.lit(" 1. Department")).alias("b"), T.without_label(F.lit("Fig. 3: A curve")).alias("c"), T.is_coder_model(F.lit("DeepSeek-Coder")).alias("d"), T.service_error(F.lit(404), F.lit("Model NOT FOUND")).alias("e")).first()
    assert tuple(row) == ("Miller", "Department", "A curve", True, "gone")


def test_views(spark):
    rows = spark.createDataFrame([(1, i, t, h) for i, (t, h) in enumerate([("Intro", True), ("two words", False), ("three more words", False)])], "ms_id int, idx int, text string, is_heading boolean")
    assert views.selected_words(rows, 1, 2).first().words == 5 and views.matching(rows, "TWO").count() == 1 and views.matching(rows, "", True).count() == 1
    ranges = spark.createDataFrame([(1, 0)], "ms_id int, end int")
    assert tuple(views.default_ranges(rows, ranges).first()) == (1, 1, 2) and tuple(views.default_ranges(rows, ranges.limit(0)).first()) == (1, 0, 2)
    ms = spark.createDataFrame([(1, "T", ["a"], None), (2, "U", ["b"], None)], "ms_id int, title string, keywords array<string>, highlights array<string>")
    edits = spark.createDataFrame([(1, None, "x; y ;", "h1\nh2")], "ms_id int, title string, keywords string, highlights string")
    found = {r.ms_id: r for r in views.edited_front(ms, edits).collect()}
    assert found[1].keywords == ["x", "y"] and found[1].highlights == ["h1", "h2"] and found[1].title == "T" and found[1].method == "explicit" and found[2].method == "heuristic"
    assert tuple(views.stats(ms, rows=rows, none=rows.limit(0)).orderBy("ms_id").first()) == (1, 3, 0)
    failed = spark.createDataFrame([(9, "BadZipFile")], "ms_id int, error string")
    audits = spark.createDataFrame([(1, "tables", 2, 2, True), (1, "images", 3, 1, False)], "ms_id int, what string, expected int, got int, ok boolean")
    issues = spark.createDataFrame([(1, "error")], "ms_id int, severity string")
    scores = spark.createDataFrame([(1, 2, 3)], "ms_id int, failures int, warnings int")
    out = {r.ms_id: r for r in views.evaluation(audits, issues, scores, failed).collect()}
    assert not out[1].parse_retained and out[1].counts["images"].got == 1 and out[9].note == "parse failed: BadZipFile" and not out[9].parse_ok
