import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import text as T


def value(spark, column, **values):
    names = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in names.items()]).select(column.alias("x")).first().x


def of(spark, function, text):
    return value(spark, function(F.col("t")), t=text)


@pytest.mark.parametrize("title, role", [
    ("Results and discussion", "results_discussion"), ("  MATERIALS   AND METHODS. ", "methods"), ("Literature review", "related_work"), ("Optimization", "methods"),
    ("Data Availability Statement", "data_availability"), ("Some other words", "unknown"), ("", "unknown"), ("Conclusions and outlook:", "conclusion"), ("Appendix B. More", "appendix"),
])
def test_roles(spark, title, role):
    assert of(spark, T.role_of, title) == role


def test_null_title_has_no_role(spark):
    assert spark.range(1).select(T.role_of(F.lit(None).cast("string")).alias("x")).first().x == "unknown"


@pytest.mark.parametrize("text, number", [("3.2 Setup", "3.2"), ("IV. Results", "IV"), ("(2) Next", "2"), ("A novel thing", "A"), ("Plain title", ""), ("2nd try", "")])
def test_numbering(spark, text, number):
    assert of(spark, T.numbering_of, text) == number


@pytest.mark.parametrize("text, vetoed", [("eta, efficiency;", True), ("Power [kW]", True), ("(a)", True), ("(12)", True), ("Fig. 3 shows", True), ("where: x", True), ("a@b.org", True), ("Case 2:", True), ("   ", True), ("Introduction", False), ("System model", False)])
def test_vetoes(spark, text, vetoed):
    assert of(spark, T.cannot_be_heading, text) is vetoed


@pytest.mark.parametrize("text, label", [("ISSN 1234-5678", "ISSN line"), ("DOI:", "empty DOI placeholder"), ("© 2020 The Publisher", "copyright line"), ("xxxxxx here", "placeholder text"), ("The results show a gain.", None), ("We do not change the model", None)])
def test_furniture(spark, text, label):
    assert of(spark, T.furniture_label, text) == label


def test_captions(spark):
    c = of(spark, T.caption, "Table 2. Results\nof it")
    assert (c.kind, c.number, c.rest) == ("table", "2", "Results\nof it")
    assert of(spark, T.caption, "In Fig. 3 we see") is None
    assert of(spark, lambda t: T.caption(t, anywhere=True), "x Fig. 3 we see").number == "3"


@pytest.mark.parametrize("latex, nothing", [("", True), (None, True), ("_{}", True), ("^{}^{}", True), ("\\ ", True), ("\\quad", True), ("x", False), ("\\frac{a}{b}", False)])
def test_degenerate(spark, latex, nothing):
    assert spark.range(1).select(T.is_degenerate_math(F.lit(latex).cast("string")).alias("x")).first().x is nothing


def test_reference(spark):
    r = of(spark, T.parse_reference, '[3] A. B. Miller, C. Stone (2019). "Winds over the northern sea," J. Winds, 12(3), 45-67. doi:10.1234/abc.9.')
    assert (r.doi, r.year, r.volume, r.issue, r.page) == ("10.1234/abc.9", 2019, "12", "3", "45-67")
    assert [(a.family, a.given) for a in r.authors] == [("Miller", "A. B."), ("Stone", "C.")]
    assert r.title == "Winds over the northern sea" and r.confidence == 1.0 and r.raw.startswith("[3]")
    bare = of(spark, T.parse_reference, "nothing to see")
    assert bare.confidence == 0.0 and bare.year is None and bare.raw == "nothing to see"


def test_url_only_without_doi(spark):
    assert of(spark, T.parse_reference, "Some page, https://x.org/a.").url == "https://x.org/a"


def test_run_on_references(spark):
    one = "A. Miller, Winds over seas and what they do to ships, 12, 45-67. "
    two = "Stone C. Ships in winds and what they do to the seas, 2020, 100-120."
    assert of(spark, T.split_run_on, one + two) == [one.strip(), two]
    assert of(spark, T.split_run_on, "short 1-2. Stone C. other") == ["short 1-2. Stone C. other"]
    assert of(spark, T.split_run_on, "  ") == []


def test_keywords(spark):
    assert of(spark, T.split_keywords, "Keywords: solar cells; wind, x, • heat pumps | grid.") == ["solar cells", "wind", "heat pumps", "grid"]


def test_quote_key(spark):
    assert of(spark, T.quote_key, "  “It’s\n a –  Test” ") == "\"it's a - test\""


def test_match_key_drops_formulas(spark):
    assert of(spark, T.match_key, "A $x^2$ B" + T.MATH_MARK + "c-9") == "abc9"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=40), min_size=1, max_size=6))
def test_words_like_python(spark, texts):
    """Python's own split knows four separators more, which are left out here."""
    texts = [re.sub("[\x1c-\x1f\x85]", "", t) for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [len(t.split()) for t in texts]


PARITY = ["Été 2019 – naïve résumé", "we propose a novel approach", "a b", "x may be 5 kW and 3 %", "Fig. 2 and table 3", "ÉCOLE", "(Müller et al., 2019)", ""]


@pytest.mark.parametrize("pattern, ignore_case", [(p, True) for p in P.NOVELTY + list(P.MOVES.values())] + [(P.QUANTITY, False), (P.CITATION_IN_ABSTRACT, False), (P.EMAIL, False), (r"^\w+$", False)])
def test_patterns_like_python(spark, pattern, ignore_case):
    rows = spark.createDataFrame([(t,) for t in PARITY], "t string").select(T.matches(F.col("t"), pattern, ignore_case).alias("x")).collect()
    assert [r.x for r in rows] == [bool(re.search(pattern, t, re.I if ignore_case else 0)) for t in PARITY]


def test_features(spark):
    f = of(spark, T.structural_features, "2.1 Results of the TEST:")
    assert (f.n_words, f.starts_number, f.num_depth, f.ends_colon, f.short, f.has_digit) == (5, 1, 2, 1, 1, 1)
    empty = of(spark, T.structural_features, "")
    assert empty.n_words == 0 and empty.upper_ratio == 0 and empty.n_stopwords == 0


def test_latex_escape_keeps_its_own_braces(spark):
    assert of(spark, T.latex_escaped, "a\\b {c} 5% ~") == "a\\textbackslash{}b \\{c\\} 5\\% \\textasciitilde{}"


def test_equations(spark):
    assert of(spark, T.without_manual_number, "a = b \\quad (12)") == "a = b"
    assert of(spark, T.visual_length, "\\frac{a}{b} + c") == 6
    long = "x" * 40
    assert value(spark, T.equation_fit(F.col("t"), F.lit(2)), t=f"{long}\\quad\\quad {long}") == "break"
    assert value(spark, T.equation_fit(F.col("t"), F.lit(2)), t=long * 2) == "scale"
    assert value(spark, T.equation_fit(F.col("t"), F.lit(1)), t=long * 2) == "keep"


def test_specificity_orders_findings(spark):
    score = lambda issue: value(spark, T.specificity(F.col("t"), F.lit(""), F.lit("")), t=issue)
    assert score("Table 3 reports 12 % against a baseline") > score("something") > score("The text could be improved and lacks depth")


def test_implicit_headings(spark):
    no = F.lit(False)
    found = lambda t, bold: value(spark, T.is_implicit_heading(F.col("t"), F.lit(bold), no, F.lit(None).cast("double")), t=t)
    assert found("Introduction", False) and found("A bold line", True)
    assert not found("A plain line", False) and not found("It ends here.", True) and not found("x" * 130, True)


def test_classified_role(spark):
    r = value(spark, T.classified_role(F.col("t"), F.lit("methods"), F.lit(0.8)), t="What we did")
    assert (r.role, r.method, r.confidence) == ("methods", "model", 0.8)
    assert value(spark, T.classified_role(F.col("t"), F.lit("methods"), F.lit(0.7)), t="What we did").role == "unknown"
    assert value(spark, T.classified_role(F.col("t"), F.lit("methods"), F.lit(0.9)), t="3. Conclusion").role == "conclusion"
