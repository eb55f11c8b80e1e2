import pytest
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import plain
from scriptorium.functions import text as T
from scriptorium.operators import audit, compliance, review
from scriptorium.plans import adapters as X
from scriptorium.plans import catalog
from scriptorium.session import ship

MS = "ms_id int, title string, abstract_raw string, keywords array<string>, highlights array<string>, abstract_paragraphs int, abstract_has_math boolean"


def corpus(spark, abstract="Short words only.", figures=(), refs=(), issues=()):
    return {
        "manuscripts": spark.createDataFrame([(1, "A title of some six words here", abstract, ["a", "b"], None, 1, False)], MS),
        "sections": spark.createDataFrame([(1, 0, 1, "introduction", "Introduction")], "ms_id int, sec_ord int, level int, role string, title_raw string"),
        "blocks": spark.createDataFrame([(1, 0, 0, "paragraph", "We may propose a novel thing. It is so.")], "ms_id int, sec_ord int, blk_ord int, kind string, text string"),
        "figures": spark.createDataFrame(list(figures), "ms_id int, fig_id string, fmt string, is_vector boolean, width_px int, placed_width_mm double, caption_raw string"),
        "tables": spark.createDataFrame([], "ms_id int, tab_id string, caption_raw string"),
        "refs": spark.createDataFrame(list(refs), "ms_id int, ord int, ref_id string, doi string, confidence double, year int"),
        "issues": spark.createDataFrame(list(issues), "ms_id int, seq int, severity string, code string, message string"),
    }


def rules(spark, verified=True, limits=None, **parts):
    table = compliance.profiles(spark, [dict(profile_id="p", publisher="x", journal="y", verified=verified, **(limits or {}))])
    return {r.rule: r for r in compliance.findings(corpus(spark, **parts), table).collect()}


def test_limits_that_are_not_verified_never_fail(spark):
    limits = dict(abstract_max_words=1, keywords_min=5, title_max_chars=3, required_sections=["methods"], manuscript_max_words=1)
    assert {r.severity for r in rules(spark, False, limits, refs=[(1, 1, "r", "", 0.9, 2000)]).values()} <= {"warn", "pass", "info"}
    assert rules(spark, True, limits)["abstract.max_words"].severity == "fail"


def test_what_every_journal_wants_fails_anyway(spark):
    found = rules(spark, False, {}, abstract="  ")
    assert found["abstract.present"].severity == "fail" and found["references.present"].severity == "fail"


def test_a_limit_that_is_not_set_gives_no_finding(spark):
    assert not {r for r in rules(spark) if r.startswith(("abstract.", "keywords.", "title.", "structure.length"))}
    assert "keywords.count" not in rules(spark, True, dict(keywords_min=0, keywords_max=0))


def test_resolution_is_judged_at_printed_size(spark):
    figures = [(1, "wide", "png", False, 1229, 160.0, "c"), (1, "small", "png", False, 1229, 80.0, "c"), (1, "vector", "pdf", True, None, 160.0, "c"), (1, "unknown", "png", False, None, None, "")]
    found = rules(spark, figures=figures)
    assert found["figures.resolution"].locations == ["wide"] and found["figures.resolution_unknown"].locations == ["unknown"] and found["figures.caption"].locations == ["unknown"]


def test_no_figures_no_figure_rules(spark):
    assert [r for r in rules(spark) if r.startswith(("figures", "tables"))] == ["figures.present"]


def test_missing_sections_only_warn_while_some_are_unlabelled(spark):
    c = corpus(spark)
    c["sections"] = c["sections"].union(spark.createDataFrame([(1, 1, 1, "unknown", "Something")], c["sections"].schema))
    table = compliance.profiles(spark, [dict(profile_id="p", publisher="x", journal="y", verified=True, required_sections=["methods"])])
    found = {r.rule: r.severity for r in compliance.findings(c, table).collect()}
    assert found["structure.required_sections"] == "warn"


def test_errors_of_the_parser_are_carried(spark):
    found = rules(spark, issues=[(1, 1, "error", "no_authors", "m"), (1, 2, "warning", "no_title", "m"), (1, 3, "warning", "manual_citations", "m")], refs=[(1, 1, "r", "d", 0.9, 2000)])
    assert found["parse.no_authors"].severity == "warn" and "parse.no_title" not in found and "references.field_codes" in found


def test_score_without_decisions_is_whole(spark):
    found = spark.createDataFrame([(1, "p", "info", "figures.present")], "ms_id int, profile_id string, severity string, rule string")
    assert compliance.scores(found).first().score == 1.0


def test_unknown_profile_names_the_known(spark):
    try:
        compliance.profile(X.profiles(spark), "nope")
        raise AssertionError
    except KeyError as e:
        assert "alpha" in str(e)


def test_required_pixels_round_half_even(spark):
    row = spark.range(1).select(compliance.required_pixels(F.lit(25.4), F.lit(300)).alias("a"), compliance.required_pixels(F.lit(90.0), F.lit(300)).alias("b")).first()
    assert (row.a, row.b) == (300, 1063)


def test_every_check_has_a_weight_and_a_score_between_0_and_1(spark, sf_dir):
    from scriptorium.plans.rule_queries import _checks

    assert _checks(spark, sf_dir).where("score < 0 OR score > 1 OR weight < 0 OR severity IS NULL").isEmpty()


def test_scope_counts_whole_words(spark):
    rows = spark.createDataFrame([(["heat", "heat pump", "C++"], "Heat-pump heater in c++")], "t array<string>, h string")
    assert rows.select(review.whole_words(F.col("t"), review.padded_words(F.col("h"))).alias("x")).first().x == ["heat", "heat pump", "C++"]
    assert rows.select(review.whole_words(F.array(F.lit("pum"), F.lit("eat")), review.padded_words(F.col("h"))).alias("x")).first().x == []


def test_retention(spark):
    e = spark.createDataFrame([(1, 2), (2, 0), (3, 5)], "ms_id int, n int")
    g = spark.createDataFrame([(1, 3), (2, 1), (4, 1)], "ms_id int, n int")
    found = {r.ms_id: (r.ok, r.delta) for r in audit.retention(e, g, ["ms_id"]).collect()}
    assert found == {1: (True, 1), 2: (True, 1), 3: (False, -5), 4: (True, 1)}


def test_every_seeded_fault_is_seen(spark, sf_dir):
    rows = X.lines(spark, sf_dir).where("length(text) > 4")
    tally = audit.fault_tally(audit.with_faults(rows, share=0.3), rows).collect()
    assert {r.fault for r in tally} == {"drop", "truncate", "duplicate"} and all(r.applied == r.detected for r in tally)
    none = audit.with_faults(rows, share=0.0)
    assert audit.fault_tally(none, rows).isEmpty() and audit.compared(rows, none).isEmpty()


def test_reports_are_in_order(spark):
    found = spark.createDataFrame([(1, "p", "pass", "b"), (1, "p", "fail", "a"), (1, "p", "warn", "c")], "ms_id int, profile_id string, severity string, rule string")
    assert compliance.report(found).first().report == "FAIL [a]\nWARN [c]\nPASS [b]"


def test_ready_needs_all(spark):
    checks = spark.createDataFrame([(1, True), (1, False), (2, True), (3, True)], "ms_id int, ok boolean")
    blocked = audit.blocking(spark.createDataFrame([(1, 0, 1, 0, 0), (2, 0, 1, 0, 0), (3, 1, 0, 5, 0)], "ms_id int, mathtype int, citation_fields int, refs int, unconvertible int"))
    assert {r.ms_id: r.ready for r in audit.ready(checks, blocked).collect()} == {1: False, 2: True, 3: False}


#: queries in which texts are read once, not once for each partition of profiles
READ_ONCE = ["e_08_category_scores", "f_11_desk_risk", "f_09_priorities", "f_10_weakest", "i_review_checks"]


@pytest.mark.parametrize("name", READ_ONCE)
def test_profiles_go_to_the_manuscripts(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin BuildLeft" not in plan


TEXTS = [
    "Data are available. The CODE is available on GitHub; see the Open-source version.", "Available on request", "available from the corresponding author", "two Repositories", "a repository", "data availability",
    "Z\u0415NODO", "zenodo", "figshare", "dryad", "source code", "open source", "code will be available", "code are available", "data will be available", "data is available", "MATLAB", "S\u0130mul\u0131nk", "\u017fimulink", "Python", "homer", "COMSOL",
    "AN\u017fYS", "simulin\u212a", "TRNSYS", "PVsyst", "R  statistical", "R\nstatistical", "R is statistical", "Our Parameters are\nin a table", "The parameter set is given here.", "\u212aelvin, stra\u00dfe", "pythonic and available", "", None,
    "It may be so. It could not! Perhaps \u0130t is bel\u0131eved; \u017fomewhat, as it SEEMS to and suggests that; dismay is maybe no hedge\u2003and might is.\n\nTwo more words here.  ", " . ", "one two three",
]


def test_signals_and_hedges_are_those_of_the_whole_patterns(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    plain = sum((T.matches(F.col("t"), p, True).cast("int") for p in P.REPRODUCIBILITY.values()), F.lit(0))
    hedges = F.regexp_count("t", T.rx(P.HEDGE)) / F.greatest(F.lit(1.0), T.word_count(F.col("t")) / 1000)
    found = rows.select("t", review.signals(F.col("t")).alias("a"), plain.alias("b"), review.writing_facts(F.col("t"))["hedges_per_1000"].alias("c"), hedges.alias("d")).collect()
    assert [r for r in found if r.a != r.b or r.c != r.d] == [] and sum(r.a or 0 for r in found) >= 24 and max(r.c or 0 for r in found) >= 6


def test_texts_of_a_manuscript_come_from_one_pass(spark):
    sections = spark.createDataFrame([(1, 0, "abstract", "A"), (1, 1, "introduction", ""), (1, 2, "introduction", "C"), (2, 0, "introduction", "T"), (3, 0, "methods", None)], "ms_id int, sec_ord int, role string, title_raw string")
    blocks = spark.createDataFrame([(1, 1, 1, "paragraph", "second"), (1, 1, 0, "paragraph", "first"), (1, 2, 0, "paragraph", "later"), (1, 0, 0, "paragraph", ""), (2, 0, 0, "table", "x"), (3, 0, 0, "paragraph", None)], "ms_id int, sec_ord int, blk_ord int, kind string, text string")
    whole = {r.ms_id: r.all_text for r in review.corpus_text(sections, blocks).collect()}
    opening = {r.ms_id: r.text for r in review.section_text(sections, blocks, "introduction").collect()}
    made = {r.ms_id: r for r in review.corpus_texts(sections, blocks).collect()}
    assert opening == {1: "first second"} and all(made[k].all_text == v for k, v in whole.items()) and {k: r.introduction for k, r in made.items()} == {1: "first second", 2: None, 3: None}


@pytest.mark.parametrize("name", READ_ONCE)
def test_rows_of_manuscripts_and_profiles_stay_with_the_manuscript(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BroadcastNestedLoopJoin")[0]
    assert "Generate posexplode" in above and "SortMergeJoin" not in above
    if name != "f_10_weakest":  # which counts over all manuscripts
        assert "Exchange" not in above


SENTENCES = [*TEXTS, *(f"x {w} y. Then {w.upper()}" for w in ("however", "novel", "for the first time", "we propose", "unlike prior", "few studies", "is", "results show", "used to", "under-explored", "the main contributions of this work", "ſhow")), "a  b. c d e!f g h? i j k", "  leads. on and on", " ", "a.", "x.y z\x85w", "İı \U0001d400\U0001d401 é"]


def test_lowered_patterns_find_what_patterns_find_in_any_case(spark):
    """Every pattern of the checks, told by first letters on lowered text, against the plain one."""
    rows = spark.createDataFrame([(t,) for t in SENTENCES], "t string")
    every = [*P.MOVES.values(), *P.NOVELTY, *P.REPRODUCIBILITY.values(), P.HEDGE]
    assert all("(?=[" in T.lowered_pattern(p) for p in every)
    pairs = [(F.regexp_count(T.lowered(F.col("t")), T.rx(T.lowered_pattern(p))), F.regexp_count("t", T.rx(p, True))) for p in every]
    found = rows.select(*[F.sum((~a.eqNullSafe(b)).cast("int")).alias(f"c{n}") for n, (a, b) in enumerate(pairs)], *[F.sum(b).alias(f"n{n}") for n, (_, b) in enumerate(pairs)]).first()
    assert not any(found[: len(every)]) and sum(n > 0 for n in found[len(every) :]) >= 12


def test_words_are_counted_without_a_row_of_words(spark):
    rows = spark.createDataFrame([(t,) for t in SENTENCES], "t string")
    sentences = F.transform(F.split("t", r"(?U)(?<=[.!?])\s+"), lambda s: F.size(T.words(s)))
    plain = F.filter(sentences, lambda n: n > 2)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    facts = review.writing_facts(F.col("t"))
    found = rows.where("t IS NOT NULL").select("t", T.word_count(F.col("t")).alias("a"), F.size(T.words(F.col("t"))).alias("b"), facts["sentences"].alias("c"), F.size(plain).alias("d"), facts["mean_words"].alias("e"), F.try_divide(total(plain), F.size(plain)).alias("f")).collect()
    assert [r for r in found if (r.a, r.c, r.e) != (r.b, r.d, r.f)] == [] and sum(r.c for r in found) > 20


def test_structure_comes_from_the_pass_over_the_texts(spark, sf_dir):
    """The checks read lines twice, as sections and as paragraphs, and count as the text facts do."""
    corpus = X.corpus(spark, sf_dir)
    keys = ["ms_id", "present", "words", "abstract_words", "unlabelled", "top_roles"]
    tidy = lambda df: df.select("ms_id", F.array_sort("present"), *keys[2:])
    plain = tidy(compliance.text_facts(corpus["manuscripts"], corpus["sections"], corpus["blocks"]))
    whole = review.corpus_texts(corpus["sections"], corpus["blocks"], structure=True)
    made = tidy(compliance.front_facts(corpus["manuscripts"].join(whole, "ms_id", "left")))
    assert made.exceptAll(plain).isEmpty() and plain.exceptAll(made).isEmpty()
    for name in READ_ONCE:
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Generate posexplode(split") == 2


def test_plain_texts_have_the_facts_of_all_texts(spark):
    """Arrow's patterns and the bytes of words, against the expressions; texts beyond ASCII are left to those."""
    more = [f"{lead}{text}{tail}" for text in SENTENCES if text for lead, tail in (("", ""), ("\x0bNo\x0b", " yet. "), ("no a\rb study! ", "\r\nno x. study?"), ("5 kg6kg 5%6% 7\x0bkW, 3.5 Hz", " (Li et al., 2001) [3]Fig. 2"), ("a\x1fb c. ", "\x1c. d e f." + " w" * 41))]
    rows = spark.createDataFrame([(t,) for t in [*SENTENCES, *more]], "t string").repartition(3).withColumns({"title": F.lit("For the first time"), "introduction": F.concat(F.lit("No. "), F.reverse("t")), "abstract_has_math": F.lit(None).cast("boolean")})
    ship(spark)
    front = F.concat_ws(" ", "title", "t", "introduction")
    rows = rows.withColumns({"w": plain.whole_facts(plain.only(F.col("t"))), "a": plain.abstract_facts(plain.only(F.col("t"), front), plain.only(front))})
    one = rows.select("t", "w", "a", T.word_count(F.col("t")).alias("words"), review.writing_facts(F.col("t")).alias("f"), review.signals(F.col("t")).alias("s"), review.abstract_facts(F.col("t")).alias("b")).collect()
    seen = [r for r in one if r.w is not None]
    assert {r.t for r in one if r.w is None} == {t for t in [*SENTENCES, *more] if t is None or not t.isascii()}
    for r in seen:
        assert (r.w.words, r.w.sentences, r.w.signals) == (r.words, r.f.sentences, r.s), r.t
        assert r.w.hedges / max(1.0, r.w.words / 1000) == r.f.hedges_per_1000 and (r.w.total, r.w.long) == (round((r.f.mean_words or 0) * r.w.sentences), round((r.f.long_share or 0) * r.w.sentences)), r.t
        assert r.a == r.b, r.t
    assert len(seen) > 150 and max(r.a.quantities for r in seen) >= 4 and {r.a.foreign for r in seen} == {True, False} and max(r.a.novel for r in seen) >= 2 and min(r.a.missing for r in seen) < 4


def test_texts_of_the_checks_are_read_by_arrow(spark, sf_dir):
    """The checks' patterns run over all of a text in Arrow, once; only texts beyond ASCII meet the expressions."""
    for name in READ_ONCE:
        made = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert made.count("ArrowEvalPython") == 2
    corpus = X.corpus(spark, sf_dir)
    odd = lambda c: F.concat(c, F.when(F.col("ms_id") % 2 == 0, " é").otherwise(""))
    corpus |= {"blocks": corpus["blocks"].withColumn("text", odd("text")), "manuscripts": corpus["manuscripts"].withColumn("abstract_raw", odd("abstract_raw"))}
    facts = review.review_facts(corpus, 2000).select("ms_id", "words", "writing", "signals", "abstract_facts", "title_words")
    texts = review.corpus_text(corpus["sections"], corpus["blocks"]).join(review.section_text(corpus["sections"], corpus["blocks"], "introduction").withColumnRenamed("text", "introduction"), "ms_id", "left").join(corpus["manuscripts"], "ms_id")
    abstract = T.stripped(F.col("abstract_raw"))
    words = corpus["blocks"].groupBy("ms_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"))
    expected = texts.join(words, "ms_id").select("ms_id", "words", review.writing_facts(F.col("all_text")).alias("writing"), review.signals(F.col("all_text")).alias("signals"), F.when(abstract != "", review.abstract_facts(abstract)).alias("abstract_facts"), T.word_count(T.stripped(F.col("title"))).alias("title_words"))
    assert facts.exceptAll(expected).isEmpty() and expected.exceptAll(facts).isEmpty()


@pytest.mark.parametrize("name", READ_ONCE)
def test_checks_are_compiled(spark, sf_dir, name):
    """What a generator or a lambda holds is interpreted, so all checks are made before their rows are."""
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if " AS checks#" in line]
    assert "Generate posexplode(checks" in plan and len(made) == 1 and "Project" in made[0] and "lambda" not in made[0]
