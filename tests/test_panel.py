import difflib
import random

from pyspark.sql import functions as F

from scriptorium.operators import panel

RUNS = "ms_id int, provider string, reviewer string, raw string"
GOOD = '{"findings": [{"issue": "No baseline", "why": "w", "fix": "add one", "quote": "q", "section": "Results", "severity": "MAJOR issue"}]}'


def test_malformed_answers_have_no_findings(spark):
    raws = ["plain words", "", "{}", '{"findings": "x"}', '{"findings": []}', '{"findings": [{"issue": ', None]
    assert panel.parse_findings(spark.createDataFrame([(1, "p", f"r{i}", r) for i, r in enumerate(raws)], RUNS)).isEmpty()


def test_fences_and_prose_around_an_answer(spark):
    rows = panel.parse_findings(spark.createDataFrame([(1, "p", "a", GOOD), (1, "p", "b", f"```json\n{GOOD}\n```"), (1, "p", "c", f"Here it is: {GOOD} Bye.")], RUNS)).collect()
    assert len(rows) == 3 and {r.severity for r in rows} == {"major"} and {r.issue for r in rows} == {"No baseline"}


def test_at_most_twenty_and_cut(spark):
    many = '{"findings": [' + ", ".join('{"issue": "' + "x" * 500 + '"}' for _ in range(25)) + "]}"
    rows = panel.parse_findings(spark.createDataFrame([(1, "p", "a", many)], RUNS)).collect()
    assert len(rows) == 20 and len(rows[0].issue) == 400 and rows[0].severity == "minor"


def test_quotes_are_verified(spark):
    text = "The pump was run for three hundred hours at constant load in the test bench."
    texts = spark.createDataFrame([(1, text)], "ms_id int, text string")
    quotes = [(1, "run for three hundred hours at  CONSTANT load"), (1, "run for three hundred hours at constant laod"), (1, "an invented sentence that nobody wrote"), (1, "three hundred")]
    found = panel.verified(spark.createDataFrame(quotes, "ms_id int, quote string"), texts).collect()
    assert {r.quote: r.grounded for r in found} == dict(zip([q for _, q in quotes], [True, True, False, False]))


def test_both_ways_of_grounding_agree(spark):
    texts = spark.createDataFrame([(i, f"words before number {i} and then some more words of the text {i % 3} with an end") for i in range(12)], "ms_id int, text string")
    quotes = spark.createDataFrame([(i, f"then some more words of the text {i} with an") for i in range(4)] + [(9, "words before number 3 and"), (10, "too short"), (11, "unbreakablewordofmanyletters")], "quote_id int, quote string")
    nested, anchored = panel.grounded(quotes, texts), panel.grounded(quotes, texts, few=3)
    assert sorted(map(tuple, nested.collect())) == sorted(map(tuple, anchored.collect())) and nested.count() == 13


def findings(spark, rows):
    return spark.createDataFrame(rows, "ms_id int, seq int, provider string, reviewer string, issue string, why string, fix string, quote string, severity string")


def test_agreement_counts_reviewers_and_not_findings(spark):
    same = "The baseline is missing from the comparison"
    rows = [(1, 0, "p", "a", same, "", "Add it", "", "minor"), (1, 1, "p", "a", same + ".", "", "Add it now", "", "minor"), (1, 2, "q", "a", same, "longer reason", "Add it", "", "major"), (1, 3, "p", "b", "Units are wrong in Table 3", "", "Use mm", "", "minor")]
    merged = {r.seq: r for r in panel.merged(panel.clusters(findings(spark, rows))).collect()}
    assert set(merged) == {2, 3}
    assert merged[2].agreement == 2 and merged[2].agreed_by == ["p/a", "q/a"] and merged[2].severity == "major" and merged[2].rank == 1


def test_clusters_like_a_fold(spark):
    texts = ["add a baseline to the table", "add the baseline to the table", "units differ", "unit differs", "something else entirely", "add baseline to table"]
    leaders, expected = [], []
    for i, t in enumerate(texts):
        key = t + " f"
        found = next((s for s, k in leaders if difflib.SequenceMatcher(None, key, k).ratio() >= 0.55), None)
        if found is None:
            leaders.append((i, key))
            found = i
        expected.append(found)
    rows = [(1, i, "p", "a", t, "", "f", "", "minor") for i, t in enumerate(texts)]
    assert [r.leader for r in panel.clusters(findings(spark, rows)).orderBy("seq").collect()] == expected


def test_groundedness_is_a_mean_over_runs(spark):
    rows = spark.createDataFrame([(1, "p", "a", True), (1, "p", "a", False), (1, "p", "b", True)], "ms_id int, provider string, reviewer string, grounded boolean")
    assert panel.groundedness(rows).first().groundedness == 0.75


def test_context_is_abridged_only_if_it_must_be(spark):
    ms = spark.createDataFrame([(1, "t", "a", ["k"])], "ms_id int, title string, abstract_raw string, keywords array<string>")
    body = "One sentence here. " * 200
    sections = spark.createDataFrame([(1, 0, "methods", "Methods", body), (1, 1, "abstract", "Abstract", "x"), (1, 2, "results", "", "Short. End.")], "ms_id int, sec_ord int, role string, title_raw string, text string")
    whole = panel.context(ms, sections).collect()
    assert [r.section for r in whole] == ["Methods", "(results)"] and whole[0].text == body
    short = panel.context(ms, sections, budget=1500).collect()
    assert "[... section abridged ...]" in short[0].text and short[0].text.startswith("One sentence here.") and len(short[0].text) < 1700 and short[1].text == "Short. End."


def test_located(spark):
    parts = spark.createDataFrame([(1, 0, "Intro", "nothing of note is said here"), (1, 1, "Results", "the gain was twelve percent over all runs")], "ms_id int, part_no int, section string, text string")
    quotes = spark.createDataFrame([(1, 1, "gain was twelve percent over"), (2, 1, "never written anywhere at all")], "quote_id int, ms_id int, quote string")
    assert {r.quote_id: r.section for r in panel.located(quotes, parts).collect()} == {1: "Results", 2: ""}


def test_empty(spark):
    none = findings(spark, [])
    assert panel.clusters(none).isEmpty() and panel.ranked(none.withColumns({"agreement": F.lit(1), "specificity": F.lit(0.5)})).isEmpty()


def test_answers_become_ranked_findings(spark):
    text = "The pump was run for three hundred hours at constant load."
    raw = '{"findings": [{"issue": "Load is not varied", "fix": "vary it", "quote": "run for three hundred hours at constant load"}, {"issue": "Made up", "quote": "a sentence that is not in the manuscript"}]}'
    runs = spark.createDataFrame([(1, "p", "a", raw, None), (1, "q", "b", raw, None), (1, "r", "c", raw, "timed out")], RUNS + ", error string")
    parts = spark.createDataFrame([(1, 1, "Methods", text)], "ms_id int, part_no int, section string, text string")
    found = panel.reviewed(runs, spark.createDataFrame([(1, text)], "ms_id int, text string"), parts).collect()
    assert [(f.issue, f.section, f.agreement, f.agreed_by, f.rank) for f in found] == [("Load is not varied", "Methods", 2, ["p/a", "q/b"], 1)]


def test_verified_reads_whole_texts_of_all_documents(spark, tmp_path):
    """Against difflib over every window; a foreign quote stands, one letter off, behind 3,000 characters."""
    from scriptorium.plans.panel_queries import verified

    draw = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega", "stone", "river", "cloud"]
    texts = {i: " ".join(draw.choice(words) + str(draw.randint(0, 999)) for _ in range(n)) for i, n in enumerate((600, 5, 0, 60, 25, 600, 12, 40, 400))}
    foreign = "words that nobody would write in such a text at all"
    texts[5] = texts[5][:3003] + " " + foreign.replace("nobody", "nobudy") + " " + texts[5][3003:]
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.ms_id: r.grounded for r in verified(spark, str(tmp_path)).collect()}

    def expected(i, text):
        cut = text[99:179]
        quote, text = (" ".join(x.split()) for x in ([cut, cut[:40] + "x" + cut[41:], foreign][i % 3], text))
        windows = [text[a : a + len(quote)] for a in range(0, max(1, len(text) - len(quote) + 1), max(1, len(quote) // 4))]
        return len(quote) >= 20 and (quote in text or any(difflib.SequenceMatcher(None, quote, w).ratio() >= 0.92 for w in windows))

    assert found == {i: expected(i, t) for i, t in texts.items()} and set(found.values()) == {True, False}
