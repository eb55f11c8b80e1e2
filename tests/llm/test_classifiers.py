import random

import numpy as np

from scriptorium.llm import quality, toxicity
from scriptorium.llm.learning import labelled_sample


def prose(draw, n=60):
    return " ".join("".join(draw.choice(["th", "er", "on", "an", "re", "in", "ed"]) for _ in range(draw.randint(1, 4))) for _ in range(n)) + "."


def labelled(spark, make, n=400):
    draw = random.Random(8)
    rows = [(i, *make(draw, i)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def junk(draw, i):
    text = prose(draw, draw.randint(5, 120))
    return (text, 1) if i % 4 else (draw.choice([text.upper().replace(" ", "!! "), text.replace(" ", "%%% "), "Er " * 60]), 0)


def test_quality_on_held_out_texts(spark):
    docs, labels, truth = labelled(spark, junk)
    model = quality.fit_quality(docs, labels)
    held = [r for r in quality.score_quality(docs, model).collect() if r.held_out]
    assert 50 < len(held) and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in held)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and np.mean([truth[r.doc_id] for r in kept.collect()]) >= 0.95


def test_held_out_rows_are_never_read(spark):
    docs, labels, _ = labelled(spark, junk, 60)
    texts = {t for t, _ in labelled_sample(docs, labels, "quality", 4, 2, 1000, 10**9)}
    import zlib

    assert texts == {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    few = labelled_sample(docs, labels, "quality", 4, 2, 5, 10**9)
    assert sum(y == 0 for _, y in few) <= 5 and sum(y == 1 for _, y in few) <= 5


def test_a_text_that_does_not_fit_is_passed_over(spark):
    """Three texts over the whole budget, wherever the order puts them, leave the other texts of their class in the sample."""
    rows = [(i, ("y" * 5000 if i in (0, 5, 9) else f"text {i:03}"), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, "text 001")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    short = sorted([(t, y) for i, t, y in rows if i not in (0, 5, 9)] + [("text 001", 1)])
    assert sorted(labelled_sample(docs, labels, "quality", 1, 1, 1000, 4000)) == short
    some = labelled_sample(docs, labels, "quality", 1, 1, 1000, 8 * 10 + 3)
    assert [sum(y == z for _, z in some) for y in (0, 1)] == [10, 10] and some == labelled_sample(docs, labels, "quality", 1, 1, 1000, 8 * 10 + 3)


def insult(draw, i):
    words = prose(draw, draw.randint(10, 80)).split()
    if i % 3 == 0:
        for w in draw.sample(["grobnik", "zarvel", "plomka"], 2):
            words.insert(draw.randrange(len(words)), w + draw.choice(["", "en", "."]))
    return " ".join(words), int(i % 3 == 0)


def test_toxicity_on_held_out_texts(spark):
    docs, labels, truth = labelled(spark, insult)
    model = toxicity.fit_toxicity(docs, labels)
    assert set(model.stems) == {"grobnik", "zarvel", "plomka"}
    held = [r for r in toxicity.score_toxicity(docs, model).collect() if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97


def test_the_grammar_knows_circumstances():
    model = toxicity.ToxicityModel({"idiot": 2.0, "scum": 3.0}, None, 0.0)
    kinds = lambda text: [k for _, k, _ in model.matches(text)]
    assert kinds("The idiot left.") == ["plain"]
    assert kinds("You are an idiot") == ["aimed"]
    assert kinds("You are not an idiot") == ["negated"]
    assert kinds("He said that you are an idiot") == ["reported"]
    assert kinds("I will kill you") == kinds("You, I will kill you") == kinds("We're going to hurt them") == kinds("You will die") == ["threat"]
    assert kinds("you kill it") == kinds("I will kill the lights") == kinds("They die") == [] and kinds("I will never hurt you") == ["negated"]
    assert kinds("Idiot, they said") == ["reported"] and kinds("What an idiot you are") == ["aimed"] and kinds("He said: I will kill you") == ["threat"]
    assert kinds("Not here. You scum! A nidiotic word") == ["aimed"]
    assert model.weight("scummy") == 3.0 and model.weight("other") == 0.0


def test_the_grammar_tells_what_the_sum_of_stems_cannot():
    """Quoted and denied insults are not toxic here: the same words, told apart by circumstances alone."""
    draw = random.Random(12)
    toxic = ["You are a {0}", "{0}, get out", "They are {0} people"]
    clean = ["He said that you are a {0}", "You are not a {0}", "Nobody is called a {0}, she wrote"]
    sample = [(f"{prose(draw, 20)} {draw.choice(toxic if y else clean).format(draw.choice(['grobnik', 'zarvel']))}. {prose(draw, 20)}", y) for i in range(400) for y in [i % 2]]
    model = toxicity.ToxicityModel({"grobnik": 2.0, "zarvel": 2.0}, None, 0.0)
    y = np.array([z for _, z in sample], float)
    grammar = np.array([model.features(t) for t, _ in sample])
    stems = np.array([[sum(model.weight(w) for w in toxicity.WORD_OF.findall(t.lower()))] for t, _ in sample])
    order = np.argsort(np.arange(400) % 4 // 2, kind="stable")
    fit, rest = order[:200], order[200:]
    right = [np.mean((toxicity.Logistic(x[fit], y[fit], 1.0, False)(x[rest]) >= 0.5) == y[rest]) for x in (grammar, stems)]
    assert right[0] == 1.0 and right[1] < 0.7


def test_a_long_text_without_marks_is_read_once():
    model = toxicity.ToxicityModel({"idiot": 2.0}, None, 0.0)
    assert len(model.matches("word idiot " * 50_000)) == 50_000


def test_copies_do_not_make_a_lexicon():
    draw = random.Random(9)
    copied = prose(draw, 80) + " grobnik"
    sample = [(copied + f" {prose(draw, 2)}", 1) for _ in range(60)] + [(prose(draw, 20) + " zarvel " + prose(draw), 1) for _ in range(40)] + [(prose(draw), 0) for _ in range(300)]
    assert set(toxicity.learn_stems(sample)) == {"zarvel"}


def test_odd_rows_and_no_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for scored in (quality.score_quality(odd, quality.fit_quality(odd, none)), toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, none))):
        rows = scored.collect()
        assert len(rows) == odd.count() and len({r.score for r in rows}) == 1
    docs, labels, _ = labelled(spark, junk, 100)
    model = quality.fit_quality(docs, labels)
    assert quality.score_quality(odd, model).where("score BETWEEN 0 AND 1").count() == odd.count()
    assert quality.score_quality(odd.limit(0), model).isEmpty()
    harsh = toxicity.fit_toxicity(docs, labels)
    assert toxicity.score_toxicity(odd, harsh).count() == odd.count() and toxicity.toxic_clauses(odd, harsh).count() >= 0


def test_clauses(spark, documents):
    model = toxicity.ToxicityModel({"idiot": 2.0}, None, 0.0)
    found = toxicity.toxic_clauses(documents("Fine. You idiot! Bye", None, "nothing"), model).collect()
    assert [(r.doc_id, r.clause, r.kind, r.weight) for r in found] == [(0, "you idiot", "aimed", 2.0)]
