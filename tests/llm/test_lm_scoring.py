import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from scriptorium.llm import attention, lm_scoring
from scriptorium.llm.lm_scoring import Lexicon, score_batch, score_texts, split_words, tokens_of, words_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def base(rows):
    known, ends = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            known.update(words_of(t))
            ends += 1
    n, v = sum(known.values()) + ends, len(known) + (ends > 0)
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    return {(i, t): (len(words_of(t)) + 1, sum(known[w] > 0 for w in words_of(t)) + (ends > 0), n, sum(log(known[w]) for w in words_of(t)) + log(ends)) for i, t in rows}


@pytest.mark.parametrize("table", [3, 10_000])
def test_base_scores_are_exact(spark, odd, monkeypatch, table):
    """With a table of three words nearly every count comes through the join."""
    monkeypatch.setattr(lm_scoring, "ROUNDS", 1)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    expected = base(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    found = score_texts(odd, RANKS, table=table).collect()
    assert len(found) == len(rows)
    for r in found:
        tokens, known, n, score = expected[r.doc_id, texts[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score < 0 and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2)
    assert score_texts(odd.limit(0), RANKS).isEmpty()


def lexicon(words, most=1000):
    ids, _, _ = tokens_of(words, RANKS)
    return Lexicon(np.bincount(ids, minlength=len(lm_scoring.encoder(RANKS)[1])).astype(float), RANKS, Counter(words), 1.0, most)


def drawn(seed):
    """Weights away from the first ones, so that every part of the model matters."""
    draw = np.random.default_rng(seed)
    return {k: (v + 0.3 * draw.standard_normal(v.shape)).astype(np.float32) for k, v in attention.fresh(seed, np.ones(attention.SLOTS)).items()}


def unbounded(weights, slot, text, target):
    """Log shares of the targets by one mask over the whole stream, in double precision."""
    w = {k: v.astype(np.float64) for k, v in weights.items()}
    x, n = w["token"][slot], len(slot)
    back = np.arange(n)[:, None] - np.arange(n)[None, :]
    seen = (back >= 0) & (back < attention.CONTEXT) & (text[:, None] == text[None, :])
    scores = (x @ w["query"]) @ (x @ w["key"]).T / np.sqrt(attention.DIM) + w["place"][np.clip(back, 0, attention.CONTEXT - 1)]
    shares = np.where(seen, np.exp(scores - np.where(seen, scores, -np.inf).max(axis=1, keepdims=True)), 0)
    hidden = x @ w["here"] + (shares / shares.sum(axis=1, keepdims=True)) @ (x @ w["value"]) @ w["there"] + w["shift"]
    hidden /= 1 + np.abs(hidden)
    log = lambda z, t: z[np.arange(n), t] - np.log(np.exp(z).sum(axis=1))
    group, member = np.divmod(target, attention.MEMBERS)
    return log(hidden @ w["group"] + w["group_bias"], group) + log(np.einsum("nh,nhm->nm", hidden, w["member"][group]) + w["member_bias"][group], member)


def sample(n, seed=0):
    draw = np.random.default_rng(seed)
    return draw.integers(0, attention.SLOTS, n), np.repeat(np.arange(n // 90 + 1), 90)[:n], draw.integers(0, attention.SLOTS, n)


@pytest.mark.parametrize("large", [1, 40])
def test_windows_are_one_unbounded_mask(monkeypatch, large):
    """Also across chunks, and where scores are too large for exponentials without the maximum."""
    monkeypatch.setattr(attention, "CHUNK", 5 * attention.BLOCK)
    weights, stream = drawn(1), sample(517)
    weights["query"] *= large
    tables = attention.Tables(weights)
    assert tables.safe == (large == 1)
    assert np.allclose(attention.predict(tables, *stream), unbounded(weights, *stream), rtol=1e-3, atol=2e-3)


def test_a_row_far_below_another_does_not_vanish():
    weights = drawn(2)
    weights["query"] *= 60
    slot, text, target = sample(200)
    found = attention.predict(attention.Tables(weights), slot, text, target)
    assert np.isfinite(found).all()
    assert np.isfinite(attention._logs(np.array([[500.0] * 32, [-500.0] * 32], np.float32), np.array([3, 4]), False)).all()


def test_gradients():
    draw, weights, stream = np.random.default_rng(0), drawn(3), sample(150)
    slopes, loss = attention.gradients(weights, *stream)
    assert loss == pytest.approx(-unbounded(weights, *stream).sum(), rel=1e-4)
    for name in weights:
        wide = weights[name].astype(np.float64)
        for _ in range(4):
            step = np.zeros_like(wide)
            step[draw.integers(0, len(wide))] = 1e-4 * draw.standard_normal(wide.shape[1:]) if wide.ndim > 1 else 1e-4
            above, below = (-unbounded(weights | {name: wide + sign * step}, *stream).mean() for sign in (1, -1))
            assert float((slopes[name] * step).sum()) == pytest.approx((above - below) / 2, rel=2e-2, abs=2e-8), name


def test_all_that_can_follow_sums_to_one():
    weights, tables = drawn(4), None
    tables = attention.Tables(weights)
    every = np.arange(attention.SLOTS)
    shares = [np.exp(attention.predict(tables, np.array([7, 9]), np.zeros(2, int), np.array([3, t]))[1]) for t in every]
    assert sum(shares) == pytest.approx(1.0, rel=1e-4)


def test_nothing_ahead_or_of_another_text_matters():
    words, draw = lexicon([b"one", b"two", b"three", b"four"]), random.Random(1)
    tables = attention.Tables(drawn(5))
    score = lambda texts: score_batch(words, tables, pa.array(texts))["score"]
    text = " ".join(draw.choice(["one", "two", "three", "four", "five"]) for _ in range(200))
    alone = score([text])[0]
    assert score(["two one", text, None, "four"])[1] == pytest.approx(alone, rel=1e-4)


def test_the_context_is_32_ids():
    weights = drawn(6)
    slot, text, target = sample(80)
    last = lambda s: attention.forward(attention.Tables(weights), s, np.zeros(80, int))[0][60]
    for back, matters in ((0, True), (16, True), (31, True), (32, False)):
        other = slot.copy()
        other[60 - back] = (other[60 - back] + 1) % attention.SLOTS
        assert np.allclose(last(other), last(slot), rtol=0, atol=1e-7) != matters


def test_slots_share_out_one():
    counts = np.random.default_rng(2).integers(0, 50, 5000).astype(float)
    slot, share = attention.slots_of(counts)
    total = np.bincount(slot, weights=np.exp(share), minlength=attention.SLOTS)
    assert np.allclose(total[1:], 1.0) and 0 not in slot
    assert len(np.unique(slot[np.argsort(-counts, kind="stable")[:991]])) == 991


def test_a_full_cache_changes_nothing():
    tables, draw = attention.Tables(drawn(7)), random.Random(3)
    texts = [" ".join(f"w{draw.randint(0, 60)}" for _ in range(30)) for _ in range(12)]
    small, large = lexicon([b"a", b"w7"], 5), lexicon([b"a", b"w7"], 500)
    for _ in range(2):
        a, b = ([score_batch(x, tables, pa.array([t])) for t in texts] for x in (small, large))
        for x, y in zip(a, b):
            assert x["score"] == pytest.approx(y["score"], rel=1e-5) and x["known"] == y["known"] and x["missed"].to_pylist() == y["missed"].to_pylist()


def test_training_helps(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice([["red", "green", "blue"], ["rot", "grün", "blau"]][i % 2]) for _ in range(40))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    found = [r for r in score_texts(docs, RANKS).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_every_text_is_trained_on(spark):
    """Each text moves the weights, however often it occurs, and whatever size the corpus is said to have."""
    ones = np.ones(len(lm_scoring.encoder(RANKS)[1]))
    trained = lambda rows: lm_scoring.train(rows, 24_000, ones, RANKS)
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    fresh = trained(frame(["one"]).limit(0))
    for texts in (["one two one"], ["two one"], ["one one"] * 30, ["two two two"] * 30):
        found = trained(frame(texts))
        assert any(not np.array_equal(found[k], fresh[k]) for k in fresh)


def test_words_alike_in_arrow_and_python():
    draw = random.Random(5)
    letters = list("aBcÉ \t\n\x0b\x0c\r\x1c\xa0☃ ")
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(400)] + [None, "", " ", " a", "a "]
    for begin in (0, 7, 390):
        lengths, numbers, distinct = split_words(pa.record_batch({"t": texts}).slice(begin).column(0))
        ends = np.cumsum(lengths)
        for t, end, n in zip(texts[begin:], ends, lengths):
            assert [distinct[i] for i in numbers[end - n : end]] == words_of(t)
    encode, _ = lm_scoring.encoder(RANKS)
    words = list(dict.fromkeys(w for t in texts for w in words_of(t)))
    ids, word, leads = tokens_of(words, RANKS)
    for i, w in enumerate(words):
        assert ids[word == i].tolist() == encode(" " + w.decode()) and leads[word == i].sum() == 1
