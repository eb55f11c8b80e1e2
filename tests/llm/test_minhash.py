import random

import numpy as np
import pytest

from scriptorium.llm import minhash
from scriptorium.llm.minhash import keep_one, near_duplicates, sketch
from scriptorium.llm.shingles import links, shingles


def word_sets(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets = [word_sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


def corpus(seed):
    draw = random.Random(seed)
    prose = lambda n: [f"w{draw.randint(0, 400)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = prose(draw.randint(3, 90))
        texts.append(" ".join(base))
        for _ in range(draw.randint(0, 8)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = f"x{draw.randint(0, 99)}"
            texts.append(draw.choice([" ", "\n", "\t "]).join(copy).upper() if draw.random() < 0.3 else " ".join(copy))
    return texts + ["", None, "one two", "ONE\ttwo", "  ", "one two three"]


@pytest.mark.parametrize("members", [1000, 6])
def test_like_brute_force(spark, monkeypatch, members):
    """With groups of six at most, all go through blocks, delegates and query blocks."""
    monkeypatch.setattr(minhash, "MEMBERS", members)
    texts = corpus(members)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(rows).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)


def test_links_at_the_threshold():
    a, b, c = np.arange(7, dtype=np.uint64), np.arange(1, 8, dtype=np.uint64), np.arange(2, 8, dtype=np.uint64)
    assert links([a, b]) == [(0, 1)]  # 6 of 8
    assert links([a, c]) == []  # 5 of 8
    assert links([a, b, c], left=np.array([False, False, True])) == [(2, 1)]


def test_every_coordinate_fills_and_similarity_is_estimated():
    draw = np.random.default_rng(1)
    assert (sketch(np.array([5], np.uint64)) != np.iinfo(np.uint64).max).all()
    errors = []
    for _ in range(40):
        common, own = draw.integers(0, 1 << 62, 300, np.uint64), draw.integers(0, 1 << 62, (2, 50), np.uint64)
        x, y = (np.unique(np.concatenate([common, o])) for o in own)
        errors.append((sketch(x) == sketch(y)).mean() - 300 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_words_are_split_at_ascii_space_only():
    assert len(shingles("a\x0bb c\x1cd e f g h")) == 2  # a, b, c\x1cd, e f, g, h
    assert np.array_equal(shingles("É a b c d"), shingles("É A B C D")) and not np.array_equal(shingles("é a b c d"), shingles("É a b c d"))


def test_odd_rows(spark, odd):
    found = near_duplicates(odd).collect()
    assert len(found) == odd.count()
    assert all(r.component_id == 1 for r in found if r.doc_id in (1, 4)) and sum(r.kept for r in found if r.doc_id in (1, 4)) == 1
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for r in found if r.doc_id in (2, 3, 7))
    assert [r.kept for r in found if r.doc_id is None] == [True]
    assert near_duplicates(odd.limit(0)).isEmpty()


def test_one_row_of_each_group_stays(spark, odd):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "None", "5", "6", "7"])
