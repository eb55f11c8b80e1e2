import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import suffix_dedup
from scriptorium.llm.suffix_dedup import remove_repeats, without_repeats
from scriptorium.llm.suffixes import anchors, multikey_quicksort, neighbours_share, tokens


def brute(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40):
    draw = random.Random(seed)
    words = [f"w{i}é" if i % 17 == 0 else f"word{i}" for i in range(300)]
    prose = lambda k: " ".join(draw.choice(words) for _ in range(k))
    passages = [prose(draw.randint(5, 40)) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = draw.random()
        if kind < 0.2 and texts:
            base = draw.choice(texts)
            cut = draw.randint(0, len(base))
            texts.append(base[:cut] + "X" + base[cut:])
        elif kind < 0.3 and texts:
            texts.append(draw.choice(texts))
        else:
            texts.append(prose(draw.randint(0, 60)) + " " + draw.choice(passages) + " " + prose(draw.randint(0, 30)))
    return texts + ["ab" * 300, "a" * 500, "", None, "aab" * 100]


@pytest.mark.parametrize("length, window, hot", [(60, 32, 4000), (60, 40, 2), (100, 64, 4000)])
def test_like_brute_force(spark, monkeypatch, length, window, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = corpus(length + window)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(rows, length=length, window=window).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, length)


@pytest.mark.parametrize("length", [240, 20, 17])
def test_the_window_follows_the_length(spark, length):
    texts = corpus(length, 25)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(rows, length=length).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, length)
    with pytest.raises(ValueError):
        remove_repeats(rows, length=16)


def test_equal_strings_have_equal_anchors():
    draw = random.Random(5)
    same = bytes(draw.randrange(256) for _ in range(100))
    for _ in range(20):
        left, right = (bytes(draw.randrange(256) for _ in range(draw.randint(0, 90))) for _ in range(2))
        data = left + same + right
        at, lo, hi = anchors(data, 100, 50)
        place = next(a for a, b, e in zip(at, lo, hi) if b <= len(left) <= e)
        alone = anchors(same, 100, 50)[0][0]
        assert place - len(left) == alone


def test_multikey_quicksort_sorts_and_shares():
    draw = random.Random(6)
    strings = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 30))) for _ in range(500)]
    table, lengths = tokens(strings)
    order = multikey_quicksort(table)
    assert [strings[i].ljust(32, b"\0") for i in order] == sorted(s.ljust(32, b"\0") for s in strings)
    shared = neighbours_share(table, lengths, order)
    for a, b, n in zip(order[:-1], order[1:], shared[1:]):
        x, y = strings[a], strings[b]
        assert n == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert len(multikey_quicksort(np.zeros((0, 1), np.uint64))) == 0


def test_odd_rows(spark, odd):
    found = remove_repeats(odd, length=20, window=4).collect()
    assert len(found) == odd.count()
    repeated = [r for r in found if r.doc_id in (1, 4)]
    assert all(r.n_removed == r.n_bytes == 27 and r.n_spans == 1 for r in repeated)
    assert all(r.n_removed == 0 for r in found if r.doc_id in (2, 3, 6, 7, None))
    assert remove_repeats(odd.limit(0)).isEmpty()


def test_rows_keep_their_columns(spark, documents):
    text = " ".join(f"word{i}" for i in range(60))
    rows = documents(text, "é" + text, "other words", None)
    found = without_repeats(rows, length=400).orderBy("doc_id").collect()
    assert found[0].asDict().keys() == rows.first().asDict().keys()
    assert [r.text for r in found] == ["", "é", "other words", None]
