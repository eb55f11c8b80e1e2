import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scriptorium.llm.packing import Bins, ByteIds, pack_texts, packed_sequences

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def ids_of(text):
    return np.array(Tokenizer.from_file(JSON).encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_ids_are_the_librarys(ranks):
    draw, encode, library = random.Random(3), ByteIds(JSON, ranks), Tokenizer.from_file(JSON)
    letters = [chr(i) for i in range(0x250)] + list("  \n\n''sltred☃漢😀") + ["<|endoftext|>"]
    for _ in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        assert encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check(rows, texts, size):
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    sequences = {}
    for i, t in texts.items():
        ids, pieces = ids_of(t), sorted(found[i], key=lambda r: r.piece)
        assert sum(p.length for p in pieces) == len(ids) and [p.piece for p in pieces] == list(range(len(pieces)))
        assert 0 < pieces[0].length <= size and all(p.length == size for p in pieces[1:])  # the first piece may be shorter
        assert all(q.start == p.start + p.length for p, q in zip(pieces, pieces[1:])) and pieces[0].start == 0
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_pieces_and_places(spark, documents):
    draw = random.Random(4)
    texts = {i: " ".join(draw.choice(["sea", "wind", "über", "42"]) for _ in range(draw.randint(0, 150))) for i in range(120)}
    texts |= {3: "", 5: None, 7: "x " * 400, 9: "ok <|endoftext|> 漢字"}
    rows = pack_texts(documents(*[texts[i] for i in range(120)]), JSON, RANKS, size=128).collect()
    sequences = check(rows, texts, 128)
    total = sum(r.length for r in rows)
    assert -(-total // 128) <= sequences <= 1.1 * total / 128 + 1


def test_sequences_hold_the_ids(spark, documents):
    rows = documents("a b c", "d e f g", None)
    found = packed_sequences(rows, JSON, RANKS, size=64).collect()
    assert len(found) == 1
    ids = np.frombuffer(bytes(found[0].ids), "<u4")
    for p in found[0].pieces:
        assert np.array_equal(ids[p.offset : p.offset + p.length], ids_of({0: "a b c", 1: "d e f g", 2: ""}[p.doc_id]))


def test_bins_like_a_plain_best_fit():
    draw, size, most = random.Random(5), 50, 7
    bins, open_, made = Bins(size, most), {}, 0
    for _ in range(3000):
        n = draw.randint(1, size)
        number, offset = bins.place(n)
        fitting = [free for free in open_.values() if free >= n]
        if fitting:
            assert size - offset == min(fitting) == open_[number]
        else:
            assert number == made and offset == 0
            made += 1
            if len(open_) == most and n < size:
                fullest = min(open_.values())
                closed = [b for b, f in open_.items() if f == fullest]
                gone = [b for b in closed if b not in {x for level in bins.open for x in level}]
                assert len(gone) == 1
                del open_[gone[0]]
            open_[number] = size
        open_[number] -= n
        if not open_[number]:
            del open_[number]
        assert len(open_) <= most


def test_odd_rows(spark, odd):
    rows = pack_texts(odd, JSON, RANKS, size=2048).collect()
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert all(r.length == 1 for r in rows if r.doc_id in (2, 3)) and sum(r.doc_id == 5 for r in rows) > 10
    assert pack_texts(odd.limit(0), JSON, RANKS).isEmpty()
