"""Facts of texts of ASCII characters alone, many at once: Arrow's linear-time patterns, and words by their bytes.

They are what the expressions of :mod:`scriptorium.operators.review` give for such texts, at
a fraction of the cost.  Any other text is given as null, gets null, and is left to those expressions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
#: Texts are worked on in parts of about so many bytes.
PART = 2 << 20


def only(text: Column, on: Column | None = None) -> Column:
    """The text where it, or ``on``, is of ASCII characters alone, else null."""
    told = text if on is None else on
    return F.when(F.length(told) == F.octet_length(told), text)


def linear(pattern: str) -> str:
    """The pattern as Arrow and Python read it the way Java does in ASCII: white space has a vertical tab, and no line end is any character."""
    def read(m: re.Match) -> str:
        if m[0] == ".":
            return r"[^\n\r]"
        return m[0].replace(r"\s", r"\t-\r ") if m[0][0] == "[" else m[0].replace(r"\s", r"[\t-\r ]")

    return re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]|\.", read, pattern)


def found(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, linear(pattern)).to_numpy(zero_copy_only=False)


def counted(texts: pa.Array, pattern: str) -> np.ndarray:
    """Matches of each text.  Arrow forgets what is before the place a search goes on from, so only texts without a match are left to it."""
    out = np.zeros(len(texts), np.int32)
    some, plain = np.flatnonzero(found(texts, pattern)), re.compile(linear(pattern), re.ASCII)
    out[some] = [sum(1 for _ in plain.finditer(t)) for t in texts.take(pa.array(some)).to_pylist()]
    return out


def _bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    first = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset]
    held = texts.buffers()[2]
    return np.frombuffer(held, np.uint8)[first : first + size[-1]] if held else np.zeros(0, np.uint8), size


def words_and_sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its words; its sentences of three words or more, their words, and how many have more than 40.  No nulls."""
    if not len(texts):
        return (np.zeros(0, np.int64),) * 4
    data, size = _bounds(texts)
    many, white = len(texts), WHITE[data]
    after = np.ones(len(data), bool)  # behind a word's last letter is white space or the text's end
    after[:-1] = white[1:]
    after[size[1:][size[1:] > 0] - 1] = True
    last = np.flatnonzero(after & ~white)
    upto = np.searchsorted(last, size)
    words = np.diff(upto)
    ends = STOP[data[last]]
    ends[upto[1:][words > 0] - 1] = True
    sentence = np.flatnonzero(ends)
    length = np.diff(sentence, prepend=-1)
    text = np.searchsorted(upto, sentence, "right") - 1
    text, length = text[length > 2], length[length > 2]
    total = np.bincount(text, weights=length, minlength=many).astype(np.int64)
    return words, np.bincount(text, minlength=many), total, np.bincount(text[length > 40], minlength=many)


def _struct(valid: np.ndarray, **columns: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns), mask=pa.array(~valid))


def _parts(texts: pa.Array) -> list[pa.Array]:
    step = max(1, int(len(texts) * PART / max(1, texts.nbytes)))
    return [texts.slice(at, step) for at in range(0, max(1, len(texts)), step)]


def _whole(texts: pa.Array) -> pa.Array:
    valid, made = texts.is_valid().to_numpy(zero_copy_only=False), []
    for part in _parts(texts):
        part = pc.fill_null(part, "")
        words, sentences, total, long = words_and_sentences(part)
        signals = sum((found(part, f"(?i){p}").astype(np.int32) for p in P.REPRODUCIBILITY.values()), np.zeros(len(part), np.int32))
        made.append((words, sentences, total, long, counted(part, P.HEDGE), signals))
    words, sentences, total, long, hedges, signals = (np.concatenate(c) for c in zip(*made))
    kinds = (c.astype(np.int64) for c in (words, sentences, total, long))
    return _struct(valid, **dict(zip(("words", "sentences", "total", "long"), kinds)), hedges=hedges.astype(np.int32), signals=signals.astype(np.int32))


def whole_facts(texts: Column) -> Column:
    """Struct words, sentences, total, long (see :func:`words_and_sentences`), hedges, signals (patterns of reproducibility found) of ASCII texts."""
    def facts(texts: pa.Array) -> pa.Array:
        return _whole(texts)

    return F.arrow_udf(facts, "words long, sentences long, total long, long long, hedges int, signals int")(texts)


def _abstract(texts: pa.Array, fronts: pa.Array) -> pa.Array:
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    texts, fronts = pc.fill_null(texts, ""), pc.fill_null(fronts, "")
    # a line for each sentence: no pattern of a move passes the end of one
    apart = pc.replace_substring_regex(texts, r"([.!?])[\t-\r ]+", "\\1\n")
    missing = sum(((~found(apart, f"(?i){p}")).astype(np.int32) for p in P.MOVES.values()), np.zeros(len(texts), np.int32))
    novel = sum((found(fronts, f"(?i){p}").astype(np.int32) for p in P.NOVELTY), np.zeros(len(texts), np.int32))
    foreign = found(texts, P.CITATION_IN_ABSTRACT) | found(texts, P.FLOAT_IN_ABSTRACT)
    return _struct(valid, n=words_and_sentences(texts)[0].astype(np.int64), missing=missing, quantities=counted(texts, P.QUANTITY), foreign=foreign, novel=novel)


def abstract_facts(abstract: Column, front: Column) -> Column:
    """Struct n (words), missing (moves), quantities, foreign (a citation or float) of ASCII abstracts, novel (signals) of what they stand in."""
    def facts(abstract: pa.Array, front: pa.Array) -> pa.Array:
        return _abstract(abstract, front)

    return F.arrow_udf(facts, "n long, missing int, quantities int, foreign boolean, novel int")(abstract, front)
