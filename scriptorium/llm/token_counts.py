"""Token counts of whole texts, by a map-side two-tier lookup (operator 7).

A text's token count is the sum over its pre-tokens.  Tier one is a broadcast hash
table, pre-token to length, of the most frequent pre-tokens; tier two is a cache in
each Python worker that encodes what the table lacks.  There is no shuffle: the table
is built from a bounded sample of rows, and since every miss is encoded exactly, the
sample touches speed only, never a count.

Splitting is exact for a sentencepiece model when none of its pieces continues over a
space mark or holds a line feed: no merge can then cross those places.  This is tested
when the model is loaded; for another model every text is encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.shared import map_batches, text_rows

#: Runs of spaces with what follows them; line feeds alone.
PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
SPACE = "▁"
_loaded: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts a sentencepiece model's tokens of texts; one for each worker and model."""

    def __init__(self, model: str, most_cached: int = 200_000, longest_cached: int = 64):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "a  b\tÉﬁＡ\nx "
        self.splits = (
            not any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in pieces)
            and self.model.normalize(probe) == SPACE + probe.replace(" ", SPACE)
            and len(self.model.encode("\n")) == 2
        )
        self.cache: dict[str, int] = {}
        self.most, self.longest = most_cached, longest_cached

    @classmethod
    def of(cls, model: str) -> "PieceCounter":
        if model not in _loaded:
            _loaded[model] = cls(model)
        return _loaded[model]

    def pre_tokens(self, text: str) -> list[str]:
        return PRE_TOKEN.findall(" " + text.replace(SPACE, " ")) if text else []

    def lengths(self, pre_tokens: list[str]) -> list[int]:
        """Each alone, after a line feed: that stands for two tokens and merges with nothing."""
        return [len(x) - 2 for x in self.model.encode(["\n" + p for p in pre_tokens], num_threads=1)]

    def count(self, text: str, table: dict[str, int]) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text))
        total, missed = 0, Counter()
        parts = self.pre_tokens(text)
        found = list(map(table.get, parts))
        if None not in found:
            return sum(found)
        cache = self.cache
        for part, length in zip(parts, found):
            if length is None:
                length = cache.get(part)
                if length is None:
                    missed[part] += 1
                    continue
            total += length
        if missed:
            if len(cache) + len(missed) > self.most:
                cache.clear()
            for part, length in zip(missed, self.lengths(list(missed))):
                total += missed[part] * length
                if len(part) <= self.longest:
                    cache[part] = length
        return total


def frequent_lengths(rows: DataFrame, model: str, sample_rows: int, table_size: int) -> dict[str, int]:
    """Tier one: at most ``table_size`` pre-tokens of at most ``sample_rows`` texts of 8 KB at most."""
    counter = PieceCounter.of(model)
    if not counter.splits:
        return {}
    seen: Counter = Counter()
    for row in rows.select("text").where(F.octet_length("text") <= 8192).where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).limit(sample_rows).collect():
        seen.update(p for p in counter.pre_tokens(row.text) if len(p) <= counter.longest)
    top = [p for p, _ in seen.most_common(table_size)]
    return dict(zip(top, counter.lengths(top)))


def count_tokens(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096, sample_rows: int = 4000, table_size: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    A null or empty text has 0 bytes and 0 tokens.  Equal rows give equal rows; a null
    key stays null; an empty table gives an empty table; other columns are not read.
    ``sample_rows`` (of 8 KB at most, so the driver holds 32 MB) and ``table_size`` bound the
    broadcast table, and nothing else.
    """
    rows = text_rows(df, key, text)
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(rows, model, sample_rows, table_size))

    def start():
        counter, lengths = PieceCounter.of(model), table.value

        def count(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": [counter.count(t, lengths) for t in texts]}

        return count

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = map_batches(rows, start, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
