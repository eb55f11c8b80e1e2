"""Best-fit packing of token sequences (operator 4).

Texts become pieces of at most ``size`` tokens in one map over the rows.  Only the
pieces' few numbers travel on: they are dealt over tasks of about ``pieces_per_task``
and each task packs its stream in one pass.

Bounded-space online best-fit: a fixed number of bins are open.  They hang in a table
keyed by free space, and one integer holds a bit for each free space in use, so the
tightest bin that still takes a piece is the lowest set bit above the piece's length.
When no open bin takes it and all are open, the fullest closes.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.shared import map_batches, text_rows, written

#: The pattern by which byte-level BPE splits a text (public, with that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[tuple, "ByteIds"] = {}


class ByteIds:
    """A byte-level BPE's ids of a text, as little-endian 32-bit bytes.

    ``path`` is the tokenizer whose ids count.  With ``ranks``, the same vocabulary as a
    file of ranks, a library several times faster gives the ids of texts on which both are
    bound to agree: those without added tokens and without characters beyond U+024F, for
    which two libraries may know different versions of Unicode.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = re.compile("[^\x00-\u024f]" + ("|" + added if added else "")).search
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str, ranks: str | None = None) -> "ByteIds":
        if (path, ranks) not in _loaded:
            _loaded[path, ranks] = cls(path, ranks)
        return _loaded[path, ranks]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or self.odd(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()


def cut(df: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 2048, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """Pieces of every row: doc_id, piece, start, length, ids_crc32, row (a number of the row); with ``whole`` their ids too.

    Each text's ids are followed by id 0.  Only texts longer than ``size`` are cut: the first
    piece takes what is left over, all others have ``size`` ids.  A null text counts as empty
    and has one piece: id 0.
    """
    rows = text_rows(df, key, text)

    def start():
        encode = ByteIds.of(tokenizer, ranks)
        end = array("I", [0]).tobytes()
        seen = TaskContext.get().partitionId() << 40

        def pieces(batch: pa.RecordBatch) -> dict:
            nonlocal seen
            out: dict[str, list] = {k: [] for k in ("doc_id", "row", "piece", "start", "length", "ids_crc32", *(("ids",) if whole else ()))}
            for key_, text_ in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview(encode(text_ or "") + end)
                first = len(ids) % (4 * size) or 4 * size
                for n, at in enumerate([0, *range(first, len(ids), 4 * size)]):
                    part = ids[at : at + 4 * size if n else first]
                    for k, v in zip(out, (key_, seen, n, at // 4, len(part) // 4, zlib.crc32(part), bytes(part))):
                        out[k].append(v)
                seen += 1
            return out

        return pieces

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, start, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long{', ids binary' if whole else ''}")


class Bins:
    """Open bins by free space; ``mask`` has bit f set while a bin with f free slots is open."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = self.count = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The number of the bin that takes a piece, and the place in it."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count == self.most and length < self.size:  # the fullest closes
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, number = self.size, self.made
            self.made += 1
        if left := free - length:
            self.open[left].append(number)
            self.mask |= 1 << left
            self.count += 1
        return number, self.size - free

    def _take(self, free: int) -> int:
        number = self.open[free].pop()
        self.count -= 1
        if not self.open[free]:
            self.mask &= ~(1 << free)
        return number


def pack(pieces: DataFrame, size: int = 2048, open_bins: int = 1024, pieces_per_task: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``pieces`` must be cheap to read twice.

    The number of tasks follows the number of pieces, so a task's memory does not.  At the
    end of a task up to ``open_bins`` sequences stay partly filled: at most one in a hundred
    where tasks are full.  Pieces come in the order of a hash, so a source of equally long
    texts does not arrive in one run; a rerun of a task sees the same order.
    """
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    order = [F.xxhash64("row", "piece"), F.col("row"), F.col("piece")]
    dealt = pieces.repartition(tasks).sortWithinPartitions(*order)
    names = [f.name for f in pieces.schema]

    def start():
        bins, base = Bins(size, open_bins), TaskContext.get().partitionId() << 36

        def place(batch: pa.RecordBatch) -> dict:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            return {n: batch.column(n) for n in names} | {"sequence_id": [base + s for s, _ in placed], "offset": [o for _, o in placed]}

        return place

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(dealt, start, f"{fields}, sequence_id long, offset long")


def pack_texts(df: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 2048, open_bins: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every text with the sequence and the place it is packed to.

    Empty table: no rows.  Repeated rows are packed each.  Null keys stay null.
    Other columns are not read.
    """
    return pack(written(cut(df, tokenizer, ranks, size, key, text), "pieces"), size, open_bins)


def packed_sequences(df: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 2048, open_bins: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id, ids (little-endian 32-bit, the pieces in place), pieces.

    ``pieces`` lists doc_id, piece, offset and length in the order of the offsets.
    """
    pieces = written(cut(df, tokenizer, ranks, size, key, text, whole=True), "pieces")
    placed = pack(pieces.drop("ids"), size, open_bins).join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"),
    )
