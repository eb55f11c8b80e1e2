"""Suffix-array deduplication of byte strings (operator 2).

Removes every byte that a string of ``length`` bytes covers which also starts anywhere
else.  A full suffix array would sort every byte's suffix; here a suffix stands for all
starts that share an anchor (see :func:`suffixes.anchors`), about one in 130 bytes, and
carries its context: the bytes from its first start to the end of its last string.

1. One pass over the texts lists anchors with two hashes: of the leading bytes that all
   strings of the anchor have in common, and of the whole context.
2. Contexts that occur more than once repeat entirely.  They are counted with partial
   sums, so thousands of copies of a passage are one row from there on.
3. Distinct contexts with equal leading bytes may still share strings.  Only these ship
   bytes, one copy of each.  Sampled splitters range-partition their suffixes by leading
   bytes (``repartitionByRange``); each bucket is sorted by multikey quicksort and its
   neighbours compared.  Splitters are leading bytes, so suffixes that share them never
   fall on two sides of a boundary, and there is nothing to compare across it but that.
4. A lead with more than ``HOT`` distinct contexts would not fit a task: its strings are
   hashed and counted one by one instead, which any number of tasks can share.
5. The marked starts return to their texts, whose remaining bytes are put together.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.minhash import keyed
from scriptorium.llm.shared import drop_written, map_batches, unused, written
from scriptorium.llm.suffixes import GRAM

HOT = 4000
BUCKET_BYTES = 16_000_000


def window_of(length: int) -> int:
    """Bytes in which a string of ``length`` looks for its anchor: 16 25ths, so leading bytes remain."""
    return max(1, min(256, length * 16 // 25, length - GRAM))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchors(rows: DataFrame, length: int, window: int) -> DataFrame:
    """rid, lo and hi (first and last start), more (lo of equal contexts in the same text, or null), before (anchor - lo), lead, context.

    A text that repeats a line has one row for all the places where its context is the same.
    """
    import xxhash

    leading = length - window + 1
    names = ("rid", "lo", "hi", "more", "before", "lead", "context")

    def start():
        from scriptorium.llm.suffixes import anchors

        def fill(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in names}
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist()):
                data = (text or "").encode()
                own: dict[tuple, list] = {}
                for a, b, e in zip(*(x.tolist() for x in anchors(data, length, window))):
                    key = xxhash.xxh3_64_intdigest(data[a : a + leading]), xxhash.xxh3_64_intdigest(data[b : e + length], a - b)
                    own.setdefault(key, []).append((b, e, a - b))
                for (lead, context), places in own.items():
                    lo, hi, before = places[0]
                    more = [p[0] for p in places[1:]] or None
                    for n, v in zip(names, (rid, lo, hi, more, before, _signed(lead), _signed(context))):
                        out[n].append(v)
            return out

        return fill

    return map_batches(rows.select("rid", "text"), start, "rid long, lo int, hi int, more array<int>, before int, lead long, context long")


def _with_bytes(pointers: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """lead, context, before, span, data of the contexts that ``pointers`` name."""
    wanted = pointers.groupBy("rid").agg(F.collect_list(F.struct("lead", "context", "lo", "hi", "before")).alias("wanted"))
    joined = wanted.join(rows.select("rid", "text"), "rid").select("text", "wanted")

    def start():
        def fill(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("lead", "context", "before", "span", "data")}
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                data = text.encode()
                for w in wanted:
                    for n, v in zip(out, (w["lead"], w["context"], w["before"], w["hi"] - w["lo"], data[w["lo"] : w["hi"] + length])):
                        out[n].append(v)
            return out

        return fill

    return map_batches(joined, start, "lead long, context long, before int, span int, data binary")


def _sorted_buckets(contexts: DataFrame, length: int, window: int) -> DataFrame:
    """lead, context, marks: runs of starts, relative to the first, that other contexts have too."""
    total = contexts.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))
    leading = F.substring(F.col("data"), F.col("before") + 1, F.lit(24))
    dealt = contexts.withColumn("leading", leading).repartitionByRange(buckets, "leading", "lead")

    def compare(batches):
        from scriptorium.llm.suffixes import repeated

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).drop_columns(["leading"])
        data, before = table.column("data").to_pylist(), table.column("before").to_pylist()
        spans = np.array(table.column("span").to_pylist(), np.int64)
        marks = repeated([d[b:] for d, b in zip(data, before)], [d[:b] for d, b in zip(data, before)], spans, length, length - window + 1)
        found = pa.table({"lead": table.column("lead"), "context": table.column("context"), "marks": pa.array(marks, pa.list_(pa.int32()))})
        yield from found.filter(pa.array([bool(m) for m in marks])).to_batches()

    return dealt.mapInArrow(compare, "lead long, context long, marks array<int>")


def _counted_strings(contexts: DataFrame, length: int) -> DataFrame:
    """As :func:`_sorted_buckets`, for hot leads: every string by two hashes, counted."""
    import xxhash

    def start():
        def fill(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("lead", "context", "start", "h1", "h2")}
            for lead, context, span, data in zip(*(batch.column(n).to_pylist() for n in ("lead", "context", "span", "data"))):
                for i in range(span + 1):
                    h = xxhash.xxh3_128_intdigest(data[i : i + length])
                    for n, v in zip(out, (lead, context, i, _signed(h >> 64), _signed(h & ((1 << 64) - 1)))):
                        out[n].append(v)
            return out

        return fill

    strings = written(map_batches(contexts, start, "lead long, context long, start int, h1 long, h2 long"), "strings")
    # contexts are distinct, and one context has a string twice only where both have other anchors
    twice = strings.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    return strings.join(twice, ["h1", "h2"]).groupBy("lead", "context").agg(F.flatten(F.collect_list(F.array("start", "start"))).alias("marks"))


def marked(rows: DataFrame, length: int = 400, window: int | None = None) -> DataFrame:
    """rid, runs: for each text with repeated strings the flat list of first and last starts of them.

    ``length`` is above 16; ``window`` follows it (:func:`window_of`) where none is given.
    """
    if length <= GRAM:
        raise ValueError(f"strings of {length} bytes have no anchor: more than {GRAM} are needed")
    window = window or window_of(length)
    found = written(_anchors(rows, length, window), "anchors")
    distinct = found.groupBy("lead", "context").agg(F.sum(1 + F.coalesce(F.array_size("more"), F.lit(0))).alias("n"), F.min(F.struct("rid", "lo", "hi", "before")).alias("one"))
    distinct = written(distinct, "contexts")
    leads = distinct.groupBy("lead").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("all > 1").select("lead", "m")
    shared = written(distinct.join(leads, "lead").select("lead", "context", "n", "m", "one.*"), "shared")
    drop_written(distinct)  # each table goes when nothing reads it any longer
    once = shared.where("m > 1")
    contexts = written(_with_bytes(once, rows, length), "bytes")
    used = [shared, contexts]
    hot = once.where(f"m > {HOT}").select("lead").distinct()
    if hot.isEmpty():
        partly = _sorted_buckets(contexts, length, window)
    else:
        apart = written(contexts.join(hot.withColumn("hot", F.lit(True)), "lead", "left"), "apart")
        used.append(apart)
        partly = _sorted_buckets(apart.where("hot IS NULL").drop("hot"), length, window)
        partly = partly.unionAll(_counted_strings(apart.where("hot").drop("hot"), length))
    marks = shared.where("n > 1").select("lead", "context", F.array(F.lit(0), F.col("hi") - F.col("lo")).alias("marks"))
    marks = written(marks.unionAll(partly), "marks")
    for table in used:
        drop_written(table)
    places = F.concat(F.array("lo"), F.coalesce("more", F.array().cast("array<int>")))
    runs = F.flatten(F.transform(places, lambda lo: F.transform("marks", lambda x: x + lo)))
    placed = found.join(marks, ["lead", "context"]).select("rid", runs.alias("runs"))
    runs = written(placed.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    drop_written(found)
    drop_written(marks)
    return runs


def remaining(data: bytes, found: list[int] | None, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the strings that start within the runs, and the maximal removed spans."""
    if not found:
        return data, []
    spans: list[tuple[int, int]] = []
    for first, last in sorted(zip(found[::2], found[1::2])):
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], last + length))
        else:
            spans.append((first, last + length))
    kept, at = [], 0
    for begin, end in spans:
        kept.append(data[at:begin])
        at = end
    return b"".join([*kept, data[at:]]), spans


def remove_repeats(df: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", window: int | None = None, whole: bool = True) -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with ``whole`` also kept (bytes) and spans.

    Texts are UTF-8 bytes, null is empty; strings are judged on the input and never cross
    rows.  Equal rows are removed from each other when they have ``length`` bytes.  Null
    and repeated keys keep a row each; empty table: no rows; other columns are not read.
    What is kept may end within a character: ``kept`` is binary.
    """
    rows = keyed(df, key, text)
    joined = rows.join(marked(rows, length, window), "rid", "left")

    def start():
        def fill(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *(("kept", "spans") if whole else ()))}
            for text_, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                data = (text_ or "").encode()
                kept, spans = remaining(data, runs, length)
                for n, v in zip(out, (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [x for s in spans for x in s])):
                    out[n].append(v)
            return out | {n: batch.column(n) for n in ("rid", "doc_id")}

        return fill

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(joined, start, f"rid long, doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept binary, spans array<int>' if whole else ''}")


def without_repeats(df: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """All rows and columns, their texts without what :func:`remove_repeats` removes.

    A character that loses some of its bytes goes altogether.  ``size``, if there is such
    a column, becomes the number of characters left; null texts stay null.
    """
    row = unused("row", df)
    whole = written(df.withColumn(row, F.monotonically_increasing_id()), "documents")
    rows = whole.select(F.col(row).alias("rid"), F.col(f"`{text}`").alias("text"))
    found = marked(rows, length)

    @F.pandas_udf("string")
    def left(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([t if r is None else remaining(t.encode(), list(r), length)[0].decode(errors="ignore") for t, r in zip(texts, runs)], dtype=object)

    runs = unused("runs", df)
    joined = whole.join(found.select(F.col("rid").alias(row), F.col("runs").alias(runs)), row, "left")
    shorter = F.when(F.col(runs).isNull(), F.col(f"`{text}`")).otherwise(left(F.col(f"`{text}`"), F.col(runs)))
    out = joined.withColumn(text, shorter)
    if size in df.columns:
        out = out.withColumn(size, F.when(F.col(runs).isNull(), F.col(f"`{size}`")).otherwise(F.length(F.col(f"`{text}`")).cast(df.schema[size].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
