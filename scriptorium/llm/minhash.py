"""MinHash near-duplicates by fast similarity sketching (operator 3).

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round i every element goes to a bin
that its i-th hash names, with value i plus a hash fraction; a bin keeps its smallest
value.  After t rounds, round t + b sends every element to bin b.  Rounds end when every
bin is filled, for most sets after few, and agreements of two sketches are concentrated
around the Jaccard similarity as if sampled without replacement.

1. Rows with equal shingle sets are one class; from here on a class is one row.
2. Sketches of ``ROWS`` coordinates are banded; classes that share a band are candidates.
   A pair of similarity 0.75 shares none of the 48 bands with probability 1.2e-8.
3. Candidates form groups (components of the star graph from each band's least class).
   A group of bounded size meets in one task, which compares full sets exactly.
4. Larger groups are dealt into blocks.  Blocks are compared inside; some delegates of
   every sizeable block component meet again; then whatever is not in its group's largest
   component is a query set, compared with all rows of the group block by block.  Nothing
   is capped: two members stay uncompared only if they are already connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.graph import components
from scriptorium.llm.shared import drop_written, map_batches, text_rows, unused, written
from scriptorium.llm.shingles import STEP, links, mixed, roots, shingles

BANDS, ROWS = 48, 4
SIZE = BANDS * ROWS
#: A group meets in one task up to so many members and bytes of text.
MEMBERS, BYTES = 1000, 8_000_000
#: One multiple of STEP for each round.
ROUND = np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * STEP


def sketch(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The coordinates of a non-empty set: per bin its smallest (round, fraction, element) as one number."""
    found = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * size):
        hashed = mixed(elements + ROUND[i])
        bins = (hashed >> np.uint64(40)) % np.uint64(size) if i < size else np.full(len(hashed), i - size, np.uint64)
        # earlier rounds are smaller: the round is in the top bits
        np.minimum.at(found, bins, (np.uint64(i) << np.uint64(54)) | (mixed(hashed) >> np.uint64(10)))
        if found.max() != np.iinfo(np.uint64).max:
            break
    return found


def band_keys(elements: np.ndarray) -> list[int]:
    coordinates = sketch(elements).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * STEP
    for r in range(ROWS):
        keys = mixed(keys * STEP + coordinates[:, r])
    return keys.astype(np.int64).tolist()


def sketched(rows: DataFrame) -> DataFrame:
    """rid, n_shingles, bytes, two hashes of the set and its band keys, from rows (rid, text)."""

    def start():
        def fill(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_shingles", "bytes", "h1", "h2", "bands")}
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                out["n_shingles"].append(len(found))
                out["bytes"].append(len(text or ""))
                out["h1"].append(int(mixed(found).sum(dtype=np.uint64).astype(np.int64)))
                out["h2"].append(int(np.bitwise_xor.reduce(mixed(found * STEP), initial=np.uint64(0)).astype(np.int64)))
                out["bands"].append(band_keys(found) if len(found) else [])
            return out | {"rid": batch.column("rid")}

        return fill

    return map_batches(rows.select("rid", "text"), start, "rid long, n_shingles long, bytes long, h1 long, h2 long, bands array<long>")


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """(rid, root) within each value of ``part``, from rows (part, rid, text): all members compared exactly."""

    def compare(table: pa.Table) -> pa.Table:
        rids = table.column("rid").to_pylist()
        order = sorted(range(len(rids)), key=rids.__getitem__)
        texts = table.column("text")
        sets = [shingles(texts[i].as_py()) for i in order]
        root = roots(len(order), links(sets, percent))
        rids = [rids[i] for i in order]
        return pa.table({"part": table.column("part"), "rid": pa.array(rids, pa.int64()), "root": pa.array([rids[r] for r in root], pa.int64())})

    return rows.groupBy("part").applyInArrow(compare, f"part {rows.schema['part'].dataType.simpleString()}, rid long, root long")


def _compare_queries(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from rows (part, rid, asked, text): between asked members and any of their part."""

    def compare(table: pa.Table) -> pa.Table:
        rids, asked = table.column("rid").to_pylist(), np.array(table.column("asked").to_pylist(), bool)
        texts = table.column("text")
        pairs = links([shingles(texts[i].as_py()) for i in range(len(rids))], percent, asked)
        return pa.table({"a": pa.array([rids[i] for i, _ in pairs], pa.int64()), "b": pa.array([rids[j] for _, j in pairs], pa.int64())})

    return rows.groupBy("part").applyInArrow(compare, "a long, b long")


def _large(members: DataFrame, percent: int) -> DataFrame:
    """(rid, root) of groups too large for a task; ``members``: rid, group, bytes, text."""
    texts, members = members.select("rid", "text"), members.drop("text")
    totals = members.groupBy("group").agg(F.count("*").alias("m"), F.sum("bytes").alias("all_bytes"))
    blocks = F.greatest(F.ceil(F.col("m") * 2 / MEMBERS), F.ceil(F.col("all_bytes") * 2 / BYTES)).cast("int")
    members = members.join(totals.select("group", blocks.alias("blocks")), "group")
    members = written(members.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")), "members")
    found = None
    level, used = members, []
    while True:  # inside blocks, then between delegates of the blocks' components
        parts = level.select("rid", F.concat_ws("/", F.col("group").cast("string"), F.col("block").cast("string")).alias("part"))
        inside = written(_compare(parts.join(texts, "rid"), percent), "inside")
        used += [inside, *([level] if level is not members else [])]
        pairs = inside.select("rid", "root").where("rid <> root")
        found = pairs if found is None else found.unionAll(pairs)
        ranked = inside.join(level.select("rid", "group", "blocks"), "rid").withColumn("n", F.row_number().over(Window.partitionBy("part", "root").orderBy(F.xxhash64("rid"), "rid"))).withColumn("size", F.count("*").over(Window.partitionBy("part", "root")))
        delegates = ranked.where("n <= 8 AND size >= 4 AND blocks > 1")
        fewer = F.greatest(F.lit(1), F.ceil(F.col("blocks") / 8)).cast("int")
        level = written(delegates.select("rid", "group", fewer.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("blocks")).cast("int")), "delegates")
        if level.isEmpty():
            break
    known = components(found, "rid", "root").withColumnsRenamed({"id": "rid"})
    placed = written(members.join(known, "rid", "left").withColumn("root", F.coalesce("root", "rid")), "placed")
    for table in used:
        drop_written(table)
    # what is outside its group's largest component is asked against all of the group
    sizes = placed.groupBy("group", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("group").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("largest"))
    outside = placed.join(largest, "group").withColumn("asked", F.col("root") != F.col("largest"))
    asked = outside.where("asked")
    rounds = asked.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * 2 / MEMBERS), F.ceil(F.sum("bytes") * 2 / BYTES)).cast("int").alias("rounds"))
    part = F.concat_ws("/", F.col("group").cast("string"), F.col("q").cast("string"), F.col("b").cast("string")).alias("part")
    rows = outside.join(rounds, "group")
    as_query = rows.where("asked").withColumn("q", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("rounds"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    as_row = rows.withColumn("b", F.col("block")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    columns = ["rid", "asked", part]
    dealt = as_query.select(*columns).unionAll(as_row.select("rid", F.lit(False).alias("asked"), part)).groupBy("rid", "part").agg(F.max("asked").alias("asked"))
    cross = _compare_queries(dealt.join(texts, "rid"), percent)
    edges = placed.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")).unionAll(cross)
    whole = components(edges, "a", "b").withColumnsRenamed({"id": "rid"})
    drop_written(placed)
    return members.select("rid").join(whole, "rid", "left").select("rid", F.coalesce("root", "rid").alias("root"))


def near_duplicates(df: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, rid, root for every row; components of links of ``percent`` or more.

    Words are split at ASCII white space and shingles have five words, or all of fewer.
    Rows without words have 0 shingles, no links and themselves as component.  Repeated
    rows share one; of rows with equal keys in a component every one is kept.  A null key
    counts as larger than any; a component of such rows alone has a null id and keeps
    them.  Empty table: no rows.  Other columns are not read.  ``rid`` numbers the rows
    as written to the shared folder, see :func:`keyed`; ``root`` is a component's least one.
    """
    rows = keyed(df, key, text)
    found = _components_of(rows, percent)
    drop_written(rows)  # the result reads numbers and keys only
    return found


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text with a number for each row, written so that the number stays."""
    return written(text_rows(df, key, text).withColumn("rid", F.monotonically_increasing_id()), "keyed")


def _components_of(rows: DataFrame, percent: int) -> DataFrame:
    found = written(sketched(rows), "sketches")
    with_words = found.where("n_shingles > 0")
    class_of = ["h1", "h2", "n_shingles"]
    classes = with_words.groupBy(*class_of).agg(F.min(F.struct("rid", "bytes")).alias("low")).select(*class_of, F.col("low.rid").alias("class"), F.col("low.bytes").alias("bytes"))
    members = written(found.join(classes.select(*class_of, "class").hint("merge"), class_of, "left").select("rid", "n_shingles", "bytes", F.coalesce("class", "rid").alias("class")), "classes")

    bands = written(found.join(members.where("rid = class AND n_shingles > 0").select("rid").hint("merge"), "rid", "left_semi").select("rid", F.explode("bands").alias("band")), "bands")
    drop_written(found)  # each table goes when nothing reads it any longer
    shared = bands.groupBy("band").agg(F.min("rid").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least").hint("merge")
    stars = bands.join(shared, "band").where("rid <> least").select("rid", "least").distinct()
    groups = written(components(stars, "rid", "least").withColumnRenamed("id", "rid").join(members.where("rid = class").select("rid", "bytes"), "rid").withColumnRenamed("root", "group"), "groups")
    drop_written(bands)
    totals = groups.groupBy("group").agg(F.count("*").alias("m"), F.sum("bytes").alias("all_bytes"))
    over = totals.where(f"m > {MEMBERS} OR all_bytes > {BYTES}").select("group")
    # texts travel once, and only those of candidates go on; joined alike at every size
    located = written(groups.join(rows.select("rid", "text").hint("merge"), "rid"), "candidates")
    inside = _compare(located.join(over, "group", "left_anti").select("rid", F.col("group").alias("part"), "text"), percent).select("rid", "root")
    rooted, used = inside, [groups, located]
    if not over.isEmpty():
        used.append(large := written(located.join(over, "group", "left_semi"), "large"))
        rooted = inside.unionAll(_large(large, percent))
    rooted = written(rooted.withColumnRenamed("rid", "class"), "roots")
    for table in used:
        drop_written(table)

    placed = members.join(rooted, "class", "left").select("rid", "n_shingles", F.coalesce("root", "class").alias("root")).join(rows.select("rid", "doc_id"), "rid")
    placed = written(placed, "placed")
    drop_written(members)
    drop_written(rooted)
    least = written(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    named = placed.join(least.hint("merge"), "root")  # both sides are read and dealt: a hot root is split
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "rid", "root")


def keep_one(df: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near copies, with all its columns: that of the smallest key.

    Null keys come last; of rows with equal keys one stays.  Rows without words all stay.
    """
    row = unused("row", df)
    whole = written(df.withColumn(row, F.monotonically_increasing_id()), "documents")
    rows = whole.select(F.col(row).alias("rid"), F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = _components_of(rows, percent)
    low = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("low"))
    return whole.join(low.select(F.col("low.rid").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
