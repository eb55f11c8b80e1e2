"""Mixing sources to target weights, in DataFrame functions only (operator 5).

Sizes are words.  Every source's target is its weight's share of all words, but at most
``most`` times its own; what that cuts off goes to the others by weight until none is
above.  A source is taken in whole epochs first; what is left of its target is selected
from its documents in the order of Efraimidis-Spirakis keys (an exponential variable
divided by the document's quality weight, smallest first) up to that many words.

The order is never sorted as a whole.  Keys fall into about sqrt(rows) intervals, words
are summed by source and interval, and only the one interval of each source in which the
budget runs out is sorted.  The join of documents with their source's plan is salted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.shared import WORD, unused, written

SALTS = 64


def quality_weight(text: Column, size: Column) -> Column:
    """Between 1 and 2: longer documents with usual word lengths count more."""
    mean_length = F.try_divide(F.length(text), size)
    return 1 + 0.5 * F.least(F.lit(1.0), size / 200.0) + 0.5 * F.coalesce(mean_length.between(3, 12).cast("double"), F.lit(0.0))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed alone."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sized(df: DataFrame, seed: int, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """doc_id, group (the source, null told apart), size, late: 1 - u ** (1/w), in the order of the keys -ln(u)/w."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), size.alias("size"), *([F.col(row).alias("row")] if row else []))
    late = 1 - F.pow(uniform(F.col("doc_id"), seed), 1 / quality_weight(F.col("text"), F.col("size")))
    return rows.select("doc_id", F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source")).alias("group"), F.col("source").isNull().alias("nameless"), "size", late.alias("late"), *(["row"] if row else []))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """A row for each group: source_size, target, epochs, rest.  As many rows as there are sources."""
    groups = sizes.groupBy("group", "nameless").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("nameless", "group")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = groups.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    # sources in the order in which a rising level reaches their cap; those before one are full
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    levels = ranked.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("level", (F.col("total") - before) / open_weight)
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    planned = levels.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    return planned.select("group", "source_size", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest"))


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 20240229, key: str = "doc_id", text: str = "text", source: str = "source", intervals: int | None = None, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row; and ``row``, a column that numbers them.

    A row is taken ``copies`` times: its source's epochs, and once more when half of it
    still falls within the rest of the target; so a source misses its target by at most
    half a document.  Null sources are one source, last in order; null texts have size 0.
    Keys depend on doc_id alone: a rerun gives the same; equal keys fall back on size.
    Repeated rows each count.  Empty table: no rows.  Other columns are not read.
    """
    rows = written(sized(df, seed, key, text, source, row), "sizes")
    n = intervals or max(16, math.isqrt(rows.count()))
    rows = rows.withColumn("interval", F.least(F.floor(F.col("late") * n), F.lit(n - 1)))
    plan = targets(rows, weights, most)

    # the interval of each group in which the rest runs out, and the words before it
    words = rows.groupBy("group", "interval").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("group").orderBy("interval"))
    running = words.withColumn("upto", upto).join(plan.select("group", "rest"), "group")
    last = running.where("upto > rest").groupBy("group").agg(F.min(F.struct("interval", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    plan = written(plan.join(last, "group", "left").select("group", "source_size", "target", "epochs", "rest", F.coalesce("edge.interval", F.lit(n)).alias("edge"), F.coalesce("edge.before", F.lit(0)).alias("before")), "plan")

    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", (F.xxhash64("doc_id", "late") % SALTS + SALTS) % SALTS).join(salted, ["group", "salt"])
    inside = Window.partitionBy("group").orderBy("late", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = joined.where("interval = edge").withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    elsewhere = joined.where("interval <> edge").withColumn("start", F.lit(None).cast("long"))
    more = F.when(F.col("interval") == F.col("edge"), F.col("start") + F.col("size") / 2 <= F.col("rest")).otherwise(F.col("interval") < F.col("edge"))
    return (
        at_edge.unionByName(elsewhere)
        .withColumn("copies", F.col("epochs") + more.cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *(["row"] if row else []))
    )


def mixed(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, **names: str) -> DataFrame:
    """The mix itself: every row, all columns, as often as :func:`mix` takes it."""
    row, copies = unused("row", df), unused("copies", df)
    whole = written(df.withColumn(row, F.monotonically_increasing_id()), "documents")
    taken = mix(whole, weights, most, row=row, **names).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    again = whole.join(taken, row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return again.select(*[F.col(f"`{c}`") for c in df.columns])


#: The same mix in one statement: what the intervals spare, the whole order of each source, is sorted here.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         length(coalesce(text, '')) AS chars
  FROM documents),
k AS (
  SELECT *, (('0x' || substr(md5('20240229' || coalesce('|' || doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         1 + 0.5 * least(1.0::DOUBLE, size::DOUBLE / 200.0::DOUBLE)
           + CASE WHEN size > 0 AND chars::DOUBLE / size BETWEEN 3 AND 12 THEN 0.5 ELSE 0.0 END::DOUBLE AS w
  FROM d),
g AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM k GROUP BY source),
c AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE AS total
  FROM g),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
t AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER (), 0::DOUBLE) * weight) AS target
  FROM l),
e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size::DOUBLE) END::BIGINT AS epochs FROM t),
o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY 1 - pow(u, 1 / w), k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN start + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken,
       (epochs + CASE WHEN start + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM o
"""
