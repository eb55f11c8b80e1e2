"""Connected components of a large graph by alternating large and small stars.

Every round is two joins on node ids; no component ever meets in one task, and nothing
but an answer a round comes to the driver: whether each component is a star by now.  Rounds are written to the shared folder,
so a lost executor costs at most the round it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.shared import drop_written, written


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is either one edge's lower end or the upper end of just one: then each star is a component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return degrees.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root) for every node of an edge: root is the smallest id that edges reach."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not _all_stars(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "edges")
        drop_written(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
