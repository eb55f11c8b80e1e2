"""Sections, flat rows and ranges of a document, by windows over its order.

All windows are partitioned by ``ms_id``, so one exchange serves them.  Ties of the order
column are broken by the next column named; rows of one document never need another's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T

LEVELS = 9


def _before(*order: str):
    return Window.partitionBy("ms_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(*order: str):
    return Window.partitionBy("ms_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def parents(headings: DataFrame, order: str = "ord", deepest: int = LEVELS) -> DataFrame:
    """B-10: adds parent_ord, the nearest heading before with a smaller level; null for a top one.

    The nearest is the last of the last headings of every smaller level.
    """
    last = [F.last(F.when(F.col("level") == k, F.col(order)), ignorenulls=True).over(_before(order)) for k in range(1, deepest)]
    of_smaller = [F.when(F.col("level") > k, c) for k, c in enumerate(last, 1)]
    return headings.withColumn("parent_ord", F.greatest(*of_smaller))


def owners(rows: DataFrame, order: str = "ord") -> DataFrame:
    """B-10: adds section_ord, the heading that a row falls under (its own, if it is one); null before the first."""
    return rows.withColumn("section_ord", F.last(F.when(F.col("is_heading"), F.col(order)), ignorenulls=True).over(_upto(order)))


def usable_headings(headings: DataFrame, title: str = "title_raw") -> DataFrame:
    """B-11: headings that are neither blank nor template furniture."""
    t = T.stripped(F.col(title))
    return headings.where((t != "") & T.furniture_label(t).isNull())


def flatten(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """B-12: a row for each heading and block of a document, numbered from 0 in reading order.

    ``sections``: ms_id, sec_ord, level, role, title_raw; ``blocks``: ms_id, sec_ord, blk_ord, kind, text.
    Blocks of a section follow its heading; sections are in preorder.
    """
    heads = sections.select("ms_id", "sec_ord", F.lit(-1).alias("blk_ord"), F.lit(True).alias("is_heading"), "level", "role", F.lit("heading").alias("kind"), F.col("title_raw").alias("text"))
    rows = blocks.select("ms_id", "sec_ord", "blk_ord", F.lit(False).alias("is_heading"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("role"), "kind", "text")
    number = F.row_number().over(Window.partitionBy("ms_id").orderBy("sec_ord", F.desc("is_heading"), "blk_ord")) - 1
    return heads.unionByName(rows).withColumn("idx", number)


def rebuild(rows: DataFrame, roles: list[str]) -> DataFrame:
    """B-13: the tree of flat rows: levels clamped to 1..6, unknown roles unknown, each row with its section.

    Rows before the first heading belong to the preamble, whose number is -1.
    """
    level = F.when(F.col("is_heading"), F.least(F.greatest("level", F.lit(1)), F.lit(6))).otherwise(0)
    role = F.when(F.col("is_heading"), F.when(F.col("role").isin(*roles), F.col("role")).otherwise("unknown"))
    clean = rows.withColumn("level", level).withColumn("role", role)
    owned = owners(clean, "idx").withColumn("section_ord", F.coalesce("section_ord", F.lit(-1)))
    heads = parents(clean.where("is_heading"), "idx", 7).select("ms_id", "idx", "parent_ord")
    return owned.join(heads, ["ms_id", "idx"], "left")


def preview(kind: Column, text: Column, target: Column) -> Column:
    """B-17: what stands for a block in a list of rows."""
    return (
        F.when(kind == "paragraph", T.stripped(text))
        .when(kind.isin("figure_ref", "table_ref", "equation_ref"), F.concat(F.lit("["), F.substring_index(kind, "_", 1), F.lit(" "), target, F.lit("]")))
        .when(kind == "code", F.concat(F.lit("[code] "), F.left(text, F.lit(60))))
        .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    )


def row_table(rows: DataFrame, most: int = 110) -> DataFrame:
    """B-15: rows as an editor shows them."""
    return rows.select("ms_id", "idx", F.col("is_heading").alias("heading"), F.greatest("level", F.lit(1)).alias("level"), F.coalesce("role", F.lit("unknown")).alias("role"), "kind", F.left("text", F.lit(most)).alias("text"))


def apply_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """B-16: edits (ms_id, idx, heading, level, role) laid over rows; ``source`` is explicit only where one changed something."""
    new = edits.select("ms_id", "idx", F.coalesce("heading", F.lit(False)).alias("e_heading"), F.coalesce("level", F.lit(1)).alias("e_level"), F.coalesce("role", F.lit("unknown")).alias("e_role"))
    changed = (F.col("e_heading") != F.col("is_heading")) | (F.col("e_heading") & ((F.col("e_level") != F.col("level")) | (F.col("e_role") != F.coalesce("role", F.lit("unknown")))))
    edited = F.col("e_heading").isNotNull()
    return rows.join(new, ["ms_id", "idx"], "left").select(
        "ms_id", "idx", "text", "kind",
        F.when(edited, F.col("e_heading")).otherwise(F.col("is_heading")).alias("is_heading"),
        F.when(edited, F.col("e_level")).otherwise(F.col("level")).alias("level"),
        F.when(edited, F.col("e_role")).otherwise(F.col("role")).alias("role"),
        F.when(edited & changed, "explicit").otherwise(F.col("source")).alias("source"),
        F.when(edited & changed, 1.0).otherwise(F.col("confidence")).alias("confidence"),
    )


def first_by_role(sections: DataFrame) -> DataFrame:
    """B-07: the first section of each role in reading order."""
    return sections.withColumn("n", F.row_number().over(Window.partitionBy("ms_id", "role").orderBy("sec_ord"))).where("n = 1").drop("n")


def last_descendant(sections: DataFrame) -> DataFrame:
    """B-18: adds last_ord: a section's subtree is sec_ord..last_ord.

    It ends before the next section whose level is not deeper, or with the document.
    """
    ahead = Window.partitionBy("ms_id").orderBy("sec_ord").rowsBetween(1, Window.unboundedFollowing)
    following = [F.min(F.when(F.col("level") <= k, F.col("sec_ord"))).over(ahead) for k in range(1, LEVELS + 1)]
    ends = reduce(lambda c, k: c.when(F.col("level") == k, following[k - 1]), range(2, LEVELS + 1), F.when(F.col("level") == 1, following[0]))
    whole = Window.partitionBy("ms_id")
    return sections.withColumn("last_ord", F.coalesce(ends - 1, F.max("sec_ord").over(whole)))


def unwrap_title(sections: DataFrame, titles: DataFrame, canonical: list[str]) -> DataFrame:
    """B-20: promotes the children of a lone section that is really the title; adds unwrapped.

    That holds where at most two top-level sections exist, exactly one has children, its text
    equals the title, or one holds the other, and two or more distinct canonical roles are
    among the children.  The wrapper itself stays, as front matter.
    """
    whole = Window.partitionBy("ms_id")
    rows = parents(sections.withColumnRenamed("sec_ord", "ord")).withColumnRenamed("ord", "sec_ord").join(titles.select("ms_id", "title"), "ms_id", "left")
    is_top = F.col("parent_ord").isNull()
    kids = rows.where(~is_top).groupBy("ms_id", F.col("parent_ord").alias("sec_ord")).agg(F.collect_set("role").alias("child_roles"))
    rows = rows.join(kids, ["ms_id", "sec_ord"], "left")
    mine, title = T.match_key(F.col("title_raw")), T.match_key(F.col("title"))
    same = (mine != "") & (title != "") & (F.contains(mine, title) | F.contains(title, mine))
    several = F.size(F.array_intersect(F.coalesce("child_roles", F.array().cast("array<string>")), F.array(*map(F.lit, canonical)))) >= 2
    parents_at_top = F.sum((is_top & F.col("child_roles").isNotNull()).cast("int")).over(whole)
    tops = F.sum(is_top.cast("int")).over(whole)
    rows = rows.withColumn("wraps", is_top & (parents_at_top == 1) & (tops <= 2) & F.coalesce(same, F.lit(False)) & several)
    wrapper = F.max(F.when(F.col("wraps"), F.col("sec_ord"))).over(whole)
    wrapper_level = F.max(F.when(F.col("wraps"), F.col("level"))).over(whole)
    rows = last_descendant(rows).withColumn("wrapper", wrapper).withColumn("wrapper_end", F.max(F.when(F.col("wraps"), F.col("last_ord"))).over(whole)).withColumn("wrapper_level", wrapper_level)
    inside = F.coalesce((F.col("sec_ord") > F.col("wrapper")) & (F.col("sec_ord") <= F.col("wrapper_end")), F.lit(False))
    return rows.select(
        "ms_id", "sec_ord", "title_raw", "role", F.coalesce("wraps", F.lit(False)).alias("unwrapped"),
        F.when(inside, F.greatest(F.lit(1), F.col("level") - 1)).otherwise(F.col("level")).alias("level"),
        F.when(inside & (F.col("parent_ord") == F.col("wrapper")), F.lit(None)).otherwise(F.col("parent_ord")).alias("parent_ord"),
    )


def emitted_depth(sections: DataFrame, elsewhere: list[str], deepest: int = LEVELS) -> DataFrame:
    """B-24: adds depth: ancestors whose role is emitted elsewhere do not count.

    One pass a level: the last section of each smaller level, whether it counts.
    """
    counts = (~F.coalesce(F.col("role").isin(*elsewhere), F.lit(False))).cast("int")
    rows = sections.withColumn("counts", counts)
    last_at = lambda k, c: F.last(F.when(F.col("level") == k, c), ignorenulls=True).over(_before("sec_ord"))
    for k in range(1, deepest):
        rows = rows.withColumn(f"at_{k}", last_at(k, F.col("sec_ord"))).withColumn(f"counts_{k}", last_at(k, F.col("counts")))
    # level k's last section is an ancestor if no later section before this one is as shallow
    parts = []
    for k in range(1, deepest):
        shallower = [F.coalesce(F.col(f"at_{j}"), F.lit(-1)) for j in range(1, k)]
        alive = reduce(lambda a, b: a & b, [F.col(f"at_{k}") > s for s in shallower], F.col(f"at_{k}").isNotNull())
        parts.append(F.when((F.col("level") > k) & alive, F.col(f"counts_{k}")).otherwise(0))
    return rows.withColumn("depth", reduce(lambda a, b: a + b, parts)).select(*sections.columns, "depth")


def suggested_ranges(rows: DataFrame) -> DataFrame:
    """F-03: ms_id, role, first, last: the rows below the first heading of each role, up to the next heading."""
    ahead = Window.partitionBy("ms_id").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    bounded = rows.withColumn("next_heading", F.min(F.when(F.col("is_heading"), F.col("idx"))).over(ahead)).withColumn("final", F.max("idx").over(Window.partitionBy("ms_id")))
    heads = bounded.where("is_heading AND role IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("ms_id", "role").orderBy("idx"))).where("n = 1")
    return heads.select("ms_id", "role", (F.col("idx") + 1).alias("first"), F.coalesce(F.col("next_heading") - 1, F.col("final")).alias("last")).where("last >= first")


def claims(assignments: DataFrame) -> DataFrame:
    """F-04: ranges in the order of their starts, each cut where an earlier one ends; empty ones go.

    Cutting by the greatest end so far is exact: a range that is dropped ends before it.
    ``assignments``: ms_id, seq, role, start, end, title; equal starts are taken in the order of seq.
    """
    known = F.coalesce(F.max("end").over(_before("start", "seq")), F.lit(-1))
    cut = assignments.where("end >= start").withColumn("start", F.col("start").cast("long")).withColumn("known", known)
    return cut.withColumn("start", F.greatest("start", F.col("known") + 1)).where("start <= end").drop("known")


def apply_ranges(rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """F-05: every row with the section it belongs to once the ranges are confirmed.

    Returns ms_id, idx, section (idx of the row that opens it, -1 for the preamble), role,
    title, dropped (headings that a range swallows or takes as its title).  A range opens a
    section; a heading directly above is its title; other headings keep their own sections.
    """
    ranges = claims(assignments).select("ms_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("role").alias("c_role"), F.col("title").alias("c_title"))
    opened = rows.join(ranges.select("ms_id", F.col("c_start").alias("idx"), "c_start", "c_end", "c_role", "c_title"), ["ms_id", "idx"], "left")
    order = Window.partitionBy("ms_id").orderBy("idx")
    opens = F.col("c_start").isNotNull()
    covered = F.coalesce(F.last("c_end", ignorenulls=True).over(_upto("idx")) >= F.col("idx"), F.lit(False))
    takes_title = F.lead(opens).over(order) & F.col("is_heading")
    above = F.when(F.lag("is_heading").over(order), T.stripped(F.lag("text").over(order)))
    placed = opened.withColumn("covered", covered).withColumn("takes_title", F.coalesce(takes_title, F.lit(False))).withColumn("above", above).withColumn("opens", opens)
    own = F.col("is_heading") & ~F.col("opens") & ~F.col("covered") & ~F.col("takes_title")
    placed = placed.withColumn("starts", F.col("opens") | own)
    named = F.coalesce(F.nullif(T.stripped(F.coalesce("c_title", F.lit(""))), F.lit("")), F.col("above"), F.initcap(F.replace("c_role", F.lit("_"), F.lit(" "))))
    title = F.when(F.col("opens"), named).when(own, T.stripped(F.col("text")))
    role = F.when(F.col("opens"), F.col("c_role")).when(own, F.coalesce("role", F.lit("unknown")))
    upto = _upto("idx")
    carried = lambda c: F.last(F.when(F.col("starts"), c), ignorenulls=True).over(upto)
    return placed.withColumn("new_title", title).withColumn("new_role", role).select(
        "ms_id", "idx",
        F.coalesce(carried(F.col("idx")), F.lit(-1)).alias("section"), F.coalesce(carried(F.col("new_role")), F.lit("unknown")).alias("role"), F.coalesce(carried(F.col("new_title")), F.lit("")).alias("title"),
        (F.col("is_heading") & ~F.col("starts") & (F.col("takes_title") | F.col("covered"))).alias("dropped"),
    )


def numbered(rows: DataFrame, prefix: str, order: str, name: str) -> DataFrame:
    """F-01: ids such as fig1, fig2 in reading order."""
    return rows.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy("ms_id").orderBy(order)).cast("string")))


def number_mismatches(equations: DataFrame) -> DataFrame:
    """F-02: equations whose printed number is not their place in the document."""
    place = F.row_number().over(Window.partitionBy("ms_id").orderBy("ord"))
    return equations.withColumn("number", place).where(F.col("number_raw").try_cast("int").isNotNull() & (F.col("number_raw").try_cast("int") != F.col("number")))


def closing_breaks(rows: DataFrame) -> DataFrame:
    """F-18: adds part, the number of section breaks that closed before a row."""
    return rows.withColumn("part", F.coalesce(F.sum(F.col("is_break").cast("int")).over(_before("idx")), F.lit(0)))


def continued(rows: DataFrame) -> DataFrame:
    """F-20: entries of a list whose unmarked lines continue the one before, where enough lines are marked.

    ``rows``: ms_id, idx, text, is_marked.  Where fewer than max(2, half) are marked, each line is an entry.
    """
    whole = Window.partitionBy("ms_id")
    enough = F.sum(F.col("is_marked").cast("int")).over(whole) >= F.greatest(F.lit(2), F.floor(F.count("*").over(whole) / 2))
    running = F.sum(F.col("is_marked").cast("int")).over(_upto("idx"))
    grouped = rows.withColumn("entry", F.when(enough, running).otherwise(F.row_number().over(Window.partitionBy("ms_id").orderBy("idx"))))
    return grouped.groupBy("ms_id", "entry").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"))
