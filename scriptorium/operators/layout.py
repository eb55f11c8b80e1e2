"""Decisions on a manuscript's pages: what goes, what is restyled, how sections are set.

Each returns rows that name the decision; writing packages is the caller's affair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import text as T


def masthead(paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """L-01: ms_id, masthead_end: the paragraph that is the title, else 12, or as many as there are."""
    norm = lambda c: F.lower(T.stripped(T.replaced(c, r"\s+", " ")))
    rows = paragraphs.join(titles.select("ms_id", "title"), "ms_id", "left")
    wanted = norm(F.col("title"))
    hit = (wanted != "") & (norm(F.col("text")) == wanted)
    return rows.groupBy("ms_id").agg(F.coalesce(F.min(F.when(hit, F.col("idx"))), F.least(F.lit(12), F.count("*"))).cast("long").alias("masthead_end"))


def removals(paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """L-02 to L-04: ms_id, idx, reason of paragraphs that are the journal's and not the author's.

    Small pictures above the title are logos; furniture goes by its patterns; blank
    paragraphs go where nothing is before them.  ``paragraphs``: ms_id, idx, text, has_drawing, width_mm.
    """
    rows = paragraphs.join(masthead(paragraphs, titles), "ms_id")
    logo = F.col("has_drawing") & (F.col("idx") < F.col("masthead_end")) & (F.col("width_mm") > 0) & (F.col("width_mm") <= P.LOGO_MAX_MM)
    label = T.furniture_label(T.stripped(F.col("text")))
    rows = rows.withColumn("reason", F.when(logo, "logo").otherwise(label))
    kept = F.col("reason").isNull() & ((T.stripped(F.col("text")) != "") | F.col("has_drawing"))
    first = F.min(F.when(kept, F.col("idx"))).over(Window.partitionBy("ms_id"))
    rows = rows.withColumn("first_kept", first)
    reason = F.coalesce("reason", F.when(F.col("idx") < F.coalesce("first_kept", F.col("idx")), "leading blank"))
    return rows.select("ms_id", "idx", reason.alias("reason")).where("reason IS NOT NULL")


def cleaned(paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """L-07: the paragraphs that stay."""
    return paragraphs.join(removals(paragraphs, titles).select("ms_id", "idx"), ["ms_id", "idx"], "left_anti")


def described(paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """L-07: the same plan without applying it: how many paragraphs go, by reason."""
    return removals(paragraphs, titles).groupBy("ms_id", "reason").agg(F.count("*").alias("paragraphs"))


def indents(paragraphs: DataFrame, millimetres: float = 0.0) -> DataFrame:
    """L-05: paragraphs whose first-line indent differs from the one wanted; headings, tables and lists are left alone."""
    wanted = round(millimetres * 1440 / 25.4)
    return paragraphs.where(~F.col("in_table") & ~F.col("is_heading") & ~F.col("is_list") & (F.coalesce("first_line", F.lit(0)) != wanted)).withColumn("first_line", F.lit(wanted))


def emptied_parts(parts: DataFrame) -> DataFrame:
    """L-06: headers and footers, and footnotes that are furniture; they are emptied, not deleted."""
    base = F.substring_index("name", "/", -1)
    kind = F.when(base.rlike(r"^header.*\.xml$"), "header").when(base.rlike(r"^footer.*\.xml$"), "footer").when((base == "footnotes.xml") & T.furniture_label(F.col("text")).isNotNull(), "footnote")
    return parts.withColumn("emptied", kind).where("emptied IS NOT NULL")


def columns_plan(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """L-08, L-09: columns of each section: collapsing is always safe, widening keeps a full-width title block.

    ``sections``: ms_id, part, columns; ``wanted``: ms_id, want, has_body (whether the first body
    section is known).  Action: collapse, keep, normalise, split or set.
    """
    whole = Window.partitionBy("ms_id")
    rows = sections.join(wanted, "ms_id").withColumn("varies", F.min("columns").over(whole) != F.max("columns").over(whole))
    action = (
        F.when(F.col("want") == 1, F.when(F.col("columns") > 1, "collapse").otherwise("keep"))
        .when(F.col("varies"), F.when((F.col("columns") > 1) & (F.col("columns") != F.col("want")), "normalise").otherwise("keep"))
        .when(F.col("has_body"), "split")
        .otherwise("set")
    )
    after = F.when(F.col("action") == "keep", F.col("columns")).otherwise(F.col("want"))
    return rows.withColumn("action", action).withColumn("new_columns", after).select("ms_id", "part", "columns", "new_columns", "action")


def split_point(rows: DataFrame, body_roles: list[str]) -> DataFrame:
    """H-51, L-09: ms_id, idx of the heading that opens the body: the first with a body role, else one that looks it."""
    looks = T.matches(T.stripped(F.col("text")), r"^\s*(1|I)[.)]?\s+\S|^\s*introduction\b", True)
    heads = rows.where("is_heading")
    return heads.groupBy("ms_id").agg(F.coalesce(F.min(F.when(F.col("role").isin(*body_roles), F.col("idx"))), F.min(F.when(looks, F.col("idx")))).alias("idx")).where("idx IS NOT NULL")


def cleared_direction(paragraphs: DataFrame) -> DataFrame:
    """L-10: paragraphs marked right-to-left that hold no such script."""
    return paragraphs.where(F.col("bidi") & ~T.is_right_to_left(F.col("text")))


def paragraph_classes(paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """D-12, L-11: heading, caption or body; a paragraph is a heading if a section has its text, the last such section's."""
    key = lambda c: F.lower(T.normal_space(c))
    titles = sections.where("title_raw <> ''").select("ms_id", key(F.col("title_raw")).alias("k"), "sec_ord", "level").groupBy("ms_id", "k").agg(F.max_by("level", "sec_ord").alias("level"))
    rows = paragraphs.withColumn("k", key(F.col("text"))).join(titles, ["ms_id", "k"], "left")
    return rows.withColumn("class", F.when(F.col("level").isNotNull(), "heading").when(T.caption(F.col("text")).isNotNull(), "caption").otherwise("body")).drop("k")


def unsupported(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """L-12, D-20, F-14: what a restyled manuscript still lacks, a row for each."""
    ranks = F.transform(F.filter("top_roles", lambda r: F.array_contains("section_order", r)), lambda r: F.array_position("section_order", r))
    missing = F.array_except("required_sections", F.array_union("present", F.array(F.lit("abstract"), F.lit("keywords"))))
    rows = F.array(F.when(ranks != F.array_sort(ranks), "section_order"), F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(missing), ", "))))
    return facts.crossJoin(profiles).select("ms_id", "profile_id", F.explode(rows).alias("what")).where("what IS NOT NULL")


def merged_styles(target: DataFrame, template: DataFrame) -> DataFrame:
    """D-13, L-13: styles of both by name; the template's properties win, the target's ids stay.

    ``target`` and ``template``: style_id, name, props.  A template style whose id another
    target style has gets an X behind it; base is not followed here, see :func:`remapped`.
    """
    key = F.lower(F.trim("name"))
    mine = target.select(key.alias("k"), F.col("style_id").alias("t_id"), F.col("name").alias("t_name"), F.col("props").alias("t_props"))
    theirs = template.select(key.alias("k"), F.col("style_id").alias("s_id"), F.col("name").alias("s_name"), F.col("props").alias("s_props"))
    both = mine.join(theirs, "k", "full_outer")
    taken = target.select(F.col("style_id").alias("s_id"), F.lit(True).alias("clash"))
    both = both.join(taken, "s_id", "left")
    new_id = F.when(F.col("t_id").isNotNull(), F.col("t_id")).when(F.col("clash"), F.concat("s_id", F.lit("X"))).otherwise(F.col("s_id"))
    origin = F.when(F.col("t_id").isNull(), "template").when(F.col("s_id").isNull(), "target").otherwise("both")
    return both.select(new_id.alias("style_id"), F.coalesce("s_name", "t_name").alias("name"), F.coalesce("s_props", "t_props").alias("props"), origin.alias("origin"), F.col("s_id").alias("template_id"))


def remapped(references: DataFrame, merged: DataFrame) -> DataFrame:
    """D-13: references to template styles (style_id, refers_to) by their new ids; dangling ones go."""
    ids = merged.where("template_id IS NOT NULL").select(F.col("template_id").alias("refers_to"), F.col("style_id").alias("new_id"))
    return references.join(ids, "refers_to").select("style_id", F.col("new_id").alias("refers_to"))


def found_styles(hints: DataFrame, names: DataFrame) -> DataFrame:
    """D-14: for each key the style its hints name: exactly or in part, the first hint first.

    ``hints``: key, hint_ord, hint; ``names``: name_ord, name.
    """
    exact = F.lower("name") == F.lower("hint")
    rows = hints.join(names, exact | F.contains(F.lower("name"), F.lower("hint")))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(exact), "hint_ord", "name_ord"))
    return rows.withColumn("place", place).where("place = 1").select("key", "name")


def column_width_emu(page_mm: float, margins_mm: float, columns: int, gutter_emu: int = 457_200) -> int:
    """H-52: usable width of a column in EMU."""
    text = int(page_mm * 36_000) - int(margins_mm * 36_000)
    return text if columns <= 1 else (text - (columns - 1) * gutter_emu) // columns


def oversized(drawings: DataFrame) -> DataFrame:
    """H-52: inline drawings wider than their column, with the size that fits; ``drawings``: cx, cy, column_emu."""
    ratio = F.col("column_emu") / F.col("cx")
    return drawings.where(F.col("cx") > F.col("column_emu") * 1.01).withColumn("new_cx", F.col("column_emu")).withColumn("new_cy", F.floor(F.col("cy") * ratio).cast("long"))


def tabbed_padding(text):
    """H-52: runs of six and more spaces as a tab."""
    return F.regexp_replace(text, r" {6,}", "\t")
