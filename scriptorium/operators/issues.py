"""Issue rows (ms_id, severity, code, message, location) out of what the other operators find.

Uncertainty is a row, never an exception: every stage has its issues, and :func:`numbered`
puts them in one table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("ms_id", "severity", "code", "message", "location")


def _rows(found: DataFrame, severity: str, code: str, message: Column, location: Column | None = None) -> DataFrame:
    return found.select("ms_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.cast("string").alias("message"), (F.lit("") if location is None else location.cast("string")).alias("location"))


def _counted(found: DataFrame, severity: str, code: str, text: str) -> DataFrame:
    """One row a manuscript; its message begins with how many there are."""
    counts = found.groupBy("ms_id").agg(F.count("*").alias("n"))
    return _rows(counts, severity, code, F.concat(F.col("n").cast("string"), F.lit(f" {text}")))


def orphan_media(orphans: DataFrame) -> DataFrame:
    """Media that nothing refers to: how many, and the first five."""
    names = F.array_join(F.slice(F.array_sort(F.collect_list("filename")), 1, 5), ", ")
    found = orphans.groupBy("ms_id").agg(F.count("*").alias("n"), names.alias("names"))
    return _rows(found, "info", "orphan_media", F.concat(F.col("n").cast("string"), F.lit(" media files are not referred to: "), "names"))


def missing_captions(floats: DataFrame) -> DataFrame:
    """Figures and tables (ms_id, float_id, caption) without a caption."""
    return _rows(floats.where("coalesce(caption, '') = ''"), "warning", "missing_caption", F.concat(F.col("float_id").cast("string"), F.lit(" has no caption that could be found.")), F.col("float_id"))


def floating_images(figures: DataFrame) -> DataFrame:
    return _rows(figures.where("floating"), "info", "floating_image", F.lit("A floating image: its place in the reading order is approximate."), F.col("fig_id"))


def estimated_positions(anchors: DataFrame) -> DataFrame:
    """Figures placed by a neighbour, in either direction, or in proportion only."""
    near = _rows(anchors.where("method = 'neighbour'"), "info", "figure_anchored_by_neighbour", F.lit("Placed beside a paragraph near it in the source."), F.col("fig_id"))
    far = _rows(anchors.where("method = 'estimated'"), "warning", "figure_position_estimated", F.lit("Placed in proportion to its place in the source."), F.col("fig_id"))
    return near.unionByName(far)


def layout_tables(equation_rows: DataFrame, empty: DataFrame) -> DataFrame:
    """Tables that became equations, and empty ones that were dropped; the latter's message begins with their number."""
    turned = equation_rows.groupBy("ms_id", "tab_id").agg(F.count("*").alias("n"))
    one = _rows(turned, "info", "equation_table", F.concat(F.lit("A table of "), F.col("n").cast("string"), F.lit(" rows only lays out numbered equations.")), F.col("tab_id"))
    return one.unionByName(_counted(empty, "info", "layout_table_dropped", "empty layout tables were dropped."))


def number_mismatches(mismatches: DataFrame) -> DataFrame:
    return _rows(mismatches, "warning", "eqnum_mismatch", F.concat(F.lit("Printed as "), "number_raw", F.lit(", in place "), F.col("number").cast("string")), F.col("ord"))


def headings(demoted: DataFrame, promoted: DataFrame, unwrapped: DataFrame) -> DataFrame:
    """Headings that are template furniture, paragraphs that became headings (by_model), wrappers that were opened."""
    n = promoted.groupBy("ms_id").agg(F.count("*").alias("n"), F.count_if("by_model").alias("m"))
    made = _rows(n, "info", "implicit_headings", F.concat(F.col("n").cast("string"), F.lit(" paragraphs were taken as headings, "), F.col("m").cast("string"), F.lit(" of them by the model.")))
    parts = [_counted(demoted, "info", "boilerplate_heading_demoted", "headings belong to the template."), made, _rows(unwrapped.where("unwrapped"), "info", "title_wrapper_unwrapped", F.lit("A section that was the title's own was opened."), F.col("sec_ord"))]
    return reduce(DataFrame.unionByName, parts)


def roles(sections: DataFrame) -> DataFrame:
    """Roles that a model gave, and top-level sections without one; ``sections``: role, role_method, level, title_raw, sec_ord."""
    open_ = sections.where("role = 'unknown' AND level = 1 AND title_raw <> ''")
    titles = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("sec_ord", F.left("title_raw", F.lit(40)).alias("t")))), 1, 6), lambda x: x["t"]), "; ")
    listed = open_.groupBy("ms_id").agg(F.count("*").alias("n"), titles.alias("titles"))
    without = _rows(listed, "warning", "unclassified_sections", F.concat(F.col("n").cast("string"), F.lit(" sections have no role: "), "titles"))
    return _counted(sections.where("role_method = 'model'"), "info", "role_model_used", "roles were given by the model.").unionByName(without)


def lost_text(lost: DataFrame, most: int = 12) -> DataFrame:
    """Paragraphs that the reader lost: one error with their words, and the first of them named."""
    from scriptorium.functions.text import word_count

    whole = lost.groupBy("ms_id").agg(F.count("*").alias("n"), F.sum(word_count(F.col("text"))).alias("words"))
    error = _rows(whole, "error", "text_lost_by_reader", F.concat(F.col("n").cast("string"), F.lit(" paragraphs were lost, "), F.col("words").cast("string"), F.lit(" words.")))
    named = lost.withColumn("n", F.row_number().over(Window.partitionBy("ms_id").orderBy("idx"))).where(F.col("n") <= most)
    return error.unionByName(_rows(named, "warning", "recovered_paragraph", F.left("text", F.lit(90)), F.col("idx")))


def numbered(*parts: DataFrame) -> DataFrame:
    """All issues in one table, numbered within their manuscript."""
    filled = [p.select("ms_id", "severity", "code", *[(F.col(c) if c in p.columns else F.lit("")).cast("string").alias(c) for c in ("message", "location")]) for p in parts]
    every = reduce(DataFrame.unionByName, filled)
    return every.withColumn("seq", F.row_number().over(Window.partitionBy("ms_id").orderBy("severity", "code", "location", "message")))
