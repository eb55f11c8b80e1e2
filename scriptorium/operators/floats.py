"""Figures, tables and equations: captions, anchors, layout tables, placement."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import text as T
from scriptorium.session import ship


def with_files(images: DataFrame, rels: DataFrame) -> DataFrame:
    """D-01, A-05: images with the file their relationship names; those without one go."""
    return images.join(rels, ["ms_id", "rid"])


def figures_of(images: DataFrame) -> DataFrame:
    """D-02, F-01: a figure for each paragraph with images, its panels in order; numbered in reading order.

    ``images``: ms_id, img_ord, para_index, filename, svg_filename, width_emu, height_emu, anchored.
    The vector original of a picture is preferred to its raster.
    """
    preferred = F.coalesce(F.nullif("svg_filename", F.lit("")), "filename")
    grouped = images.groupBy("ms_id", "para_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("img_ord", preferred.alias("file")))), lambda x: x["file"]).alias("files"),
        F.bround(F.max("width_emu") / P.EMU_PER_MM, 1).alias("placed_width_mm"), F.bround(F.max("height_emu") / P.EMU_PER_MM, 1).alias("placed_height_mm"), F.max("anchored").alias("floating"),
    )
    ord_ = F.row_number().over(Window.partitionBy("ms_id").orderBy("para_index"))
    return grouped.withColumn("ord", ord_).withColumn("fig_id", F.concat(F.lit("fig"), F.col("ord").cast("string")))


def nearest_captions(floats: DataFrame, paragraphs: DataFrame, table: bool = False) -> DataFrame:
    """D-03: the caption of each float: the nearest paragraph that has one of its kind, within three.

    The float's own paragraph comes first, then those after it, then those before, near to far.
    ``floats``: ms_id, float_id, idx; ``paragraphs``: ms_id, idx, text.  Floats without one are kept with null.
    """
    offsets = F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(n).alias("priority")) for n, o in enumerate(P.FLOAT_OFFSETS)])
    probes = floats.select("*", F.inline(offsets)).withColumn("at", F.col("idx") + F.col("offset"))
    captioned = paragraphs.withColumn("c", T.caption(T.stripped(F.col("text")), anywhere=True)).where(F.col("c").isNotNull() & (F.startswith("c.kind", F.lit("tab")) == table))
    found = probes.join(captioned.select("ms_id", F.col("idx").alias("at"), F.col("text").alias("caption"), "c"), ["ms_id", "at"])
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("ms_id", "float_id").orderBy("priority"))).where("place = 1")
    chosen = first.select("ms_id", "float_id", F.when(~T.looks_like_path(F.col("caption")), F.col("caption")).alias("caption"), F.col("c.number").alias("number"), "offset")
    return floats.join(chosen, ["ms_id", "float_id"], "left")


def consumed_captions(stream: DataFrame) -> DataFrame:
    """D-04: table captions, each paragraph given to one table only, tables in reading order.

    ``stream``: ms_id, idx, kind ('table' or 'paragraph'), float_id, text.  What one table takes
    the next cannot, so a document's few tables are gone through in order, in one task; the
    candidates are found by a join first and only they travel.
    """
    ship(stream.sparkSession)
    tables = stream.where("kind = 'table'").select("ms_id", "idx", "float_id")
    offsets = F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(n).alias("priority")) for n, o in enumerate(P.TABLE_OFFSETS)])
    probes = tables.select("*", F.inline(offsets)).withColumn("at", F.col("idx") + F.col("offset"))
    captioned = stream.where("kind = 'paragraph'").withColumn("c", T.caption(T.stripped(F.col("text")))).where(F.col("c").isNotNull() & F.startswith("c.kind", F.lit("tab")))
    candidates = probes.join(captioned.select("ms_id", F.col("idx").alias("at"), F.col("text").alias("caption")), ["ms_id", "at"])
    id_type, float_type = (stream.schema[c].dataType.simpleString() for c in ("ms_id", "float_id"))

    def take(group: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, mine in group.sort_values(["idx", "priority"]).groupby("idx", sort=True):
            for row in mine.itertuples():
                if row.at not in used:
                    used.add(row.at)
                    out.append((row.ms_id, row.float_id, row.at, row.caption))
                    break
        return pd.DataFrame(out, columns=["ms_id", "float_id", "at", "caption"])

    taken = candidates.groupBy("ms_id").applyInPandas(take, f"ms_id {id_type}, float_id {float_type}, at long, caption string")
    return tables.join(taken, ["ms_id", "float_id"], "left")


def anchors(figures: DataFrame, stream: DataFrame, source: DataFrame, reach: int = 24) -> DataFrame:
    """D-05 to D-07: where each figure stands in the text that was read, and how that was found.

    By its caption's first words; else by the nearest source neighbour, back before forward,
    whose beginning is found; else in proportion to its place.  ``figures``: ms_id, fig_id,
    para_index, caption; ``stream``: ms_id, pos, text; ``source``: ms_id, idx, text.
    Every table here grows with the manuscripts, and Spark's estimates do not see how many
    rows a generator adds: joins are by sorting, so no table is ever broadcast.
    """
    key = lambda c, n: F.left(F.lower(T.normal_space(c)), F.lit(n))
    texts = stream.select("ms_id", "pos", F.lower(T.normal_space(F.col("text"))).alias("t")).where(F.length("t") >= 25)
    begins = texts.groupBy("ms_id", F.left("t", F.lit(60)).alias("k")).agg(F.min("pos").alias("pos"))
    captions = figures.select("ms_id", "fig_id", key(F.col("caption"), 40).alias("k")).where(F.length("k") >= 12)
    by_caption = captions.join(texts.hint("merge"), (captions.ms_id == texts.ms_id) & F.contains(texts.t, captions.k)).groupBy(captions.ms_id, "fig_id").agg(F.min("pos").alias("pos"))
    near = source.select("ms_id", "idx", key(F.col("text"), 60).alias("k")).where(F.length("k") >= 25).join(begins.hint("merge"), ["ms_id", "k"])
    # a figure asks for the three stretches its reach touches, not for each paragraph in it
    stretch = lambda c: F.floor(c / reach)
    probes = figures.select("ms_id", "fig_id", "para_index", F.explode(F.sequence(stretch(F.col("para_index") - reach), stretch(F.col("para_index") + reach))).alias("stretch"))
    near = near.withColumn("stretch", stretch(F.col("idx")))
    back_first = F.struct((F.col("step") > 0).alias("ahead"), F.abs("step").alias("far"))
    within = probes.join(near.hint("merge"), ["ms_id", "stretch"]).withColumn("step", F.col("idx") - F.col("para_index")).where((F.col("step") != 0) & (F.abs("step") <= reach))
    by_neighbour = within.groupBy("ms_id", "fig_id").agg(F.min_by(F.struct("pos", "step"), back_first).alias("n"))
    sizes = source.groupBy("ms_id").agg(F.count("*").alias("n_source")).join(stream.groupBy("ms_id").agg(F.count("*").alias("n_stream")).hint("merge"), "ms_id")
    share = F.least(F.greatest(F.bround(F.col("para_index") / F.greatest("n_source", F.lit(1)) * F.col("n_stream")).cast("long"), F.lit(0)), F.col("n_stream").cast("long"))
    neighbour_pos = F.col("n.pos") + F.when(F.col("n.step") < 0, 1).otherwise(0)
    rows = figures.join(by_caption.hint("merge"), ["ms_id", "fig_id"], "left").join(by_neighbour.hint("merge"), ["ms_id", "fig_id"], "left").join(sizes.hint("merge"), "ms_id", "left")
    method = F.when(F.col("pos").isNotNull(), "caption").when(F.col("n").isNotNull(), "neighbour").otherwise("estimated")
    return rows.select("ms_id", "fig_id", F.coalesce("pos", neighbour_pos, share).alias("pos"), method.alias("method"))


def inserted(stream: DataFrame, placed: DataFrame, consumed: DataFrame) -> DataFrame:
    """D-08: the stream with figure anchors before the rows they go before, and without consumed rows; nothing is broadcast, as in :func:`anchors`."""
    rows = stream.join(consumed.hint("merge"), ["ms_id", "pos"], "left_anti").select("ms_id", "pos", F.lit(1).alias("after"), F.lit(None).cast("string").alias("fig_id"), "text")
    heads = placed.select("ms_id", "pos", F.lit(0).alias("after"), "fig_id", F.lit(None).cast("string").alias("text"))
    every = rows.unionByName(heads)
    return every.withColumn("new_pos", F.row_number().over(Window.partitionBy("ms_id").orderBy("pos", "after", "fig_id")) - 1)


def equation_layouts(cells: DataFrame) -> DataFrame:
    """H-10, H-11, H-54: tables that only lay out numbered equations, with the formula and number of each row.

    Every row has exactly one cell that is a formula alone, at most one with a number, and
    nothing else; the table has 1 to 40 rows and at least one number.
    ``cells``: ms_id, tab_id, row, col, n_math, text, latex, has_non_paragraph.
    """
    text = T.stripped(F.col("text"))
    formula, number, blank = (F.col("n_math") == 1) & (text == ""), (F.col("n_math") == 0) & T.matches(text, P.EQUATION_NUMBER), (F.col("n_math") == 0) & (text == "")
    rows = cells.groupBy("ms_id", "tab_id", "row").agg(
        F.count_if(formula).alias("formulas"), F.count_if(number).alias("numbers"), F.count_if(blank).alias("blanks"), F.count("*").alias("n"), F.max("has_non_paragraph").alias("other"),
        F.max(F.when(formula, F.col("latex"))).alias("latex"), F.max(F.when(number, T.equation_number(text))).alias("number_raw"),
    )
    fits = (F.col("formulas") == 1) & (F.col("numbers") <= 1) & (F.col("formulas") + F.col("numbers") + F.col("blanks") == F.col("n")) & ~F.col("other") & (T.stripped(F.coalesce("latex", F.lit(""))) != "")
    tables = rows.groupBy("ms_id", "tab_id").agg(F.bool_and(fits).alias("fits"), F.sum("numbers").alias("numbers"), F.count("*").alias("rows"))
    chosen = tables.where("fits AND numbers >= 1 AND rows BETWEEN 1 AND 40").select("ms_id", "tab_id")
    return rows.join(chosen, ["ms_id", "tab_id"]).select("ms_id", "tab_id", "row", "latex", F.coalesce("number_raw", F.lit("")).alias("number_raw"))


def empty_tables(cells: DataFrame) -> DataFrame:
    """B-22: tables none of whose cells hold anything."""
    filled = (T.stripped(F.coalesce("text", F.lit(""))) != "") | (F.col("n_math") > 0)
    return cells.groupBy("ms_id", "tab_id").agg(F.count_if(filled).alias("filled")).where("filled = 0").select("ms_id", "tab_id")


def column_widths(cells: DataFrame) -> DataFrame:
    """B-25: width of every column in characters: its longest cell, at least 3; a cell stands where earlier spans end."""
    before = Window.partitionBy("ms_id", "tab_id", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum(F.greatest(F.lit(1), "colspan")).over(before), F.lit(0))
    return cells.withColumn("column", place).groupBy("ms_id", "tab_id", "column").agg(F.greatest(F.lit(3), F.max(F.length("text"))).alias("width"))


def natural_widths(widths: DataFrame) -> DataFrame:
    """H-49: ms_id, tab_id, natural: what a table would like to be wide: its columns and three characters between them."""
    return widths.groupBy("ms_id", "tab_id").agg((F.sum("width") + 3 * (F.count("*") - 1)).alias("natural"))


def asset_action(extension: Column) -> Column:
    """L-20: what must happen to a file before LaTeX takes it."""
    e = F.lower(F.ltrim(extension, F.lit(".")))
    return F.when(e.isin("png", "jpg", "jpeg", "pdf", "eps"), "copy").when(e == "svg", "svg_to_pdf").when(e.isin("tif", "tiff", "bmp", "gif"), "raster_to_png").when(e.isin("emf", "wmf"), "metafile_to_pdf").otherwise("unsupported")


def width_expression(width_mm: Column, single_mm: Column, double_mm: Column, columns: Column) -> Column:
    """H-48: the width a figure is set at."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.25), width_mm / double_mm))
    wide = F.when(width_mm > single_mm * 1.4, r"\textwidth").otherwise(r"\linewidth")
    return F.when(F.coalesce(width_mm, F.lit(0.0)) == 0, r"\linewidth").when(columns >= 2, wide).otherwise(F.concat(F.format_string("%.2f", share), F.lit(r"\linewidth")))


def media_issues(figures: DataFrame) -> DataFrame:
    """2.M: issues of image files, by format and by whether they could be read."""
    fmt = F.lower("fmt")
    rows = [
        (F.coalesce("missing", F.lit(False)), "error", "missing_media"),
        (fmt.isin("emf", "wmf"), "error", "unusable_image_format"),
        (fmt.isin("tif", "tiff", "bmp", "gif"), "warning", "latex_incompatible_image"),
        (~F.col("is_vector") & F.col("width_px").isNull() & ~F.coalesce("missing", F.lit(False)), "warning", "image_unreadable"),
    ]
    made = [F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for c, s, code in rows]
    return figures.select("ms_id", F.col("fig_id").alias("location"), F.explode(F.array(*made)).alias("i")).where("i IS NOT NULL").select("ms_id", "i.*", "location")


def degenerate_issues(equations: DataFrame, most: int = 10) -> DataFrame:
    """H-13: formulas without content: one error a manuscript with their count, and the first ten named."""
    bad = equations.where(T.is_degenerate_math(F.col("latex")))
    whole = bad.groupBy("ms_id").agg(F.count("*").alias("n")).select("ms_id", F.lit("error").alias("severity"), F.lit("degenerate_math").alias("code"), F.col("n").cast("string").alias("location"))
    place = F.row_number().over(Window.partitionBy("ms_id").orderBy("ord"))
    named = bad.withColumn("place", place).where(F.col("place") <= most).select("ms_id", F.lit("warning").alias("severity"), F.lit("degenerate_equation").alias("code"), F.col("eq_id").alias("location"))
    return whole.unionByName(named)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
