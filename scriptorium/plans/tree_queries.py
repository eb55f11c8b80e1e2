"""Queries of sections, ranges, floats and page layout, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import floats, layout, tree
from scriptorium.plans import adapters as X


def _lines_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their places in the order, since line numbers repeat."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return X.table(spark, sf_dir, "lineitem").withColumn("place", place)


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5: a document for each order, a heading for each of its lines."""
    line = _lines_of_orders(spark, sf_dir)
    return line.select(F.col("l_orderkey").alias("ms_id"), F.col("place").alias("ord"), (F.lit(1) + F.col("l_suppkey") % 4).cast("int").alias("level"))


def section_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.parents(_headings(spark, sf_dir)).select("ms_id", "ord", "level", "parent_ord")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat rows of every document: every fifth line a heading."""
    s = X.sections(spark, sf_dir).where("sec_ord % 5 = 0")
    own = X.lines(spark, sf_dir).select("ms_id", (F.floor(F.col("idx") / 5) * 5).cast("int").alias("sec_ord"), F.col("idx").alias("blk_ord"), F.lit("paragraph").alias("kind"), "text")
    return tree.flatten(s, own)


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("ms_id", "idx", "is_heading", "kind", F.length("text").cast("long").alias("characters"))


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.rebuild(_rows(spark, sf_dir).withColumn("level", F.col("level") * 4 - 3), X.ROLES)
    return rows.select("ms_id", "idx", "level", "section_ord", "parent_ord", "role")


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.sections(spark, sf_dir).withColumn("title_raw", F.lit("x"))
    return tree.emitted_depth(s, ["abstract", "keywords", "references"]).select("ms_id", "sec_ord", "depth")


def subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.last_descendant(X.sections(spark, sf_dir)).select("ms_id", "sec_ord", "last_ord")


def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.suggested_ranges(_rows(spark, sf_dir))


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7: ranges of every user's events: from each event's place, as long as its value says."""
    e = X.table(spark, sf_dir, "events")
    start = (F.col("event_id") % 40).cast("long")
    return e.select(F.col("user_id").alias("ms_id"), F.col("event_id").alias("seq"), F.lit("methods").alias("role"), start.alias("start"), (start + F.pmod(F.col("event_id") * 7, F.lit(9)) - 2).alias("end"), F.lit("").alias("title"))


def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.claims(_assignments(spark, sf_dir)).select("ms_id", "seq", "start", "end")


def ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-05 on flat rows, with a range over rows 2 to 4 and one over 8 to 20 of every third document."""
    some = X.texts(spark, sf_dir).where("ms_id % 3 = 0").select("ms_id")
    ranges = some.select("ms_id", F.inline(F.array(*[F.struct(F.lit(n).alias("seq"), F.lit(r).alias("role"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("title")) for n, r, a, b, t in ((1, "methods", 2, 4, ""), (2, "data_availability", 8, 20, "Named"))])))
    rows = _rows(spark, sf_dir)
    last = rows.groupBy("ms_id").agg(F.max("idx").alias("last"))
    ranges = ranges.join(last, "ms_id").where("start <= last").drop("last")
    return tree.apply_ranges(rows, ranges).select("ms_id", "idx", "section", "role", "dropped")


def equation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _lines_of_orders(spark, sf_dir)
    rows = line.select(F.col("l_orderkey").alias("ms_id"), F.col("place").alias("ord"), F.when(F.col("l_suppkey") % 3 == 0, F.lit("")).otherwise((F.col("place") + F.col("l_suppkey") % 2).cast("string")).alias("number_raw"))
    return tree.number_mismatches(rows).select("ms_id", "ord", "number")


def breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.lines(spark, sf_dir).withColumn("is_break", F.length("text") % 3 == 0)
    return tree.closing_breaks(rows).select("ms_id", "idx", "part")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.lines(spark, sf_dir).withColumn("is_marked", (F.col("idx") + F.col("ms_id")) % 2 == 0)
    return tree.continued(rows).select("ms_id", F.col("entry").cast("long").alias("entry"), F.length("text").cast("long").alias("characters"))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("source", F.lit("heuristic")).withColumn("confidence", F.lit(0.5))
    edits = rows.where("idx % 3 = 0").select("ms_id", "idx", (F.col("idx") % 2 == 0).alias("heading"), F.lit(2).alias("level"), F.lit("methods").alias("role"))
    done = tree.apply_edits(rows, edits)
    return done.groupBy("ms_id").agg(F.count_if(F.col("source") == "explicit").alias("explicit"), F.count_if("is_heading").alias("headings"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-03: figures at every tenth line; every seventh line begins as a caption of a figure, every eleventh of a table."""
    rows = _captioned(spark, sf_dir)
    figures = rows.where("idx % 10 = 5").select("ms_id", F.col("idx").alias("float_id"), "idx")
    return floats.nearest_captions(figures, rows).select("ms_id", "float_id", "number", "offset")


def _captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("idx").cast("string")
    start = F.when(F.col("idx") % 7 == 0, F.concat(F.lit("Figure "), number, F.lit(": "))).when(F.col("idx") % 11 == 0, F.concat(F.lit("Tab. "), number, F.lit(" "))).otherwise("")
    return X.lines(spark, sf_dir).select("ms_id", "idx", F.concat(start, F.lit("ordinary words")).alias("text"))


def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _captioned(spark, sf_dir)
    stream = rows.select("ms_id", "idx", F.when(F.col("idx") % 3 == 1, "table").otherwise("paragraph").alias("kind"), F.col("idx").alias("float_id"), F.when(F.col("idx") % 3 == 1, "").otherwise(F.concat(F.lit("Table 1. "), F.col("text"))).alias("text"))
    return floats.consumed_captions(stream).select("ms_id", "float_id", "at")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _lines_of_orders(spark, sf_dir)
    return line.select(F.col("l_orderkey").alias("ms_id"), F.col("place").alias("img_ord"), (F.col("l_suppkey") % 5).cast("int").alias("para_index"), F.concat(F.lit("i"), F.col("place").cast("string")).alias("filename"), F.when(F.col("l_returnflag") == "R", "v.svg").otherwise("").alias("svg_filename"), (F.col("l_quantity") * 100_000).cast("long").alias("width_emu"), F.lit(0).cast("long").alias("height_emu"), F.lit(False).alias("anchored"))


def grouped_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floats.figures_of(_images(spark, sf_dir)).select("ms_id", "fig_id", F.array_join("files", "|").alias("files"), "placed_width_mm")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order: a row a line, a formula, a number and a spacer, which some lines break."""
    line = _lines_of_orders(spark, sf_dir)
    bad = F.col("l_suppkey") % 29 == 0
    cell = lambda col, math, text: F.struct(F.lit(col).alias("col"), math.cast("int").alias("n_math"), text.alias("text"))
    number = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("("), F.col("place").cast("string"), F.lit(")"))).otherwise("")
    rows = line.select(F.col("l_orderkey").alias("ms_id"), F.lit("t").alias("tab_id"), F.col("place").alias("row"), F.inline(F.array(cell(0, F.lit(0), F.lit("")), cell(1, F.lit(1), F.when(bad, "with words").otherwise("")), cell(2, F.lit(0), number))))
    return rows.withColumn("latex", F.when(F.col("n_math") == 1, "a=b")).withColumn("has_non_paragraph", F.lit(False)).withColumn("colspan", F.lit(1) + F.col("col") % 2)


def equation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floats.equation_layouts(_cells(spark, sf_dir)).select("ms_id", "row", "latex", "number_raw")


def widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floats.natural_widths(floats.column_widths(_cells(spark, sf_dir))).select("ms_id", F.col("natural").cast("long").alias("natural"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.figures(spark, sf_dir)
    return f.select("fig_id", floats.asset_action(F.col("fmt")).alias("action"), floats.width_expression(F.col("placed_width_mm"), F.lit(90.0), F.lit(190.0), F.lit(1)).alias("one"), floats.width_expression(F.col("placed_width_mm"), F.lit(90.0), F.lit(190.0), F.lit(2)).alias("two"))


def media_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floats.media_issues(X.figures(spark, sf_dir).withColumn("missing", F.col("ms_id") % 13 == 0))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("idx") % 6 == 0, "").when(F.col("idx") % 9 == 2, F.concat(F.lit("ISSN "), "text")).otherwise(F.col("text"))
    return X.lines(spark, sf_dir).select("ms_id", "idx", text.alias("text"), (F.col("idx") % 4 == 1).alias("has_drawing"), ((F.col("ms_id") + F.col("idx")) % 80).cast("double").alias("width_mm"))


def removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = X.lines(spark, sf_dir).where("idx = 3").select("ms_id", F.upper("text").alias("title"))
    return layout.removals(_paragraphs(spark, sf_dir), titles)


def column_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = X.table(spark, sf_dir, "lineitem")
    sections = line.select(F.col("l_orderkey").alias("ms_id"), F.col("l_linenumber").alias("part"), (F.lit(1) + F.when(F.col("l_orderkey") % 2 == 0, F.col("l_suppkey") % 3).otherwise(0)).cast("int").alias("columns"))
    wanted = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ms_id"), (F.lit(1) + F.col("o_orderkey") % 3 % 2).cast("int").alias("want"), (F.col("o_orderkey") % 5 > 1).alias("has_body"))
    return layout.columns_plan(sections, wanted)


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-13 on names: nations as the target's styles, regions and some nations as the template's."""
    target = X.table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("style_id"), F.col("n_name").alias("name"), F.lit("target").alias("props"))
    regions = X.table(spark, sf_dir, "region").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("style_id"), F.col("r_name").alias("name"), F.lit("template").alias("props"))
    some = X.table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("style_id"), F.lower("n_name").alias("name"), F.lit("template").alias("props"))
    return layout.merged_styles(target, regions.unionByName(some)).select("style_id", "name", "props", "origin")


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name_ord"), F.col("n_name").alias("name"))
    wanted = X.table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.inline(F.array(F.struct(F.lit(0).alias("hint_ord"), F.left("r_name", F.lit(3)).alias("hint")), F.struct(F.lit(1).alias("hint_ord"), F.left("r_name", F.lit(1)).alias("hint")))))
    return layout.found_styles(wanted, names)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _captioned(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" "), (F.col("idx") % 5).cast("string")))
    heads = rows.where("idx % 8 = 3").select("ms_id", F.col("idx").alias("sec_ord"), (F.col("idx") % 3 + 1).alias("level"), F.upper("text").alias("title_raw"))
    done = layout.paragraph_classes(rows, heads)
    return done.groupBy("ms_id", "class").agg(F.count("*").alias("n"))


QUERIES = {
    "b_10_parents": section_parents, "b_12_flatten": flattened, "b_13_rebuild": rebuilt, "b_24_depths": depths, "b_18_subtrees": subtrees, "f_03_suggested": suggested, "f_04_claims": claimed,
    "f_05_ranges": ranged, "f_02_equation_numbers": equation_numbers, "f_18_breaks": breaks, "f_20_entries": entries, "b_16_edits": edited, "d_03_captions": captions, "d_04_table_captions": table_captions,
    "d_02_figures": grouped_figures, "h_10_equation_tables": equation_tables, "b_25_widths": widths, "l_20_assets": assets, "m_media_issues": media_issues, "l_04_removals": removals,
    "l_08_columns": column_plan, "d_13_styles": styles, "d_14_hints": hints, "l_11_classes": classes,
}

_PLACED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place FROM lineitem)"
_H = f"h AS (SELECT l_orderkey AS ms_id, place AS ord, (1 + l_suppkey % 4)::INT AS level FROM {_PLACED})"
_ROWS = X.CORPUS + """, every AS (
  SELECT ms_id, idx AS sec_ord, -1 AS blk_ord, true AS is_heading, CASE WHEN idx = 0 THEN 1 ELSE 1 + idx % 3 END AS level, s.role, 'heading' AS kind, s.title_raw AS text FROM lines JOIN sections s USING (ms_id) WHERE s.sec_ord = idx AND idx % 5 = 0
  UNION ALL SELECT ms_id, idx // 5 * 5, idx, false, 0, NULL, 'paragraph', text FROM lines),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY ms_id ORDER BY sec_ord, is_heading DESC, blk_ord) - 1 AS idx FROM every)
"""
_CAP = X.CORPUS + ", cap AS (SELECT ms_id, idx, CASE WHEN idx % 7 = 0 THEN 'fig' WHEN idx % 11 = 0 THEN 'tab' ELSE '' END AS kind FROM lines)"
_CELLS = f"WITH c AS (SELECT l_orderkey AS ms_id, place AS row, l_suppkey % 29 = 0 AS bad, l_partkey % 2 = 0 AS num FROM {_PLACED}) "
ORACLES = {
    "b_10_parents": f"WITH {_H} SELECT ms_id, ord, level, (SELECT max(p.ord) FROM h p WHERE p.ms_id = h.ms_id AND p.ord < h.ord AND p.level < h.level) AS parent_ord FROM h",
    "b_12_flatten": _ROWS + "SELECT ms_id, idx, is_heading, kind, length(text) AS characters FROM rows_",
    "b_13_rebuild": _ROWS + """, c AS (SELECT ms_id, idx, is_heading, CASE WHEN is_heading THEN least(greatest(level * 4 - 3, 1), 6) ELSE 0 END AS level, role FROM rows_)
      SELECT ms_id, idx, level, coalesce((SELECT max(p.idx) FROM c p WHERE p.ms_id = c.ms_id AND p.idx <= c.idx AND p.is_heading), -1) AS section_ord,
        CASE WHEN is_heading THEN (SELECT max(p.idx) FROM c p WHERE p.ms_id = c.ms_id AND p.idx < c.idx AND p.is_heading AND p.level < c.level) END AS parent_ord,
        CASE WHEN is_heading THEN CASE WHEN list_contains(""" + X._sql(X.ROLES) + """, role) THEN role ELSE 'unknown' END END AS role FROM c""",
    "b_24_depths": X.CORPUS + """, RECURSIVE_ AS (SELECT 1), a AS (
        SELECT s.ms_id, s.sec_ord, p.sec_ord AS anc, p.role FROM sections s JOIN sections p ON p.ms_id = s.ms_id AND p.sec_ord < s.sec_ord AND p.level < s.level
        WHERE NOT EXISTS (SELECT 1 FROM sections q WHERE q.ms_id = s.ms_id AND q.sec_ord > p.sec_ord AND q.sec_ord < s.sec_ord AND q.level <= p.level))
      SELECT s.ms_id, s.sec_ord, (SELECT count(*) FROM a WHERE a.ms_id = s.ms_id AND a.sec_ord = s.sec_ord AND a.role NOT IN ('abstract', 'keywords', 'references')) AS depth FROM sections s""",
    "b_18_subtrees": X.CORPUS + """SELECT ms_id, sec_ord, coalesce((SELECT min(n.sec_ord) - 1 FROM sections n WHERE n.ms_id = s.ms_id AND n.sec_ord > s.sec_ord AND n.level <= s.level), (SELECT max(n.sec_ord) FROM sections n WHERE n.ms_id = s.ms_id)) AS last_ord FROM sections s""",
    "f_03_suggested": _ROWS + """, f AS (SELECT ms_id, role, min(idx) AS h FROM rows_ WHERE is_heading AND role IS NOT NULL GROUP BY ALL),
      g AS (SELECT ms_id, role, h + 1 AS first, coalesce((SELECT min(r.idx) - 1 FROM rows_ r WHERE r.ms_id = f.ms_id AND r.is_heading AND r.idx > f.h), (SELECT max(r.idx) FROM rows_ r WHERE r.ms_id = f.ms_id)) AS last FROM f) SELECT * FROM g WHERE last >= first""",
    "f_04_claims": """WITH RECURSIVE a AS (SELECT user_id AS ms_id, event_id AS seq, event_id % 40 AS s, event_id % 40 + (event_id * 7) % 9 - 2 AS e FROM events),
      o AS (SELECT *, row_number() OVER (PARTITION BY ms_id ORDER BY s, seq) AS n FROM a WHERE e >= s),
      walk AS (SELECT ms_id, seq, n, s AS start, e, e AS last_end, true AS kept FROM o WHERE n = 1
        UNION ALL SELECT o.ms_id, o.seq, o.n, greatest(o.s, w.last_end + 1), o.e, CASE WHEN greatest(o.s, w.last_end + 1) <= o.e THEN o.e ELSE w.last_end END, greatest(o.s, w.last_end + 1) <= o.e FROM walk w JOIN o ON o.ms_id = w.ms_id AND o.n = w.n + 1)
      SELECT ms_id, seq, start, e AS "end" FROM walk WHERE kept""",
    "f_05_ranges": _ROWS + """, last_ AS (SELECT ms_id, max(idx) AS last FROM rows_ GROUP BY ms_id),
      rg AS (SELECT ms_id, a, b, role FROM last_ CROSS JOIN (VALUES (2, 4, 'methods'), (8, 20, 'data_availability')) v(a, b, role) WHERE ms_id % 3 = 0 AND a <= last),
      k AS (SELECT r.ms_id, r.idx, r.is_heading, r.role, (SELECT max(g.role) FROM rg g WHERE g.ms_id = r.ms_id AND g.a = r.idx) AS opens,
              EXISTS (SELECT 1 FROM rg g WHERE g.ms_id = r.ms_id AND r.idx BETWEEN g.a AND g.b) AS covered, EXISTS (SELECT 1 FROM rg g WHERE g.ms_id = r.ms_id AND g.a = r.idx + 1) AND r.is_heading AS takes FROM rows_ r),
      s AS (SELECT *, opens IS NOT NULL OR (is_heading AND NOT covered AND NOT takes) AS starts FROM k)
      SELECT ms_id, idx, coalesce((SELECT max(p.idx) FROM s p WHERE p.ms_id = s.ms_id AND p.idx <= s.idx AND p.starts), -1) AS section,
        coalesce((SELECT arg_max(coalesce(p.opens, p.role), p.idx) FROM s p WHERE p.ms_id = s.ms_id AND p.idx <= s.idx AND p.starts), 'unknown') AS role, is_heading AND NOT starts AND (takes OR covered) AS dropped FROM s""",
    "f_02_equation_numbers": f"""WITH r AS (SELECT l_orderkey AS ms_id, place AS ord, place AS number, CASE WHEN l_suppkey % 3 <> 0 THEN place + l_suppkey % 2 END AS raw FROM {_PLACED})
      SELECT ms_id, ord, number FROM r WHERE raw <> number""",
    "f_18_breaks": X.CORPUS + "SELECT ms_id, idx, (SELECT count(*) FROM lines b WHERE b.ms_id = l.ms_id AND b.idx < l.idx AND length(b.text) % 3 = 0) AS part FROM lines l",
    "f_20_entries": X.CORPUS + """, m AS (SELECT *, (idx + ms_id) % 2 = 0 AS marked FROM lines), e AS (SELECT *, CASE WHEN sum(marked::INT) OVER (PARTITION BY ms_id) >= greatest(2, count(*) OVER (PARTITION BY ms_id) // 2) THEN sum(marked::INT) OVER (PARTITION BY ms_id ORDER BY idx) ELSE row_number() OVER (PARTITION BY ms_id ORDER BY idx) END AS entry FROM m)
      SELECT ms_id, entry::BIGINT AS entry, (sum(length(text)) + count(*) - 1)::BIGINT AS characters FROM e GROUP BY ms_id, entry""",
    "b_16_edits": _ROWS + """SELECT ms_id, count(*) FILTER (WHERE idx % 3 = 0 AND ((idx % 2 = 0) <> is_heading OR (idx % 2 = 0 AND (level <> 2 OR coalesce(role, 'unknown') <> 'methods')))) AS explicit, count(*) FILTER (WHERE CASE WHEN idx % 3 = 0 THEN idx % 2 = 0 ELSE is_heading END) AS headings FROM rows_ GROUP BY ms_id""",
    "d_03_captions": _CAP + """, f AS (SELECT ms_id, idx FROM lines WHERE idx % 10 = 5), p AS (SELECT f.ms_id, f.idx AS float_id, c.idx AS pos, o.off, o.pri FROM f CROSS JOIN (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (-1, 4), (-2, 5), (-3, 6)) o(off, pri) JOIN cap c ON c.ms_id = f.ms_id AND c.idx = f.idx + o.off AND c.kind = 'fig')
      SELECT f.ms_id, f.idx AS float_id, (SELECT arg_min(pos, pri) FROM p WHERE p.ms_id = f.ms_id AND p.float_id = f.idx)::VARCHAR AS number, (SELECT arg_min(off, pri) FROM p WHERE p.ms_id = f.ms_id AND p.float_id = f.idx) AS "offset" FROM f""",
    "d_02_figures": f"""WITH g AS (SELECT l_orderkey AS ms_id, l_suppkey % 5 AS para, string_agg(CASE WHEN l_returnflag = 'R' THEN 'v.svg' ELSE 'i' || place END, '|' ORDER BY place) AS files, max((l_quantity * 100000)::BIGINT) AS w FROM {_PLACED} GROUP BY ALL)
      SELECT ms_id, 'fig' || row_number() OVER (PARTITION BY ms_id ORDER BY para) AS fig_id, files, round_even(w / (914400.0::DOUBLE / 25.4), 1) AS placed_width_mm FROM g""",
    "h_10_equation_tables": _CELLS + "SELECT ms_id, row, 'a=b' AS latex, CASE WHEN num THEN row::VARCHAR ELSE '' END AS number_raw FROM c WHERE ms_id IN (SELECT ms_id FROM c GROUP BY ms_id HAVING NOT bool_or(bad) AND bool_or(num) AND count(*) <= 40)",
    "b_25_widths": _CELLS + "SELECT ms_id, (3 + CASE WHEN bool_or(bad) THEN 10 ELSE 3 END + greatest(3, max(CASE WHEN num THEN length(row::VARCHAR) + 2 ELSE 0 END)) + 6)::BIGINT AS natural FROM c GROUP BY ms_id",
    "l_20_assets": X.CORPUS + r""", f AS (SELECT 'fig' || p_partkey AS fig_id, (""" + X._sql(X.FORMATS) + r""")[p_size % 5 + 1] AS fmt, CASE WHEN p_size % 3 <> 0 THEN p_size * 3.0::DOUBLE END AS w FROM part)
      SELECT fig_id, CASE WHEN fmt IN ('png', 'jpg', 'pdf') THEN 'copy' WHEN fmt = 'tif' THEN 'raster_to_png' ELSE 'metafile_to_pdf' END AS action, CASE WHEN w IS NULL THEN '\linewidth' ELSE printf('%.2f', least(1.0, greatest(0.25, w / 190.0))::DOUBLE) || '\linewidth' END AS one,
        CASE WHEN w > 126.0 THEN '\textwidth' ELSE '\linewidth' END AS two FROM f""",
    "m_media_issues": """WITH f AS (SELECT p_partkey // 3 AS ms_id, 'fig' || p_partkey AS location, p_size % 5 AS k, p_size % 7 = 0 AS blank, (p_partkey // 3) % 13 = 0 AS missing FROM part)
      SELECT ms_id, 'error' AS severity, 'missing_media' AS code, location FROM f WHERE missing UNION ALL SELECT ms_id, 'error', 'unusable_image_format', location FROM f WHERE k = 2
      UNION ALL SELECT ms_id, 'warning', 'latex_incompatible_image', location FROM f WHERE k = 3 UNION ALL SELECT ms_id, 'warning', 'image_unreadable', location FROM f WHERE k <> 4 AND blank AND NOT missing""",
    "l_04_removals": X.CORPUS + """, p AS (SELECT ms_id, idx, CASE WHEN idx % 6 = 0 THEN '' WHEN idx % 9 = 2 THEN 'ISSN ' || text ELSE text END AS text, text AS raw, idx % 4 = 1 AS drawing, (ms_id + idx) % 80 AS w FROM lines),
      t AS (SELECT ms_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS title FROM lines WHERE idx = 3), e AS (SELECT p.ms_id, coalesce(min(idx) FILTER (WHERE title <> '' AND lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) = title), least(12, count(*))) AS e FROM p LEFT JOIN t USING (ms_id) GROUP BY p.ms_id),
      r AS (SELECT p.*, CASE WHEN drawing AND idx < e AND w > 0 AND w <= 40 THEN 'logo' WHEN idx % 9 = 2 AND idx % 6 <> 0 THEN 'ISSN line' END AS reason FROM p JOIN e USING (ms_id)),
      k AS (SELECT *, min(idx) FILTER (WHERE reason IS NULL AND (trim(text) <> '' OR drawing)) OVER (PARTITION BY ms_id) AS first_kept FROM r)
      SELECT ms_id, idx, coalesce(reason, 'leading blank') AS reason FROM k WHERE reason IS NOT NULL OR idx < first_kept""",
    "l_08_columns": """WITH s AS (SELECT l_orderkey AS ms_id, l_linenumber AS part, (1 + CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey % 3 ELSE 0 END)::INT AS columns, (1 + l_orderkey % 3 % 2)::INT AS want, l_orderkey % 5 > 1 AS body FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
      v AS (SELECT *, min(columns) OVER w <> max(columns) OVER w AS varies FROM s WINDOW w AS (PARTITION BY ms_id)), a AS (SELECT *, CASE WHEN want = 1 THEN CASE WHEN columns > 1 THEN 'collapse' ELSE 'keep' END WHEN varies THEN CASE WHEN columns > 1 AND columns <> want THEN 'normalise' ELSE 'keep' END WHEN body THEN 'split' ELSE 'set' END AS action FROM v)
      SELECT ms_id, part, columns, CASE WHEN action = 'keep' THEN columns ELSE want END AS new_columns, action FROM a""",
    "d_13_styles": """WITH t AS (SELECT 's' || n_nationkey AS id, n_name AS name FROM nation), s AS (SELECT 's' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 't' || n_nationkey, lower(n_name) FROM nation WHERE n_nationkey % 4 = 0)
      SELECT coalesce(t.id, CASE WHEN s.id IN (SELECT id FROM t) THEN s.id || 'X' ELSE s.id END) AS style_id, coalesce(s.name, t.name) AS name, CASE WHEN s.id IS NULL THEN 'target' ELSE 'template' END AS props, CASE WHEN t.id IS NULL THEN 'template' WHEN s.id IS NULL THEN 'target' ELSE 'both' END AS origin
      FROM t FULL JOIN s ON lower(trim(t.name)) = lower(trim(s.name))""",
    "d_14_hints": """WITH h AS (SELECT r_name AS key, 0 AS o, substr(r_name, 1, 3) AS hint FROM region UNION ALL SELECT r_name, 1, substr(r_name, 1, 1) FROM region)
      SELECT key, name FROM (SELECT key, n_name AS name, row_number() OVER (PARTITION BY key ORDER BY lower(n_name) = lower(hint) DESC, o, n_nationkey) AS place FROM h JOIN nation ON contains(lower(n_name), lower(hint))) WHERE place = 1""",
    "l_11_classes": _CAP + """, t AS (SELECT ms_id, idx, kind, kind || CASE WHEN kind <> '' THEN idx::VARCHAR ELSE '' END || (idx % 5) AS k FROM cap), h AS (SELECT DISTINCT ms_id, k FROM t WHERE idx % 8 = 3)
      SELECT t.ms_id, CASE WHEN h.k IS NOT NULL THEN 'heading' WHEN kind <> '' THEN 'caption' ELSE 'body' END AS class, count(*) AS n FROM t LEFT JOIN h ON h.ms_id = t.ms_id AND h.k = t.k GROUP BY ALL""",
}
ORACLES["b_24_depths"] = ORACLES["b_24_depths"].replace("RECURSIVE_ AS (SELECT 1), ", "")
