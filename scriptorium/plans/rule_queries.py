"""Queries of the rules, the readiness checks and the audit, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import audit, compliance, review
from scriptorium.plans import adapters as X

AS_OF_YEAR = 2000


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.findings(X.corpus(spark, sf_dir), X.profiles(spark))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("ms_id", "profile_id", "rule", "severity", "observed", F.array_join("locations", ",").alias("locations"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.scores(_findings(spark, sf_dir)).withColumn("score", F.round("score", 9))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.matrix(_findings(spark, sf_dir)).withColumnsRenamed({s: f"n_{s}" for s in ("pass", "warn", "fail", "info")})


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, profiles = X.corpus(spark, sf_dir), X.profiles(spark)
    facts = review.review_facts(corpus, AS_OF_YEAR)
    return review.checks(facts, review.float_facts(corpus["figures"], corpus["tables"], profiles, corpus["manuscripts"]), profiles)


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).select("ms_id", "profile_id", "category", "key", F.round("score", 9).alias("score"), "weight", "severity")


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = review.desk_risk(_checks(spark, sf_dir))
    return risk.select("ms_id", "profile_id", F.round("readiness", 9).alias("readiness"), "band", F.array_join("reasons", ",").alias("reasons"))


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.priorities(_checks(spark, sf_dir)).select("ms_id", "profile_id", "place", "key", "severity")


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.category_scores(_checks(spark, sf_dir)).withColumn("category_score", F.round("category_score", 9))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-01 on X8: orders expect as many lines as their key says, modulo 7; lines are what was kept."""
    orders = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ms_id"), (F.col("o_orderkey") % 7).alias("n"))
    lines = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ms_id")).agg(F.count("*").alias("n"))
    return audit.retention(orders, lines, ["ms_id"])


def accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.accounted(X.tables(spark, sf_dir), X.issues(spark, sf_dir))


def shown_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.shown_issues(X.issues(spark, sf_dir))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ms_id"), F.col("c_name").alias("filename"))
    return audit.unreferenced(customers, X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ms_id")), "ms_id")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", F.when(F.col("l_linestatus") == "F", F.lit("broken")).otherwise(F.col("l_partkey").cast("string")).alias("cell"))
    return audit.totals(rows, "l_returnflag", ["l_linenumber", "cell"])


def mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.mode(X.table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity")


def lost_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-09: of every document's lines, those that its text without its third lines lacks."""
    rows = X.lines(spark, sf_dir)
    kept = rows.where("idx % 3 <> 2").groupBy("ms_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda r: r["text"]), "\n").alias("text"))
    return audit.lost_text(rows, kept).select("ms_id", "idx")


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-10 on orders: every seventh line of an order goes to the last multiple of three before it."""
    rows = X.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ms_id"), F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("n"))
    starts = rows.where("n = 1 AND idx % 3 = 0").select("ms_id", "idx").distinct().withColumn("sec_id", F.col("idx"))
    lost = rows.where("idx % 7 = 1").select("ms_id", "idx").distinct().withColumn("text", F.lit("x"))
    return audit.recovered(lost, starts).select("ms_id", "idx", "sec_id")


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.lines(spark, sf_dir)
    return audit.fault_tally(audit.with_faults(rows), rows)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = X.corpus(spark, sf_dir)
    return audit.coverage(compliance.text_facts(corpus["manuscripts"], corpus["sections"], corpus["blocks"]))


def profile_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = compliance.profiles(spark, [dict(profile_id="beta", journal="Beta, own copy", abstract_max_words=99), dict(profile_id="delta", journal="Delta")])
    return compliance.override(X.profiles(spark), mine).select("profile_id", "journal", "abstract_max_words")


def desk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-10: the weakest check of every category."""
    weak = review.weakest(_checks(spark, sf_dir)).where("place = 1")
    return weak.groupBy("category", "key").agg(F.count("*").alias("manuscripts"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-01 to G-05, G-07 on section roles: sizes of unions, intersections, differences, and whether roles are uniform."""
    own = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("sec_ord", "role"))), lambda r: r["role"]))
    wanted = F.array(*[F.lit(r) for r in ("abstract", "introduction", "methods", "ethics")])
    return X.sections(spark, sf_dir).groupBy("ms_id").agg(own.alias("own")).select(
        "ms_id", F.size(F.array_union("own", wanted)).cast("long").alias("in_either"), F.size(F.array_intersect("own", wanted)).cast("long").alias("in_both"),
        F.size(F.array_except(wanted, "own")).cast("long").alias("missing"), F.array_join("own", ",").alias("in_order"), (F.size("own") <= 1).alias("uniform"),
    )


def _rule(severity: str, rule: str, observed: str, where: str, locations: str = "''") -> str:
    return f"SELECT ms_id, profile_id, '{rule}' AS rule, {severity} AS severity, ({observed})::DOUBLE AS observed, {locations} AS locations FROM both_ WHERE {where}"


def _verdict(ok: str, hard: bool = True) -> str:
    return f"CASE WHEN {ok} THEN 'pass' {'WHEN verified THEN ' + chr(39) + 'fail' + chr(39) if hard else ''} ELSE 'warn' END"


_MISSING = "list_filter(required_sections, lambda r: NOT list_contains(present, r))"
_FORBIDDEN = "list_filter(forbidden_sections, lambda r: list_contains(present, r))"
_RANKS = "list_transform(list_filter(coalesce(top_roles, []), lambda r: list_contains(section_order, r)), lambda r: list_position(section_order, r))"
_SOME = "abstract_words > 0"
FINDINGS = X.CORPUS + ", figure_facts AS (" + """
  SELECT m.ms_id, q.profile_id, q.verified, count(f.fig_id) AS figures,
         list(f.fig_id ORDER BY f.fig_id) FILTER (WHERE list_contains(list_transform(q.rejected_formats, lambda x: lower(x)), f.fmt)) AS rejected,
         list(f.fig_id ORDER BY f.fig_id) FILTER (WHERE NOT f.is_vector AND coalesce(f.width_px, 0) <> 0 AND
           CASE WHEN coalesce(f.placed_width_mm, 0) <> 0 THEN f.width_px / (f.placed_width_mm / 25.4) < q.dpi_halftone
                ELSE f.width_px < coalesce(q.min_px_single_column, round_even(q.single_column_mm / 25.4 * q.dpi_halftone, 0)::INT) END) AS low,
         list(f.fig_id ORDER BY f.fig_id) FILTER (WHERE NOT f.is_vector AND coalesce(f.width_px, 0) = 0) AS unmeasured,
         list(f.fig_id ORDER BY f.fig_id) FILTER (WHERE f.caption_raw = '') AS uncaptioned,
         (SELECT list(t.tab_id ORDER BY t.tab_id) FROM tables_ t WHERE t.ms_id = m.ms_id AND t.caption_raw = '') AS bare
  FROM manuscripts m CROSS JOIN profiles q LEFT JOIN figures f ON f.ms_id = m.ms_id GROUP BY ALL),
reference_facts AS (
  SELECT m.ms_id, q.profile_id, q.verified, q.doi_required, q.max_references, count(r.ref_id) AS n,
         list(r.ref_id ORDER BY r.ord) FILTER (WHERE r.doi = '') AS no_doi, list(r.ref_id ORDER BY r.ord) FILTER (WHERE r.confidence < 0.6) AS low,
         EXISTS (SELECT 1 FROM issues i WHERE i.ms_id = m.ms_id AND i.code = 'manual_citations') AS manual
  FROM manuscripts m CROSS JOIN profiles q LEFT JOIN refs r ON r.ms_id = m.ms_id GROUP BY ALL),
found AS (
""" + " UNION ALL ".join([
    _rule("'fail'", "abstract.present", "0", "abstract_words = 0"),
    _rule(_verdict("abstract_words <= abstract_max_words"), "abstract.max_words", "abstract_words", f"{_SOME} AND coalesce(abstract_max_words, 0) <> 0"),
    _rule(_verdict("abstract_words >= abstract_min_words", False), "abstract.min_words", "abstract_words", f"{_SOME} AND coalesce(abstract_min_words, 0) <> 0"),
    _rule(_verdict("1 <= abstract_paragraphs_max"), "abstract.paragraphs", "1", f"{_SOME} AND coalesce(abstract_paragraphs_max, 0) <> 0"),
    _rule(_verdict("len(keywords) BETWEEN coalesce(keywords_min, 0) AND coalesce(nullif(keywords_max, 0), 99)"), "keywords.count", "len(keywords)", "coalesce(keywords_min, 0) <> 0 OR coalesce(keywords_max, 0) <> 0"),
    _rule("CASE WHEN verified THEN 'fail' ELSE 'warn' END", "highlights.present", "0", "highlights_required"),
    _rule(_verdict("length(title) <= title_max_chars"), "title.length", "length(title)", "coalesce(title_max_chars, 0) <> 0 AND title <> ''"),
    _rule(f"CASE WHEN len({_MISSING}) > 0 AND unlabelled > 0 THEN 'warn' ELSE {_verdict(f'len({_MISSING}) = 0')} END", "structure.required_sections", f"len({_MISSING})", "true", f"array_to_string(list_sort({_MISSING}), ',')"),
    _rule("'warn'", "structure.forbidden_sections", f"len({_FORBIDDEN})", f"len({_FORBIDDEN}) > 0", f"array_to_string(list_sort({_FORBIDDEN}), ',')"),
    _rule(_verdict(f"{_RANKS} = list_sort({_RANKS})", False), "structure.section_order", f"len({_RANKS})", "len(section_order) > 0"),
    _rule(_verdict("words <= manuscript_max_words"), "structure.length", "words", "coalesce(manuscript_max_words, 0) <> 0"),
]) + """
  UNION ALL SELECT ms_id, profile_id, 'figures.present', 'info', 0, '' FROM figure_facts WHERE figures = 0
  UNION ALL SELECT ms_id, profile_id, 'figures.format', CASE WHEN rejected IS NULL THEN 'pass' WHEN verified THEN 'fail' ELSE 'warn' END, coalesce(len(rejected), 0), coalesce(array_to_string(rejected, ','), '') FROM figure_facts WHERE figures > 0
  UNION ALL SELECT ms_id, profile_id, 'figures.resolution', CASE WHEN low IS NULL THEN 'pass' WHEN verified THEN 'fail' ELSE 'warn' END, coalesce(len(low), 0), coalesce(array_to_string(low, ','), '') FROM figure_facts WHERE figures > 0
  UNION ALL SELECT ms_id, profile_id, 'figures.resolution_unknown', 'info', len(unmeasured), array_to_string(unmeasured, ',') FROM figure_facts WHERE figures > 0 AND unmeasured IS NOT NULL
  UNION ALL SELECT ms_id, profile_id, 'figures.caption', CASE WHEN uncaptioned IS NULL THEN 'pass' ELSE 'warn' END, coalesce(len(uncaptioned), 0), coalesce(array_to_string(uncaptioned, ','), '') FROM figure_facts WHERE figures > 0
  UNION ALL SELECT ms_id, profile_id, 'tables.caption', 'warn', len(bare), array_to_string(bare, ',') FROM figure_facts WHERE figures > 0 AND bare IS NOT NULL
  UNION ALL SELECT ms_id, profile_id, 'references.present', 'fail', 0, '' FROM reference_facts WHERE n = 0
  UNION ALL SELECT ms_id, profile_id, 'references.doi', CASE WHEN no_doi IS NULL THEN 'pass' ELSE 'warn' END, coalesce(len(no_doi), 0), coalesce(array_to_string(no_doi, ','), '') FROM reference_facts WHERE n > 0 AND doi_required
  UNION ALL SELECT ms_id, profile_id, 'references.count', CASE WHEN n <= max_references THEN 'pass' WHEN verified THEN 'fail' ELSE 'warn' END, n, '' FROM reference_facts WHERE n > 0 AND coalesce(max_references, 0) <> 0
  UNION ALL SELECT ms_id, profile_id, 'references.parse_quality', 'warn', len(low), array_to_string(low, ',') FROM reference_facts WHERE n > 0 AND low IS NOT NULL
  UNION ALL SELECT ms_id, profile_id, 'references.field_codes', 'warn', 1, '' FROM reference_facts WHERE n > 0 AND manual
  UNION ALL SELECT i.ms_id, q.profile_id, 'parse.' || i.code, 'warn', 1, '' FROM issues i CROSS JOIN profiles q WHERE i.severity = 'error' AND i.code IN ('text_lost_by_reader', 'no_authors', 'no_title', 'no_abstract'))
"""  # fmt: skip

QUERIES = {
    "flagship": matrix,
    "c_findings": findings,
    "c_27_scores": scores,
    "e_23_matrix": matrix,
    "e_01_retention": retention,
    "e_02_accounted": accounted,
    "e_04_coverage": coverage,
    "e_07_shown_issues": shown_issues,
    "e_11_mode": mode,
    "e_16_totals": totals,
    "e_22_fault_tally": faults,
    "a_07_orphans": orphans,
    "a_15_profile_override": profile_override,
    "d_09_lost_text": lost_text,
    "d_10_recovered": recovered,
    "g_set_operations": set_operations,
    "i_review_checks": checks,
    "e_08_category_scores": category_scores,
    "f_09_priorities": priorities,
    "f_10_weakest": desk_reasons,
    "f_11_desk_risk": readiness,
}

_MATRIX = FINDINGS + """SELECT profile_id, count(*) FILTER (WHERE severity = 'pass') AS n_pass, count(*) FILTER (WHERE severity = 'warn') AS n_warn,
  count(*) FILTER (WHERE severity = 'fail') AS n_fail, count(*) FILTER (WHERE severity = 'info') AS n_info FROM found GROUP BY ROLLUP (profile_id)"""
_KEY = "regexp_replace(lower(regexp_replace({}, '\\$[^$]*\\$', ' ', 'g')), '[^0-9a-z]', '', 'g')"
ORACLES = {
    "flagship": _MATRIX,
    "e_23_matrix": _MATRIX,
    "c_findings": FINDINGS + "SELECT * FROM found",
    "c_27_scores": FINDINGS + """SELECT ms_id, profile_id, count(*) FILTER (WHERE severity = 'pass') AS passes, count(*) FILTER (WHERE severity = 'warn') AS warnings,
      count(*) FILTER (WHERE severity = 'fail') AS failures, count(*) FILTER (WHERE severity = 'info') AS infos,
      round(coalesce(count(*) FILTER (WHERE severity = 'pass') / nullif(count(*) FILTER (WHERE severity <> 'info'), 0)::DOUBLE, 1.0), 9) AS score,
      count(*) FILTER (WHERE severity = 'fail') = 0 AS ready FROM found GROUP BY ms_id, profile_id""",
    "e_01_retention": """SELECT coalesce(a.ms_id, b.ms_id) AS ms_id, coalesce(a.n, 0)::BIGINT AS expected, coalesce(b.n, 0)::BIGINT AS got, coalesce(a.n, 0) = 0 OR coalesce(b.n, 0) >= a.n AS ok,
      (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS delta FROM (SELECT o_orderkey AS ms_id, o_orderkey % 7 AS n FROM orders) a FULL JOIN (SELECT l_orderkey AS ms_id, count(*) AS n FROM lineitem GROUP BY 1) b ON a.ms_id = b.ms_id""",
    "e_02_accounted": """SELECT ms_id, sum(n)::BIGINT AS n FROM (SELECT s_suppkey AS ms_id, 1 AS n FROM supplier
      UNION ALL SELECT user_id, CASE WHEN event_id % 5 = 2 THEN 1 ELSE event_id % 4 END FROM events WHERE event_id % 5 IN (2, 3)) GROUP BY ms_id""",
    "e_04_coverage": X.CORPUS + """SELECT ms_id, title <> '' AS has_title, abstract_raw <> '' AS has_abstract, len(keywords) > 0 AS has_keywords,
      len(list_filter(coalesce(top_roles, []), lambda r: r <> 'unknown')) AS roles_resolved, len(coalesce(top_roles, [])) AS roles_total FROM facts""",
    "e_07_shown_issues": """SELECT ms_id, severity, code, min(seq) AS seq, arg_min(message, seq) AS message, CASE WHEN severity = 'info' THEN count(*) ELSE 1 END AS times
      FROM (SELECT user_id AS ms_id, event_id AS seq, ['error', 'warning', 'info'][event_id % 3 + 1] AS severity, ['manual_citations', 'no_authors', 'equation_table', 'layout_table_dropped', 'no_title'][event_id % 5 + 1] AS code,
            (event_id % 4)::VARCHAR || ' ' || event_type AS message FROM events) GROUP BY ms_id, severity, code, CASE WHEN severity = 'info' THEN '' ELSE substr(message, 1, 60) END""",
    "e_11_mode": "SELECT l_partkey, l_quantity, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_quantity) AS place FROM (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE place = 1",
    "e_16_totals": "SELECT l_returnflag, count(*) AS rows, sum(l_linenumber)::BIGINT AS l_linenumber, sum(CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_partkey END)::BIGINT AS cell FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    "a_07_orphans": "SELECT c_custkey AS ms_id, c_name AS filename FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "a_15_profile_override": "SELECT * FROM (VALUES ('alpha', 'Alpha', 40), ('beta', 'Beta, own copy', 99), ('gamma', 'Gamma', NULL), ('delta', 'Delta', NULL)) t(profile_id, journal, abstract_max_words)",
    "d_09_lost_text": X.CORPUS + f""", keyed AS (SELECT ms_id, idx, substr({_KEY.format('text')}, 1, 40) AS k FROM lines),
      kept AS (SELECT ms_id, {_KEY.format("string_agg(text, chr(10) ORDER BY idx)")} AS whole FROM lines WHERE idx % 3 <> 2 GROUP BY ms_id)
      SELECT ms_id, idx FROM keyed WHERE length(k) >= 20 AND NOT EXISTS (SELECT 1 FROM kept WHERE kept.ms_id = keyed.ms_id AND contains(kept.whole, keyed.k))""",
    "d_10_recovered": """WITH s AS (SELECT DISTINCT l_suppkey AS ms_id, l_orderkey AS idx FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0), l AS (SELECT DISTINCT l_suppkey AS ms_id, l_orderkey AS idx FROM lineitem WHERE l_orderkey % 7 = 1)
      SELECT l.ms_id, l.idx, coalesce((SELECT max(s.idx) FROM s WHERE s.ms_id = l.ms_id AND s.idx <= l.idx), (SELECT max(s.idx) FROM s WHERE s.ms_id = l.ms_id)) AS sec_id FROM l""",
    "g_set_operations": X.CORPUS + """, r AS (SELECT ms_id, list(role ORDER BY first) AS own FROM (SELECT ms_id, role, min(sec_ord) AS first FROM sections GROUP BY ALL) GROUP BY ms_id), w AS (SELECT *, ['abstract', 'introduction', 'methods', 'ethics'] AS wanted FROM r)
      SELECT ms_id, len(list_distinct(list_concat(own, wanted)))::BIGINT AS in_either, len(list_intersect(own, wanted))::BIGINT AS in_both, len(list_filter(wanted, lambda x: NOT list_contains(own, x)))::BIGINT AS missing, array_to_string(own, ',') AS in_order, len(own) <= 1 AS uniform FROM w""",
}
