"""How the driver's tables stand in for manuscripts, in DataFrames and as the same SQL.

Text is taken with characters beyond ASCII as spaces, so both engines agree on what a
letter, a boundary and white space are.  The SQL is a chain of CTEs that oracles begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import compliance

ROLES = ["introduction", "methods", "results", "discussion", "conclusion", "references", "unknown", "data_availability", "results_discussion", "acknowledgements"]
FORMATS = ["png", "jpg", "emf", "tif", "pdf"]
CODES = ["manual_citations", "no_authors", "equation_table", "layout_table_dropped", "no_title"]
PROFILES = [
    dict(profile_id="alpha", publisher="A", journal="Alpha", verified=True, abstract_max_words=40, abstract_min_words=20, abstract_paragraphs_max=1, keywords_min=3, keywords_max=6, title_max_chars=50, manuscript_max_words=600, required_sections=["abstract", "introduction", "methods", "results", "references"], section_order=["introduction", "methods", "results", "discussion", "conclusion"], doi_required=False, max_references=4, dpi_halftone=300, scope_keywords=["the", "on the", "er"], rejected_formats=["emf", "gif"]),
    dict(profile_id="beta", publisher="B", journal="Beta", verified=False, abstract_max_words=60, keywords_min=0, keywords_max=0, required_sections=["abstract", "data_availability"], forbidden_sections=["acknowledgements"], doi_required=True, dpi_halftone=600, min_px_single_column=900, scope_keywords=[], rejected_formats=["TIF"]),
    dict(profile_id="gamma", publisher="C", journal="Gamma", verified=True, abstract_min_words=10, keywords_max=4, highlights_required=True, highlights_max=5, required_sections=["discussion", "results"], section_order=["results_discussion", "conclusion"], manuscript_max_words=2000, scope_keywords=["ing", "in", "that", "de"], columns=2),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_text(column: str):
    text = F.coalesce(F.col(column), F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.regexp_replace(text, r"[^\x00-\x7F]", " "))  # most are ASCII as they are


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ms_id, idx, text: the lines of every document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ms_id"), F.posexplode(F.split(ascii_text("text"), "\n")).alias("idx", "text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ms_id"), ascii_text("text").alias("text"))


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring_index("text", "\n", 1)
    return texts(spark, sf_dir).select(
        "ms_id", F.left(first, F.lit(60)).alias("title"), first.alias("abstract_raw"), F.filter(F.split(first, " "), lambda w: F.length(w) >= 9).alias("keywords"),
        F.lit(None).cast("array<string>").alias("highlights"), F.lit(1).alias("abstract_paragraphs"), F.lit(False).alias("abstract_has_math"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.pmod(F.col("ms_id") + F.col("idx"), F.lit(10)) + 1).cast("int"))
    return lines(spark, sf_dir).select("ms_id", F.col("idx").alias("sec_ord"), F.when(F.col("idx") == 0, 1).otherwise(1 + F.col("idx") % 3).alias("level"), F.when(F.col("idx") == 0, "abstract").otherwise(role).alias("role"), F.left("text", F.lit(30)).alias("title_raw"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("ms_id", F.col("idx").alias("sec_ord"), F.lit(0).alias("blk_ord"), F.lit("paragraph").alias("kind"), "text")


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    fmt = F.element_at(F.array(*map(F.lit, FORMATS)), (size % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 3).alias("ms_id"), F.concat(F.lit("fig"), F.col("p_partkey").cast("string")).alias("fig_id"), fmt.alias("fmt"), (fmt == "pdf").alias("is_vector"),
        F.when(size % 7 != 0, size * 40).alias("width_px"), F.when(size % 3 != 0, size * 3.0).alias("placed_width_mm"), F.when(size % 4 == 0, "").otherwise(F.col("p_name")).alias("caption_raw"),
    )


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ms_id"), F.concat(F.lit("tab"), F.col("s_suppkey").cast("string")).alias("tab_id"), F.when(F.col("s_nationkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("caption_raw"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("10.1000/"), F.col("l_partkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ms_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("ref"), F.col("l_linenumber").cast("string")).alias("ref_id"), doi.alias("doi"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), F.year("l_shipdate").alias("year"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (e % n + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ms_id"), e.alias("seq"), pick(["error", "warning", "info"], 3).alias("severity"), pick(CODES, 5).alias("code"), F.concat((e % 4).cast("string"), F.lit(" "), F.col("event_type")).alias("message"))


def corpus(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    known = manuscripts(spark, sf_dir)
    ids = known.select("ms_id")
    own = lambda df: df.join(ids, "ms_id", "left_semi")
    return {
        "manuscripts": known, "sections": sections(spark, sf_dir), "blocks": blocks(spark, sf_dir), "figures": own(figures(spark, sf_dir)), "tables": own(tables(spark, sf_dir)),
        "refs": own(refs(spark, sf_dir)), "issues": own(issues(spark, sf_dir)),
    }


def profiles(spark: SparkSession) -> DataFrame:
    return compliance.profiles(spark, PROFILES)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "]::VARCHAR[]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value}::DOUBLE" if isinstance(value, float) else str(value)


def _profile_sql() -> str:
    rows = [", ".join(f"{_sql(p.get(n, compliance.PROFILE_DEFAULTS.get(n)))} AS {n}" for n in compliance.PROFILE_FIELDS) for p in PROFILES]
    return " UNION ALL ".join(f"SELECT {r}" for r in rows)


CORPUS = rf"""
WITH texts AS (SELECT doc_id AS ms_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', ' ', 'g') AS text FROM documents),
lines AS (SELECT ms_id, unnest(range(len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS text FROM texts),
manuscripts AS (
  SELECT ms_id, substr(text, 1, 60) AS title, text AS abstract_raw, list_filter(string_split(text, ' '), lambda w: length(w) >= 9) AS keywords,
         len(regexp_extract_all(text, '[^\s]+')) AS abstract_words
  FROM lines WHERE idx = 0),
sections AS (
  SELECT ms_id, idx AS sec_ord, CASE WHEN idx = 0 THEN 1 ELSE 1 + idx % 3 END AS level,
         CASE WHEN idx = 0 THEN 'abstract' ELSE ({_sql(ROLES)})[(ms_id + idx) % 10 + 1] END AS role, substr(text, 1, 30) AS title_raw, text
  FROM lines),
figures AS (
  SELECT p_partkey // 3 AS ms_id, 'fig' || p_partkey AS fig_id, ({_sql(FORMATS)})[p_size % 5 + 1] AS fmt, p_size % 5 = 4 AS is_vector,
         CASE WHEN p_size % 7 <> 0 THEN p_size * 40 END AS width_px, CASE WHEN p_size % 3 <> 0 THEN p_size * 3.0::DOUBLE END AS placed_width_mm,
         CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS caption_raw
  FROM part WHERE p_partkey // 3 IN (SELECT doc_id FROM documents)),
tables_ AS (SELECT s_suppkey AS ms_id, 'tab' || s_suppkey AS tab_id, CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE s_name END AS caption_raw FROM supplier WHERE s_suppkey IN (SELECT doc_id FROM documents)),
refs AS (
  SELECT l_orderkey AS ms_id, l_linenumber AS ord, 'ref' || l_linenumber AS ref_id, CASE WHEN l_returnflag = 'R' THEN '' ELSE '10.1000/' || l_partkey END AS doi,
         round(l_discount * 10, 2) AS confidence, year(l_shipdate) AS year
  FROM lineitem WHERE l_orderkey IN (SELECT doc_id FROM documents)),
issues AS (
  SELECT user_id AS ms_id, event_id AS seq, ['error', 'warning', 'info'][event_id % 3 + 1] AS severity, ({_sql(CODES)})[event_id % 5 + 1] AS code, (event_id % 4)::VARCHAR || ' ' || event_type AS message
  FROM events WHERE user_id IN (SELECT doc_id FROM documents)),
profiles AS ({_profile_sql()}),
present AS (
  SELECT ms_id, list(DISTINCT role) AS roles FROM (
    SELECT ms_id, role FROM sections
    UNION ALL SELECT ms_id, unnest(['results', 'discussion']) FROM (SELECT DISTINCT ms_id FROM sections WHERE role = 'results_discussion')
    UNION ALL SELECT ms_id, 'abstract' FROM manuscripts WHERE trim(abstract_raw) <> ''
    UNION ALL SELECT ms_id, 'keywords' FROM manuscripts WHERE len(keywords) > 0)
  GROUP BY ms_id),
tops AS (
  SELECT ms_id, list(role ORDER BY sec_ord) FILTER (WHERE level = 1) AS top_roles, count(*) FILTER (WHERE level = 1 AND role = 'unknown' AND title_raw <> '') AS unlabelled,
         sum(len(regexp_extract_all(text, '[^\s]+')))::BIGINT AS words
  FROM sections GROUP BY ms_id),
facts AS (
  SELECT m.*, p.* EXCLUDE (ms_id), t.* EXCLUDE (ms_id), coalesce(r.roles, []) AS present FROM manuscripts m CROSS JOIN (SELECT NULL AS ms_id) p LEFT JOIN tops t ON m.ms_id = t.ms_id LEFT JOIN present r ON m.ms_id = r.ms_id),
both_ AS (SELECT f.*, q.* FROM facts f CROSS JOIN profiles q)
"""
CORPUS = CORPUS.replace("SELECT m.*, p.* EXCLUDE (ms_id), t.* EXCLUDE (ms_id)", "SELECT m.*, t.* EXCLUDE (ms_id)").replace(" CROSS JOIN (SELECT NULL AS ms_id) p", "")
