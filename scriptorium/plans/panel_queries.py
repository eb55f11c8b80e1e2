"""Queries of reviewers' findings, learning, rendering, packages and streams, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import audit, floats, frontmatter, learn, panel, render
from scriptorium.plans import adapters as X
from scriptorium.sources import docx, files
from scriptorium.streaming import corrections


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4: a conversation's turns as findings of its roles."""
    text = X.ascii_text("text")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    severity = F.when(F.col("turn") % 3 == 0, "major").otherwise("minor")
    return X.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("ms_id"), seq.alias("seq"), F.lit("p").alias("provider"), F.col("role").alias("reviewer"), F.left(text, F.lit(60)).alias("issue"), F.substring(text, 61, 60).alias("fix"),
        F.substring(text, 121, 40).alias("why"), F.substring(text, 161, 40).alias("quote"), severity.alias("severity"),
    )


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), X.ascii_text("text").alias("quote"))
    return panel.grounded(quotes, X.texts(spark, sf_dir))


def grounding_by_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through word anchors: the way for more quotes than may be broadcast."""
    quotes = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), X.ascii_text("text").alias("quote"))
    return panel.grounded(quotes, X.texts(spark, sf_dir), few=5)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-38: answers built of turns: good, fenced, without an issue, and malformed ones."""
    t = X.table(spark, sf_dir, "conversations")
    good = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("issue "), F.col("turn").cast("string")).alias("issue"), F.lit("Major").alias("severity"), F.lit("fix it").alias("fix")), F.struct(F.lit("").alias("issue"), F.lit("minor").alias("severity"), F.lit("x").alias("fix"))).alias("findings")))
    raw = F.when(F.col("turn") % 4 == 0, good).when(F.col("turn") % 4 == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(F.col("turn") % 4 == 2, F.lit("no braces here")).otherwise(F.lit('{"findings": [{"issue": '))
    runs = t.select(F.col("conv_id").alias("ms_id"), F.lit("p").alias("provider"), F.concat("role", F.col("turn").cast("string")).alias("reviewer"), raw.alias("raw"))
    return panel.parse_findings(runs).select("ms_id", "reviewer", "item_no", "issue", "fix", "severity")


def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumn("grounded", F.length("issue") % 2 == 0)
    return panel.groundedness(rows).withColumn("groundedness", F.round("groundedness", 9))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-12, E-13, F-08 with clusters by the first letter, which SQL can follow."""
    rows = _turns(spark, sf_dir)
    first = rows.groupBy("ms_id", F.left("issue", F.lit(1)).alias("k")).agg(F.min("seq").alias("leader"))
    clustered = rows.withColumn("k", F.left("issue", F.lit(1))).join(first, ["ms_id", "k"]).drop("k")
    return panel.merged(clustered).select("ms_id", "seq", F.array_join("agreed_by", ",").alias("agreed_by"), "agreement", "severity")


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.merged(panel.clusters(_turns(spark, sf_dir))).select("ms_id", "seq", "agreement", "severity", "specificity", "rank")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-06: quotes cut out of their documents, a third with a letter changed, a third foreign; whole texts of all documents."""
    texts = X.texts(spark, sf_dir)
    quote = F.substring("text", 100, 80)
    changed = F.concat(F.left(quote, F.lit(40)), F.lit("x"), F.substring(quote, 42, 40))
    rows = texts.select("ms_id", F.when(F.col("ms_id") % 3 == 0, quote).when(F.col("ms_id") % 3 == 1, changed).otherwise(F.lit("words that nobody would write in such a text at all")).alias("quote"))
    return panel.verified(rows, texts).select("ms_id", "grounded")


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.lines(spark, sf_dir).select("ms_id", F.col("idx").alias("part_no"), F.concat(F.lit("S"), F.col("idx").cast("string")).alias("section"), "text")
    quotes = parts.where("part_no % 4 = 1 AND length(text) > 60").select(F.concat_ws("/", F.col("ms_id").cast("string"), F.col("part_no").cast("string")).alias("quote_id"), "ms_id", F.substring("text", 5, 50).alias("quote"))
    return panel.located(quotes, parts)


def slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("seconds"))
    return panel.slowest(runs)


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-10 with a budget that only long documents go beyond."""
    rows = X.sections(spark, sf_dir).join(X.blocks(spark, sf_dir).select("ms_id", "sec_ord", "text"), ["ms_id", "sec_ord"])
    out = panel.context(X.manuscripts(spark, sf_dir), rows, budget=6000)
    return out.groupBy("ms_id").agg(F.count("*").alias("parts"), F.count_if(F.contains("text", F.lit("[... section abridged ...]"))).alias("abridged"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9: whole lines of labelled documents; short ones stand for headings."""
    labelled = X.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ms_id"), "quality")
    return X.lines(spark, sf_dir).join(labelled, "ms_id").select(T.stripped(F.col("text")).alias("text"), (F.length("text") <= 60).alias("is_heading"), F.when(F.length("text") <= 60, F.concat(F.lit("r"), (F.length("text") % 4).cast("string"))).otherwise("").alias("role"))


def example_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.status(_examples(spark, sf_dir))


def example_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.class_counts(_examples(spark, sf_dir))


def rating_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.rating_status(X.table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("useful")))


def new_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = X.table(spark, sf_dir, "part").select(F.col("p_type").alias("text"), (F.col("p_size") % 2 == 0).alias("is_heading"), F.col("p_brand").alias("role"))
    return learn.new_examples(every, every.where("role LIKE '%1'"))


def heading_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-01, K-02: cross-validated F1 of the heading model on lines."""
    rows = _examples(spark, sf_dir).select("text", "is_heading").distinct()
    return learn.cross_validated(rows, "is_heading", 2.0, "f1", folds=3)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _examples(spark, sf_dir).select("text", "is_heading").distinct()
    fold = F.pmod(F.xxhash64("text"), F.lit(4))
    model = learn.train(rows.where(fold != 0), "is_heading", 2.0)
    scored = learn.predict(model, rows.where(fold == 0), positive="true")
    return scored.groupBy("is_heading", "predicted").agg(F.count("*").alias("n"))


def harvested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.lines(spark, sf_dir).withColumn("style", F.when(F.col("idx") % 4 == 0, "Heading 1").when(F.col("idx") % 4 == 1, "Caption").otherwise("Normal")).withColumn("in_table", F.col("idx") % 7 == 6)
    return learn.harvested(rows).groupBy("is_heading").agg(F.count("*").alias("n"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-14 to L-16: whole LaTeX documents of lines and references, measured."""
    rows = X.lines(spark, sf_dir).select("ms_id", "idx", (F.col("idx") % 4 == 0).alias("is_heading"), F.lit(0).alias("depth"), F.lit("paragraph").alias("kind"), "text", F.lit("").alias("target_id"))
    refs = X.refs(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("ms_id").orderBy("ord", "doi", "confidence", "year"))).select("ms_id", "ord", F.concat(F.lit("ref"), F.col("ord").cast("string")).alias("ref_id"), F.concat(F.lit("[1] An entry of "), F.col("year").cast("string")).alias("raw"))
    made = render.documents(rows, X.manuscripts(spark, sf_dir), refs)
    return made.select("ms_id", F.inline(F.array(audit.emitted_counts(F.col("latex"))))).select("ms_id", "sections", "references")


def bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("ms_id").orderBy("ord", "doi", "confidence", "year"))
    refs = X.refs(spark, sf_dir).withColumn("ord", place).withColumn("ref_id", F.concat(F.lit("ref"), F.col("ord").cast("string")))
    people = F.array(F.struct(F.lit("Miller").alias("family"), F.lit("A.").alias("given")))
    rows = refs.select("*", people.alias("authors"), F.lit("T").alias("title"), F.lit("").alias("volume"), F.lit("").alias("issue"), F.lit("").alias("page"), F.lit("").alias("url"))
    return render.bibtex(rows).select("ms_id", "kept", "total", F.array_join("missing", ",").alias("missing"), F.length("bibtex").cast("long").alias("characters"))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-01, A-03: packages made of documents and read back: their paragraphs are the lines."""
    from scriptorium.session import ship

    ship(spark)
    made = X.texts(spark, sf_dir).select(F.col("ms_id").cast("string").alias("ms_id"), docx.packed(F.col("text")).alias("content"))
    return docx.paragraphs(made).select(F.col("ms_id").cast("long").alias("ms_id"), "idx", "text", "in_table", "error")


def package_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.session import ship

    ship(spark)
    made = X.texts(spark, sf_dir).select(F.col("ms_id").cast("string").alias("ms_id"), docx.packed(F.col("text")).alias("content"))
    counts = docx.source_counts(docx.parts(made))
    return counts.select(F.col("ms_id").cast("long").alias("ms_id"), "paragraphs", "tables", "pictures")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of corrections over files of examples: what it keeps equals the batch operator's result."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="corrections-")
    folder = f"{shared}/corrections-{uuid.uuid4().hex}"
    rows = X.table(spark, sf_dir, "part").select(F.col("p_type").alias("text"), (F.col("p_size") % 2 == 0).alias("is_heading"), F.col("p_brand").alias("role"))
    rows.repartition(3).write.mode("overwrite").json(f"{folder}/in")
    query = corrections.keep(corrections.each_once(corrections.corrections(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return files.examples(spark, f"{folder}/out")


def reference_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = X.texts(spark, sf_dir).where("ms_id % 2 = 0").select("ms_id")
    refs = X.corpus(spark, sf_dir)["refs"]
    return frontmatter.reference_issues(refs, X.sections(spark, sf_dir).select("ms_id"), cited)


def degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = X.table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = line.select(F.col("l_orderkey").alias("ms_id"), place.alias("ord"), F.concat(F.lit("eq"), place.cast("string")).alias("eq_id"), F.when(F.col("l_suppkey") % 3 == 0, "_{}").otherwise("a=b").alias("latex"))
    return floats.degenerate_issues(rows)


QUERIES = {
    "d_16_grounding": grounding, "d_16_grounding_by_anchor": grounding_by_anchor, "h_38_parse_findings": parsed, "e_10_groundedness": groundedness, "f_08_ranked": ranked, "f_07_clusters": clustered, "f_06_verified": verified,
    "d_17_located": located, "f_12_slowest": slowest, "k_10_excerpts": excerpts, "e_15_status": example_status, "e_14_classes": example_classes, "e_15_ratings": rating_status, "a_18_new_examples": new_examples,
    "k_02_heading_model": heading_model, "k_03_predictions": predictions, "k_07_harvested": harvested, "l_14_documents": documents, "l_17_bibtex": bibtex, "a_01_scanned": scanned, "a_11_package_counts": package_counts,
    "j_corrections_stream": streamed, "m_reference_issues": reference_issues, "h_13_degenerate": degenerate,
}

_ASCII = r"regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', ' ', 'g')"
_KEY = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_GROUNDED = f"""WITH d AS (SELECT doc_id AS ms_id, {_KEY.format(_ASCII)} AS t FROM documents), q AS (SELECT item_id AS quote_id, {_KEY.format(_ASCII)} AS q FROM benchmark)
  SELECT quote_id, ms_id FROM q JOIN d ON length(q) >= 20 AND contains(t, q)"""
_TURNS = f"""t AS (SELECT conv_id AS ms_id, turn, role, text AS raw, {_ASCII} AS x FROM conversations),
  f AS (SELECT ms_id, row_number() OVER (PARTITION BY ms_id ORDER BY turn, role, raw) AS seq, role AS reviewer, substr(x, 1, 60) AS issue, substr(x, 61, 60) AS fix, substr(x, 121, 40) AS why, CASE WHEN turn % 3 = 0 THEN 'major' ELSE 'minor' END AS severity FROM t)"""
_EX = X.CORPUS + r", ex AS (SELECT trim(substr(text, 1, 80)) AS text, length(text) <= 60 AS is_heading, CASE WHEN length(text) <= 60 THEN 'r' || (length(text) % 4) ELSE '' END AS role FROM lines JOIN labels ON labels.doc_id = lines.ms_id)"
_PLACED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place FROM lineitem)"
ORACLES = {
    "d_16_grounding": _GROUNDED,
    "d_16_grounding_by_anchor": _GROUNDED,
    "h_38_parse_findings": "SELECT conv_id AS ms_id, role || turn AS reviewer, 0 AS item_no, 'issue ' || turn AS issue, 'fix it' AS fix, 'major' AS severity FROM conversations WHERE turn % 4 IN (0, 1)",
    "e_10_groundedness": f"WITH {_TURNS} SELECT ms_id, round(avg(rate), 9) AS groundedness, count(*) AS runs FROM (SELECT ms_id, reviewer, avg((length(issue) % 2 = 0)::INT) AS rate FROM f GROUP BY ALL) GROUP BY ms_id",
    "d_17_located": X.CORPUS + f""", q AS (SELECT ms_id, idx, {_KEY.format('substr(text, 5, 50)')} AS q FROM lines WHERE idx % 4 = 1 AND length(text) > 60), l AS (SELECT ms_id, idx, {_KEY.format('text')} AS t FROM lines)
      SELECT q.ms_id || '/' || q.idx AS quote_id, coalesce('S' || (SELECT min(l.idx) FROM l WHERE l.ms_id = q.ms_id AND length(q.q) >= 20 AND contains(l.t, q.q)), '') AS section FROM q""",
    "f_12_slowest": "SELECT o_orderkey AS run_id, o_totalprice AS seconds FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6",
    "k_10_excerpts": X.CORPUS + """, s AS (SELECT s.ms_id, s.text, length(title || abstract_raw || array_to_string(keywords, ', ')) AS used FROM sections s JOIN manuscripts m USING (ms_id) WHERE role NOT IN ('abstract', 'keywords', 'references', 'highlights') AND s.text <> ''),
      a AS (SELECT *, sum(length(text)) OVER (PARTITION BY ms_id) AS total, greatest(1000, 6000 - used) AS room FROM s)
      SELECT ms_id, count(*) AS parts, count(*) FILTER (WHERE total > room AND length(text) > greatest(600, floor(room * length(text) / total::DOUBLE))) AS abridged FROM a GROUP BY ms_id""",
    "e_15_status": _EX + "SELECT *, examples >= 60 AND headings >= 10 AND examples - headings >= 10 AS can_train_heading, roles >= 40 AND role_classes >= 3 AS can_train_role FROM (SELECT count(*) AS examples, count(*) FILTER (WHERE is_heading) AS headings, count(nullif(role, '')) AS roles, count(DISTINCT nullif(role, '')) AS role_classes FROM ex)",
    "e_14_classes": _EX + "SELECT role, count(*) AS n, count(*) >= 2 AS scorable FROM ex WHERE role <> '' GROUP BY role",
    "e_15_ratings": "SELECT *, ratings >= 40 AND useful >= 8 AND ratings - useful >= 8 AS can_train FROM (SELECT count(*) AS ratings, count(*) FILTER (WHERE quality = 1) AS useful FROM labels)",
    "a_18_new_examples": "SELECT DISTINCT p_type AS text, p_size % 2 = 0 AS is_heading, p_brand AS role FROM part EXCEPT SELECT p_type, p_size % 2 = 0, p_brand FROM part WHERE p_brand LIKE '%1'",
    "j_corrections_stream": "SELECT DISTINCT p_type AS text, p_size % 2 = 0 AS is_heading, p_brand AS role FROM part",
    "k_07_harvested": X.CORPUS + r""", s AS (SELECT *, trim(text) AS t, count(*) FILTER (WHERE idx % 4 = 0 AND trim(text) <> '') OVER (PARTITION BY ms_id) AS styled FROM lines)
      SELECT is_heading, count(*) AS n FROM (SELECT true AS is_heading FROM s WHERE styled >= 3 AND idx % 4 = 0 AND t <> '' AND length(t) <= 120 UNION ALL SELECT false FROM s WHERE styled >= 3 AND idx % 4 IN (2, 3) AND idx % 7 <> 6 AND length(t) BETWEEN 40 AND 400) GROUP BY ALL""",
    "f_08_ranked": f"""WITH {_TURNS}, k AS (SELECT *, min(seq) OVER (PARTITION BY ms_id, substr(issue, 1, 1)) AS leader FROM f),
      c AS (SELECT ms_id, leader, list_sort(list(DISTINCT 'p/' || reviewer)) AS by_, CASE WHEN bool_or(severity = 'major') THEN 'major' ELSE 'minor' END AS severity FROM k GROUP BY ALL),
      r AS (SELECT ms_id, leader, seq FROM (SELECT *, row_number() OVER (PARTITION BY ms_id, leader ORDER BY length(why) + length(fix) DESC, seq) AS n FROM k) WHERE n = 1)
      SELECT ms_id, seq, array_to_string(by_, ',') AS agreed_by, len(by_)::INT AS agreement, severity FROM r JOIN c USING (ms_id, leader)""",
    "l_14_documents": X.CORPUS + """SELECT l.ms_id, count(*) FILTER (WHERE idx % 4 = 0) AS sections, (SELECT count(*) FROM lineitem WHERE l_orderkey = l.ms_id) AS references FROM lines l GROUP BY l.ms_id""",
    "l_17_bibtex": f"""WITH r AS (SELECT l_orderkey AS ms_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_returnflag = 'R' THEN '' ELSE '10.1000/' || l_partkey END, round(l_discount * 10, 2), year(l_shipdate)) AS ord, CASE WHEN l_returnflag = 'R' THEN '' ELSE '10.1000/' || l_partkey END AS doi, round(l_discount * 10, 2) AS c, year(l_shipdate) AS y FROM lineitem)
      SELECT ms_id, count(*) FILTER (WHERE c >= 0.6) AS kept, count(*) AS total, coalesce(string_agg('ref' || ord, ',' ORDER BY ord) FILTER (WHERE c < 0.6), '') AS missing,
        coalesce(length(string_agg('@article{{ref' || ord || ',' || chr(10) || '  author = {{Miller, A.}},' || chr(10) || '  title = {{T}},' || chr(10) || '  year = {{' || y || '}},' || CASE WHEN doi <> '' THEN chr(10) || '  doi = {{' || doi || '}},' ELSE '' END || chr(10) || '}}', chr(10) || chr(10) ORDER BY ord) FILTER (WHERE c >= 0.6)), 0) AS characters FROM r GROUP BY ms_id""",
    "a_01_scanned": X.CORPUS + "SELECT ms_id, idx, text, false AS in_table, NULL::VARCHAR AS error FROM lines",
    "a_11_package_counts": X.CORPUS + "SELECT ms_id, count(*) AS paragraphs, 0::BIGINT AS tables, 0::BIGINT AS pictures FROM lines GROUP BY ms_id",
    "m_reference_issues": """WITH r AS (SELECT l_orderkey AS ms_id, count(*) FILTER (WHERE round(l_discount * 10, 2) < 0.6) AS low, count(*) FILTER (WHERE l_returnflag <> 'R') AS dois FROM lineitem GROUP BY 1), d AS (SELECT doc_id AS ms_id, low, dois FROM documents LEFT JOIN r ON r.ms_id = doc_id)
      SELECT ms_id, 'error' AS severity, 'no_references' AS code FROM d WHERE low IS NULL UNION ALL SELECT ms_id, 'warning', 'low_confidence_refs' FROM d WHERE low > 0 UNION ALL SELECT ms_id, 'warning', 'no_dois' FROM d WHERE dois = 0 UNION ALL SELECT ms_id, 'warning', 'manual_citations' FROM d WHERE ms_id % 2 = 1""",
    "h_13_degenerate": f"""WITH e AS (SELECT l_orderkey AS ms_id, place, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM {_PLACED} WHERE l_suppkey % 3 = 0)
      SELECT DISTINCT ms_id, 'error' AS severity, 'degenerate_math' AS code, c::VARCHAR AS location FROM e UNION ALL SELECT ms_id, 'warning', 'degenerate_equation', 'eq' || place FROM e WHERE n <= 10""",
}
