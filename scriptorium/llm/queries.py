"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.embedding_dedup import embedding_duplicates

    return embedding_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.suffix_dedup import remove_repeats

    removed = remove_repeats(_table(spark, sf_dir, "documents"), length=400, whole=False)
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=75).drop("rid", "root")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.packing import pack_texts

    packed = pack_texts(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), _path("byte_bpe_50k.tiktoken"), size=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.media import media_columns

    return media_columns(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.quality import fit_quality, score_quality

    documents = _table(spark, sf_dir, "documents")
    return score_quality(documents, fit_quality(documents, _table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.toxicity import fit_toxicity, score_toxicity

    documents = _table(spark, sf_dir, "documents")
    return score_toxicity(documents, fit_toxicity(documents, _table(spark, sf_dir, "labels")))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.lm_scoring import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.tiktoken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


#: All pairs by list cosines in doubles, and what links reach by recursion.
_OP1 = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  l AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y FROM g a JOIN g b ON a.rid <> b.rid AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END),
  r AS (SELECT rid AS x, rid AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
  c AS (SELECT r.x AS rid, min(w.vec_id) AS component_id FROM r JOIN v w ON w.rid = r.y GROUP BY 1)
  SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.rid) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (rid)"""
#: Shingles as joined words, an inverted index of them, and what links reach by recursion.
_OP3 = r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
  i AS MATERIALIZED (SELECT rid, len(s) AS n, unnest(s) AS h FROM s),
  l AS MATERIALIZED (SELECT x, y FROM (SELECT a.rid AS x, b.rid AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM i a JOIN i b ON a.h = b.h AND a.rid <> b.rid GROUP BY 1, 2) WHERE 100 * c >= 75 * (n + m - c)),
  r AS (SELECT rid AS x, rid AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
  c AS (SELECT r.x AS rid, min(t.doc_id) AS component_id FROM r JOIN s t ON t.rid = r.y GROUP BY 1)
  SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (rid)"""


def oracle_sql() -> dict[str, str]:
    from scriptorium.llm.mixing import ORACLE

    return {"op1_embedding_near_dedup": _OP1, "op3_minhash_near_dedup": _OP3, "op5_source_mixing": ORACLE}
