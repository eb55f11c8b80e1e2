"""Small views and edits of the same tables, as a front end asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T

ESSENTIAL = ("introduction", "methods", "results", "conclusion")
NOT_SELECTED = ("title", "authors", "affiliations")


def publishers(profiles: DataFrame, publisher: str | None = None) -> DataFrame:
    """E-18: profiles of one publisher or all, by publisher and journal."""
    chosen = profiles.where(F.col("publisher") == publisher) if publisher else profiles
    return chosen.orderBy("publisher", "journal").select("publisher", "journal", "profile_id", "verified")


def selected_words(rows: DataFrame, first: int, last: int) -> DataFrame:
    """E-19: words of the rows in a range."""
    return rows.where(F.col("idx").between(first, last)).groupBy("ms_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"))


def tail(examples: DataFrame, order: str, most: int = 200) -> DataFrame:
    """F-13: the last examples."""
    return examples.orderBy(F.desc(order)).limit(most)


def wanted_roles(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """F-22: the roles to confirm, in order: those required, those there, the essential ones; each once."""
    there = F.filter("top_roles", lambda r: r != "unknown")
    every = F.array_distinct(F.concat("required_sections", there, F.array(*map(F.lit, ESSENTIAL))))
    return facts.crossJoin(profiles).select("ms_id", "profile_id", F.array_except(every, F.array(*map(F.lit, NOT_SELECTED))).alias("wanted"))


def default_ranges(rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """F-21: ms_id, first, last: three rows after the last confirmed range, within the document."""
    sizes = rows.groupBy("ms_id").agg(F.max("idx").alias("final"))
    ends = assignments.groupBy("ms_id").agg(F.max("end").alias("end"))
    first = F.least(F.coalesce("end", F.lit(-1)) + 1, F.greatest("final", F.lit(0)))
    return sizes.join(ends, "ms_id", "left").select("ms_id", first.alias("first"), F.least(first + 2, F.col("final")).alias("last"))


def matching(rows: DataFrame, needle: str = "", headings_only: bool = False) -> DataFrame:
    """K-14: rows that hold a string, in any case."""
    found = rows.where(F.contains(F.lower("text"), F.lit(needle.lower())))
    return found.where("is_heading") if headings_only else found


def edited_front(manuscripts: DataFrame, edits: DataFrame) -> DataFrame:
    """K-15: title, keywords and highlights as typed: keywords between semicolons, highlights a line each.

    ``edits``: ms_id, title, keywords, highlights; null leaves a value alone, and only a value
    that is given is marked as explicit.
    """
    parts = lambda c, by: F.filter(F.transform(F.split(c, by), T.stripped), lambda x: x != "")
    new = edits.select("ms_id", F.col("title").alias("n_title"), parts(F.col("keywords"), ";").alias("n_keywords"), parts(F.col("highlights"), "\n").alias("n_highlights"))
    rows = manuscripts.join(new, "ms_id", "left")
    given = F.coalesce("n_title", F.array_join("n_keywords", ""), F.array_join("n_highlights", "")).isNotNull()
    kept = [c for c in manuscripts.columns if c not in ("ms_id", "title", "keywords", "highlights")]
    return rows.select("ms_id", F.coalesce("n_title", "title").alias("title"), F.coalesce("n_keywords", "keywords").alias("keywords"), F.coalesce("n_highlights", "highlights").alias("highlights"), *kept, F.when(given, "explicit").otherwise("heuristic").alias("method"))


def with_roles(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """K-16: sections with roles as edited (ms_id, sec_ord, role)."""
    new = edits.select("ms_id", "sec_ord", F.col("role").alias("n_role"))
    changed = F.col("n_role").isNotNull() & (F.col("n_role") != F.col("role"))
    rows = sections.join(new, ["ms_id", "sec_ord"], "left").withColumn("explicit", changed)
    return rows.withColumn("role", F.coalesce("n_role", "role")).drop("n_role")


def to_confirm(sections: DataFrame, least: float = 0.6) -> DataFrame:
    """K-17: ms_id, unsure, progress: sections whose role is not sure, and the share of those that are."""
    sure = F.coalesce(F.col("role_confidence") >= least, F.lit(False))
    return sections.groupBy("ms_id").agg(F.count_if(~sure).alias("unsure"), F.avg(sure.cast("double")).alias("progress"))


def stats(manuscripts: DataFrame, **tables: DataFrame) -> DataFrame:
    """B-23: counts of every table for each manuscript: ``stats(ms, sections=..., figures=...)``."""
    out = manuscripts.select("ms_id")
    for name, table in tables.items():
        out = out.join(table.groupBy("ms_id").agg(F.count("*").alias(name)), "ms_id", "left")
    return out.na.fill(0, list(tables))


def evaluation(audits: DataFrame, issues: DataFrame, scores: DataFrame, failed: DataFrame) -> DataFrame:
    """L-21: a row for each document of a batch; those that failed are rows too, with what went wrong.

    ``audits``: ms_id, what, expected, got, ok; ``scores``: ms_id, failures, warnings; ``failed``: ms_id, error.
    """
    wide = audits.groupBy("ms_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("what", F.struct("expected", "got"))))).alias("counts"), F.bool_and("ok").alias("parse_retained"))
    found = issues.groupBy("ms_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    judged = scores.select("ms_id", F.col("failures").alias("compliance_fail"), F.col("warnings").alias("compliance_warn"))
    good = wide.join(found, "ms_id", "left").join(judged, "ms_id", "left").withColumn("note", F.lit("")).withColumn("parse_ok", F.lit(True))
    bad = failed.select("ms_id", F.concat(F.lit("parse failed: "), F.left("error", F.lit(120))).alias("note"), F.lit(False).alias("parse_ok"), F.lit(False).alias("parse_retained"))
    return good.unionByName(bad, allowMissingColumns=True)


def caption_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """A-24: paragraphs whose style is a caption's."""
    return paragraphs.where(F.lower("style") == "caption")


def baselines(source: DataFrame, converted: DataFrame) -> DataFrame:
    """N-15: for each converter the share of source paragraphs whose beginning its output keeps.

    ``source``: ms_id, idx, text; ``converted``: converter, ms_id, text.
    """
    key = F.left(T.match_key(F.col("text")), F.lit(40))
    wanted = source.withColumn("key", key).where(F.length("key") >= 20).select("ms_id", "key").distinct()
    every = converted.select("converter", "ms_id", T.match_key(F.col("text")).alias("whole"))
    rows = wanted.join(every, "ms_id")
    return rows.groupBy("converter").agg(F.count("*").alias("paragraphs"), F.count_if(F.contains("whole", F.col("key"))).alias("retained"))


def numbered_display(rows: DataFrame) -> DataFrame:
    """E-20: formulas that stand in the top-level blocks of a document."""
    n = F.size(F.filter("inlines", lambda r: r["kind"] == "math"))
    return rows.where("parent IS NULL").groupBy("ms_id").agg(F.sum(n).cast("long").alias("formulas"))


def deduplicated(findings: DataFrame) -> DataFrame:
    """N-23: findings as a panel lists them: once for each severity and code, with how many there are."""
    first = F.row_number().over(Window.partitionBy("ms_id", "severity", "code").orderBy("seq"))
    n = F.count("*").over(Window.partitionBy("ms_id", "severity", "code"))
    return findings.withColumn("n", n).withColumn("place", first).where("place = 1").drop("place")


def of_target(blocks: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """B-08: blocks with the figure, table or equation they point at."""
    return blocks.join(targets.withColumnRenamed(key, "target_id"), ["ms_id", "target_id"])


def in_order(sections: DataFrame) -> DataFrame:
    """B-06: sections in preorder."""
    return sections.orderBy("ms_id", "sec_ord")


def found_blocks(stream: DataFrame) -> DataFrame:
    """N-02: the stream's blocks alone."""
    return stream.where("record = 'block'")
