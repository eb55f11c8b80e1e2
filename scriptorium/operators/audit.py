"""Reconciliation of what a source holds with what was kept of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def retention(expected: DataFrame, got: DataFrame, on: list[str]) -> DataFrame:
    """E-01: counts ``expected`` and ``got`` side by side; nothing expected is always kept, more than expected too.

    Both frames have the columns of ``on`` and a count ``n``; keys of either side stay.
    """
    both = expected.withColumnRenamed("n", "expected").join(got.withColumnRenamed("n", "got"), on, "full_outer")
    e, g = F.coalesce("expected", F.lit(0)).cast("long"), F.coalesce("got", F.lit(0)).cast("long")
    return both.select(*on, e.alias("expected"), g.alias("got"), ((e == 0) | (g >= e)).alias("ok"), (g - e).alias("delta"))


def accounted(tables: DataFrame, issues: DataFrame) -> DataFrame:
    """E-02: ms_id, n: tables kept, turned into equations, or dropped as layout (the message begins with how many)."""
    kept = tables.groupBy("ms_id").agg(F.count("*").alias("n"))
    dropped = F.regexp_extract("message", r"^\s*(\d+)", 1).try_cast("long")
    moved = issues.where("code IN ('equation_table', 'layout_table_dropped')").groupBy("ms_id").agg(F.sum(F.when(F.col("code") == "equation_table", F.lit(1)).otherwise(F.coalesce(dropped, F.lit(0)))).cast("long").alias("n"))
    return kept.unionByName(moved).groupBy("ms_id").agg(F.sum("n").alias("n"))


def inline_formulas(blocks: DataFrame) -> DataFrame:
    """E-03: ms_id, n: formulas in the runs of every block, nested ones and table cells included as rows of their own."""
    return blocks.groupBy("ms_id").agg(F.sum(F.size(F.filter("inlines", lambda x: x["kind"] == "math"))).cast("long").alias("n"))


def coverage(facts: DataFrame) -> DataFrame:
    """E-04: which parts a manuscript has, and how many of its top-level sections have a role."""
    there = lambda c: (F.coalesce(F.col(c), F.lit("")) != "")
    known = F.size(F.filter("top_roles", lambda r: r != "unknown"))
    return facts.select("ms_id", there("title").alias("has_title"), there("abstract_raw").alias("has_abstract"), (F.size("keywords") > 0).alias("has_keywords"), known.alias("roles_resolved"), F.size("top_roles").alias("roles_total"))


def blocking(facts: DataFrame) -> DataFrame:
    """E-05: ms_id, blocking: what must be mended before typesetting; ``facts``: mathtype, citation_fields, refs, unconvertible."""
    reasons = F.array(
        F.when(F.coalesce("mathtype", F.lit(0)) > 0, "mathtype_objects"),
        F.when((F.coalesce("citation_fields", F.lit(0)) == 0) & (F.coalesce("refs", F.lit(0)) > 0), "hand_typed_references"),
        F.when(F.coalesce("unconvertible", F.lit(0)) > 0, "unconvertible_figures"),
    )
    return facts.select("ms_id", F.filter(reasons, lambda r: r.isNotNull()).alias("blocking"))


def ready(checks: DataFrame, blocked: DataFrame) -> DataFrame:
    """E-06: ready where nothing blocks and every count was kept."""
    kept = checks.groupBy("ms_id").agg(F.bool_and("ok").alias("kept"))
    return kept.join(blocked, "ms_id", "full_outer").select("ms_id", (F.coalesce("kept", F.lit(True)) & (F.size(F.coalesce("blocking", F.array().cast("array<string>"))) == 0)).alias("ready"))


def shown_issues(issues: DataFrame) -> DataFrame:
    """E-07: issues as a report lists them: errors and warnings once for each code and 60 characters, infos once a code with a count."""
    key = F.when(F.col("severity") == "info", F.lit("")).otherwise(F.left("message", F.lit(60)))
    grouped = issues.groupBy("ms_id", "severity", "code", key.alias("key")).agg(F.min(F.struct("seq", "message")).alias("first"), F.count("*").alias("n"))
    return grouped.select("ms_id", "severity", "code", F.col("first.seq").alias("seq"), F.col("first.message").alias("message"), F.when(F.col("severity") == "info", F.col("n")).otherwise(F.lit(1)).cast("long").alias("times"))


def lost_text(source: DataFrame, kept: DataFrame, shortest: int = 20, probe: int = 40) -> DataFrame:
    """D-09: paragraphs of ``source`` (ms_id, idx, text) that no longer occur in ``kept`` (ms_id, text).

    A paragraph's key is its first ``probe`` letters and digits; shorter keys than
    ``shortest`` are not judged.  Paragraphs that kept their beginning are found by an
    equi-join on the key; only the rest is looked for inside its own document's text.
    """
    keyed = source.withColumn("key", F.left(T.match_key(F.col("text")), F.lit(probe))).where(F.length("key") >= shortest)
    texts = kept.withColumn("whole", T.match_key(F.col("text"))).select("ms_id", "whole")
    same = texts.select("ms_id", F.left("whole", F.lit(probe)).alias("key")).distinct()
    left = keyed.join(same, ["ms_id", "key"], "left_anti")
    inside = texts.alias("t")
    return left.alias("s").join(inside, (F.col("s.ms_id") == F.col("t.ms_id")) & F.contains(F.col("t.whole"), F.col("s.key")), "left_anti").drop("key")


def recovered(lost: DataFrame, starts: DataFrame) -> DataFrame:
    """D-10: the section of each lost paragraph: the last that begins before it, else the document's last.

    ``starts``: ms_id, idx, sec_id, with idx null for sections that cannot be placed.  As-of
    by one window over both kinds of rows.
    """
    final = starts.groupBy("ms_id").agg(F.max_by("sec_id", F.struct(F.col("idx").isNotNull(), "idx", "sec_id")).alias("final"))
    rows = starts.where("idx IS NOT NULL").select("ms_id", "idx", F.lit(0).alias("kind"), "sec_id", F.lit(None).cast("string").alias("text"))
    rows = rows.unionByName(lost.select("ms_id", "idx", F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["sec_id"].dataType).alias("sec_id"), "text"))
    upto = Window.partitionBy("ms_id").orderBy("idx", "kind", "sec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("owner", F.last("sec_id", ignorenulls=True).over(upto)).where("kind = 1")
    return placed.join(final, "ms_id", "left").select("ms_id", "idx", "text", F.coalesce("owner", "final").alias("sec_id"))


def unreferenced(media: DataFrame, used: DataFrame, on: str | list[str]) -> DataFrame:
    """A-07, D-20: rows that nothing refers to."""
    return media.join(used, on, "left_anti")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """H-56, B-14: ms_id, lost: distinct paragraphs of ``before`` that ``after`` lacks."""
    gone = before.select("ms_id", "text").distinct().exceptAll(after.select("ms_id", "text").distinct())
    return gone.groupBy("ms_id").agg(F.count("*").alias("lost"))


def with_faults(paragraphs: DataFrame, seed: int = 7, share: float = 0.1) -> DataFrame:
    """H-57: paragraphs with seeded faults, named in ``fault``: dropped (text null), truncated, duplicated (copies 2) or none.

    The draw is a hash of the row's key and the seed: the same everywhere and every time.
    """
    draw = F.pmod(F.xxhash64("ms_id", "idx", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    fault = F.when(draw < share / 3, "drop").when(draw < 2 * share / 3, "truncate").when(draw < share, "duplicate").otherwise("none")
    text = F.when(fault == "drop", F.lit(None)).when(fault == "truncate", F.left("text", (F.length("text") / 2).cast("int"))).otherwise(F.col("text"))
    return paragraphs.withColumn("fault", fault).withColumn("text", text).withColumn("copies", F.when(fault == "duplicate", 2).otherwise(1))


def fault_tally(faulty: DataFrame, original: DataFrame) -> DataFrame:
    """E-22: how many faults of each kind were made, and how many a comparison of texts sees."""
    both = faulty.join(original.select("ms_id", "idx", F.col("text").alias("before")), ["ms_id", "idx"])
    seen = F.coalesce(F.col("text") != F.col("before"), F.col("before").isNotNull()) | (F.col("copies") > 1)
    return both.where("fault <> 'none'").groupBy("fault").agg(F.count("*").alias("applied"), F.count_if(seen).alias("detected"))


def totals(rows: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """E-16: a row for each key and one, with a null key, for all; failures stay in and add nothing."""
    return rows.rollup(key).agg(F.count("*").alias("rows"), *[F.sum(F.col(c).try_cast("long")).alias(c) for c in counts])


def mode(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """E-11: the most frequent value of each group; of equally frequent ones the smallest."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))
    return counted.withColumn("place", first).where("place = 1").drop("place")


def emitted_counts(text: Column) -> Column:
    """E-17: Struct of counters over produced LaTeX text; preamble left out."""
    body = F.substring_index(text, "\\begin{document}", -1)
    count = lambda p: F.regexp_count(body, F.lit(p)).cast("long")
    return F.struct(
        count(r"\\(?:sub)*section\*?\{").alias("sections"), count(r"\\begin\{equation").alias("equations"), count(r"\\includegraphics").alias("images"), count(r"\\begin\{tabular").alias("tables"),
        count(r"\\bibitem").alias("references"), T.word_count(F.regexp_replace(body, r"\\[a-zA-Z]+\*?", " ")).alias("words"),
    )


def distinct_paragraphs(paragraphs: DataFrame, least: int = 25) -> DataFrame:
    """H-55: a document's paragraphs of ``least`` characters and more, each text once, the first."""
    key = T.normal_space(F.col("text"))
    first = F.row_number().over(Window.partitionBy("ms_id", "key").orderBy("idx"))
    return paragraphs.withColumn("key", key).where(F.length("key") >= least).withColumn("n", first).where("n = 1").drop("n", "key")
