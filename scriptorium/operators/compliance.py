"""Rules of a publisher's profile, evaluated for every manuscript.

A profile is a row and a rule a projected struct: facts of each manuscript, one row, meet
each profile, one row, and a rule whose limit is not set gives no finding.  Manuscripts
that differ in size do not matter here; facts are one row each by then.  Every manuscript
with every profile is the result itself, so that product is no detour; whether profiles are
broadcast for it is left to their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import text as T

PASS, WARN, FAIL, INFO = "pass", "warn", "fail", "info"

PROFILE_FIELDS = {
    "profile_id": "string", "publisher": "string", "journal": "string", "verified": "boolean", "scope_keywords": "array<string>",
    "abstract_max_words": "int", "abstract_min_words": "int", "abstract_paragraphs_max": "int", "keywords_min": "int", "keywords_max": "int",
    "highlights_required": "boolean", "highlights_min": "int", "highlights_max": "int", "highlights_max_chars": "int", "title_max_chars": "int",
    "manuscript_max_words": "int", "required_sections": "array<string>", "forbidden_sections": "array<string>", "section_order": "array<string>",
    "rejected_formats": "array<string>", "dpi_halftone": "int", "min_px_single_column": "int", "single_column_mm": "double", "double_column_mm": "double",
    "doi_required": "boolean", "max_references": "int", "columns": "int",
}
#: fixed values: what a profile that does not say has
PROFILE_DEFAULTS = {
    "verified": False, "highlights_required": False, "doi_required": False, "dpi_halftone": 300, "single_column_mm": 90.0, "double_column_mm": 190.0,
    "columns": 1, "scope_keywords": [], "required_sections": [], "forbidden_sections": [], "section_order": [], "rejected_formats": ["bmp", "gif", "wmf", "emf"],
}


def profiles(spark, rows: list[dict]) -> DataFrame:
    """Profiles as a table; fields that a row does not name have their defaults or are null."""
    schema = ", ".join(f"{n} {t}" for n, t in PROFILE_FIELDS.items())
    return spark.createDataFrame([tuple(r.get(n, PROFILE_DEFAULTS.get(n)) for n in PROFILE_FIELDS) for r in rows], schema)


def override(*sources: DataFrame) -> DataFrame:
    """A-15, D-18: profiles of several sources; of one id the last source's counts."""
    every = sources[0].withColumn("rank", F.lit(0))
    for n, more in enumerate(sources[1:], 1):
        every = every.unionByName(more.withColumn("rank", F.lit(n)))
    return every.withColumn("n", F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("rank")))).where("n = 1").drop("n", "rank")


def profile(table: DataFrame, profile_id: str) -> DataFrame:
    """A-16: one profile; an unknown id raises KeyError that lists those there are."""
    found = table.where(F.col("profile_id") == profile_id)
    if found.isEmpty():
        known = [r.profile_id for r in table.select("profile_id").orderBy("profile_id").limit(1000).collect()]
        raise KeyError(f"no profile {profile_id!r}; there are {', '.join(known)}")
    return found


def required_pixels(millimetres: Column, dpi: Column) -> Column:
    return F.bround(millimetres / 25.4 * dpi).cast("int")


def verdict(ok: Column, hard: bool = True) -> Column:
    """C-01: a limit that is not verified warns and never fails."""
    failed = F.when(F.col("verified"), FAIL).otherwise(WARN) if hard else F.lit(WARN)
    return F.when(ok, PASS).otherwise(failed)


def _set(limit: str) -> Column:
    """A limit counts if it is neither null nor zero."""
    return F.coalesce(F.col(limit), F.lit(0)) != 0


def text_facts(manuscripts: DataFrame, sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each manuscript: its front matter, section roles and word counts."""
    whole = sections.groupBy("ms_id").agg(
        F.collect_set("role").alias("roles"),
        F.array_sort(F.collect_list(F.when(F.col("level") == 1, F.struct("sec_ord", "role", "title_raw")))).alias("tops"),
    )
    text = blocks.where("kind = 'paragraph'").groupBy("ms_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"))
    return front_facts(manuscripts.join(whole, "ms_id", "left").join(text, "ms_id", "left"))


def front_facts(facts: DataFrame) -> DataFrame:
    """Manuscripts with roles (all their sections'), tops (sec_ord, role, title_raw of those of level 1) and words, as :func:`text_facts` gives them."""
    none = F.array().cast("array<string>")
    front = F.concat(F.when(T.stripped(F.col("abstract_raw")) != "", F.array(F.lit("abstract"))).otherwise(none), F.when(F.size("keywords") > 0, F.array(F.lit("keywords"))).otherwise(none))
    present = F.array_union(F.coalesce("roles", none), front)
    present = F.when(F.array_contains(present, "results_discussion"), F.array_union(present, F.array(F.lit("results"), F.lit("discussion")))).otherwise(present)
    return facts.withColumns({
        "present": present, "words": F.coalesce("words", F.lit(0)),
        "abstract_words": T.word_count(T.stripped(F.coalesce("abstract_raw", F.lit("")))),
        "unlabelled": F.coalesce(F.size(F.filter("tops", lambda s: (s["role"] == "unknown") & (s["title_raw"] != ""))), F.lit(0)),
        "top_roles": F.coalesce(F.transform("tops", lambda s: s["role"]), none),
    }).drop("roles", "tops")


def _finding(severity: Column, rule: str, observed: Column, limit: Column, locations: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(severity.alias("severity"), F.lit(rule).alias("rule"), observed.cast("double").alias("observed"), limit.cast("double").alias("allowed"), (none if locations is None else locations).alias("locations"))


def _rows(facts: DataFrame, rules: list[Column]) -> DataFrame:
    return facts.select("ms_id", "profile_id", F.posexplode(F.array(*rules)).alias("seq", "f")).where("f IS NOT NULL").select("ms_id", "profile_id", "f.*")


def text_findings(facts: DataFrame, table: DataFrame) -> DataFrame:
    """C-02 to C-14: rules on front matter and structure, a row for each that applies."""
    both = facts.crossJoin(table)
    empty = F.col("abstract_words") == 0
    n_keywords = F.size(F.coalesce("keywords", F.array()))
    low, high = F.coalesce(F.nullif("keywords_min", F.lit(0)), F.lit(0)), F.coalesce(F.nullif("keywords_max", F.lit(0)), F.lit(99))
    marks = F.coalesce("highlights", F.array().cast("array<string>"))
    over = F.size(F.filter(marks, lambda h: F.length(h) > F.col("highlights_max_chars")))
    missing = F.array_except("required_sections", "present")
    forbidden = F.array_intersect("forbidden_sections", "present")
    ranks = F.transform(F.filter("top_roles", lambda r: F.array_contains("section_order", r)), lambda r: F.array_position("section_order", r))
    null = F.lit(None)
    rules = [
        F.when(empty, _finding(F.lit(FAIL), "abstract.present", F.lit(0), null)),
        F.when(~empty & _set("abstract_max_words"), _finding(verdict(F.col("abstract_words") <= F.col("abstract_max_words")), "abstract.max_words", F.col("abstract_words"), F.col("abstract_max_words"))),
        F.when(~empty & _set("abstract_min_words"), _finding(verdict(F.col("abstract_words") >= F.col("abstract_min_words"), hard=False), "abstract.min_words", F.col("abstract_words"), F.col("abstract_min_words"))),
        F.when(~empty & _set("abstract_paragraphs_max"), _finding(verdict(F.col("abstract_paragraphs") <= F.col("abstract_paragraphs_max")), "abstract.paragraphs", F.col("abstract_paragraphs"), F.col("abstract_paragraphs_max"))),
        F.when(~empty & F.col("abstract_has_math"), _finding(F.lit(WARN), "abstract.no_math", F.lit(1), F.lit(0))),
        F.when(_set("keywords_min") | _set("keywords_max"), _finding(verdict(n_keywords.between(low, high)), "keywords.count", n_keywords, high)),
        F.when(F.col("highlights_required") & (F.size(marks) == 0), _finding(F.when(F.col("verified"), FAIL).otherwise(WARN), "highlights.present", F.lit(0), F.lit(1))),
        F.when(F.col("highlights_required") & (F.size(marks) > 0), _finding(verdict(F.size(marks).between(F.coalesce(F.nullif("highlights_min", F.lit(0)), F.lit(1)), F.coalesce(F.nullif("highlights_max", F.lit(0)), F.lit(99)))), "highlights.count", F.size(marks), F.col("highlights_max"))),
        F.when(F.col("highlights_required") & (F.size(marks) > 0) & _set("highlights_max_chars"), _finding(verdict(over == 0), "highlights.length", over, F.col("highlights_max_chars"))),
        F.when(_set("title_max_chars") & (F.col("title") != ""), _finding(verdict(F.length("title") <= F.col("title_max_chars")), "title.length", F.length("title"), F.col("title_max_chars"))),
        _finding(F.when((F.size(missing) > 0) & (F.col("unlabelled") > 0), WARN).otherwise(verdict(F.size(missing) == 0)), "structure.required_sections", F.size(missing), F.lit(0), F.array_sort(missing)),
        F.when(F.size(forbidden) > 0, _finding(F.lit(WARN), "structure.forbidden_sections", F.size(forbidden), F.lit(0), F.array_sort(forbidden))),
        F.when(F.size("section_order") > 0, _finding(verdict(ranks == F.array_sort(ranks), hard=False), "structure.section_order", F.size(ranks), null)),
        F.when(_set("manuscript_max_words"), _finding(verdict(F.col("words") <= F.col("manuscript_max_words")), "structure.length", F.col("words"), F.col("manuscript_max_words"))),
    ]
    return _rows(both, rules)


def effective_dpi(pixels: Column, millimetres: Column) -> Column:
    """At the size a figure is printed; null where it has no size."""
    return F.try_divide(pixels, F.nullif(millimetres, F.lit(0.0)) / 25.4)


def figure_facts(figures: DataFrame, tables: DataFrame, table: DataFrame, manuscripts: DataFrame) -> DataFrame:
    """A row for each manuscript and profile: ids of its figures by what is wrong with them."""
    needed = F.coalesce(F.nullif("min_px_single_column", F.lit(0)), required_pixels(F.col("single_column_mm"), F.col("dpi_halftone")))
    measured = ~F.col("is_vector") & (F.coalesce("width_px", F.lit(0)) != 0)
    placed = F.coalesce("placed_width_mm", F.lit(0.0)) != 0
    low = measured & F.when(placed, effective_dpi(F.col("width_px"), F.col("placed_width_mm")) < F.col("dpi_halftone")).otherwise(F.col("width_px") < needed)
    rejected = F.array_contains(F.transform("rejected_formats", lambda f: F.lower(f)), F.lower("fmt"))
    ids = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.col("fig_id"))))
    found = figures.crossJoin(table).groupBy("ms_id", "profile_id").agg(
        F.count("*").alias("figures"), ids(rejected).alias("rejected"), ids(low).alias("low"), ids(~F.col("is_vector") & ~measured).alias("unmeasured"),
        ids(F.coalesce("caption_raw", F.lit("")) == "").alias("uncaptioned"), F.array_sort(F.collect_set(F.when(rejected | (low & placed), F.col("fig_id")))).alias("unfit"),
    )
    bare = tables.groupBy("ms_id").agg(F.count("*").alias("tables"), F.array_sort(F.collect_list(F.when(F.coalesce("caption_raw", F.lit("")) == "", F.col("tab_id")))).alias("bare_tables"))
    every = manuscripts.select("ms_id").crossJoin(table.select("profile_id", "verified", "dpi_halftone"))
    return every.join(found, ["ms_id", "profile_id"], "left").join(bare, "ms_id", "left")


def figure_findings(facts: DataFrame) -> DataFrame:
    """C-21 to C-25.  Without figures there is one info row, and no rule on figures or tables."""
    some = F.coalesce("figures", F.lit(0)) > 0
    hard = lambda c: F.when(F.size(c) == 0, PASS).when(F.col("verified"), FAIL).otherwise(WARN)
    soft = lambda c: F.when(F.size(c) == 0, PASS).otherwise(WARN)
    null = F.lit(None)
    rules = [
        F.when(~some, _finding(F.lit(INFO), "figures.present", F.lit(0), null)),
        F.when(some, _finding(hard("rejected"), "figures.format", F.size("rejected"), F.lit(0), F.col("rejected"))),
        F.when(some, _finding(hard("low"), "figures.resolution", F.size("low"), F.lit(0), F.col("low"))),
        F.when(some & (F.size("unmeasured") > 0), _finding(F.lit(INFO), "figures.resolution_unknown", F.size("unmeasured"), null, F.col("unmeasured"))),
        F.when(some, _finding(soft("uncaptioned"), "figures.caption", F.size("uncaptioned"), F.lit(0), F.col("uncaptioned"))),
        F.when(some & (F.size("bare_tables") > 0), _finding(F.lit(WARN), "tables.caption", F.size("bare_tables"), F.lit(0), F.col("bare_tables"))),
    ]
    return _rows(facts, rules)


def reference_facts(manuscripts: DataFrame, refs: DataFrame, issues: DataFrame) -> DataFrame:
    """A row for each manuscript: counts over its references, and whether citations are hand-typed."""
    first = lambda condition: F.slice(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("ord", "ref_id")))), lambda r: r["ref_id"]), 1, 20)
    found = refs.groupBy("ms_id").agg(
        F.count("*").alias("refs"), F.count_if(F.coalesce("doi", F.lit("")) == "").alias("no_doi"), F.count_if(F.col("confidence") < 0.6).alias("low_refs"),
        first(F.coalesce("doi", F.lit("")) == "").alias("no_doi_ids"), first(F.col("confidence") < 0.6).alias("low_ids"),
    )
    manual = issues.where("code = 'manual_citations'").select("ms_id").distinct().withColumn("manual", F.lit(True))
    return manuscripts.select("ms_id").join(found, "ms_id", "left").join(manual, "ms_id", "left")


def reference_findings(facts: DataFrame, table: DataFrame) -> DataFrame:
    """C-15 to C-19."""
    both = facts.crossJoin(table)
    some = F.coalesce("refs", F.lit(0)) > 0
    rules = [
        F.when(~some, _finding(F.lit(FAIL), "references.present", F.lit(0), F.lit(None))),
        F.when(some & F.col("doi_required"), _finding(verdict(F.col("no_doi") == 0, hard=False), "references.doi", F.col("no_doi"), F.lit(0), F.col("no_doi_ids"))),
        F.when(some & _set("max_references"), _finding(verdict(F.col("refs") <= F.col("max_references")), "references.count", F.col("refs"), F.col("max_references"))),
        F.when(some & (F.col("low_refs") > 0), _finding(F.lit(WARN), "references.parse_quality", F.col("low_refs"), F.lit(0), F.col("low_ids"))),
        F.when(some & F.coalesce("manual", F.lit(False)), _finding(F.lit(WARN), "references.field_codes", F.lit(1), F.lit(0))),
    ]
    return _rows(both, rules)


def carried_findings(issues: DataFrame, table: DataFrame) -> DataFrame:
    """C-20: errors of the parser that bear on compliance, each a warning."""
    kept = issues.where((F.col("severity") == "error") & F.col("code").isin(*P.CARRIED_ISSUES))
    return kept.crossJoin(table.select("profile_id")).select(
        "ms_id", "profile_id", F.lit(WARN).alias("severity"), F.concat(F.lit("parse."), "code").alias("rule"), F.lit(1.0).alias("observed"), F.lit(0.0).alias("allowed"), F.array().cast("array<string>").alias("locations")
    )


def findings(corpus: dict[str, DataFrame], table: DataFrame) -> DataFrame:
    """All rules for all manuscripts and profiles: ms_id, profile_id, severity, rule, observed, allowed, locations."""
    ms = corpus["manuscripts"]
    parts = [
        text_findings(text_facts(ms, corpus["sections"], corpus["blocks"]), table),
        figure_findings(figure_facts(corpus["figures"], corpus["tables"], table, ms)),
        reference_findings(reference_facts(ms, corpus["refs"], corpus["issues"]), table),
        carried_findings(corpus["issues"], table),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scores(found: DataFrame) -> DataFrame:
    """C-26, C-27: counts by severity, score = passes among what is decided (1 if nothing is), ready = no failure."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return found.groupBy("ms_id", "profile_id").agg(
        count(PASS).alias("passes"), count(WARN).alias("warnings"), count(FAIL).alias("failures"), count(INFO).alias("infos"),
        F.coalesce(F.try_divide(count(PASS), F.count_if(F.col("severity") != INFO)), F.lit(1.0)).alias("score"), (count(FAIL) == 0).alias("ready"),
    )


def report(found: DataFrame) -> DataFrame:
    """C-28: one text for each manuscript and profile, findings by severity in a fixed order."""
    rank = F.when(F.col("severity") == FAIL, 0).when(F.col("severity") == WARN, 1).when(F.col("severity") == INFO, 2).otherwise(3)
    line = F.concat(F.upper("severity"), F.lit(" ["), F.col("rule"), F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("rule"), line.alias("line")))), lambda x: x["line"])
    return found.groupBy("ms_id", "profile_id").agg(F.array_join(lines, "\n").alias("report"))


def matrix(found: DataFrame) -> DataFrame:
    """E-23: findings of every profile by severity, with a grand total (profile_id null)."""
    return found.rollup("profile_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in (PASS, WARN, FAIL, INFO)])
