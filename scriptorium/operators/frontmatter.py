"""Title, authors, affiliations, abstract and keywords out of a manuscript's first paragraphs.

Each value keeps the string it came from, how it was found and how sure that is; what is not
found becomes an issue row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import text as T

# --- fixed values: how keywords, authors and institutions show ---
RUN_IN_KEYWORDS = r"^\s*(key\s*words?|index terms?)\s*[:\-–]"
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹ᵃᵇᶜ⁺⁻", "0123456789abc+-")
INSTITUTION = r"universit|institut|laborator|department|faculty|college|school|centre|center|academy|LTD|inc\."


def title(core: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """H-20: ms_id, title, method: the document's own property, a paragraph styled Title, or the first plausible one.

    Plausible among the first 25: 12 to 300 characters, no address, no section name, no
    template furniture, and before any line of authors, abstract or keywords.
    ``core``: ms_id, title; ``paragraphs``: ms_id, idx, text, style.
    """
    t = T.normal_space(F.col("text"))
    styled = F.min(F.when((F.col("idx") < 40) & F.lower("style").isin("title", "titre") & (t != ""), F.struct("idx", T.stripped(F.col("text")).alias("t"))))
    good = (F.col("idx") < 25) & F.length(t).between(12, 300) & ~T.matches(t, P.EMAIL) & (T.role_of(t) == "unknown") & T.furniture_label(t).isNull()
    stops = good & ((F.regexp_count(t, F.lit(r"[A-Za-z][\d*†]")) >= 2) | F.lower(t).rlike("^(abstract|keywords)"))
    marks = paragraphs.groupBy("ms_id").agg(styled.alias("styled"), F.min(F.when(stops, F.col("idx"))).alias("stop"), F.min(F.when(good & ~stops, F.struct("idx", t.alias("t")))).alias("plausible"))
    own = F.nullif(T.stripped(F.coalesce("title", F.lit(""))), F.lit(""))
    guess = F.when(F.col("stop").isNull() | (F.col("plausible.idx") < F.col("stop")), F.col("plausible.t"))
    rows = core.select("ms_id", own.alias("own")).join(marks, "ms_id", "full_outer")
    method = F.when(F.col("own").isNotNull(), "explicit").when(F.col("styled").isNotNull(), "style").when(guess.isNotNull(), "heuristic").otherwise("default")
    return rows.select("ms_id", F.coalesce("own", "styled.t", guess, F.lit("")).alias("title"), method.alias("method"))


def abstract(blocks: DataFrame) -> DataFrame:
    """H-19: ms_id, abstract_raw, paragraphs, split_keywords: the abstract without the keyword lines at its end.

    ``blocks``: ms_id, blk_ord, text of the abstract's paragraphs.
    """
    keyword = T.matches(T.stripped(F.col("text")), RUN_IN_KEYWORDS, True)
    last = F.max(F.when(~keyword, F.col("blk_ord"))).over(Window.partitionBy("ms_id"))
    rows = blocks.withColumn("last", last).withColumn("in_tail", F.col("last").isNull() | (F.col("blk_ord") > F.col("last")))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(~F.col("in_tail"), F.struct("blk_ord", "text")))), lambda r: r["text"])
    return rows.groupBy("ms_id").agg(T.stripped(F.array_join(ordered, " ")).alias("abstract_raw"), F.count_if(~F.col("in_tail")).alias("paragraphs"), F.count_if(F.col("in_tail")).alias("split_keywords"))


def keywords(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """H-18: ms_id, keywords: of the keywords section, else of the first run-in line anywhere."""
    firsts = sections.where("role = 'keywords'").groupBy("ms_id").agg(F.min("sec_ord").alias("sec_ord"))
    inside = blocks.join(firsts, ["ms_id", "sec_ord"]).groupBy("ms_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk_ord", "text"))), lambda r: r["text"]), " ").alias("line"))
    run_in = blocks.where(T.matches(F.col("text"), RUN_IN_KEYWORDS, True)).groupBy("ms_id").agg(F.min_by("text", F.struct("sec_ord", "blk_ord")).alias("run_in"))
    return inside.join(run_in, "ms_id", "full_outer").select("ms_id", T.split_keywords(F.coalesce("line", "run_in")).alias("keywords"))


def _chunks(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\s*,\s*|\s+and\s+"), T.stripped), lambda c: c != "")


def author_line(candidates: DataFrame) -> DataFrame:
    """H-21: ms_id, idx, line: the first of the front lines that looks like names with markers."""
    line = F.translate("text", *SUPERSCRIPTS)
    chunks = _chunks(line)
    marked = F.size(F.filter(chunks, lambda c: F.regexp_like(c, F.lit(r"[A-Za-z]\s*[\d*†a-c]\s*$"))))
    found = candidates.withColumn("line", line).where((F.size(chunks) >= 2) & (marked >= 2) & (F.length("line") < 400))
    return found.groupBy("ms_id").agg(F.min_by(F.struct("idx", "line"), "idx").alias("f")).select("ms_id", "f.*")


def authors(candidates: DataFrame) -> DataFrame:
    """H-21: a row for each author: ms_id, ord, raw, given, family, corresponding, affiliation_ids, confidence."""
    rows = author_line(candidates).select("ms_id", F.posexplode(_chunks(F.col("line"))).alias("pos", "raw"))
    markers = F.regexp_extract_all(F.right(F.col("raw"), F.lit(4)), F.lit(r"([\d*†])"), 1)
    name = T.replaced(F.col("raw"), r"[\d*†\s]+$")
    parts = T.words(name)
    n = F.size(parts)
    return rows.where(name != "").select(
        "ms_id", (F.col("pos") + 1).alias("ord"), "raw", F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), n - 1)), " ").alias("given"), T.at(parts, -1).alias("family"),
        F.array_contains(markers, "*").alias("corresponding"), F.transform(F.filter(markers, lambda m: F.regexp_like(m, F.lit(r"^\d$"))), lambda m: F.concat(F.lit("aff"), m)).alias("affiliation_ids"), F.lit(0.5).alias("confidence"),
    )


def affiliations(candidates: DataFrame) -> DataFrame:
    """H-22, H-23: front lines that name an institution, once for each marker."""
    lines = candidates.withColumn("line", F.translate("text", *SUPERSCRIPTS)).where(T.matches(F.col("line"), INSTITUTION, True))
    lines = lines.join(author_line(candidates).select("ms_id", "idx"), ["ms_id", "idx"], "left_anti")
    marked = r"^\s*([\d*†])\s*[.\-)]?\s*(.+)$"
    marker = F.regexp_extract(T.stripped(F.col("line")), marked, 1)
    rest = T.stripped(F.when(marker != "", F.regexp_extract(T.stripped(F.col("line")), marked, 2)).otherwise(F.col("line")))
    place = F.row_number().over(Window.partitionBy("ms_id").orderBy("idx")).cast("string")
    rows = lines.withColumn("marker", marker).withColumn("raw", rest).withColumn("aff_id", F.concat(F.lit("aff"), F.when(F.col("marker") != "", F.col("marker")).otherwise(place)))
    first = F.row_number().over(Window.partitionBy("ms_id", "aff_id").orderBy("idx"))
    return rows.withColumn("n", first).where("n = 1").select("ms_id", "idx", "aff_id", "marker", "raw", T.guess_country(F.col("raw")).alias("country"))


def references(entries: DataFrame) -> DataFrame:
    """H-16: ms_id, ord, ref_id and the parsed parts of every reference.

    ``entries``: ms_id, idx, text of the paragraphs of the reference section.  Lines that
    only continue an entry join it; entries that run together are cut.
    """
    from scriptorium.operators.tree import continued

    marked = entries.withColumn("is_marked", T.matches(F.col("text"), P.REFERENCE_MARKER))
    parts = continued(marked).select("ms_id", "entry", F.posexplode(T.split_run_on(F.col("text"))).alias("part", "raw"))
    ord_ = F.row_number().over(Window.partitionBy("ms_id").orderBy("entry", "part"))
    rows = parts.withColumn("ord", ord_).withColumn("ref_id", F.concat(F.lit("ref"), F.col("ord").cast("string")))
    return rows.select("ms_id", "ord", "ref_id", F.inline(F.array(T.parse_reference(F.col("raw")))))


def reference_issues(refs: DataFrame, sections: DataFrame, citations: DataFrame) -> DataFrame:
    """2.M: no_references, low_confidence_refs, no_dois, manual_citations.  ``citations``: ms_id of those with citation fields."""
    every = sections.select("ms_id").distinct()
    counted = refs.groupBy("ms_id").agg(F.count_if(F.col("confidence") < 0.6).alias("low"), F.count_if(F.col("doi") != "").alias("dois"), F.count("*").alias("n"))
    fields = citations.select("ms_id").distinct().withColumn("fields", F.lit(True))
    rows = every.join(counted, "ms_id", "left").join(fields, "ms_id", "left")
    some = F.col("n").isNotNull()
    issue = lambda when, severity, code: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    made = F.array(issue(~some, "error", "no_references"), issue(some & (F.col("low") > 0), "warning", "low_confidence_refs"), issue(some & (F.col("dois") == 0), "warning", "no_dois"), issue(F.col("fields").isNull(), "warning", "manual_citations"))
    return rows.select("ms_id", F.explode(made).alias("i")).where("i IS NOT NULL").select("ms_id", "i.*")


def front_issues(titles: DataFrame, abstracts: DataFrame, keyword_lists: DataFrame, people: DataFrame, manuscripts: DataFrame) -> DataFrame:
    """2.M: title_heuristic, no_title, no_abstract, keywords_split_from_abstract, no_keywords, authors_heuristic, no_authors."""
    named = people.groupBy("ms_id").agg(F.count("*").alias("authors"))
    rows = manuscripts.select("ms_id").join(titles.select("ms_id", "title", "method"), "ms_id", "left").join(abstracts.select("ms_id", "abstract_raw", "split_keywords"), "ms_id", "left")
    rows = rows.join(keyword_lists, "ms_id", "left").join(named, "ms_id", "left")
    issue = lambda when, severity, code: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    made = F.array(
        issue(F.col("method") == "heuristic", "warning", "title_heuristic"), issue(F.coalesce("title", F.lit("")) == "", "error", "no_title"),
        issue(F.coalesce("abstract_raw", F.lit("")) == "", "error", "no_abstract"), issue(F.col("split_keywords") > 0, "info", "keywords_split_from_abstract"),
        issue(F.coalesce(F.size("keywords"), F.lit(0)) <= 0, "warning", "no_keywords"),
        issue(F.col("authors") > 0, "warning", "authors_heuristic"), issue(F.col("authors").isNull(), "error", "no_authors"),
    )
    return rows.select("ms_id", F.explode(made).alias("i")).where("i IS NOT NULL").select("ms_id", "i.*")
