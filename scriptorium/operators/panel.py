"""Findings of reviewers: parsed, held against the manuscript, merged and ranked.

Order-dependent steps go by ``seq``, an explicit order, so reruns agree.  Calls to models
are not made here; their answers come in as a table.
"""

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import text as T
from scriptorium.session import ship

SHORTEST_QUOTE = 20
#: Quotes are nested-loop joined up to this many; beyond, by word anchors.
FEW_QUOTES = 5_000
ANCHOR = 5
_ITEM = "findings array<struct<issue:string,why:string,fix:string,quote:string,section:string,severity:string>>"


def parse_findings(runs: DataFrame) -> DataFrame:
    """H-38: a row for each finding in a raw answer, at most 20 an answer; malformed answers have none.

    ``runs``: ms_id, provider, reviewer, raw.  Fences are dropped and the outermost braces
    are read as JSON; items that are not objects or have no issue are left out.
    """
    body = F.regexp_extract(F.regexp_replace(F.trim("raw"), r"(?s)^```(?:json)?\s*|\s*```$", ""), r"(?s)\{.*\}", 0)
    items = F.slice(F.from_json(body, _ITEM)["findings"], 1, 20)
    rows = runs.select("ms_id", "provider", "reviewer", F.posexplode(items).alias("item_no", "f")).where("f.issue IS NOT NULL AND f.issue <> ''")
    cut = lambda c, n: F.left(F.coalesce(F.col(f"f.{c}"), F.lit("")), F.lit(n))
    severity = F.when(F.startswith(F.lower(F.coalesce("f.severity", F.lit("minor"))), F.lit("maj")), "major").otherwise("minor")
    return rows.select("ms_id", "provider", "reviewer", "item_no", cut("issue", 400).alias("issue"), cut("why", 400).alias("why"), cut("fix", 400).alias("fix"), cut("quote", 400).alias("quote"), cut("section", 120).alias("section"), severity.alias("severity"))


def jobs(providers: DataFrame, reviewers: DataFrame, known: DataFrame) -> DataFrame:
    """D-15: every provider with every reviewer that is known."""
    return providers.crossJoin(reviewers.join(known, "reviewer", "left_semi"))


def grounded(quotes: DataFrame, texts: DataFrame, few: int = FEW_QUOTES) -> DataFrame:
    """D-16: (quote_id, ms_id) for quotes that a text contains, both in the form quotes are compared in.

    ``quotes``: quote_id, quote; ``texts``: ms_id, text.  Quotes under 20 characters ground
    nothing.  Up to ``few`` quotes are broadcast and looked for in every text; more are
    joined on the rarest of their five-word sequences first and looked for only where that
    occurs, except those too short to have one.
    """
    keyed = quotes.select("quote_id", T.quote_key(F.col("quote")).alias("q")).where(F.length("q") >= SHORTEST_QUOTE)
    whole = texts.select("ms_id", T.quote_key(F.col("text")).alias("t"))
    found = F.contains(F.col("t"), F.col("q"))
    if keyed.limit(few + 1).count() <= few:
        return whole.join(F.broadcast(keyed), found).select("quote_id", "ms_id")
    # the first and last word may be cut: anchors are whole words between them
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - ANCHOR + 1), lambda i: F.xxhash64(F.array_join(F.slice(c, i, ANCHOR), " ")))
    inner = keyed.withColumn("w", F.split("q", " ")).withColumn("w", F.slice("w", 2, F.greatest(F.lit(0), F.size("w") - 2)))
    long = inner.where(F.size("w") >= ANCHOR).select("quote_id", "q", F.explode(F.array_distinct(runs(F.col("w")))).alias("anchor"))
    short = inner.where(F.size("w") < ANCHOR).select("quote_id", "q")
    parts = whole.withColumn("w", F.split("t", " ")).where(F.size("w") >= ANCHOR).select("ms_id", F.explode(F.array_distinct(runs(F.col("w")))).alias("anchor"))
    common = parts.join(long.select("anchor").distinct(), "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("n"))
    rarest = long.join(common, "anchor").withColumn("place", F.row_number().over(Window.partitionBy("quote_id").orderBy("n", "anchor"))).where("place = 1").select("quote_id", "q", "anchor")
    candidates = parts.join(rarest, "anchor").join(whole, "ms_id").where(found).select("quote_id", "ms_id")
    return candidates.unionByName(whole.join(short, found).select("quote_id", "ms_id"))


def resembles(quote: Column, text: Column) -> Column:
    """F-06: whether some window of a text is like a quote, by 0.92 or more; only for quotes that exact search missed.

    Windows are as long as the quote and step by a quarter of it; a cheap upper bound
    spares most comparisons.  Both sides are in the form of ``quote_key``.
    """

    def like(q: str, t: str) -> bool:
        if q is None or t is None or len(q) < SHORTEST_QUOTE:
            return False
        matcher = difflib.SequenceMatcher(None)
        matcher.set_seq1(q)
        for at in range(0, max(1, len(t) - len(q) + 1), max(1, len(q) // 4)):
            matcher.set_seq2(t[at : at + len(q)])
            if matcher.quick_ratio() >= 0.84 and matcher.ratio() >= 0.92:
                return True
        return False

    def judge(quotes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([like(q, t) for q, t in zip(quotes, texts)], dtype=bool)

    return F.pandas_udf(judge, "boolean")(quote, text)


def verified(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds grounded: the quote occurs in its own manuscript, exactly or nearly."""
    ship(findings.sparkSession)
    q, t = T.quote_key(F.col("quote")), F.col("haystack")
    rows = findings.join(texts.select("ms_id", T.quote_key(F.col("text")).alias("haystack")), "ms_id", "left")
    long = F.length(q) >= SHORTEST_QUOTE
    exact = F.coalesce(long & F.contains(t, q), F.lit(False))
    nearly = resembles(F.when(long & ~exact, q), F.when(long & ~exact, t))
    return rows.withColumn("grounded", exact | F.coalesce(nearly, F.lit(False))).drop("haystack")


def located(quotes: DataFrame, context: DataFrame) -> DataFrame:
    """D-17: (quote_id, section): the first part of the context that holds the quote, '' if none does.

    ``context``: ms_id, part_no, section, text; ``quotes``: quote_id, ms_id, quote.
    """
    q = T.quote_key(F.col("quote"))
    rows = quotes.withColumn("q", q).where(F.length("q") >= SHORTEST_QUOTE).join(context.select("ms_id", "part_no", "section", T.quote_key(F.col("text")).alias("t")), "ms_id")
    first = rows.where(F.contains("t", F.col("q"))).groupBy("quote_id").agg(F.min_by("section", "part_no").alias("section"))
    return quotes.select("quote_id").join(first, "quote_id", "left").select("quote_id", F.coalesce("section", F.lit("")).alias("section"))


def groundedness(findings: DataFrame) -> DataFrame:
    """E-10: the mean over runs of the share of grounded findings; runs without findings do not count."""
    runs = findings.groupBy("ms_id", "provider", "reviewer").agg(F.avg(F.col("grounded").cast("double")).alias("rate"))
    return runs.groupBy("ms_id").agg(F.avg("rate").alias("groundedness"), F.count("*").alias("runs"))


def clusters(findings: DataFrame, threshold: float = 0.55) -> DataFrame:
    """F-07: adds leader, the seq of the first finding like this one: in order, each joins the first leader it resembles.

    A manuscript's findings meet in one task: some dozens, 20 for each reviewer at most.
    ``findings`` has ms_id, seq, issue, fix.
    """
    ship(findings.sparkSession)
    keyed = findings.select("ms_id", "seq", T.quote_key(F.concat_ws(" ", "issue", "fix")).alias("key"))
    id_type = findings.schema["ms_id"].dataType.simpleString()
    seq_type = findings.schema["seq"].dataType.simpleString()

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple] = []
        found = []
        group = group.sort_values("seq")
        for seq, key in zip(group["seq"], group["key"]):
            leader = next((s for s, k in leaders if difflib.SequenceMatcher(None, key, k).ratio() >= threshold), None)
            if leader is None:
                leaders.append((seq, key))
                leader = seq
            found.append(leader)
        return pd.DataFrame({"ms_id": group["ms_id"], "seq": group["seq"], "leader": found})

    placed = keyed.groupBy("ms_id").applyInPandas(assign, f"ms_id {id_type}, seq {seq_type}, leader {seq_type}")
    return findings.join(placed, ["ms_id", "seq"])


def merged(clustered: DataFrame) -> DataFrame:
    """E-12, E-13, F-08: one finding for each cluster, with the reviewers that agree, ranked.

    The longest-reasoned finding speaks for its cluster, the first of equals; severity is
    major if any of them is; agreement counts distinct reviewers, not findings.
    """
    by = Window.partitionBy("ms_id", "leader")
    length = F.length(F.coalesce("why", F.lit(""))) + F.length("fix")
    rows = clustered.withColumn("place", F.row_number().over(by.orderBy(F.desc(length), "seq"))).withColumn("any_major", F.max((F.col("severity") == "major").cast("int")).over(by))
    agents = clustered.groupBy("ms_id", "leader").agg(F.array_sort(F.collect_set(F.concat_ws("/", "provider", "reviewer"))).alias("agreed_by"))
    chosen = rows.where("place = 1").join(agents, ["ms_id", "leader"])
    chosen = chosen.withColumn("agreement", F.size("agreed_by")).withColumn("severity", F.when(F.col("any_major") == 1, "major").otherwise("minor"))
    chosen = chosen.withColumn("specificity", F.round(usefulness(F.lit(None).cast("double"), F.col("issue"), F.col("fix"), F.coalesce("quote", F.lit(""))), 3))
    return ranked(chosen).drop("place", "any_major")


def ranked(findings: DataFrame) -> DataFrame:
    """F-08: adds rank: most agreement, then severity, then specificity, then the order they came in."""
    order = Window.partitionBy("ms_id").orderBy(F.desc("agreement"), F.when(F.col("severity") == "major", 0).otherwise(1), F.desc("specificity"), "seq")
    return findings.withColumn("rank", F.row_number().over(order))


def usefulness(predicted: Column, issue: Column, fix: Column, quote: Column) -> Column:
    """K-13: a trained model's probability if there is one, else the wording's specificity."""
    return F.coalesce(predicted, T.specificity(issue, fix, quote))


def slowest(runs: DataFrame, most: int = 6) -> DataFrame:
    """F-12: the runs that took longest."""
    return runs.orderBy(F.desc("seconds"), "run_id").limit(most)


def context(manuscripts: DataFrame, sections: DataFrame, budget: int = 60_000) -> DataFrame:
    """K-10, F-17: ms_id, part_no, section, text: what a referee is given of a manuscript.

    ``sections``: ms_id, sec_ord, role, title_raw, text (subsections included).  Sections that
    come elsewhere are left out.  Only if all do not fit, each is abridged in proportion,
    never below 600 characters: its opening to a sentence end, and its closing.
    """
    front = manuscripts.select("ms_id", F.length(F.concat_ws("", "title", "abstract_raw", F.array_join("keywords", ", "))).alias("used"))
    rows = sections.where(~F.col("role").isin(*P.FRONT_MATTER_ELSEWHERE) & (F.col("text") != "")).join(front, "ms_id")
    room = F.greatest(F.lit(1000), F.lit(budget) - F.col("used"))
    total = F.sum(F.length("text")).over(Window.partitionBy("ms_id"))
    n = F.length("text")
    allowance = F.when(total <= room, n).otherwise(F.greatest(F.lit(600), F.floor(room * n / total).cast("int")))
    rows = rows.withColumn("allowance", allowance.cast("int"))
    head = F.left("text", (F.col("allowance") * 0.6).cast("int"))
    opening = F.when(F.contains(head, F.lit(". ")), F.concat(F.regexp_replace(head, r"(?s)\. (?!.*\. ).*$", ""), F.lit("."))).otherwise(F.concat(head, F.lit(".")))
    tail = F.right(F.col("text"), (F.col("allowance") * 0.4).cast("int"))
    closing = F.regexp_replace(tail, r"(?s)^.*?\. ", "")
    text = F.when(n > F.col("allowance"), F.concat(opening, F.lit("\n[... section abridged ...]\n"), closing)).otherwise(F.col("text"))
    title = F.coalesce(F.nullif("title_raw", F.lit("")), F.concat(F.lit("("), F.col("role"), F.lit(")")))
    return rows.select("ms_id", F.row_number().over(Window.partitionBy("ms_id").orderBy("sec_ord")).alias("part_no"), title.alias("section"), text.alias("text"))


def reviewed(runs: DataFrame, texts: DataFrame, parts: DataFrame) -> DataFrame:
    """K-11: answers to ranked findings: parsed, verified, placed in their sections, merged; what is not in the text is withheld.

    ``runs``: ms_id, provider, reviewer, raw, error (runs that failed have no findings);
    ``texts``: ms_id, text; ``parts``: as :func:`context` gives them.
    """
    found = parse_findings(runs.where("error IS NULL"))
    order = Window.partitionBy("ms_id").orderBy("provider", "reviewer", "item_no")
    held = verified(found.withColumn("seq", F.row_number().over(order)), texts).where("grounded")
    keyed = held.withColumn("quote_id", F.concat_ws("/", F.col("ms_id").cast("string"), F.col("seq").cast("string")))
    placed = keyed.drop("section").join(located(keyed.select("quote_id", "ms_id", "quote"), parts), "quote_id").drop("quote_id")
    return merged(clusters(placed))
