"""Limits that authors' instructions state, mined sentence by sentence into a profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import text as T

# --- fixed values: limits outside these are not believed; how many sentences back a pattern may look ---
SANE = {
    "abstract_words": (50, 1000), "keyword_range": (1, 20), "keyword_max": (1, 20), "highlight_range": (1, 20), "highlight_chars": (40, 400),
    "title_chars": (20, 1000), "dpi": (72, 2400), "total_words": (500, 9999),
}
LOOK_BACK = {"abstract_words": 2, "keyword_range": 1, "keyword_max": 1}


def windows(sentences: Column, back: int) -> Column:
    """F-16: for each sentence of an array the text of it with ``back`` before it."""
    start = lambda i: F.greatest(i - back, F.lit(0))
    return F.transform(sentences, lambda s, i: F.array_join(F.slice(sentences, start(i) + 1, i - start(i) + 1), " ")) if back else sentences


def first_hit(read: Column, what: str) -> Column:
    """F-16: struct w, i: the first text of an array that a pattern of a limit matches, and its place; or null."""
    any_of = lambda w: reduce(lambda x, y: x | y, [T.matches(w, p, True) for p in P.MINED_LIMITS[what]])
    return T.at(F.filter(F.transform(read, lambda w, i: F.when(any_of(w), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull()), 1)


def numbers_of(text: Column, what: str) -> Column:
    """H-30: struct a, b: the numbers that the first matching pattern of a limit finds."""
    number = lambda p, n: T.extracted(text, p, n, True).try_cast("int")
    return F.coalesce(*[
        F.when(T.matches(text, p, True), F.struct(number(p, 1).alias("a"), (number(p, 2) if p.count(r"(\d{1,4})") > 1 else F.lit(None).cast("int")).alias("b")))
        for p in P.MINED_LIMITS[what]
    ])


def believed(what: str) -> Column:
    """H-30: struct what, low, high, sentence of a limit whose numbers are sane, or null."""
    found, sentence = F.col(f"n_{what}"), T.at(F.col("s"), F.col(f"hit_{what}")["i"] + 1)
    low, high = F.when(found["b"].isNotNull(), found["a"]), F.coalesce(found["b"], found["a"])
    return F.when(high.between(*SANE[what]), F.struct(F.lit(what).alias("what"), low.alias("low"), high.alias("high"), F.left(sentence, F.lit(200)).alias("sentence")))


def mined(texts: DataFrame) -> DataFrame:
    """H-30: every limit found in each text, with the sentence that states it: one pass over the texts, none is shuffled.

    Each step names what the next reads more than once, so that nothing is computed twice.
    """
    limits = list(P.MINED_LIMITS)
    # numbers as digits, lower case: that moves no sentence's end, so both arrays go together
    rows = texts.select("ms_id", T.sentences(F.col("text")).alias("s"), T.sentences(T.digits(F.lower("text"))).alias("read"))
    rows = rows.select("*", *[windows(F.col("read"), n).alias(f"read_{n}") for n in sorted({LOOK_BACK.get(what, 0) for what in limits})])
    rows = rows.select("ms_id", "s", *[first_hit(F.col(f"read_{LOOK_BACK.get(what, 0)}"), what).alias(f"hit_{what}") for what in limits])
    rows = rows.select("*", *[numbers_of(F.col(f"hit_{what}.w"), what).alias(f"n_{what}") for what in limits])
    return rows.select("ms_id", F.explode(F.array(*map(believed, limits))).alias("f")).where("f IS NOT NULL").select("ms_id", "f.*")


def derived(texts: DataFrame, base: DataFrame) -> DataFrame:
    """H-34: a profile for each text: what it proves, else the base profile's value; never verified.

    ``texts``: ms_id, name, text; ``base``: one profile row.
    """
    found = mined(texts)
    high = lambda what: F.max(F.when(F.col("what") == what, F.col("high")))
    low = lambda what: F.max(F.when(F.col("what") == what, F.col("low")))
    limits = found.groupBy("ms_id").agg(
        high("abstract_words").alias("m_abstract_max"), low("abstract_words").alias("m_abstract_min"), F.coalesce(high("keyword_range"), high("keyword_max")).alias("m_keywords_max"), low("keyword_range").alias("m_keywords_min"),
        high("highlight_range").alias("m_highlights_max"), low("highlight_range").alias("m_highlights_min"), high("highlight_chars").alias("m_highlight_chars"), high("title_chars").alias("m_title"), high("dpi").alias("m_dpi"), high("total_words").alias("m_words"),
    )
    taken = {"abstract_max_words": "m_abstract_max", "abstract_min_words": "m_abstract_min", "keywords_max": "m_keywords_max", "keywords_min": "m_keywords_min", "highlights_max": "m_highlights_max", "highlights_min": "m_highlights_min", "highlights_max_chars": "m_highlight_chars", "title_max_chars": "m_title", "dpi_halftone": "m_dpi", "manuscript_max_words": "m_words"}
    rows = texts.join(limits, "ms_id", "left").crossJoin(F.broadcast(base.limit(1)))
    own = [F.coalesce(taken[c], c).alias(c) if c in taken else F.col(c) for c in base.columns if c not in ("profile_id", "verified", "journal")]
    return rows.select("ms_id", T.slug(F.col("name")).alias("profile_id"), F.col("name").alias("journal"), F.lit(False).alias("verified"), T.reference_style(F.col("text")).alias("reference_style"), T.heading_numbering(F.col("text")).alias("numbering"), *own)


def evidence(text: Column) -> Column:
    """What a template's own examples show: struct style, numbering."""
    return F.struct(T.reference_style(text).alias("style"), T.heading_numbering(text).alias("numbering"))


def capped(paragraphs: DataFrame, most: int = 400_000) -> DataFrame:
    """A-12: paragraphs of a document up to a number of characters."""
    running = F.sum(F.length("text") + 1).over(Window.partitionBy("ms_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return paragraphs.withColumn("before", F.coalesce(running, F.lit(0))).where(F.col("before") < most).drop("before")
