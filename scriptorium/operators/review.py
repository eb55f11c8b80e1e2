"""Readiness of a manuscript for a journal: inspectable checks, their scores and what to fix first.

Every check is a struct (category, key, score 0..1, weight, severity, evidence); a score is
never a probability of acceptance.  ``as_of_year`` is a parameter, so reruns agree.
Profiles go to the manuscripts, never the other way: a product dealt by both sides' partitions
would read every text once for each partition of profiles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import plain
from scriptorium.functions import text as T
from scriptorium.operators.compliance import effective_dpi, front_facts
from scriptorium.session import ship, small_batches


def _check(category: str, key: str, score: Column, weight: Column | float, severity: Column, evidence: Column) -> Column:
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return F.struct(F.lit(category).alias("category"), F.lit(key).alias("key"), score.cast("double").alias("score"), weight.cast("double").alias("weight"), severity.alias("severity"), evidence.cast("double").alias("evidence"))


def _graded(ok: Column, otherwise: str | Column) -> Column:
    return F.when(ok, "ok").otherwise(otherwise)


def _set_or(limit: str, default: int) -> Column:
    return F.coalesce(F.nullif(F.col(limit), F.lit(0)), F.lit(default))


def corpus_text(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """I-23: ms_id, all_text: titles and paragraphs, a line each, in reading order."""
    heads = sections.where("title_raw <> ''").select("ms_id", "sec_ord", F.lit(-1).alias("blk_ord"), F.col("title_raw").alias("text"))
    rows = heads.unionByName(blocks.where("kind = 'paragraph'").select("ms_id", "sec_ord", "blk_ord", "text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sec_ord", "blk_ord", "text"))), lambda r: r["text"])
    return rows.groupBy("ms_id").agg(F.array_join(ordered, "\n").alias("all_text"))


def section_text(sections: DataFrame, blocks: DataFrame, role: str) -> DataFrame:
    """I-23: ms_id, text: the paragraphs of the first section of a role, joined by spaces, subsections left out."""
    firsts = sections.where(F.col("role") == role).groupBy("ms_id").agg(F.min("sec_ord").alias("sec_ord"))
    rows = blocks.where("kind = 'paragraph'").join(firsts, ["ms_id", "sec_ord"])
    return rows.groupBy("ms_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk_ord", "text"))), lambda r: r["text"]), " ").alias("text"))


def corpus_texts(sections: DataFrame, blocks: DataFrame, structure: bool = False) -> DataFrame:
    """I-23: ms_id, all_text and introduction, as :func:`corpus_text` and :func:`section_text` give them, out of one pass over the rows.

    With ``structure`` also roles, tops and words, which :func:`compliance.front_facts` reads, and ``plain``: what
    :func:`plain.whole_facts` says of texts of ASCII characters alone, null for others.
    """
    level, own = F.col("level") if structure else F.lit(None).cast("int"), F.lit(None)
    counted = T.word_count(F.col("title_raw")) if structure else own
    heads = sections.select("ms_id", "sec_ord", F.lit(-1).alias("blk_ord"), F.col("title_raw").alias("text"), F.lit(True).alias("head"), "role", level.alias("level"), counted.cast("long").alias("n"))
    rows = heads.unionByName(blocks.where("kind = 'paragraph'").select("ms_id", "sec_ord", "blk_ord", "text", F.lit(False).alias("head"), own.cast("string").alias("role"), own.cast("int").alias("level"), own.cast("long").alias("n")))
    found = [F.array_sort(F.collect_list(F.struct("sec_ord", "blk_ord", "text", "head"))).alias("rows"), F.min(F.when(F.col("role") == "introduction", F.col("sec_ord"))).alias("opening")]
    facts = ["roles", "tops", "titled"] if structure else []
    if structure:
        tops = F.collect_list(F.when(F.col("level") == 1, F.struct("sec_ord", "role", F.col("text").alias("title_raw"))))
        found += [F.collect_set("role").alias("roles"), F.array_sort(tops).alias("tops"), F.coalesce(F.sum("n"), F.lit(0)).alias("titled")]
    grouped = rows.groupBy("ms_id").agg(*found)
    joined = lambda keep, by: F.array_join(F.transform(F.filter("rows", keep), lambda r: r["text"]), by)
    own = lambda r: ~r["head"] & (r["sec_ord"] == F.col("opening"))
    texts = grouped.select("ms_id", joined(lambda r: ~r["head"] | (r["text"] != ""), "\n").alias("all_text"), F.when(F.exists("rows", own), joined(own, " ")).alias("introduction"), *facts)
    if not structure:
        return texts
    ship(sections.sparkSession)
    small_batches(sections.sparkSession)
    texts = texts.withColumn("plain", plain.whole_facts(plain.only(F.col("all_text"))))
    # lines add up: the paragraphs' words are all but those of titles
    return texts.withColumn("words", F.coalesce("plain.words", T.word_count(F.col("all_text"))) - F.col("titled")).drop("titled")


def padded_words(hay: Column) -> Column:
    """Lower-case words with one space around each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(hay), r"(?U)[^\w]+", " "), F.lit(" "))


def whole_words(terms: Column, padded: Column) -> Column:
    """Terms that occur in padded words as whole words, any case: no pattern is built."""
    return F.filter(terms, lambda t: F.contains(padded, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), r"(?U)[^\w]+", " ")), F.lit(" "))))


def scope_checks() -> list[Column]:
    """I-01."""
    n = F.size("scope_keywords")
    none = _check("Scope fit", "scope.match", F.lit(1.0), 0.0, F.lit("info"), F.lit(None))
    matched = F.col("matched")
    score = F.least(F.lit(1.0), F.coalesce(F.try_divide(matched, F.least(n, F.lit(12))), F.lit(0.0)) * 2)
    severity = F.when(score >= 0.67, "ok").when(score >= 0.34, "minor").otherwise("major")
    return [F.when(n == 0, none).otherwise(_check("Scope fit", "scope.match", score, 3.0, severity, matched))]


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _has(folded: Column, pattern: str) -> Column:
    return T.matches(folded, T.lowered_pattern(pattern))


def signals(text: Column, folded: Column | None = None) -> Column:
    """I-19: how many patterns of reproducibility a text has; each is only tried on a text with one of the words it cannot do without."""
    words = lambda folded, name: reduce(lambda a, b: a | b, [F.contains(folded, F.lit(w)) for w in P.REPRODUCIBILITY_WORDS[name]])
    made = lambda folded: reduce(lambda a, b: a + b, [(words(folded, name) & _has(folded, p)).cast("int") for name, p in P.REPRODUCIBILITY.items()])
    return _once(T.lowered(text), made) if folded is None else made(folded)


def abstract_facts(text: Column) -> Column:
    """Struct n (words), missing (moves), quantities, foreign, novel (signals) of an abstract; no profile takes part."""
    found = lambda sentences, p: F.exists(sentences, lambda s: _has(s, p))
    missing = _once(T.joined_sentences(T.lowered(text)), lambda sentences: reduce(lambda a, b: a + b, [F.when(found(sentences, p), 0).otherwise(1) for p in P.MOVES.values()]))
    foreign = T.matches(text, P.CITATION_IN_ABSTRACT) | F.coalesce("abstract_has_math", F.lit(False)) | T.matches(text, P.FLOAT_IN_ABSTRACT)
    front = T.lowered(F.concat_ws(" ", "title", text, "introduction"))
    novel = _once(front, lambda folded: reduce(lambda a, b: a + b, [_has(folded, p).cast("int") for p in P.NOVELTY]))
    return F.struct(T.word_count(text).alias("n"), missing.alias("missing"), F.regexp_count(text, T.rx(P.QUANTITY)).alias("quantities"), foreign.alias("foreign"), novel.alias("novel"))


def abstract_checks() -> list[Column]:
    """I-02 to I-07; without an abstract the first is all there is."""
    n, missing, quantities, foreign, novel = (F.col("abstract_facts")[c] for c in ("n", "missing", "quantities", "foreign", "novel"))
    some = n.isNotNull()
    low, high = _set_or("abstract_min_words", 0), _set_or("abstract_max_words", 10_000)
    over, under = n > high, (low > 0) & (n < low)
    length = F.when(over, F.greatest(F.lit(0.0), 1 - (n - high) / high)).when(under, n / low).otherwise(1.0)
    made = [
        _check("Abstract", "abstract.length", length, 2.0, F.when(over, "major").when(under, "minor").otherwise("ok"), n),
        _check("Abstract", "abstract.moves", 1 - missing / len(P.MOVES), 2.0, F.when(missing == 0, "ok").when(missing > 1, "major").otherwise("minor"), missing),
        _check("Abstract", "abstract.quantified", F.when(quantities >= 2, 1.0).when(quantities == 1, 0.5).otherwise(0.0), 1.5, _graded(quantities >= 2, "major"), quantities),
        _check("Abstract", "abstract.selfcontained", F.when(foreign, 0.0).otherwise(1.0), 1.5, _graded(~foreign, "major"), foreign.cast("int")),
        _check("Abstract", "abstract.novelty", F.when(novel > 0, 1.0).otherwise(0.0), 2.0, _graded(novel > 0, "major"), novel),
    ]
    return [F.when(~some, _check("Abstract", "abstract.present", F.lit(0.0), 4.0, F.lit("blocker"), F.lit(0)))] + [F.when(some, c) for c in made]


def structure_checks() -> list[Column]:
    """I-08 to I-10."""
    missing, n = F.size(F.array_except("required_sections", "present")), F.size("required_sections")
    severity = F.when((missing > 0) & (F.col("unlabelled") > 0), "minor").when(missing == 0, "ok").when(missing > 2, "blocker").otherwise("major")
    keywords = F.size(F.coalesce("keywords", F.array()))
    fits = keywords.between(_set_or("keywords_min", 0), _set_or("keywords_max", 99))
    title = F.col("title_words")
    good = title.between(6, 20)
    return [
        _check("Structure", "structure.required", 1 - missing / F.greatest(F.lit(1), n), 3.0, severity, missing),
        _check("Structure", "structure.keywords", F.when(fits, 1.0).otherwise(0.0), 1.0, _graded(fits, "minor"), keywords),
        _check("Structure", "structure.title", F.when(good, 1.0).when(title > 0, 0.5).otherwise(0.0), 1.0, _graded(good, "minor"), title),
    ]


def reference_checks() -> list[Column]:
    """I-11 to I-15; without references the first is all there is."""
    n = F.coalesce("refs", F.lit(0))
    expected = F.when(F.greatest(F.lit(1), "words") < 5000, 30).when(F.col("words") < 9000, 45).otherwise(60)
    ratio = n / expected
    enough = F.when(ratio >= 0.75, 1.0).otherwise(ratio / 0.75)
    recent = F.when(F.coalesce("dated", F.lit(0)) > 0, F.least(F.lit(1.0), F.col("recent") / F.col("dated") / 0.5)).otherwise(0.4)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), n), F.lit(0.0))
    clean = 1 - share("low_refs")
    made = [
        _check("References", "refs.count", enough, 1.5, _graded(enough >= 1, "major"), n),
        _check("References", "refs.recency", recent, 1.5, _graded(recent >= 1, "major"), F.col("recent")),
        _check("References", "refs.doi", share("with_doi"), F.when(F.col("doi_required"), 1.5).otherwise(0.8), _graded(share("with_doi") > 0.9, F.when(F.col("doi_required"), "major").otherwise("minor")), F.col("with_doi")),
        _check("References", "refs.consistency", clean, 1.0, _graded(clean > 0.85, "minor"), F.col("low_refs")),
    ]
    return [F.when(n == 0, _check("References", "refs.present", F.lit(0.0), 3.0, F.lit("blocker"), F.lit(0)))] + [F.when(n > 0, c) for c in made]


def figure_checks() -> list[Column]:
    """I-16 to I-18."""
    figures, tables = F.coalesce("figures", F.lit(0)), F.coalesce("tables", F.lit(0))
    density = (figures + tables) / (F.greatest(F.lit(1), "words") / 1000)
    balanced = density.between(0.5, 2.5)
    captioned = 1 - F.coalesce(F.try_divide("uncaptioned", figures), F.lit(0.0))
    fit = 1 - F.coalesce(F.try_divide("unfit", figures), F.lit(0.0))
    return [
        _check("Figures and tables", "figs.density", F.when(balanced, 1.0).otherwise(0.6), 0.8, _graded(balanced, "minor"), density),
        F.when(figures > 0, _check("Figures and tables", "figs.captions", captioned, 1.2, _graded(captioned == 1, "major"), F.col("uncaptioned"))),
        F.when(figures > 0, _check("Figures and tables", "figs.production", fit, 2.0, F.when(fit == 1, "ok").when(fit < 0.5, "blocker").otherwise("major"), F.col("unfit"))),
    ]


def reproducibility_checks() -> list[Column]:
    """I-19, I-20."""
    found = F.col("signals")
    stated = F.array_contains("present", "data_availability")
    needed = F.array_contains("required_sections", "data_availability")
    score = found / len(P.REPRODUCIBILITY)
    return [
        _check("Reproducibility", "repro.signals", score, 1.5, _graded(score >= 0.75, "major"), found),
        _check("Reproducibility", "repro.statement", F.when(stated, 1.0).otherwise(0.0), F.when(needed, 1.2).otherwise(0.6), _graded(stated, F.when(needed, "major").otherwise("minor")), stated.cast("int")),
    ]


def _written(words: Column, sentences: Column, total: Column, long: Column, hedges: Column) -> Column:
    """Struct of writing facts out of counts: all words, sentences of three words or more, the words of these, those of more than 40, hedges."""
    per_1000 = hedges / F.greatest(F.lit(1.0), words / 1000)
    return F.struct(sentences.alias("sentences"), F.try_divide(total, sentences).alias("mean_words"), F.try_divide(long, sentences).alias("long_share"), per_1000.alias("hedges_per_1000"))


def writing_facts(text: Column, folded: Column | None = None) -> Column:
    """Struct sentences, mean_words, long_share, hedges_per_1000 of a text; only sentences of three words or more count."""
    # a sentence ends with a word that ends with . ! or ?: each word becomes one letter, with that mark behind it
    marks = F.regexp_replace(F.regexp_replace(text, r"(?U)\S+(?:(?<=([.!?]))|)\s*", "w$1"), r"(?U)^\s+", "")
    counts = F.transform(F.split(F.translate(marks, "!?", ".."), r"\."), lambda s: F.length(s).cast("long"))
    total = lambda counts: F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    hedges = F.regexp_count(T.lowered(text) if folded is None else folded, T.rx(T.lowered_pattern(P.HEDGE)))

    def made(counts: Column) -> Column:
        return _once(F.filter(counts, lambda n: n > 2), lambda lengths: _written(total(counts), F.size(lengths).cast("long"), total(lengths), F.size(F.filter(lengths, lambda x: x > 40)), hedges))

    return _once(counts, made)


def writing_checks() -> list[Column]:
    """I-21, I-22; nothing for a text without sentences."""
    facts = F.col("writing")
    some = F.coalesce(facts["sentences"], F.lit(0)) > 0
    readable = facts["mean_words"].between(14, 26) & (facts["long_share"] < 0.1)
    plain = facts["hedges_per_1000"] <= 12
    return [
        F.when(some, _check("Writing signals", "writing.sentences", F.when(readable, 1.0).otherwise(0.6), 0.8, _graded(readable, "minor"), facts["mean_words"])),
        F.when(some, _check("Writing signals", "writing.hedging", F.when(plain, 1.0).otherwise(0.6), 0.6, _graded(plain, "minor"), facts["hedges_per_1000"])),
    ]


def review_facts(corpus: dict[str, DataFrame], as_of_year: int) -> DataFrame:
    """Text facts, and what the checks read of references and texts.

    Texts are read here, once a manuscript; they stay behind when manuscripts meet profiles.
    """
    refs = corpus["refs"].groupBy("ms_id").agg(
        F.count("*").alias("refs"), F.count("year").alias("dated"), F.count_if(as_of_year - F.col("year") <= 5).alias("recent"),
        F.count_if(F.coalesce("doi", F.lit("")) != "").alias("with_doi"), F.count_if(F.col("confidence") < 0.6).alias("low_refs"),
    )
    whole, text, known = corpus_texts(corpus["sections"], corpus["blocks"], structure=True), F.col("all_text"), F.col("plain")
    said = _written(known["words"], known["sentences"], known["total"], known["long"], known["hedges"])
    whole = whole.withColumns({"writing": F.when(known.isNotNull(), said).otherwise(writing_facts(text)), "signals": F.coalesce(known["signals"], signals(text))}).drop("all_text", "plain")
    nothing = writing_facts(F.lit(""))  # a manuscript without any section or paragraph
    facts = front_facts(corpus["manuscripts"].join(whole, "ms_id", "left")).join(refs, "ms_id", "left").withColumns({"writing": F.coalesce("writing", nothing), "signals": F.coalesce("signals", F.lit(0))})
    abstract, known = F.col("abstract"), F.col("plain")
    facts = facts.withColumn("abstract", T.stripped(F.coalesce("abstract_raw", F.lit("")))).withColumn("front", F.concat_ws(" ", "title", abstract, "introduction"))
    facts = facts.withColumn("plain", plain.abstract_facts(plain.only(abstract, F.col("front")), plain.only(F.col("front"))))
    math = F.coalesce("abstract_has_math", F.lit(False))
    said = F.struct(known["n"].alias("n"), known["missing"].alias("missing"), known["quantities"].alias("quantities"), (known["foreign"] | math).alias("foreign"), known["novel"].alias("novel"))
    read = {
        "abstract_facts": F.when(abstract != "", F.when(known.isNotNull(), said).otherwise(abstract_facts(abstract))),
        "title_words": T.word_count(T.stripped(F.coalesce("title", F.lit("")))), "padded": padded_words(F.concat_ws(" ", "title", F.array_join("keywords", " "), "abstract_raw")),
    }
    return facts.withColumns(read).drop("introduction", "abstract_raw", "abstract", "front", "plain")


def float_facts(figures: DataFrame, tables: DataFrame, profiles: DataFrame, manuscripts: DataFrame) -> DataFrame:
    """ms_id, profile_id, figures, tables, uncaptioned, unfit (a rejected format, or too coarse where it is placed)."""
    coarse = ~F.col("is_vector") & (F.coalesce("width_px", F.lit(0)) != 0) & (F.coalesce("placed_width_mm", F.lit(0.0)) != 0) & (effective_dpi(F.col("width_px"), F.col("placed_width_mm")) < F.col("dpi_halftone"))
    rejected = F.array_contains(F.transform("rejected_formats", lambda f: F.lower(f)), F.lower("fmt"))
    found = figures.crossJoin(F.broadcast(profiles)).groupBy("ms_id", "profile_id").agg(
        F.count("*").alias("figures"), F.count_if(F.coalesce("caption_raw", F.lit("")) == "").alias("uncaptioned"), F.count_if(rejected | F.coalesce(coarse, F.lit(False))).alias("unfit"))
    bare = tables.groupBy("ms_id").agg(F.count("*").alias("tables"))
    return manuscripts.select("ms_id").crossJoin(F.broadcast(profiles.select("profile_id"))).join(found, ["ms_id", "profile_id"], "left").join(bare, "ms_id", "left")


def checks(facts: DataFrame, floats: DataFrame, profiles: DataFrame) -> DataFrame:
    """I-24: ms_id, profile_id, seq and the fields of every check that applies.

    A manuscript brings what its floats are to each profile, so that the wide rows of manuscripts and profiles stay where the manuscript is.
    """
    own = floats.groupBy("ms_id").agg(F.collect_list(F.struct(*[c for c in floats.columns if c != "ms_id"])).alias("floats"))
    both = facts.join(own, "ms_id", "left").crossJoin(F.broadcast(profiles))
    both = both.withColumn("floats", T.at(F.filter("floats", lambda f: f["profile_id"] == F.col("profile_id")), 1)).select("*", *[F.col("floats")[c].alias(c) for c in floats.columns if c not in ("ms_id", "profile_id")])
    both = both.withColumn("matched", F.size(whole_words(F.col("scope_keywords"), F.col("padded"))))
    every = scope_checks() + structure_checks() + abstract_checks() + reference_checks() + figure_checks() + reproducibility_checks() + writing_checks()
    # made before the generator, which would interpret each check; outer, or a test that the array has elements makes all of them once more
    made = both.select("ms_id", "profile_id", F.array(*every).alias("checks"))
    return made.select("ms_id", "profile_id", F.posexplode_outer("checks").alias("seq", "c")).where("c IS NOT NULL").select("ms_id", "profile_id", "seq", "c.*")


def category_scores(found: DataFrame) -> DataFrame:
    """E-08: weighted mean of a category's checks, 1 where all weights are 0."""
    score = F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.nullif(F.sum("weight"), F.lit(0.0))), F.lit(1.0))
    return found.groupBy("ms_id", "profile_id", "category").agg(score.alias("category_score"))


def _readiness() -> Column:
    """The weighted mean over the checks of one manuscript and profile: sums by category in one pass."""
    total = 0
    for name, weight in P.CATEGORY_WEIGHTS.items():
        own = F.col("category") == name
        score = F.try_divide(F.sum(F.when(own, F.col("score") * F.col("weight"))), F.nullif(F.sum(F.when(own, F.col("weight"))), F.lit(0.0)))
        total = total + F.coalesce(score, F.lit(1.0)) * weight
    return total / sum(P.CATEGORY_WEIGHTS.values())


def readiness(found: DataFrame) -> DataFrame:
    """E-09: weighted mean of the seven categories; one without checks counts as whole."""
    return found.groupBy("ms_id", "profile_id").agg(_readiness().alias("readiness"))


def _rank(severity: Column) -> Column:
    return reduce(lambda c, kv: c.when(severity == kv[0], kv[1]), list(P.SEVERITY_RANK.items())[1:], F.when(severity == "blocker", 0)).otherwise(3)


def priorities(found: DataFrame, most: int = 8) -> DataFrame:
    """F-09: what to fix first: by severity, then by weighted loss."""
    loss = -(1 - F.col("score")) * F.col("weight")
    order = Window.partitionBy("ms_id", "profile_id").orderBy(_rank(F.col("severity")), loss, "seq")
    return found.where("score < 0.99").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def weakest(found: DataFrame) -> DataFrame:
    """F-10: checks below 0.99 of each category, worst first."""
    order = Window.partitionBy("ms_id", "profile_id", "category").orderBy("score", F.desc("weight"), "seq")
    return found.where("score < 0.99").withColumn("place", F.row_number().over(order))


def desk_risk(found: DataFrame) -> DataFrame:
    """F-11: High, Moderate or Low, with the keys of the checks that are its reasons."""
    scope = F.max(F.when(F.col("key") == "scope.match", F.col("score")))
    keyed = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.struct("seq", "key")))), lambda r: r["key"])
    facts = found.groupBy("ms_id", "profile_id").agg(scope.alias("scope"), keyed("blocker").alias("blockers"), keyed("major").alias("majors"), _readiness().alias("readiness"))
    weak = F.coalesce(F.col("scope") < 0.34, F.lit(False))
    band = F.when((F.size("blockers") > 0) | weak, "High").when((F.size("majors") >= 3) | (F.col("readiness") < 0.6), "Moderate").otherwise("Low")
    reasons = F.concat(F.when(weak, F.array(F.lit("scope"))).otherwise(F.array().cast("array<string>")), "blockers", F.slice("majors", 1, 4))
    return facts.select("ms_id", "profile_id", "readiness", band.alias("band"), reasons.alias("reasons"))


def report(found: DataFrame) -> DataFrame:
    """N-11: one text for each manuscript and profile: a line for each check in order."""
    line = F.format_string("%s: %s %.2f", F.col("category"), F.col("key"), F.col("score"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return found.groupBy("ms_id", "profile_id").agg(F.array_join(lines, "\n").alias("report"))
