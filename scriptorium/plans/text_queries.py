"""Queries of the text functions, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import text as T
from scriptorium.operators import audit, frontmatter, mining
from scriptorium.plans import adapters as X

_q = lambda p: "'" + p.replace("'", "''") + "'"
_NUMBER = _q(P.NUMBERING)


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.lines(spark, sf_dir)
    return rows.groupBy("ms_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"), F.count("*").alias("paragraphs"))


def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.match_key(F.col("text"))
    return X.lines(spark, sf_dir).groupBy("ms_id").agg(F.count_distinct(key).alias("keys"), F.sum(F.length(key)).alias("characters"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.lines(spark, sf_dir).select("ms_id", T.structural_features(F.col("text")).alias("f")).select("ms_id", "f.*")
    names = [c for c in f.columns if c != "ms_id"]
    return f.groupBy("ms_id").agg(*[F.round(F.sum(n), 7).alias(n) for n in names])


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-01, H-02 on built titles: every second line is headed by a section name with a number."""
    names = F.array(*map(F.lit, _TITLES))
    n = F.col("ms_id") + F.col("idx")
    title = F.when(F.col("idx") % 2 == 0, F.concat((F.col("idx") + 1).cast("string"), F.lit(". "), F.element_at(names, (F.pmod(n, F.lit(len(_TITLES))) + 1).cast("int")))).otherwise(F.left("text", F.lit(40)))
    rows = X.lines(spark, sf_dir).select("ms_id", title.alias("title"))
    role = T.role_of(T.without_numbering(F.col("title")))
    return rows.groupBy(role.alias("role")).agg(F.count("*").alias("n"), F.count_if(T.numbering_of(F.col("title")) != "").alias("numbered"))


_TITLES = ["Introduction", "Results and Discussion", "RESULTS", "Materials and methods", "Conclusions and outlook", "Literature review", "Acknowledgments", "Data availability statement", "Appendix B. Extra", "Index Terms", "A plain title", "Optimisation"]


def vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-03 on lines and on their endings, which show more of what a heading is not."""
    tail = F.concat(F.right("text", F.lit(6)), F.element_at(F.array(*map(F.lit, ["", ";", " [kW]", "@x", " 3"])), (F.col("idx") % 5 + 1).cast("int")))
    return X.lines(spark, sf_dir).groupBy("ms_id").agg(F.count_if(T.cannot_be_heading(F.col("text"))).alias("lines"), F.count_if(T.cannot_be_heading(tail)).alias("tails"))


def furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-27 on lines, every seventh of which begins with a phrase of a template."""
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.pmod(F.col("ms_id"), F.lit(len(_PHRASES))) + 1).cast("int"))
    text = F.when(F.col("idx") % 7 == 0, F.concat(phrase, F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return X.lines(spark, sf_dir).groupBy(T.furniture_label(text).alias("label")).agg(F.count("*").alias("n"))


_PHRASES = ["ISSN 1234", "DOI: 10.xxxx", "Article  citation info:", "Vol. xx", "Creative Commons Attribution licence", "Received 2020-xx ; accepted", "(do not change this)", "xxxxxx", "Plain words", "Licensee X. This licence"]


def writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.operators.review import writing_facts

    facts = X.texts(spark, sf_dir).select("ms_id", writing_facts(F.col("text")).alias("w"))
    return facts.select("ms_id", "w.sentences", *[F.round(f"w.{c}", 9).alias(c) for c in ("mean_words", "long_share", "hedges_per_1000")])


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References built of a line item's columns, so that each part is known."""
    rows = X.table(spark, sf_dir, "lineitem")
    year = (F.lit(1990) + F.col("l_suppkey") % 30).cast("string")
    title = F.concat(F.lit("A study of item "), F.col("l_partkey").cast("string"), F.lit(" and its price"))
    end = F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.concat(F.lit(" doi:10.1234/x"), F.col("l_partkey").cast("string")))
    volume = F.concat((F.col("l_linenumber") + 10).cast("string"), F.lit("("), (F.col("l_linenumber") + 1).cast("string"), F.lit("), "), (F.col("l_suppkey") + 100).cast("string"), F.lit("-"), (F.col("l_suppkey") + 120).cast("string"))
    raw = F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit("] A. B. Miller, C. Stone ("), year, F.lit('). "'), title, F.lit('," Journal, '), volume, F.lit("."), end)
    return rows.select("l_orderkey", "l_linenumber", T.parse_reference(raw).alias("r"))


def reference_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reference(spark, sf_dir)
    people = F.array_join(F.transform("r.authors", lambda a: F.concat_ws("|", a["family"], a["given"])), ";")
    return r.select("l_orderkey", "l_linenumber", "r.doi", "r.year", "r.volume", "r.issue", "r.page", "r.title", people.alias("authors"), F.round("r.confidence", 6).alias("confidence"))


def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("Keywords: "), F.array_join(F.split("p_name", " "), "; "), F.lit(", "), "p_brand", F.lit(" |x"))
    return X.table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.split_keywords(line), "/").alias("keywords"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat("p_type", F.lit(" -- "), "p_brand")).alias("slug"), T.label_key(F.col("p_brand")).alias("label"))


def quote_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("  “"), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("”  ‘x’ –— "))
    return X.table(spark, sf_dir, "benchmark").select("item_id", T.quote_key(quoted).alias("quote_key"))


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("between "), F.element_at(F.array(*map(F.lit, P.WORD_NUMBERS)), (F.col("p_size") % 12 + 1).cast("int")), F.lit(" and Twelve, someone"))
    return X.table(spark, sf_dir, "part").select("p_partkey", T.digits(text).alias("digits"))


def sentence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return X.texts(spark, sf_dir).select("ms_id", F.size(s).cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" 5% & $3 #1 a_b {c} ~ ^ \\x"))
    return X.lines(spark, sf_dir).select("ms_id", "idx", T.latex_escaped(text).alias("latex"))


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-45 to H-49 on parts: formulas of repeated terms, figures and tables of their sizes."""
    size = F.col("p_size").cast("int")
    formula = F.concat(F.repeat(F.lit("x+"), size), F.lit("\\frac{a}{b}"), F.when(size % 3 == 0, F.concat(F.lit("\\quad\\quad "), F.repeat(F.lit("y"), size))).otherwise(""), F.lit(" (12)"))
    columns = size % 2 + 1
    bare = T.without_manual_number(formula)
    table = T.table_fit(size * 4, columns)
    return X.table(spark, sf_dir, "part").select(
        "p_partkey", T.visual_length(bare).cast("long").alias("visual"), T.equation_fit(bare, columns).alias("fit"),
        T.figure_spans(columns, size * 6.0, (size % 9) * 10.0, F.lit(88.9)).alias("spans"), table["star"].alias("star"), table["wraps"].alias("wraps"), table["size"].alias("type_size"),
        (T.is_degenerate_math(F.when(size % 4 == 0, "\\ _{ }^{}").otherwise(formula))).alias("degenerate"),
    )


def specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.ascii_text("text")
    issue = F.concat(F.left(text, F.lit(80)), F.element_at(F.array(*map(F.lit, _WORDINGS)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_WORDINGS))) + 1).cast("int")))
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(T.specificity(issue, F.substring(text, 81, 90), F.substring(text, 171, 60)), 6).alias("specificity"))


_WORDINGS = [" could be improved", " see Table 3 with 12 % loss", " lacks depth and needs work", " compared to the baseline", "", " is not clearly stated, versus the control", " should be 5 mm and not less"]


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("C:\\x\\"), "url")).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("/a.JPEG "))).otherwise(F.col("url")).alias("alt"))
    return rows.select("page_id", T.looks_like_path(F.col("alt")).alias("is_path"))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-11 on pages: elements counted by their tags alone."""
    tags = ("h1", "p", "li", "a", "script")
    return X.table(spark, sf_dir, "pages").select("page_id", *[F.regexp_count("html", F.lit(rf"<{t}[\s>]")).cast("long").alias(f"n_{t}") for t in tags])


def emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-17 on lines wrapped in commands."""
    wrapped = F.concat(F.when(F.col("idx") % 4 == 0, "\\section{x} ").when(F.col("idx") % 4 == 1, "\\begin{equation} ").when(F.col("idx") % 4 == 2, "\\includegraphics{f} ").otherwise("\\bibitem{k} "), "text")
    whole = X.lines(spark, sf_dir).groupBy("ms_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", wrapped.alias("t")))), lambda r: r["t"]), "\n").alias("latex"))
    return whole.select("ms_id", F.inline(F.array(audit.emitted_counts(F.concat(F.lit("\\section{no}\\begin{document}"), F.col("latex"))))))


def _instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("Write well. Abstract.\nBetween "), s(n + 100), F.lit(" and "), s(n + 200), F.lit(" words please. Authors give a minimum of three to a maximum of "), F.element_at(F.array(*map(F.lit, P.WORD_NUMBERS)), (n % 6 + 5).cast("int")),
        F.lit(" keywords. Title: not exceed "), s(n + 60), F.lit(" characters. Halftone art at "), s(n * 10 + 100), F.lit(" dpi. Highlights are 3 to 5 bullet points of "), s(n + 50), F.lit(" characters including spaces."),
    )
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ms_id"), F.concat("p_name", F.lit(" Letters")).alias("name"), text.alias("text"))


def mined_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mined(_instructions(spark, sf_dir)).select("ms_id", "what", "low", "high")


def derived_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = X.profiles(spark).where("profile_id = 'alpha'")
    return mining.derived(_instructions(spark, sf_dir), base).select("ms_id", "profile_id", "verified", "abstract_min_words", "abstract_max_words", "keywords_max", "title_max_chars", "dpi_halftone", "max_references")


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-20 to H-23 on lines, the second of which becomes an author line and the third an affiliation."""
    text = F.when(F.col("idx") == 0, F.lit("A plain beginning")).when(F.col("idx") == 1, F.lit("Ann B. Miller¹*, Carl Stone2, and Eve Long 1")).when(F.col("idx") == 2, F.lit("1 Institute of Lines, Oslo, Norway")).otherwise(F.col("text"))
    rows = X.lines(spark, sf_dir).withColumn("text", text).withColumn("style", F.lit(""))
    core = X.texts(spark, sf_dir).select("ms_id", F.when(F.col("ms_id") % 2 == 0, F.concat(F.lit("Title "), F.col("ms_id").cast("string"))).otherwise("").alias("title"))
    titles = frontmatter.title(core, rows)
    people = frontmatter.authors(rows.where("idx < 12")).groupBy("ms_id").agg(F.count("*").alias("authors"), F.count_if("corresponding").alias("corresponding"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "family", F.array_join("affiliation_ids", "+")))), ",").alias("names"))
    places = frontmatter.affiliations(rows.where("idx < 3")).groupBy("ms_id").agg(F.max("country").alias("country"))
    own = titles.where("method = 'explicit'").select("ms_id", "title")
    return own.join(people, "ms_id").join(places, "ms_id")


QUERIES = {
    "b_09_word_count": word_counts, "h_24_match_keys": match_keys, "h_41_features": features, "h_01_roles": roles, "h_03_heading_vetoes": vetoes, "h_27_furniture": furniture,
    "i_21_writing": writing, "h_15_references": reference_parts, "h_18_keywords": keyword_lists, "h_33_slugs": slugs, "h_36_quote_keys": quote_keys, "h_28_number_words": number_words,
    "h_29_sentences": sentence_lists, "h_42_latex_escape": escaped, "h_46_fits": fits, "h_37_specificity": specific, "h_26_paths": paths, "a_11_tag_counts": page_counts, "e_17_emitted": emitted,
    "h_30_mined_limits": mined_limits, "h_34_derived_profiles": derived_profiles, "h_20_front_matter": front_matter,
}

_STOP = "[" + ", ".join(map(_q, P.STOPWORDS)) + "]"
_ESCAPE = reduce(lambda t, p: f"replace({t}, {_q(p[0])}, {_q(p[1].replace('{}', chr(1)))})".replace(chr(1), "\x01"), P.LATEX_SPECIALS[1:], "replace(t, '\\', chr(2))")
_SPEC = " + ".join(f"0.15 * (CASE WHEN regexp_matches(t, {_q(p)}, 'i') THEN 1 ELSE 0 END)" for p in P.SPECIFIC)
_VAC = " - ".join(f"0.25 * (CASE WHEN regexp_matches(t, {_q(p)}, 'i') THEN 1 ELSE 0 END)" for p in P.VACUOUS if "(?!" not in p)
_MORE = "0.25 * (CASE WHEN regexp_matches(t, '\\bmore (details?|information|discussion|explanation)\\b', 'i') THEN 1 ELSE 0 END)"
ORACLES = {
    "b_09_word_count": X.CORPUS + r"SELECT ms_id, sum(len(regexp_extract_all(text, '[^\s]+')))::BIGINT AS words, count(*) AS paragraphs FROM lines GROUP BY ms_id",
    "h_24_match_keys": X.CORPUS + r", k AS (SELECT ms_id, regexp_replace(lower(regexp_replace(text, '\$[^$]*\$', ' ', 'g')), '[^0-9a-z]', '', 'g') AS key FROM lines) SELECT ms_id, count(DISTINCT key) AS keys, sum(length(key))::BIGINT AS characters FROM k GROUP BY ms_id",
    "h_41_features": X.CORPUS + rf""", a AS (SELECT ms_id, trim(text) AS t, regexp_extract_all(text, '[^\s]+') AS w, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, len(regexp_extract_all(text, '[A-Z]')) AS upper_, regexp_extract(trim(text), {_NUMBER}, 1) AS num FROM lines), b AS (
      SELECT ms_id, length(t)::DOUBLE AS n_chars, len(w)::DOUBLE AS n_words, (t LIKE '%.')::INT AS ends_period, (t LIKE '%:')::INT AS ends_colon, (regexp_matches(t, '[.,;:!?]$'))::INT AS ends_punct, (num <> '')::INT AS starts_number,
        CASE WHEN num <> '' THEN length(num) - length(replace(num, '.', '')) + 1 ELSE 0 END AS num_depth, (letters > 0 AND letters = upper_)::INT AS all_caps,
        (len(w) > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) / greatest(1, len(w))::DOUBLE > 0.6)::INT AS title_case, coalesce(upper_ / nullif(letters, 0)::DOUBLE, 0) AS upper_ratio,
        regexp_matches(t, '[0-9]')::INT AS has_digit, contains(t, ',')::INT AS has_comma, (len(w) <= 8)::INT AS short, (len(w) <= 4)::INT AS very_short, len(list_filter(w, lambda x: list_contains({_STOP}, lower(x)))) / greatest(1, len(w))::DOUBLE AS n_stopwords FROM a)
      SELECT ms_id, {', '.join(f'round(sum({n})::DOUBLE, 7) AS {n}' for n in ('n_chars', 'n_words', 'ends_period', 'ends_colon', 'ends_punct', 'starts_number', 'num_depth', 'all_caps', 'title_case', 'upper_ratio', 'has_digit', 'has_comma', 'short', 'very_short', 'n_stopwords'))} FROM b GROUP BY ms_id""",
    "h_01_roles": X.CORPUS + rf""", t AS (SELECT CASE WHEN idx % 2 = 0 THEN (idx + 1)::VARCHAR || '. ' || ({X._sql(_TITLES)})[(ms_id + idx) % {len(_TITLES)} + 1] ELSE substr(text, 1, 40) END AS title FROM lines),
      k AS (SELECT title, regexp_replace(lower(trim(regexp_replace(regexp_replace(title, {_NUMBER}, ''), '\s+', ' ', 'g'), ' .:;-')), '\s+', ' ', 'g') AS key FROM t)
      SELECT CASE {' '.join(f"WHEN regexp_matches(key, {_q(p)}) THEN '{r}'" for r, p in P.ROLE_PATTERNS)} ELSE 'unknown' END AS role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(title, {_NUMBER})) AS numbered FROM k GROUP BY ALL""",
    "h_03_heading_vetoes": X.CORPUS + rf""", r AS (SELECT ms_id, trim(text) AS a, trim(substr(text, greatest(1, length(text) - 5)) || ['', ';', ' [kW]', '@x', ' 3'][idx % 5 + 1]) AS b FROM lines)
      SELECT ms_id, count(*) FILTER (WHERE a = '' OR {' OR '.join(f'regexp_matches(a, {_q(p)})' for p in P.NOT_HEADING)}) AS lines, count(*) FILTER (WHERE b = '' OR {' OR '.join(f'regexp_matches(b, {_q(p)})' for p in P.NOT_HEADING)}) AS tails FROM r GROUP BY ms_id""",
    "h_27_furniture": X.CORPUS + rf""", r AS (SELECT CASE WHEN idx % 7 = 0 THEN ({X._sql(_PHRASES)})[ms_id % {len(_PHRASES)} + 1] || ' ' || text ELSE text END AS t FROM lines)
      SELECT CASE {' '.join(f"WHEN regexp_matches(t, {_q(p)}, 'i') THEN '{label}'" for p, label in P.FURNITURE)} END AS label, count(*) AS n FROM r GROUP BY ALL""",
    "i_21_writing": X.CORPUS + rf""", f AS (SELECT ms_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(regexp_extract_all(s, '[^\s]+'))), lambda n: n > 2) AS n,
        len(regexp_extract_all(text, '[^\s]+')) AS words, len(regexp_extract_all(regexp_replace(text, '\s+', '  ', 'g'), {_q(P.HEDGE.replace(' ', '  '))})) AS hedges FROM texts)
      SELECT ms_id, len(n)::BIGINT AS sentences, round(list_sum(n) / nullif(len(n), 0)::DOUBLE, 9) AS mean_words, round(len(list_filter(n, lambda x: x > 40)) / nullif(len(n), 0)::DOUBLE, 9) AS long_share, round(hedges / greatest(1.0, words / 1000.0::DOUBLE), 9) AS hedges_per_1000 FROM f""",
    "h_15_references": """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '' ELSE '10.1234/x' || l_partkey END AS doi, (1990 + l_suppkey % 30)::INT AS year, (l_linenumber + 10)::VARCHAR AS volume, (l_linenumber + 1)::VARCHAR AS issue,
        (l_suppkey + 100) || '-' || (l_suppkey + 120) AS page, 'A study of item ' || l_partkey || ' and its price' AS title, 'Miller|A. B.;Stone|C.' AS authors, round(CASE WHEN l_returnflag = 'R' THEN 0.9 ELSE 1.0 END, 6)::DOUBLE AS confidence
      FROM lineitem""",
    "h_18_keywords": "SELECT p_partkey, array_to_string(list_filter(list_concat(string_split(p_name, ' '), [p_brand]), lambda w: length(w) > 1), '/') AS keywords FROM part",
    "h_33_slugs": "SELECT p_partkey, trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS label FROM part",
    "h_36_quote_keys": r"""SELECT item_id, '"' || lower(trim(regexp_replace(translate(text, '’‘“”–—', '''''""--'), '\s+', ' ', 'g'))) || CASE WHEN regexp_matches(text, '\s$') THEN ' ' ELSE '' END || '" ''x'' --' AS quote_key FROM benchmark""",
    "h_28_number_words": "SELECT p_partkey, 'between ' || (p_size % 12 + 1) || ' and 12, someone' AS digits FROM part",
    "h_29_sentences": X.CORPUS + r""", s AS (SELECT ms_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n', chr(1), 'g'), '([.!?])[\s]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM texts)
      SELECT ms_id, len(s)::BIGINT AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest FROM s""",
    "h_42_latex_escape": X.CORPUS + ", r AS (SELECT ms_id, idx, text || ' 5% & $3 #1 a_b {c} ~ ^ \\x' AS t FROM lines) SELECT ms_id, idx, replace(replace(" + _ESCAPE.replace("\x01", "⟦⟧") + ", '⟦⟧', '{}'), chr(2), '\\textbackslash{}') AS latex FROM r",
    "h_46_fits": r"""WITH p AS (SELECT p_partkey, p_size::INT AS n, p_size % 2 + 1 AS cols FROM part), v AS (SELECT *, 2 * n + 2 + 2 + CASE WHEN n % 3 = 0 THEN n + 4 ELSE 0 END AS visual, 2 * n + 4 AS left_, n AS right_, CASE WHEN cols >= 2 THEN 46 ELSE 88 END AS room FROM p)
      SELECT p_partkey, visual::BIGINT AS visual, CASE WHEN visual <= room THEN 'keep' WHEN n % 3 = 0 AND left_ <= room AND right_ <= room THEN 'break' ELSE 'scale' END AS fit,
        cols >= 2 AND coalesce(n * 6.0 / nullif((n % 9) * 10.0, 0), 0) >= 1.8 AND n * 6.0 >= 88.9 * 1.2 AS spans, cols >= 2 AND n * 4 > 46 AS star,
        n * 4 > CASE WHEN cols < 2 THEN 88 WHEN n * 4 > 46 THEN 96 ELSE 46 END AS wraps, CASE WHEN NOT (cols >= 2 AND n * 4 > 46) THEN '' WHEN n * 4 <= 124.8 THEN 'small' ELSE 'footnotesize' END AS type_size, n % 4 = 0 AS degenerate FROM v""",
    "h_37_specificity": rf"""WITH c AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', ' ', 'g') AS x FROM conversations),
      r AS (SELECT conv_id, turn, substr(x, 1, 80) || ({X._sql(_WORDINGS)})[(conv_id + turn) % {len(_WORDINGS)} + 1] || ' ' || substr(x, 81, 90) AS t, substr(x, 81, 90) AS fix, substr(x, 171, 60) AS quote FROM c)
      SELECT conv_id, turn, round(greatest(0.0, least(1.0, 0.5 + {_SPEC} - {_VAC} - {_MORE} + CASE WHEN len(regexp_extract_all(fix, '[^\s]+')) >= 12 THEN 0.1 ELSE 0 END + CASE WHEN len(regexp_extract_all(quote, '[^\s]+')) >= 8 THEN 0.1 ELSE 0 END))::DOUBLE, 6) AS specificity FROM r""",
    "h_26_paths": "SELECT page_id, page_id % 3 <> 2 OR regexp_matches(url, '(?i)\\.(png|jpe?g|gif|bmp|tiff?|emf|wmf|pdf|eps)\\s*$') AS is_path FROM pages",
    "a_11_tag_counts": "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{t}[\\s>]'))::BIGINT AS n_{t}" for t in ("h1", "p", "li", "a", "script")) + " FROM pages",
    "e_17_emitted": X.CORPUS + r"""SELECT ms_id, count(*) FILTER (WHERE idx % 4 = 0) AS sections, count(*) FILTER (WHERE idx % 4 = 1) AS equations, count(*) FILTER (WHERE idx % 4 = 2) AS images, 0::BIGINT AS tables,
      count(*) FILTER (WHERE idx % 4 = 3) AS references, (sum(len(regexp_extract_all(text, '[^\s]+'))) + count(*))::BIGINT AS words FROM lines GROUP BY ms_id""",
    "h_30_mined_limits": """SELECT p_partkey AS ms_id, what, low, high FROM (
      SELECT p_partkey, 'abstract_words' AS what, (p_size + 100)::INT AS low, (p_size + 200)::INT AS high FROM part
      UNION ALL SELECT p_partkey, 'keyword_range', 3, (p_size % 6 + 5)::INT FROM part UNION ALL SELECT p_partkey, 'keyword_max', NULL, (p_size % 6 + 5)::INT FROM part
      UNION ALL SELECT p_partkey, 'highlight_range', 3, 5 FROM part UNION ALL SELECT p_partkey, 'highlight_chars', NULL, (p_size + 50)::INT FROM part
      UNION ALL SELECT p_partkey, 'title_chars', NULL, (p_size + 60)::INT FROM part UNION ALL SELECT p_partkey, 'dpi', NULL, (p_size * 10 + 100)::INT FROM part)""",
    "h_34_derived_profiles": """SELECT p_partkey AS ms_id, trim(regexp_replace(lower(p_name || ' Letters'), '[^a-z0-9]+', '_', 'g'), '_') AS profile_id, false AS verified, (p_size + 100)::INT AS abstract_min_words, (p_size + 200)::INT AS abstract_max_words,
      (p_size % 6 + 5)::INT AS keywords_max, (p_size + 60)::INT AS title_max_chars, (p_size * 10 + 100)::INT AS dpi_halftone, 4 AS max_references FROM part""",
    "h_20_front_matter": X.CORPUS + """SELECT ms_id, 'Title ' || ms_id AS title, 3::BIGINT AS authors, 1::BIGINT AS corresponding, 'Long:aff1,Miller:aff1,Stone:aff2' AS names, 'Norway' AS country
      FROM (SELECT ms_id, count(*) AS n FROM lines GROUP BY ms_id) WHERE ms_id % 2 = 0 AND n >= 3""",
}
