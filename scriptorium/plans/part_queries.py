"""Queries of the smaller operators on rows whose outcome is known row by row, with their SQL.

Parts and lines stand in; a key's remainder chooses among wordings, so that every rule has
rows on which it holds and rows on which it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import text as T
from scriptorium.operators import audit, floats, frontmatter, issues, layout, render, tree, views
from scriptorium.plans import adapters as X


def K() -> Column:  # noqa: N802
    """The key of a part."""
    return F.col("k")


def _pick(values: list, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _of(values: list, by: str = "k") -> str:
    """The same choice in SQL."""
    return f"([{', '.join(map(X._sql, values))}])[{by} % {len(values)} + 1]"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_partkey").cast("long").alias("ms_id"), F.col("p_size").cast("long").alias("n"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))


def _wide(df: DataFrame) -> DataFrame:
    """32-bit columns as 64-bit, as the SQL has them."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


_K = "k AS (SELECT p_partkey::BIGINT AS k, p_size::BIGINT AS n, p_name AS name, p_brand AS brand FROM part)"
QUERIES, ORACLES = {}, {}


def _query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: _wide(f(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return keep


# --- text functions ---

_NUMBERED = ["1. ", "2.3 ", "IV. ", "A) ", "(3) ", ""]


@_query("h_02_numbering", f"WITH {_K} SELECT k, {_of(['1', '2.3', 'IV', 'A', '3', ''])} AS number, 'Heading ' || k AS rest FROM k")
def numbering(spark, sf_dir):
    title = F.concat(_pick(_NUMBERED, K()), F.lit("Heading "), K().cast("string"))
    return _parts(spark, sf_dir).select("k", T.numbering_of(title).alias("number"), T.without_numbering(title).alias("rest"))


_SHAPES = ["2.1 Heat pumps", "Introduction", "Plain words here", "Plain words here.", "3 Plain words", "1.2.3.4.5 Deep"]


@_query("h_04_implicit_headings", f"""WITH {_K} SELECT k, {_of([2, 1, 1, 1, 1, 4])}::BIGINT AS level,
  k % 6 <> 3 AND k % 5 <> 0 AND (k % 2 = 0 OR k % 6 = 1 OR (k % 10 >= 9 AND k % 6 IN (0, 4, 5))) AS heading FROM k""")
def implicit_headings(spark, sf_dir):
    text = _pick(_SHAPES, K())
    heading = T.is_implicit_heading(text, K() % 2 == 0, K() % 5 == 0, (K() % 10) / 10.0)
    return _parts(spark, sf_dir).select("k", T.implicit_level(text).alias("level"), heading.alias("heading"))


@_query("h_05_classified_roles", f"""WITH {_K} SELECT k, CASE WHEN k % 3 = 0 THEN 'methods' WHEN k % 3 = 2 THEN 'conclusion' WHEN k % 4 = 3 AND k % 7 <> 0 THEN 'results' ELSE 'unknown' END AS role,
  CASE WHEN k % 3 <> 1 THEN 'heuristic' WHEN k % 4 = 3 AND k % 7 <> 0 THEN 'model' ELSE 'default' END AS method, CASE WHEN k % 3 <> 1 THEN 0.95 WHEN k % 4 = 3 AND k % 7 <> 0 THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence FROM k""")
def classified(spark, sf_dir):
    role = T.classified_role(_pick(["2. Methods", "Odd things", "Conclusions"], K()), F.lit("results"), F.when(K() % 7 != 0, (K() % 4) / 4.0))
    return _parts(spark, sf_dir).select("k", role.alias("r")).select("k", "r.*")


@_query("h_06_captions", f"""WITH {_K} SELECT k, {_of(['figure|3|A plot', '', 'table|A4|Values', ''])} AS anchored, {_of(['figure|3|A plot', 'fig|2-1|inset', 'table|A4|Values', ''])} AS anywhere FROM k""")
def captions(spark, sf_dir):
    text = _pick(["Figure 3. A plot", "see Fig. 2-1: inset", "Table A4 – Values", "No name here"], K())
    shown = lambda c: F.coalesce(F.concat(c["kind"], F.lit("|"), c["number"], F.lit("|"), c["rest"]), F.lit(""))
    return _parts(spark, sf_dir).select("k", shown(T.caption(text)).alias("anchored"), shown(T.caption(text, anywhere=True)).alias("anywhere"))


@_query("h_08_printed_numbers", f"WITH {_K} SELECT k, {_of(['12', 'A.3', '7', '', ''])} AS number FROM k")
def printed_numbers(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", T.equation_number(_pick(["(12)", "(A.3)", "7", "(x)", ""], K())).alias("number"))


@_query("h_09_display_formulas", f"WITH {_K} SELECT k, CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN CASE WHEN k % 3 = 0 THEN 0.75 END END::DOUBLE AS confidence FROM k")
def display_formulas(spark, sf_dir):
    run = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text"))
    formula = run("math", "a=b")
    inlines = F.when(K() % 4 == 0, F.array(formula)).when(K() % 4 == 1, F.array(formula, run("break", ""), run("text", " (3)"))).when(K() % 4 == 2, F.array(formula, run("text", "and words"))).otherwise(F.array(formula, formula))
    return _parts(spark, sf_dir).select("k", T.display_confidence(inlines, K() % 3 == 0).alias("confidence"))


@_query("h_14_patterns", f"WITH {_K} SELECT k, '10.1234/ab' || k AS doi, 'https://ex.org/p' || k AS url, '(2001a)' AS year, 'a.b' || k || '@mail.org' AS email, CASE WHEN k % 2 = 0 THEN '' ELSE 'Text' END AS unmarked FROM k")
def part_patterns(spark, sf_dir):
    key = K().cast("string")
    text = F.concat(F.lit("See doi:10.1234/ab"), key, F.lit(", https://ex.org/p"), key, F.lit(" (2001a) or a.b"), key, F.lit("@mail.org"))
    marked = F.concat(F.when(K() % 2 == 0, F.lit("")).otherwise(F.lit("[12] Text")))
    return _parts(spark, sf_dir).select("k", T.extracted(text, P.DOI, 1).alias("doi"), T.extracted(text, P.URL, 1).alias("url"), T.extracted(text, P.YEAR, 0).alias("year"), T.extracted(text, P.EMAIL, 0).alias("email"), T.replaced(marked, P.REFERENCE_MARKER).alias("unmarked"))


@_query("h_23_countries", f"WITH {_K} SELECT k, {_of(['Norway', '', 'Spain', ''])} AS country FROM k")
def countries(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", T.guess_country(_pick(["Institute, Oslo, Norway.", "Laboratory 5, Room 12", " Spain ", "A, B, C"], K())).alias("country"))


@_query("h_31_evidence", f"WITH {_K} SELECT k, {_of(['numeric', 'author-year', None])} AS style, {_of(['roman', 'arabic', None, None])} AS numbering FROM k")
def evidence(spark, sf_dir):
    cited = _pick(["As in [1] and [2], also [3].", "See (Miller, 2001), (Stone, 2002) and (Long, 2003).", "Nothing cited [1]."], K())
    headed = _pick(["I. INTRODUCTION\nwords\nII. METHODS\n", "1. Introduction\nwords\n2. Methods\n", "Plain\n", "1. Only one\n"], K())
    return _parts(spark, sf_dir).select("k", T.reference_style(cited).alias("style"), T.heading_numbering(headed).alias("numbering"))


@_query("h_35_line_spacing", f"WITH {_K} SELECT k, round_even(n * 20 / 240.0::DOUBLE, 2) AS spacing FROM k")
def line_spacing(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", T.line_spacing(F.col("n") * 20).alias("spacing"))


@_query("h_39_services", f"WITH {_K} SELECT k, {_of([True, False, True, False])} AS coder, {_of(['blocked', 'gone', 'key', 'limit', 'other', 'other'])} AS answer FROM k")
def services(spark, sf_dir):
    answer = T.service_error(_pick([403, 404, 401, 429, 500, 404], K()), _pick(["error code 1010", "Model NOT FOUND", "bad", "slow", "oops", "elsewhere"], K()))
    return _parts(spark, sf_dir).select("k", T.is_coder_model(_pick(["qwen-Coder:7b", "gpt", "CodeLlama", "plain"], K())).alias("coder"), answer.alias("answer"))


@_query("h_43_folded", f"WITH {_K} SELECT k, {_of(['naïve $' + chr(92) + 'alpha$ test', 'x2  1', 'plain'])} || k AS folded FROM k")
def folded(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", T.folded(F.concat(_pick(["naïve \U0001d6fc test", "x² − 1", "plain"], K()), K().cast("string"))).alias("folded"))


@_query("h_47_markers", f"WITH {_K} SELECT k, 'Miller' AS name, 'Institute ' || k AS place, {_of(['A plot', 'Values', 'Plain words'])} AS caption FROM k")
def markers(spark, sf_dir):
    return _parts(spark, sf_dir).select(
        "k", T.clean_name(F.concat(F.lit("Miller"), _pick(["1*", "†", ", 2", ""], K()))).alias("name"),
        T.without_marker(F.concat(_pick(["1. ", "* ", "2) ", ""], K()), F.lit("Institute "), K().cast("string"))).alias("place"), T.without_label(_pick(["Figure 3. A plot", "Table A4 - Values", "Plain words"], K())).alias("caption"),
    )


@_query("h_50_scripts", f"WITH {_K} SELECT k, k % 2 = 1 AS right_to_left FROM k")
def scripts(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", T.is_right_to_left(_pick(["left to right, é", "שלום words"], K())).alias("right_to_left"))


@_query("f_15_keyword_order", f"WITH {_K} SELECT k, array_to_string(list_transform(list_sort(list_transform(list_append(string_split(name, ' '), brand), lambda x: {{'k': lower(x), 'v': x}})), lambda s: s.v), '/') AS keywords FROM k")
def keyword_order(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", F.array_join(render.sorted_keywords(F.concat(F.split("name", " "), F.array("brand"))), "/").alias("keywords"))


# --- runs of a paragraph ---


def _run(kind, text, **more):
    fields = dict(bold=False, italic=False, code=False, subscript=False, superscript=False, smallcaps=False, url="", target_id="") | more
    lits = [F.lit(kind).alias("kind"), (text if isinstance(text, Column) else F.lit(text)).alias("text"), *[F.lit(v).alias(k) for k, v in fields.items() if k != "ref_ids"]]
    return F.struct(*lits, F.array(*map(F.lit, fields.get("ref_ids", []))).cast("array<string>").alias("ref_ids"))


def _runs() -> Column:
    n = F.col("n").cast("string")
    return F.array(_run("text", F.concat(F.lit("5% of "), n), bold=True, italic=True), _run("break", ""), _run("math", "a_1"), _run("link", "site", url="http://x.org"), _run("xref", "2", target_id="fig-2"), _run("cite", "[1]", ref_ids=["ref1", "ref2"]), _run("math", "{ }"))


@_query("h_44_rendered_runs", f"WITH {_K} " + r"SELECT k, '\textbf{\emph{5\% of ' || n || '}}\\' || chr(10) || '$a_1$\href{http://x.org}{site}\ref{fig2}\cite{ref1,ref2}[equation]' AS latex, '5% of ' || n || ' $a_1$site2[1]${ }$' AS plain FROM k")
def rendered_runs(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", render.inlines(_runs()).alias("latex"), render.plain_text(_runs()).alias("plain"))


@_query("h_25_caption_runs", f"WITH {_K} SELECT k, CASE WHEN n % 12 < 7 THEN substr('Fig. 1 ', n % 12 + 1) || 'A plot' WHEN n % 12 < 13 THEN substr('A plot', n % 12 - 6) END || '$x$ end' AS kept FROM k")
def caption_runs(spark, sf_dir):
    runs = F.array(_run("text", "Fig. 1 "), _run("text", "A plot"), _run("math", "x"), _run("text", " end"))
    return _parts(spark, sf_dir).select("k", render.plain_text(render.without_label(runs, F.col("n") % 12)).alias("kept"))


@_query("e_03_inline_formulas", f"WITH {_K} SELECT k // 4 AS ms_id, sum(n % 3)::BIGINT AS every, sum(CASE WHEN k % 2 = 0 THEN n % 3 END)::BIGINT AS top FROM k GROUP BY 1")
def inline_formulas(spark, sf_dir):
    """E-03 and E-20: formulas in all blocks, and in those that no block holds."""
    math, word = (F.struct(F.lit(kind).alias("kind")) for kind in ("math", "text"))
    runs = F.concat(F.array(word), F.array_repeat(math, (F.col("n") % 3).cast("int")))
    rows = _parts(spark, sf_dir).select(F.floor(K() / 4).alias("ms_id"), runs.alias("inlines"), F.when(K() % 2 == 1, K()).alias("parent"))
    return audit.inline_formulas(rows).withColumnRenamed("n", "every").join(views.numbered_display(rows).withColumnRenamed("formulas", "top"), "ms_id", "left")


# --- views ---


@_query("e_18_publishers", "SELECT * FROM (VALUES ('A', 'Alpha', 'alpha', true), ('B', 'Beta', 'beta', false), ('C', 'Gamma', 'gamma', true)) AS t(publisher, journal, profile_id, verified)")
def publishers(spark, sf_dir):
    return views.publishers(X.profiles(spark))


@_query("e_19_selected_words", X.CORPUS + r"SELECT ms_id, sum(len(regexp_extract_all(text, '[^\s]+')))::BIGINT AS words FROM lines WHERE idx BETWEEN 1 AND 3 GROUP BY ms_id")
def selected_words(spark, sf_dir):
    return views.selected_words(X.lines(spark, sf_dir), 1, 3)


@_query("f_13_tail", f"WITH {_K} SELECT k, brand FROM k ORDER BY k DESC LIMIT 200")
def tail(spark, sf_dir):
    return views.tail(_parts(spark, sf_dir).select("k", "brand"), "k")


@_query("f_21_default_ranges", X.CORPUS + """, f AS (SELECT ms_id, max(idx) AS final FROM lines GROUP BY 1), g AS (SELECT ms_id, final, least(CASE WHEN ms_id % 2 = 0 THEN ms_id % 7 ELSE -1 END + 1, greatest(final, 0)) AS first FROM f)
  SELECT ms_id, first::BIGINT AS first, least(first + 2, final)::BIGINT AS last FROM g""")
def default_ranges(spark, sf_dir):
    ends = X.texts(spark, sf_dir).where("ms_id % 2 = 0").select("ms_id", (F.col("ms_id") % 7).cast("int").alias("end"))
    return views.default_ranges(X.lines(spark, sf_dir), ends.unionAll(ends.withColumn("end", F.lit(0))))


_TOPS = [["unknown"], ["results", "methods", "unknown", "results"], []]
_WANTED = [(i, p["profile_id"], ",".join(r for r in dict.fromkeys([*p["required_sections"], *[t for t in tops if t != "unknown"], *views.ESSENTIAL]) if r not in views.NOT_SELECTED)) for i, tops in enumerate(_TOPS) for p in X.PROFILES]


@_query("f_22_wanted_roles", f"WITH {_K}, w(i, profile_id, wanted) AS (VALUES {', '.join(map(str, _WANTED))}) SELECT k AS ms_id, profile_id, wanted FROM k JOIN w ON k % 3 = i")
def wanted_roles(spark, sf_dir):
    tops = F.element_at(F.array(*[F.array(*map(F.lit, t)).cast("array<string>") for t in _TOPS]), (K() % 3 + 1).cast("int"))
    return views.wanted_roles(_parts(spark, sf_dir).select("ms_id", tops.alias("top_roles")), X.profiles(spark)).withColumn("wanted", F.array_join("wanted", ","))


@_query("k_14_matching", X.CORPUS + "SELECT ms_id, idx::BIGINT AS idx, idx % 3 = 0 AS is_heading FROM lines WHERE contains(lower(text), 'the on') AND idx % 3 = 0")
def matching(spark, sf_dir):
    return views.matching(X.lines(spark, sf_dir).withColumn("is_heading", F.col("idx") % 3 == 0), "The ON", headings_only=True).select("ms_id", "idx", "is_heading")


@_query("k_15_front_edits", X.CORPUS + """SELECT ms_id, CASE WHEN ms_id % 3 = 0 THEN 'New' ELSE title END AS title, CASE WHEN ms_id % 3 = 1 THEN 'a|b' ELSE array_to_string(keywords, '|') END AS keywords, CASE WHEN ms_id % 3 < 2 THEN 'explicit' ELSE 'heuristic' END AS method FROM manuscripts""")
def front_edits(spark, sf_dir):
    third = F.col("ms_id") % 3
    edits = X.texts(spark, sf_dir).select("ms_id", F.when(third == 0, "New").alias("title"), F.when(third == 1, " a ;; b").alias("keywords"), F.lit(None).cast("string").alias("highlights"))
    return views.edited_front(X.manuscripts(spark, sf_dir), edits).select("ms_id", "title", F.array_join("keywords", "|").alias("keywords"), "method")


@_query("k_16_role_edits", X.CORPUS + "SELECT ms_id, sec_ord::BIGINT AS sec_ord, CASE WHEN sec_ord % 2 = 0 THEN 'methods' ELSE role END AS role, sec_ord % 2 = 0 AND role <> 'methods' AS explicit FROM sections")
def role_edits(spark, sf_dir):
    s = X.sections(spark, sf_dir)
    return views.with_roles(s, s.where("sec_ord % 2 = 0").select("ms_id", "sec_ord", F.lit("methods").alias("role"))).select("ms_id", "sec_ord", "role", F.coalesce("explicit", F.lit(False)).alias("explicit"))


@_query("k_17_to_confirm", X.CORPUS + "SELECT ms_id, count(*) FILTER (WHERE sec_ord % 10 < 6) AS unsure, round(avg((sec_ord % 10 >= 6)::INT), 9) AS progress FROM sections GROUP BY ms_id")
def to_confirm(spark, sf_dir):
    s = X.sections(spark, sf_dir).withColumn("role_confidence", F.when(F.col("sec_ord") % 10 > 0, (F.col("sec_ord") % 10) / 10.0))
    return views.to_confirm(s).withColumn("progress", F.round("progress", 9))


@_query("b_23_stats", X.CORPUS + ", " + ", ".join(f"c_{n} AS (SELECT ms_id, count(*) AS n FROM {t} GROUP BY 1)" for n, t in (("sections", "sections"), ("figures", "figures"), ("tables", "tables_"), ("refs", "refs"), ("issues", "issues"))) + " SELECT m.ms_id, " + ", ".join(f"coalesce(c_{n}.n, 0) AS {n}" for n in ("sections", "figures", "tables", "refs", "issues")) + " FROM manuscripts m " + " ".join(f"LEFT JOIN c_{n} ON c_{n}.ms_id = m.ms_id" for n in ("sections", "figures", "tables", "refs", "issues")))
def stats(spark, sf_dir):
    corpus = X.corpus(spark, sf_dir)
    return views.stats(corpus["manuscripts"], **{n: corpus[n] for n in ("sections", "figures", "tables", "refs", "issues")})


@_query("a_24_caption_paragraphs", X.CORPUS + "SELECT ms_id, idx::BIGINT AS idx, text FROM lines WHERE idx % 4 < 2")
def caption_paragraphs(spark, sf_dir):
    return views.caption_paragraphs(X.lines(spark, sf_dir).withColumn("style", _pick(["Caption", "caption", "Normal", "Captions"], F.col("idx")))).select("ms_id", "idx", "text")


@_query("n_15_baselines", X.CORPUS + r""", p AS (SELECT DISTINCT ms_id, left(regexp_replace(lower(regexp_replace(text, '\$[^$]*\$', ' ', 'g')), '[^0-9a-z]', '', 'g'), 40) AS key FROM lines WHERE length(left(regexp_replace(lower(regexp_replace(text, '\$[^$]*\$', ' ', 'g')), '[^0-9a-z]', '', 'g'), 40)) >= 20),
  w AS (SELECT 'whole' AS converter, ms_id, regexp_replace(lower(regexp_replace(text, '\$[^$]*\$', ' ', 'g')), '[^0-9a-z]', '', 'g') AS t FROM texts UNION ALL SELECT 'first', ms_id, regexp_replace(lower(regexp_replace(text, '\$[^$]*\$', ' ', 'g')), '[^0-9a-z]', '', 'g') FROM lines WHERE idx = 0)
  SELECT converter, count(*) AS paragraphs, count(*) FILTER (WHERE contains(t, key)) AS retained FROM p JOIN w USING (ms_id) GROUP BY 1""")
def baselines(spark, sf_dir):
    lines, whole = X.lines(spark, sf_dir), X.texts(spark, sf_dir)
    converted = whole.select(F.lit("whole").alias("converter"), "ms_id", "text").unionByName(lines.where("idx = 0").select(F.lit("first").alias("converter"), "ms_id", "text"))
    return views.baselines(lines, converted)


@_query("n_23_deduplicated", X.CORPUS + "SELECT ms_id, severity, code, min(seq)::BIGINT AS seq, count(*) AS n FROM issues GROUP BY ALL")
def deduplicated(spark, sf_dir):
    return views.deduplicated(X.corpus(spark, sf_dir)["issues"]).select("ms_id", "severity", "code", "seq", "n")


@_query("b_08_targets", X.CORPUS + "SELECT l.ms_id, l.idx::BIGINT AS idx, f.fig_id AS target_id, f.fmt FROM lines l JOIN figures f ON f.ms_id = l.ms_id AND f.fig_id = 'fig' || (l.ms_id * 3 + l.idx)")
def targets(spark, sf_dir):
    points = X.lines(spark, sf_dir).select("ms_id", "idx", F.concat(F.lit("fig"), (F.col("ms_id") * 3 + F.col("idx")).cast("string")).alias("target_id"))
    return views.of_target(points, X.figures(spark, sf_dir), "fig_id").select("ms_id", "idx", "target_id", "fmt")


@_query("b_06_preorder", X.CORPUS + "SELECT ms_id, sec_ord::BIGINT AS sec_ord, role FROM sections")
def preorder(spark, sf_dir):
    return views.in_order(X.sections(spark, sf_dir)).select("ms_id", "sec_ord", "role")


@_query("n_02_blocks", f"WITH {_K} SELECT k FROM k WHERE k % 3 = 0")
def stream_blocks(spark, sf_dir):
    return views.found_blocks(_parts(spark, sf_dir).select("k", _pick(["block", "issue", "figure"], K()).alias("record"))).select("k")


# --- trees ---


@_query("b_07_first_by_role", X.CORPUS + "SELECT ms_id, role, min(sec_ord)::BIGINT AS sec_ord FROM sections GROUP BY ALL")
def first_by_role(spark, sf_dir):
    return tree.first_by_role(X.sections(spark, sf_dir)).select("ms_id", "role", "sec_ord")


@_query("f_01_numbered", X.CORPUS + "SELECT ms_id, sec_ord::BIGINT AS sec_ord, 's' || row_number() OVER (PARTITION BY ms_id ORDER BY sec_ord) AS sec_id FROM sections")
def numbered(spark, sf_dir):
    return tree.numbered(X.sections(spark, sf_dir), "s", "sec_ord", "sec_id").select("ms_id", "sec_ord", "sec_id")


@_query("b_20_unwrapped", f"""WITH {_K}, s AS (SELECT k, unnest([0, 1, 2, 3]) AS o FROM k) SELECT k AS ms_id, o::BIGINT AS sec_ord, o = 0 AND k % 2 = 0 AND k % 3 > 0 AS unwrapped,
  CASE WHEN o = 0 THEN 1 WHEN k % 2 = 0 AND k % 3 > 0 THEN greatest(1, [1, 2, 2, 3][o + 1] - 1) ELSE [1, 2, 2, 3][o + 1] END::BIGINT AS level FROM s""")
def unwrapped(spark, sf_dir):
    """A section with the title's words, or others; its children have two canonical roles, or one twice."""
    second = F.when(K() % 3 > 0, "results").otherwise("methods")
    rows = [(0, 1, F.concat(F.lit("A Title of "), K().cast("string")), F.lit("unknown")), (1, 2, F.lit("Methods"), F.lit("methods")), (2, 2, F.lit("Then"), second), (3, 3, F.lit("Deep"), F.lit("unknown"))]
    made = F.array(*[F.struct(F.lit(o).alias("sec_ord"), F.lit(v).alias("level"), t.alias("title_raw"), r.alias("role")) for o, v, t, r in rows])
    sections = _parts(spark, sf_dir).select("ms_id", "k", F.inline(made)).drop("k")
    titles = _parts(spark, sf_dir).select("ms_id", F.when(K() % 2 == 0, F.concat(F.lit("a TITLE of "), K().cast("string"))).otherwise("Something else").alias("title"))
    return tree.unwrap_title(sections, titles, ["introduction", "methods", "results", "conclusion"]).select("ms_id", "sec_ord", "unwrapped", "level")


# --- reconciliation ---


def _blocked(spark, sf_dir):
    return audit.blocking(_parts(spark, sf_dir).select("ms_id", (K() % 2).alias("mathtype"), (K() % 3).alias("citation_fields"), (K() % 5).alias("refs"), F.when(K() % 7 == 0, 2).alias("unconvertible")))


@_query("e_05_blocking", f"WITH {_K} SELECT k AS ms_id, array_to_string(list_filter([CASE WHEN k % 2 > 0 THEN 'mathtype_objects' END, CASE WHEN k % 3 = 0 AND k % 5 > 0 THEN 'hand_typed_references' END, CASE WHEN k % 7 = 0 THEN 'unconvertible_figures' END], lambda x: x IS NOT NULL), ',') AS blocking FROM k")
def blocking(spark, sf_dir):
    return _blocked(spark, sf_dir).withColumn("blocking", F.array_join("blocking", ","))


@_query("e_06_ready", f"WITH {_K} SELECT k AS ms_id, NOT (k % 2 > 0 OR (k % 3 = 0 AND k % 5 > 0) OR k % 7 = 0) AND (k % 4 = 0 OR k % 11 > 0) AS ready FROM k")
def ready(spark, sf_dir):
    checks = _parts(spark, sf_dir).where("k % 4 <> 0").select("ms_id", F.explode(F.array(F.lit(True), K() % 11 > 0)).alias("ok"))
    return audit.ready(checks, _blocked(spark, sf_dir))


@_query("h_55_distinct_paragraphs", X.CORPUS + r", t AS (SELECT ms_id, idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS key FROM lines) SELECT ms_id, min(idx)::BIGINT AS idx FROM t WHERE length(key) >= 25 GROUP BY ms_id, key")
def distinct_paragraphs(spark, sf_dir):
    return audit.distinct_paragraphs(X.lines(spark, sf_dir)).select("ms_id", "idx")


@_query("h_56_compared", X.CORPUS + "SELECT ms_id, count(DISTINCT text) AS lost FROM lines l WHERE NOT EXISTS (SELECT 1 FROM lines m WHERE m.ms_id = l.ms_id AND m.text = l.text AND m.idx % 3 <> 0) GROUP BY ms_id")
def compared(spark, sf_dir):
    lines = X.lines(spark, sf_dir)
    return audit.compared(lines, lines.where("idx % 3 <> 0"))


@_query("l_18_build_notes", f"WITH {_K} SELECT k AS ms_id, w AS what, (n % 3)::BIGINT AS expected, CASE w WHEN 'sections' THEN k % 3 ELSE 1 END::BIGINT AS emitted, CASE w WHEN 'sections' THEN k % 3 ELSE 1 END >= n % 3 AS ok FROM k, (VALUES ('sections'), ('images')) AS v(w)")
def build_notes(spark, sf_dir):
    produced = _parts(spark, sf_dir).select("ms_id", F.concat(F.lit("\\begin{document}\\includegraphics{a} "), F.repeat(F.lit("\\section{x} "), (K() % 3).cast("int"))).alias("latex"))
    expected = _parts(spark, sf_dir).select("ms_id", F.explode(F.array(F.lit("sections"), F.lit("images"))).alias("what"), (F.col("n") % 3).alias("n"))
    return render.build_notes(produced, expected).select("ms_id", "what", "expected", "emitted", "ok")


@_query("l_19_outcome", f"WITH {_K} SELECT k AS ms_id, k % 2 = 0 OR n + 1 < 50 AS empty_body FROM k")
def outcome(spark, sf_dir):
    body = F.concat(F.lit("\\begin{document}"), F.when(K() % 2 == 1, "\\section{one} ").otherwise(""), F.repeat(F.lit("word "), F.col("n").cast("int")))
    return render.outcome(_parts(spark, sf_dir).select("ms_id", body.alias("latex")))


@_query("d_11_affiliations", f"WITH {_K} SELECT k AS ms_id, 'au' AS au_id, CASE WHEN k % 2 = 0 THEN '1,2' ELSE '2' END AS places FROM k")
def affiliations(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    people = parts.select("ms_id", F.lit("au").alias("au_id"), F.when(K() % 2 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("gone"))).alias("affiliation_ids"))
    places = parts.select("ms_id", F.inline(F.array(F.struct(F.lit("b").alias("aff_id"), F.lit(9).alias("ord")), F.struct(F.lit("a").alias("aff_id"), F.lit(4).alias("ord")))))
    return render.affiliations_of(people, places).withColumn("places", F.array_join(F.transform("places", lambda p: p.cast("string")), ","))


@_query("l_15_blocks", f"""WITH {_K} SELECT k, CASE k % 5 WHEN 0 THEN '\\subsection{{A \\& B}}' WHEN 1 THEN '\\begin{{equation}}' || chr(10) || 'A & B' || chr(10) || '\\end{{equation}}' WHEN 2 THEN '\\begin{{verbatim}}' || chr(10) || 'A & B' || chr(10) || '\\end{{verbatim}}'
  WHEN 3 THEN '\\begin{{quote}}' || chr(10) || 'A \\& B' || chr(10) || '\\end{{quote}}' ELSE 'A \\& B' END AS latex FROM k""")
def blocks(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("ms_id", "k", (K() % 5 == 0).alias("is_heading"), F.lit(1).alias("depth"), _pick(["heading", "equation_ref", "code", "quote", "paragraph"], K()).alias("kind"), F.lit("A & B").alias("text"), F.lit("").alias("target_id"))
    return render.blocks(rows).select("k", "latex")


# --- floats and issues ---


@_query("d_01_files", f"WITH {_K} SELECT k AS ms_id, 'm' || k || '.png' AS target FROM k WHERE k % 3 > 0")
def files(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    rels = parts.where("k % 3 > 0").select("ms_id", F.lit("r1").alias("rid"), F.concat(F.lit("m"), K().cast("string"), F.lit(".png")).alias("target"))
    return floats.with_files(parts.select("ms_id", F.lit("r1").alias("rid")), rels).select("ms_id", "target")


def _empty_cells(spark, sf_dir):
    return _parts(spark, sf_dir).select(F.floor(K() / 3).alias("ms_id"), F.lit("t").alias("tab_id"), F.when(F.col("n") % 2 == 0, " ").alias("text"), (F.col("n") % 5 == 0).cast("int").alias("n_math"))


@_query("b_22_empty_tables", f"WITH {_K} SELECT k // 3 AS ms_id, 't' AS tab_id FROM k GROUP BY 1 HAVING count(*) FILTER (WHERE n % 5 = 0) = 0")
def empty_tables(spark, sf_dir):
    return floats.empty_tables(_empty_cells(spark, sf_dir))


def _anchored(spark, sf_dir):
    """Texts of three long paragraphs; a caption that is found, a neighbour that is, or neither."""
    parts = _parts(spark, sf_dir)
    line = lambda j: F.concat(F.lit(f"Paragraph {j} of the document number "), K().cast("string"))
    rows = F.array(*[F.struct(F.lit(j).alias("pos"), line(j).alias("text")) for j in range(3)])
    stream = parts.select("ms_id", "k", F.inline(rows)).drop("k")
    source = parts.select("ms_id", "k", F.inline(F.array(*[F.struct(F.lit(j).alias("idx"), F.when(K() % 3 == 2, "words that are not there at all").otherwise(line(j)).alias("text")) for j in range(3)]))).drop("k")
    figures = parts.select("ms_id", F.lit("fig1").alias("fig_id"), F.lit(1).alias("para_index"), F.when(K() % 3 == 0, F.lit("PARAGRAPH 2 of the")).otherwise(F.lit("short")).alias("caption"))
    return stream, floats.anchors(figures, stream, source)


_ANCHORS = "a AS (SELECT k AS ms_id, 'fig1' AS fig_id, [2, 1, 1][k % 3 + 1] AS pos, ['caption', 'neighbour', 'estimated'][k % 3 + 1] AS method FROM k)"


@_query("d_05_anchors", f"WITH {_K}, {_ANCHORS} SELECT ms_id, fig_id, pos::BIGINT AS pos, method FROM a")
def anchors(spark, sf_dir):
    return _anchored(spark, sf_dir)[1]


@_query("d_08_inserted", f"""WITH {_K}, {_ANCHORS}, e AS (SELECT k AS ms_id, unnest(CASE WHEN k % 2 = 0 THEN [0, 1, 2] ELSE [1, 2] END) AS pos, 1 AS after, NULL AS fig_id FROM k UNION ALL SELECT ms_id, pos, 0, fig_id FROM a)
  SELECT ms_id, pos::BIGINT AS pos, fig_id, row_number() OVER (PARTITION BY ms_id ORDER BY pos, after, fig_id) - 1 AS new_pos FROM e""")
def inserted(spark, sf_dir):
    stream, placed = _anchored(spark, sf_dir)
    return floats.inserted(stream, placed, stream.where("ms_id % 2 = 1 AND pos = 0").select("ms_id", "pos")).select("ms_id", "pos", "fig_id", "new_pos")


@_query("m_float_issues", f"""WITH {_K}, {_ANCHORS}, o AS (SELECT k // 8 AS ms_id, count(*) AS c, list('f' || k ORDER BY 'f' || k) AS names FROM k GROUP BY 1), i AS (
  SELECT ms_id, 'info' AS severity, 'orphan_media' AS code, c || ' media files are not referred to: ' || array_to_string(names[1:5], ', ') AS message, '' AS location FROM o
  UNION ALL SELECT k, 'warning', 'missing_caption', 'fig' || k || ' has no caption that could be found.', 'fig' || k FROM k WHERE k % 4 < 2 UNION ALL SELECT k, 'warning', 'missing_caption', 'tab' || k || ' has no caption that could be found.', 'tab' || k FROM k WHERE k % 5 = 0
  UNION ALL SELECT k, 'info', 'floating_image', 'A floating image: its place in the reading order is approximate.', 'fig' || k FROM k WHERE n % 2 = 0
  UNION ALL SELECT ms_id, 'info', 'figure_anchored_by_neighbour', 'Placed beside a paragraph near it in the source.', fig_id FROM a WHERE method = 'neighbour'
  UNION ALL SELECT ms_id, 'warning', 'figure_position_estimated', 'Placed in proportion to its place in the source.', fig_id FROM a WHERE method = 'estimated')
  SELECT *, row_number() OVER (PARTITION BY ms_id ORDER BY severity, code, location, message) AS seq FROM i""")
def float_issues(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    name = lambda prefix: F.concat(F.lit(prefix), K().cast("string"))
    return issues.numbered(
        issues.orphan_media(parts.select(F.floor(K() / 8).alias("ms_id"), name("f").alias("filename"))),
        issues.missing_captions(parts.select("ms_id", name("fig").alias("float_id"), _pick(["", None, "A", "B"], K()).alias("caption"))),
        issues.missing_captions(parts.select("ms_id", name("tab").alias("float_id"), F.when(K() % 5 == 0, "").otherwise("T").alias("caption"))),
        issues.floating_images(parts.select("ms_id", name("fig").alias("fig_id"), (F.col("n") % 2 == 0).alias("floating"))), issues.estimated_positions(_anchored(spark, sf_dir)[1]),
    )


@_query("m_table_issues", f"""WITH {_K} SELECT k // 4 AS ms_id, 'info' AS severity, 'equation_table' AS code, 'A table of ' || count(*) || ' rows only lays out numbered equations.' AS message, 'tab' || n % 2 AS location FROM k GROUP BY k // 4, n % 2
  UNION ALL SELECT k // 3, 'info', 'layout_table_dropped', '1 empty layout tables were dropped.', '' FROM k GROUP BY 1 HAVING count(*) FILTER (WHERE n % 5 = 0) = 0
  UNION ALL SELECT k, 'warning', 'eqnum_mismatch', 'Printed as 7, in place 1', '5' FROM k WHERE k % 2 = 0""")
def table_issues(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    rows = parts.select(F.floor(K() / 4).alias("ms_id"), F.concat(F.lit("tab"), (F.col("n") % 2).cast("string")).alias("tab_id"))
    printed = tree.number_mismatches(parts.select("ms_id", F.lit(5).alias("ord"), F.when(K() % 2 == 0, "7").otherwise("1").alias("number_raw")))
    return issues.layout_tables(rows, floats.empty_tables(_empty_cells(spark, sf_dir))).unionByName(issues.number_mismatches(printed))


@_query("m_heading_issues", f"""WITH {_K}, s AS (SELECT k // 4 AS ms_id, k, n, {_of(['unknown', 'methods'])} AS role FROM k)
  SELECT ms_id, 'info' AS severity, 'boilerplate_heading_demoted' AS code, count(*) || ' headings belong to the template.' AS message, '' AS location FROM s GROUP BY 1
  UNION ALL SELECT ms_id, 'info', 'implicit_headings', count(*) || ' paragraphs were taken as headings, ' || count(*) FILTER (WHERE n % 3 = 0) || ' of them by the model.', '' FROM s GROUP BY 1
  UNION ALL SELECT ms_id, 'info', 'title_wrapper_unwrapped', 'A section that was the title''s own was opened.', k::VARCHAR FROM s WHERE n % 7 = 0
  UNION ALL SELECT ms_id, 'info', 'role_model_used', count(*) || ' roles were given by the model.', '' FROM s WHERE n % 2 = 0 GROUP BY 1
  UNION ALL SELECT ms_id, 'warning', 'unclassified_sections', count(*) || ' sections have no role: ' || string_agg('T' || k, '; ' ORDER BY k), '' FROM s WHERE role = 'unknown' GROUP BY 1""")
def heading_issues(spark, sf_dir):
    rows = _parts(spark, sf_dir).select(F.floor(K() / 4).alias("ms_id"), K().alias("sec_ord"), "n", _pick(["unknown", "methods"], K()).alias("role"), F.lit(1).alias("level"), F.concat(F.lit("T"), K().cast("string")).alias("title_raw"), F.when(F.col("n") % 2 == 0, "model").otherwise("default").alias("role_method"))
    found = issues.headings(rows, rows.select("ms_id", (F.col("n") % 3 == 0).alias("by_model")), rows.select("ms_id", "sec_ord", (F.col("n") % 7 == 0).alias("unwrapped")))
    return found.unionByName(issues.roles(rows))


@_query("m_lost_text", X.CORPUS + r""", l AS (SELECT ms_id, idx, text, row_number() OVER (PARTITION BY ms_id ORDER BY idx) AS n FROM lines WHERE idx % 4 = 1)
  SELECT ms_id, 'error' AS severity, 'text_lost_by_reader' AS code, count(*) || ' paragraphs were lost, ' || sum(len(regexp_extract_all(text, '[^\s]+')))::BIGINT || ' words.' AS message, '' AS location FROM l GROUP BY 1
  UNION ALL SELECT ms_id, 'warning', 'recovered_paragraph', left(text, 90), idx::VARCHAR FROM l WHERE n <= 12""")
def lost_text(spark, sf_dir):
    return issues.lost_text(X.lines(spark, sf_dir).where("idx % 4 = 1"))


# --- front matter ---


def _abstract_blocks(spark, sf_dir):
    """An abstract of two paragraphs and, in every third, a line of keywords at its end or between them."""
    rows = [(0, F.lit("First part."), K() >= 0), (1, F.lit("Keywords: a; b"), K() % 3 == 1), (2, F.lit("Second part."), K() % 4 > 0), (3, F.lit(" Index terms - c"), K() % 3 > 0)]
    made = F.array(*[F.when(on, F.struct(F.lit(o).alias("blk_ord"), t.alias("text"))) for o, t, on in rows])
    return _parts(spark, sf_dir).select("ms_id", F.inline(F.filter(made, lambda r: r.isNotNull())))


_ABSTRACTS = "a AS (SELECT k AS ms_id, CASE WHEN k % 4 > 0 THEN 'First part.' || CASE WHEN k % 3 = 1 THEN ' Keywords: a; b' ELSE '' END || ' Second part.' ELSE 'First part.' END AS abstract_raw, CASE WHEN k % 4 > 0 THEN CASE WHEN k % 3 = 1 THEN 3 ELSE 2 END ELSE 1 END AS paragraphs, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 AND k % 4 = 0 THEN 2 ELSE 1 END AS split_keywords FROM k)"


@_query("h_19_abstracts", f"WITH {_K}, {_ABSTRACTS} SELECT ms_id, abstract_raw, paragraphs::BIGINT AS paragraphs, split_keywords::BIGINT AS split_keywords FROM a")
def abstracts(spark, sf_dir):
    return frontmatter.abstract(_abstract_blocks(spark, sf_dir))


def _keyword_lists(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    sections = parts.where("k % 2 = 0").select("ms_id", F.lit(1).alias("sec_ord"), F.lit("keywords").alias("role"))
    rows = parts.where("k % 5 > 0").select("ms_id", F.inline(F.array(F.struct(F.lit(1).alias("sec_ord"), F.lit(0).alias("blk_ord"), F.lit("pump; heat").alias("text")), F.struct(F.lit(2).alias("sec_ord"), F.lit(0).alias("blk_ord"), F.lit("Keywords: run, in").alias("text")))))
    return frontmatter.keywords(sections, rows)


@_query("h_18_keyword_sections", f"WITH {_K} SELECT k AS ms_id, CASE WHEN k % 2 = 0 THEN 'pump/heat' ELSE 'run/in' END AS keywords FROM k WHERE k % 5 > 0")
def keyword_sections(spark, sf_dir):
    return _keyword_lists(spark, sf_dir).withColumn("keywords", F.array_join("keywords", "/"))


@_query("m_front_issues", f"""WITH {_K}, {_ABSTRACTS} SELECT k AS ms_id, 'warning' AS severity, 'title_heuristic' AS code FROM k WHERE k % 3 = 0 UNION ALL SELECT k, 'error', 'no_title' FROM k WHERE k % 3 = 1 UNION ALL SELECT k, 'error', 'no_abstract' FROM k WHERE k % 7 = 0
  UNION ALL SELECT ms_id, 'info', 'keywords_split_from_abstract' FROM a WHERE split_keywords > 0 AND ms_id % 7 > 0 UNION ALL SELECT k, 'warning', 'no_keywords' FROM k WHERE k % 5 = 0 UNION ALL SELECT k, 'warning', 'authors_heuristic' FROM k WHERE k % 2 = 0 UNION ALL SELECT k, 'error', 'no_authors' FROM k WHERE k % 2 = 1""")
def front_issues(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    titles = parts.select("ms_id", F.when(K() % 3 == 1, "").otherwise("T").alias("title"), _pick(["heuristic", "default", "explicit"], K()).alias("method"))
    return frontmatter.front_issues(titles, frontmatter.abstract(_abstract_blocks(spark, sf_dir).where("ms_id % 7 > 0")), _keyword_lists(spark, sf_dir), parts.where("k % 2 = 0").select("ms_id"), parts)


# --- pages ---


def _paragraphs(spark, sf_dir):
    return X.lines(spark, sf_dir).withColumn("has_drawing", F.col("idx") % 6 == 0).withColumn("width_mm", (F.col("idx") * 7).cast("double"))


@_query("l_01_masthead", X.CORPUS + r""", t AS (SELECT ms_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS title FROM lines WHERE idx = 2)
  SELECT l.ms_id, coalesce(min(idx) FILTER (WHERE title <> '' AND lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) = title), least(12, count(*)))::BIGINT AS masthead_end FROM lines l LEFT JOIN t ON t.ms_id = l.ms_id GROUP BY l.ms_id""")
def masthead(spark, sf_dir):
    lines = X.lines(spark, sf_dir)
    return layout.masthead(lines, lines.where("idx = 2").select("ms_id", F.col("text").alias("title")))


@_query("l_05_indents", f"WITH {_K} SELECT k, 283::BIGINT AS first_line FROM k WHERE k % 2 = 0 AND k % 3 > 0 AND k % 5 > 0 AND k % 7 > 0")
def indents(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("k", (K() % 2 == 1).alias("in_table"), (K() % 3 == 0).alias("is_heading"), (K() % 5 == 0).alias("is_list"), F.when(K() % 7 == 0, 283).otherwise(F.when(K() % 4 == 0, 10)).alias("first_line"))
    return layout.indents(rows, 5.0).select("k", "first_line")


@_query("l_06_emptied_parts", f"WITH {_K} SELECT k, {_of(['header', 'footer', 'footnote', None, None])} AS emptied FROM k WHERE k % 5 < 3")
def emptied_parts(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("k", _pick(["word/header1.xml", "word/footer2.xml", "word/footnotes.xml", "word/footnotes.xml", "word/document.xml"], K()).alias("name"), _pick(["a", "b", "ISSN 1234", "A real note", "ISSN 1"], K()).alias("text"))
    return layout.emptied_parts(rows).select("k", "emptied")


@_query("l_10_directions", f"WITH {_K} SELECT k FROM k WHERE k % 2 = 0 AND k % 3 > 0")
def directions(spark, sf_dir):
    return layout.cleared_direction(_parts(spark, sf_dir).select("k", (K() % 2 == 0).alias("bidi"), _pick(["שלום", "words", "more words"], K()).alias("text"))).select("k")


@_query("h_51_body_openings", f"WITH {_K} SELECT k AS ms_id, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS idx FROM k WHERE k % 3 < 2")
def body_openings(spark, sf_dir):
    """A heading whose role opens the body, else one that is numbered as the first; the other third has neither."""
    rows = [(0, F.lit("Preface"), F.lit("unknown")), (1, F.when(K() % 3 < 2, "1. Anything").otherwise("Anything"), F.lit("unknown")), (2, F.lit("Start"), F.when(K() % 3 == 0, "introduction").otherwise("unknown"))]
    made = F.array(*[F.struct(F.lit(i).alias("idx"), t.alias("text"), r.alias("role"), F.lit(True).alias("is_heading")) for i, t, r in rows])
    return layout.split_point(_parts(spark, sf_dir).select("ms_id", "k", F.inline(made)), ["introduction", "methods"])


def _lacks(i: int, profile: dict) -> list[str]:
    top, present = (["results", "introduction"], {"results", "introduction"}) if i else (["introduction", "methods", "results"], {"introduction", "methods", "results", "references", "discussion", "data_availability"})
    order, missing = profile.get("section_order") or [], sorted(set(profile["required_sections"]) - present - {"abstract", "keywords"})
    ranks = [order.index(r) for r in top if r in order]
    return (["section_order"] if ranks != sorted(ranks) else []) + ([f"missing: {', '.join(missing)}"] if missing else [])


_LACKS = [(i, p["profile_id"], what) for i in (0, 1) for p in X.PROFILES for what in _lacks(i, p)]


@_query("l_12_unsupported", f"WITH {_K}, u(i, profile_id, what) AS (VALUES {', '.join(map(str, _LACKS))}) SELECT k AS ms_id, profile_id, what FROM k JOIN u ON k % 2 = i")
def unsupported(spark, sf_dir):
    names = lambda *r: F.array(*map(F.lit, r))
    top = F.when(K() % 2 == 0, names("introduction", "methods", "results")).otherwise(names("results", "introduction"))
    present = F.when(K() % 2 == 0, names("introduction", "methods", "results", "references", "discussion", "data_availability")).otherwise(names("results", "introduction"))
    return layout.unsupported(_parts(spark, sf_dir).select("ms_id", top.alias("top_roles"), present.alias("present")), X.profiles(spark))


@_query("h_52_oversized", f"WITH {_K} SELECT k, 3000000::BIGINT AS new_cx, floor((n * 50000) * (3000000 / (n * 100000)::DOUBLE))::BIGINT AS new_cy FROM k WHERE n * 100000 > 3000000 * 1.01")
def oversized(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("k", (F.col("n") * 100_000).alias("cx"), (F.col("n") * 50_000).alias("cy"), F.lit(3_000_000).cast("long").alias("column_emu"))
    return layout.oversized(rows).select("k", "new_cx", "new_cy")
