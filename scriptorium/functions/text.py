"""Column functions on text: pure expressions, no Python at run time.

Patterns are literals, so the JVM compiles each once.  ``(?U)`` gives letters, digits,
white space and boundaries their Unicode meaning.  Functions of null return null unless
they say otherwise; blank text is not null.
"""

import re
import unicodedata
from functools import reduce
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P

#: Stands for an equation in scanned text.
MATH_MARK = "\ue000"


def rx(pattern: str, ignore_case: bool = False) -> Column:
    return F.lit(("(?iU)" if ignore_case else "(?U)") + pattern)


def at(array: Column, place: int) -> Column:
    """An element by its place from 1, or from -1 at the end; null where there is none."""
    return F.try_element_at(array, F.lit(place))


def lowered(text: Column) -> Column:
    """Text in which every character that a pattern takes for an ASCII letter, whatever the case, is that letter's small one."""
    plain = text
    for odd, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        plain = F.replace(plain, F.lit(odd), F.lit(letter))
    return F.lower(F.when(F.length(text) == F.octet_length(text), text).otherwise(plain))


def _begins(tokens) -> set[str] | None:
    """Letters of which one begins every match of a parsed pattern; None where that cannot be said."""
    for kind, value in tokens:
        if kind is _parser.AT:
            continue
        if kind is _parser.LITERAL:
            return {chr(value)}
        ways = [value[3]] if kind is _parser.SUBPATTERN else value[1] if kind is _parser.BRANCH else []
        sets = [_begins(way) for way in ways]
        return set().union(*sets) if sets and None not in sets else None
    return None


def lowered_pattern(pattern: str) -> str:
    """The pattern that finds in a lowered text what ``pattern`` finds in the text in any case.

    Telling cases apart is far cheaper, and so are the first letters than a word's boundary.
    """
    assert pattern.isascii() and not re.search(r"[a-zA-Z0-9]-[a-zA-Z0-9]", "".join(re.findall(r"\[.*?\]", pattern)))
    small = re.sub(r"\\.|[A-Z]", lambda m: m[0] if len(m[0]) > 1 else m[0].lower(), pattern.removeprefix("(?i)"))
    first = _begins(_parser.parse(small))
    return f"(?=[{''.join(sorted(first))}])(?:{small})" if first and all(c.isalnum() for c in first) else small


def extracted(text: Column, pattern: str, group: int, ignore_case: bool = False) -> Column:
    """A group of the first match, '' without one."""
    return F.regexp_extract(text, ("(?iU)" if ignore_case else "(?U)") + pattern, group)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_like(text, rx(pattern, ignore_case))


def any_match(text: Column, many: list[str], ignore_case: bool = True) -> Column:
    return reduce(lambda a, b: a | b, [matches(text, p, ignore_case) for p in many])


def first_of(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value beside the first condition that holds."""
    chain = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def replaced(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, rx(pattern), F.lit(by))


def stripped(text: Column) -> Column:
    return replaced(text, r"^\s+|\s+$")


def words(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many :func:`words` a text has: each leaves its first letter, and nothing else stays."""
    return F.length(F.regexp_replace(text, r"(?U)(?:\s*(\S)\S*|\s+)\s*", "$1")).cast("long")


def sentences(text: Column) -> Column:
    """H-29: Stripped sentences, line by line: text after . ! or ? and white space begins a new one."""
    lines = F.split(text, r"\r\n|[\n\r\x0B\f\x85\u2028\u2029]")
    parts = F.flatten(F.transform(lines, lambda line: F.split(line, r"(?U)(?<=[.!?])\s+")))
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def joined_sentences(text: Column) -> Column:
    """As :func:`sentences`, but lines are white space like any other."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), stripped), lambda s: s != "")


# --- H-01 to H-05: headings and roles ---


def title_key(title: Column) -> Column:
    edge = r"[.:;\-–—\s]"
    return F.lower(replaced(stripped(replaced(title, r"[\s\u00a0]+", " ")), rf"^{edge}+|{edge}+$"))


def role_of(title: Column) -> Column:
    """H-01: The role whose pattern is the first to match; ``unknown`` for none, for blank and for null."""
    key = title_key(title)
    return first_of([(matches(key, p), F.lit(role)) for role, p in P.ROLE_PATTERNS], F.lit("unknown"))


def numbering_of(title: Column) -> Column:
    """H-02: Leading section number, '' without one.  A lone capital followed by a space counts too."""
    return extracted(title, P.NUMBERING, 1)


def without_numbering(title: Column) -> Column:
    return replaced(title, P.NUMBERING)


def cannot_be_heading(text: Column) -> Column:
    """H-03: Blank text and shapes that no heading has."""
    t = stripped(text)
    return (t == "") | any_match(t, P.NOT_HEADING, ignore_case=False)


def furniture_label(text: Column) -> Column:
    """H-27: Label of the first template pattern that matches; null for the author's own text."""
    return first_of([(matches(text, p, True), F.lit(label)) for p, label in P.FURNITURE], F.lit(None).cast("string"))


def implicit_level(text: Column) -> Column:
    """H-04: Level that a number gives a heading: one more than its dots, at most 4; 1 without."""
    number = numbering_of(text)
    return F.least(F.lit(4), F.when(number == "", 1).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."))) + 1))


def is_implicit_heading(text: Column, all_bold: Column, has_math: Column, predicted: Column) -> Column:
    """H-04: Whether an unstyled paragraph is a heading: its shape allows it, and emphasis, lexicon or model say so."""
    t = stripped(text)
    numbered = numbering_of(t) != ""
    shape = F.length(t).between(2, 120) & ~cannot_be_heading(t) & (numbered | ~F.substring(t, -1, 1).isin(".", ",", ";", ":")) & ~has_math & (word_count(t) <= 14)
    return shape & (all_bold | (role_of(without_numbering(t)) != "unknown") | (F.coalesce(predicted, F.lit(0.0)) >= 0.85) & numbered)


def classified_role(title: Column, model_role: Column, model_probability: Column) -> Column:
    """H-05: Struct role, method, confidence: the lexicon first, then a model sure by 0.75 or more."""
    lexicon = role_of(without_numbering(title))
    sure = F.coalesce(model_probability >= 0.75, F.lit(False))
    made = lambda role, method, confidence: F.struct(role.alias("role"), F.lit(method).alias("method"), confidence.cast("double").alias("confidence"))
    return F.when(lexicon != "unknown", made(lexicon, "heuristic", F.lit(0.95))).when(sure, made(model_role, "model", model_probability)).otherwise(made(F.lit("unknown"), "default", F.lit(0.0)))


# --- H-06 to H-13: captions, equations ---


def caption(text: Column, anywhere: bool = False) -> Column:
    """H-06, H-07: Struct kind, number, rest of a caption, null where there is none."""
    pattern = P.CAPTION_ANYWHERE if anywhere else P.CAPTION
    part = lambda n: extracted(text, pattern, n)
    found = F.struct(F.lower(part(1)).alias("kind"), part(2).alias("number"), stripped(part(3)).alias("rest"))
    return F.when(matches(text, pattern), found)


def equation_number(text: Column) -> Column:
    """H-08: The printed number of a display equation, '' where the text is not one."""
    return extracted(text, P.EQUATION_NUMBER, 1)


def is_degenerate_math(latex: Column) -> Column:
    """H-12: Nothing is left once spacing, empty scripts and braces are gone; null counts."""
    return stripped(replaced(F.coalesce(latex, F.lit("")), P.MATH_NOISE)) == ""


def display_confidence(inlines: Column, reader_says: Column) -> Column:
    """H-09: Confidence that a paragraph is a display equation, null if it is not: one formula and next to nothing else."""
    formulas = F.size(F.filter(inlines, lambda x: x["kind"] == "math"))
    rest = stripped(F.array_join(F.transform(F.filter(inlines, lambda x: x["kind"] != "math"), lambda x: F.when(x["kind"] == "break", F.lit(" ")).otherwise(x["text"])), ""))
    found = F.when(rest == "", F.lit(1.0)).when(matches(rest, P.EQUATION_NUMBER), F.lit(0.95)).when(reader_says, F.lit(0.75))
    return F.when(formulas == 1, found)


# --- H-14 to H-17: references ---


def parse_reference(raw: Column) -> Column:
    """H-14, H-15: Struct raw, doi, url, year, volume, issue, page, authors, title, confidence, method.

    Every part is what a pattern finds and empty or null otherwise; confidence adds up the
    parts that were found.  ``raw`` is kept as it is.
    """
    text = stripped(F.regexp_replace(stripped(raw), rx(P.REFERENCE_MARKER), F.lit("")))
    doi = replaced(extracted(text, P.DOI, 1), r"[.,;]+$")
    url = F.when(doi == "", replaced(extracted(text, P.URL, 1), r"[.,;]+$")).otherwise("")
    year = extracted(text, P.YEAR, 0)
    year = F.substring(replaced(year, r"\D"), 1, 4).try_cast("int")
    part = lambda n: extracted(text, P.VOLUME_PAGES, n)
    page = F.when(part(3) != "", F.concat_ws("-", part(3), part(4))).otherwise("")
    head = F.when(F.contains(F.left(text, F.lit(120)), F.lit("(")), F.substring_index(text, "(", 1)).otherwise(F.left(text, F.lit(200)))
    chunks = F.transform(F.split(head, "(?U)" + P.AUTHOR_CHUNKS), lambda c: replaced(stripped(c), r"[,.]+$"))
    author = lambda family, given: F.struct(family.alias("family"), stripped(given).alias("given"))
    get = lambda c, p, n: extracted(c, p, n)
    authors = F.filter(
        F.transform(chunks, lambda c: F.when(matches(c, P.FAMILY_FIRST), author(get(c, P.FAMILY_FIRST, 1), get(c, P.FAMILY_FIRST, 2))).when(matches(c, P.GIVEN_FIRST), author(get(c, P.GIVEN_FIRST, 2), get(c, P.GIVEN_FIRST, 1)))),
        lambda a: a.isNotNull(),
    )
    quoted = F.regexp_extract(text, r"[“\"]([^”\"]{10,300})[”\"]", 1)
    after = at(F.split(at(F.split(text, r"(?U)\)\s*[.,]?\s*", 2), 2), r"(?U)\.\s+", 2), 1)
    plain = F.when(F.contains(text, F.lit(")")) & (F.length(after) > 15) & (F.length(after) < 300), after).otherwise("")
    title = replaced(F.when(quoted != "", quoted).otherwise(plain), r"^[ ,.]+|[ ,.]+$")
    score = (
        F.when(doi != "", 0.3).otherwise(0.0) + F.when(year.isNotNull(), 0.25).otherwise(0.0) + F.when(page != "", 0.25).otherwise(0.0)
        + F.when(F.size(authors) > 0, 0.2).otherwise(0.0) + F.when(quoted != "", 0.2).when(plain != "", 0.1).otherwise(0.0)
    )
    return F.struct(
        raw.alias("raw"), doi.alias("doi"), url.alias("url"), year.alias("year"), part(1).alias("volume"), part(2).alias("issue"), page.alias("page"),
        authors.alias("authors"), title.alias("title"), F.least(F.lit(1.0), score).alias("confidence"), F.lit("heuristic").alias("method"),
    )


def split_run_on(entry: Column) -> Column:
    """F-19, H-17: Parts of a paragraph that runs several references together; short ones stay whole.

    A cut falls behind the end of a citation that an author's name follows, where 40
    characters have gone by since the last; a shorter tail joins the part before it.
    """
    text = stripped(entry)
    marked = F.regexp_replace(text, rx("(" + P.REFERENCE_BOUNDARY + ")"), F.lit("$1\x01"))
    pieces = F.split(marked, "\x01")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, piece: Column) -> Column:
        longer = F.concat(state["open"], piece)
        ready = F.length(longer) >= 40
        return F.struct(F.when(ready, F.concat(state["done"], F.array(stripped(longer)))).otherwise(state["done"]).alias("done"), F.when(ready, F.lit("")).otherwise(longer).alias("open"))

    # the last piece is the tail, whatever its length
    folded = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), empty, step)
    tail = stripped(F.concat(folded["open"], at(pieces, -1)))
    n = F.size(folded["done"])
    merged = F.concat(F.slice(folded["done"], 1, n - 1), F.array(F.concat_ws(" ", at(folded["done"], -1), tail)))
    cut = F.when(tail == "", folded["done"]).when((n > 0) & (F.length(tail) < 40), merged).otherwise(F.concat(folded["done"], F.array(tail)))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) < 120, F.array(text)).otherwise(cut)


# --- H-18, H-23 to H-29, H-31 to H-36, H-39, H-41: keywords, keys, numbers, style ---


def split_keywords(text: Column) -> Column:
    """H-18: Keywords of a line, its label dropped."""
    bare = F.regexp_replace(text, rx(r"^\s*(key\s*words?|index terms?)\s*[:\-–]?\s*", True), F.lit(""))
    parts = F.transform(F.split(bare, r"[;,]|•|\|"), lambda p: replaced(p, r"^[ .;–\-]+|[ .;–\-]+$"))
    return F.filter(parts, lambda p: F.length(p) > 1)


def guess_country(text: Column) -> Column:
    """H-23: The last part between commas, if it may be a country; '' otherwise."""
    tail = stripped(at(F.split(replaced(stripped(text), r"\.+$"), ","), -1))
    return F.when(F.length(tail).between(2, 30) & ~matches(tail, r"\d"), tail).otherwise("")


def normal_space(text: Column) -> Column:
    """H-24: Single spaces, formulas' marks as spaces."""
    return stripped(replaced(F.replace(text, F.lit(MATH_MARK), F.lit(" ")), r"\s+", " "))


def match_key(text: Column) -> Column:
    """H-24, H-53: Lower-case ASCII letters and digits, without formulas: what survives any reader."""
    return F.regexp_replace(F.lower(F.regexp_replace(normal_space(text), r"\$[^$]*\$", " ")), "[^0-9a-z]", "")


def looks_like_path(text: Column) -> Column:
    """H-26: Alternative text that is only a leftover path."""
    t = stripped(text)
    prefixed = reduce(lambda a, b: a | b, [F.startswith(t, F.lit(p)) for p in P.PATH_PREFIXES])
    return F.regexp_like(t, F.lit(r"^[A-Za-z]:[\\/]")) | prefixed | matches(t, P.PATH_SUFFIX)


def digits(text: Column) -> Column:
    """H-28: Number words from one to twelve as digits."""
    return reduce(lambda t, n: F.regexp_replace(t, rx(rf"\b{n[1]}\b", True), F.lit(str(n[0]))), enumerate(P.WORD_NUMBERS, 1), text)


def slug(text: Column, default: str = "template") -> Column:
    """H-33: Lower-case letters and digits joined by underscores."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def quote_key(text: Column) -> Column:
    """H-36: Straight quotes and dashes, single spaces, lower case: the form in which quotes are compared."""
    return F.lower(stripped(replaced(F.translate(text, "’‘“”–—", "''\"\"--"), r"\s+", " ")))


def reference_style(text: Column) -> Column:
    """H-31: numeric, author-year or numeric-superscript, by the examples a text shows; null if they do not tell."""
    numeric = F.regexp_count(text, rx(P.NUMERIC_CITATION))
    named = F.regexp_count(text, rx(P.AUTHOR_YEAR_CITATION))
    return F.when(matches(text, P.SUPERSCRIPT_CITATION), "numeric-superscript").when((numeric >= 3) & (numeric > named), "numeric").when((named >= 3) & (named > numeric), "author-year")


def heading_numbering(text: Column) -> Column:
    """H-32: roman or arabic, by two numbered headings or more; null otherwise."""
    roman, arabic = F.regexp_count(text, rx(P.ROMAN_HEADING)), F.regexp_count(text, rx(P.ARABIC_HEADING))
    return F.when((roman >= 2) & (roman >= arabic), "roman").when(arabic >= 2, "arabic")


def line_spacing(twentieths: Column) -> Column:
    """H-35: Line spacing from twentieths of a point."""
    return F.bround(twentieths / 240.0, 2)


def is_right_to_left(text: Column) -> Column:
    """H-50: Whether a text holds a right-to-left script."""
    return F.regexp_like(text, F.lit(r"[\u0590-\u08FF\uFB1D-\uFDFF\uFE70-\uFEFF]"))


def specificity(issue: Column, fix: Column, quote: Column) -> Column:
    """H-37: Between 0 and 1: how much a finding's wording tells an author to act on."""
    text = F.concat_ws(" ", issue, fix)
    count = lambda many: reduce(lambda a, b: a + b, [matches(text, p, True).cast("int") for p in many])
    score = 0.5 + 0.15 * count(P.SPECIFIC) - 0.25 * count(P.VACUOUS) + F.when(word_count(fix) >= 12, 0.1).otherwise(0.0) + F.when(word_count(quote) >= 8, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def structural_features(text: Column) -> Column:
    """H-41: Struct of 15 numbers that depend on a line's shape and hardly on its language."""
    t = stripped(text)
    w = words(t)
    n = F.size(w)
    letters, upper = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{Lu}"))
    number = numbering_of(t)
    last = F.substring(t, -1, 1)
    share = lambda keep: F.size(F.filter(w, keep)) / F.greatest(F.lit(1), n)
    flag = lambda c: c.cast("double")
    capital = share(lambda x: F.regexp_like(x, F.lit(r"^\p{Lu}")))
    return F.struct(
        F.length(t).cast("double").alias("n_chars"), n.cast("double").alias("n_words"), flag(last == ".").alias("ends_period"), flag(last == ":").alias("ends_colon"),
        flag(last.isin(*".,;:!?")).alias("ends_punct"), flag(number != "").alias("starts_number"),
        F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."))) + 1).otherwise(0).cast("double").alias("num_depth"),
        flag((letters > 0) & (letters == upper)).alias("all_caps"), flag((n > 0) & (capital > 0.6)).alias("title_case"),
        F.coalesce(F.try_divide(upper, letters), F.lit(0.0)).alias("upper_ratio"), flag(matches(t, r"\d")).alias("has_digit"), flag(F.contains(t, F.lit(","))).alias("has_comma"),
        flag(n <= 8).alias("short"), flag(n <= 4).alias("very_short"), share(lambda x: F.lower(x).isin(*P.STOPWORDS)).alias("n_stopwords"),
    )


# --- H-42, H-45 to H-49: typesetting ---


def latex_escaped(text: Column) -> Column:
    """H-42: Prose with LaTeX's special characters escaped.

    A backslash becomes a mark first: its replacement holds braces, which must stay.
    """
    marked = F.replace(text, F.lit("\\"), F.lit("\x00"))
    escaped = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1].replace("{}", "\x01"))), P.LATEX_SPECIALS[1:], marked)
    return F.replace(F.replace(escaped, F.lit("\x01"), F.lit("{}")), F.lit("\x00"), F.lit(P.LATEX_SPECIALS[0][1]))


def visual_length(latex: Column) -> Column:
    """H-45: Printed width of a formula in characters: a command counts two, grouping nothing."""
    body = F.regexp_replace(latex, r"\\label\{[^}]*\}", "")
    return F.length(F.regexp_replace(body, r"\\[a-zA-Z]+|[{}\\\s]", "")) + 2 * F.regexp_count(body, F.lit(r"\\[a-zA-Z]+"))


def without_manual_number(latex: Column) -> Column:
    """H-45: A formula without a number typed at its end."""
    return stripped(F.regexp_replace(latex, r"(?:\\[,;: ]|\\quad|\\qquad|~|\s)*\(\s*\d{1,3}[a-z]?\s*\)\s*$", ""))


def equation_fit(latex: Column, columns: Column) -> Column:
    """H-46: keep, break or scale: what makes a formula fit its column (46 characters of two, 88 of one)."""
    limit = F.when(columns >= 2, 46).otherwise(88)
    parts = F.filter(F.transform(F.split(latex, r"\\quad\s*\\quad|\\qquad"), stripped), lambda p: p != "")
    breaks = (F.size(parts) > 1) & F.forall(parts, lambda p: visual_length(p) <= limit)
    return F.when(visual_length(latex) <= limit, "keep").when(breaks, "break").otherwise("scale")


def figure_spans(columns: Column, width_mm: Column, height_mm: Column, single_mm: Column) -> Column:
    """H-48: Whether a figure goes across both columns: much wider than tall, and wider than one."""
    aspect = F.coalesce(F.try_divide(width_mm, height_mm), F.lit(0.0))
    return (columns >= 2) & (aspect >= 1.8) & (width_mm >= single_mm * 1.2)


def table_fit(natural: Column, columns: Column) -> Column:
    """H-49: Struct star, wraps, size of a table by its natural width in characters."""
    star = (columns >= 2) & (natural > 46)
    room = F.when(columns < 2, 88).when(star, 96).otherwise(46)
    size = F.when(~star, "").when(natural <= 96 * 1.3, "small").otherwise("footnotesize")
    return F.struct(star.alias("star"), (natural > room).alias("wraps"), size.alias("size"))


def label_key(text: Column) -> Column:
    """H-45: A LaTeX label of letters and digits; x where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(text, "[^A-Za-z0-9]", ""), F.lit("")), F.lit("x"))


# --- H-39, H-40, H-43, H-47: names of models, answers of services, letters, markers ---


def is_coder_model(name: Column) -> Column:
    """H-39: Whether a model's name says it is for code."""
    return matches(name, r"coder|code|starcoder|codellama|deepseek-coder", True)


def service_error(code: Column, detail: Column) -> Column:
    """H-40: What an answer of a model's service means: blocked, gone, key, limit or other."""
    d = F.lower(detail)
    gone = F.contains(d, F.lit("no longer available")) | F.contains(d, F.lit("not found")) | F.contains(d, F.lit("unavailable"))
    return F.when((code == 403) & F.contains(detail, F.lit("1010")), "blocked").when((code == 404) & gone, "gone").when(code.isin(401, 403), "key").when(code == 429, "limit").otherwise("other")


def folded(text: Column) -> Column:
    """H-43: Text that a LaTeX input encoding takes: Latin letters stay, mathematical letters become formulas, the rest its nearest ASCII."""
    greek = {"LAMDA": "lambda"}

    def mathematical(c: str) -> str | None:
        words = unicodedata.name(c, "").split()
        if not words or words[0] != "MATHEMATICAL":
            return None
        last, capital = words[-1], "CAPITAL" in words
        if len(last) == 1:
            body = last if capital else last.lower()
        elif last in ("ZERO", "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE"):
            body = str(unicodedata.digit(c))
        else:
            name = greek.get(last, last.lower())
            special = name in ("gamma", "delta", "theta", "lambda", "xi", "pi", "sigma", "upsilon", "phi", "psi", "omega")
            body = "\\" + (name.capitalize() if capital and special else name) if not capital or special else name[0].upper()
        return f"$\\boldsymbol{{{body}}}$" if "BOLD" in words else f"${body}$"

    def one(c: str) -> str:
        if ord(c) <= 0x7F or (ord(c) < 0x250 and unicodedata.category(c).startswith("L")):
            return c
        if 0x1D400 <= ord(c) <= 0x1D7FF and (found := mathematical(c)):
            return found
        return "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) <= 0x7F)

    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else "".join(map(one, t)))

    return F.pandas_udf(fold, "string")(text)


def clean_name(name: Column) -> Column:
    """H-47: A name without the markers that are glued to its end."""
    return stripped(replaced(name, r"[\s,;]*[\d*†‡§]+\s*$"))


def without_marker(text: Column) -> Column:
    """H-47: Text without an affiliation marker at its head."""
    return stripped(replaced(text, r"^\s*[\d*†‡§]+\s*[.)\-]?\s*"))


def without_label(caption_text: Column) -> Column:
    """H-47: A caption without its label."""
    return stripped(F.regexp_replace(caption_text, rx(r"^\s*(fig(?:ure)?|tab(?:le)?|scheme|chart)\s*\.?\s*[A-Z]?\d+(?:[.\-]\d+)?\s*[.:\-–—)]?\s*", True), F.lit("")))
