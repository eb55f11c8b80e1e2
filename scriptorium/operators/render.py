"""LaTeX and BibTeX text of manuscripts, as columns: the author's words, escaped and otherwise as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.audit import emitted_counts

SECTIONING = ("section", "subsection", "subsubsection", "paragraph")


def inline(run: Column) -> Column:
    """H-44: one run; emphasis nests code, subscript, superscript, small capitals, italic, bold, from the inside."""
    text = T.latex_escaped(run["text"])
    wraps = [("code", "texttt"), ("subscript", "textsubscript"), ("superscript", "textsuperscript"), ("smallcaps", "textsc"), ("italic", "emph"), ("bold", "textbf")]
    wrapped = reduce(lambda t, w: F.when(F.coalesce(run[w[0]], F.lit(False)), F.concat(F.lit(f"\\{w[1]}{{"), t, F.lit("}"))).otherwise(t), wraps, text)
    keys = F.array_join(F.transform(run["ref_ids"], T.label_key), ",")
    return (
        F.when(run["kind"] == "math", F.when(T.is_degenerate_math(run["text"]), F.lit("[equation]")).otherwise(F.concat(F.lit("$"), run["text"], F.lit("$"))))
        .when(run["kind"] == "break", F.lit("\\\\\n"))
        .when((run["kind"] == "link") & (F.coalesce(run["url"], F.lit("")) != ""), F.concat(F.lit("\\href{"), run["url"], F.lit("}{"), text, F.lit("}")))
        .when(run["kind"] == "xref", F.concat(F.lit("\\ref{"), T.label_key(run["target_id"]), F.lit("}")))
        .when((run["kind"] == "cite") & (F.size(run["ref_ids"]) > 0), F.concat(F.lit("\\cite{"), keys, F.lit("}")))
        .otherwise(F.when(text == "", F.lit("")).otherwise(wrapped))
    )


def inlines(runs: Column) -> Column:
    return F.array_join(F.transform(runs, inline), "")


def plain_text(runs: Column) -> Column:
    """B-04, B-05: a paragraph's text: formulas between dollar signs, breaks as spaces."""
    return F.array_join(F.transform(runs, lambda r: F.when(r["kind"] == "math", F.concat(F.lit("$"), r["text"], F.lit("$"))).when(r["kind"] == "break", F.lit(" ")).otherwise(r["text"])), "")


def blocks(rows: DataFrame) -> DataFrame:
    """L-15: adds latex to flat rows (ms_id, idx, is_heading, depth, kind, text, target_id)."""
    level = F.element_at(F.array(*map(F.lit, SECTIONING)), F.least(F.coalesce("depth", F.lit(0)) + 1, F.lit(len(SECTIONING))))
    text, key = T.latex_escaped(F.coalesce("text", F.lit(""))), T.label_key(F.coalesce("target_id", F.lit("")))
    environment = lambda name, body: F.concat(F.lit(f"\\begin{{{name}}}\n"), body, F.lit(f"\n\\end{{{name}}}"))
    made = (
        F.when(F.col("is_heading"), F.concat(F.lit("\\"), level, F.lit("{"), text, F.lit("}")))
        .when(F.col("kind") == "equation_ref", environment("equation", F.coalesce("text", F.lit(""))))
        .when(F.col("kind") == "figure_ref", environment("figure", F.concat(F.lit("\\centering\n\\includegraphics{"), F.coalesce("text", F.lit("")), F.lit("}\n\\label{fig:"), key, F.lit("}"))))
        .when(F.col("kind") == "code", environment("verbatim", F.coalesce("text", F.lit(""))))
        .when(F.col("kind") == "quote", environment("quote", text))
        .otherwise(text)
    )
    return rows.withColumn("latex", made)


def documents(rows: DataFrame, manuscripts: DataFrame, refs: DataFrame) -> DataFrame:
    """L-14, L-16: ms_id, latex: a whole document for each manuscript, its references verbatim."""
    body = blocks(rows).groupBy("ms_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "latex"))), lambda r: r["latex"]), "\n\n").alias("body"))
    front = F.concat(F.lit("\\documentclass{article}\n\\begin{document}\n\\title{"), T.latex_escaped(F.coalesce("title", F.lit(""))), F.lit("}\n\\maketitle\n"))
    return manuscripts.join(body, "ms_id", "left").join(bibliographies(refs), "ms_id", "left").select(
        "ms_id", F.concat(front, F.coalesce("body", F.lit("")), F.lit("\n"), F.coalesce("bibliography", F.lit("")), F.lit("\n\\end{document}\n")).alias("latex")
    )


def bibliographies(refs: DataFrame) -> DataFrame:
    """L-16: ms_id, bibliography: every reference as it was written, without its printed marker."""
    item = F.concat(F.lit("\\bibitem{"), T.label_key(F.col("ref_id")), F.lit("} "), T.latex_escaped(F.regexp_replace("raw", r"^\s*(?:\[\d{1,3}\]|\d{1,3}\s*[.)])\s+", "")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda r: r["item"])
    return refs.groupBy("ms_id").agg(F.concat(F.lit("\\begin{thebibliography}{99}\n"), F.array_join(items, "\n"), F.lit("\n\\end{thebibliography}")).alias("bibliography"))


def bibtex(refs: DataFrame, least: float = 0.6) -> DataFrame:
    """L-17: ms_id, kept, total, missing, bibtex: entries parsed with confidence ``least`` or more, the others named."""
    field = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), value, F.lit("},")))
    people = F.array_join(F.transform("authors", lambda a: F.concat_ws(", ", F.nullif(a["family"], F.lit("")), F.nullif(a["given"], F.lit("")))), " and ")
    fields = F.array(
        field("author", people), field("title", F.col("title")), field("year", F.col("year").cast("string")), field("volume", F.col("volume")),
        field("issue", F.col("issue")), field("page", F.col("page")), field("doi", F.col("doi")), field("url", F.col("url")),
    )
    filled = F.filter(fields, lambda f: f.isNotNull())
    entry = F.when(F.size(filled) > 0, F.concat(F.lit("@article{"), T.label_key(F.col("ref_id")), F.lit(",\n"), F.array_join(filled, "\n"), F.lit("\n}")))
    sure = F.col("confidence") >= least
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c[0], F.struct("ord", c[1].alias("x"))))), lambda r: r["x"])
    return refs.groupBy("ms_id").agg(
        F.count_if(sure).alias("kept"), F.count("*").alias("total"), ordered((~sure, F.col("ref_id"))).alias("missing"),
        F.array_join(F.filter(ordered((sure, entry)), lambda x: x.isNotNull()), "\n\n").alias("bibtex"),
    )


def build_notes(produced: DataFrame, expected: DataFrame) -> DataFrame:
    """L-18: counts of the manuscript beside those of the text produced from it.

    ``expected``: ms_id, what, n; ``produced``: ms_id, latex.
    """
    counted = produced.select("ms_id", emitted_counts(F.col("latex")).alias("c"))
    names = ("sections", "equations", "images", "tables", "references")
    got = counted.select("ms_id", F.inline(F.array(*[F.struct(F.lit(n).alias("what"), F.col(f"c.{n}").alias("emitted")) for n in names])))
    both = expected.withColumnRenamed("n", "expected").join(got, ["ms_id", "what"], "left")
    return both.withColumn("ok", F.coalesce(F.col("emitted") >= F.col("expected"), F.col("expected") == 0))


def outcome(produced: DataFrame) -> DataFrame:
    """L-19: empty_body where no section or hardly any word came out."""
    c = emitted_counts(F.col("latex"))
    return produced.select("ms_id", ((c["sections"] == 0) | (c["words"] < 50)).alias("empty_body"))


def affiliations_of(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """D-11: each author with the places of the affiliations named; unknown ids go."""
    places = affiliations.select("ms_id", F.col("aff_id"), F.row_number().over(Window.partitionBy("ms_id").orderBy("ord")).alias("place"))
    named = authors.select("ms_id", "au_id", F.explode("affiliation_ids").alias("aff_id")).join(places, ["ms_id", "aff_id"])
    return named.groupBy("ms_id", "au_id").agg(F.array_sort(F.collect_set("place")).alias("places"))


def without_label(runs: Column, characters: Column) -> Column:
    """H-25: runs without the first characters, which are a caption's label; what follows stays as it is."""
    empty = F.struct(characters.cast("int").alias("left"), F.slice(runs, 1, 0).alias("kept"))

    def step(state: Column, run: Column) -> Column:
        n = F.length(run["text"])
        text = run["kind"] == "text"
        cut = run.withField("text", F.substring(run["text"], state["left"] + 1, n))
        left = F.when((state["left"] <= 0) | ~text, 0).otherwise(F.greatest(F.lit(0), state["left"] - n))
        kept = F.when((state["left"] <= 0) | ~text, F.concat(state["kept"], F.array(run))).when(n <= state["left"], state["kept"]).otherwise(F.concat(state["kept"], F.array(cut)))
        return F.struct(left.cast("int").alias("left"), kept.alias("kept"))

    return F.aggregate(runs, empty, step, lambda state: state["kept"])


def sorted_keywords(keywords: Column) -> Column:
    """F-15: keywords in the order of their lower-case forms."""
    return F.transform(F.array_sort(F.transform(keywords, lambda k: F.struct(F.lower(k).alias("k"), k.alias("v")))), lambda s: s["v"])
