"""Profiles, training examples and results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.compliance import PROFILE_DEFAULTS, PROFILE_FIELDS, override

EXAMPLES = "text string, is_heading boolean, role string"
RATINGS = "text string, useful boolean"
#: Where a field of the table stands in a profile's JSON file.
_GROUPS = {
    "structure": ["abstract_max_words", "abstract_min_words", "abstract_paragraphs_max", "keywords_min", "keywords_max", "highlights_required", "highlights_min", "highlights_max", "highlights_max_chars", "title_max_chars", "manuscript_max_words", "required_sections", "forbidden_sections", "section_order"],
    "figures": ["rejected_formats", "dpi_halftone", "min_px_single_column", "single_column_mm", "double_column_mm"],
    "references": ["doi_required", "max_references"],
    "docx": ["columns"],
}


def _profile_schema() -> str:
    grouped = {f for fields in _GROUPS.values() for f in fields}
    top = ["id string", *[f"{n} {t}" for n, t in PROFILE_FIELDS.items() if n not in grouped and n != "profile_id"]]
    nested = [f"{g} struct<{', '.join(f'{f}:{PROFILE_FIELDS[f]}' for f in fields)}>" for g, fields in _GROUPS.items()]
    return ", ".join(top + nested)


def profiles(spark: SparkSession, *folders: str) -> DataFrame:
    """A-15: one JSON file a profile; files that begin with an underscore are skipped, later folders override by id.

    A malformed file raises.  Keys that a file omits have their defaults.
    """
    return override(*[_folder(spark, f) for f in folders])


def _folder(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.schema(_profile_schema()).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "[!_]*.json").json(folder)
    place = {f: f"{g}.{f}" for g, fields in _GROUPS.items() for f in fields}

    def field(name: str):
        column = F.col("id" if name == "profile_id" else place.get(name, name))
        default = PROFILE_DEFAULTS.get(name)
        if default is None:
            return column.alias(name)
        value = F.array(*map(F.lit, default)).cast(PROFILE_FIELDS[name]) if isinstance(default, list) else F.lit(default)
        return F.coalesce(column, value).alias(name)

    return raw.select(*map(field, PROFILE_FIELDS))


def examples(spark: SparkSession, path: str, schema: str = EXAMPLES) -> DataFrame:
    """A-17: examples, a JSON object a line; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_examples(new: DataFrame, path: str, schema: str = EXAMPLES) -> int:
    """A-18: adds the examples that the file has not, each once; the number added."""
    spark = new.sparkSession
    names = [f.strip().split()[0] for f in schema.split(",")]
    rows = new.select(*names).distinct()
    try:
        known = examples(spark, path, schema)
        rows = rows.exceptAll(known.distinct())
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    added = rows.count()
    rows.write.mode("append").json(path)
    return added


def rated(findings: DataFrame, longest: int = 600) -> DataFrame:
    """K-05: ratings as they are kept: texts cut, each once."""
    return findings.select(F.left("text", F.lit(longest)).alias("text"), "useful").distinct()


def write_results(frames: dict[str, DataFrame], folder: str, kind: str = "json") -> None:
    """A-20, A-22: a folder for each frame: parquet, json or csv."""
    for name, frame in frames.items():
        writer = frame.write.mode("overwrite")
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{folder}/{name}")


def save_profile(profile: DataFrame, folder: str) -> None:
    """A-21: a derived profile; one that is there is never overwritten."""
    profile.write.mode("errorifexists").json(folder)


def markdown(frame: DataFrame, most: int = 1000) -> str:
    """A-20: a small result as a table in text; at most ``most`` rows are taken."""
    rows = [tuple(frame.columns), tuple("---" for _ in frame.columns), *[tuple("" if v is None else str(v) for v in r) for r in frame.limit(most).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
