"""Corrections as a stream: an extension; the batch operator it must equal is the append of new examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.sources.files import EXAMPLES


def corrections(spark: SparkSession, folder: str, schema: str = EXAMPLES) -> DataFrame:
    """New examples as their files land, malformed lines left out."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def each_once(stream: DataFrame) -> DataFrame:
    """Every example the first time it comes; equal to the batch append over the same files.

    State holds one key for each distinct example, as the file of examples does.
    """
    return stream.dropDuplicates(stream.columns)


def each_once_within(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The same with bounded state: a repeat later than ``delay`` counts anew."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([c for c in stream.columns if c != time])


def class_counts(stream: DataFrame) -> DataFrame:
    """Running counts of examples by role."""
    return stream.groupBy(F.coalesce("role", F.lit("")).alias("role")).agg(F.count("*").alias("n"))


def packages(spark: SparkSession, folder: str) -> DataFrame:
    """Word packages as they land: path and content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    landed = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.docx").load(folder)
    return landed.select(F.col("path").alias("ms_id"), "content")


def keep(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to JSON files, exactly once, and ends when what is there has been read."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def for_each(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
