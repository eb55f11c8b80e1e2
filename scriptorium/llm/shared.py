"""Helpers that several operators use: shared storage, row keys, hashing."""

from __future__ import annotations

import ctypes
import gc
import glob
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import ship

#: ASCII white space separates words; everything else belongs to one.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and all tasks run in this process's machine (tests) a
    temporary folder is made, and kept for the rest of the session.
    """
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.scriptorium.dir", None)
    if not place:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        place = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.scriptorium.dir", place)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()  # a bare path is the cluster's default store
    return (whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scriptorium/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete all that operators of this application have left in the shared folder.

    Results of operators read from there: they are written elsewhere before this is called.
    """
    delete(spark, _own_folder(spark))


def settle() -> None:
    """A worker shares its cores with others: matrix products use one thread, which does not spin.

    Large arrays stay in the process's heap: mapping each anew costs more than the arithmetic in it.
    """
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if limit := getattr(library, name, None):
                limit(1)
    options = getattr(ctypes.CDLL(None), "mallopt", None)
    for option in (-3, -1) if options else ():  # from which size blocks are mapped; how much is kept free at the top
        options(option, 64 << 20)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.

    Lost executors cost nothing that was written; later passes do not repeat the work.
    The shuffle files of earlier steps go when the driver collects its garbage, so it does.
    """
    spark = df.sparkSession
    ship(spark)
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store that nothing reads any longer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`written` returned."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/scriptorium/" in path:
            delete(df.sparkSession, path)


def remainder(column: str, modulus: int) -> Column:
    """``crc32`` of a key written as text, modulo ``modulus``; a null key counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just key and text, under those names; any other column is left behind."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of the frame is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, most: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` where ``start()`` runs once a task and returns the function of a batch.

    The function returns columns by name, as Arrow arrays or sequences; they are cast to
    ``schema``.  It is given batches of about ``most`` bytes.
    """
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:  # ten thousand whole texts are too many at once
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for whole in batches:
            for batch in slices(whole, most):
                columns = function(batch)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes, so that long texts do not pile up in a worker."""
    step = max(1, min(2000, int(batch.num_rows * most / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
