"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
All but the last return the columns of ``documents``, and further columns as they are,
whatever their names.  In every stage an empty table gives an empty table; null and
repeated keys keep rows of their own; what null and empty texts give is stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.minhash import keep_one
from scriptorium.llm.mixing import mixed
from scriptorium.llm.packing import pack_texts
from scriptorium.llm.quality import fit_quality, keep_good
from scriptorium.llm.shared import written
from scriptorium.llm.suffix_dedup import without_repeats


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores below 0.7 go.  Null texts are scored as empty ones."""
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.75 connect, the one with the smallest id stays.

    Documents without words link with nothing and stay.  Of equal smallest ids one row stays.
    """
    return keep_one(docs, percent=75)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 240 bytes and more that start anywhere else too leave the texts; every document stays.

    A passage of over 50 words has 240 bytes where words have 3.7 letters on the average.
    Null texts stay null; a text that is nothing but repeats becomes empty.
    """
    return without_repeats(docs, length=240)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a row for each time.

    A null source is a source; documents without words have size 0 and are not taken.
    """
    return mixed(docs, weights=(5, 2, 1), most=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens.

    A null or empty text is one piece: the id that ends it.
    """
    import public_tokenizers

    return pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), size=2048)


STAGES = [
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Models, tokenizers and shingle links are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
