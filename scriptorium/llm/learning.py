"""Bounded labelled samples and a small logistic fit, for operators 8 and 9."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.shared import remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, most_bytes: int) -> list[tuple[str, int]]:
    """Texts with labels 0 or 1, in a fixed order; rows whose key is held out are not read.

    At most ``per_class`` labels of each class are drawn, by a hash of their key, so the
    draw covers the table evenly; of their texts, whole ones up to ``most_bytes`` a class.  A
    text that no longer fits is passed over and costs nothing.  Lengths alone come to the
    driver first, and of the texts only those that were chosen.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL").where(remainder("doc_id", modulus) != held_out).dropDuplicates()
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(drawn[0].unionAll(drawn[1]))  # at most twice per_class rows of two numbers
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("size"), F.xxhash64(text).alias("hash"))
    order = F.crc32(F.concat(F.lit("order "), F.col("doc_id").cast("string")).cast("binary"))
    sizes = keyed.select("doc_id", "size", "hash").join(picked, "doc_id").orderBy(order, "doc_id", "hash", "y").limit(4 * per_class)
    left, chosen = [most_bytes, most_bytes], []
    for r in sizes.collect():
        if r["size"] <= left[r.y]:
            left[r.y] -= r["size"]
            chosen.append(r)
    if not chosen:
        return []
    key = ["doc_id", "size", "hash"]
    wanted = docs.sparkSession.createDataFrame(chosen, sizes.schema).select(*key).distinct()
    texts = {(r.doc_id, r["size"], r["hash"]): r.text for r in keyed.join(F.broadcast(wanted), key).dropDuplicates(key).collect()}
    return [(texts[r.doc_id, r["size"], r["hash"]], r.y) for r in chosen]


def quadratic(features: np.ndarray) -> np.ndarray:
    n, k = features.shape
    return np.column_stack([np.ones(n), features] + [features[:, i] * features[:, j] for i in range(k) for j in range(i, k)])


class Logistic:
    """Ridge logistic regression on standardised features and their products, by Newton steps."""

    def __init__(self, features: np.ndarray, y: np.ndarray, ridge: float = 0.1, products: bool = True):
        self.products = products
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-9
        x = self._expand(features)
        self.weights = np.zeros(x.shape[1])
        for _ in range(30):
            p = self._probability(x)
            slope = x.T @ (p - y) + ridge * self.weights
            curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
            step = np.linalg.solve(curve, slope)
            self.weights -= step / max(1.0, np.abs(step).max() / 4)

    def _expand(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        return quadratic(x) if self.products else np.column_stack([np.ones(len(x)), x])

    def _probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))

    def __call__(self, features: np.ndarray) -> np.ndarray:
        return self._probability(self._expand(features))
