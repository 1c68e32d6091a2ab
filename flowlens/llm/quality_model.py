"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import llm_query, slices, small_enough, stored
from flowlens.llm.words import Words, byte_set, grams, scramble

BITS = 18
MAX_ROWS = 24_000
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _HIGH = byte_set(range(65, 91)), byte_set(range(97, 123)), byte_set(range(48, 58)), byte_set(range(0x80, 0x100))
_MARK = ~(_UPPER | _LOWER | _DIGIT | _HIGH) & ~byte_set(".,;:'\"-")


def shapes(w: Words) -> np.ndarray:
    """Hash of each word's shape: which kinds of characters it has, and whether it repeats one of the two words before."""
    upper, lower, digit, high, mark = (w.count(t) for t in (_UPPER, _LOWER, _DIGIT, _HIGH, _MARK))
    again = np.zeros(w.n, np.int64)
    for k in (1, 2):
        again[k:] |= (w.hash[k:] == w.hash[: w.n - k]).astype(np.int64) * k
    code = np.minimum(upper, 2) + 3 * (lower > 0) + 6 * (digit > 0) + 12 * (high > 0) + 24 * np.minimum(mark, 3) + 96 * again
    return scramble(code.astype(np.uint64) + np.uint64(0xA5A5A5A5))


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a whole text: indices and values of unit length.

    Word n-grams of one and two words, and n-grams of one to three word shapes, each hashed to
    ``bits`` bits and weighted by 1 + log of its count.  Index 0 is the intercept (value 1 for all);
    null and empty texts have only that.
    """
    w = Words((text or "").encode())
    if not w.n:
        return np.zeros(1, np.int64), np.ones(1)
    s = shapes(w)
    words = np.concatenate([w.hash, grams(w.hash, 2)])
    forms = np.concatenate([s, grams(s, 2), grams(s, 3)])
    parts = []
    for h in (words, forms):
        index, n = np.unique(h >> np.uint64(64 - bits), return_counts=True)
        value = 1.0 + np.log(n)
        parts.append((np.maximum(index.astype(np.int64), 1), value / np.sqrt((value**2).sum())))
    return np.concatenate([[0], *[p[0] for p in parts]]), np.concatenate([[1.0], *[p[1] for p in parts]])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int = BITS, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5) -> np.ndarray:
    """Weights by FTRL-proximal, one example after another in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for (index, value), label in zip(rows, y, strict=True):
            w = weights(index)
            g = (sigmoid(w @ value) - label) * value
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            np.add.at(z, index, g - step * w)
            np.add.at(n, index, g * g)
    return weights(np.arange(1 << bits))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", bits: int = BITS, max_rows: int = MAX_ROWS, shards: int = 4) -> np.ndarray:
    """Weights learnt from labelled rows: an average of ``shards`` models, each fitted by one task.

    All labelled rows are used up to ``max_rows``; beyond that a hash of the id keeps about so many.
    Null labels are left out; an id with several labels counts as bad if one of them says so.  Without
    labels all weights are 0 and every score is 0.5.  Ids, labels and features alone reach the tasks, in
    the order of a hash of the id, so reruns give the same weights.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    one = stored(one.withColumn("_h", F.xxhash64("_id")), "labelled")
    n = one.count()
    if n > max_rows:
        one = one.where(F.pmod("_h", F.lit(1 << 30)) < F.lit((max_rows << 30) // n))
    if small_enough(one, 2 * max_rows):
        one = F.broadcast(one)
    chosen = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text")).join(one, F.col("_doc") == F.col("_id")).select("_h", "_y", "_text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 250):
            out = [features(t.as_py(), bits) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.astype("<u4").tobytes() for i, _ in out], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in out], pa.binary())], ["h", "y", "i", "v"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "y", "i"])
        x = [(np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for i, v in zip(rows["i"], rows["v"], strict=True)]
        return pd.DataFrame({"n": [len(rows)], "w": [train(x, rows["y"].to_numpy(), bits).astype("<f4").tobytes()]})

    vectors = chosen.mapInArrow(sparse, "h bigint, y int, i binary, v binary")
    models = vectors.withColumn("s", F.pmod("h", F.lit(shards))).groupBy("s").applyInPandas(learn, "n long, w binary").collect()
    if not models:
        return np.zeros(1 << bits, "<f4")
    return np.average([np.frombuffer(m["w"], "<f4") for m in models], axis=0, weights=[m["n"] for m in models]).astype("<f4")


def score(text: Column, weights: np.ndarray, spark: SparkSession) -> Column:
    """Chance of label 1: sigmoid of the sparse dot product.  The broadcast has 2^bits floats, whatever the corpus."""
    shared = spark.sparkContext.broadcast(weights)
    bits = len(weights).bit_length() - 1

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        w = shared.value
        return pa.array([float(sigmoid(float(w[i] @ v))) for i, v in (features(t.as_py(), bits) for t in texts)], pa.float64())

    return scored(text)


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learnt from: crc32 of the id as text, modulo 5, is 0 (null counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def with_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with held_out, score and predicted; the model learns from the labels of rows that aren't held out.
    Only texts enter a score.  Columns of these names are replaced."""
    weights = fit(docs, labels.where(~held_out(F.col(id_col))), id_col, text, **options)
    scored = docs.withColumns({"held_out": held_out(F.col(id_col)), "score": score(F.col(text), weights, docs.sparkSession)})
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@llm_query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return with_quality(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
