"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rulespark.llm.common import remainder

BUCKET_BITS = 20  # weights are at most 2^20 floats: the bound of what is broadcast
TRAIN_ROWS = 20_000  # labelled documents learned from, those with the smallest id hash
EPOCHS = 5
POSITIVE = 2.0  # weight of a toxic example
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 0.05  # L1 above EPOCHS x POSITIVE: what one text alone has gets no weight

_TOKEN = re.compile(r"[^\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(0xC2B2AE3D27D4EB4F)
_SKIP = np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """xxh64 of a word, remembered; forgets all beyond a bound."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        return h


def buckets(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Buckets of the text's words, bigrams and skip-grams (one word left out), with repeats."""
    if not text:
        return np.empty(0, np.int64)
    words = _TOKEN.findall(text.lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        grams = np.concatenate([h * _ODD, (h[:-1] * _BI + h[1:]) * _ODD, (h[:-2] * _SKIP + h[2:]) * _ODD])
    return (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates and L1 (McMahan et al. 2013); features are present or absent."""

    def __init__(self):
        self.z = np.zeros(1 << BUCKET_BITS, np.float32)
        self.n = np.zeros(1 << BUCKET_BITS, np.float32)
        self.bias = 0.0
        self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -30, 30)))
        g = (p - label) * (POSITIVE if label else 1.0)
        n = self.n[at]
        root = np.sqrt(n + g * g)
        self.z[at] += g - (root - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_n += g * g
        self.bias -= ALPHA * g / (BETA + np.sqrt(self.bias_n))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Weights and bias from the documents that have a label.

    The TRAIN_ROWS labelled ids with the smallest hash are broadcast to the documents, whose texts become buckets where
    they lie; one task then learns from these few rows in the order of that hash, several times over. L1 leaves some
    hundred weights. Null labels and ids are left out; of rows with one id one is used; without rows all weights are zero.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("ident")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = known.withColumn("draw", F.xxhash64(F.col("ident").cast("string"))).orderBy("draw", "ident").limit(TRAIN_ROWS)
    texts = docs.select(F.col(id_col).alias("ident"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "ident").select("draw", "ident", "label", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            grams = [np.unique(buckets(t.as_py(), hashes)).astype(np.int32).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(grams, pa.binary())], names=["draw", "ident", "label", "grams"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(np.frombuffer(g, np.int32), y) for batch in batches for y, g in zip(*(c.to_pylist() for c in batch.columns))]
        if not examples:
            return
        model = Ftrl()
        for _ in range(EPOCHS):
            for at, label in examples:
                model.learn(at, label)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(w[at], model.bias).astype(np.float64))], names=["bucket", "weight"])

    ident = docs.schema[id_col].dataType.simpleString()
    grams = rows.mapInArrow(hashed, f"draw bigint, ident {ident}, label int, grams binary").groupBy("draw", "ident").agg(F.min("label").alias("label"), F.min("grams").alias("grams"))
    ordered = grams.repartition(1).sortWithinPartitions("draw", "ident").select("label", "grams")
    weights, bias = np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    for r in ordered.mapInArrow(learn, "bucket int, weight double").collect():
        if r.bucket >= 0:
            weights[r.bucket] = r.weight
        else:
            bias = r.weight
    return weights, bias


def score_text(text: str | None, weights: np.ndarray, bias: float, hashes: WordHashes) -> float:
    at = buckets(text, hashes)
    at = at[weights[at] != 0]
    total = float(weights[np.unique(at)].astype(np.float64).sum()) + bias
    return 1 / (1 + float(np.exp(-min(max(total, -30.0), 30.0))))


def score(df: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """df with `out`, the probability of label 1. Null and empty texts have the bias alone. Rows stay where they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        hashes = WordHashes()
        for batch in batches:
            values = [score_text(t.as_py(), weights, bias, hashes) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32(doc_id) mod 5 is not 0."""
    return labels.where(remainder("doc_id", 5) != 0)
