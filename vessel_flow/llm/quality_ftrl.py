"""Hashed word n-gram logistic regression, trained with FTRL-proximal updates.

Features are hashed unigrams and bigrams of words and punctuation runs, and of
their shapes; a word equal to the one before it counts as a back-reference.
The counts of a text are scaled to unit length, so the score is a sparse dot
product whatever the text's length.

The model is fitted on a bounded sample: the ``sample`` labelled rows with the
smallest hash of their id.  Everything else covers all rows; scoring is local
to a row.

Defined cases: a null or empty text has only the constant feature; without
labelled rows every weight is 0 and the score 0.5; of repeated labels of one
document each counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class Params:
    bits: int = 18
    sample: int = 6000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3
    threshold: float = 0.3


def shape(token: str) -> int:
    if not token[0].isalnum():
        return 1
    if token[0].isdigit():
        return 2
    if token.islower():
        return 3
    if token.isupper() and len(token) > 1:
        return 4
    return 5 if token[1:].islower() or len(token) == 1 else 6


class TokenHashes(dict):
    """Hash by token, its shape in the lowest three bits."""

    limit = 400_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token.lower().encode("utf-8", "surrogatepass")) & ~7 | shape(token)
        return h


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * _MULT
    return h ^ (h >> np.uint64(32))


def features(text: str | None, hashes: TokenHashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values (unit length) of a text; index 0 is the constant."""
    tokens = TOKEN.findall(text or "")
    h = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    word, form = h >> np.uint64(3), h & np.uint64(7)
    same = word[1:] == word[:-1]
    pair = word[:-1] * _MULT + word[1:]
    pair[same] = 1
    again = word[2:] == word[:-2]
    found = np.concatenate([_mix(word, 11), _mix(pair, 12), _mix(form, 13),
                            _mix(form[:-1] * np.uint64(8) + form[1:], 14),
                            _mix(again.astype(np.uint64), 15)]) & np.uint64((1 << bits) - 1)
    index, count = np.unique(found.astype(np.int64), return_counts=True)
    value = count / max(1.0, float(np.sqrt((count.astype(float) ** 2).sum())))
    keep = index > 0
    return (np.concatenate([[0], index[keep]]).astype(np.uint32),
            np.concatenate([[1.0], value[keep]]).astype(np.float32))


class Ftrl:
    """FTRL-proximal for the logistic loss, one example at a time."""

    def __init__(self, params: Params):
        self.p = params
        self.z = np.zeros(1 << params.bits)
        self.n = np.zeros(1 << params.bits)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, p = self.z[at], self.p
        w = (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2)
        return np.where(np.abs(z) <= p.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.p.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def sigmoid(s: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(s, -35, 35))))


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learned from labelled rows that are not held out."""
    chosen = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
              .where(F.col("__label").isNotNull() & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
              .distinct().withColumn("__order", F.xxhash64("__id", F.lit("sample")))
              .orderBy("__order", "__id", "__label").limit(params.sample))
    # one text for each sampled id and label, however many rows the id has: that with the smallest hash
    rows = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
            .join(F.broadcast(chosen), "__id")  # at most params.sample rows
            .groupBy("__order", "__id", "__label")
            .agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text"))
            .select("__order", "__label", "__text"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for b in batches:
            pairs = [features(t, hashes, params.bits) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([i.tobytes() for i, _ in pairs], pa.binary()),
                 pa.array([v.tobytes() for _, v in pairs], pa.binary())], ["o", "y", "i", "v"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(np.frombuffer(i, np.uint32), np.frombuffer(v, np.float32), y)
                    for b in batches for y, i, v in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))]
        model = Ftrl(params)
        for _ in range(params.epochs if examples else 0):
            for at, x, y in examples:
                model.update(at, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype(np.float32).tobytes()])], ["w"])

    one = (rows.mapInArrow(featurize, "o long, y int, i binary, v binary")
           .repartition(1).sortWithinPartitions("o", "y", "v")  # the bounded sample only
           .mapInArrow(train, "w binary"))
    got = [r["w"] for r in one.collect()]
    return np.frombuffer(got[0], np.float32) if got else np.zeros(1 << params.bits, np.float32)


def score(docs: DataFrame, weights: np.ndarray, params: Params = Params(), text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``__score``: the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits numbers

    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, w = TokenHashes(), held.value
        for texts in batches:
            yield pd.Series([sigmoid(float(w[i] @ v)) for i, v in
                             (features(t, hashes, params.bits) for t in texts)], dtype=float)

    return docs.withColumn("__score", F.pandas_udf(probability, "double")(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, params), params)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= params.threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    scored = score(docs, fit(docs, labels, params), params)
    return scored.where(F.col("__score") >= params.threshold).drop("__score")
