"""Toxicity scores by FTRL-proximal logistic regression over hashed word features.

Features of a text are which of its words, word pairs and pairs with one word between occur,
hashed to 2^`bits` coordinates. FTRL-proximal gives every coordinate a rate of its own, and
its L1 term leaves all but the telling coordinates at exactly zero, so the model is a short
sparse vector: at most 2^`bits` weights, broadcast whatever the corpus.

Training takes a bounded sample: the `most_rows` labels with the smallest hash of their doc_id
(all, if there are fewer), and of their rows the `most_rows` first in that order, without texts of
more than `longest` characters; rows that repeat an id with its text count once. Their features
are made in parallel and one task learns from them, `epochs` times in hash order. The sample is
the only bound; scoring reads every row and every word. Memory is one Arrow batch of texts and
the model, and in the learning task the features of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import sliced, table

#: ASCII punctuation but the apostrophe separates words.
SPLIT = bytes.maketrans(bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39), b" " * 31)
BITS, MOST_ROWS, EPOCHS = 20, 16_384, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
THRESHOLD = 0.3
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct coordinates of a text's words, word pairs and pairs one word apart."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(SPLIT).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    pair, skip = h[:-1] * _A + h[1:] * _B, h[:-2] * _B + h[2:] * _C
    mixed = np.concatenate([h, pair ^ (pair >> np.uint64(29)), skip ^ (skip >> np.uint64(31))]) * _C
    return np.unique(mixed >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Weights of a logistic regression, learnt one row at a time; coordinate 2^bits is the
    bias, which has no penalty."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, own: np.ndarray, label: int) -> None:
        at = np.append(own, len(self.z) - 1)
        w = self.weights(at)
        g = probability(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def probability(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS, longest: int = 200_000, epochs: int = EPOCHS, bits: int = BITS, **rates: float) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) of the model, nonzero ones and the bias.

    A doc_id labelled twice counts as toxic if it is once; null labels and ids are left out.
    Without any labelled row the bias alone says that nothing is toxic."""
    order = F.xxhash64("doc_id")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    sample = known.orderBy(order, "doc_id").limit(most_rows)  # most_rows narrow rows
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(sample), "doc_id").where(F.length("t") <= longest)
    rows = rows.select(order.alias("o"), F.xxhash64("t").alias("h"), "y", "t")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            own = [features(t.as_py(), bits).astype(np.int32) for t in b["t"]]
            yield pa.RecordBatch.from_arrays([b["o"], b["h"], b["y"], pa.array(own, pa.list_(pa.int32()))], names=["o", "h", "y", "at"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(int(y.as_py()), np.asarray(at.values)) for b in batches for y, at in zip(b["y"], b["at"], strict=True)]
        if not seen:
            return
        model = Ftrl(bits, **rates)
        for _ in range(epochs):
            for y, at in seen:
                model.learn(at.astype(np.int64), y)
        w = model.weights(np.arange(2**bits + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    ready = rows.mapInArrow(made, "o long, h long, y int, at array<int>").dropDuplicates(["o", "h"])
    model = ready.orderBy("o", "h").limit(most_rows).coalesce(1).select("y", "at").mapInArrow(learnt, "at long, w double").toPandas()
    if model.empty:  # no row was labelled, so nothing was learnt
        return np.array([2**bits]), np.array([-35.0])
    return model["at"].to_numpy(np.int64), model["w"].to_numpy(np.float64)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", bits: int = BITS) -> DataFrame:
    """Every row of `docs` with `score`, 0 to 1 (a column of that name is replaced). Null and
    empty texts have no features and get the bias's score; repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^bits + 1 pairs

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights = np.zeros(2**bits + 1)
        weights[shared.value[0]] = shared.value[1]
        return pa.array([probability(weights[features(t.as_py(), bits)].sum() + weights[-1]) for t in texts], pa.float64())

    return docs.withColumn("score", score(F.coalesce(F.col(text), F.lit(""))))


def clean(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score is below the threshold; columns as in `docs`."""
    rows = docs.select("*", F.col(text).alias("__text"))
    kept = scored(rows.withColumnRenamed("score", "__score"), train(docs, labels, text), "__text").where(F.col("score") < threshold).drop("score", "__text")
    return kept.withColumnRenamed("__score", "score") if "score" in docs.columns else kept


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
