"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are n-grams of two views of the words: the words themselves (1 and 2 grams) and their shapes, in which runs of
letters, capitals and digits become one sign each and other characters stay (1 to 3 grams; a word equal to the one before has a
shape of its own). All are hashed into one space of 2 ** BITS; a text's vector holds the square roots of its n-grams' shares in each
view, so long texts weigh no more than short ones. A score is a sparse dot product with the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import arrow_map, chunks, documents, texts, type_of

BITS = 18
#: Labelled rows that a model is fitted on at most: those first by a hash of doc_id.
TRAIN_ROWS = 10_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
THRESHOLD = 0.7
REMEMBERED = 250_000

_CLASSES = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_SAME = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, tuple[int, int]] = {}


def _signs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word and for its shape."""
    if len(_known) > REMEMBERED:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = (zlib.crc32(w), zlib.crc32(_RUNS.sub(rb"\1", w.translate(_CLASSES)), 1))
    both = np.array([_known[w] for w in words], np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def features(raw: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (ascending, distinct) and values of a text's vector; empty for a text without words. Slot 0 takes n-grams like any other."""
    words = raw.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    word, shape = _signs(words)
    shape = shape.copy()
    shape[1:][word[1:] == word[:-1]] ^= _SAME
    parts, weights = [], []
    for view, signs, most in ((1, word, 2), (2, shape, 3)):
        gram = np.full(len(signs), view, np.uint64)
        for n in range(1, most + 1):
            if len(signs) < n:
                break
            gram = _mixed(gram[: len(signs) - n + 1] * np.uint64(0x100000001B3) + signs[n - 1 :])
            parts.append(gram >> np.uint64(64 - bits))
            weights.append(np.full(len(gram), 1 / len(gram), np.float64))
    index = np.concatenate(parts).astype(np.int64)
    at, inverse = np.unique(index, return_inverse=True)
    return at.astype(np.int32), np.sqrt(np.bincount(inverse, np.concatenate(weights))).astype(np.float32)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) for logistic loss; coordinate 2 ** bits is the intercept."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: DataFrame, bits: int = BITS, epochs: int = EPOCHS, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights (2 ** bits and the intercept, float32) from rows(doc_id, text, label), of which the `most` first by hash are used.

    Rows without a label are skipped; several labels of a doc_id count as rows each. Vectors are made in parallel and
    one task takes them in a fixed order, so reruns give the same weights. Without rows all weights are 0 and every score 0.5.
    """
    rows = rows.where(F.col("label").isNotNull()).withColumn("_order", F.xxhash64(F.col("doc_id").cast("string")))

    def vectors(batch: pa.RecordBatch) -> dict:
        found = [features(x, bits) for x in texts(batch)]
        return {"o": batch.column("_order"), "d": batch.column("doc_id"), "y": batch.column("label"), "i": [a.tobytes() for a, _ in found], "x": [b.tobytes() for _, b in found]}

    def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, one = Ftrl(bits), np.float32([1])
        for batch in it:
            for piece in chunks(batch):
                for y, i, x in zip(*[piece.column(c).to_pylist() for c in "yix"], strict=True):
                    model.update(np.append(np.frombuffer(i, np.int32), np.int32(1 << bits)), np.append(np.frombuffer(x, np.float32), one), y)
        yield pa.RecordBatch.from_pydict({"w": pa.array([model.weights(slice(None)).astype("<f4").tobytes()], pa.binary())})

    first = rows.select("_order", "doc_id", "text", F.col("label").cast("int").alias("label"))
    made = arrow_map(first, vectors, f"o long, d {type_of(rows, 'doc_id')}, y int, i binary, x binary")
    # each epoch's rows come as rows of their own, so the task that takes them in order holds a few at a time
    order = ["e", "o", "d", "i", "y"]
    passes = made.orderBy(*order[1:]).limit(most).select("*", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("e"))
    got = passes.repartition(1).sortWithinPartitions(*order).mapInArrow(fit, "w binary").collect()
    return np.frombuffer(got[0]["w"], "<f4") if got else np.zeros((1 << bits) + 1, "<f4")


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs. Null and empty texts get the score of the intercept alone.

    Repeated rows each get their row and one score; texts are read whole; an empty table gives an empty result; other columns are not read, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 4 * (2 ** bits + 1) bytes

    def f(batch: pa.RecordBatch) -> dict:
        w = sent.value
        logit = [float(w[-1]) + float(w[i] @ x) for i, x in (features(t, bits) for t in texts(batch))]
        return {"doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))), pa.float64())}

    return arrow_map(docs.select("doc_id", "text"), f, f"doc_id {type_of(docs, 'doc_id')}, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, label of the labelled rows that are not held out, the `most` first by hash; chosen before any text is read."""
    chosen = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    chosen = chosen.withColumn("_order", F.xxhash64(F.col("_id").cast("string"))).orderBy("_order", "_id", "label").limit(most)
    return docs.join(chosen.drop("_order"), docs["doc_id"] == F.col("_id")).select("doc_id", "text", "label")


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted. Without labels every score is 0.5; a null doc_id is not held out; see score() for other hard rows."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    weights = train(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score(docs, weights)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
