"""Shared by the two text classifiers: the bounded training sample, follow-the-regularised-leader updates, and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks, crc32_of_id, one, release, small_batches


#: Bytes of features that the training task holds (documented bound of the sample).
FIT_BYTES = 120_000_000


class Ftrl:
    """Follow-the-regularised-leader updates of a logistic regression (per-coordinate rates, L1 and L2)."""

    def __init__(self, size: int, alpha: float, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float, importance: float) -> None:
        """One labelled row; `at` names each feature once."""
        w = self.weights(at)
        p = sigmoid(float(w @ x))
        g = (p - y) * importance * x
        n = self.n[at]
        s = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - s * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """doc_id, y and text of at most about `most` labelled documents that aren't held out, half of them of either label if there are so many.

    Documents are chosen by a hash of doc_id; rows that repeat an id all come. The choice is a table of ids of bounded size and goes to the documents, so texts are not shuffled. Labels other than 0 and 1 count as none; of several labels of one id the largest counts.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, most / 2 / n))).otherwise(share)
    u = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1e6
    chosen = known.filter(u < share).limit(most + most // 4)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")


Features = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]


def featurised(features: Features):
    """Rows to (doc_id, y, at, x): each text's feature numbers and values, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            got = [(at.astype(np.int32).tobytes(), x.astype(np.float32).tobytes()) for at, x in features(one(block["text"]))]
            yield pa.RecordBatch.from_arrays([one(block["doc_id"]), one(block["y"]), pa.array([a for a, _ in got], pa.binary()), pa.array([x for _, x in got], pa.binary())], ["doc_id", "y", "at", "x"])

    return run


def fit_in_one_task(rows: DataFrame, train: Callable[[list[tuple[np.ndarray, np.ndarray, int]]], np.ndarray]) -> np.ndarray:
    """Weights from featurised rows, in order of a hash of doc_id. The sample is bounded, so one task can hold it: of rows that repeat an id one counts, and rows beyond FIT_BYTES of features are left out. Only weights reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, last, size = [], None, 0
        for b in batches:
            for i, y, at, x in zip(*(b.column(k) for k in range(4)), strict=True):
                i, n = i.as_py(), at.as_buffer().size + x.as_buffer().size
                if i != last and size + n <= FIT_BYTES:
                    data.append((np.frombuffer(at.as_py(), np.int32), np.frombuffer(x.as_py(), np.float32), y.as_py()))
                    size += n
                last = i
        yield pa.RecordBatch.from_arrays([pa.array([train(data).astype(np.float32).tobytes()], pa.binary())], ["w"])
        del data
        release()

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(17)), "doc_id", "y", F.xxhash64("at"))
    with small_batches(rows.sparkSession):
        found = ordered.mapInArrow(run, "w binary").collect()
    return np.frombuffer(found[0]["w"], np.float32) if found else np.zeros(0, np.float32)


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            s = score(one(block["text"]))
            yield pa.RecordBatch.from_arrays([one(block["doc_id"]), one(block["held_out"]), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def remainder(modulus: int, value: int) -> Column:
    return F.pmod(crc32_of_id(), F.lit(modulus)) == value
