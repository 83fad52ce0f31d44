"""Toxicity classifier: presence of character n-grams, scaled by naive Bayes log-count ratios, under a linear model.

N-grams of 3 to 5 characters of the lower-cased text, white space as one space and a space at either end, are hashed to 2^18 features. A feature's value is its log-count ratio between toxic and other training texts; the linear model is a logistic regression with L1, so most weights are 0 and long clean texts gather nothing. The features that L1 leaves are fitted once more without it, as it makes their weights too small. How strong L1 is follows from the training rows alone: of a fixed list of strengths, the one with the least log loss on a quarter of them, after a fit on the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .linear import Ftrl, featurised, fit_in_one_task, remainder, scored, sigmoid, training_rows
from .shared import split_words

BITS = 18
ORDERS = (3, 4, 5)
#: Training rows at most (documented bound of the sample); passes over them.
TRAIN_ROWS, PASSES = 6_000, 4
#: Added to each count of a log-count ratio; training texts that a feature must be in; the least ratio, either way, of a feature that takes part.
SMOOTH, LEAST, RATIO = 1.0, 10, 1.0
#: Strengths of L1 to choose from.
STRENGTHS = (0.5, 2.0, 5.0, 10.0, 20.0, 40.0)


def _presence(text: pa.Array) -> Iterator[np.ndarray]:
    """The feature numbers in each text, each once, ascending."""
    words, ends = split_words(pc.utf8_lower(text))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words)
    joined = pc.binary_join_element_wise(" ", pc.binary_join(lists, " "), " ", "")
    data = np.frombuffer("".join(joined.to_pylist()).encode("utf-32-le"), np.uint32)
    to = np.append(0, np.cumsum(np.asarray(pc.utf8_length(joined), dtype=np.int64)))
    grams, rolling = [], np.zeros(len(data), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        m = len(data) - k + 1
        if m <= 0:
            break
        rolling = rolling[:m] * np.uint32(0x01000193) + data[k - 1 :] + np.uint32(1)
        if k in ORDERS:
            h = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
            grams.append((k, ((h ^ (h >> np.uint32(13))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)))
    mark = np.zeros(1 << BITS, bool)
    for a, b in zip(to[:-1], to[1:], strict=True):
        for k, h in grams:
            mark[h[a : max(a, b - k + 1)]] = True
        at = np.flatnonzero(mark)
        mark[at] = False
        yield at


def _features(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in _presence(text):
        yield at, np.zeros(0)


Rows = list[tuple[np.ndarray, np.ndarray, int]]


def _ratios(rows: Rows) -> np.ndarray:
    """Log-count ratios; 0 for features that take no part."""
    count = np.zeros((2, 1 << BITS))
    for at, _, y in rows:
        count[y, at] += 1
    p, q = count[1] + SMOOTH, count[0] + SMOOTH
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where((count.sum(axis=0) < LEAST) | (np.abs(ratio) < RATIO), 0.0, ratio)


def _fitted(rows: list[tuple[np.ndarray, int]], ratio: np.ndarray, l1: float) -> np.ndarray:
    """Weights and the constant; features without a ratio take no part."""
    size = 1 << BITS
    used = [(at[ratio[at] != 0], y) for at, y in rows]
    model = Ftrl(size + 1, alpha=0.1, l1=l1, l2=0.01)
    for _ in range(PASSES):
        for at, y in used:
            model.update(np.append(at, size), np.append(ratio[at], 1.0), y, 1.0)
    return model.weights()


def _weights(rows: Rows, l1: float) -> np.ndarray:
    """Weights scaled by the ratios, and the constant."""
    ratio, few = _ratios(rows), [(at, y) for at, _, y in rows]
    kept = _fitted(few, ratio, l1)[:-1] != 0
    ratio = np.where(kept, ratio, 0.0)
    w = _fitted(few, ratio, 0.0)
    return np.append(w[:-1] * ratio, w[-1])


def _loss(w: np.ndarray, rows: Rows) -> float:
    s = sigmoid(np.array([w[at].sum() for at, _, _ in rows]) + w[-1])
    return float(-np.log(np.where(np.array([y for *_, y in rows]) == 1, s, 1 - s) + 1e-12).mean())


def _train(rows: Rows) -> np.ndarray:
    if len(rows) < 8:
        return _weights(rows, STRENGTHS[0])
    rest, own = [r for i, r in enumerate(rows) if i % 4], rows[::4]
    return _weights(rows, min(STRENGTHS, key=lambda l1: _loss(_weights(rest, l1), own)))


def fit(docs: DataFrame, labels: DataFrame, held_out, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights by feature number, already scaled by the ratios, the constant last. With no labelled row all are 0 and every score is 0.5."""
    rows = training_rows(docs, labels, "toxic", held_out, most)
    w = fit_in_one_task(rows.mapInArrow(featurised(_features), "doc_id long, y int, at binary, x binary"), _train)
    return w if len(w) else np.zeros((1 << BITS) + 1, np.float32)


def score_texts(weights: np.ndarray, text: pa.Array) -> np.ndarray:
    return sigmoid(np.fromiter((weights[at].sum() for at in _presence(text)), np.float64, len(text)) + float(weights[-1]))


def score_documents(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null and empty texts have no n-gram but the spaces' and get about the constant's score. Repeated rows get equal scores; a null doc_id is never trained on; an empty table gives no rows.
    """
    held_out = remainder(5, 0) if held_out is None else held_out
    weights = fit(docs, labels, held_out)
    return scored(docs, lambda text: score_texts(weights, text), held_out)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
