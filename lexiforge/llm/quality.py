"""Quality classifier: hashed word n-grams, a logistic regression by follow-the-regularised-leader updates, sparse dot products.

Two views of a text's words are hashed, as single words and pairs: the lower-cased words, and their shapes (runs of letter, digit and symbol classes; a word that repeats the one before it has a shape of its own). A feature's value is its share among the text's words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .linear import Ftrl, featurised, fit_in_one_task, remainder, scored, sigmoid, training_rows
from .shared import hash_text, mix, split_words

BITS = 18
#: Training rows at most (documented bound of the sample); passes over them.
TRAIN_ROWS, PASSES = 12_000, 4
SCALE = 4.0


class _Classes(dict):
    """A character's class for str.translate: A capital, a other letter or mark, 0 digit, else itself."""

    def __missing__(self, code: int) -> str:
        kind = unicodedata.category(chr(code))
        self[code] = "A" if kind == "Lu" else "a" if kind[0] in "LM" else "0" if kind[0] == "N" else chr(code)
        return self[code]


_CLASSES, _RUN = _Classes(), re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """Runs of character classes, e.g. Aa for a capitalised word and A! for a shouted one."""
    return _RUN.sub(r"\1", word.translate(_CLASSES))[:12]


def _hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts, where each text's begin, and each text's number of words."""
    words, ends = split_words(text)
    coded = words.dictionary_encode()
    code, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    word = hash_text(pc.utf8_lower(distinct).to_pylist())[code]
    form = hash_text([f"\x00{shape(w)}" for w in distinct.to_pylist()])[code]
    same = np.zeros(len(code), bool)
    same[1:] = word[1:] == word[:-1]
    same[ends[:-1][ends[:-1] < len(code)]] = False
    form[same] = np.uint64(0x5EED)
    p = np.uint64(0x9E3779B97F4A7C15)
    pairs = []
    for h in (word, form):
        prev = np.append(np.zeros(1, np.uint64), h[:-1]) if len(h) else h
        prev[ends[:-1][ends[:-1] < len(code)]] = 0  # the first word of a text follows nothing
        pairs += [h, mix(prev * p + h)]
    n = np.diff(ends)
    out = (np.stack(pairs, axis=1).reshape(-1) >> np.uint64(64 - BITS)).astype(np.int64) if len(code) else np.zeros(0, np.int64)
    return out, ends * 4, n


def _features(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at, ends, n = _hashes(text)
    for a, b, k in zip(ends[:-1], ends[1:], n, strict=True):
        which, count = np.unique(at[a:b], return_counts=True)
        yield np.append(which, 1 << BITS), np.append(SCALE * count / max(k, 1), 1.0)


def _train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    model = Ftrl((1 << BITS) + 1, alpha=1.0, l1=0.02, l2=0.1)
    for _ in range(PASSES):
        for at, x, y in rows:
            model.update(at, x, y, 1.0)
    return model.weights()


def fit(docs: DataFrame, labels: DataFrame, held_out, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights by feature number, the constant last. With no labelled row all are 0 and every score is 0.5."""
    rows = training_rows(docs, labels, "quality", held_out, most)
    w = fit_in_one_task(rows.mapInArrow(featurised(_features), "doc_id long, y int, at binary, x binary"), _train)
    return w if len(w) else np.zeros((1 << BITS) + 1, np.float32)


def score_texts(weights: np.ndarray, text: pa.Array) -> np.ndarray:
    at, ends, n = _hashes(text)
    sums = np.append(0.0, np.cumsum(weights[at].astype(np.float64)))
    return sigmoid(SCALE * (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(n, 1) + float(weights[-1]))


def score_documents(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null and empty texts have no feature and get the constant's score. Repeated rows get equal scores; a null doc_id is never trained on; an empty table gives no rows.
    """
    held_out = remainder(3, 1) if held_out is None else held_out
    weights = fit(docs, labels, held_out)
    return scored(docs, lambda text: score_texts(weights, text), held_out)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
