"""Correction by a noisy channel: all dictionary words within two edits of what was typed, by how likely the slip and the word are."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .. import lang
from ..functions.batches import together
from . import backoff as K
from .vocab import LONGEST

EDITS = 2
#: Letters of a word that can be within two edits of a dictionary word.
WIDTH = LONGEST + EDITS


@dataclass(frozen=True)
class Costs:
    """What slips cost; any other letter put in, left out or replaced costs 1. weight is what a cost of 1 takes from the logarithm of a word's share."""

    accent: float = 0.3
    adjacent: float = 0.5
    doubled: float = 0.6
    swapped: float = 0.7
    weight: float = 6.0


def _codes(words: pa.Array) -> np.ndarray:
    """Code points, a column a word, with zeros behind."""
    words = words.cast(pa.string())
    if not len(words):
        return np.zeros((1, 0), np.uint32)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    flat = words.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().decode() if ends[-1] > ends[0] else ""
    lengths = _lengths(words)
    codes = np.zeros((len(words), max(1, int(lengths.max()))), np.uint32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    return np.ascontiguousarray(codes.T)


def _lengths(words: pa.Array) -> np.ndarray:
    return np.asarray(pc.utf8_length(words))


def _plain(codes: np.ndarray) -> np.ndarray:
    """Code points of the letters without their marks."""
    table = np.zeros(int(codes.max(initial=0)) + 1, np.uint32)
    for k in np.flatnonzero(np.bincount(codes.ravel())).tolist():
        table[k] = ord(unicodedata.normalize("NFD", chr(k))[0])
    return table[codes]


#: What a letter and its place weigh in a hash, modulo 2^64: places by powers of an odd number, which has an inverse.
_MIX, _BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(WIDTH)], np.uint64)
_BACK = [np.uint64(pow(_BASE, -i, 1 << 64)) for i in range(3)]


def deletions(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words of WIDTH letters at most and of what is left of them without any one or two of their letters, each once a word: whose it is, the hash, and how many letters are gone. Words within two edits have one of these in common; with fewer edits, one with no more letters gone from either than there are edits. Unlike words that share a hash by chance are only compared in vain."""
    codes, lengths = _codes(words), _lengths(words)
    out = []
    for n in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == n)
        letters = (codes[:n, mine].astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
        letters ^= letters >> np.uint64(29)
        # What stands before each place; letters behind a gap move up by its width.
        upto = np.zeros((n + 1, len(mine)), np.uint64)
        np.cumsum(letters * _POWERS[:n, None], axis=0, out=upto[1:])
        tail = lambda i: upto[n] - upto[i]
        hashes = [upto[n], *(upto[i] + tail(i + 1) * _BACK[1] for i in range(n))]
        hashes += [upto[i] + (upto[j] - upto[i + 1]) * _BACK[1] + tail(j + 1) * _BACK[2] for i in range(n) for j in range(i + 1, n)]
        hashes, gone = np.array(hashes), np.repeat(np.array([0, 1, 2], np.int8), [1, n, n * (n - 1) // 2])
        order = np.argsort(hashes, axis=0)
        hashes = np.take_along_axis(hashes, order, axis=0)
        first = np.ones(hashes.shape, bool)
        first[1:] = hashes[1:] != hashes[:-1]
        place, word = np.nonzero(first)
        out.append((mine[word], hashes[place, word].view(np.int64), gone[order[place, word]]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _with_keys(rows: DataFrame) -> DataFrame:
    """rows, with their words first, for each of the words' deletions: adds key and gone."""
    names = [*rows.columns, "key", "gone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                whose, keys, gone = deletions(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(whose)).columns, pa.array(keys), pa.array(gone)], names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("key", LongType()), StructField("gone", ByteType())]))


#: A code point beyond all that have neighbours on the keyboard, and which pairs are neighbours.
_TOP = max(ord(x) for a, bs in lang.ADJACENT.items() for x in a + bs) + 1
_NEAR = np.zeros((_TOP + 1, _TOP + 1), bool)
for _a, _bs in lang.ADJACENT.items():
    for _b in _bs:
        _NEAR[ord(_a), ord(_b)] = _NEAR[ord(_b), ord(_a)] = True
#: Letters of either side that two swapped letters take, one of the sides with a letter between them.
_SWAPS = ((2, 2), (2, 3), (3, 2))


def _band(i: int, top: int) -> range:
    return range(max(0, i - EDITS), min(top, i + EDITS) + 1)


def _steps(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The number of edits between the words of each column; 255 where lengths are too far apart. Bytes will do: within the band, a number is at most a word's length and EDITS."""
    end = np.full(len(n), 255, np.uint8)
    steps: dict[tuple[int, int], np.ndarray] = {}
    differ = {(i, j): (a[i - 1] != b[j - 1]).view(np.uint8) for i in range(1, len(a) + 1) for j in range(max(1, i - EDITS - 1), min(len(b), i + EDITS + 1) + 1)}
    for i in range(len(a) + 1):
        for j in _band(i, len(b)):
            if not (i and j):
                s = np.full(len(n), i + j, np.uint8)
            else:
                s = steps[i - 1, j - 1] + differ[i, j]
                for before in ((i - 1, j), (i, j - 1)):
                    if before in steps:
                        np.minimum(s, steps[before] + 1, out=s)
                for di, dj in _SWAPS:
                    if i >= di and j >= dj and (i - di, j - dj) in steps:
                        not_there = differ[i, j - dj + 1] | differ[i - di + 1, j]
                        np.minimum(s, steps[i - di, j - dj] + (di + dj - 3) + not_there * 100, out=s)
            steps[i, j] = s
            np.copyto(end, s, where=(n == i) & (m == j))
    return end


def _weighed(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, costs: Costs) -> np.ndarray:
    """The least cost of a way between the words of each column; infinite where lengths are too far apart."""
    end = np.full(len(n), np.inf)
    plain_a, plain_b = _plain(a), _plain(b)
    near_a, near_b = np.minimum(a, _TOP).astype(np.intp) * (_TOP + 1), np.minimum(b, _TOP).astype(np.intp)
    near = _NEAR.ravel()
    again = lambda x: [None, np.ones(len(n)), *(np.where(x[i] == x[i - 1], costs.doubled, 1.0) for i in range(1, len(x)))]
    out_of, into = again(a), again(b)
    ways: dict[tuple[int, int], np.ndarray] = {(0, 0): np.zeros(len(n))}
    same = {(i, j): a[i - 1] == b[j - 1] for i in range(1, len(a) + 1) for j in range(max(1, i - EDITS - 1), min(len(b), i + EDITS + 1) + 1)}
    for i in range(len(a) + 1):
        for j in _band(i, len(b)):
            w = ways.get((i, j), end)
            if i and j:
                c = np.where(near[near_a[i - 1] + near_b[j - 1]], costs.adjacent, 1.0)
                c[plain_a[i - 1] == plain_b[j - 1]] = costs.accent
                c[same[i, j]] = 0.0
                w = ways[i - 1, j - 1] + c
            if (i - 1, j) in ways:
                w = np.minimum(w, ways[i - 1, j] + out_of[i]) if w is not end else ways[i - 1, j] + out_of[i]
            if (i, j - 1) in ways:
                w = np.minimum(w, ways[i, j - 1] + into[j]) if w is not end else ways[i, j - 1] + into[j]
            for di, dj in _SWAPS:
                if i >= di and j >= dj and (i - di, j - dj) in ways:
                    np.minimum(w, ways[i - di, j - dj] + costs.swapped + (di + dj - 4), out=w, where=same[i, j - dj + 1] & same[i - di + 1, j])
            ways[i, j] = w
            np.copyto(end, w, where=(n == i) & (m == j))
    return end


def distances(typed: list[str], words: list[str], costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """The number of edits between pairs of words, exact up to EDITS, and the least cost of a way with its slips weighed. An edit is a letter put in, left out, replaced, or two letters that follow each other swapped, also with a letter put in or left out between them.

    All pairs go through one table of sums together, of which only the band is made that EDITS can reach.
    """
    texts = [pa.array(x, pa.string()) for x in (typed, words)]
    sides = (*map(_codes, texts), *map(_lengths, texts))
    steps = _steps(*sides)
    return np.where(steps == 255, np.inf, steps), _weighed(*sides, costs)


#: Pairs that are measured at once: steps over them cost little beside each call.
MEASURED = 1 << 14


def _asked(typed: DataFrame) -> DataFrame:
    """typed and _low, once each, of what can be within two edits of a dictionary word."""
    return typed.select("typed", F.lower("typed").alias("_low")).distinct().filter((F.length("_low") <= WIDTH) & (F.col("_low") != ""))


def _measured(asked: DataFrame, words: DataFrame, costs: Costs | None) -> DataFrame:
    """_low, word, cnt, edits and cost (not without costs): all words within two edits of _low, as often as keys lead them together."""
    # Words and pairs are few bytes and much work: by their bytes alone, they would be put together in too few tasks, or sent to all.
    session = words.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    left = _with_keys(asked.select("_low").distinct().repartition(tasks)).repartition(tasks, "key")
    some = words.filter((F.length("word") <= LONGEST) & (F.col("word") != "")).select("word", "cnt")
    right = _with_keys(some.repartition(tasks)).drop("gone").repartition(tasks, "key")
    pairs = left.join(K.merged(right), "key").select("_low", "word", "cnt", "gone")
    names = ["_low", "word", "cnt", "edits"] + ["cost"] * (costs is not None)
    kind = words.schema["cnt"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, 4 * MEASURED):
            # Pairs of like length together: the longest word of a slice sets the size of its table.
            batch = batch.take(pc.sort_indices(pc.utf8_length(batch.column(0))))
            for at in range(0, len(batch), MEASURED):
                part = batch.slice(at, MEASURED)
                sides = (*map(_codes, part.columns[:2]), *map(_lengths, part.columns[:2]))
                edits, gone = _steps(*sides), np.asarray(part.column(3)).astype(np.int64)
                # A pair of fewer edits also has a key with fewer letters gone: it is given there.
                most = np.maximum(gone, gone + sides[3] - sides[2])
                ok = np.flatnonzero((edits <= EDITS) & ((edits == EDITS) | (most <= edits)))
                columns = [*part.take(pa.array(ok)).columns[:3], pa.array(edits[ok].astype(np.int64))]
                if costs is not None:
                    columns.append(pa.array(np.round(_weighed(*(x[..., ok] for x in sides), costs), 9)))
                yield pa.RecordBatch.from_arrays(columns, names)

    return pairs.mapInArrow(measure, f"_low string, word string, cnt {kind}, edits bigint" + ", cost double" * (costs is not None))


def candidates(typed: DataFrame, words: DataFrame, costs: Costs | None = Costs()) -> DataFrame:
    """typed, word, cnt, edits and cost (not without costs): all words (word, cnt) within two edits of what was typed, once each, whatever the case of what was typed. Words are of LONGEST letters at most, as in dictionaries.

    What two words have in common after deletions leads them together, by its hash, and distances are then exact: only what is within two edits is shuffled again.
    """
    asked = _asked(typed)
    measured = _measured(asked, words, costs)
    # What was typed and its words are dealt alike: what several keys found goes without another shuffle.
    return measured.join(K.merged(asked), "_low").distinct().select("typed", *measured.columns[1:])


def corrections(typed: DataFrame, words: DataFrame, k: int = 5, costs: Costs = Costs()) -> DataFrame:
    """typed and topk: the k best candidates by ln cnt less what the slip costs, ties in order."""
    score = F.round(F.log("cnt") - costs.weight * F.col("cost"), 9)
    r = F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("_s"), "word"))
    best = candidates(typed, words, costs).withColumn("_s", score).withColumn("r", r).filter(F.col("r") <= k)
    return best.groupBy("typed").agg(F.array_sort(F.collect_list(F.struct("r", "word")))["word"].alias("topk"))


#: Scores as near as this to the last of the best words count as ties of it until they are rounded.
TIES = 1e-8


def _lists(asked: DataFrame, words: DataFrame, model: K.Model, k: int, costs: Costs) -> DataFrame:
    """_low, its candidates (words, on lines, and costs) by the logarithm of the word's own share less what the slip costs, and the shares of the first k of them, with ties of the last (first)."""
    shares = words.select("word").join(K.merged(model.one.withColumnRenamed("w3", "word")), "word", "left").select("word", F.coalesce("p1", F.lit(model.p0)).alias("cnt"))
    one = F.struct((costs.weight * F.col("cost") - F.log("cnt")).alias("s"), "word", "cost", F.col("cnt").alias("p"))
    by_word = _measured(asked, shares, costs).repartition("_low").distinct().groupBy("_low").agg(F.array_sort(F.collect_list(one)).alias("every"))
    last = F.get("every", F.least(F.size("every"), F.lit(k)) - 1)["s"]
    first = F.transform(F.filter("every", lambda x: x["s"] <= last + TIES), lambda x: x["p"])
    return by_word.select("_low", F.array_join("every.word", "\n").alias("words"), F.col("every.cost").alias("costs"), first.alias("first"))


def corrections_in_text(typed: DataFrame, words: DataFrame, model: K.Model, k: int = 5, costs: Costs = Costs()) -> DataFrame:
    """prev2, prev, typed and topk: the k best candidates of what was typed after two words, by the logarithm of their share there in a back-off model, less what the slip costs. Contexts are judged once each.

    A candidate that the texts never have after prev has its own share there, times what the context lets go: such candidates stand in one order after all contexts, and the first k of them are enough. The others are pairs of the texts, so the part of the model that has prev finds and scores them, and no table of contexts by candidates is made.
    """
    asked = typed.select("prev2", "prev", "typed").distinct()
    lists = _lists(_asked(asked), words, model, k, costs)
    parts = model.parts
    ask = asked.withColumn("_low", F.lower("typed")).mapInArrow(K.to_parts(parts), "prev2 string, prev string, typed string, _low string, part int")
    ask = ask.repartition("_low").groupBy("_low", "part").agg(F.collect_list(F.struct("prev2", "prev", "typed")).alias("contexts")).join(K.merged(lists), "_low").drop("_low")
    found = K.scored_candidates(ask, model)
    if parts.salts:
        # What the parts of a dealt word found is put together; the others have one row.
        same = [F.max(c).alias(c) for c in ("g3", "g2")] + [F.first("first").alias("first")]
        found = found.groupBy("prev2", "prev", "typed").agg(*same, F.flatten(F.collect_list("seen")).alias("seen"))
    g3, g2 = (F.coalesce(c, F.lit(1.0)) for c in ("g3", "g2"))
    scored = lambda x, p: F.struct((-F.round(F.log(p) - costs.weight * x["cost"], 9)).alias("s"), x["word"].alias("word"))
    seen = F.transform("seen", lambda x: scored(x, F.when(x["tri"], x["p"]).otherwise(g3 * x["p"])))
    rest = F.transform(F.filter("first", lambda x: ~F.exists("seen", lambda y: y["word"] == x["word"])), lambda x: scored(x, g3 * (g2 * x["p"])))
    topk = F.transform(F.slice(F.array_sort(F.concat(seen, rest)), 1, k), lambda x: x["word"])
    return found.select("prev2", "prev", "typed", topk.alias("topk"))
