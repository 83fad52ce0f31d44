"""Tokenizer training and encoding by a unigram language model, as Spark jobs over a table of distinct words.

A word may be cut into pieces in many ways, its lattice; a piece has a log probability. Training starts from frequent substrings, and in each round runs expectation maximisation (expected counts of pieces over all lattices, summed by Spark) and then drops the pieces whose loss would cost the least likelihood. Encoding takes the best path. Pieces are a bounded table (`seeds` at most) that goes to the workers; words and texts stay where they are.

Lattices of words of one length are computed together: a piece is found by a 64-bit hash of its code points among the sorted hashes of all pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from .. import lang
from ..functions.batches import together
from .order import least_k

#: Code points of a piece at most; how much worse than the worst piece an unknown character is.
LONGEST, UNKNOWN = 16, 10.0
#: Entries of lattices that are held at once.
ENTRIES = 1 << 21
#: Words whose ids a task remembers.
REMEMBERED = 1 << 18
#: The least expected count of a character, so that every known character keeps a probability.
FLOOR = 1e-3
#: First bits of a piece's hash by which it is looked up.
HEAD = 18
_TAIL = np.uint64(64 - HEAD)
#: Words that a step of training takes at once, and how unlikely a word may be to be summed without logarithms.
WORDS, UNLIKELY = 1 << 16, 600.0
_BASE, _LENGTH = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _any_of(pieces: tuple[str, ...]) -> list[str]:
    """A pattern of the longest of the pieces, if there are any. Pieces of one first character stand together behind a look at it, so that hundreds of them are not tried at each character of a text."""
    heads: dict[str, list[str]] = {}
    for p in sorted(pieces, key=len, reverse=True):
        heads.setdefault(p[0], []).append(p)
    code = lambda c: rf"\x{{{ord(c):X}}}"
    ways = [rf"(?={code(c)})(?:{'|'.join(rf'\Q{p}\E' for p in own)})" for c, own in heads.items()]
    return [rf"(?=[{''.join(map(code, heads))}])(?:{'|'.join(ways)})"] if ways else []


def pretokens(text: Column, reserved: tuple[str, ...] = ()) -> Column:
    """The words of a text as an array: a run up to a space, with the space as a mark at its end. Lines and reserved pieces stand apart; reserved pieces are words of their own."""
    marked = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(lang.SPACE_MARK))
    own = _any_of(reserved)
    if own:  # each on a line of its own; patterns without groups in loops stand texts of any length
        marked = F.regexp_replace(marked, "|".join(own), "\n$0\n")
    run = rf"[^\n{lang.SPACE_MARK}]"
    return F.regexp_extract_all(marked, F.lit("|".join([*own, rf"{run}*{lang.SPACE_MARK}", rf"{run}+"])), F.lit(0))


def word_table(texts: DataFrame, text: str = "text", reserved: tuple[str, ...] = ()) -> DataFrame:
    """word and cnt of all texts, without reserved pieces."""
    words = texts.select(F.explode(pretokens(F.col(text), reserved)).alias("word"))
    return words.filter(~F.col("word").isin(*reserved)).groupBy("word").agg(F.count("*").alias("cnt"))


def alphabet(words: DataFrame, coverage: float = 0.9995) -> DataFrame:
    """piece and cnt: the most frequent characters, as many as cover that share of all; ties go to the smaller. There is one row for each character of the corpus, so the window is bounded by Unicode."""
    chars = words.select(F.explode(F.split("word", "")).alias("piece"), "cnt").filter("piece <> ''").groupBy("piece").agg(F.sum("cnt").alias("cnt"))
    order = Window.orderBy(F.desc("cnt"), "piece")
    upto = F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cnt")
    total = F.sum("cnt").over(Window.partitionBy())
    return chars.select("piece", "cnt", upto.alias("before"), total.alias("total")).filter(F.col("before") < F.col("total") * coverage).select("piece", "cnt")


def _itself(df: DataFrame) -> DataFrame:
    return df


def seed_pieces(words: DataFrame, known: DataFrame, seeds: int, longest: int = LONGEST, kept: Callable[[DataFrame], DataFrame] = _itself) -> DataFrame:
    """piece and cnt: the characters, and of the substrings of words that occur twice the `seeds` with the most characters in all (ties to the smaller). No substring holds an unknown character. Only these characters, of which there are no more than in Unicode, come to the driver. Counts of substrings are read several times; `kept` may make a table of them."""
    odd = sorted(r.c for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().join(known.select(F.col("piece").alias("c")), "c", "left_anti").filter("c <> ''").collect())
    runs = F.array("word")
    if odd:  # words are cut where they have unknown characters, before substrings are made of them
        one = odd[-1]
        runs = F.split(F.translate("word", "".join(odd[:-1]), one * (len(odd) - 1)) if len(odd) > 1 else F.col("word"), rf"\x{{{ord(one):X}}}")
    n = F.length("run")
    starts = words.select("cnt", F.explode(runs).alias("run")).filter(n > 1).select("run", "cnt", F.explode(F.sequence(F.lit(1), n - 1)).alias("i"))
    subs = starts.select("cnt", F.explode(F.transform(F.sequence(F.lit(2), F.least(n - F.col("i") + 1, F.lit(longest))), lambda k: F.substring(F.col("run"), F.col("i"), k))).alias("piece"))
    counts = subs.groupBy("piece").agg(F.sum("cnt").alias("cnt")).filter("cnt > 1")
    ranked = counts.withColumn("rank", -F.col("cnt") * F.length("piece"))
    return least_k(kept(ranked), "rank", ["piece"], seeds).select("piece", "cnt").unionByName(known)


@dataclass
class Pieces:
    """Pieces with their log probabilities, sorted by the hash of each."""

    text: list[str]
    score: np.ndarray

    def __post_init__(self) -> None:
        keys = np.zeros(len(self.text), np.uint64)
        for rows, codes in _by_length(self.text):
            h = np.zeros(len(rows), np.uint64)
            for j in range(codes.shape[1]):
                h = _longer(h, codes[:, j])
            keys[rows] = _key(h, codes.shape[1])
        order = np.argsort(keys)
        self.keys, self.text, self.score = keys[order], [self.text[i] for i in order], np.asarray(self.score, np.float64)[order]
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.longest = int(self.size.max(initial=1))
        self.unknown = float(self.score.min(initial=0.0)) - UNKNOWN
        # Where the keys with the same first bits begin, and how many have the most common ones.
        heads = (self.keys >> _TAIL).astype(np.int64)
        self.begin = np.minimum(np.searchsorted(heads, np.arange(1 << HEAD)), max(0, len(self.keys) - 1))
        self.crowd = int(np.unique(heads, return_counts=True)[1].max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        if not len(self.keys):
            return np.full(keys.shape, -1, np.int32)
        flat = keys.ravel()
        at = self.begin[(flat >> _TAIL).view(np.int64)]
        there = self.keys[at]
        out = np.where(there == flat, at, -1)
        # Few keys come behind another one of their first bits.
        behind = np.flatnonzero(there < flat)
        for more in range(1, self.crowd):
            place = np.minimum(at[behind] + more, len(self.keys) - 1)
            there = self.keys[place]
            hit = there == flat[behind]
            out[behind[hit]] = place[hit]
            behind = behind[there < flat[behind]]
        return out.reshape(keys.shape)


def _longer(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (h ^ (code.astype(np.uint64) + np.uint64(1))) * _BASE


def _key(h: np.ndarray, length: int) -> np.ndarray:
    x = (h + np.uint64(length)) * _LENGTH
    return x ^ (x >> np.uint64(31))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers, and code points as a matrix, of the words of each length."""
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        most = max(1, ENTRIES // (n * LONGEST))
        for a in range(0, len(rows), most):
            part = rows[a : a + most]
            yield part, np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), n)


def _lattice(codes: np.ndarray, pieces: Pieces, whole: bool = True) -> np.ndarray:
    """The piece number of each substring by start and length (from 1), or -1. Without `whole`, the whole word is no piece."""
    n, size = codes.shape
    most = min(size, pieces.longest)
    out = np.full((n, size, most), -1, np.int32)
    codes = np.ascontiguousarray(codes.T)
    for i in range(size):
        h = np.zeros(n, np.uint64)
        for k in range(min(most, size - i)):
            h = _longer(h, codes[i + k])
            if whole or k + 1 < size:
                out[:, i, k] = pieces.find(_key(h, k + 1))
    return out


def _steps(ids: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The log probability of each substring: none (-inf) if it is no piece, but an unknown character has one."""
    scores = np.append(pieces.score, -np.inf)[ids]
    scores[:, :, 0] = np.where(ids[:, :, 0] < 0, pieces.unknown, scores[:, :, 0])
    return scores


def _logsum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(terms - safe[:, None]).sum(axis=1))


def _plainly(codes: np.ndarray, weight: np.ndarray, pieces: Pieces, total: np.ndarray) -> float:
    """expected() of words of one length whose probabilities are not too small for numbers without logarithms: adds to total, of which the first is that of unknown characters, and gives the log likelihood."""
    n, size = codes.shape
    codes, most = np.ascontiguousarray(codes.T), min(size, pieces.longest)
    chance, unknown = np.append(np.exp(pieces.score), 0.0), np.exp(pieces.unknown)
    before, after = np.zeros((size + 1, n)), np.zeros((size + 1, n))
    before[0] = after[size] = 1.0
    steps = []
    for i in range(size):
        longest = min(most, size - i)
        keys, h = np.empty((longest, n), np.uint64), np.zeros(n, np.uint64)
        for k in range(longest):
            h = _longer(h, codes[i + k])
            keys[k] = _key(h, k + 1)
        found = pieces.find(keys)
        for k, ids in enumerate(found, 1):
            if k > 1 and ids.max(initial=-1) < 0:
                continue
            p = chance[ids]
            if k == 1:
                p[ids < 0] = unknown
            before[i + k] += before[i] * p
            steps.append((i, k, ids, p))
    for i, k, _, p in reversed(steps):
        after[i] += p * after[i + k]
    share = weight / before[size]
    for i, k, ids, p in steps:
        total += np.bincount(ids + 1, before[i] * p * after[i + k] * share, len(total))
    return float((weight * np.log(before[size])).sum())


def expected(words: list[str], cnt: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, float]:
    """The expected count of each piece over all segmentations of the words, and the log likelihood, by the forward-backward algorithm."""
    total, likelihood = np.zeros(len(pieces.text)), 0.0
    for rows, codes in _by_length(words):
        n, size = codes.shape
        if -pieces.unknown * size < UNLIKELY:
            more = np.zeros(len(total) + 1)
            likelihood += _plainly(codes, cnt[rows].astype(np.float64), pieces, more)
            total += more[1:]
            continue
        ids = _lattice(codes, pieces)
        steps, most = _steps(ids, pieces), ids.shape[2]
        before, after = np.full((n, size + 1), -np.inf), np.full((n, size + 1), -np.inf)
        before[:, 0] = after[:, size] = 0.0
        for j in range(1, size + 1):
            before[:, j] = _logsum(np.stack([before[:, j - k] + steps[:, j - k, k - 1] for k in range(1, min(most, j) + 1)], axis=1))
        for i in range(size - 1, -1, -1):
            after[:, i] = _logsum(np.stack([steps[:, i, k - 1] + after[:, i + k] for k in range(1, min(most, size - i) + 1)], axis=1))
        weight = cnt[rows].astype(np.float64)
        likelihood += float((weight * before[:, size]).sum())
        for k in range(1, most + 1):
            share = np.exp(before[:, : size - k + 1] + steps[:, : size - k + 1, k - 1] + after[:, k:] - before[:, size :]) * weight[:, None]
            mine = ids[:, : size - k + 1, k - 1]
            there = mine >= 0
            total += np.bincount(mine[there], share[there], len(total))
    return total, likelihood


def best(words: list[str], pieces: Pieces, whole: bool = True) -> tuple[list[list[int]], np.ndarray]:
    """The best segmentation of each word, and its log probability. A segment is a piece's number, or minus one minus the code point of an unknown character. Of equal segmentations, the one whose last pieces are shorter is taken."""
    out: list[list[int]] = [[] for _ in words]
    score = np.zeros(len(words))
    for rows, codes in _by_length(words):
        n, size = codes.shape
        ids = _lattice(codes, pieces, whole)
        steps, most = _steps(ids, pieces), ids.shape[2]
        if not whole and size == 1:
            steps[:] = -np.inf
        reach, back = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int64)
        reach[:, 0] = 0.0
        for j in range(1, size + 1):
            terms = np.stack([reach[:, j - k] + steps[:, j - k, k - 1] for k in range(1, min(most, j) + 1)], axis=1)
            back[:, j] = terms.argmax(axis=1) + 1
            reach[:, j] = terms.max(axis=1)
        score[rows] = reach[:, size]
        ends = np.full(n, size)
        every = np.arange(n)
        path: list[tuple[np.ndarray, np.ndarray]] = []
        while (ends > 0).any():
            k = np.where(ends > 0, back[every, ends], 0)
            start = ends - k
            piece = np.where(k > 0, ids[every, np.minimum(start, size - 1), np.maximum(k, 1) - 1], 0)
            piece = np.where((k > 0) & (piece < 0), -1 - codes[every, np.minimum(start, size - 1)].astype(np.int64), piece)
            path.append((piece, k > 0))
            ends = start
        for row, r in enumerate(rows.tolist()):
            out[r] = [int(p[row]) for p, there in reversed(path) if there[row]]
    return out, score


def _summed(pieces: Pieces) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, likelihood = np.zeros(len(pieces.text)), 0.0
        for batch in together(batches, WORDS):
            more, z = expected(batch.column(0).to_pylist(), np.asarray(batch.column(1)), pieces)
            total, likelihood = total + more, likelihood + z
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(total[seen], likelihood))], ["id", "value"])

    return run


def counted(words: DataFrame, pieces: Pieces) -> tuple[np.ndarray, float]:
    """expected() over a table of words: a task sums its words, Spark sums the tasks. As many rows as there are pieces come back."""
    sums = words.select("word", "cnt").mapInArrow(_summed(pieces), "id int, value double").groupBy("id").agg(F.sum("value").alias("value")).toArrow()
    ids, values = sums["id"].to_numpy(), sums["value"].to_numpy()
    total = np.zeros(len(pieces.text))
    total[ids[ids >= 0]] = values[ids >= 0]
    return total, float(values[ids < 0].sum())


def _renewed(pieces: Pieces, counts: np.ndarray) -> Pieces:
    """Log probabilities from expected counts; pieces of several characters that are never expected go."""
    kept = np.flatnonzero((pieces.size == 1) | (counts > 0))
    c = np.maximum(counts[kept], np.where(pieces.size[kept] == 1, FLOOR, 0.0))
    return Pieces([pieces.text[i] for i in kept], np.log(c / c.sum()))


def _losses(pieces: Pieces) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, without = best(batch.column(1).to_pylist(), pieces, whole=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(without)], ["id", "without"])

    return run


def pruned(spark: SparkSession, pieces: Pieces, counts: np.ndarray, most: int) -> Pieces:
    """The characters, and the pieces whose loss would cost the most, up to `most`: a piece's expected count times how much worse its best other segmentation is. Ties go to the smaller piece."""
    long = np.flatnonzero(pieces.size > 1)
    rows = pa.table({"id": pa.array(long, pa.int32()), "piece": [pieces.text[i] for i in long]})
    found = spark.createDataFrame(rows).repartition(spark.sparkContext.defaultParallelism).mapInArrow(_losses(pieces), "id int, without double").toArrow()
    without = np.zeros(len(pieces.text))
    without[found["id"].to_numpy()] = found["without"].to_numpy()
    loss = counts * (pieces.score - without)
    order = sorted(long.tolist(), key=lambda i: (-loss[i], pieces.text[i]))
    kept = [*np.flatnonzero(pieces.size == 1).tolist(), *order[: max(0, most - int((pieces.size == 1).sum()))]]
    return Pieces([pieces.text[i] for i in kept], pieces.score[kept])


@dataclass
class Training:
    """What a training gives: the pieces, and for each step its round, the number of pieces and the log likelihood before the step."""

    pieces: Pieces
    log: list[tuple[int, int, float]]


def train(words: DataFrame, most: int, seeds: int = 200_000, shrink: float = 0.75, steps: int = 2, coverage: float = 0.9995, kept: Callable[[DataFrame], DataFrame] = _itself) -> Training:
    """Trains `most` pieces on word and cnt (a table that is read several times).

    Each round takes `steps` of expectation maximisation and keeps `shrink` of the pieces, until `most` are left; all characters of the coverage stay. In a round the likelihood never falls.
    """
    spark = words.sparkSession
    seed = seed_pieces(words, alphabet(words, coverage), seeds, kept=kept).toArrow()
    text, cnt = seed["piece"].to_pylist(), seed["cnt"].to_numpy().astype(np.float64)
    if not text:
        return Training(Pieces([], np.zeros(0)), [])
    pieces, log, turn = Pieces(text, np.log(cnt / cnt.sum())), [], 0
    while True:
        for _ in range(steps):
            counts, likelihood = counted(words, pieces)
            log.append((turn, len(pieces.text), likelihood))
            pieces = _renewed(pieces, counts)
        if len(pieces.text) <= most or not (pieces.size > 1).any():
            return Training(pieces, log)
        counts, likelihood = counted(words, pieces)
        log.append((turn, len(pieces.text), likelihood))
        smaller = pruned(spark, pieces, counts, max(most, int(len(pieces.text) * shrink)))
        if len(smaller.text) == len(pieces.text):
            return Training(pieces, log)
        pieces, turn = smaller, turn + 1


def vocabulary(pieces: Pieces, reserved: tuple[str, ...] = ()) -> list[tuple[int, str, float, str]]:
    """id, piece, score and kind, in order of ids: four control pieces, the reserved ones from FIRST_SLOT on, 256 bytes, and the trained pieces from the most probable to the least (ties to the smaller). A reserved piece that was trained keeps its slot only."""
    rows = [(i, p, 0.0, "control") for i, p in enumerate(("<pad>", "<s>", "</s>", "<unk>"))]
    rows += [(lang.FIRST_SLOT + i, p, 0.0, "reserved") for i, p in enumerate(reserved)]
    rows += [(len(rows) + b, f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    taken = set(reserved)
    order = sorted((i for i, t in enumerate(pieces.text) if t not in taken), key=lambda i: (-pieces.score[i], pieces.text[i]))
    return rows + [(len(rows) + n, pieces.text[i], float(pieces.score[i]), "piece") for n, i in enumerate(order)]


class Encoder:
    """Texts to ids by a vocabulary: a reserved piece is its slot, any other word its best path, an unknown character its bytes."""

    def __init__(self, rows: list[tuple[int, str, float, str]]):
        self.reserved = {p: i for i, p, _, kind in rows if kind == "reserved"}
        own = [r for r in rows if r[3] == "piece"]
        self.pieces = Pieces([r[1] for r in own], np.array([r[2] for r in own]))
        of = {r[1]: r[0] for r in own}
        self.ids = [of[t] for t in self.pieces.text]
        self.bytes = next(i for i, _, _, kind in rows if kind == "byte")

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        paths, _ = best(words, self.pieces)
        out = []
        for word, path in zip(words, paths, strict=True):
            if word in self.reserved:
                out.append([self.reserved[word]])
            else:
                out.append([x for p in path for x in ([self.ids[p]] if p >= 0 else [self.bytes + b for b in chr(-1 - p).encode("utf-8", "surrogatepass")])])
        return out

    def column(self, df: DataFrame, text: str, out: str = "ids") -> DataFrame:
        """df with the ids of a text column; a null text has none. A task remembers REMEMBERED words and segments others once a batch; texts are not shuffled."""
        rows = df.withColumn("_words", pretokens(F.col(text), tuple(self.reserved)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, list[int]] = {}
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    lists = part.column(part.num_columns - 1)
                    ends = np.asarray(lists.offsets, dtype=np.int64)
                    coded = lists.flatten().dictionary_encode()
                    if len(known) > REMEMBERED:
                        known.clear()
                    words = coded.dictionary.to_pylist()
                    new = [w for w in words if w not in known]
                    known.update(zip(new, self.words(new), strict=True))
                    made = [known[w] for w in words]
                    size = np.array([len(m) for m in made] or [0], np.int64)
                    flat = np.fromiter((x for m in made for x in m), np.int32, int(size.sum()))
                    which = np.asarray(coded.indices, dtype=np.int64)
                    first = np.cumsum(size) - size
                    n = size[which] if len(which) else np.zeros(0, np.int64)
                    upto = np.concatenate(([0], np.cumsum(n)))
                    ids = flat[np.repeat(first[which], n) + np.arange(upto[-1]) - np.repeat(upto[:-1], n)] if len(which) else flat
                    stops = upto[ends - ends[0]]
                    made_lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], made_lists], [*part.schema.names[:-1], out])

        return rows.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType()))]))

    def segmented(self, words: DataFrame, word: str = "word") -> DataFrame:
        """words with `pieces`, the texts of its best path."""
        names = self.pieces.text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths, _ = best([w or "" for w in batch.column(batch.schema.get_field_index(word)).to_pylist()], self.pieces)
                texts = pa.array([[names[p] if p >= 0 else chr(-1 - p) for p in path] for path in paths], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "pieces"])

        return words.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in words.schema.fields)}, pieces array<string>")


def morpheme_cases(words: DataFrame, endings: tuple[str, ...], shortest: int = 4) -> DataFrame:
    """word, root and suffix: words (word) that are another word of the table with one of the endings. Of several endings, the longest counts."""
    known = words.select("word").distinct()
    cut = known.select("word", F.explode(F.array(*map(F.lit, endings))).alias("suffix")).filter(F.endswith("word", "suffix"))
    cut = cut.withColumn("root", F.substring(F.col("word"), F.lit(1), F.length("word") - F.length("suffix"))).filter(F.length("root") >= shortest)
    cases = cut.join(known.select(F.col("word").alias("root")), "root", "left_semi")
    return cases.groupBy("word").agg(F.max(F.struct(F.length("suffix").alias("n"), "root", "suffix")).alias("x")).select("word", "x.root", "x.suffix")
