"""A back-off language model of words: interpolated Kneser-Ney trigrams, counted, scored and ranked in parts by the word in the middle.

The share of a word after two words is what its trigram keeps of its count beyond a discount, and what all discounts of that context set free goes to the word's share after the one word before it; likewise from there to the word alone, and from there to all words and one unknown word alike. Below trigrams a word counts by how many different words stand before it, not by how often it does. So the shares after any context sum up to 1 over the vocabulary and the unknown word.

A part has all trigrams of its words w2, so what a trigram, its pairs and its context need is in it. A frequent w2 is dealt over several parts by w3; sums of its contexts, and what each w3 has over all parts, are joined by Spark and sent to the parts that have such words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lang
from ..functions import text as T
from .store import tabled

#: What stands before a text, twice; no word is like it.
START = "<s>"
#: Parts of a frequent word in lookups by one word.
SALTS = 16
#: The discount where no count, or none of its double, occurs.
HALF = 0.5
#: Characters of text for which there is a part, and that a task counts at once.
PART, BLOCK = 8_000_000, 16_000_000
_WORD = re.compile(lang.WORD_B)
_PACKED = "part int, n int, size int, words binary, codes binary"


@dataclass(frozen=True)
class Parts:
    """How trigrams are dealt: by w2 over n parts; a word of `salts` over so many of them by w3."""

    n: int
    salts: dict[str, int]

    def of(self, words: pa.Array, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
        text = words.to_pylist()
        h = np.array([crc32(w.encode()) for w in text], np.int64)
        salts = np.array([self.salts.get(w, 1) for w in text], np.int64)
        return (h[w2] + h[w3] % salts[w2]) % self.n


@dataclass(frozen=True)
class Model:
    """Trigrams with their counts, a row a part (three: _PACKED); words and contexts of dealt words in the parts that have them (two: part, key, n, k), with what all parts have of them; the same once each: of contexts (pairs: w1, w2, n, k), of dealt words (words: w2, n, k) and of each word, its share (one: w3, p1) and that of an unknown word (p0); the discounts, and how trigrams are dealt."""

    three: DataFrame
    two: DataFrame
    pairs: DataFrame
    words: DataFrame
    one: DataFrame
    p0: float
    d3: float
    d2: float
    d1: float
    total: int
    parts: Parts


def trigram_counts(docs: DataFrame) -> DataFrame:
    """w1, w2, w3 and cnt: each word of each text with the two before it."""
    t = docs.select(F.transform(T.matches(F.col("text"), lang.WORD_B), F.lower).alias("t"))
    t = t.select(F.size("t").alias("n"), F.concat(F.array(F.lit(START), F.lit(START)), "t").alias("t")).filter("n > 0")
    z = F.arrays_zip(*[F.slice("t", F.lit(i), F.col("n")).alias(f"w{i}") for i in (1, 2, 3)])
    # One text a row is less to shuffle than three; words hold no space.
    counts = t.select(F.explode(F.transform(z, lambda x: F.concat_ws(" ", x["w1"], x["w2"], x["w3"]))).alias("_k")).groupBy("_k").agg(F.count("*").alias("cnt"))
    return counts.select(F.substring_index("_k", " ", 1).alias("w1"), F.substring_index(F.substring_index("_k", " ", 2), " ", -1).alias("w2"), F.substring_index("_k", " ", -1).alias("w3"), "cnt")


# --- counting -----------------------------------------------------------------------------------------------------------


def word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Distinct words of about BLOCK characters of texts, the number of each word in order, and where texts begin."""

    def block() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        return coded.dictionary.cast(pa.string()), np.asarray(coded.indices, np.int64), np.asarray(lists.offsets, np.int64)[:-1]

    texts, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if found := _WORD.findall(text or ""):
                texts.append(" ".join(found).lower())
                size += len(texts[-1])
                if size >= BLOCK:
                    yield block()
                    texts, size = [], 0
    if texts:
        yield block()


def _frequent(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, codes, starts in word_blocks(batches):
            share = np.bincount(codes, minlength=len(words)) / len(codes)
            many = np.flatnonzero(share * parts > 1)
            yield pa.RecordBatch.from_arrays([pa.array([START, *words.take(pa.array(many)).to_pylist()]), pa.array(np.append(len(starts) / len(codes), share[many]))], ["word", "share"])

    return run


def dealt(docs: DataFrame) -> Parts:
    """Parts for the texts: a word that a block has more often than a part's share is dealt over as many parts as that needs. Only these words, fewer than parts for a block, come to the driver."""
    n = max(1, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // PART))
    if n == 1:
        return Parts(1, {})
    most = docs.select("text").mapInArrow(_frequent(n), "word string, share double").groupBy("word").agg(F.max("share").alias("share")).filter(F.col("share") * n > 1).collect()
    return Parts(n, {r.word: min(n, int(np.ceil(r.share * n))) for r in most})


def _unique(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, cnt: np.ndarray | None, kinds: int) -> tuple[np.ndarray, ...]:
    """Each trigram once with its count, in order of w2, w3, w1."""
    pairs, at = np.unique(w2 * kinds + w3, return_inverse=True)
    keys, at = np.unique(at * kinds + w1, return_inverse=True)
    pair = pairs[keys // kinds]
    return keys % kinds, pair // kinds, pair % kinds, np.bincount(at, cnt, len(keys)).astype(np.int64)


def _packed(part: int, words: pa.Array, columns: tuple[np.ndarray, ...]) -> tuple:
    """A row of _PACKED: the words in order and the numbers by their bytes, both compressed."""
    used = np.unique(np.concatenate(columns[:3]))
    text = words.take(pa.array(used))
    order = np.asarray(pc.sort_indices(text))
    rank = np.empty(len(used), np.int64)
    rank[order] = np.arange(len(used))
    w1, w2, w3 = (rank[np.searchsorted(used, x)] for x in columns[:3])
    by = np.lexsort((w1, w3, w2))
    # Pairs are in order: most steps from one to the next are 0 or small.
    pair = np.diff((w2 * len(used) + w3)[by], prepend=0)
    flat = np.concatenate([w1[by], pair, columns[3][by]]).astype("<i8").view(np.uint8).reshape(-1, 8).T
    raw = "\n".join(text.take(pa.array(order)).to_pylist()).encode()
    return part, len(by), len(raw), pa.compress(raw, "zstd", asbytes=True), pa.compress(np.ascontiguousarray(flat).tobytes(), "zstd", asbytes=True)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "n", "size", "words", "codes"])


def _unpacked(rows: pa.Table | pa.RecordBatch) -> tuple[pa.Array, tuple[np.ndarray, ...]]:
    """All words and trigrams (w1, w2, w3, cnt) of rows of _PACKED; words in order, trigrams in order if there is one row."""
    texts, columns, at = [], [], 0
    for r in rows.select(["n", "size", "words", "codes"]).to_pylist():
        words = pa.decompress(r["words"], r["size"], "zstd", asbytes=True).decode().split("\n")
        flat = np.frombuffer(pa.decompress(r["codes"], 24 * r["n"], "zstd", asbytes=True), np.uint8).reshape(8, -1)
        w1, pair, cnt = np.ascontiguousarray(flat.T).view("<i8").reshape(3, -1)
        w2, w3 = np.divmod(np.cumsum(pair), len(words))
        columns.append(np.stack([w1 + at, w2 + at, w3 + at, cnt]))
        texts.append(pa.array(words, pa.string()))
        at += len(words)
    if len(texts) == 1:
        return texts[0], tuple(columns[0])
    coded = pa.chunked_array(texts).combine_chunks().dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[np.asarray(coded.indices)]
    four = np.concatenate(columns, axis=1)
    return coded.dictionary.take(pa.array(order)), (code[four[0]], code[four[1]], code[four[2]], four[3])


def _split(parts: Parts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, w3, starts in word_blocks(batches):
            first = len(words)
            words = pa.concat_arrays([words, pa.array([START])])
            w2, w1 = np.roll(w3, 1), np.roll(w3, 2)
            w2[starts] = w1[starts] = first
            more = starts + 1
            w1[more[np.isin(more, starts, invert=True) & (more < len(w3))]] = first
            columns = _unique(w1, w2, w3, None, len(words))
            part = parts.of(words, columns[1], columns[2])
            order = np.argsort(part, kind="stable")
            ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
            begin = 0
            for at in range(0, len(ends), 64):
                rows = []
                for end in ends[at : at + 64].tolist():
                    mine = order[begin:end]
                    rows.append(_packed(int(part[mine[0]]), words, tuple(c[mine] for c in columns)))
                    begin = end
                yield _rows(rows)

    return run


def _merged(rows: pa.Table) -> pa.Table:
    words, columns = _unpacked(rows)
    return pa.Table.from_batches([_rows([_packed(rows["part"][0].as_py(), words, _unique(*columns, len(words)))])])


class _Part:
    """A part's trigrams, pairs (w2, w3), words w2 and contexts (w1, w2), each in order, and which of these a trigram or a pair has. What lies in other parts too is put in by learn()."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, parts: Parts):
        self.words, (self.w1, self.w2, self.w3, self.cnt) = _unpacked(rows)
        self.kinds = len(self.words)
        text = self.words.to_pylist()
        self.spread = np.array([w in parts.salts for w in text], bool)
        self.pair, self.of_pair = np.unique(self.w2 * self.kinds + self.w3, return_inverse=True)
        self.p2, self.p3 = self.pair // self.kinds, self.pair % self.kinds
        counts = np.bincount(self.of_pair)
        # What begins a text has no word before it to count: here, how often it does.
        begins = np.array([w == START for w in text], bool)[self.p2]
        self.c = np.where(begins, np.bincount(self.of_pair, self.cnt).astype(np.int64), counts)
        self.word, self.of_word = np.unique(self.p2, return_inverse=True)
        self.n2, self.k2 = np.bincount(self.of_word, self.c), np.bincount(self.of_word)
        self.context, self.of_context = np.unique(self.w1 * self.kinds + self.w2, return_inverse=True)
        self.c1, self.c2 = self.context // self.kinds, self.context % self.kinds
        self.n3, self.k3 = np.bincount(self.of_context, self.cnt), np.bincount(self.of_context)

    def text(self, codes: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(codes))

    def keys(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Sums that other parts add to: of each w3, of contexts and words that are dealt, and how many trigrams and pairs have counts of 1 and 2."""
        thirds, in_pairs = np.unique(self.p3, return_counts=True)
        far, spread = np.flatnonzero(self.spread[self.c2]), np.flatnonzero(self.spread[self.word])
        keys = [self.text(thirds), self._pair_keys(far), pc.binary_join_element_wise(pa.scalar(""), self.text(self.word[spread]), " "), pa.array(["\t3", "\t2"])]
        tally = lambda x: [np.count_nonzero(self.cnt == x), np.count_nonzero(self.c == x)]
        return pa.concat_arrays(keys), np.concatenate([in_pairs, self.n3[far], self.n2[spread], tally(1)]).astype(np.int64), np.concatenate([np.zeros(len(thirds)), self.k3[far], self.k2[spread], tally(2)]).astype(np.int64)

    def _pair_keys(self, at: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(self.text(self.c1[at]), self.text(self.c2[at]), " ")

    def learn(self, keys: pa.Array, n: np.ndarray, k: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """Puts in what the keys sum up to in all parts; gives the share p1 of each word as a w3."""
        got = lambda asked: np.asarray(pc.index_in(asked, value_set=keys))
        far, spread = np.flatnonzero(self.spread[self.c2]), np.flatnonzero(self.spread[self.word])
        at = got(self._pair_keys(far))
        self.n3[far], self.k3[far] = n[at], k[at]
        at = got(pc.binary_join_element_wise(pa.scalar(""), self.text(self.word[spread]), " "))
        self.n2[spread], self.k2[spread] = n[at], k[at]
        thirds = np.unique(self.p3)
        out = np.zeros(self.kinds)
        out[thirds] = p1[got(self.text(thirds))]
        return out


def model(docs: DataFrame) -> Model:
    """The model of the texts; null and empty ones hold no word. Only discounts, totals and words that are dealt come to the driver."""
    parts = dealt(docs)
    three = tabled(docs.select("text").mapInArrow(_split(parts), _PACKED).groupBy("part").applyInArrow(_merged, _PACKED))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys, n, k = _Part(batch.slice(i, 1), parts).keys()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), batch.column(0)[i].as_py(), np.int32)), keys, pa.array(n), pa.array(k)], ["part", "key", "n", "k"])

    # A key's sums know the parts to go back to, so that what parts have goes to the sums once and back once.
    totals = tabled(three.mapInArrow(sums, "part int, key string, n bigint, k bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.collect_list("part").alias("parts")).sortWithinPartitions("key"))
    one = totals.filter(~F.col("key").rlike("[ \t]"))
    total, kinds, n1, n2 = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    tally = {r.key: (r.n, r.k) for r in totals.filter("key in ('\t3', '\t2')").collect()}
    discount = lambda a=0, b=0: a / (a + 2.0 * b) if a and b else HALF
    d1 = discount(n1, n2)
    p0 = d1 * kinds / total / (kinds + 1) if total else 1.0
    p1 = (F.col("n") - d1) / F.lit(total) + F.lit(p0)
    cut = lambda i: F.substring_index("key", " ", i)
    pairs = totals.filter(F.col("key").contains(" ") & ~F.startswith("key", F.lit(" "))).select(cut(1).alias("w1"), cut(-1).alias("w2"), "n", "k")
    words = totals.filter(F.startswith("key", F.lit(" "))).select(cut(-1).alias("w2"), "n", "k")
    two = totals.select(F.explode("parts").alias("part"), "key", "n", "k")
    return Model(three, two, pairs, words, one.select(F.col("key").alias("w3"), p1.alias("p1")), p0, discount(*tally.get("\t3", ())), discount(*tally.get("\t2", ())), d1, total, parts)


# --- scoring ------------------------------------------------------------------------------------------------------------


def merged(table: DataFrame) -> DataFrame:
    """table as a side of a join that is not sent to all tasks through the driver: what comes out of texts, or of a compressed table, is many times the size that Spark expects of it."""
    return table.hint("merge")


def _looked_up(rows: DataFrame, table: DataFrame, key: str, parts: Parts) -> DataFrame:
    """rows with what a table of words has of the word in `key`, if anything. Rows of words that are dealt over parts go to SALTS places by all their words, and only these words of the table are repeated as often."""
    words = [c for c in ("w1", "w2", "w3") if c in rows.columns]
    dealt = F.col(key).isin(*parts.salts)
    salted = rows.withColumn("_salt", F.when(dealt, F.pmod(F.xxhash64(*words), F.lit(SALTS))).otherwise(0).cast("int"))
    return salted.join(merged(table.withColumn("_salt", F.explode(F.when(dealt, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))), [key, "_salt"], "left").drop("_salt")


def _find(keys: np.ndarray, asked: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The place of each asked key among the keys, which are in order, or -1; also where it is not ok."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(ok & (keys[at] == asked), at, -1)


def _taken(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """values at places, null at -1."""
    return pa.array(values[at] if len(values) else np.zeros(len(at), np.int64), pa.int64(), mask=at < 0)


def shares(asked: DataFrame, m: Model) -> DataFrame:
    """w1, w2, w3 and p of each of the trigrams asked for, once. A word that the texts lack has the unknown word's share."""
    parts, sums = m.parts, {r.w2: (r.n, r.k) for r in m.words.collect()}

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [batch.column(i).dictionary_encode() for i in (1, 2)]
            words = pa.concat_arrays([x.dictionary for x in coded])
            w2, w3 = (np.asarray(x.indices, np.int64) for x in coded)
            part = parts.of(words, w2, w3 + len(coded[0].dictionary))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["w1", "w2", "w3", "part"])

    def found(asked: pa.Table, rows: pa.Table) -> pa.Table:
        p = _Part(rows, parts) if rows.num_rows else None
        texts = [asked[f"w{i}"].combine_chunks() for i in (1, 2, 3)]
        none = np.full(asked.num_rows, -1)
        tri = pair = context = word = none
        if p:
            a, b, c = (np.asarray(pc.fill_null(pc.index_in(t, value_set=p.words), -1), np.int64) for t in texts)
            pair = _find(p.pair, b * p.kinds + c, (b >= 0) & (c >= 0))
            tri = _find(p.of_pair * p.kinds + p.w1, pair * p.kinds + a, (pair >= 0) & (a >= 0))
            here = (b >= 0) & ~p.spread[b]
            context = _find(p.context, a * p.kinds + b, here & (a >= 0))
            word = _find(p.word, b, here)
        out = [_taken(v, at) for v, at in ((p.cnt, tri), (p.c, pair), (p.n3, context), (p.k3, context), (p.n2, word), (p.k2, word))] if p else [pa.nulls(len(none), pa.int64())] * 6
        if sums:
            coded = texts[1].dictionary_encode()
            for at in (0, 1):
                far = pa.array([sums.get(w, (None, None))[at] for w in coded.dictionary.to_pylist()], pa.int64())
                out[4 + at] = pc.coalesce(far.take(coded.indices), out[4 + at])
        return pa.table([*texts, *out], ["w1", "w2", "w3", "cnt", "c", "n3", "k3", "n2", "k2"])

    rows = asked.select("w1", "w2", "w3").distinct().mapInArrow(sent, "w1 string, w2 string, w3 string, part int")
    j = rows.groupBy("part").cogroup(m.three.groupBy("part")).applyInArrow(found, "w1 string, w2 string, w3 string, cnt bigint, c bigint, n3 bigint, k3 bigint, n2 bigint, k2 bigint")
    j = _looked_up(j, m.one, "w3", parts)
    if sums:
        j = j.join(merged(m.pairs.select("w1", "w2", F.col("n").alias("_n"), F.col("k").alias("_k"))), ["w1", "w2"], "left").withColumns({"n3": F.coalesce("n3", "_n"), "k3": F.coalesce("k3", "_k")})
    rung = lambda c, d, n, k, below: F.coalesce((F.col(c) - d) / F.col(n), F.lit(0.0)) + F.coalesce(F.lit(d) * F.col(k) / F.col(n), F.lit(1.0)) * below
    p2 = rung("c", m.d2, "n2", "k2", F.coalesce("p1", F.lit(m.p0)))
    return j.select("w1", "w2", "w3", rung("cnt", m.d3, "n3", "k3", p2).alias("p"))


def with_loss(steps: DataFrame, m: Model) -> DataFrame:
    """Adds lp, the logarithm of the share of `word` after prev2 and prev. Each trigram is scored once, however often it stands in steps."""
    named = steps.select("*", F.col("prev2").alias("_1"), F.col("prev").alias("_2"), F.col("word").alias("_3"))
    p = shares(named.select(F.col("_1").alias("w1"), F.col("_2").alias("w2"), F.col("_3").alias("w3")), m).select(F.col("w1").alias("_1"), F.col("w2").alias("_2"), F.col("w3").alias("_3"), F.log("p").alias("lp"))
    return named.join(merged(p), ["_1", "_2", "_3"]).select(*steps.columns, "lp")


def to_parts(parts: Parts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the word w2 as their second column, for each of the parts that it is dealt over: adds part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            to = [sorted({(crc32(w.encode()) + i) % parts.n for i in range(parts.salts.get(w, 1))}) for w in coded.dictionary.to_pylist()]
            to = [to[i] for i in coded.indices.to_pylist()]
            rows = np.repeat(np.arange(len(to)), [len(x) for x in to])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array([x for own in to for x in own], pa.int32())], [*batch.schema.names, "part"])

    return run


@dataclass(frozen=True)
class _Numbers:
    """The discounts of a model, for tasks."""

    d3: float
    d2: float
    d1: float
    total: int
    p0: float


def _scored(p: _Part, known: pa.Table, m: _Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shares of a part's trigrams and pairs, and what its contexts and words let go on to the rung below."""
    n = known["n"].to_numpy()
    p1 = p.learn(known["key"].combine_chunks(), n, known["k"].to_numpy(), (n - m.d1) / m.total + m.p0)
    g2, g3 = m.d2 * p.k2 / p.n2, m.d3 * p.k3 / p.n3
    p2 = (p.c - m.d2) / p.n2[p.of_word] + g2[p.of_word] * p1[p.p3]
    return (p.cnt - m.d3) / p.n3[p.of_context] + g3[p.of_context] * p2[p.of_pair], p2, g3, g2


def all_shares(m: Model) -> DataFrame:
    """w1, w2, w3 and p of all trigrams of the texts."""
    numbers, parts = _Numbers(m.d3, m.d2, m.d1, m.total, m.p0), m.parts

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        p = _Part(rows, parts)
        return pa.table([p.text(p.w1), p.text(p.w2), p.text(p.w3), pa.array(_scored(p, known, numbers)[0])], ["w1", "w2", "w3", "p"])

    return m.three.groupBy("part").cogroup(m.two.groupBy("part")).applyInArrow(run, "w1 string, w2 string, w3 string, p double")


def _best(p: _Part, group: np.ndarray, share: np.ndarray, w3: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array]:
    """Of the groups asked for, in order, the k greatest shares (negative) and their words."""
    mine = np.flatnonzero(np.isin(group, asked))
    mine = mine[np.lexsort((w3[mine], -share[mine], group[mine]))]
    kinds, first, n = np.unique(group[mine], return_index=True, return_counts=True)
    mine = mine[np.arange(len(mine)) - np.repeat(first, n) < k]
    upto = np.concatenate(([0], np.cumsum(np.minimum(n, k)))).astype(np.int32)
    return kinds, pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([pa.array(-share[mine]), p.text(w3[mine])], ["p", "w"]))


def best_words(contexts: DataFrame, m: Model, k: int = 5) -> DataFrame:
    """prev2, prev and topk: the k words of the greatest shares after each context, ties in order.

    Candidates are the words seen after the context and the k best of the rung below. That is enough: any other word has k words of the rung below before it, and what the rung above adds to these is not negative. A part ranks what it has seen and answers for its words; only what several parts have seen of a dealt word is put together after.
    """
    heads = m.one.orderBy(F.desc("p1"), "w3").limit(k).collect()
    if not heads:
        return contexts.select("prev2", "prev", F.lit(None).cast("array<string>").alias("topk")).limit(0)
    # Like keys and like answers stand together in what is shuffled and written, which makes it small.
    asked = tabled(contexts.select(F.col("prev2").alias("w1"), F.col("prev").alias("w2")).distinct().sortWithinPartitions("w2", "w1"))
    numbers, parts = _Numbers(m.d3, m.d2, m.d1, m.total, m.p0), m.parts

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).to_pylist()
            to = [sorted({(crc32(w.encode()) + i) % parts.n for i in range(parts.salts.get(w, 1))}) for w in words]
            rows = np.repeat(np.arange(len(to)), [len(t) for t in to])
            yield pa.RecordBatch.from_arrays([pa.array([x for t in to for x in t], pa.int32()), pc.binary_join_element_wise(batch.column(0), batch.column(1), " ").take(pa.array(rows))], ["part", "key"])

    tops = pa.list_(pa.struct([("p", pa.float64()), ("w", pa.string())]))
    schema = pa.schema([("w1", pa.string()), ("w2", pa.string()), ("g3", pa.float64()), ("own", tops), ("g2", pa.float64()), ("second", tops)])

    def ranked(rows: pa.Table, known: pa.Table) -> pa.Table:
        """What the part has seen after the contexts asked for, and after their words. A context that it has not seen has a row without, where its word is at home; words that are dealt have rows of their own."""
        asks = known.filter(pc.is_null(known["n"]))
        ask = asks["key"].combine_chunks()
        if not len(ask):
            return schema.empty_table()
        halves = pc.split_pattern(ask, " ").flatten()
        first, coded = halves.take(pa.array(np.arange(0, len(halves), 2))), halves.take(pa.array(np.arange(1, len(halves), 2))).dictionary_encode()
        kinds, of = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        home = np.array([crc32(w.encode()) % parts.n for w in kinds])[of] == asks["part"][0].as_py()
        spread = np.array([w in parts.salts for w in kinds])
        none = pa.nulls(len(ask), pa.int64())
        context = word = none
        g3 = g2 = pa.nulls(0, pa.float64())
        own = second = pa.nulls(0, tops)
        if rows.num_rows:
            p = _Part(rows, parts)
            p3, p2, on3, on2 = _scored(p, known.filter(pc.is_valid(known["n"])), numbers)
            a, b = (np.asarray(pc.fill_null(pc.index_in(x, value_set=p.words), -1), np.int64) for x in (first, coded.dictionary))
            b = b[of]
            at = _find(p.context, a * p.kinds + b, (a >= 0) & (b >= 0))
            seen, own = _best(p, p.of_context, p3, p.w3, np.unique(at[at >= 0]), k)
            context, g3 = _taken(np.arange(len(seen)), _find(seen, at, at >= 0)), pa.array(on3[seen])
            at = _find(p.word, b, b >= 0)
            seen, second = _best(p, p.of_word, p2, p.p3, np.unique(at[at >= 0]), k)
            word, g2 = _taken(np.arange(len(seen)), _find(seen, at, at >= 0)), pa.array(on2[seen])
        said = np.flatnonzero(home | np.asarray(pc.is_valid(context)))
        alone = pc.if_else(pa.array(spread[of]), pa.scalar(None, pa.int64()), word)
        once = np.unique(of, return_index=True)[1]
        once = once[spread & np.asarray(pc.is_valid(word.take(pa.array(once))))]
        last = coded.dictionary.take(coded.indices)
        out = []
        for at, w1, c, w in ((said, first, context, alone), (once, pa.nulls(len(ask), pa.string()), none, word)):
            rows_at = pa.array(at)
            c, w = c.take(rows_at), w.take(rows_at)
            out.append(pa.Table.from_arrays([w1.take(rows_at), last.take(rows_at), g3.take(c), own.take(c), g2.take(w), second.take(w)], schema=schema))
        return pa.concat_tables(out)

    def best(own, g, below):
        new = F.transform(F.filter(below, lambda x: ~F.exists(own, lambda y: y["w"] == x["w"])), lambda x: F.struct((g * x["p"]).alias("p"), x["w"].alias("w")))
        return F.slice(F.array_sort(F.concat(own, new)), 1, k)

    first = F.array(*[F.struct(F.lit(-h.p1).alias("p"), F.lit(h.w3).alias("w")) for h in heads])
    own = F.coalesce("own", F.array().cast("array<struct<p:double,w:string>>"))
    below = F.coalesce(best(F.col("second"), F.col("g2"), first), first)
    topk = lambda own, below: best(own, F.coalesce("g3", F.lit(1.0)), below)["w"].alias("topk")
    named = [F.col("w1").alias("prev2"), F.col("w2").alias("prev")]
    ask = asked.mapInArrow(sent, "part int, key string")
    known = m.two.unionByName(ask, allowMissingColumns=True)
    found = m.three.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(ranked, "w1 string, w2 string, g3 double, own array<struct<p:double,w:string>>, g2 double, second array<struct<p:double,w:string>>")
    dealt = F.col("w2").isin(*parts.salts)
    found = tabled(found.select("*", F.when(~dealt, topk(own, below)).alias("topk")).select("w1", "w2", "topk", *[F.when(dealt, F.col(c)).alias(c) for c in ("g3", "own", "g2", "second")]))
    answers = found.filter("topk is not null").select(*named, "topk")
    if not parts.salts:
        return answers
    # A row a dealt word at most, and these are known to the driver.
    seconds = found.filter("w1 is null").groupBy("w2").agg(F.max("g2").alias("g2"), F.slice(F.array_sort(F.flatten(F.collect_list("second"))), 1, k).alias("second")).select("w2", below.alias("below"))
    own = found.filter("w1 is not null and topk is null").groupBy("w1", "w2").agg(F.max("g3").alias("g3"), F.slice(F.array_sort(F.flatten(F.collect_list(own))), 1, k).alias("own"))
    together = own.join(F.broadcast(seconds), "w2", "left").select(*named, topk(F.col("own"), F.coalesce("below", first)))
    return answers.unionByName(together)


#: Contexts by candidates that are looked up at once.
LOOKED_UP = 1 << 21


def scored_candidates(asks: DataFrame, m: Model) -> DataFrame:
    """What parts say of candidates after contexts. asks: part, contexts (an array of prev2, prev and typed), words (candidates, on lines), costs, and first, the shares of the first of these. For each context: prev2, prev, typed, what it and its word let go on to the rung below (g3, g2; null where the part has not seen them), the candidates that follow prev in the part (seen: word, cost, p, and tri where p is the share after both words; without, it is that after prev alone), and first, with their words and costs."""
    numbers, parts = _Numbers(m.d3, m.d2, m.d1, m.total, m.p0), m.parts
    text, real = pa.string(), pa.float64()
    one, some = pa.struct([("word", text), ("cost", real), ("p", real)]), pa.struct([("word", text), ("cost", real), ("p", real), ("tri", pa.bool_())])
    schema = pa.schema([("prev2", text), ("prev", text), ("typed", text), ("g3", real), ("g2", real), ("seen", pa.list_(some)), ("first", pa.list_(one))])

    def judged(rows: pa.Table, known: pa.Table) -> pa.Table:
        ask = known.filter(pc.is_valid(known["contexts"])).combine_chunks()
        if not ask.num_rows:
            return schema.empty_table()
        p = _Part(rows, parts) if rows.num_rows else None
        if p:
            p3, p2, on3, on2 = _scored(p, known.filter(pc.is_valid(known["n"])), numbers)
            keys = p.of_pair * p.kinds + p.w1
        code = lambda x: np.asarray(pc.fill_null(pc.index_in(x, value_set=p.words), -1), np.int64)
        column = lambda name: ask[name].combine_chunks() if isinstance(ask[name], pa.ChunkedArray) else ask[name]
        lists, costs, leads = column("contexts"), column("costs"), column("first")
        # Each context is a row from here on.
        n_contexts, n_words, n_first = (np.asarray(pc.list_value_length(x), np.int64) for x in (lists, costs, leads))
        prev2, prev, typed = (pc.struct_field(lists.flatten(), [i]) for i in range(3))
        words, costs, shares = pc.split_pattern(column("words"), "\n").flatten(), costs.flatten(), leads.flatten()
        of = np.repeat(np.arange(len(n_contexts)), n_contexts)
        begin = np.cumsum(n_words) - n_words
        at_first = pa.array(np.repeat(begin - (np.cumsum(n_first) - n_first), n_first) + np.arange(n_first.sum()))
        own = pa.StructArray.from_arrays([words.take(at_first), costs.take(at_first), shares], fields=list(one))
        first = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_first))), pa.int32()), own).take(pa.array(of))
        if not p:
            nothing = pa.array([[]] * len(of), pa.list_(some))
            return pa.Table.from_arrays([prev2, prev, typed, pa.nulls(len(of), real), pa.nulls(len(of), real), nothing, first], schema=schema)
        a, b, c = code(prev2), code(prev), code(words)
        thirds = np.zeros(p.kinds, bool)
        thirds[p.p3] = True
        # Candidates that follow no word here need not be looked up.
        there = np.flatnonzero((c >= 0) & thirds[c])
        upto = np.searchsorted(there, np.append(begin, len(c)))
        many = np.where(b >= 0, np.diff(upto)[of], 0)
        context, word = _find(p.context, a * p.kinds + b, (a >= 0) & (b >= 0)), _find(p.word, b, b >= 0)
        stops, hits = np.cumsum(many), []
        lo = 0
        while lo < len(of):
            hi = max(lo + 1, int(np.searchsorted(stops, stops[lo] - many[lo] + LOOKED_UP, "right")))
            row = np.repeat(np.arange(lo, hi), many[lo:hi])
            nth = np.arange(len(row)) - np.repeat(stops[lo:hi] - many[lo:hi] - (stops[lo] - many[lo]), many[lo:hi])
            candidate = there[upto[of[row]] + nth]
            # In order, keys are found several times as fast; what is found goes back in order of contexts.
            asked = b[row] * p.kinds + c[candidate]
            order = np.argsort(asked)
            pair = _find(p.pair, asked[order], np.ones(len(row), bool))
            hit = np.flatnonzero(pair >= 0)
            hit, pair = order[hit], pair[hit]
            order = np.argsort(hit)
            row, candidate, pair = row[hit[order]], candidate[hit[order]], pair[order]
            tri = _find(keys, pair * p.kinds + a[row], a[row] >= 0)
            hits.append((row, candidate, np.where(tri >= 0, p3[tri], p2[pair]), tri >= 0))
            lo = hi
        row, candidate, share, tri = (np.concatenate(x) for x in zip(*hits, strict=True))
        candidate = pa.array(candidate)
        found = pa.StructArray.from_arrays([words.take(candidate), costs.take(candidate), pa.array(share), pa.array(tri)], fields=list(some))
        seen = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(of) + 1)), pa.int32()), found)
        go = lambda on, at: pa.array(on[at], real, mask=at < 0)
        return pa.Table.from_arrays([prev2, prev, typed, go(on3, context), go(on2, word), seen, first], schema=schema)

    known = m.two.unionByName(asks, allowMissingColumns=True)
    kinds = "prev2 string, prev string, typed string, g3 double, g2 double, seen array<struct<word:string,cost:double,p:double,tri:boolean>>, first array<struct<word:string,cost:double,p:double>>"
    return m.three.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(judged, kinds)
