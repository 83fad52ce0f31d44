"""N-gram Jaccard join: exact links between documents by partitioning the universe of shingles.

Sets are put in bands of size. In a band of largest size u, linked sets differ in at most U = 2u/9 shingles (for 0.8). The universe is hashed into m = U + 1 + t segments, so linked sets agree wholly on t + 1 segments at least. Allocation, by cost:

- shingles of very many sets get no weight: they are in no segment (leaving shingles out never adds difference);
- a set with at most t empty segments indexes each other segment's subset as it is; one of them must match;
- a set with more empty segments also indexes the one-deletion neighbourhood of each subset of two or more shingles. Such a subset counts 2 and a single shingle 1; among two such sets U + 1 of this weight is enough;
- sets that lack even that weight index their rarest shingles (n - ceil(0.8 n) + 1 of them), which two linked sets share.

t is the number that makes the expected index smallest. Sets equal as a whole are one class from the start. Entries travel packed, a few bytes each. Classes that share an entry are candidates of the entry's least class first; in a block, an entry of many classes sends its least class on and leaves the others as candidates of that one. A candidate pair must differ in few enough bits of the sets' parity sketches (bits that differ never outnumber shingles that differ, so this loses nothing) and is then verified by exact intersection. Components are formed, and only entries whose classes are still in different components are looked at again. Small ones give their pairs. Large ones are groups around a pivot, the class that shares most: the classes outside of a group's largest component are a query set that meets the whole group in tiles of bounded size, where exact intersections are counted as a matrix product and only links that join components leave the task. No bucket is capped, and no link between different texts is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, roots
from .shared import Tables, blocks, gram_hashes, hash_words, mix, one, signed, split_words, within

WORDS, PERCENT = 5, 80
#: A shingle in so many sets of a block is counted; one of so many counted sets in all has no weight. Any choice gives the same links.
BLOCK_SETS, FREQUENT_SETS, FREQUENT_MOST = 3, 200, 400_000
#: Text bytes that a worker counts or indexes at once: a text's shingles and entries take some 30 times its bytes.
COUNT_BYTES, INDEX_BYTES = 8_000_000, 4_000_000
#: An entry that so many classes of a block share is dealt out for one of them.
HOT_CLASSES = 8
#: An open entry of so many classes gives their pairs; a larger one is compared in tiles of so many classes and bytes of sets.
SMALL_ENTRY, TILE_ROWS, TILE_BYTES = 8, 128, 256_000
#: Bytes of packed entries that a task merges.
STAR_BYTES = 32_000_000
#: Ids or pairs up to which a side is broadcast; beyond, the same join shuffles.
BROADCAST_ROWS = 300_000


# --- sets -------------------------------------------------------------------------------------------------------------


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sets' shingles (64-bit hashes, ascending in each set), where each set begins, and each set's class (a hash of the set; 0 for the empty set)."""
    words, ends = split_words(pc.ascii_lower(text))
    h = hash_words(words)
    at, owner = within(ends, WORDS)
    token = gram_hashes(h, WORDS)[at]
    n = np.diff(ends)
    few = np.flatnonzero((n > 0) & (n < WORDS))
    whole = np.fromiter((int(gram_hashes(h[ends[i] : ends[i + 1]], int(n[i]), seed=int(n[i]))[0]) for i in few), np.uint64, len(few))
    size = np.maximum(n - WORDS + 1, 0)
    size[few] = 1
    starts = np.append(0, np.cumsum(size))
    gram = np.ones(starts[-1], bool)
    gram[starts[few]] = False
    every = np.empty(starts[-1], np.uint64)
    every[gram], every[~gram] = token, whole
    for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        every[i:j].sort()
    token, owner = every, np.repeat(np.arange(len(n)), size)
    new = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])) if len(token) else np.zeros(0, bool)
    token, owner = token[new], owner[new]
    size = np.bincount(owner, minlength=len(n)) if len(owner) else np.zeros(len(n), np.int64)
    starts = np.append(0, np.cumsum(size))
    return token, starts, _sums(mix(token), starts, size)


def _sums(x: np.ndarray, starts: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """An order-free hash of each run; 0 where it is empty."""
    total = np.append(np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))
    out = mix((total[starts[1:]] - total[starts[:-1]]) + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(np.diff(starts) > 0, out, np.uint64(0))


def sketches(token: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A parity sketch of each set: bit i tells whether an odd number of its shingles falls on i. A set has 1 to 2 bits a shingle, 64 at least; a longer sketch folds to a shorter one's length."""
    size = np.diff(starts)
    bits = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    base = np.append(0, np.cumsum(bits))
    at = np.repeat(base[:-1], size) + (mix(token ^ _space(9)) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd, bitorder="little"))])


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches differ: never more than the shingles that only one of the sets has."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows for the shingles that many sets of the block have."""
    names = ["doc_id", "n", "class", "sketch", "token", "sets"]
    for block in blocks(batches, "text", COUNT_BYTES):
        token, starts, cls = shingle_sets(one(block["text"]))
        size = np.diff(starts)
        ids = one(block["doc_id"])
        none = lambda k, t=pa.int64(): pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(signed(cls), mask=size == 0), sketches(token, starts), none(len(ids)), none(len(ids))], names)
        distinct = np.zeros(len(cls), bool)
        distinct[np.unique(cls, return_index=True)[1]] = True
        value, count = np.unique(token[np.repeat(distinct, size)], return_counts=True)
        value, count = value[count >= BLOCK_SETS], count[count >= BLOCK_SETS]
        k = len(value)
        if k:
            yield pa.RecordBatch.from_arrays([none(k), none(k), none(k), none(k, pa.binary()), pa.array(signed(value)), pa.array(count)], names)


# --- bands and allocation ---------------------------------------------------------------------------------------------


@cache
def bands() -> list[tuple[int, int, int, int]]:
    """(least size, largest size, U, m) of each band. Different sets of up to 4 shingles are never linked to each other."""
    out, low = [], 5
    while low < 1 << 40:
        high = max(low + 1, low * 3 // 2)
        u = 2 * high * (100 - PERCENT) // (100 + PERCENT)
        best = min(range(200), key=lambda t: _cost(low, u, t))
        out.append((low, high, u, u + 1 + best))
        low = high + 1
    return out


def _cost(n: int, u: int, t: int) -> float:
    """Expected entries of a set of n shingles: its segments, and its deletions as often as more than t segments are empty (about Poisson)."""
    m = u + 1 + t
    rate = m * math.exp(-n / m)
    term = upto = math.exp(-rate)
    for k in range(1, t + 1):
        term *= rate / k
        upto += term
    return m + max(0.0, 1 - upto) * (m + n)


def _space(*parts: int) -> np.uint64:
    x = 0x51ED270B
    for p in parts:
        x = (x * 0x9E3779B97F4A7C15 + p + 1) & (1 << 64) - 1
    return np.uint64(x)


def entries(token: np.ndarray, starts: np.ndarray, frequent: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index entries and the number of the set of each. frequent: ascending shingles without weight; order: their places in the order of frequency."""
    size = np.diff(starts)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.searchsorted(frequent, token) if len(frequent) else np.zeros(len(token), np.int64)
    common = (frequent[np.minimum(at, len(frequent) - 1)] == token) if len(frequent) else np.zeros(len(token), bool)
    value, rare_owner = token[~common], owner[~common]
    out_e, out_o = [], []
    short = np.zeros(len(size), bool)  # sets that lack weight in some band
    low = np.array([b[0] for b in bands()])
    own = np.searchsorted(low, size, side="right") - 1
    reach = np.searchsorted(low, size * 100 // PERCENT, side="right") - 1
    for b in np.unique(np.concatenate((own, reach))):
        if b < 0:
            continue
        _, _, u, m = bands()[b]
        here = (size > 0) & (own <= b) & (reach >= b)
        sets = np.flatnonzero(here)
        number = np.cumsum(here) - 1
        mine = here[rare_owner]
        v, o = value[mine], number[rare_owner[mine]]
        seg = o * m + (mix(v ^ _space(int(b))) % np.uint64(m)).astype(np.int64)
        by = np.argsort(seg, kind="stable")
        v, seg = mix(v + _space(7))[by], seg[by]
        begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
        which = seg[begin]
        count = np.diff(np.append(begin, len(seg)))
        total = np.add.reduceat(v, begin) if len(begin) else np.zeros(0, np.uint64)
        of, place = which // m, (which % m).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        filled = np.bincount(of, minlength=len(sets))
        sparse = m - filled > m - u - 1
        weight = np.bincount(of, weights=np.minimum(count, 2), minlength=len(sets))
        short[sets[sparse & (weight < u + 1)]] = True
        out_e.append(mix(total + place + _space(int(b), 1)))
        out_o.append(sets[of])
        d = sparse[of]
        if d.any():
            out_e.append(mix(total[d] + place[d] + _space(int(b), 2)))
            out_o.append(sets[of[d]])
            d &= count >= 2
            each = np.repeat(d, count)
            back = np.repeat(np.arange(len(begin)), count)[each]
            out_e.append(mix(total[back] - v[each] + place[back] + _space(int(b), 2)))
            out_o.append(sets[of[back]])
    if short.any():
        mine = short[owner]
        v, o = token[mine], owner[mine]
        rank = np.where(common[mine], order[np.minimum(at[mine], len(order) - 1)] + 1 if len(order) else 0, 0)
        by = np.lexsort((v, rank, o))
        v, o = v[by], o[by]
        n = size[o]
        nth = np.arange(len(o)) - np.searchsorted(o, o)
        head = nth < n - -(-n * PERCENT // 100) + 1
        out_e.append(mix(v[head] + _space(3)))
        out_o.append(o[head])
    if not out_e:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_e), np.concatenate(out_o)


PACKED = ["part", "data", "entry", "a", "b"]


def _star_rows(e: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """entry, a (the entry's least class) and each other class b, from entries and classes in any order."""
    by = np.lexsort((c, e))
    e, c = e[by], c[by]
    begin = np.append(True, e[1:] != e[:-1]) if len(e) else np.zeros(0, bool)
    new = begin | np.append(True, c[1:] != c[:-1]) if len(e) else begin
    first = c[begin][np.cumsum(begin) - 1] if len(e) else c
    other = new & ~begin
    return e[other], first[other], c[other]


def _shared(e: np.ndarray, least: int) -> np.ndarray:
    """Which entries occur `least` times at least."""
    ordered = np.sort(e)
    if len(e) < least:
        return np.zeros(len(e), bool)
    values = np.unique(ordered[least - 1 :][ordered[least - 1 :] == ordered[: len(e) - least + 1]])
    if not len(values):
        return np.zeros(len(e), bool)
    return values[np.minimum(np.searchsorted(values, e), len(values) - 1)] == e


def _star_batch(rows: tuple, part: np.ndarray | None) -> pa.RecordBatch:
    e, a, b = (pa.array(signed(np.ascontiguousarray(x)) if x.dtype == np.uint64 else x) for x in rows)
    if part is None:
        return pa.RecordBatch.from_arrays([e, a, b], PACKED[2:])
    return pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(e), pa.binary()), e, a, b], PACKED)


def pack_entries(entry: np.ndarray, cls: np.ndarray) -> bytes:
    """Entries' upper 48 bits, and classes as numbers in a list of those that occur."""
    names, number = np.unique(cls, return_inverse=True)
    wide = np.uint16 if len(names) < 1 << 16 else np.uint32
    top = np.ascontiguousarray(entry).view(np.uint8).reshape(-1, 8)[:, 2:]
    return np.array([len(entry), len(names)], np.uint32).tobytes() + names.tobytes() + number.astype(wide).tobytes() + top.tobytes()


def unpack_entries(data) -> tuple[np.ndarray, np.ndarray]:
    k, kinds = np.frombuffer(data, np.uint32, 2).tolist()
    wide = np.dtype(np.uint16 if kinds < 1 << 16 else np.uint32)
    at = 8 + 8 * kinds
    names, number = np.frombuffer(data, np.int64, kinds, 8), np.frombuffer(data, wide, k, at)
    entry = np.zeros((k, 8), np.uint8)
    entry[:, 2:] = np.frombuffer(data, np.uint8, 6 * k, at + wide.itemsize * k).reshape(k, 6)
    return entry.view(np.uint64).ravel(), names[number]


def _indexed(frequent: np.ndarray, order: np.ndarray, parts: int):
    """Packed entries for each part (dealt by the entry's lower 16 bits), and the links of entries that many classes of a block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", INDEX_BYTES):
            token, starts, cls = shingle_sets(one(block["text"]))
            keep = np.zeros(len(cls), bool)
            keep[np.unique(cls, return_index=True)[1]] = True
            size = np.diff(starts)
            keep &= size > 0
            entry, owner = entries(token[np.repeat(keep, size)], np.append(0, np.cumsum(size[keep])), frequent, order)
            part = ((entry & np.uint64(0xFFFF)) * np.uint64(parts) >> np.uint64(16)).astype(np.int32)
            # What part an entry is in goes into the bits that are not sent, so that all of its copies are equal.
            entry = (entry & ~np.uint64(0xFFFF)) | part.astype(np.uint64) & np.uint64(0xFFFF)
            c = signed(cls[keep])[owner]
            hot = _shared(entry, HOT_CLASSES)
            if hot.any():
                rows = _star_rows(entry[hot], c[hot])
                yield _star_batch(rows, (np.arange(len(rows[0])) % parts).astype(np.int32))
                e, by = np.unique(entry[hot], return_inverse=True)
                least = np.full(len(e), np.iinfo(np.int64).max)
                np.minimum.at(least, by, c[hot])
                p = (e & np.uint64(0xFFFF)).astype(np.int32)
                entry, c, part = np.append(entry[~hot], e), np.append(c[~hot], least), np.append(part[~hot], p)
            by = np.argsort(part, kind="stable")
            entry, c, part = entry[by], c[by], part[by]
            edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
            data = [pack_entries(entry[i:j], c[i:j]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            none = pa.nulls(len(data), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array(data, pa.binary()), none, none, none], PACKED)

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the classes of each entry, from a partition's packed entries; those that blocks have made pass through."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        made = batch.filter(pc.is_valid(batch.column(2)))
        if len(made):
            yield made.select(PACKED[2:])
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if data.is_valid:
                e, c = unpack_entries(data.as_buffer())
                held.append((e | np.uint64(part & 0xFFFF), c))
    if not held:
        return
    e, c = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    many = _shared(e, 2)
    e, a, b = _star_rows(e[many], c[many])
    for i in range(0, len(e), 100_000):
        yield _star_batch((e[i : i + 100_000], a[i : i + 100_000], b[i : i + 100_000]), None)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", INDEX_BYTES):
        token, starts, cls = shingle_sets(one(block["text"]))
        data = pa.Array.from_buffers(pa.binary(), len(cls), [None, pa.py_buffer((starts * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(token))])
        yield pa.RecordBatch.from_arrays([pa.array(signed(cls)), data], ["class", "tokens"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and sketches allow a link."""
    for batch in batches:
        n = np.asarray(batch.column(3)) + np.asarray(batch.column(5))
        least = np.minimum(np.asarray(batch.column(3)), np.asarray(batch.column(5)))
        good = least * (100 + PERCENT) >= n * PERCENT
        x, y = batch.column(4), batch.column(6)
        for i in np.flatnonzero(good):
            bits = differing(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64))
            good[i] = bits * (100 + PERCENT) <= int(n[i]) * (100 - PERCENT)
        yield batch.select(["a", "b", "k"]).filter(pa.array(good))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate((x, y)))
            shared = int((both[1:] == both[:-1]).sum())
            good.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def intersections(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each set of x shares with each set of y, as a product of incidence matrices."""
    sizes = np.array([len(v) for v in (*x, *y)])
    token, owner = np.concatenate((*x, *y)), np.repeat(np.arange(len(sizes)), sizes)
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    same = token[1:] == token[:-1]
    several = np.append(same, False) | np.append(False, same)
    new = np.append(True, ~same)[several]
    owner, place = owner[several], np.cumsum(new) - 1
    out = np.zeros((len(x), len(y)))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        i, j = np.searchsorted(place, (low, low + columns))
        has = np.zeros((len(sizes), columns), np.float32)
        has[owner[i:j], place[i:j] - low] = 1
        out += has[: len(x)] @ has[len(x) :].T
    return out


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two tiles of classes: links that join components, no more than make them one."""
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            x, y = x.as_py(), y.as_py()
            sets = [[np.frombuffer(r["tokens"], np.uint64) for r in side] for side in (x, y)]
            n = [np.array([len(v) for v in side], np.float64) for side in sets]
            shared = intersections(*sets)
            comp = [np.array([r["comp"] for r in side], np.int64) for side in (x, y)]
            good = 100 * shared >= PERCENT * (n[0][:, None] + n[1][None, :] - shared)
            good &= comp[0][:, None] != comp[1][None, :]
            i, j = np.nonzero(good)
            _, firsts = np.unique(np.stack((comp[0][i], comp[1][j]), axis=1), axis=0, return_index=True)
            parent: dict[int, int] = {}

            def root(c: int, parent: dict[int, int] = parent) -> int:
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            a, b = [], []
            for k in firsts.tolist():
                r, s = root(int(comp[0][i[k]])), root(int(comp[1][j[k]]))
                if r != s:
                    parent[r] = s
                    a.append(x[i[k]]["class"])
                    b.append(y[j[k]]["class"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _classes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()


def _with_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with the components ca and cb of a and b."""
    x, y = (labels.select(F.col("v").alias(f"_{s}"), F.col("c").alias(f"_c{s}")) for s in "ab")
    both = pairs.join(x, F.col("a") == F.col("_a"), "left").join(y, F.col("b") == F.col("_b"), "left")
    return both.select(*pairs.columns, F.coalesce("_ca", "a").alias("ca"), F.coalesce("_cb", "b").alias("cb"))


# --- the join ---------------------------------------------------------------------------------------------------------


class Join:
    """One run of the join over documents with doc_id and text."""

    def __init__(self, docs: DataFrame, tables: Tables):
        self.docs, self.tables, self.spark = docs.select("doc_id", "text"), tables, docs.sparkSession
        seen = tables.put(self.docs.mapInArrow(_sized, "doc_id long, n long, class long, sketch binary, token long, sets long"), "sized")
        self.sized = seen.filter("token is null").select("doc_id", "n", "class", "sketch")
        counts = seen.filter("token is not null").groupBy("token").agg(F.sum("sets").alias("sets"))
        self._repeat: bool | None = None
        self.frequent, self.order = self._frequent(tables.put(counts.filter(F.col("sets") >= FREQUENT_SETS), "frequent"))

    def _frequent(self, counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent shingles, a list of bounded length."""
        least = FREQUENT_SETS
        while counts.filter(F.col("sets") >= least).count() > FREQUENT_MOST:
            least *= 2
        rows = counts.filter(F.col("sets") >= least).select("token", "sets").toPandas()
        token = rows["token"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(token)
        order = np.empty(len(token), np.int64)
        order[np.lexsort((token, rows["sets"].to_numpy()))] = np.arange(len(token))
        return token[by], order[by]

    def small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def stars(self) -> DataFrame:
        # An entry takes some 8 bytes, and a set has about 2 for each shingle.
        shingles = self.sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        parts = min(1 << 16, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-16 * shingles // STAR_BYTES)))
        rows = self.docs.mapInArrow(_indexed(self.frequent, self.order, parts), "part int, data binary, entry long, a long, b long")
        return self.tables.put(rows.repartitionById(parts, "part").mapInArrow(_stars, "entry long, a long, b long"), "stars")

    def near(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b, k) that sizes and sketches let through."""
        sets = self.sized.join(self.small(_classes(pairs)), "class", "left_semi").groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        sets = self.tables.put(sets, f"{name}_sketches")
        x, y = (sets.select(F.col("class").alias(f"_{s}"), F.col("n").alias(f"_n{s}"), F.col("sketch").alias(f"_s{s}")) for s in "ab")
        both = pairs.join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b")).select("a", "b", "k", "_na", "_sa", "_nb", "_sb")
        found = self.tables.put(both.mapInArrow(_near, "a long, b long, k long"), name)
        self.tables.drop(f"{name}_sketches")
        return found

    def sets(self, pairs: DataFrame, name: str) -> DataFrame:
        """The sets of the classes in pairs."""
        reps = self.sized.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
        ids = self.tables.put(reps.join(self.small(_classes(pairs)), "class", "left_semi").select("doc_id"), f"{name}_needed")
        here = self.docs.join(self.small(ids), "doc_id", "left_semi").mapInArrow(_sets, "class long, tokens binary")
        here = self.tables.put(here, name)
        return here.dropDuplicates(["class"]) if self._ids_repeat() else here

    def verified(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        first = pairs.join(sets.select(F.col("class").alias("_b"), F.col("tokens").alias("_tb")), F.col("b") == F.col("_b")).select("a", "b", "_tb")
        both = first.join(sets.select(F.col("class").alias("_a"), F.col("tokens").alias("_ta")), F.col("a") == F.col("_a")).select("a", "b", "_ta", "_tb")
        # A hub's long set comes with each of its pairs; put() bounds batches by bytes, not by rows alone.
        return self.tables.put(both.mapInArrow(_verify, "a long, b long"), name)

    def labels(self) -> DataFrame:
        """v and c for each class v whose component's label c is another."""
        stars = self.stars()
        pairs = self.tables.put(stars.groupBy("a", "b").agg(F.count("*").alias("k")), "pairs")
        near = self.near(pairs, "near")
        sets = self.sets(near, "sets")
        best = near.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a")).select("a", "b")
        labels = roots(self.verified(best, sets, "links1"), self.tables, "roots")
        rest = self.apart(near.join(best, ["a", "b"], "left_anti"), labels)
        labels = self.merged(labels, self.verified(rest, sets, "links2"), "merged2")
        self.tables.drop("sets")
        rows = self.tables.put(self.open_rows(stars, labels), "open")
        few = self.small_pairs(rows).join(pairs, ["a", "b"], "left_anti").withColumn("k", F.lit(1).cast("long"))
        more = self.near(self.tables.put(few, "more"), "more_near")
        if more.limit(1).count():
            labels = self.merged(labels, self.verified(more.select("a", "b"), self.sets(more, "more_sets"), "links3"), "merged3")
            self.tables.drop("more_sets")
        groups = self.tables.put(self.pivot_groups(rows.filter(F.col("k") > SMALL_ENTRY), labels), "groups")
        if groups.limit(1).count():
            labels = self.merged(labels, self.tile_links(groups), "merged4")
            self.tables.drop("group_sets", "group_rows")
        return labels

    def merged(self, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """The labels after more links: only components that a link joins with another are walked."""
        edges = self.tables.put(self.apart(links.withColumn("k", F.lit(1)), labels, "ca", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), f"{name}_edges")
        if not edges.limit(1).count():
            return labels
        new = components(edges, self.tables, name).filter("v <> c")
        up = new.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
        return self.tables.put(labels.join(up, F.col("c") == F.col("_v"), "left").select("v", F.coalesce("_c", "c").alias("c")).unionByName(new), f"{name}_labels")

    def _ids_repeat(self) -> bool:
        if self._repeat is None:
            self._repeat = self.sized.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
        return self._repeat

    def apart(self, pairs: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
        """The pairs of classes in different components ca and cb."""
        return _with_components(pairs, labels).filter("ca <> cb").select(*(columns or ("a", "b")))

    def open_rows(self, stars: DataFrame, labels: DataFrame) -> DataFrame:
        """entry, class, comp, n and the entry's number k of classes, for entries of three or more classes that are in different components."""
        sizes = self.sized.filter("class is not null").groupBy("class").agg(F.first("n").alias("n"))
        # Entries whose classes are all in one component end here.
        several = stars.groupBy("entry").count().filter("count > 1").select("entry")
        ends = _with_components(stars.join(several, "entry", "left_semi"), labels)
        open_ = ends.groupBy("entry").agg(F.max(F.col("ca") != F.col("cb")).alias("open")).filter("open").select("entry")
        left = ends.join(open_, "entry", "left_semi")
        left = left.select("entry", F.col("a").alias("class"), F.col("ca").alias("comp")).unionByName(left.select("entry", F.col("b").alias("class"), F.col("cb").alias("comp"))).distinct()
        left = self.tables.put(left, "open_ends")
        count = left.groupBy("entry").agg(F.count("*").alias("k"))
        return left.join(count, "entry").join(sizes, "class").select("entry", "class", "comp", "n", "k")

    def small_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of classes in different components that share a small open entry: at most SMALL_ENTRY / 2 for each of its rows."""
        rows = rows.filter(F.col("k") <= SMALL_ENTRY).drop("k")
        other = rows.select("entry", F.col("class").alias("b"), F.col("comp").alias("_comp"), F.col("n").alias("_n"))
        pairs = rows.withColumnRenamed("class", "a").join(other, "entry").filter((F.col("a") < F.col("b")) & (F.col("comp") != F.col("_comp")) & (F.least("n", "_n") * 100 >= F.greatest("n", "_n") * PERCENT))
        return pairs.select("a", "b").distinct()

    def pivot_groups(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """pivot, class, comp, the numbers of its tiles (query only outside of the group's largest component) and of the group's tiles."""
        now = labels.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
        rows = rows.join(now, F.col("class") == F.col("_v"), "left").select("entry", "class", F.coalesce("_c", "class").alias("comp"), "n", "k")
        open_ = rows.groupBy("entry").agg((F.min("comp") != F.max("comp")).alias("open")).filter("open").select("entry")
        rows = self.tables.put(rows.join(open_, "entry", "left_semi"), "open_large")
        shares = rows.groupBy("class").agg(F.sum("k").alias("shares")).withColumnRenamed("class", "_class")
        pivots = rows.select("entry", "class").join(shares, F.col("class") == F.col("_class")).groupBy("entry").agg(F.max_by("class", F.struct("shares", "class")).alias("pivot"))
        members = self.tables.put(rows.join(pivots, "entry").select("pivot", "class", "comp", "n").distinct(), "members")
        comps = members.groupBy("pivot", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
        groups = comps.groupBy("pivot").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max(F.struct("rows", "comp", "n")).alias("most"))
        tiles = lambda rows, n: F.greatest(F.lit(1), F.ceil(rows / TILE_ROWS), F.ceil(n * 8 / TILE_BYTES)).cast("long")
        groups = groups.filter(F.col("rows") > F.col("most.rows")).select("pivot", F.col("most.comp").alias("_most"), tiles(F.col("rows"), F.col("n")).alias("tiles"), tiles(F.col("rows") - F.col("most.rows"), F.col("n") - F.col("most.n")).alias("_query_tiles"))
        query = F.when(F.col("comp") != F.col("_most"), F.pmod(F.xxhash64("class", F.lit(2)), "_query_tiles"))
        return members.join(groups, "pivot").select("pivot", "class", "comp", F.pmod(F.xxhash64("class", F.lit(1)), "tiles").alias("tile"), query.alias("query"), "tiles")

    def tile_links(self, groups: DataFrame) -> DataFrame:
        """Links (a, b) between the query classes of each group and all of its classes."""
        sets = self.sets(groups.select(F.col("class").alias("a"), F.col("class").alias("b")), "group_sets").withColumnRenamed("class", "_class")
        rows = self.tables.put(groups.join(sets, F.col("class") == F.col("_class")).drop("_class"), "group_rows")
        row = F.collect_list(F.struct("class", "comp", "tokens"))
        every = rows.groupBy("pivot", "tile").agg(row.alias("y"))
        query = rows.filter("query is not null").groupBy("pivot", "query").agg(row.alias("x"), F.first("tiles").alias("_tiles"))
        query = query.select(F.col("pivot").alias("_pivot"), "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)).alias("_tile"))
        both = every.join(query, (F.col("pivot") == F.col("_pivot")) & (F.col("tile") == F.col("_tile"))).select("x", "y")
        return self.tables.put(both.mapInArrow(_tile_links, "a long, b long"), "links4")

    def result(self) -> DataFrame:
        labels = self.labels()
        docs = self.sized.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
        docs = docs.join(labels, F.col("class") == F.col("v"), "left").select("class", "least", F.coalesce("c", "class").alias("comp"))
        smallest = docs.groupBy("comp").agg(F.min("least").alias("component_id"))
        names = self.tables.put(docs.join(smallest, "comp").select(F.col("class").alias("_class"), "component_id"), "names")
        out = self.sized.join(names, F.col("class") == F.col("_class"), "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row.

    Null and empty texts have no shingle and are linked with nothing. Texts of fewer than five words are one shingle. Rows of equal sets are linked; rows of one doc_id with different texts are compared each by itself, and a null doc_id is never the smallest. An empty table gives no rows. Classes are 64-bit hashes of whole sets.
    """
    return Join(docs, tables).result()


def keep_one(docs: DataFrame, tables: Tables) -> DataFrame:
    """The documents whose id is their component's, with all columns; rows that repeat such an id stay together, as do rows without one."""
    found = near_duplicates(docs, tables)
    gone = tables.put(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark))


OP10_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS shingle FROM w WHERE len(ws) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id
FROM w JOIN reach ON reach.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
