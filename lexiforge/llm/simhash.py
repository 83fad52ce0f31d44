"""SimHash near-dedup by pivot distance tables.

A text's fingerprint has the bits that are set in more than half of its shingles' hashes. Equal fingerprints are one class, so copies cost nothing more. Each distinct fingerprint gets a row of a distance table: its Hamming distances to REFERENCES. Two fingerprints within LIMIT bits differ by LIMIT at most in each coordinate, so pairs with a larger difference in any are discarded, and survivors are verified.

The references serve to find pairs as well. 64 of them are the base reference with a few bits of one 4-bit group flipped, four for each group, so that the coordinates of a group together tell its bits. The 16 groups make four blocks, and fingerprints within two bits agree on all coordinates of two blocks at least. Each fingerprint therefore goes to six buckets, by its coordinates in two of the blocks. A bucket of more than CROWD fingerprints is not compared: its members go to six finer buckets each, by two of four parts of the groups that they need not agree on yet, and once more if need be. After three levels a bucket's members differ in two groups alone, so 256 of them are all that can be. The other references are random and only discard.

A bucket of up to CROWD fingerprints is compared in one task, in blocks of pairs; only a star for each of its components leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Tables, blocks, mix, one, release, signed, split_words

#: Words of a shingle; bits that linked fingerprints may differ by; fingerprints that a bucket compares.
SHINGLE, LIMIT, CROWD = 3, 2, 256
#: Text bytes that a worker hashes at once, shingles whose bits it counts at once, pairs that it compares at once.
HASH_BYTES, COUNT_AT_ONCE, PAIRS = 6_000_000, 1 << 17, 1 << 19
#: Groups of four bits, and which of them each level has agreed on and splits into four.
GROUPS, LEVELS = 16, 3
MASKS = (0b1111, 0b1010, 0b1100, 0b1001)
BASE = 0x9E3779B97F4A7C15
FLIPPED = np.array([BASE ^ (m << (4 * g)) for g in range(GROUPS) for m in MASKS], np.uint64)
REFERENCES = np.concatenate((np.array([BASE], np.uint64), mix(np.arange(1, 32, dtype=np.uint64)), FLIPPED))
_CHOICES = list(combinations(range(4), 2))

# The primes and the seed of the 64-bit hash that fingerprints are made of.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
SEED = 42


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each slice of a byte array. Slices of one length are hashed together, those of 32 bytes and more by the library."""
    out = np.empty(len(start), np.uint64)
    padded = np.concatenate((buffer, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(buffer) + 1,), "<u8", padded, 0, (1,))
    fours = np.ndarray((len(buffer) + 1,), "<u4", padded, 0, (1,))
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    raw = memoryview(buffer)
    for size, a, b in zip(sizes.tolist(), first, [*first[1:], len(order)], strict=True):
        rows = order[a:b]
        if size >= 32:
            at = start[rows].tolist()
            out[rows] = np.fromiter((xxhash.xxh64_intdigest(raw[s : s + size], SEED) for s in at), np.uint64, len(at))
            continue
        at = start[rows]
        h = np.full(len(rows), np.uint64(SEED + int(P5) + size & (1 << 64) - 1))
        done = 0
        while done + 8 <= size:
            h = _turned(h ^ (_turned(eights[at + done] * P2, 31) * P1), 27) * P1 + P4
            done += 8
        if done + 4 <= size:
            h = _turned(h ^ (fours[at + done].astype(np.uint64) * P1), 23) * P2 + P3
            done += 4
        for j in range(done, size):
            h = _turned(h ^ (padded[at + j].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), COUNT_AT_ONCE):
        part = np.ascontiguousarray(hashes[a : a + COUNT_AT_ONCE].astype("<u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(text: pa.Array) -> np.ndarray:
    """The fingerprint of each text; one without words has 0."""
    words, ends = split_words(pc.ascii_lower(text))
    out = np.zeros(len(ends) - 1, np.uint64)
    if not len(words):
        return out
    length = np.asarray(pc.binary_length(words), dtype=np.int64)
    stop = np.cumsum(length + 1) - 1
    start = stop - length
    # All words of the block with one space between, so that a shingle is a slice.
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer()
    line = np.frombuffer(line, np.uint8)
    counts = np.diff(ends)
    grams = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(grams)))
    # Texts are taken together until they have enough shingles.
    doc = 0
    while doc < len(grams):
        last = max(doc + 1, int(np.searchsorted(bounds, bounds[doc] + COUNT_AT_ONCE, side="right")) - 1)
        owner = np.repeat(np.arange(doc, last), grams[doc:last])
        first = ends[owner] + np.arange(bounds[doc], bounds[last]) - bounds[owner]
        final = np.minimum(first + SHINGLE, ends[owner + 1]) - 1
        hashes = xxh64(line, start[first], stop[final] - start[first])
        for d in range(doc, last):
            a, b = bounds[d] - bounds[doc], bounds[d + 1] - bounds[doc]
            if b > a:
                out[d] = _majority(hashes[a:b])
        doc = last
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", HASH_BYTES):
        yield pa.RecordBatch.from_arrays([one(block["doc_id"]), pa.array(signed(fingerprints(one(block["text"]))))], ["doc_id", "fp"])


def distances(fps: np.ndarray) -> np.ndarray:
    """The distance table: a row for each fingerprint, a column for each reference."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def _agreed(path: int, level: int) -> list[int]:
    """The groups on which a bucket agrees, from its choices at each level (six a level)."""
    agreed: list[int] = []
    for i in range(level):
        left = [g for g in range(GROUPS) if g not in agreed]
        size = len(left) // 4
        for block in _CHOICES[path // 6 ** (level - 1 - i) % 6]:
            agreed += left[block * size : (block + 1) * size]
    return agreed


def bucket_keys(fps: np.ndarray, path: int, level: int) -> np.ndarray:
    """A hash of the coordinates that say on what a bucket of this path agrees. Two buckets with one hash are compared as one."""
    base = np.bitwise_count(fps ^ np.uint64(BASE)).astype(np.int64)
    out = np.full(len(fps), np.uint64(path * 8 + level))
    for g in sorted(_agreed(path, level)):
        for r in FLIPPED[g * len(MASKS) : (g + 1) * len(MASKS)]:
            out = out * P1 + (np.bitwise_count(fps ^ r) - base).astype(np.int64).view(np.uint64)
    return mix(out)


def _buckets(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, paths = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1))
            for path in np.unique(paths).tolist():
                mine = fps[paths == path]
                for choice in range(6):
                    p = path * 6 + choice
                    yield pa.RecordBatch.from_arrays([pa.array(signed(bucket_keys(mine, p, level))), pa.array(signed(mine)), pa.array(np.full(len(mine), p, np.int32))], ["key", "fp", "path"])

    return run


def _stars(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n vertices and links between them, each vertex that is not the least of its component, with that least one."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    v = np.flatnonzero(label != np.arange(n))
    return v, label[v]


def linked(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs are within LIMIT bits: the distance table discards, the fingerprints decide."""
    table = distances(fps)
    kept = np.arange(len(left))
    for a in range(0, table.shape[1], 8):
        if not len(kept):
            break
        part = table[:, a : a + 8]
        kept = kept[(np.abs(part[left[kept]] - part[right[kept]]).max(axis=1) <= LIMIT)]
    return kept[np.bitwise_count(fps[left[kept]] ^ fps[right[kept]]) <= LIMIT]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        ends = np.asarray(lists.offsets, dtype=np.int64)
        flat = np.asarray(lists.flatten()).view(np.uint64)
        ends = ends - ends[0]
        pairs = np.concatenate(([0], np.cumsum(np.diff(ends) * (np.diff(ends) - 1) // 2)))
        at = 0
        while at < len(ends) - 1:
            last = max(at + 1, int(np.searchsorted(pairs, pairs[at] + PAIRS, side="right")) - 1)
            fps, stop = flat[ends[at] : ends[last]], ends[at : last + 1] - ends[at]
            later = np.repeat(stop[1:], np.diff(stop)) - 1 - np.arange(len(fps))
            left = np.repeat(np.arange(len(fps)), later)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
            kept = linked(fps, left, right)
            v, root = _stars(left[kept], right[kept], len(fps))
            yield pa.RecordBatch.from_arrays([pa.array(signed(fps[root])), pa.array(signed(fps[v]))], ["a", "b"])
            at = last
        release()


def links(distinct: DataFrame, tables: Tables, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) with the components of the links between distinct fingerprints (fp)."""
    rows, edges = distinct.select("fp", F.lit(0).alias("path")), None
    for level in range(1, LEVELS + 1):
        keyed = tables.put(rows.mapInArrow(_buckets(level), "key long, fp long, path int"), f"keyed{level}")
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("_key"), "n")
        shared = tables.put(keyed.join(sizes, F.col("key") == F.col("_key")).select("key", "fp", "path", "n"), f"shared{level}")
        last = level == LEVELS
        few = shared if last else shared.filter(F.col("n") <= crowd)
        found = few.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_links, "a long, b long")
        found = tables.put(found.distinct(), f"links{level}")
        edges = found if edges is None else edges.unionByName(found)
        rows = shared.filter(F.col("n") > crowd).select("fp", "path").distinct()
        if last or not rows.limit(1).count():
            return edges


def near_duplicates(docs: DataFrame, tables: Tables, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp (a signed long) and component_id (the smallest doc_id that links reach) of each row.

    Null and empty texts and those of white space have fingerprint zero, which is linked like any other. Rows that repeat a doc_id are each compared by their own text; a null doc_id is never the smallest, and a component of such rows alone has none. An empty table gives no rows. Extra columns play no part.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_hashed, "doc_id long, fp long")
    rows = tables.put(rows, "fingerprints")
    classes = tables.put(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(links(classes.select("fp"), tables, crowd), tables)
    named = classes.join(labels, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("c", "fp").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    names = tables.put(named.join(smallest, "comp").select(F.col("fp").alias("_fp"), "component_id"), "names")
    return rows.join(names, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
