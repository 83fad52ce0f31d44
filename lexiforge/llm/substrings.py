"""Substring dedup by compaction of a de Bruijn graph of words.

A window of 20 words is an edge between its two 19-word nodes. Edges are dealt by their own hash, so the places of equal edges meet, and no word sequence, however frequent, draws other windows into its task. Each place but the first is a repeated edge with the first place as its source coordinate. Repeated edges then travel to their documents, where consecutive ones with consecutive sources form a path without a branch and are compacted into a span. Spans are verified by the words at their source coordinates before the result stands.

A block of documents settles its own repeats before anything is shuffled (and compares their words there), so a passage of very many copies sends a row for each block at most. Edges and repeated edges travel packed, and paths are compacted where they arrive, in place of a join for each step along a path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, blocks, gram_hashes, hash_words, mix, one, release, signed, split_words, within

WINDOW = 20
#: Text bytes that a worker handles at once; packed bytes of edges that a task settles.
EDGE_BYTES, PART_BYTES = 4_000_000, 24_000_000
#: Spans up to which the documents' spans are broadcast (some 40 bytes each); beyond, the join shuffles.
BROADCAST_SPANS = 400_000
NO_ID = -(1 << 63)
EDGES, PLACES, SPANS = 0, 1, 2
PACKED = "part int, kind int, data binary"
SPAN = "doc long, nth long, pos int, n int, src_doc long, src_nth long, src_pos int"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, one after the other, each with its type."""
    head = np.array([len(columns[0]) if columns else 0, len(columns)], np.int64).tobytes() + b"".join(c.dtype.str.encode().ljust(4) for c in columns)
    return head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(data) -> list[np.ndarray]:
    n, k = np.frombuffer(data, np.int64, 2).tolist()
    at, out = 16 + 4 * k, []
    for i in range(k):
        kind = np.dtype(bytes(memoryview(data)[16 + 4 * i : 20 + 4 * i]).decode().strip())
        out.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


def _named(doc: np.ndarray, nth: np.ndarray) -> bytes:
    """The documents of places, once for each run of places of one document, and a bit for each place that tells whether a run begins."""
    new = np.append(True, (doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1]))
    return _pack(doc[new], nth[new] if nth.any() else np.zeros(int(new.sum()), np.int8)) + np.packbits(new).tobytes()


def _dealt(kind: int, part: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], columns: list[np.ndarray]) -> pa.RecordBatch:
    """A packed row for each part."""
    by = np.argsort(part, kind="stable")
    part = part[by]
    edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
    data = []
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        rows = by[i:j]
        named = [_named(d[rows], n[rows]) for d, n in docs]
        data.append(np.array([j - i, *map(len, named)], np.int64).tobytes() + b"".join(named) + _pack(*(c[rows] for c in columns)))
    parts = pa.array(part[edge[:-1]].astype(np.int32) if len(part) else [], pa.int32())
    return pa.RecordBatch.from_arrays([parts, pa.array(np.full(len(data), kind, np.int32)), pa.array(data, pa.binary())], ["part", "kind", "data"])


def _opened(data, docs: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of a packed row: doc and nth of each column of documents, and the other columns."""
    n, *sizes = np.frombuffer(data, np.int64, docs + 1).tolist()
    at, out, bits = 8 * (docs + 1), [], -(-n // 8)
    for size in sizes:
        names = _unpack(memoryview(data)[at : at + size - bits])
        run = np.cumsum(np.unpackbits(np.frombuffer(data, np.uint8, bits, at + size - bits), count=n)) - 1
        out += [x[run].astype(np.int64) for x in names]
        at += size
    return out, _unpack(memoryview(data)[at:])


def _gathered(batches: Iterator[pa.RecordBatch], kind: int, docs: int) -> tuple[list[np.ndarray] | None, list[pa.RecordBatch]]:
    """The columns of all packed rows of a kind, and the rows of others."""
    held, other = [], []
    for batch in batches:
        mine = np.asarray(batch.column(1)) == kind
        if not mine.all():
            other.append(batch.filter(pa.array(~mine)))
        for data in batch.column(2).filter(pa.array(mine)):
            a, b = _opened(data.as_buffer(), docs)
            held.append([*a, *b])
    if not held:
        return None, other
    return [np.concatenate(x) for x in zip(*held, strict=True)], other


def _doc_part(doc: np.ndarray, nth: np.ndarray, parts: int) -> np.ndarray:
    return ((gram_hashes(doc.view(np.uint64) + nth.view(np.uint64), 1, seed=5) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _firsts(key: np.ndarray) -> np.ndarray:
    """For each place, in the order of places, the number of the first with its key."""
    order = np.argsort(key, kind="stable")
    if not len(key):
        return order
    new = np.append(True, key[order][1:] != key[order][:-1])
    out = np.empty(len(key), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    return out


def _several(key: np.ndarray) -> np.ndarray:
    """Which places' keys occur more than once."""
    ordered = np.sort(key)
    values = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(values):
        return np.zeros(len(key), bool)
    return values[np.minimum(np.searchsorted(values, key), len(values) - 1)] == key


def _edges(parts: int):
    """Packed edges of a block, each once, and the spans that the block has settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", EDGE_BYTES):
            doc, nth = (np.asarray(one(block[c]), dtype=np.int64) for c in ("doc", "nth"))
            by = np.lexsort((nth, doc))
            by = by[np.append(True, (np.diff(doc[by]) != 0) | (np.diff(nth[by]) != 0))] if len(by) else by  # a row that is repeated is the same document
            doc, nth = doc[by], nth[by]
            words, ends = split_words(one(block["text"]).take(pa.array(by)))
            at, owner = within(ends, WINDOW)
            if not len(at):
                continue
            coded = words.dictionary_encode()
            code = np.asarray(coded.indices)
            key = gram_hashes(hash_words(coded.dictionary)[code], WINDOW, seed=1)[at]
            pos = at - ends[:-1][owner]
            head = _firsts(key)
            again = np.flatnonzero(head != np.arange(len(head)))
            same = np.ones(len(again), bool)
            for j in range(WINDOW):
                same &= code[at[again] + j] == code[at[head[again]] + j]
            again = again[same]
            if len(again):
                f = owner[head[again]]
                d, p, n, sd, sp = _paths_of(owner[again], pos[again], f, pos[head[again]])
                yield _dealt(SPANS, _doc_part(doc[d], nth[d], parts), [(doc[d], nth[d])], [p.astype(np.int32), n.astype(np.int32)])
            left = np.ones(len(key), bool)
            left[again] = False
            key, owner, pos = key[left], owner[left], pos[left]
            part = ((key & np.uint64(0xFFFF)) * np.uint64(parts) >> np.uint64(16)).astype(np.int32)
            top = (key >> np.uint64(16)).astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :6]
            yield _dealt(EDGES, part, [(doc[owner], nth[owner])], [_narrow(pos), *(np.ascontiguousarray(top[:, i : i + 2]).view(np.uint16).ravel() for i in (0, 2, 4)), (key & np.uint64(0xFFFF)).astype(np.uint16)])

    return run


def _paths_of(doc: np.ndarray, pos: np.ndarray, sdoc: np.ndarray, spos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Repeated edges in order of (doc, pos), compacted where place and source both go on by one word: doc, pos, n, sdoc, spos."""
    new = np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (sdoc[1:] != sdoc[:-1]) | (spos[1:] != spos[:-1] + 1))
    at = np.flatnonzero(new)
    return doc[at], pos[at], np.diff(np.append(at, len(doc))), sdoc[at], spos[at]


def _settle(parts: int):
    """Repeated edges, dealt to their documents; settled spans pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, other = _gathered(batches, EDGES, 1)
        yield from other
        if edges is not None:
            doc, nth, pos, a, b, c, low = edges
            key = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64) << np.uint64(32) | c.astype(np.uint64) << np.uint64(48) | low.astype(np.uint64)
            some = _several(key)
            doc, nth, pos, key = (x[some] for x in (doc, nth, pos, key))
            del edges, a, b, c, low
            by = np.lexsort((pos, nth, doc))
            doc, nth, pos, key = (x[by] for x in (doc, nth, pos, key))
            head = _firsts(key)
            # A row of the same document is at an equal place, which is not earlier.
            again = np.flatnonzero((doc[head] != doc) | (nth[head] != nth) | (pos[head] != pos))
            if len(again):
                f = head[again]
                doc_, nth_ = doc[again], nth[again]
                yield _dealt(PLACES, _doc_part(doc_, nth_, parts), [(doc_, nth_), (doc[f], nth[f])], [_narrow(pos[again]), _narrow(pos[f])])
        release()

    return run


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each document: paths of repeated edges, and those that blocks have settled, which have no source."""
    names = [c.split()[0] for c in SPAN.split(", ")]
    places, other = _gathered(batches, PLACES, 2)
    for batch in other:
        for data in batch.column(2):
            (doc, nth), (pos, n) = _opened(data.as_buffer(), 1)
            none = pa.nulls(len(doc), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(nth), pa.array(pos), pa.array(n), none, none, pa.nulls(len(doc), pa.int32())], names)
    if places is not None:
        by = np.lexsort((places[4], places[1], places[0]))
        doc, nth, sdoc, snth, pos, spos = (x[by].astype(np.int64) for x in places)
        del places
        repeated = np.append(False, (doc[1:] == doc[:-1]) & (nth[1:] == nth[:-1]) & (pos[1:] == pos[:-1]))
        doc, nth, sdoc, snth, pos, spos = (x[~repeated] for x in (doc, nth, sdoc, snth, pos, spos))
        new = np.append(True, (doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1]) | (pos[1:] != pos[:-1] + 1) | (sdoc[1:] != sdoc[:-1]) | (snth[1:] != snth[:-1]) | (spos[1:] != spos[:-1] + 1))
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(doc)))
        whole = [doc[at], nth[at], pos[at].astype(np.int32), n.astype(np.int32), sdoc[at], snth[at], spos[at].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in whole], names)
    release()


def keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc, nth and text with the row's doc_id, and the bytes of all texts. Where ids repeat with different texts, nth is a hash of the text, and 0 elsewhere."""
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("nth"), "text")
    ids = docs.groupBy("doc").agg((F.min("nth") != F.max("nth")).alias("several"), F.sum(F.octet_length("text")).alias("bytes"))
    found = ids.agg(F.max("several").alias("several"), F.sum("bytes").alias("bytes")).first()
    return docs if found["several"] else docs.withColumn("nth", F.lit(0).cast("long")), found["bytes"] or 0


def repeated_spans(docs: DataFrame, tables: Tables, size: int) -> DataFrame:
    """doc, nth, pos, n, src_doc, src_nth, src_pos: n windows from word pos of a document on whose first places start at word src_pos of the source document and go on there. Spans that a block has settled and verified have no source. A document's spans may touch or overlap."""
    parts = min(1 << 16, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-3 * size // PART_BYTES)))
    edges = docs.select("doc", "nth", "text").mapInArrow(_edges(parts), PACKED).repartitionById(parts, "part")
    places = edges.mapInArrow(_settle(parts), PACKED).repartitionById(parts, "part")
    return tables.put(places.mapInArrow(_paths, SPAN), "spans")


CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, doc long, nth long, pos int, n int, digest long, expected boolean"
BASE = np.uint64(0xD1342543DE82EF95)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of BASE and of its inverse, modulo 2^64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, np.uint64)), dtype=np.uint64) for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))


def digests(sums: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of words, from the sums of word hashes times powers: equal runs have equal ones, wherever they stand."""
    inverse = _powers(1 << max(0, len(sums) - 1).bit_length())[1]
    return signed(mix((sums[at + words] - sums[at]) * inverse[at] + words.astype(np.uint64)))


def word_sums(words: pa.Array) -> np.ndarray:
    h = mix(hash_words(words) ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return np.append(np.zeros(1, np.uint64), np.cumsum(h * _powers(1 << max(0, len(h)).bit_length())[0][: len(h)], dtype=np.uint64))


def _flat(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[pa.Array]]:
    """Of a column of lists of structs: each entry's row, and its fields."""
    rows = np.repeat(np.arange(len(column)), np.asarray(pc.fill_null(pc.list_value_length(column), 0)))
    flat = column.flatten()
    return rows, [flat.field(f) for f in fields]


def _cut(text_too: bool):
    """Each document without the words of its spans; and digests of the words of spans (expected, at the source coordinates) and of source coordinates that others ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", EDGE_BYTES):
            words, ends = split_words(one(block["text"]))
            n, starts = np.diff(ends), ends[:-1]
            row, (pos, size, sdoc, snth, spos) = _flat(one(block["spans"]), "pos", "n", "src_doc", "src_nth", "src_pos")
            ask, (apos, asize) = _flat(one(block["asked"]), "pos", "n")
            begin, length = starts[row] + np.asarray(pos, np.int64), np.asarray(size, np.int64) + WINDOW - 1
            sourced = np.asarray(pc.is_valid(spos))
            if sourced.any() or len(ask):
                sums = word_sums(words)
                have = np.asarray(apos, np.int64), np.asarray(asize, np.int64) + WINDOW - 1
                # A span or a request that goes beyond its document has no words to compare.
                fits = have[0] + have[1] <= n[ask]
                doc, nth = (one(block[c]).take(pa.array(ask)) for c in ("doc", "nth"))
                yield _digest_batch([doc, nth, apos, asize], digests(sums, starts[ask[fits]] + have[0][fits], have[1][fits]), False, pa.array(fits))
                good = sourced & (begin + length <= ends[1:][row])
                yield _digest_batch([sdoc, snth, spos, size], digests(sums, begin[good], length[good]), True, pa.array(good))
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, begin, 1)
            np.add.at(gone, np.minimum(begin + length, ends[1:][row]), -1)
            keep = np.cumsum(gone)[:-1] == 0
            left = np.append(0, np.cumsum(keep))[ends]
            lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(keep)))
            kept = pc.binary_join(lists, " ")
            sha = [hashlib.sha256(t.as_buffer()).hexdigest() for t in kept.cast(pa.binary())]
            none = lambda k: pa.nulls(len(n), k)
            cols = [one(block["doc_id"]), pa.array(n), pa.array(n - np.diff(left)), pa.array(sha, pa.string()), kept.cast(pa.string()) if text_too else none(pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *map(none, _KINDS[5:])], _NAMES)

    return run


_NAMES = [c.split()[0] for c in CUT.split(", ")]
_KINDS = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64(), pa.bool_()]


def _digest_batch(keys: list[pa.Array], digest: np.ndarray, expected: bool, some: pa.Array) -> pa.RecordBatch:
    keys = [k.filter(some) for k in keys]
    return pa.RecordBatch.from_arrays([*(pa.nulls(len(digest), k) for k in _KINDS[:5]), *keys, pa.array(digest), pa.array(np.full(len(digest), expected))], _NAMES)


def _cut_documents(docs: DataFrame, spans: DataFrame, tables: Tables, name: str, text_too: bool) -> DataFrame:
    own = spans.groupBy("doc", "nth").agg(F.collect_list(F.struct("pos", "n", "src_doc", "src_nth", "src_pos")).alias("spans"), F.lit(None).cast("array<struct<pos:int,n:int>>").alias("asked"))
    ask = spans.filter("src_pos is not null").select(F.col("src_doc").alias("doc"), F.col("src_nth").alias("nth"), F.col("src_pos").alias("pos"), "n").distinct()
    ask = ask.groupBy("doc", "nth").agg(F.lit(None).cast(own.schema["spans"].dataType).alias("spans"), F.collect_list(F.struct("pos", "n")).alias("asked"))
    both = own.unionByName(ask).groupBy("doc", "nth").agg(F.first("spans", True).alias("spans"), F.first("asked", True).alias("asked"))
    both = both.select(F.col("doc").alias("_doc"), F.col("nth").alias("_nth"), "spans", "asked")
    side = F.broadcast(both) if spans.count() <= BROADCAST_SPANS else both
    rows = docs.join(side, (docs["doc"] == F.col("_doc")) & (docs["nth"] == F.col("_nth")), "left").select("doc_id", "doc", "nth", "text", "spans", "asked")
    return tables.put(rows.mapInArrow(_cut(text_too), CUT), name)


def dedup_substrings(docs: DataFrame, tables: Tables, text_too: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for) of each row.

    A word is removed if a window that covers it also starts earlier: in a smaller doc_id, or before in the same document. Null and empty texts have no words, and shorter ones than a window keep all. A null id is the smallest. Rows of one doc_id and one text are one document, at equal places; of rows of one doc_id with different texts, the one whose text has the smaller hash comes first. Other columns play no part. An empty table gives no rows. Spans whose words are not those at their source coordinates (different windows of one hash) are left in.
    """
    docs, size = keyed(docs)
    spans = repeated_spans(docs, tables, size)
    cut = _cut_documents(docs, spans, tables, "cut", text_too)
    keys = ["doc", "nth", "pos", "n"]
    found = cut.filter("not expected").select(*keys, F.col("digest").alias("_digest")).distinct()
    wrong = tables.put(cut.filter("expected").select(*keys, "digest").distinct().join(found, keys, "left").filter("_digest is null or digest <> _digest").select(*(F.col(k).alias(f"src_{k}") if k != "n" else F.col(k) for k in keys)).distinct(), "wrong")
    if wrong.limit(1).count():
        right = tables.put(spans.join(wrong, ["src_doc", "src_nth", "src_pos", "n"], "left_anti").select(*spans.columns), "verified")
        cut = _cut_documents(docs, right, tables, "cut_again", text_too)
    return cut.filter("n_words is not null").select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * text_too)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark))


OP9_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents
), e AS MATERIALIZED (
  SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS span FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w) t
), f AS (SELECT span, min(struct_pack(d := doc_id, p := p)) AS first FROM e GROUP BY span HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM e JOIN f USING (span) WHERE first.d <> doc_id OR first.p <> p
), word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
