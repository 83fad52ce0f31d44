"""Best-fit packing of token pieces into sequences.

Residual packing in rounds: each partition packs its pieces best-fit, longest first, and emits the bins that are nearly full. Underfull bins become items of the next round, in fewer partitions, until one round has met them all or a partition would hold too many.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .shared import Tables, blocks, one

CAPACITY = 1024
#: A bin with no more free tokens than this is emitted; later rounds could hardly fill it.
NEARLY_FULL = 2
#: Items that one task packs at once.
ITEMS_A_TASK = 100_000
#: A round has so many times fewer partitions than the one before.
MERGE = 8

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BIN = f"sequence_id long, fill int, mix long, members array<struct<{PIECE.replace(' ', ':').replace(',:', ',')}>>"


def cut(ends: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose ids end at `ends`: each piece's text, number, start and length. Only texts longer than the capacity are cut; their first piece takes what is left over."""
    n = np.diff(ends)
    pieces = np.maximum(1, -(-n // capacity))
    owner = np.repeat(np.arange(len(n)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = n - (pieces - 1) * capacity
    start = np.where(number == 0, 0, first[owner] + (number - 1) * capacity)
    return owner, number, start, np.where(number == 0, first[owner], capacity)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, best-fit decreasing: the fullest bin that still has room. Ties follow the order given."""
    bins = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0  # bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if free := mask >> size:
            left = size + (free & -free).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, b, made = capacity, made, made + 1
        bins[i] = b
        left -= size
        if left:
            if not room[left]:
                mask |= 1 << left
            room[left].append(b)
    return bins


def _bins(sizes: np.ndarray, members: pa.ListArray, base: int, capacity: int) -> pa.RecordBatch:
    """Bins of items; an item has one or more members. base numbers the bins."""
    which = best_fit(sizes, capacity)
    order = np.argsort(which, kind="stable")
    fill = np.bincount(which, weights=sizes).astype(np.int32)
    lists = members.take(pa.array(order))
    count = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    upto = np.append(0, np.cumsum(count))
    ends = upto[np.append(0, np.cumsum(np.bincount(which)))].astype(np.int32)
    ids = base + np.arange(len(fill))
    out = pa.ListArray.from_arrays(pa.array(ends), lists.flatten())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fill), pa.array((ids * 2654435761) % (1 << 31)), out], ["sequence_id", "fill", "mix", "members"])


def _base(turn: int) -> int:
    """Sequence numbers of a task in a round: no other task of any round has them."""
    return (turn << 56) | (TaskContext.get().partitionId() << 32)


def pieces_of(text: pa.Array, tokenizer: str, capacity: int, ids_too: bool = False) -> tuple[np.ndarray, list[pa.Array]]:
    """Each piece's text number, and its number, start, length and crc32, with its ids if asked for."""
    ids, ends = tokens.encode(tokenizer, text)
    owner, number, start, length = cut(ends, capacity)
    at = (ends[owner] + start) * 4
    view = memoryview(np.ascontiguousarray(ids.astype("<u4", copy=False))).cast("B")
    crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
    out = [pa.array(number.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())]
    if ids_too:
        out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(ids.view(np.int32))))
    return owner, out


def _first_round(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, _base(0)
        names = [f.name for f in _MEMBER]

        def packed():
            nonlocal held, size, base
            m = pa.concat_arrays(held)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32)), m)
            out = _bins(np.asarray(m.field("length")), lists, base, capacity)
            held, size, base = [], 0, base + len(out)
            return out

        for block in blocks(batches, "text", tokens.ENCODE_BYTES):
            owner, cols = pieces_of(one(block["text"]), tokenizer, capacity)
            held.append(pa.StructArray.from_arrays([one(block["doc_id"]).take(pa.array(owner)), *cols], names))
            size += len(owner)
            if size >= ITEMS_A_TASK:
                yield packed()
        if held:
            yield packed()

    return run


def _next_round(turn: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(map(len, held)):
            t = pa.Table.from_batches(held).sort_by("sequence_id").combine_chunks()
            yield _bins(np.asarray(one(t["fill"])).astype(np.int64), one(t["members"]), _base(turn), capacity)

    return run


def pack(docs: DataFrame, tokenizer: str, tables: Tables, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    A null text counts as empty and is one piece of the end id alone; rows of one doc_id are packed each by itself. An empty table gives no rows. Each round is a table in the shared folder, so a lost executor repeats one round at most.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bins = tables.put(docs.mapInArrow(_first_round(tokenizer, capacity), BIN), "round0")
    open_ = F.col("fill") < capacity - NEARLY_FULL
    done = [bins.filter(~open_)]
    parts = int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(1, 20):
        left = bins.filter(open_)
        n = left.count()
        parts = max(-(-parts // MERGE), -(-n // ITEMS_A_TASK))
        if not n:
            break
        bins = tables.put(left.repartition(parts, "mix").mapInArrow(_next_round(turn, capacity), BIN), f"round{turn}")
        if parts == -(-n // ITEMS_A_TASK):
            done.append(bins)
            break
        done.append(bins.filter(~open_))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return unroll(out)


def unroll(bins: DataFrame) -> DataFrame:
    """A row for each member of a bin, with its offset there."""
    upto = F.aggregate("members", F.array(F.lit(0).cast("long")), lambda a, m: F.concat(a, F.array(F.element_at(a, -1) + m["length"])))
    rows = bins.select("sequence_id", F.arrays_zip("members", upto.alias("upto")).alias("z"))
    rows = rows.select("sequence_id", F.explode("z").alias("z")).filter("z.members is not null")
    return rows.select("z.members.*", "sequence_id", F.col("z.upto").alias("offset"))


def _with_ids(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", tokens.ENCODE_BYTES):
            owner, cols = pieces_of(one(block["text"]), tokenizer, capacity, True)
            yield pa.RecordBatch.from_arrays([one(block["doc_id"]).take(pa.array(owner)), *cols], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids and the doc_ids in them. A sequence holds `capacity` ids at most, so each group is bounded."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.mapInArrow(_with_ids(tokenizer, capacity), f"{PIECE}, ids array<int>").select("doc_id", "piece", "ids_crc32", "ids")
    ids = ids.dropDuplicates(["doc_id", "piece", "ids_crc32"])
    rows = packed.join(ids.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (packed["piece"] == ids["piece"]) & (packed["ids_crc32"] == ids["ids_crc32"]))
    grouped = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("m"))
    return grouped.select("sequence_id", F.flatten(F.col("m.ids")).alias("ids"), F.col("m.doc_id").alias("doc_ids"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.tokenizer_path("byte_bpe_50k.json"), Tables(spark))
