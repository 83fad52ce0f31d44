"""Token files: Parquet with a list column of ids, for selective reads of tokens or metadata.

Layout: rows in ascending doc_id over ascending parts, each with the place of its first id in its part. Ids are dictionary-encoded (a vocabulary of 2^16 takes 16 bits an id); doc_id, part_start and n_tokens are delta-encoded. Row groups and pages are of set sizes, and the page index lets a reader of few documents skip the pages of all others.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .shared import Tables, blocks, one, small_batches

WRITE = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#part_start": "false",
}
#: Text bytes that a worker encodes at once, and pieces that it keeps.
ENCODE_BYTES, KEEP = 10_000_000, 600_000
SCHEMA = "part int, doc_id long, part_start long, n_tokens int, ids array<int>"


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.load(path).keep = KEEP
        written = 0
        for block in blocks(batches, "text", ENCODE_BYTES):
            ids, ends = tokens.encode(path, one(block["text"]))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
            starts = pa.array(ends[:-1].astype(np.int64) + written)
            yield pa.RecordBatch.from_arrays([one(block["part"]), one(block["doc_id"]), starts, pa.array(np.diff(ends).astype(np.int32)), lists], ["part", "doc_id", "part_start", "n_tokens", "ids"])
            written += len(ids)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, parts: int | None = None) -> None:
    """Encodes every text (null: empty), closes it with the end id, and writes the file.

    Rows of one doc_id stay rows of their own, ordered by text; null doc_ids come first. Each row holds where its ids begin in its part. Parts are ranges of doc_id, so that each is sorted by itself; a doc_id that has more rows than two parts should is divided by text.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    most, n = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    ranges = ["doc_id"] if (most or 0) * parts <= 2 * (n or 0) else ["doc_id", F.substring("text", 1, 64)]
    rows = rows.repartitionByRange(parts, *ranges).sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    with small_batches(spark):
        rows.mapInArrow(_encoder(tokenizer), SCHEMA).write.options(**WRITE).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a token file. Selecting n_tokens only reads no ids; a filter on doc_id skips row groups and pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        ends = np.asarray(lists.offsets, dtype=np.int64)
        ids = np.ascontiguousarray(np.asarray(lists.flatten()).astype("<u4"))
        view, ends = memoryview(ids).cast("B"), (ends - ends[0]) * 4
        crc = [zlib.crc32(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends) // 4), pa.array(crc, pa.int64())], ["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all rows before it in the file), n_tokens and ids_crc32 of each row, from the file. Rows of one doc_id keep the places that the file gives them."""
    rows = read_tokens(spark, path).mapInArrow(_digests, "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long")
    # Sums of parts are a row for each part.
    parts = read_tokens(spark, path).groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    before = parts.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = rows.join(F.broadcast(before), F.col("part") == F.col("_part"))
    return out.select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Tables(spark).top}/tokens"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokens.tokenizer_path("word_bpe_49k.json"))
    return token_digests(spark, path)
