"""Bounded pulls: rows in order up to a budget, read from no more of the files than the budget needs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order as O
from ..operators.store import kept
from .files import ordered_lines

#: Bytes of text that make a token, until rows that were read tell better.
BYTES_A_TOKEN = 4.0


def row_groups(spark: SparkSession, files: list[str], seq: str, text: str) -> DataFrame:
    """lo and bytes of each row group: its least seq (a whole number; null without statistics, or if it holds a null) and the size of its text column. Tasks read the files' footers only."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as source:
                    meta = pq.ParquetFile(source).metadata
                los, sizes = [], []
                for g in range(meta.num_row_groups):
                    columns = {c.path_in_schema: c for c in map(meta.row_group(g).column, range(meta.num_columns))}
                    s = columns[seq].statistics
                    known = s is not None and s.has_min_max and s.has_null_count and s.null_count == 0
                    los.append(s.min if known else None)
                    sizes.append(columns[text].total_uncompressed_size)
                yield pa.RecordBatch.from_arrays([pa.array(los, pa.int64()), pa.array(sizes, pa.int64())], ["lo", "bytes"])

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 1000)).mapInArrow(footers, "lo bigint, bytes bigint")


def _opens(file: str) -> bool:
    """Whether pyarrow has the store of a file; Spark reads from more."""
    try:
        pafs.FileSystem.from_uri(file)
    except (pa.ArrowException, OSError):
        return False
    return True


def splits(table: DataFrame, seq: str) -> DataFrame:
    """lo and bytes as of row_groups, of the ranges in which Spark reads a table's files: for stores in which tasks cannot open footers. seq is read whole, other columns are not; bytes are those of the range."""
    block = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_block_length")]
    rows = table.select(F.col(seq).cast("bigint").alias("seq"), *block)
    lo = F.when(F.count("seq") == F.count("*"), F.min("seq"))
    return rows.groupBy("file_path", "file_block_start").agg(lo.alias("lo"), F.max("file_block_length").alias("bytes")).select("lo", "bytes")


def _steps(groups: DataFrame) -> tuple[int, list[tuple[int, int]]]:
    """The bytes that are read in any case, and lo and bytes of ranges of row groups in order: SIDE * SIDE at most, however many row groups there are."""
    groups = kept(groups)
    always = groups.filter("lo is null").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    some = groups.filter("lo is not null")
    rows = some.groupBy(O.range_of(some, "lo", 1).alias("range")).agg(F.min("lo").alias("lo"), F.sum("bytes").alias("bytes")).select("lo", "bytes").collect()
    return always, sorted((r.lo, r.bytes) for r in rows)


def pulled(spark: SparkSession, path: str, seq: str, text: str, prepare: Callable[[DataFrame], DataFrame], cost: str, budget: int) -> DataFrame:
    """What `prepare` makes of the Parquet table at path, in order of seq (whole numbers, unique), until the running cost reaches the budget, with the row that crosses it.

    prepare gives seq and cost (not negative) among its columns, and what it does with a row may depend on rows of lesser seq only, as with keep-first. Footers say which row groups begin where. A round reads all rows below a bound, which the scan gets as a filter, so that it skips row groups and files behind it; the bound is set by the cost that a byte had so far, and at least doubles from round to round. Null seqs come first. In a store that only Spark opens, seqs are read in place of footers. A table without statistics, or one whose row groups overlap, is read as far as they do: the rows are the same.
    """
    table = spark.read.parquet(path)
    files = table.inputFiles()
    if budget <= 0 or not files:
        return prepare(table).limit(0)
    read, steps = _steps(row_groups(spark, files, seq, text) if _opens(files[0]) else splits(table, seq))
    rate, n = 1 / BYTES_A_TOKEN, 0
    while True:
        least = 2 * read if n else 0
        while n < len(steps) and (n == 0 or read * rate < budget or read < least):
            read, n = read + steps[n][1], n + 1
        if n == len(steps):
            return O.within_budget(prepare(table), seq, F.col(cost), budget)
        near = table.filter(F.col(seq).isNull() | (F.col(seq) < steps[n][0]))
        rows = prepare(near)
        total = rows.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
        if total >= budget:
            return O.within_budget(rows, seq, F.col(cost), budget)
        rate = max(total, 1) / max(read, 1)


def pulled_lines(spark: SparkSession, folder: str, cost: Callable[[Column], Column], budget: int, pattern: str = "*.txt") -> DataFrame:
    """source (the file's name) and text of the non-empty lines of a folder's files, files by name and lines in their order, until the running cost reaches the budget, with the line that crosses it.

    Files are read in rounds, as many as their sizes say that the budget may need; later files are not opened. Of the files that fit whole, no line is numbered: only the file that crosses the budget has a running sum, by the blocks in which it is read.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length").collect()
    files = sorted((r.path.rsplit("/", 1)[-1], r.path, r.length) for r in listed)
    none = spark.createDataFrame([], "source string, text string")
    rate, n, read, spent, whole = 1 / BYTES_A_TOKEN, 0, 0, 0, []
    while n < len(files) and spent < budget:
        least, first = 2 * read, n
        while n < len(files) and (n == first or read * rate < budget or read < least):
            read, n = read + files[n][2], n + 1
        batch = [p for _, p, _ in files[first:n]]
        lines = spark.read.text(batch).filter("value <> ''").groupBy(F.col("_metadata.file_path").alias("path"))
        sums = {r.path.rsplit("/", 1)[-1]: r.cost for r in lines.agg(F.sum(cost(F.col("value"))).alias("cost")).collect()}
        for name, path, _ in files[first:n]:
            before, spent = spent, spent + sums.get(name.replace(" ", "%20"), sums.get(name, 0))
            if spent >= budget:
                rows = ordered_lines(spark, path).filter("line <> ''").withColumn("_c", cost(F.col("line")))
                last = O.running_sum(rows, "seq", F.col("_c"), "_upto", bucket=F.col("block")).filter(F.col("_upto") - F.col("_c") < budget - before)
                last = last.select(F.lit(name).alias("source"), F.col("line").alias("text"))
                return (_lines(spark, whole) if whole else none).unionByName(last)
            whole.append(path)
        rate = max(spent, 1) / max(read, 1)
    return _lines(spark, whole) if whole else none


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).filter("value <> ''").select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
