"""What several operators need: the shared folder, Arrow blocks, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once.
BLOCK_BYTES = 12_000_000
#: Bytes of a batch that a step sends to a Python worker.
BATCH_BYTES = 4_000_000

_own: dict[str, str] = {}

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD, fixed: the memory of large arrays goes back as soon as they are freed
except (OSError, AttributeError):  # another C library: memory goes back when that one likes
    _libc = None
pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own keeps what it has freed


def release() -> None:
    """Gives freed memory back to the system: a worker serves other tasks, of other steps, after this one."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a temporary one if that is unset."""
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lexiforge-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


_folders: list = []


def _remove_folders() -> None:
    """Results read the tables, so these go when the driver ends."""
    for path, conf in _folders:
        with suppress(Exception):
            path.getFileSystem(conf).delete(path, True)


class Tables:
    """Intermediate tables in the shared folder. They cut lineage, so a lost executor costs only the running step. The folder is removed when the driver's Python ends, or by close()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark)}/lexiforge-{uuid.uuid4().hex}"
        if not _folders:
            atexit.register(_remove_folders)
        _folders.append((spark._jvm.org.apache.hadoop.fs.Path(self.top), spark._jsc.hadoopConfiguration()))

    def close(self) -> None:
        """Removes all tables; nothing may read them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def put(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        # The step's shuffle files go when it ends, not when the driver happens to collect its garbage.
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), small_batches(self.spark):
            df.select("*").write.options(**options).parquet(f"{self.top}/{name}")
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.top}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the queries that are started inside; the session's own value returns after."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession):
    """Batches to Python workers are bounded by bytes in the queries that are started inside."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def column_without_clash(df: DataFrame, name: str) -> str:
    """A name that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc32_of_id(column: str = "doc_id"):
    """crc32 of an id as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def blocks(batches, column: str, most: int = BLOCK_BYTES):
    """Tables of whole rows with about `most` bytes in a string column, from an iterator of record batches. Null strings become empty."""
    held, size = [], 0
    for batch in batches:
        i = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(i), "")
        batch = batch.set_column(i, column, text)
        ends = np.cumsum(np.asarray(pc.binary_length(text), dtype=np.int64))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + most - size, side="right"))
            stop = min(len(ends), max(stop, start + (not held)))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
            if stop < len(ends) or size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                release()
            start = stop
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
        held = []
    release()


def one(column) -> pa.Array:
    """A column of a table as one array."""
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
    return column


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of anything but ASCII white space), and where each text's words begin, with the end."""
    lists = pc.ascii_split_whitespace(text)
    flat, ends = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        kept = np.concatenate(([0], np.cumsum(full)))
        flat, ends = flat.filter(pa.array(full)), kept[ends]
    return flat, ends


def hash_text(values: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values))


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    return hash_text(coded.dictionary.to_pylist())[np.asarray(coded.indices)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive word hashes (of the concatenation; callers leave out grams across texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed * 2 + 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def within(ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For grams of k of concatenated texts: the index of each gram that lies in one text, and that text's number."""
    counts = np.maximum(np.diff(ends) - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    at = np.arange(len(owner)) - first[owner] + ends[:-1][owner]
    return at, owner
