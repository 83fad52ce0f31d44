"""Flat files of token ids as a Spark data source: tasks write parts that a commit makes visible, and read ranges of bytes."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "token_files"
#: Bytes of a batch of rows, and of a reading task if that makes no more than MOST_TASKS. A task holds one batch, however long its range is.
BATCH_BYTES, TASK_BYTES, MOST_TASKS = 4 << 20, 64 << 20, 65_536
_KINDS = {2: ("<u2", "int", pa.int32()), 4: ("<u4", "bigint", pa.int64())}


def parts(path: str, width: int) -> list[tuple[str, int]]:
    """File and number of ids of each part, in order."""
    fs, top = pafs.FileSystem.from_uri(path)
    found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(top)) if f.path.endswith(".bin"))
    if cut := [p for p, size in found if size % width]:
        raise ValueError(f"{cut[0]} does not hold whole ids of {width} bytes")
    return [(p, size // width) for p, size in found]


def complete(path: str) -> bool:
    """Whether a write to the folder was committed."""
    fs, top = pafs.FileSystem.from_uri(path)
    return fs.get_file_info(f"{top}/_SUCCESS").type != pafs.FileType.NotFound


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str


class _Writer(DataSourceArrowWriter):
    """A task writes a file under a name of its attempt. The commit gives those of the attempts that count their names, and _SUCCESS comes last; what other attempts left goes, as does everything if the job fails."""

    def __init__(self, path: str, width: int):
        self.path, self.width, self.job = path, width, uuid.uuid4().hex
        fs, top = pafs.FileSystem.from_uri(path)
        fs.create_dir(top, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, top = pafs.FileSystem.from_uri(self.path)
        task = TaskContext.get()
        name = f"{top}/_{self.job}-{task.partitionId()}-{task.taskAttemptId()}"
        with fs.open_output_stream(name) as out:
            for batch in iterator:
                ids = batch.column(0).flatten()
                if ids.null_count:
                    raise ValueError("an id is null")
                data = np.asarray(ids, dtype=np.int64)
                if len(data) and (data.min() < 0 or data.max() >= 1 << 8 * self.width):
                    raise ValueError(f"an id has more than {8 * self.width} bits")
                out.write(data.astype(_KINDS[self.width][0]).tobytes())
        return _Written(task.partitionId(), name)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, top = pafs.FileSystem.from_uri(self.path)
        for f in fs.get_file_info(pafs.FileSelector(top)):
            if f.path.endswith((".bin", "/_SUCCESS")):
                fs.delete_file(f.path)
        for m in messages:
            if m is not None:
                fs.move(m.name, f"{top}/part-{m.part:07d}.bin")
        self.abort([])
        with fs.open_output_stream(f"{top}/_SUCCESS"):
            pass

    def abort(self, messages: list[_Written | None]) -> None:
        fs, top = pafs.FileSystem.from_uri(self.path)
        for f in fs.get_file_info(pafs.FileSelector(top)):
            if f.base_name.startswith(f"_{self.job}-"):
                fs.delete_file(f.path)


@dataclass
class _Range(InputPartition):
    """Rows `first` to `last` of a worker whose ids are those from lo to hi; pieces are the files that hold them (file, place of its first id, ids)."""

    worker: int
    lo: int
    hi: int
    first: int
    last: int
    pieces: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, width: int, length: int, overlap: int, workers: int, tail: bool, start: int, end: int | None):
        if not 0 <= overlap < length or workers < 1:
            raise ValueError("overlap must be less than length, and there must be a worker")
        self.path, self.width, self.length, self.step, self.workers, self.tail, self.start, self.end = path, width, length, length - overlap, workers, tail, start, end

    def _rows(self, n: int) -> int:
        """How many rows n ids make."""
        over = n - self.length + self.step
        if not self.tail:
            return max(0, over // self.step)
        return max(-(-over // self.step), int(n > 0))

    def partitions(self) -> list[_Range]:
        files = parts(self.path, self.width)
        firsts = [0]
        for _, n in files:
            firsts.append(firsts[-1] + n)
        begin = min(max(self.start, 0), firsts[-1])
        end = firsts[-1] if self.end is None else min(max(self.end, begin), firsts[-1])
        share, size = (end - begin) // self.workers, max(TASK_BYTES, (end - begin) * self.width // MOST_TASKS)
        each = max(1, size // (self.step * self.width))
        out = []
        for w in range(self.workers):
            lo, hi = begin + w * share, end if w == self.workers - 1 else begin + (w + 1) * share
            rows = self._rows(hi - lo)
            for first in range(0, rows, each):
                last = min(first + each, rows)
                a, b = lo + first * self.step, min(hi, lo + (last - 1) * self.step + self.length)
                i = bisect_right(firsts, a) - 1
                pieces = []
                while i < len(files) and firsts[i] < b:
                    pieces.append((files[i][0], firsts[i], files[i][1]))
                    i += 1
                out.append(_Range(w, lo, hi, first, last, pieces))
        return out

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no ranges
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        kind, _, arrow = _KINDS[self.width]
        rows, pieces, opened = max(1, BATCH_BYTES // (self.step * self.width)), list(partition.pieces), None
        for first in range(partition.first, partition.last, rows):
            nth = np.arange(first, min(first + rows, partition.last), dtype=np.int64)
            starts = partition.lo + nth * self.step
            ends = np.minimum(starts + self.length, partition.hi)
            got, names = [], []
            while pieces and pieces[0][1] + pieces[0][2] <= starts[0]:
                pieces.pop(0)
                opened = None
            for i, (name, at, n) in enumerate(pieces):
                a, b = max(starts[0], at), min(ends[-1], at + n)
                if at >= ends[-1]:
                    break
                source = opened if i == 0 and opened is not None else fs.open_input_file(name)
                opened = source if i == 0 else opened
                got.append(np.frombuffer(source.read_at(int(b - a) * self.width, int(a - at) * self.width), kind))
                names.append((at, name))
            ids, sizes = np.concatenate(got).astype(arrow.to_pandas_dtype()), ends - starts
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            # Rows may share ids with the next one, so each is gathered by places.
            places = np.arange(offsets[-1]) + np.repeat(starts - starts[0] - offsets[:-1], sizes)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[places], arrow))
            files = np.array([name.rsplit("/", 1)[-1] for _, name in names], dtype=object)[np.searchsorted([at for at, _ in names], starts, "right") - 1]
            columns = [pa.array(files, pa.string()), pa.array(np.full(len(nth), partition.worker), pa.int32()), pa.array(nth), pa.array(starts), lists]
            yield pa.RecordBatch.from_arrays(columns, ["file", "worker", "nth", "start", "ids"])


class TokenFiles(DataSource):
    """Parts of little-endian numbers of `width` bytes (2 or 4), which are one sequence in order of their names, in a folder that pyarrow opens at the driver and the tasks.

    Written is one column of lists, in order of the partitions; null lists hold nothing. Mode append is for a folder without a committed write, overwrite replaces one.

    Read are rows of `length` ids, of which a row shares the last `overlap` with the next: file (where it begins), worker, nth (from 0 in its worker), start (the place of its first id) and ids. `workers` get consecutive ranges of equal size, the last one what is left over; ids from `start` up to `end` are read. Without `tail`, what is left in a range and too short for a row is dropped.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def _width(self) -> int:
        width = int(self.options.get("width", 2))
        if width not in _KINDS:
            raise ValueError("width must be 2 or 4")
        return width

    def schema(self) -> str:
        return f"file string, worker int, nth bigint, start bigint, ids array<{_KINDS[self._width()][1]}>"

    def reader(self, schema) -> _Reader:
        o = self.options
        end = o.get("end")
        return _Reader(o["path"], self._width(), int(o.get("length", 1 << 18)), int(o.get("overlap", 0)), int(o.get("workers", 1)), o.get("tail", "true").lower() == "true", int(o.get("start", 0)), None if end is None else int(end))

    def writer(self, schema, overwrite: bool) -> _Writer:
        if not overwrite and complete(self.options["path"]):
            raise FileExistsError(self.options["path"])
        return _Writer(self.options["path"], self._width())


def register(spark: SparkSession) -> str:
    """The name of the source, known to the session."""
    spark.dataSource.register(TokenFiles)
    return NAME
