"""Token files: parts, ranges of bytes, rows that share ids, and what failed or repeated writes leave."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.sources import files, tokens


@pytest.fixture(scope="module")
def ids(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(1 << 16) for _ in range(rng.choice([0, 1, 5, 60]))]) for i in range(300)] + [(300, None)]
    path = f"file://{tmp_path_factory.mktemp('t')}/bin"
    df = spark.createDataFrame(rows, "s long, ids array<int>").repartition(6)
    flat = [x for _, r in rows for x in r or []]
    assert files.write_token_bin(df, "s", "ids", path, parts=7) == len(flat)
    return flat, path


def wanted(flat, length, overlap, workers, tail, start=0, end=None):
    flat, out = flat[start:end], []
    share = len(flat) // workers
    for w in range(workers):
        a, b = w * share, len(flat) if w == workers - 1 else (w + 1) * share
        i = a
        while i + length <= b or (tail and i < b and (i == a or i + overlap < b)):
            out.append((w, (i - a) // (length - overlap), start + i, flat[i : min(i + length, b)]))
            i += length - overlap
    return out


@pytest.mark.parametrize("batch,task", [(4 << 20, 64 << 20), (64, 300)])
@pytest.mark.parametrize("length,overlap,workers,tail,start,end", [(1 << 18, 0, 1, True, 0, None), (10, 0, 1, True, 0, None), (10, 0, 3, False, 0, None), (17, 1, 4, False, 0, None), (17, 5, 4, True, 0, None), (1, 0, 2, True, 0, None), (9, 8, 1, False, 40, 95), (50, 0, 2, True, 333, 1000), (10, 0, 3, True, 10**9, None), (3, 0, 9, True, 5, 9)])
def test_rows(spark, ids, monkeypatch, batch, task, length, overlap, workers, tail, start, end):
    flat, path = ids
    reader = tokens._Reader(path, 2, length, overlap, workers, tail, start, end)
    monkeypatch.setattr(tokens, "BATCH_BYTES", batch)
    monkeypatch.setattr(tokens, "TASK_BYTES", task)
    expected = wanted(flat, length, overlap, workers, tail, start, end)
    # The reader itself, as the workers of a session do not see other sizes.
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["worker"], r["nth"], r["start"], r["ids"]) for r in found] == expected
    if batch > 64:
        more = {} if end is None else {"end": end}
        rows = files.read_token_bin(spark, path, length=length, overlap=overlap, workers=workers, tail=tail, start=start, **more)
        assert sorted((r.worker, r.nth, r.start, r.ids) for r in rows.collect()) == expected


def test_files_of_rows(ids):
    flat, path = ids
    reader, at = tokens._Reader(path, 2, 7, 0, 1, True, 0, None), {}
    for name, n in tokens.parts(path, 2):
        at |= dict.fromkeys(range(len(at), len(at) + n), name.rsplit("/", 1)[-1])
    assert len(at) == len(flat)
    assert all(r["file"] == at[r["start"]] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist())


def test_a_range_is_read_without_the_rest(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(1000).select("id", F.array(F.col("id").cast("int")).alias("ids"))
    files.write_token_bin(rows, "id", "ids", path, parts=10)
    found = tokens.parts(path, 2)
    begin = sum(n for _, n in found[:4])
    got = lambda: [x for r in files.read_token_bin(spark, path, start=begin + 2, end=begin + 9).collect() for x in r.ids]
    for i, (name, _) in enumerate(found):
        if i != 4:
            size = len(open(name, "rb").read())
            with open(name, "wb") as out:
                out.truncate(size)
    assert got() == list(range(begin + 2, begin + 9))
    reader = tokens._Reader(path, 2, 100, 0, 1, True, begin + 2, begin + 9)
    assert [[p[0] for p in r.pieces] for r in reader.partitions()] == [[found[4][0]]]


def test_slices(spark, ids):
    flat, path = ids
    out = sorted((r.worker, r.nth, r.input_ids, r.labels) for r in files.token_slices(spark, path, 16, 3).collect())
    assert out == [(w, n, x[:16], x[1:]) for w, n, _, x in wanted(flat, 17, 1, 3, False)]
    assert out


def test_failed_and_repeated_writes(spark, tmp_path):
    path, folder = f"file://{tmp_path}/t", tmp_path / "t"
    good = spark.createDataFrame([(1, [1, 2]), (2, [3])], "s long, ids array<int>")
    for bad, why in (([(1, [1]), (2, [70000])], "more than 16 bits"), ([(1, [-1])], "more than 16 bits"), ([(1, [1, None])], "is null")):
        with pytest.raises(Exception, match=why):
            files.write_token_bin(spark.createDataFrame(bad, "s long, ids array<int>"), "s", "ids", path, parts=2)
        assert [f.name for f in folder.iterdir()] == []
    assert files.write_token_bin(good, "s", "ids", path) == 3 == files.write_token_bin(good.limit(1), "s", "ids", path)
    with pytest.raises(Exception, match="FileExistsError"):
        good.select("ids").write.format(tokens.register(spark)).mode("append").save(path)
    good.filter("s = 2").select("ids").coalesce(1).write.format(tokens.register(spark)).option("width", 4).mode("overwrite").save(path)
    assert sorted(f.suffix for f in folder.iterdir() if not f.name.startswith(".")) == ["", ".bin"]
    assert [r.ids for r in files.read_token_bin(spark, path, width=4).collect()] == [[3]]
    next(folder.glob("*.bin")).write_bytes(b"abc")
    with pytest.raises(Exception, match="whole ids"):
        files.read_token_bin(spark, path).collect()


def test_empty_and_wide(spark, tmp_path):
    empty = f"file://{tmp_path}/e"
    assert files.write_token_bin(spark.createDataFrame([], "s long, ids array<int>"), "s", "ids", empty) == 0
    assert files.read_token_bin(spark, empty).collect() == [] == files.token_slices(spark, empty, 4, 2).collect()
    wide = f"file://{tmp_path}/w"
    assert files.write_token_bin(spark.createDataFrame([(1, [1 << 16, (1 << 32) - 1])], "s long, ids array<long>"), "s", "ids", wide, width=4) == 2
    assert sum(np.fromfile(p, "<u4").size for p in (tmp_path / "w").glob("*.bin")) == 2
    assert [r.ids for r in files.read_token_bin(spark, wide, width=4).collect()] == [[1 << 16, (1 << 32) - 1]]
