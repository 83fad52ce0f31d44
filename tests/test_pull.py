import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.sources import pull


def blank_pages(path):
    """Zeros for all that is not the footer: whoever reads a page of the file fails. The checksum beside it would fail for the footer too."""
    folder, name = os.path.split(path)
    os.remove(f"{folder}/.{name}.crc")
    with open(path, "r+b") as f:
        size = f.seek(0, 2)
        f.seek(size - 8)
        footer = int.from_bytes(f.read(4), "little")
        f.seek(4)
        f.write(b"\0" * (size - 8 - footer - 4))


def until(costs, budget):
    total, n = 0, 0
    while n < len(costs) and total < budget:
        total, n = total + costs[n], n + 1
    return n


@pytest.fixture
def files(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i * 977, "x" * rng.randint(1, 900), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "seq long, text string, other int")
    df.repartitionByRange(16, "seq").write.option("parquet.enable.dictionary", "false").option("compression", "none").parquet(f"{tmp_path}/t")
    parts = sorted(f"{tmp_path}/t/{f}" for f in os.listdir(f"{tmp_path}/t") if f.endswith(".parquet"))
    return rows, f"{tmp_path}/t", sorted(parts, key=lambda p: pq.ParquetFile(p).metadata.row_group(0).column(0).statistics.min)


def tokens(df):
    return df.select("seq", T.estimate_tokens(F.col("text")).alias("n"))


def got(spark, path, budget, prepare=tokens):
    return sorted(r.seq for r in pull.pulled(spark, path, "seq", "text", prepare, "n", budget).collect())


def test_pages_behind_the_budget_are_not_read(spark, files):
    rows, path, parts = files
    costs = [max(1, len(t) // 4) for _, t, _ in rows]
    want = {b: [s for s, _, _ in rows[: until(costs, b)]] for b in (1, 900, 40_000)}
    for p in parts[6:]:
        blank_pages(p)
    for b, w in want.items():
        assert got(spark, path, b) == w
    with pytest.raises(Exception):
        got(spark, path, sum(costs))


def test_pull_widens_when_most_rows_are_dropped(spark, files):
    rows, path, parts = files
    few = lambda df: df.filter(F.pmod("other", F.lit(20)) == 0).select("seq", F.lit(10).cast("bigint").alias("n"))
    left = [s for s, _, o in rows if o % 20 == 0]
    for p in parts[12:]:
        blank_pages(p)
    assert got(spark, path, 600, few) == left[:60]
    assert got(spark, path, 0, few) == []


def test_pull_of_all_and_of_overlapping_files(spark, files, tmp_path):
    rows, path, _ = files
    assert got(spark, path, 1 << 40) == [s for s, _, _ in rows]
    mixed = f"{tmp_path}/mixed"
    spark.createDataFrame([*rows, (None, "abcdefgh", 0)], "seq long, text string, other int").repartition(5).write.parquet(mixed)
    costs = [2, *(max(1, len(t) // 4) for _, t, _ in rows)]
    out = pull.pulled(spark, mixed, "seq", "text", tokens, "n", 5000).collect()
    assert {r.seq for r in out} == {None, *(s for s, _, _ in rows[: until(costs, 5000) - 1])}
    empty = f"{tmp_path}/empty"
    spark.createDataFrame([], "seq long, text string").write.parquet(empty)
    assert got(spark, empty, 10) == []


def test_pull_from_a_store_that_only_spark_opens(spark, files):
    rows, path, _ = files
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.pulls.link./in", f"file://{path.removeprefix('file://')}")
    there = "viewfs://pulls/in"
    table = spark.read.parquet(there)
    assert not pull._opens(table.inputFiles()[0]) and pull._opens(f"file://{path}")
    lo = {r.lo for r in pull.splits(table, "seq").collect()}
    assert min(lo) == min(s for s, _, _ in rows) and len(lo) > 1
    for budget in (1, 5000, 1 << 40):
        assert got(spark, there, budget) == got(spark, path, budget)


def test_lines_of_files_in_order(spark, tmp_path):
    rng = random.Random(6)
    lines = {f"{c}.txt": ["y" * rng.randint(0, 60) for _ in range(120)] for c in "cabdef"}
    lines["b.txt"] = [""] * 5
    lines["c d.txt"] = ["abcd" * 20]
    for name, ls in lines.items():
        (tmp_path / name).write_text("\n".join(ls) + "\n")
    flat = [(name, x) for name in sorted(lines) for x in lines[name] if x]
    costs = [max(1, len(x) // 4) for _, x in flat]
    for budget in (1, 300, sum(costs) - 1, 10**9):
        out = pull.pulled_lines(spark, str(tmp_path), T.estimate_tokens, budget).collect()
        n = until(costs, budget)
        assert sorted((r.source.replace("%20", " "), r.text) for r in out) == sorted(flat[:n])
    assert pull.pulled_lines(spark, str(tmp_path), T.estimate_tokens, 0).collect() == []
