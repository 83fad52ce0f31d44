"""Benchmark decontamination: which documents hold a test item, by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles (bands of powers of two). An item's sketch is its least shingle hashes, as many as its band needs: a document with a share t of an item's n shingles lacks at most n - ceil(t n) of them, so it holds one of any n - ceil(t n) + 1. A document probes the sketches of the bands that its own size can contain; every hit is verified by exact shingle containment. Long documents and short items have a Jaccard similarity near 0, for which banded MinHash would lose matches; these sketches lose none.

The main path is DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables

WORDS, PERCENT = 5, 80
#: Sketch rows or candidate pairs up to which a side is broadcast; beyond, the same join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of all items' texts up to which they are broadcast.
BROADCAST_BYTES = 8_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[ \t-\r]+"), lambda w: w != "")


def _starts(words: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.size(words) - (WORDS - 1), F.lit(1)))


def shingle_texts(words: Column) -> Column:
    """Distinct shingles; fewer words than a shingle has are one shingle, no words none."""
    return F.when(F.size(words) > 0, F.array_distinct(F.transform(_starts(words), lambda i: F.concat_ws(" ", F.slice(words, i, WORDS))))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(hashes: Column) -> Column:
    """A hash of each shingle, in order, from an array of word hashes."""
    whole = F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WORDS)]))
    return F.when(F.size(hashes) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    words = df.select(*keep, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("_h"))
    return words.select(*keep, shingle_hashes(F.col("_h")).alias("_s"))


def _shingled(df: DataFrame, *keep: str) -> DataFrame:
    # The words are a column of their own: inside the function of an array they would be split again for each shingle.
    words = df.select(*keep, words_of(F.col("text")).alias("_w"))
    return words.select(*keep, shingle_texts(F.col("_w")).alias("_t"))


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each hash in an item's sketch: item_id, hash, and the least size of a document that can hold the item."""
    sets = _hashed(items, "item_id").select("item_id", F.array_sort(F.array_distinct("_s")).alias("s"))
    n = F.size("s")  # no filter on it, nor explode(): both would be pushed below the arrays and compute them again
    top = F.pow(F.lit(2), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) + 1).cast("int") - 1  # the band's largest size
    take = top - F.ceil(top * percent / F.lit(100.0)).cast("int") + 1
    least = F.ceil(((top + 1) / 2) * percent / F.lit(100.0)).cast("int")
    rows = sets.select("item_id", least.alias("least"), F.explode_outer(F.slice("s", F.lit(1), F.greatest(F.least(take, n), F.lit(0)))).alias("hash"))
    return rows.filter("hash is not null").distinct()


def contaminated(docs: DataFrame, items: DataFrame, tables: Tables, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_item for each document that holds at least `percent` of an item's distinct 5-word shingles.

    Null or empty texts hold nothing and are held by nothing; texts of fewer than five words are one shingle. Null ids take no part. Rows that repeat an id count as one: a pair is given once, for the row that shares most. An empty table gives no rows.
    """
    docs, items = docs.select("doc_id", "text").filter("doc_id is not null"), items.select("item_id", "text").filter("item_id is not null")
    index = tables.put(sketches(items, percent), "sketches")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bounded = index.count() <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    probes = _hashed(docs, "doc_id").select("doc_id", F.size("_s").alias("_n"), F.explode_outer("_s").alias("_hash"))
    hits = probes.join(F.broadcast(index) if bounded else index, (F.col("_hash") == F.col("hash")) & (F.col("_n") >= F.col("least")))
    pairs = tables.put(hits.select("doc_id", "item_id").distinct(), "candidates")
    few = pairs.count() <= BROADCAST_ROWS
    held = _shingled(items, "item_id").select("item_id", F.explode(F.array("_t")).alias("_item"))
    each = pairs.join(F.broadcast(held) if bounded else held, "item_id")
    here = docs.join((F.broadcast if few else lambda x: x)(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = _shingled(here, "doc_id").withColumnRenamed("_t", "_doc")
    both = each.join(sets, "doc_id").select("doc_id", "item_id", F.size(F.array_intersect("_item", "_doc")).alias("n_shared"), F.size("_item").alias("n_item"))
    kept = both.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_item")


def clean(docs: DataFrame, items: DataFrame, tables: Tables, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no test item, with all columns. Each row goes or stays by its own text (by a hash of it), whatever its id; null and empty texts stay."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text").filter("text is not null")
    found = tables.put(contaminated(texts, items, tables, percent).select(F.col("doc_id").alias("_held")).distinct(), "contaminated")
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rows = docs.select(F.struct("*").alias("_in"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("_text"))
    return rows.join(side, F.col("_text") == F.col("_held"), "left_anti").select("_in.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Tables(spark))


OP2_SQL = r"""
WITH w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS words
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark) t
), s AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle
  FROM w WHERE len(words) > 0
), n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(any_value(n_item) AS INTEGER) AS n_item
FROM s i JOIN s d ON i.shingle = d.shingle AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) * 100 >= any_value(n_item) * 80
"""
