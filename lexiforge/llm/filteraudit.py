"""Filter interaction audit: what five filters take from each other in every order.

A document's failures are a set of filters, so counts of documents by part, set and labels, at most 32 x 4 for a part, hold all that the audit needs. Each of these counts goes to the 80 edges of the lattice of subsets: an edge is a set of filters already applied and the next filter. An order of the filters is a path of five edges, and the 600 steps of the 120 orders look their edge up. The order in which the set was applied plays no part, so nothing is counted twice.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables

#: Least words; least per cent of words that are distinct; most per cent of capitals; characters that fail D.
MIN_WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 3, "#$%&*|"
FILTERS = "ABCDE"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> Column:
    """The filters that a text fails by itself, as bits of one number in the order of FILTERS."""
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")
    # One value of a lambda holds the words, so that the text is split once, and another one their counts.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))
    few = F.transform(counts, lambda c: F.when(c["n"] < MIN_WORDS, 1).otherwise(0) + F.when(c["d"] * 100 < c["n"] * DISTINCT, 2).otherwise(0))
    capitals = F.length(text) - F.length(F.translate(text, _AZ, ""))
    loud = F.when(capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITALS, 4).otherwise(0)
    return F.get(few, F.lit(0)) + loud + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def marked(docs: DataFrame, tables: Tables, part: str = "lang") -> DataFrame:
    """part, doc_id and failed of each document.

    A null text is an empty one, a null part an empty string. A text is a copy if a row with a smaller doc_id has the same one (by SHA-256); rows of one doc_id are no copies of each other, and a null doc_id neither is a copy nor makes one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("failed"))
    rows = tables.put(rows, "marked")
    # Least ids are summed up before they are shuffled, and only texts that occur again are looked up.
    repeated = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select(F.col("digest").alias("copied"), "first")
    both = rows.join(repeated, F.col("digest") == F.col("copied"), "left")
    return both.select("part", "doc_id", (F.col("failed") + F.when(F.col("first") < F.col("doc_id"), 16).otherwise(0)).alias("failed"))


def patterns(docs: DataFrame, labels: DataFrame, tables: Tables, part: str = "lang") -> DataFrame:
    """part, failed, good, toxic and n: the numbers of documents by the filters that they fail and by their labels. Labels that repeat an id count once; a document without one is neither good nor toxic."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("labelled"))
    known = known.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = marked(docs, tables, part).join(known, F.col("doc_id") == F.col("labelled"), "left")
    return rows.groupBy("part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))


def lattice() -> Column:
    """The 80 edges as an array: applied (bits), next (a bit), and paths, the number of orders that take the edge."""
    edges = []
    for size in range(len(FILTERS)):
        for chosen in combinations(range(len(FILTERS)), size):
            for f in set(range(len(FILTERS))) - set(chosen):
                edges.append((sum(1 << c for c in chosen), 1 << f, factorial(size) * factorial(len(FILTERS) - 1 - size)))
    return F.array(*(F.struct(F.lit(a).alias("applied"), F.lit(n).alias("next"), F.lit(p).cast("long").alias("paths")) for a, n, p in edges))


def steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, applied and next: the 600 steps of the 120 orders."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    rows = [("".join(p), i + 1, sum(bit[f] for f in p[:i]), bit[p[i]]) for p in permutations(FILTERS) for i in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def edge_counts(counts: DataFrame) -> DataFrame:
    """What each edge of the lattice does in each part, from patterns(): zeros included, as every pattern goes to all 80 edges."""
    both = counts.select("*", F.inline(lattice()))
    fails, before = F.col("failed").bitwiseAND(F.col("next")) > 0, F.col("failed").bitwiseAND(F.col("applied")) > 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    removed = fails & ~before
    return both.groupBy("part", "applied", "next", "paths").agg(
        total(~fails & ~before).alias("kept"),
        total(removed).alias("removed"),
        total(fails & before).alias("redundant"),
        total(F.col("failed") == F.col("next")).alias("unique_fails"),
        total(removed & (F.col("good") == 1)).alias("good_lost"),
        total(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame, tables: Tables, part: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts of each step of each order, with the filter's share: what it removes, over all orders.

    Null and empty texts fail A alone (and E if they repeat). An empty table has no part and gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    edges = edge_counts(patterns(docs, labels, tables, part))
    shares = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    edges = edges.join(shares, ["part", "next"])
    out = edges.join(F.broadcast(steps(spark)), ["applied", "next"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), Tables(spark))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), f AS MATERIALIZED (
  SELECT part, doc_id, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(first < doc_id, false) AS e
  FROM d
), l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT '' AS o UNION ALL SELECT o || x FROM orders JOIN letter ON NOT contains(o, x) WHERE length(o) < 5),
step AS (SELECT o AS filter_order, i AS step, o[i:i] AS x, CASE WHEN i = 1 THEN '' ELSE o[1:i - 1] END AS done FROM orders CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS i) WHERE length(o) = 5),
hit AS (SELECT part, filter_order, step, x, fails, good, toxic, n, contains(fails, x) AS now, done <> '' AND regexp_matches(fails, '[' || CASE WHEN done = '' THEN '_' ELSE done END || ']') AS before FROM m CROSS JOIN step),
r AS (
  SELECT part, filter_order, step, x,
    CAST(coalesce(sum(n) FILTER (WHERE NOT now AND NOT before), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE now AND NOT before), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE now AND before), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE fails = x), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (WHERE now AND NOT before AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (WHERE now AND NOT before AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM hit GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""
