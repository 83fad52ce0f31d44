"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def components(edges: DataFrame, tables: Tables, name: str = "components") -> DataFrame:
    """v and c for each vertex of edges (a, b): c is the least vertex of its component.

    Least labels spread over the edges, and labels jump to their label's label, so paths halve in each round. Every round is a table in the shared folder; only counts reach the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = tables.put(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), f"{name}0")
    turn = 0
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).select(F.col("a").alias("v"), "c", F.lit(None).cast("long").alias("own"))
        least = near.unionByName(labels.select("v", "c", F.col("c").alias("own"))).groupBy("v").agg(F.min("c").alias("m"), F.max("own").alias("own"))
        up = labels.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
        new = least.join(up, F.col("m") == F.col("_v"), "left").select("v", F.least("m", F.coalesce("_c", "m")).alias("c"), "own")
        turn += 1
        after = tables.put(new, f"{name}{turn}")
        tables.drop(f"{name}{turn - 1}")
        labels = after.select("v", "c")
        if not after.filter("c <> own").limit(1).count():
            return labels


def roots(edges: DataFrame, tables: Tables, name: str = "roots") -> DataFrame:
    """v and c for each b of edges (a, b), of which each has one edge and a < b: c is the root of its tree."""
    labels, turn = tables.put(edges.select(F.col("b").alias("v"), F.col("a").alias("c")), f"{name}0"), 0
    while True:
        up = labels.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
        new = labels.join(up, F.col("c") == F.col("_v"), "left").select("v", F.coalesce("_c", "c").alias("c"), F.col("_c").isNotNull().alias("moved"))
        turn += 1
        after = tables.put(new, f"{name}{turn}")
        tables.drop(f"{name}{turn - 1}")
        labels = after.select("v", "c")
        if not after.filter("moved").limit(1).count():
            return labels
