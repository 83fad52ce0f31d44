"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws -ln(u) / weight from a hash of key and child, and the least draw wins, so a child gets keys in proportion to its weight and a change of one weight moves keys only into or out of that child. A new shard in a region of its own therefore takes keys only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import column_without_clash


@dataclass(frozen=True)
class Node:
    """A node of the tree: a leaf has a shard number, any other node children. Names are unique in a tree."""

    name: str
    shard: int | None = None
    own_weight: float = 1.0
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(regions: int = 2, racks: int = 3, shards: int = 4) -> Node:
    """A tree of regions * racks * shards shards of equal weight, numbered from 0."""
    numbers = iter(range(regions * racks * shards))
    return Node("root", children=tuple(Node(f"r{r}", children=tuple(Node(f"r{r}k{k}", children=tuple(Node(f"s{n}", n) for n in (next(numbers) for _ in range(shards)))) for k in range(racks))) for r in range(regions)))


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    n = 1 + max(leaves(root))
    return Node(root.name, children=(*root.children, Node(f"r+{n}", children=(Node(f"r+{n}k", children=(Node(f"s{n}", n, weight),)),))))


def leaves(node: Node) -> list[int]:
    return [node.shard] if node.shard is not None else [s for c in node.children for s in leaves(c)]


def _draw(key: Column, node: Node, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(node.weight)


def shard_of(key: Column, node: Node, seed: int = 7) -> Column:
    """The shard that a key descends to. Children of weight 0 get nothing; a null key is a key of its own."""
    if node.shard is not None:
        return F.lit(node.shard)
    children = [c for c in node.children if c.weight > 0]
    if len(children) == 1:
        return shard_of(key, children[0], seed)
    least = F.array_min(F.array(*[F.struct(_draw(key, c, seed).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(children)]))["i"]
    # The winner is compared by number; each level's draws are evaluated once per key.
    out = shard_of(key, children[-1], seed)
    for i in reversed(range(len(children) - 1)):
        out = F.when(least == i, shard_of(key, children[i], seed)).otherwise(out)
    return out


def with_slots(df: DataFrame, shard: str, order: list[str], rows_a_bucket: int = 50_000) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard. Shards are cut into hash buckets of bounded size, so no task holds a whole shard."""
    n = df.count()
    buckets = max(1, -(-n // rows_a_bucket))
    b = column_without_clash(df, "_bucket")
    df = df.withColumn(b, F.pmod(F.xxhash64(F.lit(11), *order), F.lit(buckets)))
    inside = Window.partitionBy(shard, b)
    if buckets == 1:
        return df.withColumn("slot", F.row_number().over(inside.orderBy(*order)).cast("long") - 1).drop(b)
    sizes = df.groupBy(shard, b).agg(F.count("*").alias("_n"))
    before = sizes.select(shard, b, (F.sum("_n").over(Window.partitionBy(shard).orderBy(b)) - F.col("_n")).alias("_before"))
    ranked = df.withColumn("_rank", F.row_number().over(inside.orderBy(*order)).cast("long") - 1)
    return ranked.join(before, [shard, b]).withColumn("slot", F.col("_rank") + F.col("_before")).drop(b, "_rank", "_before")


def shard_documents(docs: DataFrame, root: Node | None = None, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; a null text has 8 and crc32 0, as an empty one. Rows of one doc_id go to one shard, each with its own slot; null doc_ids share a shard. An empty table gives an empty result. Other columns of docs play no part.
    """
    root = root or tree()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), root, seed).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), grown(root), seed).cast("int").alias("grown_shard"),
    )
    out = with_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
