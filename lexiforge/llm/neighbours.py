"""Nearest neighbours by a block matrix join.

Vectors are packed into tiles: int8 components with a scale for each vector, the rounding error's norm, and the floats. Every tile of queries meets every tile of candidates once. The int8 product of two tiles, with the error bound, rules out most pairs; the others are computed again in double precision from the original vectors. A task keeps a heap of the k best for each query over all of its pairs of tiles, whose worst entry rules out more pairs of the next ones, and the tasks' heaps are merged.

Bounds are computed on vectors divided by powers of two, so that components of any size neither overflow nor vanish in them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import one

QUERY_ROWS, TILE_ROWS = 512, 4096
#: Queries whose heaps a task holds; beyond, it hands them on and begins anew.
HELD_QUERIES = 50_000
TILE = "dim int, ids binary, quantised binary, scale binary, error binary, exponent binary, vectors binary"


def _tiles(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def tile(dim: int, take: int) -> pa.RecordBatch:
            ids, v = (np.concatenate(x) for x in zip(*held[dim], strict=True))
            held[dim] = [(ids[take:], v[take:])]
            ids, v = ids[:take], v[:take]
            d, exponent = scaled(v)
            scale = np.abs(d).max(axis=1) / 127
            whole = np.rint(d / scale[:, None])
            error = np.sqrt(((d - whole * scale[:, None]) ** 2).sum(axis=1))
            parts = [ids, whole.astype(np.int8), scale, error, exponent, v]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], [c.split()[0] for c in TILE.split(", ")])

        for b in batches:
            ids, lists = np.asarray(b.column(0), dtype=np.int64), b.column(1)
            size = np.asarray(pc.list_value_length(lists))
            flat, ends = np.asarray(lists.flatten()), np.append(0, np.cumsum(size))
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                v = flat[ends[at][:, None] + np.arange(dim)]
                held.setdefault(int(dim), []).append((ids[at], v))
                while sum(len(x) for x, _ in held[int(dim)]) >= rows:
                    yield tile(int(dim), rows)
        for dim in held:
            if n := sum(len(x) for x, _ in held[dim]):
                yield tile(dim, n)

    return run


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by a power of two each, so that the largest component is between a half and 1, and the exponents. Exact but for components that are 2^1000 times smaller than the largest."""
    exponent = np.frexp(np.abs(v).max(axis=1).astype(np.float64))[1].astype(np.int32)
    # In two steps: a single factor of 2^1074 is out of range.
    half = exponent // 2
    return np.ldexp(np.ldexp(v.astype(np.float64), -half[:, None]), (half - exponent)[:, None]), exponent


def _opened(row: dict, side: str, kind) -> tuple:
    dim = row["dim"]
    ids, scale, error = np.frombuffer(row[f"{side}ids"], np.int64), np.frombuffer(row[f"{side}scale"]), np.frombuffer(row[f"{side}error"])
    return ids, np.frombuffer(row[f"{side}quantised"], np.int8).reshape(-1, dim), scale, error, np.frombuffer(row[f"{side}exponent"], np.int32), np.frombuffer(row[f"{side}vectors"], kind).reshape(-1, dim)


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, equal for equal rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (q.astype(np.float64) * v.astype(np.float64)).sum(axis=1)


def survivors(row: dict, k: int, kind, worst: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two tiles: query, candidate and exact score of the pairs that the bounds do not rule out. worst: the least score that a query's full heap has so far."""
    qi, q8, qs, qe, qx, q = _opened(row, "q_", kind)
    ci, c8, cs, ce, cx, c = _opened(row, "", kind)
    # Products of int8 components are whole numbers below 2^24 for up to 1,000 dimensions, and exact in floats of the type used.
    wide = np.float32 if row["dim"] <= 1000 else np.float64
    whole = (q8.astype(wide) @ c8.astype(wide).T).astype(np.float64)
    near = whole * qs[:, None] * cs[None, :]
    qn, cn = (np.sqrt((scaled(x)[0] ** 2).sum(axis=1)) for x in (q, c))
    # q.c - q'.c' = (q - q').c + q'.(c - c'), and |q'| <= |q| + |q - q'|; the last factor covers rounding.
    bound = (qe[:, None] * cn[None, :] + (qn + qe)[:, None] * ce[None, :]) * (1 + 1e-6) + 1e-9 * qn[:, None] * cn[None, :]
    # In units of the tile's largest candidate exponent; what vanishes there is covered by the least normal number.
    unit = np.ldexp(1.0, cx - cx.max())
    high, low = (near + bound) * unit + 1e-300, (near - bound) * unit - 1e-300
    own = qi[:, None] == ci[None, :]
    low = np.where(own, -np.inf, low)
    # Rows of one id count once, so the k-th bound is taken over more candidates where ids repeat.
    repeats = len(ci) - len(np.unique(ci))
    if len(ci) > k + repeats:
        least = np.partition(low, len(ci) - k - repeats, axis=1)[:, len(ci) - k - repeats]
    else:
        least = np.full(len(qi), -np.inf)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        held = np.array([worst.get(i, -np.inf) for i in qi.tolist()])
        held = np.ldexp(held, -(qx + cx.max()))
        # Only finite scores of ordinary size rule anything out.
        least = np.maximum(least, np.where(np.isfinite(held) & (np.abs(held) > 1e-290), held - np.abs(held) * 1e-9, -np.inf))
    # Where a double could overflow or vanish, its order is not that of the bounds, and all pairs survive.
    size = qx + cx.max()
    least[(size > 1000) | (size < -900)] = -np.inf
    a, b = np.nonzero((high >= least[:, None]) & ~own)
    return qi[a], ci[b], exact(q[a], c[b])


class Heaps:
    """The k best candidates of each query, ties to the smaller id; an id counts once, by its best score. A score that is no number is the least."""

    def __init__(self, k: int):
        self.k, self.best, self.heap, self.worst = k, {}, {}, {}

    def push(self, query: int, candidate: int, score: float) -> None:
        best, heap = self.best.setdefault(query, {}), self.heap.setdefault(query, [])
        key = (-np.inf if score != score else score, -candidate)
        old = best.get(candidate)
        if old is not None:
            if key > old[0]:
                best[candidate] = (key, score)
                heapq.heappush(heap, key)
        elif len(best) < self.k:
            best[candidate] = (key, score)
            heapq.heappush(heap, key)
        else:
            self._tidy(best, heap)
            if key > heap[0]:
                del best[-heapq.heapreplace(heap, key)[1]]
                best[candidate] = (key, score)
        if len(best) == self.k:
            self._tidy(best, heap)
            self.worst[query] = heap[0][0]

    @staticmethod
    def _tidy(best: dict, heap: list) -> None:
        """Entries that a better one of their id has replaced go from the top."""
        while best[-heap[0][1]][0] != heap[0]:
            heapq.heappop(heap)

    def emptied(self) -> pa.RecordBatch:
        rows = [(q, c, s) for q, best in self.best.items() for c, (_, s) in best.items()]
        self.best, self.heap, self.worst = {}, {}, {}
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["query_id", "vec_id", "score"])


def _joined(k: int, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)
        for batch in batches:
            for row in range(len(batch)):
                q, c, s = survivors(batch.slice(row, 1).to_pylist()[0], k, kind, heaps.worst)
                # Best first, so that most of the others end at a full heap.
                order = np.argsort(-np.where(np.isnan(s), -np.inf, s), kind="stable")
                for x in zip(q[order].tolist(), c[order].tolist(), s[order].tolist(), strict=True):
                    if not x[2] < heaps.worst.get(x[0], -np.inf):
                        heaps.push(*x)
                if len(heaps.best) > HELD_QUERIES:
                    yield heaps.emptied()
        yield heaps.emptied()

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest candidates by inner product, ties to the smaller id. The result is exact.

    Both tables have vec_id and embedding. Rows with a null id or vector, an empty or zero vector, or a null or non-finite component take no part; vectors of different length are never compared; rows of one vec_id count as one candidate (the nearest), and none of them is a candidate of its own id's query. Products beyond the range of doubles are infinite, and a sum that is no number comes last.
    """
    spark = candidates.sparkSession
    element = candidates.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)

    def tiled(df: DataFrame, rows: int) -> DataFrame:
        typed = df.filter(good).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>"))
        return typed.mapInArrow(_tiles(rows), TILE)

    # A candidate tile has one salt; the query tiles, a twentieth of the rows, go to every salt.
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = tiled(candidates, TILE_ROWS).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    q = tiled(queries, QUERY_ROWS)
    q = q.select(F.col("dim").alias("q_dim"), *[F.col(x).alias(f"q_{x}") for x in q.columns[1:]], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("q_salt"))
    pairs = c.join(q.hint("merge"), (F.col("salt") == F.col("q_salt")) & (F.col("dim") == F.col("q_dim"))).drop("salt", "q_salt", "q_dim")
    heaps = pairs.mapInArrow(_joined(k, kind), "query_id long, vec_id long, score double")
    number = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    best = heaps.groupBy("query_id", "vec_id").agg(F.max_by("score", number).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(number), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows.filter(F.col("vec_id") % 20 == 0), rows)
