"""Exact top-k inner-product search: a KD-tree per shard, best-first by box bounds, with the kth score carried from shard to shard."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stash

#: Rows in a shard, queries that meet it at a time, and rows in a leaf.
SHARD, QUERIES, LEAF = 8192, 4096, 128
FOUND = "query_id long, vec_id long, score long"


class Tree:
    """Median splits of the widest dimension, tight boxes, leaves of at most LEAF rows; nodes by number, the root is 0."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        lows, highs = [], []

        def build(a: int, b: int) -> int:
            own, node = points[self.order[a:b]], len(self.spans)
            lows.append(own.min(axis=0))
            highs.append(own.max(axis=0))
            self.spans.append((a, b))
            self.children.append(None)
            wide = highs[node] - lows[node]
            d = int(np.argmax(wide))
            if b - a > leaf and wide[d] > 0:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, d], mid)]
                self.children[node] = (build(a, a + mid), build(a + mid, b))
            return node

        build(0, len(points))
        self.points, self.low, self.high = points[self.order], np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Of each query to each box: no inner product with a point in the box is larger."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """For each query the rows that may be among its k best: best-first over boxes, until no box reaches the kth score known."""
    ids, bounds, out = ids[tree.order], tree.bounds(queries), []
    for q, own, floor, bound in zip(queries, query_ids, kth, bounds, strict=True):
        heap, best = [(-bound[0], 0)], []  # best: (score, -vec_id), the least first
        while heap:
            top, node = heapq.heappop(heap)
            if -top < floor or len(best) == k and -top < best[0][0]:
                break
            if tree.children[node]:
                for child in tree.children[node]:
                    heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = tree.spans[node]
            scores = tree.points[a:b] @ q
            least = max(floor, best[0][0] if len(best) == k else -np.inf)
            for i in np.nonzero((scores >= least) & (ids[a:b] != own))[0]:
                item = (scores[i], -ids[a + i])
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        out += [(int(own), int(-v), int(s)) for s, v in best]
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    """Rows of integers, as doubles while every inner product is exact in them, else as Python integers."""
    x = np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)
    top = int(np.abs(x.astype(np.float64)).max(initial=0))
    return x.astype(np.float64) if top * top * max(1, x.shape[1]) < 1 << 53 else x.astype(object)


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, q, dim): floor(scale * x) of each component, for vectors without null or non-finite components and with an id."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    fine = x.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return fine.select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("q"), F.size("x").alias("dim"))


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query over base rows of its dimension but its own id.

    Both frames have vec_id, q, dim. Ties go to the smaller vec_id. Repeated rows of an id are candidates each. Fewer
    candidates than k give fewer rows. Scores are exact integers (beyond 64 bits they wrap).

    Shards are dealt by a hash and hold about `shard` rows. Each query first searches the shard of its own hash; its kth
    score there is the floor with which it searches the others, in blocks of bounded size: a shard and some queries.
    """
    spark = base.sparkSession
    base, queries = stash(base, "topk-base"), stash(queries.dropDuplicates(["vec_id"]), "topk-queries")
    n, m = base.count(), queries.count()
    shards, chunks = max(1, -(-n // shard)), max(1, -(-m // QUERIES))
    of = lambda c, x, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(x)).cast("int")
    rows = base.withColumn("shard", of("vec_id", shards, 1))
    asks = queries.select(F.col("vec_id").alias("query_id"), "q", "dim", of("vec_id", shards, 1).alias("home"), of("vec_id", chunks, 2).alias("chunk"))

    def block(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            found = []
        else:
            points, q = _matrix(left["q"]), _matrix(right["q"])
            if points.dtype == object or q.dtype == object:
                points, q = points.astype(object), q.astype(object)
            floor = right["floor"].fillna(-np.inf).to_numpy(np.float64) if points.dtype != object else np.full(len(right), -np.inf)
            found = search(Tree(points), left["vec_id"].to_numpy(np.int64), q, right["query_id"].to_numpy(np.int64), floor, k)
        return pd.DataFrame([(a, b, ((s + (1 << 63)) % (1 << 64)) - (1 << 63)) for a, b, s in found], columns=["query_id", "vec_id", "score"]).astype("int64")

    def met(asked: DataFrame) -> DataFrame:
        """Every (shard, chunk) group of asked queries with the shard's rows."""
        spread = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        return spread.groupBy("dim", "shard", "chunk").cogroup(asked.groupBy("dim", "shard", "chunk")).applyInPandas(block, FOUND)

    first = stash(met(asks.select("query_id", "q", "dim", F.col("home").alias("shard"), "chunk", F.lit(None).cast("double").alias("floor"))), "topk-home")
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).select("query_id", F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
    others = asks.join(floors, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").drop("home")
    found = first.unionByName(stash(met(others), "topk-others")) if shards > 1 else first
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)  # at most k rows of each shard
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.s")).alias("score"))


def op4_kdtree_topk(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP4_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
