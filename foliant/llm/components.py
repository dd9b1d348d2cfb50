"""Connected components over an edge table, by large-star / small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stash, unstash

#: With at most so many edges left (16 bytes each), one task joins them by union-find.
FINISH_EDGES = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((root(int(x)) for x in nodes), np.int64, len(nodes))
    for i in range(0, len(nodes), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 65536]), pa.array(roots[i : i + 65536])], ["node", "root"])


def connected_components(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """(u, v) long pairs in, (node, root) out: root is the smallest node reachable. Nodes without edges do not appear.

    Each round is two aggregations on a key with partial sums before the shuffle, and a join that adaptive
    execution may split, so a node with very many edges is no hot task; each round's edges are a written table.
    The rounds contract the graph to stars; once few edges are left, one task with bounded memory ends it.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stash(e, "cc")
    spark, last = e.sparkSession, None
    while True:
        n = e.count()
        if n <= finish_edges:
            return e.coalesce(1).mapInArrow(_union_find, "node long, root long") if n else e.selectExpr("u node", "v root")
        # large star: every neighbour above u is tied to the smallest neighbour of u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and every neighbour below it are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = stash(small, "cc")
        total = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstash(e)
        e = nxt
        if tuple(total) == last:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        last = tuple(total)
