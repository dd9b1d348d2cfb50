"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours; blocks of each label complete its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, stash, unstash
from foliant.llm.components import connected_components

#: Neighbours a node keeps at first, and at most when all it has are links. Links beyond that come from the last, exact step.
K, K_MAX = 12, 48
#: Random orders for the first graph, rows compared in one stretch of an order, rounds of refinement at most.
ORDERS, STRETCH, ROUNDS = 4, 64, 4
#: Rows in a block of the exact step: of a part that is up to eight of them, and of the largest.
BLOCK, BLOCK_MAX = 2048, 8192
EDGE = "u long, v long, sim double, fresh boolean"


def _unit(blobs: list[bytes]) -> np.ndarray:
    """Vectors from bytes of doubles, scaled to length one."""
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows (vec_id, node or null), nodes (node, part, vec): one for each different vector of a label.

    part: the label and dimension. A vector that is null, empty, zero or holds null or non-finite components has no node.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs = []
        for label, x in zip(batch.column("label").to_pylist(), batch.column("x").to_pylist(), strict=True):
            fine = label is not None and x and None not in x
            a = np.array(x, np.float64) if fine else None
            blobs.append(a.tobytes() if fine and np.isfinite(a).all() and a.any() else None)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(blobs, pa.binary())], ["vec_id", "label", "vec"])

    lean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    raw = arrow_map(lean, run, "vec_id long, label string, vec binary")
    part = F.xxhash64("label", F.octet_length("vec"))
    rows = stash(raw.select("vec_id", F.when(F.col("vec").isNotNull(), part).alias("part"), F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")).alias("node"), "vec"), "nn-rows")
    return rows.select("vec_id", "node"), stash(rows.where("node is not null").groupBy("node").agg(F.first("part").alias("part"), F.first("vec").alias("vec")), "nn-nodes")


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, sim) of the k nearest other rows of each row."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-sims, axis=1)[:, :k]
    u = np.repeat(np.arange(len(ids)), k)
    v = near.ravel()
    return ids[u], ids[v], sims[u, v]


def first_graph(nodes: DataFrame, seed: int) -> DataFrame:
    """Neighbours within overlapping stretches of a few orders by the signs of random projections, each part for itself.

    The orders are range-partitioned, so a large part is many tasks.
    """

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, ids, blobs = (batch.column(c).to_pylist() for c in ("part", "node", "vec"))
        out: tuple[list, ...] = ([], [], [], [], [])
        by_size: dict[int, list[int]] = {}
        for i, b in enumerate(blobs):
            by_size.setdefault(len(b), []).append(i)
        for size, rows in by_size.items():
            x = _unit([blobs[i] for i in rows])
            for order in range(ORDERS):
                planes = np.random.default_rng([seed, order, size]).normal(size=(x.shape[1], 24))
                code = ((x @ planes > 0) << np.arange(23, -1, -1)).sum(axis=1)
                for i, c in zip(rows, code.tolist(), strict=True):
                    for col, value in zip(out, (order, parts[i], c, ids[i], blobs[i]), strict=True):
                        col.append(value)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["ord", "part", "code", "node", "vec"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0

        def near(rows: list) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                u, v, s = _top((x := _unit([r[2] for r in rows])) @ x.T, np.array([r[1] for r in rows], np.int64), K)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s), pa.array(np.ones(len(u), bool))], ["u", "v", "sim", "fresh"])

        for batch in batches:
            for row in zip(zip(batch.column("ord").to_pylist(), batch.column("part").to_pylist(), strict=True), batch.column("node").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                if held and row[0] != held[-1][0]:
                    yield from near(held) if fresh else ()
                    held, fresh = [], 0
                held.append(row)
                fresh += 1
                if len(held) == STRETCH:
                    yield from near(held)
                    held, fresh = held[STRETCH // 2 :], 0
        yield from near(held) if fresh else ()

    by_code = arrow_map(nodes.select("node", "part", "vec"), coded, "ord int, part long, code long, node long, vec binary")
    return by_code.repartitionByRange("ord", "part", "code", "node").sortWithinPartitions("ord", "part", "code", "node").mapInArrow(stretches, EDGE)


def nearest(edges: DataFrame, threshold: float) -> DataFrame:
    """Each node's nearest: K of them, and up to K_MAX where the first K are links (the list is saturated). Old edges stay old."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = one.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("n") <= K_MAX)
    return ranked.where((F.col("n") <= K) | (F.col("sim") >= threshold)).select("u", "v", "sim", "fresh")


def refine(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates from neighbours of neighbours: each node gets the vectors of those it lists and of some that list it, and pairs them.

    Only pairs with a fresh edge count, and only those nearer than the farthest neighbour of either end.
    """
    floor = graph.groupBy("u").agg(F.min("sim").alias("floor"))
    ahead = graph.select(F.col("u").alias("m"), F.col("v").alias("n"), "fresh")
    pick = Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("u", "v"))
    behind = graph.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= K_MAX).select(F.col("v").alias("m"), F.col("u").alias("n"), "fresh")
    told = ahead.unionByName(behind).groupBy("m", "n").agg(F.max("fresh").alias("fresh"))
    known = nodes.select(F.col("node").alias("n"), "vec").join(floor.withColumnRenamed("u", "n"), "n", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)))
    sent = told.join(known, "n").select("m", "n", "fresh", "floor", "vec")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def met(rows: list) -> Iterator[pa.RecordBatch]:
            if len(rows) < 2 or not any(r[2] for r in rows):
                return
            ids, fresh, floors = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
            sims = (x := _unit([r[4] for r in rows])) @ x.T
            np.fill_diagonal(sims, -2)
            u, v = np.nonzero((sims > floors[:, None]) & (fresh[:, None] | fresh[None, :]))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v]), pa.array(sims[u, v]), pa.array(np.ones(len(u), bool))], ["u", "v", "sim", "fresh"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    yield from met(held)
                    held = []
                held.append(row)
        yield from met(held)

    return sent.repartition("m").sortWithinPartitions("m", "n").mapInArrow(pair, EDGE)


def _exact(nodes: DataFrame, roots: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """Every pair of nodes of a part, a pair of blocks a task: (node, n, null), rows of other nodes linked with each node, and
    (root, null, root) for two components of the graph that a link joins. Only counts and these leave a task.
    """
    rooted = nodes.join(roots, "node", "left").join(weights, "node").select("part", "node", "vec", "rows", F.coalesce("root", "node").alias("root"))
    count = F.count("*")
    sizes = nodes.groupBy("part").agg(F.greatest(F.ceil(count / BLOCK_MAX), F.least(F.ceil(count / BLOCK), F.lit(8))).cast("int").alias("blocks"))
    own = rooted.join(sizes, "part").withColumn("own", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
    # a block meets every block of its part
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = met.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "vec", "rows", "root")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def met(rows: list) -> Iterator[pa.RecordBatch]:
            sides = [[r for r in rows if r[3] == k] for k in dict.fromkeys(rows[0][1:3])]
            if not all(sides):
                return
            one, two = sides[0], sides[-1]
            x, y = (_unit([r[5] for r in side]) for side in (one, two))
            (wx, wy), (rx, ry) = ([np.array([r[c] for r in side], np.int64) for side in (one, two)] for c in (6, 7))
            nx, ny, joined = np.zeros(len(one), np.int64), np.zeros(len(two), np.int64), set()
            for at in range(0, len(one), 512):
                u, v = np.nonzero(x[at : at + 512] @ y.T >= threshold)
                u += at
                if one is two:
                    u, v = u[u != v], v[u != v]
                np.add.at(nx, u, wy[v])
                if one is not two:
                    np.add.at(ny, v, wx[u])
                apart = rx[u] != ry[v]
                joined.update(zip(rx[u[apart]].tolist(), ry[v[apart]].tolist(), strict=True))
            ids = [r[4] for r in one] + ([] if one is two else [r[4] for r in two])
            n = nx.tolist() + ([] if one is two else ny.tolist())
            some = [(i, k, None) for i, k in zip(ids, n, strict=True) if k] + [(a, None, b) for a, b in joined]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*some, strict=True) if some else ((), (), ()))], ["node", "n", "other"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[-1][:3]:
                    yield from met(held)
                    held = []
                held.append(row)
        if held:
            yield from met(held)

    return tiles.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "own").mapInArrow(links, "node long, n long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Link vectors of one label whose cosine (double precision) is at least `threshold`.

    Returns vec_id, n_links, component_id, kept for each row. Vectors that are null, empty, zero or hold null or
    non-finite components, and those without a label, link with nothing and are their own component. Equal vectors of a
    label are one node, so copies cost nothing; they link with each other. Vectors of different dimensions never link. A
    null vec_id keeps its row, and is a component_id only where no other is. Extra columns are ignored.

    The graph starts from random orders and is refined until few edges are new; its links give components. A node's list
    is bounded and a search may miss links, so then all pairs of a label are checked in blocks: that gives the counts, and
    links that the graph lacks join its components. The result is exact; this step grows with the square of a label's vectors.
    """
    spark = vectors.sparkSession
    rows, nodes = nodes_of(vectors)
    weights = stash(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("rows"), F.min("vec_id").alias("least")), "nn-weights")
    n, graph = nodes.count(), stash(nearest(first_graph(nodes, 0), threshold), "nn-graph")
    for _ in range(ROUNDS):
        found = refine(graph, nodes).unionByName(graph.withColumn("fresh", F.lit(False)))
        grown = stash(nearest(found, threshold), "nn-graph")
        unstash(graph)
        graph = grown
        if graph.where("fresh").count() <= 0.002 * K * n:
            break
    roots = stash(connected_components(graph.where(F.col("sim") >= threshold).select("u", "v")), "nn-roots")
    unstash(graph)
    exact = stash(_exact(nodes, roots, weights, threshold), "nn-exact")
    counts = exact.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    merged = stash(connected_components(exact.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))), "nn-merged")
    within = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("part_root"))
    roots = within.join(merged.select(F.col("node").alias("part_root"), "root"), "part_root", "left").select("node", F.coalesce("root", "part_root").alias("root"))
    of_node = weights.join(roots, "node", "left").join(counts, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    of_node = stash(of_node, "nn-counts")
    least = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.join(of_node.join(least, "root").select("node", "n_links", "component_id"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9_nn_descent(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
), f AS (
  SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS n FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0
), e AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM f a JOIN f b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.98
), r(u, w) AS (SELECT u, w FROM e UNION SELECT r.u, e.w FROM r JOIN e ON r.w = e.u
), c AS (SELECT v.vec_id, least(v.vec_id, coalesce((SELECT min(w) FROM r WHERE r.u = v.vec_id), v.vec_id)) AS component_id FROM v)
SELECT c.vec_id, (SELECT count(*) FROM e WHERE e.u = c.vec_id)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
