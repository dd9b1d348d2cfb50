"""Ruled tables from rule lines: like rules joined, crossings, the grid between them, cells, tables and boxes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.operators import fold
from foliant.operators.layout import outside
from foliant.operators.raster import components
from foliant.session import cut

PAGE = ["doc_id", "page_no"]
RIGHT, DOWN, LEFT, UP = 0, 1, 2, 3


def acceptable(rules: DataFrame, width: float, height: float) -> DataFrame:
    """Rules of a usual length: 1/30 to 9/10 of the width for horizontal ones, 1/75 to 9/10 of the height for others."""
    n, flat = F.col("v1") - F.col("v0"), F.col("orient") == "H"
    return rules.where((flat & (n > width / 30) & (n < 0.9 * width)) | (~flat & (n > height / 75) & (n < 0.9 * height)))


def joined_rules(rules: DataFrame, near: float = 8.0) -> DataFrame:
    """Rules of a page that chain within `near` of one another become one: mean offset (cut to whole), least and greatest end."""
    by = [*PAGE, "orient"]
    listed = rules.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("c", "v0", "v1"))).alias("r"))
    one = listed.select(*by, F.posexplode("r").alias("k", "p")).select(*by, "k", "p.*")
    cell = F.floor(F.col("c") / (near / 2))
    other = one.select(*by, cell.alias("cell"), *(F.col(c).alias(f"o_{c}") for c in ("k", "c", "v0", "v1")))
    dist = G.rule_distance(*map(F.col, ("c", "v0", "v1", "o_c", "o_v0", "o_v1")))
    pairs = one.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).join(other, [*by, "cell"]).where((F.col("k") < F.col("o_k")) & (dist <= near))
    edges = pairs.groupBy(*by).agg(F.collect_list(F.struct(F.col("k").alias("a"), F.col("o_k").alias("b"))).alias("e"))
    named = listed.join(edges, by, "left").withColumn("label", fold.labels(F.size("r"), F.coalesce("e", F.array().cast("array<struct<a:int,b:int>>"))))
    flat = named.select(*by, F.explode(F.arrays_zip("r", "label")).alias("z")).select(*by, "z.label", "z.r.*")
    return flat.groupBy(*by, "label").agg(F.avg("c").cast("int").cast("double").alias("c"), F.min("v0").alias("v0"), F.max("v1").alias("v1")).drop("label")


def crossings(rules: DataFrame, slack: float = 5.0) -> DataFrame:
    """Points where a vertical and a horizontal rule of a page meet, up to `slack` beyond their ends."""
    v = rules.where("orient = 'V'").select(*PAGE, F.col("c").alias("x"), F.col("v0").alias("a0"), F.col("v1").alias("a1"))
    h = rules.where("orient = 'H'").select(*PAGE, F.col("c").alias("y"), F.col("v0").alias("b0"), F.col("v1").alias("b1"))
    inside = lambda x, lo, hi: (F.col(x) > F.col(lo) - slack) & (F.col(x) < F.col(hi) + slack)
    return v.join(h, PAGE).where(inside("y", "a0", "a1") & inside("x", "b0", "b1")).select(*PAGE, "x", "y").distinct()


def covered(rules: DataFrame) -> DataFrame:
    """Rules of one offset that overlap or touch as one, so that no stretch counts twice."""
    w = Window.partitionBy(*PAGE, "orient", "c").orderBy("v0", "v1")
    reach = F.max("v1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = rules.withColumn("_s", F.when(F.col("v0") <= reach, 0).otherwise(1)).withColumn("_g", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return starts.groupBy(*PAGE, "orient", "c", "_g").agg(F.min("v0").alias("v0"), F.max("v1").alias("v1")).drop("_g")


def grid(points: DataFrame, rules: DataFrame, slack: float = 5.0) -> DataFrame:
    """Neighbouring points of a row or column that rules join: covered for all but under `slack` of their distance."""
    out, rules = [], covered(rules)
    for orient, fixed, along in (("H", "y", "x"), ("V", "x", "y")):
        near = points.withColumn("to", F.lead(along).over(Window.partitionBy(*PAGE, fixed).orderBy(along))).where("to is not null")
        r = rules.where(F.col("orient") == orient).select(*PAGE, F.col("c").alias(fixed), "v0", "v1")
        part = F.greatest(F.lit(0.0), F.least("to", "v1") - F.greatest(F.col(along), F.col("v0")))
        held = near.join(r, [*PAGE, fixed]).groupBy(*PAGE, "x", "y", "to").agg(F.sum(part).alias("n"))
        linked = held.where(F.col("n") > F.col("to") - F.col(along) - slack)
        x1, y1 = ("to", "y") if orient == "H" else ("x", "to")
        out.append(linked.select(*PAGE, "x", "y", F.col(x1).alias("x1"), F.col(y1).alias("y1")))
    return out[0].unionByName(out[1])


def painted(rules: list[tuple[str, int, int, int]]) -> np.ndarray:
    """(row, start, end) of the pixel runs of rules drawn one pixel thick, end excluded, in reading order; runs that meet are one."""
    flat = np.array([(c, v0, v1) for o, c, v0, v1 in rules if o == "H" and v1 > v0], np.int64).reshape(-1, 3)
    tall = np.array([(c, v0, v1) for o, c, v0, v1 in rules if o == "V" and v1 > v0], np.int64).reshape(-1, 3)
    high = tall[:, 2] - tall[:, 1]
    row = np.repeat(tall[:, 1] - np.cumsum(high) + high, high) + np.arange(high.sum())
    x = np.repeat(tall[:, 0], high)
    drawn = np.concatenate([flat, np.stack([row, x, x + 1], axis=1)])
    if not len(drawn):
        return drawn
    row, start, end = drawn[np.lexsort((drawn[:, 1], drawn[:, 0]))].T
    wide = end.max() - start.min() + 2
    reach = np.maximum.accumulate(row * wide + end - start.min())
    fresh = np.flatnonzero(np.concatenate([[True], (row * wide + start - start.min())[1:] > reach[:-1]]))
    return np.stack([row[fresh], start[fresh], np.maximum.reduceat(end, fresh)], axis=1)


def side(offsets: np.ndarray, near: int) -> np.ndarray | None:
    """The pooled distances of a side, the most frequent first, from each row's distance to the outermost; None if one row bears it out.

    Distances in rising order pool up to the first over `near` from the most frequent of those before it (the outer of equals).
    """
    far, rows = np.unique(offsets, return_counts=True)
    most = np.maximum.accumulate(rows)
    leads = np.concatenate([[True], rows[1:] > most[:-1]])
    mode = far[np.maximum.accumulate(np.where(leads, np.arange(len(far)), 0))]
    gaps = np.flatnonzero(np.abs(far[1:] - mode[:-1]) > near)
    n = gaps[0] + 1 if len(gaps) else len(far)
    return np.concatenate([mode[n - 1 : n], far[:n]]) if rows[:n].sum() > 1 else None


def sides_of(rules: list[tuple[str, int, int, int]], near: int = 8, least: int = 100) -> list[tuple[int, int, int]]:
    """(x, y0, y1) of vertical rules that close the left and right of each component of one page's rules, drawn one pixel thick.

    Of a component's outermost pixels row by row, `side` pools the offsets and names the side, which goes over the rows in
    which a pooled offset is drawn. Components of under `least` pixels have no sides.
    """
    runs = painted(rules)
    if not len(runs):
        return []
    label = components(runs - [runs[0, 0], 0, 0])
    found = []
    for k in np.flatnonzero(np.bincount(label, runs[:, 2] - runs[:, 1]) >= least):
        row, start, end = runs[label == k].T
        ends = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
        outer = (start[ends], end[np.append(ends[1:], len(row)) - 1] - 1)
        for edge, inward in zip((outer[0].min(), outer[1].max()), (1, -1), strict=True):
            pooled = side((outer[inward < 0] - edge) * inward, near)
            if pooled is not None:
                at = edge + inward * pooled
                drawn = row[((start[:, None] <= at) & (at < end[:, None])).any(axis=1)]
                found.append((int(at[0]), int(drawn.min()), int(drawn.max())))
    return found


def with_sides(rules: DataFrame) -> DataFrame:
    """Rules and those that close open sides, on pages that have rules of both orients. Offsets and ends are cut to whole numbers.

    A page's rules are one task's; nothing else of the document is needed.
    """
    whole = lambda c: F.col(c).cast("int")
    page = rules.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("orient", whole("c").alias("c"), whole("v0").alias("v0"), whole("v1").alias("v1")))).alias("r"))

    @F.pandas_udf("array<struct<c:double,v0:double,v1:double>>")
    def close(pages: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("c", "v0", "v1"), map(float, s), strict=True)) for s in sides_of([(x["orient"], x["c"], x["v0"], x["v1"]) for x in p])] for p in pages], dtype=object)

    both = page.where(F.exists("r", lambda x: x["orient"] == "H") & F.exists("r", lambda x: x["orient"] == "V"))
    made = both.select(*PAGE, F.explode(close("r")).alias("s")).select(*PAGE, F.lit("V").alias("orient"), "s.*")
    return rules.select(*PAGE, "orient", "c", "v0", "v1").unionByName(made)


def cells_of(edges: list[tuple]) -> list[tuple]:
    """Boxes of the cells of one page's grid: a walk right, down, left and up, each turn taken as soon as the grid allows it."""
    to: dict[tuple, dict[int, tuple]] = {}
    for x, y, x1, y1 in edges:
        ahead, back = (RIGHT, LEFT) if y == y1 else (DOWN, UP)
        to.setdefault((x, y), {})[ahead] = (x1, y1)
        to.setdefault((x1, y1), {})[back] = (x, y)
    found = set()
    for start in to:
        at, going = to[start].get(RIGHT), RIGHT
        seen = [at]
        while at is not None and not (going == UP and at[1] <= start[1]):
            turn = going + 1
            if going < UP and turn in to[at]:
                going = turn
            at = to[at].get(going)
            seen.append(at)
        if at == start:
            found.add((min(p[0] for p in seen), min(p[1] for p in seen), max(p[0] for p in seen), max(p[1] for p in seen)))
    return sorted(found, key=lambda c: (c[1], c[0]))


def grouped(cells: list[tuple], slack: float = 7.0) -> list[tuple[tuple, list[tuple]]]:
    """Cells, top to bottom, each to the first table that it touches; tables grow by their cells. As observed, two that a later cell would join stay two."""
    tables: list[tuple[tuple, list[tuple]]] = []
    for c in cells:
        for i, (t, own) in enumerate(tables):
            if all(c[a] <= t[a + 2] + slack and t[a] <= c[a + 2] + slack for a in (0, 1)):
                tables[i] = ((min(t[0], c[0]), min(t[1], c[1]), max(t[2], c[2]), max(t[3], c[3])), [*own, c])
                break
        else:
            tables.append((c, [c]))
    return tables


def tables(rules: DataFrame, width: float = 612.0, height: float = 800.0, close: bool = True) -> DataFrame:
    """Tables (two cells and more) and boxes (one) of each page; cells outside the usual lengths of rules do not count.

    With `close`, open left and right sides are closed first.

    A page's grid is walked in one task; all steps before it are joins.
    """
    joined = cut(joined_rules(acceptable(rules, width, height)), "joined-rules")
    merged = cut(with_sides(joined), "closed-rules") if close else joined
    edges = grid(crossings(merged), merged).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x", "y", "x1", "y1"))).alias("e"))
    kind = "array<struct<table_no:int,x0:double,y0:double,x1:double,y1:double,cell_count:int>>"

    @F.pandas_udf(kind)
    def walk(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            boxes = grouped(cells_of([(e["x"], e["y"], e["x1"], e["y1"]) for e in page]))
            fit = [(b, sum(width / 30 <= c[2] - c[0] <= 0.9 * width and height / 75 <= c[3] - c[1] <= 0.9 * height for c in own)) for b, own in boxes]
            out.append([dict(zip(("table_no", "x0", "y0", "x1", "y1", "cell_count"), (i, *b, n), strict=True)) for i, (b, n) in enumerate(fit) if n])
        return pd.Series(out, dtype=object)

    return edges.select(*PAGE, F.explode(walk("e")).alias("t")).select(*PAGE, "t.*").withColumn("kind", F.when(F.col("cell_count") > 1, "table").otherwise("box"))


def rules_outside(rules: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rules of which no table of their page, grown by 5 across and 10 along y, holds over 0.6."""
    flat = F.col("orient") == "H"
    thick = rules.select("*", F.when(flat, F.col("v0")).otherwise(F.col("c")).alias("x0"), F.when(flat, F.col("c")).otherwise(F.col("v0")).alias("y0"), F.when(flat, F.col("v1")).otherwise(F.col("c") + 1).alias("x1"), F.when(flat, F.col("c") + 1).otherwise(F.col("v1")).alias("y1"))
    b = boxes.select(*PAGE, (F.col("x0") - 5).alias("b_x0"), (F.col("y0") - 10).alias("b_y0"), (F.col("x1") + 5).alias("b_x1"), (F.col("y1") + 10).alias("b_y1"))
    return outside(thick, b, 0.6).drop("x0", "y0", "x1", "y1")


def without_overlaps(cells: list[tuple], share: float = 0.9) -> list[tuple]:
    """Drops, in order, each cell in which another, not dropped before it, lies by over `share`."""

    def held(a: tuple, b: tuple) -> float:
        w, h = (min(a[i + 2], b[i + 2]) - max(a[i], b[i]) for i in (0, 1))
        area = (a[2] - a[0]) * (a[3] - a[1])
        return w * h / area if w > 0 and h > 0 and area > 0 else 0.0

    dropped: set[int] = set()
    for i, c in enumerate(cells):
        if any(j != i and j not in dropped and held(o, c) > share for j, o in enumerate(cells)):
            dropped.add(i)
    return [c for i, c in enumerate(cells) if i not in dropped]


def corner_cells(rules: list[tuple[str, float, float, float]], near: float = 4.0) -> list[tuple]:
    """Cells of one page from exact junctions of its rules: each upper left corner to the nearest lower right one with four ruled sides.

    A side is ruled if parallel rules less than `near` away cover over 0.9 of its length, or all but 15 if that is more.
    """
    flat, tall = ([r[1:] for r in rules if r[0] == o] for o in "HV")
    place = lambda x, lo, hi: 1 if x == lo else 3 if x == hi else 2 if lo < x < hi else 0
    starts, ends = [], []
    for h, h0, h1 in flat:
        for v, v0, v1 in tall:
            kind = (place(h, v0, v1), place(v, h0, h1))
            if 0 in kind:
                continue
            if max(kind) <= 2:
                starts.append((v, h))
            if min(kind) >= 2:
                ends.append((v, h))

    def ruled(lines: list[tuple], at: float, lo: float, hi: float) -> bool:
        got = sum(max(0.0, min(hi, b) - max(lo, a)) for c, a, b in lines if at - near <= c < at + near)
        return got > max(0.9 * (hi - lo), hi - lo - 15)

    found = []
    for x0, y0 in starts:
        fit = [(math.hypot(x1 - x0, y1 - y0), i) for i, (x1, y1) in enumerate(ends) if x1 > x0 and y1 > y0 and ruled(tall, x0, y0, y1) and ruled(tall, x1, y0, y1) and ruled(flat, y0, x0, x1) and ruled(flat, y1, x0, x1)]
        if fit:
            found.append((x0, y0, *ends[min(fit)[1]]))
    return without_overlaps(found)


def corners(rules: DataFrame) -> DataFrame:
    """(doc_id, page_no, x0, y0, x1, y1) of the cells that the corner finder sees on each page."""
    page = rules.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("orient", "c", "v0", "v1"))).alias("r"))

    @F.pandas_udf("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    def find(pages: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("x0", "y0", "x1", "y1"), map(float, c), strict=True)) for c in corner_cells([(x["orient"], x["c"], x["v0"], x["v1"]) for x in p])] for p in pages], dtype=object)

    return page.select(*PAGE, F.explode(find("r")).alias("c")).select(*PAGE, "c.*")
