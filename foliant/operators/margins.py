"""Margins of a document: dense (x0, x1) pairs of its wide blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import cluster, fold


def edges(blocks: DataFrame, width: float = 612.0) -> DataFrame:
    """Weighted (x0, x1) of blocks over a fifth of the page wide, as heavy as they have lines.

    A block that begins within the depth of the block before (its top 0.2 to 6 of that one's line heights above the
    bottom) is passed over and is no "block before" for the next. `blocks` holds line_height, that of its last line.
    """

    def step(state, row):
        inside = state is not None and state[0] - 0.2 * state[1] > row["y0"] > state[0] - 6 * state[1]
        return (state, (False,)) if inside else ((row["y1"], row["line_height"]), (True,))

    kept = fold.sorted_fold(blocks, ["doc_id", "page_no"], ["block_no"], ["y0", "y1", "line_height"], T.StructType().add("kept", T.BooleanType()), step)
    return kept.where("kept").where(F.col("x1") - F.col("x0") > width / 5).groupBy("doc_id", "x0", "x1").agg(F.sum("n_lines").alias("n"))


def margins(points: DataFrame, pages: DataFrame, eps: float = 4.0) -> DataFrame:
    """(doc_id, x0, x1): of each dense cluster of points, the most frequent x0 and x1 of its cores, each by itself.

    A point is a core if a sixth of all (an eighth from 8 pages, a tenth from 20) lie within eps. Neighbours are found by
    joining cells of width eps.
    """
    part = F.when(F.col("pages") < 8, 6).when(F.col("pages") < 20, 8).otherwise(10)
    need = points.groupBy("doc_id").agg(F.sum("n").alias("total")).join(pages, "doc_id").select("doc_id", F.floor(F.col("total") / part).alias("need"))
    cell = F.floor(F.col("x0") / eps)
    near = lambda a, b: F.sqrt(F.pow(F.col(f"{a}x0") - F.col(f"{b}x0"), 2) + F.pow(F.col(f"{a}x1") - F.col(f"{b}x1"), 2)) <= eps

    def pairs(p: DataFrame) -> DataFrame:
        other = p.select("doc_id", cell.alias("cell"), *(F.col(c).alias(f"o_{c}") for c in p.columns if c != "doc_id"))
        return p.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).join(other, ["doc_id", "cell"]).where(near("", "o_"))

    dense = pairs(points).groupBy("doc_id", "x0", "x1", "n").agg(F.sum("o_n").alias("around"))
    cores = dense.join(need, "doc_id").where("around >= need").select("doc_id", "x0", "x1", "n")
    listed = cores.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "n"))).alias("c"))
    numbered = listed.select("doc_id", F.posexplode("c").alias("k", "p")).select("doc_id", "k", "p.*")
    linked = pairs(numbered).where("k < o_k").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("k").alias("a"), F.col("o_k").alias("b")))).alias("e"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    named = listed.join(linked, "doc_id", "left").withColumn("label", fold.labels(F.size("c"), F.coalesce("e", none)))
    flat = named.select("doc_id", F.explode(F.arrays_zip("c", "label")).alias("z")).select("doc_id", "z.label", "z.c.*")
    modes = [flat.groupBy("doc_id", "label", x).agg(F.sum("n").alias("n")).groupBy("doc_id", "label").agg(F.max_by(x, F.struct("n", -F.col(x))).alias(x)) for x in ("x0", "x1")]
    return modes[0].join(modes[1], ["doc_id", "label"]).select("doc_id", "x0", "x1")


def extents(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, lo, hi): mean left edge of a page's leftmost frequent cluster of lines, mean right edge of the rightmost."""
    page = ["doc_id", "page_no"]
    lo = cluster.outermost_mean(lines, page, "x0", last=False).withColumnRenamed("mean", "lo")
    hi = cluster.outermost_mean(lines, page, "x1", last=True).withColumnRenamed("mean", "hi")
    return lines.select(*page).distinct().join(lo, page, "left").join(hi, page, "left")


def edge_frame(lines: DataFrame, blocks: DataFrame, near: float = 3.0, weight: int = 5) -> DataFrame:
    """(doc_id, page_no, x0, x1, n_lines): edges of each block as the document approximates them, and a row of weight 5 with each page's extent."""
    sides = blocks.select("doc_id", F.explode(F.array("x0", "x1")).alias("x"))
    known = cluster.approximations(sides, ["doc_id"], "x", near)
    own = blocks.select("doc_id", "page_no", "x0", "x1", F.col("n_lines").cast("long").alias("n_lines"))
    for c in ("x0", "x1"):
        own = own.join(known.select("doc_id", F.col("x").alias(c), F.col("mean").alias(f"_{c}")), ["doc_id", c]).drop(c)
    own = own.select("doc_id", "page_no", F.col("_x0").alias("x0"), F.col("_x1").alias("x1"), "n_lines")
    page = extents(lines)
    for c in ("lo", "hi"):
        page = cluster.approximate(page.withColumn("x", F.col(c)), known, ["doc_id"], "x", near).withColumn(c, F.coalesce("approx", c)).drop("x", "approx")
    return own.unionByName(page.select("doc_id", "page_no", F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.lit(weight).cast("long").alias("n_lines")))


def per_page(frame: DataFrame) -> DataFrame:
    """(doc_id, page_no, x0, x1, lines_in_page, lines_in_doc) of edge pairs with over 5 lines in the document, over 1 on the page, on a quarter of the pages."""
    same = Window.partitionBy("doc_id", "x0", "x1")
    pages = frame.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    total = frame.withColumn("total", F.sum("n_lines").over(same)).where("total > 5")
    held = total.groupBy("doc_id", "x0", "x1", "page_no").agg(F.sum("n_lines").alias("lines_in_page"), F.max("total").alias("lines_in_doc")).where("lines_in_page > 1")
    often = held.withColumn("on_pages", F.count("*").over(same)).join(pages, "doc_id").where("on_pages >= greatest(1, pages / 4)")
    return often.select("doc_id", "page_no", "x0", "x1", "lines_in_page", "lines_in_doc")
