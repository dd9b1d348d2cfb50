"""Headings: signals of each block, their sum and the verdict; usual fonts and sizes of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as X
from foliant.operators import cluster, layout

USUAL = 0.10
SIGNALS = ("bold", "big", "other_font", "centred", "length", "near_length", "near_lines", "number", "words")


def font_usage(majority: DataFrame) -> DataFrame:
    """(doc_id, font, font_code): 0 for fonts of over a tenth of a document's characters, else 1."""
    per = majority.groupBy("doc_id", "font").agg(F.sum("chars").alias("chars"))
    share = F.col("chars") / F.sum("chars").over(Window.partitionBy("doc_id"))
    return per.select("doc_id", "font", F.when(share > USUAL, 0).otherwise(1).alias("font_code"))


def size_usage(majority: DataFrame) -> DataFrame:
    """(doc_id, size, size_code): -1 for usual sizes, -2 for those below the least usual, else 1.

    Sizes count together by running mean, within a twentieth of the document's least size. No usual size: all 1.
    """
    per = majority.groupBy("doc_id", "size").agg(F.sum("chars").alias("chars"))
    near = cluster.by_running_mean(per, ["doc_id"], "size", lambda v: v[0] / 20)
    w, doc = Window.partitionBy("doc_id", "cluster"), Window.partitionBy("doc_id")
    mean = per.join(near, ["doc_id", "size"]).withColumn("mean", F.avg("size").over(w)).withColumn("share", F.sum("chars").over(w) / F.sum("chars").over(doc))
    usual = F.col("share") > USUAL
    least = mean.withColumn("least", F.min(F.when(usual, F.col("mean"))).over(doc))
    return least.select("doc_id", "size", F.when(usual, -1).when(F.col("mean") < F.col("least"), -2).otherwise(1).alias("size_code"))


def _near(value: str, rate) -> Column:
    """Rates the blocks at -1, +1, +2: all low -0.5, a high one beside 0.5; the last two 0, the first 0.5."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    before, after, two = F.lag(value).over(w), F.lead(value).over(w), F.lead(value, 2).over(w)
    a, b, c = rate(before), rate(after), rate(two)
    low = (a == -1) & (b == -1) & (c == -1)
    return F.when(two.isNull(), 0.0).when(before.isNull(), 0.5).when(low, -0.5).when((a == 1) | (b == 1), 0.5).otherwise(0.0)


def signals(lay: DataFrame, margins: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row a block with each signal, their `total` and `heading`: total not below 0 and two positive signals.

    `margins` holds doc_id, x0, x1; `numbers` doc_id, block_no, classes (empty for a bullet), vals.
    """
    key = ["doc_id", "block_no"]
    top = layout.majority_font(lay)
    e = X.emphasis(F.col("font"))
    own = lay.groupBy(*key).agg(F.max(e.isin(0, 2)).alias("plain"), F.max(e == 3).alias("both"), F.min_by("text", "line_no").alias("first_text"))
    inside = margins.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("x0", "x1"))).alias("m"))
    marks = numbers.select(*key, "classes", F.struct("classes", "vals").alias("mark"))
    b = layout.blocks(lay).join(top.select(*key, "font", "size"), key).join(own, key).join(font_usage(top), ["doc_id", "font"]).join(size_usage(top), ["doc_id", "size"])
    b = b.join(inside, "doc_id", "left").join(marks, key, "left")
    w = Window.partitionBy("doc_id").orderBy("block_no")
    after, kin = F.lead("mark").over(w), F.lead("classes").over(w)
    number = (
        F.when(F.col("mark").isNull() | F.lead("block_no").over(w).isNull(), 0.0).when(F.size("classes") == 0, -4.0)
        .when(after.isNull() | (kin != F.col("classes")), 2.0).when(after != F.col("mark"), 1.0).otherwise(-1.0)
    )
    n = F.col("n_chars")
    made = b.select(
        *key,
        F.when(F.col("plain"), -1.0).when(F.col("both"), 1.0).otherwise(2.0).alias("bold"),
        F.col("size_code").cast("double").alias("big"),
        F.col("font_code").cast("double").alias("other_font"),
        F.coalesce(F.exists("m", lambda p: G.centred(F.col("x0"), F.col("x1"), p["x0"], p["x1"])), F.lit(False)).cast("double").alias("centred"),
        F.when(n >= 150, -4.0).when((n >= 121) | (n <= 2), -2.0).otherwise(0.0).alias("length"),
        _near("n_chars", lambda c: F.when(c >= 75, 1.0).when(c >= 46, 0.5).otherwise(-1.0)).alias("near_length"),
        _near("n_lines", lambda c: F.when(c >= 2, 1.0).otherwise(-1.0)).alias("near_lines"),
        number.alias("number"),
        F.when(F.size(F.split("first_text", " ")).between(2, 4), 0.5).otherwise(0.0).alias("words"),
    )
    total = sum((F.col(s) for s in SIGNALS[1:]), F.col(SIGNALS[0]))
    positive = sum(((F.col(s) > 0).cast("int") for s in SIGNALS[1:]), (F.col(SIGNALS[0]) > 0).cast("int"))
    return made.withColumn("total", total).withColumn("heading", (F.col("total") >= 0) & (positive >= 2))
