"""Tables without vertical rules: bands between like horizontal rules whose rows hold several spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import cluster, fold

PAGE = ["doc_id", "page_no"]


def middle_share(a0: float, a1: float, b0: float, b1: float) -> float:
    """Middle part over hull, the gap too if the intervals are apart; 0 for a hull without length."""
    s = sorted((a0, a1, b0, b1))
    return (s[2] - s[1]) / (s[3] - s[0]) if s[3] > s[0] else 0.0


def alike(rules: DataFrame, least: float = 0.95) -> DataFrame:
    """Adds `grp` to horizontal rules: each, top to bottom, joins the first group with whose extent it has over `least` in common; extents grow.

    As observed, the first rule of a group takes the group's whole extent as its own.
    """

    def step(extents, row):
        extents, a0, a1 = extents or [], row["v0"], row["v1"]
        for i, (b0, b1) in enumerate(extents):
            if middle_share(a0, a1, b0, b1) > least:
                extents[i] = (min(a0, b0), max(a1, b1))
                return extents, (i,)
        return [*extents, (a0, a1)], (len(extents),)

    flat = rules.where("orient = 'H'").select(*PAGE, "c", "v0", "v1")
    found = fold.sorted_fold(flat, PAGE, ["c", "v0", "v1"], ["v0", "v1"], T.StructType().add("grp", T.LongType()), step)
    w = Window.partitionBy(*PAGE, "grp")
    ranked = found.withColumn("n", F.row_number().over(w.orderBy("c", "v0", "v1")))
    whole = F.struct(F.min("v0").over(w).alias("v0"), F.max("v1").over(w).alias("v1"))
    return ranked.withColumn("whole", whole).select(*PAGE, "grp", "n", "c", F.when(F.col("n") == 1, F.col("whole.v0")).otherwise(F.col("v0")).alias("v0"), F.when(F.col("n") == 1, F.col("whole.v1")).otherwise(F.col("v1")).alias("v1"))


def bands(rules: DataFrame) -> DataFrame:
    """(grp, n, x0, y0, x1, y1) between neighbouring rules of groups of at least three: left end of the upper, right end of the lower rule."""
    w = Window.partitionBy(*PAGE, "grp")
    below = w.orderBy("n")
    both = alike(rules).withColumn("size", F.count("*").over(w)).withColumn("to", F.lead("c").over(below)).withColumn("end", F.lead("v1").over(below))
    return both.where("size >= 3 and to is not null").select(*PAGE, "grp", "n", F.col("v0").alias("x0"), F.col("c").alias("y0"), F.col("end").alias("x1"), F.col("to").alias("y1"))


def borderless(rules: DataFrame, spans: DataFrame, crowd: int = 2, share: float = 0.5) -> DataFrame:
    """Hulls of two and more neighbouring bands that look like table rows: in `share` of a band's rows more than `crowd` spans have their centre.

    Rows of a page are its spans clustered by vertical overlap; `spans` hold span_id, unique on a page. Spans meet bands by a hash join on the page.
    """
    rows = cluster.by_overlap(spans, PAGE, "y0", "y1", "span_id").select(*PAGE, "cluster", ((F.col("x0") + F.col("x1")) / 2).alias("ox"), ((F.col("y0") + F.col("y1")) / 2).alias("oy"))
    b = bands(rules)
    key = [*PAGE, "grp", "n"]
    inside = b.join(rows, PAGE).where("ox between x0 and x1 and oy between y0 and y1").groupBy(*key, "cluster").agg(F.count("*").alias("held"))
    good = inside.groupBy(*key).agg(F.avg((F.col("held") > crowd).cast("int")).alias("rate")).where(F.col("rate") >= share)
    passed = b.join(good.select(*key), key)
    island = F.col("n") - F.row_number().over(Window.partitionBy(*PAGE, "grp").orderBy("n"))
    hull = passed.withColumn("island", island).groupBy(*PAGE, "grp", "island").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_bands"))
    return hull.where("n_bands >= 2").select(*PAGE, "x0", "y0", "x1", "y1", "n_bands")
