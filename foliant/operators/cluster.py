"""One-dimensional clustering: by gap, by overlap with the previous interval, by running mean, by density."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.geometry import interval_iou


def _numbered(df: DataFrame, by: list[str], order: list[str], starts: Column) -> DataFrame:
    return df.withColumn("cluster", (F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).cast("long"))


def by_gap(df: DataFrame, by: list[str], value: str, tie: str, gap: float) -> DataFrame:
    """A new cluster (numbered from 0) where the step from the previous value exceeds `gap`."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(value, tie))
    return _numbered(df.withColumn("_b", before), by, [value, tie], F.col(value) - F.col("_b") > gap).drop("_b")


def by_overlap(df: DataFrame, by: list[str], start: str, end: str, tie: str, least: float = 0.1) -> DataFrame:
    """A new cluster where an interval's IoU with the one before it is below `least`."""
    w = Window.partitionBy(*by).orderBy(start, tie)
    both = df.withColumn("_s", F.lag(start).over(w)).withColumn("_e", F.lag(end).over(w))
    return _numbered(both, by, [start, tie], interval_iou(F.col("_s"), F.col("_e"), F.col(start), F.col(end)) < least).drop("_s", "_e")


def by_running_mean(df: DataFrame, by: list[str], value: str, threshold: float | Callable[[Column], Column] = 5.0) -> DataFrame:
    """(by.., value, cluster) in sorted order; a new cluster where a value is over `threshold` from the mean of the one so far.

    A callable gives the threshold from the group's sorted values. The mean depends on all before it, so this is an ordered fold over each group's sorted values, in the JVM.
    """
    limit = threshold(F.col("v")) if callable(threshold) else F.lit(threshold)
    zero = F.struct(F.lit(-1).cast("long").alias("k"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("n"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["k"] < 0) | (F.abs(x - acc["mean"]) > limit)
        k = acc["k"] + F.when(new, 1).otherwise(0)
        n = F.when(new, 1.0).otherwise(acc["n"] + 1)
        mean = F.when(new, x).otherwise((acc["mean"] * acc["n"] + x) / n)
        return F.struct(k.alias("k"), mean.alias("mean"), n.alias("n"), F.concat(acc["out"], F.array(k)).alias("out"))

    folded = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v")).withColumn("c", F.aggregate("v", zero, step)["out"])
    return folded.select(*by, F.explode(F.arrays_zip("v", "c")).alias("z")).select(*by, F.col("z.v").alias(value), F.col("z.c").alias("cluster"))


def density_cores(df: DataFrame, by: list[str], value: str, eps: float, least: int = 3) -> DataFrame:
    """Marks values with at least `least` values within `eps`, themselves included."""
    near = F.expr(f"count(1) OVER (PARTITION BY {', '.join(by)} ORDER BY {value} RANGE BETWEEN {eps}D PRECEDING AND {eps}D FOLLOWING)")
    return df.withColumn("core", near >= least)


def approximations(df: DataFrame, by: list[str], value: str, threshold: float) -> DataFrame:
    """(by.., value, mean): each distinct value with the mean of its running-mean cluster; nulls have none."""
    near = by_running_mean(df.where(F.col(value).isNotNull()), by, value, threshold)
    mean = near.withColumn("mean", F.avg(value).over(Window.partitionBy(*by, "cluster")))
    return mean.groupBy(*by, value).agg(F.max("mean").alias("mean"))


def approximate(df: DataFrame, known: DataFrame, by: list[str], value: str, threshold: float) -> DataFrame:
    """Adds `approx`: the mean of a known value; else, as observed, the next known value above itself if less than `threshold` away; else null.

    An as-of join by one sort of both sides together; a value above all known ones has null. Keys of `by` match when equal and not null.
    """
    own = df.withColumn("_known", F.lit(None).cast("double")).withColumn("_mean", F.lit(None).cast("double"))
    keys = known.select(*by, value, F.col(value).cast("double").alias("_known"), F.col("mean").alias("_mean"))
    w = Window.partitionBy(*by).orderBy(F.col(value).cast("double"), F.col("_known").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    both = own.withColumn("_own", F.lit(True)).unionByName(keys.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    at = both.withColumn("_next", F.first(F.when(~F.col("_own"), F.struct("_known", "_mean")), ignorenulls=True).over(w)).where("_own")
    near, v = F.col("_next._known"), F.col(value).cast("double")
    approx = F.when(near == v, F.col("_next._mean")).when(near - v < threshold, near)
    return at.withColumn("approx", approx).select(*df.columns, "approx")


def outermost_mean(df: DataFrame, by: list[str], value: str, last: bool, threshold: float = 4.0, least: int = 3) -> DataFrame:
    """(by.., mean) of the first (or last) running-mean cluster with over `least` values; groups without one have no row."""
    per = by_running_mean(df, by, value, threshold).groupBy(*by, "cluster").agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") > least)
    pick = F.max_by if last else F.min_by
    return per.groupBy(*by).agg(pick("mean", "cluster").alias("mean"))
