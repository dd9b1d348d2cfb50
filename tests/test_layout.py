"""Golden values of the rules, and every query with SQL against DuckDB."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as X
from foliant.operators import cluster
from foliant.plans import pages, registry, structure  # noqa: F401  (pages and structure add their queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(registry.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_rule_distance(spark):
    rows = [(25, 3, 5, 25, 1, 10, 0), (29, 30, 100, 20, 50, 150, 18), (35, 1, 10, 38, 3, 5, 6), (12, 3, 5, 13, 3, 5, 2), (10, 3, 5, 20, 7, 10, 20)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, f int, want int")
    assert all(r.got == r.want for r in df.select("want", G.rule_distance(*map(F.col, "abcdef")).alias("got")).collect())


def test_interval_iou(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.5, 1.5, 1 / 3), (0.0, 1.0, 1.0, 2.0, 0.0), (0.0, 2.0, 0.0, 2.0, 1.0)], "a double, b double, c double, d double, want double")
    assert all(r.got == pytest.approx(r.want) for r in df.select("want", G.interval_iou(*map(F.col, "abcd")).alias("got")).collect())


def test_running_mean(spark):
    df = spark.createDataFrame([(1, x) for x in (40.0, 1.0, 4.0, 6.5, 9.0, 20.0, 22.0)], "g int, x double")
    got = [r.cluster for r in cluster.by_running_mean(df, ["g"], "x").orderBy("x").collect()]
    assert got == [0, 0, 0, 1, 2, 2, 3]


def test_numerals_and_fonts(spark):
    read = lambda t: {(r["class"], r["value"]) for r in spark.createDataFrame([(t,)], "t string").select(F.inline(X.numeral_classes(F.col("t")))).collect()}
    assert read("i") == {("lower", 9), ("roman_lower", 1)} and read("12") == {("decimal", 12)} and read("012") == {("012", 0)} and read("IV") == {("roman_upper", 4)}
    assert spark.range(1).select(X.font_similarity(F.lit("Serif"), F.lit("Sans-Serif"))).first()[0] == pytest.approx(5 / 9, abs=1e-3)
    assert [r[0] for r in spark.createDataFrame([("A-Bold",), ("Ital",), ("BoldOblique",), ("X",)], "f string").select(X.emphasis(F.col("f"))).collect()] == [1, 2, 3, 0]
