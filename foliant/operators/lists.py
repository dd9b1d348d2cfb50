"""Bulleted and numbered lists: candidates, criticism over the document, and the markers that stay."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import cluster
from foliant.session import cut

# What a member gains from another whose last value is so far below its own.
STEP = {-1: 0.5, -2: 0.251, -3: 0.253, 1: 0.501, 2: 0.252, 3: 0.254, 4: 0.255}
GROUP = ["doc_id", "font", "size_class", "emphasis", "classes"]


def openings(lay: DataFrame) -> DataFrame:
    """The first line of each block."""
    first = F.min_by(F.struct("page_no", "line_no", "text", "font", "size", "x0", "y0", "x1", "y1"), "line_no")
    return lay.groupBy("doc_id", "block_no").agg(first.alias("f")).select("doc_id", "block_no", "f.*")


def bullets(lay: DataFrame, margins: DataFrame | None = None) -> DataFrame:
    """Blocks that open with a bullet and stand in line with others of the same bullet and font; two at least stay.

    Offsets may differ by a distance of two of the document's `margins` (doc_id, x0); none counts as one at 0. Others
    are counted by offset before they are joined, so a bullet that fills a document costs a row for each offset.
    """
    found = openings(lay).withColumn("glyph", X.bullet(F.col("text"))).where("glyph is not null")
    by = ["doc_id", "glyph", "font", "size"]
    offsets = found.groupBy(*by, F.col("x0").alias("o_x0")).agg(F.count("*").alias("n"))
    joined = found.join(offsets, by)
    far = F.col("x0") - F.col("o_x0")
    if margins is None:
        d = F.abs(far)
    else:
        own = margins.groupBy("doc_id").agg(F.sort_array(F.collect_set("x0")).alias("m"))
        joined = joined.join(own, "doc_id", "left").withColumn("m", F.coalesce("m", F.array(F.lit(0.0))))
        gaps = F.flatten(F.transform("m", lambda a: F.transform("m", lambda b: a - b)))
        d = F.array_min(F.transform(gaps, lambda g: F.abs(far - g)))
    score = F.sum(F.col("n") * F.exp(-d / (2 * F.col("y1") - F.col("y0")))) - 1  # without the block itself
    kept = joined.groupBy(*by, "block_no", "text", "y0", "y1").agg(score.alias("score")).where("score > 0.5")
    many = kept.groupBy("doc_id", "glyph").count().where("count >= 2").select("doc_id", "glyph")
    rest = F.expr("substring(text, length(glyph) + 1)")
    return kept.join(many, ["doc_id", "glyph"], "left_semi").select("doc_id", "block_no", "glyph", F.regexp_replace(rest, r"(?U)\A\s+", "").alias("rest"), F.round("score", 6).alias("score"))


def candidates(lay: DataFrame) -> DataFrame:
    """Blocks that open with a list number, with the font of their first line."""
    found = openings(lay).withColumn("number", X.list_number(F.col("text"))).where("number <> ''")
    return found.select("doc_id", "block_no", "number", "font", "size", X.emphasis(F.col("font")).alias("emphasis"))


def interpretations(found: DataFrame) -> DataFrame:
    """A row for each reading of each candidate, keyed by font, size class (sizes within 0.15 chain), emphasis and classes."""
    sized = cluster.by_gap(found, ["doc_id"], "size", "block_no", 0.15).withColumnRenamed("cluster", "size_class")
    rows = sized.select("*", F.posexplode(X.readings(F.col("number"))).alias("reading", "r"), X.separators(F.col("number")).alias("sep"))
    return rows.select("doc_id", "block_no", "number", "sep", "reading", "font", "size_class", "emphasis", F.transform("r", lambda x: x["class"]).alias("classes"), F.transform("r", lambda x: x["value"]).alias("vals"))


def survivors(seps: list[str], lasts: list[int], lone_letter: bool) -> list[bool]:
    """Which members of a group stay: those that a neighbour in number supports, in order, each going before the next is judged."""
    if len(lasts) < 2:
        return [False] * len(lasts)
    left, out = Counter(zip(seps, lasts, strict=True)), []
    for sep, n in zip(seps, lasts, strict=True):
        gains = {w * (2 if n in (1, 2, 3) else 1) for d, w in STEP.items() if left[sep, n - d]}
        stays = sum(sorted(gains)) >= 1 and not (lone_letter and not sep)
        out.append(stays)
        if not stays:
            left[sep, n] -= 1
    return out


def legitimate(rows: DataFrame) -> DataFrame:
    """Interpretations that their group supports. A group lies in one document; its supports are counts, never pairs."""
    inner = F.array_sort(F.collect_list(F.struct("block_no", "reading", "number", "sep", "vals")))

    @F.pandas_udf("array<boolean>")
    def judge(members: pd.Series, classes: pd.Series) -> pd.Series:
        return pd.Series([survivors([m["sep"] for m in g], [int(m["vals"][-1]) for m in g], c[0] == "lower") for g, c in zip(members, classes, strict=True)], dtype=object)

    groups = rows.where(F.size("vals") > 0).groupBy(*GROUP).agg(inner.alias("m")).withColumn("ok", judge("m", "classes"))
    flat = groups.select(*GROUP, F.explode(F.arrays_zip("m", "ok")).alias("z")).where("z.ok")
    return flat.select(*GROUP, "z.m.*")


def numbered(lay: DataFrame) -> DataFrame:
    """The list marker of each numbered block; of several readings that stay, the group first seen last gives the classes."""
    rows = cut(interpretations(candidates(lay)), "interpretations")
    font = ["doc_id", "font", "size_class", "emphasis"]
    seen = rows.groupBy(*GROUP).agg(F.min(F.struct("block_no", "reading")).alias("g_first"))
    seen = seen.join(rows.groupBy(*font).agg(F.min("block_no").alias("f_first")), font)
    tagged = legitimate(rows).join(seen, GROUP)
    last = F.max_by(F.struct("number", "classes", "vals"), F.struct("f_first", "g_first"))
    return tagged.groupBy("doc_id", "block_no").agg(last.alias("t")).select("doc_id", "block_no", "t.number", "t.classes", F.get("t.vals", F.size("t.vals") - 1).alias("value"))
