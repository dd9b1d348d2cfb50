"""Blocks to Markdown: bold, list markers, and paragraphs of blocks that stand side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry as G


def with_marker(text: Column, marker: Column) -> Column:
    """Puts a list marker first, or in place of where it stands: `1) x` gives `1. x`; a bullet keeps its glyph and a space."""
    bare = F.regexp_replace(marker, r"\A[:. ]+|[:. ]+\z", "")
    put = F.when(bare.rlike(r"(?U)\A[\p{L}\p{N}]+\z"), F.concat(bare, F.lit(". "))).otherwise(F.concat(marker, F.lit(" ")))
    at = F.call_function("instr", text, marker)
    inside = F.concat(F.call_function("substring", text, F.lit(1), at - 1), put, F.call_function("substring", text, at + F.length(marker)))
    return F.when(F.coalesce(marker, F.lit("")) == "", text).when(at > 0, inside).otherwise(F.concat(marker, F.lit(" "), text))


def block_text(blocks: DataFrame) -> DataFrame:
    """Wraps bold blocks' `text` in asterisks, then sets `marker`."""
    bold = F.when(F.col("bold"), F.concat(F.lit("**"), F.trim("text"), F.lit("**"))).otherwise(F.col("text"))
    return blocks.withColumn("text", with_marker(bold, F.col("marker")))


def paragraphs(blocks: DataFrame, intended: bool = True) -> DataFrame:
    """(doc_id, paragraph, text). A block beside the one before (y-IoU over 0.1) shares its paragraph if on its page.

    As observed (`intended` false), pages are not compared and the text of such a block is lost.
    """
    w = Window.partitionBy("doc_id").orderBy("block_no")
    p = blocks.withColumn("_0", F.lag("y0").over(w)).withColumn("_1", F.lag("y1").over(w)).withColumn("_p", F.lag("page_no").over(w))
    beside = F.col("_0").isNotNull() & F.coalesce(G.interval_iou(F.col("_0"), F.col("_1"), F.col("y0"), F.col("y1")) > 0.1, F.lit(False))
    if intended:
        beside = beside & (F.col("_p") == F.col("page_no"))
    named = p.withColumn("_b", beside).withColumn("paragraph", F.sum(F.when(F.col("_b"), 0).otherwise(1)).over(w).cast("long") - 1)
    if not intended:
        return named.where("not _b").select("doc_id", "paragraph", "text")
    rows = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    return named.groupBy("doc_id", "paragraph").agg(F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("text"))


def documents(parts: DataFrame) -> DataFrame:
    """One text a document, a blank line between paragraphs."""
    rows = F.array_sort(F.collect_list(F.struct("paragraph", "text")))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("text"))
