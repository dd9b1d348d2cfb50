"""All passes from positioned lines to one Markdown text a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import layout, lists, render, runs
from foliant.session import cut

#: Parts of one block get block numbers next to one another.
PARTS = 1_000_000


def renumbered(lines: DataFrame) -> DataFrame:
    """Makes each part of a block a block of its own."""
    return lines.withColumn("block_no", F.col("block_no") * PARTS + F.col("part")).drop("part")


def clean(lay: DataFrame, tables: DataFrame | None = None, figures: DataFrame | None = None) -> DataFrame:
    """Lines without those in tables, blocks in figures, running heads, math fonts and blanks; blocks cut at fonts and numerals."""
    out = lay if tables is None else layout.outside(lay, tables, 0.7)
    if figures is not None:
        out = out.join(layout.outside(layout.blocks(out), figures, 0.8).select("doc_id", "block_no"), ["doc_id", "block_no"], "left_semi")
    out = layout.without_blank(layout.without_math(layout.without_heads(cut(out, "outside-boxes"))))
    return cut(renumbered(runs.split_at_numerals(renumbered(layout.split_on_font(out)))), "clean-lines")


def markers(lines: DataFrame) -> DataFrame:
    """(doc_id, block_no, marker): list numbers and bullets that stand; a block has one at most."""
    numbers = lists.numbered(lines).select("doc_id", "block_no", F.col("number").alias("marker"))
    return numbers.unionByName(lists.bullets(lines).select("doc_id", "block_no", F.col("glyph").alias("marker"))).groupBy("doc_id", "block_no").agg(F.min("marker").alias("marker"))


def combined(lines: DataFrame) -> DataFrame:
    """Blocks, merged where a sentence or the line pitch goes on: hull of the first line's page, text, majority bold, marker."""
    parsed = runs.parsed_blocks(lines).drop("header").join(markers(lines), ["doc_id", "block_no"], "left").withColumn("header", F.coalesce("marker", F.lit("")))
    by_sentence = cut(runs.merge_sentences(parsed).select("doc_id", "block_no", F.col("run").alias("sentence"), "pitch", "pitch_font", "pitch_size", "header"), "sentences")
    joined = lines.join(by_sentence.select("doc_id", "block_no", "sentence", "header"), ["doc_id", "block_no"])
    grown = joined.withColumn("block_no", F.col("sentence"))
    extra = by_sentence.where("pitch is not null").select("doc_id", F.col("pitch_font").alias("font"), F.col("pitch_size").alias("size"), "pitch")
    cores = runs.pitch_cores(layout.line_pitch(lines).unionByName(extra))
    heads = grown.groupBy("doc_id", "block_no").agg(F.min_by("header", "line_no").alias("header"))
    again = runs.parsed_blocks(grown).drop("header").join(heads, ["doc_id", "block_no"])
    runs_of = runs.merge_pitch(again, cores).select("doc_id", "block_no", "run")
    final = grown.join(runs_of, ["doc_id", "block_no"]).withColumn("block_no", F.col("run"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    weight = lambda on: F.sum(F.when(on, F.length("text")).otherwise(0))
    bold = X.emphasis(F.col("font")).isin(1, 3)
    return final.groupBy("doc_id", "block_no").agg(
        F.min_by("page_no", "line_no").alias("page_no"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), (weight(bold) > weight(~bold)).alias("bold"),
        F.min_by("header", "line_no").alias("marker"), F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("text"),
    )


def markdown(lay: DataFrame, tables: DataFrame | None = None, figures: DataFrame | None = None, intended: bool = True) -> DataFrame:
    return render.documents(render.paragraphs(render.block_text(combined(clean(lay, tables, figures))), intended))
