"""Layout tables. Positioned lines of plain documents are laid out by arithmetic on their ids, for tests and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_LINES, BLOCK_LINES = 12, 4
FONTS = ("Serif", "Serif-Bold", "Sans-Italic", "MathSym", "Sans")


def read_spans(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A table of positioned spans, Parquet or JSON lines."""
    return spark.read.format(kind).load(path)


def read_pdf_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of the files whose name ends in .pdf, in any case; parsing them needs a library of the caller's."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)


def lines(docs: DataFrame) -> DataFrame:
    """A row for each line of each document, with page, block, box, font and size."""
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
    pos, doc = F.col("pos"), F.col("doc_id")
    x0 = (72 + 18 * (doc % 3) + F.when(pos % 9 == 4, 36).otherwise(0)).cast("double")
    y0 = (72 + 14 * (pos % PAGE_LINES)).cast("double")
    div = lambda a, n: F.floor(a / n).cast("long")
    font = F.get(F.array(*map(F.lit, FONTS)), ((doc * 7 + div(pos, 2)) % len(FONTS)).cast("int"))
    return raw.select(
        "doc_id", div(pos, PAGE_LINES).alias("page_no"), div(pos, BLOCK_LINES).alias("block_no"), pos.alias("line_no"), "text",
        x0.alias("x0"), y0.alias("y0"), (x0 + 5 * F.least(F.length("text"), F.lit(90))).alias("x1"), (y0 + 12).alias("y1"),
        font.alias("font"), (10 + 2 * ((doc + div(pos, 3)) % 3)).cast("double").alias("size"),
    )


#: Bytes of a table's files for each partition of `by_document`: their words, some fifty times as large, are sorted in memory.
PART_BYTES = 1 << 20


def by_document(docs: DataFrame) -> DataFrame:
    """The documents dealt by doc_id, so that what is grouped within documents, once a row for each word, moves no more."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(max(least, -(-size // PART_BYTES)), "doc_id")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def boxes(lay: DataFrame, even: bool, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """A box on each first page of even (or odd) documents."""
    pages = lay.where((F.col("page_no") == 0) & (F.col("doc_id") % 2 == (0 if even else 1))).select("doc_id", "page_no").distinct()
    fixed: list[Column] = [F.lit(v).alias(f"b_{n}") for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)]
    return pages.select("doc_id", "page_no", *fixed)


#: The same view in SQL.
LINES_SQL = r"""lay AS (
  SELECT doc_id, pos // 12 AS page_no, pos // 4 AS block_no, pos AS line_no, text, x0, y0, x0 + 5 * least(length(text), 90) AS x1, y0 + 12 AS y1, font, size FROM (
    SELECT doc_id, pos, text, (72 + 18 * (doc_id % 3) + CASE WHEN pos % 9 = 4 THEN 36 ELSE 0 END)::DOUBLE AS x0, (72 + 14 * (pos % 12))::DOUBLE AS y0,
           ['Serif', 'Serif-Bold', 'Sans-Italic', 'MathSym', 'Sans'][((doc_id * 7 + pos // 2) % 5) + 1] AS font, (10 + 2 * ((doc_id + pos // 3) % 3))::DOUBLE AS size
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)))"""

SPAN_KEYS = ("doc_id", "page_no", "block_no", "line_no")


def spans(lay: DataFrame, by: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """A row for each word of each line, with its own box, baseline, font, size and flags (bit 0: raised).

    Every 11th word is set in another font, every 13th is small and low, every 37th is raised. `by` may name a line by all
    of SPAN_KEYS: words then come in the order in which pages and blocks are looked through, and are not sorted again.
    """
    words = lay.select("*", F.posexplode(F.split("text", " ")).alias("span_no", "word")).withColumn("span_no", F.col("span_no").cast("long"))
    w = Window.partitionBy(*by).orderBy("span_no")
    words = words.withColumn("_upto", F.sum(F.length("word") + 1).over(w))  # once for both sides of the box
    left = F.col("x0") + 5 * (F.col("_upto") - F.length("word") - 1)
    n = F.col("span_no")
    low = n % 13 == 12
    return words.select(
        *SPAN_KEYS, "span_no", F.col("word").alias("text"), left.alias("x0"), F.col("y0"), (left + 5 * F.length("word")).alias("x1"), "y1",
        (F.col("y1") - 2 + F.when(low, 1.5).otherwise(0.0)).alias("oy"), F.when(n % 11 == 5, F.lit("Serif-Bold")).otherwise(F.col("font")).alias("font"),
        (F.col("size") * F.when(low, 0.5).otherwise(1.0)).alias("size"), F.when(n % 37 == 36, 1).otherwise(0).alias("flags"),
    )


def marked(lay: DataFrame) -> DataFrame:
    """Lines of which each block's first carries a number in brackets, and every fifth other a bullet, in one font."""
    text = F.when(F.col("line_no") % 4 == 0, F.concat(F.lit("("), F.col("block_no") + 1, F.lit(") "), F.col("text"))).when(F.col("line_no") % 5 == 2, F.concat(F.lit("• "), F.col("text")))
    return lay.withColumns({"text": F.coalesce(text, F.col("text")), "font": F.lit("Serif"), "size": F.lit(10.0)})


#: The same views in SQL, after `lay`.
SPANS_SQL = """sp AS (
  SELECT doc_id, page_no, block_no, line_no, span_no, word AS text, x0 + 5 * (t - length(word) - 1) AS x0, y0, x0 + 5 * (t - 1) AS x1, y1, y1 - 2 + CASE WHEN span_no % 13 = 12 THEN 1.5 ELSE 0 END AS oy,
         CASE WHEN span_no % 11 = 5 THEN 'Serif-Bold' ELSE font END AS font, size * CASE WHEN span_no % 13 = 12 THEN 0.5 ELSE 1.0 END AS size, CASE WHEN span_no % 37 = 36 THEN 1 ELSE 0 END AS flags FROM (
    SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY span_no) AS t FROM (
      SELECT *, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS span_no FROM lay)))"""
MARKED_SQL = "mk AS (SELECT * REPLACE (CASE WHEN line_no % 4 = 0 THEN '(' || (block_no + 1) || ') ' || text WHEN line_no % 5 = 2 THEN '• ' || text ELSE text END AS text, 'Serif' AS font, 10.0::DOUBLE AS size) FROM lay)"
