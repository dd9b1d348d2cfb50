"""Registered queries of page rasters, open and borderless tables, page margins, blank units and approximate numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import bands, cluster, layout, margins, raster, runs, tables
from foliant.plans.registry import WITH, query
from foliant.plans.structure import SPANS, _grid_rules, _spans
from foliant.sources.layout import SPAN_KEYS, by_document, lines, lines_of, spans

WIDTH, HEIGHT = 300, 200


def _drawn(spark, sf_dir):
    """Page rasters: each document's grid, black on white, one pixel thick."""
    rules = _grid_rules(spark, sf_dir).where("not (orient = 'H' and c = 73)")
    page = rules.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("orient", "c", "v0", "v1"))).alias("r"))

    @F.pandas_udf("binary")
    def draw(pages: pd.Series) -> pd.Series:
        out = []
        for p in pages:
            gray = np.full((HEIGHT, WIDTH), 255, np.uint8)
            for x in p:
                c, v0, v1 = int(x["c"]), int(x["v0"]), int(x["v1"])
                if x["orient"] == "H":
                    gray[c, v0:v1] = 0
                else:
                    gray[v0:v1, c] = 0
            out.append(gray.tobytes())
        return pd.Series(out, dtype=object)

    return page.select("doc_id", "page_no", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), draw("r").alias("gray"))


# An even kernel shifts what it leaves by four; a rule ends one later where one across lies at its end.
RASTER_SQL = """SELECT doc_id, 0::BIGINT AS page_no, 'H' AS orient, (72 + 30 * k)::DOUBLE AS c, 76.0::DOUBLE AS v0, (76 + 60 * n + CASE WHEN k < r THEN 1 ELSE 0 END)::DOUBLE AS v1 FROM (SELECT doc_id, doc_id % 3 + 2 AS r, doc_id % 2 + 2 AS n, unnest(range(doc_id % 3 + 3)) AS k FROM documents)
UNION ALL SELECT doc_id, 0, 'V', 72 + 60 * k, 76.0, 76 + 30 * r + CASE WHEN k < n THEN 1 ELSE 0 END FROM (SELECT doc_id, doc_id % 3 + 2 AS r, doc_id % 2 + 2 AS n, unnest(range(doc_id % 2 + 3)) AS k FROM documents)"""


@query("q_raster_rules", RASTER_SQL)
def q_raster_rules(spark, sf_dir):
    return raster.rules(_drawn(spark, sf_dir))


@query("q_tables_open", "SELECT doc_id, 72.0::DOUBLE AS x0, 72.0::DOUBLE AS y0, (71 + 60 * (doc_id % 2 + 2))::DOUBLE AS x1, (72 + 30 * (doc_id % 3 + 2))::DOUBLE AS y1, ((doc_id % 2 + 2) * (doc_id % 3 + 2))::INTEGER AS cell_count, 'table' AS kind FROM documents")
def q_tables_open(spark, sf_dir):
    """Grids without their outer vertical rules: both sides are closed first."""
    sides = (F.col("orient") == "V") & F.col("c").isin(72.0) | (F.col("orient") == "V") & (F.col("c") == 72 + 60 * (F.col("doc_id") % 2 + 2))
    return tables.tables(_grid_rules(spark, sf_dir).where(~sides)).select("doc_id", "x0", "y0", "x1", "y1", "cell_count", "kind")


@query("q_corner_cells", "SELECT doc_id, (72 + 60 * j)::DOUBLE AS x0, (72 + 30 * i)::DOUBLE AS y0, (132 + 60 * j)::DOUBLE AS x1, (102 + 30 * i)::DOUBLE AS y1 FROM (SELECT doc_id, doc_id % 3 + 2 AS r, unnest(range(doc_id % 2 + 2)) AS j FROM documents), LATERAL (SELECT unnest(range(r)) AS i)")
def q_corner_cells(spark, sf_dir):
    return tables.corners(_grid_rules(spark, sf_dir).where("not (orient = 'H' and c = 73)")).select("doc_id", "x0", "y0", "x1", "y1")


BANDS_SQL = f"""{SPANS}, h AS (SELECT doc_id, page_no, line_no, floor((y0 - 72) / 56)::BIGINT AS band, count(*) AS held FROM sp WHERE (x0 + x1) / 2 BETWEEN 72 AND 400 GROUP BY ALL),
g AS (SELECT doc_id, page_no, band FROM h WHERE band < 3 GROUP BY ALL HAVING avg(CASE WHEN held > 2 THEN 1 ELSE 0 END) >= 0.5),
i AS (SELECT *, band - row_number() OVER (PARTITION BY doc_id, page_no ORDER BY band) AS island FROM g)
SELECT doc_id, page_no, 72.0::DOUBLE AS x0, (71 + 56 * min(band))::DOUBLE AS y0, 400.0::DOUBLE AS x1, (127 + 56 * max(band))::DOUBLE AS y1, count(*) AS n_bands FROM i GROUP BY doc_id, page_no, island HAVING count(*) >= 2"""


@query("q_borderless", BANDS_SQL)
def q_borderless(spark, sf_dir):
    """Four like rules a page, one above each four lines and one below; words are the spans."""
    sp = _spans(spark, sf_dir).withColumn("span_id", F.col("line_no") * 100000 + F.col("span_no"))
    page = sp.select("doc_id", "page_no").distinct()
    rules = page.select("*", F.lit("H").alias("orient"), F.explode(F.array(*(F.lit(71.0 + 56 * k) for k in range(4)))).alias("c"), F.lit(72.0).alias("v0"), F.lit(400.0).alias("v1"))
    return bands.borderless(rules, sp)


X_IOU = "CASE WHEN b.x0 + 10 >= a.x1 OR a.x0 >= b.x1 + 10 THEN 0.0::DOUBLE ELSE (least(a.x1, b.x1 + 10) - greatest(a.x0, b.x0 + 10)) / (greatest(a.x1, b.x1 + 10) - least(a.x0, b.x0 + 10)) END"


@query("q_like_places", f"""{WITH}, p AS (SELECT a.doc_id, a.page_no, a.line_no AS a, b.line_no AS b, round(({X_IOU}) * 11 / 13, 6) AS iou FROM lay a JOIN lay b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.line_no = b.line_no + 1 WHERE ({X_IOU}) * 11 / 13 > 0.5)
SELECT * FROM p UNION ALL SELECT doc_id, page_no, b, a, iou FROM p""")
def q_like_places(spark, sf_dir):
    """Lines against the same lines moved by 10 to the right and 13 down."""
    lay = lines_of(spark, sf_dir).select("doc_id", "page_no", "line_no", "x0", "y0", "x1", "y1")
    moved = lay.withColumns({"x0": F.col("x0") + 10, "x1": F.col("x1") + 10, "y0": F.col("y0") + 13, "y1": F.col("y1") + 13})
    return layout.like_places(lay, moved, "line_no").withColumn("iou", F.round("iou", 6))


@query("q_soft_similarity", "WITH t AS (SELECT c_custkey, c_name AS a, lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer) SELECT c_custkey, CASE WHEN levenshtein(a, b) > 3 THEN 0.0::DOUBLE ELSE round((least(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b))::DOUBLE, 6) END AS alike FROM t")
def q_soft_similarity(spark, sf_dir):
    """Each customer's name against the one before it in its nation."""
    before = F.lag("c_name").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.round(X.soft_similarity(F.col("c_name"), before), 6).alias("alike"))


@query("q_approximate")
def q_approximate(spark, sf_dir):
    """Customers' balances by those of the suppliers of their nation."""
    known = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").cast("double").alias("x"))
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").cast("double").alias("x"))
    return cluster.approximate(own, cluster.approximations(known, ["nation"], "x", 500.0), ["nation"], "x", 500.0)


@query("q_margin_pages")
def q_margin_pages(spark, sf_dir):
    lay = lines_of(spark, sf_dir)
    return margins.per_page(margins.edge_frame(lay, layout.blocks(lay)))


def _blanked(spark, sf_dir):
    """Spans of which every third block and every fifth line hold but white space."""
    blank = (F.col("block_no") % 3 == 1) | (F.col("line_no") % 5 == 3)
    y = F.when(blank & (F.col("line_no") % 4 == 0), -14).otherwise(0)
    sp = spans(lines(by_document(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))), SPAN_KEYS)
    return sp.select(*(c for c in sp.columns if c not in ("text", "y0", "y1")), F.when(blank, F.lit(" ")).otherwise(F.col("text")).alias("text"), (F.col("y0") + y).alias("y0"), (F.col("y1") + y).alias("y1"))


@query("q_blank_blocks")
def q_blank_blocks(spark, sf_dir):
    return runs.donate_blanks(_blanked(spark, sf_dir), "block")


@query("q_blank_lines")
def q_blank_lines(spark, sf_dir):
    return runs.donate_blanks(_blanked(spark, sf_dir), "line")
