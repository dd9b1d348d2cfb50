"""Operators over positioned lines: spatial filters, statistics, splits, running headers, footers, headings, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as X
from foliant.operators import fold
from foliant.session import cut

PAGE = ["doc_id", "page_no"]


def outside(items: DataFrame, boxes: DataFrame, share: float) -> DataFrame:
    """Items of which no box of their page holds more than `share`: a hash join on the page with the overlap as its condition."""
    a = items.select("*", *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    b = boxes.withColumnsRenamed({"doc_id": "b_doc", "page_no": "b_page"})
    on = (F.col("doc_id") == F.col("b_doc")) & (F.col("page_no") == F.col("b_page")) & (G.containment("a_", "b_") > share)
    return a.join(b, on, "left_anti").drop("a_x0", "a_y0", "a_x1", "a_y1")


def centres_inside(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """Items whose centre lies in a box of their page, bounds included."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return items.join(boxes, PAGE).where(x.between(F.col("b_x0"), F.col("b_x1")) & y.between(F.col("b_y0"), F.col("b_y1")))


def blocks(lay: DataFrame) -> DataFrame:
    """Hull, text, line count and page of each block; a block belongs to the page of its first line."""
    return lay.groupBy("doc_id", "block_no").agg(F.min("page_no").alias("page_no"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_lines"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def line_pitch(lay: DataFrame) -> DataFrame:
    """Pitch between consecutive lines of one font and size in a block, to one decimal, where the bottom falls by over 0.05."""
    w = Window.partitionBy("doc_id", "block_no").orderBy("line_no")
    both = lay.withColumn("_f", F.lag(F.struct("font", "size")).over(w)).withColumn("_y", F.lag("y1").over(w))
    return both.where((F.col("_f") == F.struct("font", "size")) & (F.col("y1") - F.col("_y") > 0.05)).select("doc_id", "font", "size", F.bround(F.col("y1") - F.col("_y"), 1).alias("pitch"))


def majority_font(lay: DataFrame) -> DataFrame:
    """The (font, size) with the most characters of each block; ties to the one that came first."""
    per = lay.groupBy("doc_id", "block_no", "font", "size").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.min("line_no").alias("first"))
    top = F.max_by(F.struct("font", "size", "chars"), F.struct("chars", -F.col("first")))
    return per.groupBy("doc_id", "block_no").agg(top.alias("t")).select("doc_id", "block_no", "t.font", "t.size", F.col("t.chars").alias("chars"))


def split_on_font(lay: DataFrame) -> DataFrame:
    """Numbers the parts of each block, cut where the (font, size) changes."""
    w = Window.partitionBy("doc_id", "block_no").orderBy("line_no")
    key = F.struct("font", "size")
    marked = lay.withColumn("_p", F.lag(key).over(w)).withColumn("_cut", F.when(F.col("_p").isNotNull() & (F.col("_p") != key), 1).otherwise(0))
    return marked.withColumn("part", F.sum("_cut").over(w).cast("long")).drop("_p", "_cut")


def unify(lay: DataFrame) -> DataFrame:
    """Joins runs of lines of one font and size of a block by a space."""
    parts = split_on_font(lay).groupBy("doc_id", "block_no", "part").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "font", "size"))).alias("l"))
    return parts.select("doc_id", "block_no", "part", F.col("l")[0]["font"].alias("font"), F.col("l")[0]["size"].alias("size"), F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"))


def running_heads(lay: DataFrame, top: int = 4, by_page: bool = False) -> DataFrame:
    """Header and footer lines: outermost `top` of a page, scored by like text at a like place on pages -8 .. +7; kept from 1.

    Texts are alike if equal but for their digits; page numbers by how far apart they are (equal ones are not).
    by_page: numbers are not read. They are alike as texts are, so with as many digits alone, and count twice on the first six pages.
    Pages meet through buckets of 16, so a header of a long document joins its neighbours alone.
    """
    w = Window.partitionBy(*PAGE)
    near = ["doc_id", "page_no", "line_no", "text", "x0", "y0", "x1", "y1"]
    ranked = lay.select(*near).withColumn("head", F.row_number().over(w.orderBy("y0", "line_no"))).withColumn("foot", F.row_number().over(w.orderBy(F.desc("y0"), F.desc("line_no"))))
    side = lambda name, n: F.when(F.col(n) <= top, F.struct(F.lit(name).alias("side"), F.col(n).alias("n")))
    outer = ranked.where((F.col("head") <= top) | (F.col("foot") <= top))
    sides = outer.select(*near, F.inline(F.array_compact(F.array(side("header", "head"), side("footer", "foot")))))
    if by_page:
        first = F.col("text").rlike(r"^[1-9][0-9]{0,2}\z") & (F.col("page_no") <= 5)
        read = F.array(F.struct(X.band_key(F.col("text")).alias("class"), F.when(first, 2.0).otherwise(1.0).alias("value")))
    else:
        read = X.band_readings(F.col("text"))
    c = sides.select("doc_id", "page_no", "line_no", "side", "n", F.explode(read).alias("r"), "x0", "y0", "x1", "y1").select("*", "r.class", "r.value").drop("r")
    long = F.length("class") > 64  # long texts meet by their digest
    c = cut(c.withColumn("class", F.when(long, F.concat(F.lit("sha256 "), F.sha2("class", 256))).otherwise(F.col("class"))), "page-edges")
    a, b = c.select(*(F.col(x).alias(f"a_{x}") for x in c.columns)), c.select(*(F.col(x).alias(f"b_{x}") for x in c.columns))
    col, bucket = F.col, lambda p: F.floor(p / 16)
    a = a.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(col("a_page_no") - 8), bucket(col("a_page_no") + 7)))))
    b = b.withColumn("b_bucket", bucket(col("b_page_no")))
    on = (col("a_doc_id") == col("b_doc_id")) & (col("bucket") == col("b_bucket")) & (col("a_side") == col("b_side")) & (col("a_class") == col("b_class")) & (col("a_page_no") != col("b_page_no")) & col("b_page_no").between(col("a_page_no") - 8, col("a_page_no") + 7)
    area = G.axis_iou("a_", "b_", "x") * G.axis_iou("a_", "b_", "y")
    far = col("b_value") - col("a_value")
    number = F.when((far == 0) | ~far.between(-20, 19), 0.0).when(F.abs(far) <= 8, 1.0).otherwise(0.5) * F.when(col("a_value").between(1, 6), 2.0).otherwise(1.0)
    alike = F.sum(col("a_value") if by_page else F.when(col("a_value").isNull(), 1.0).otherwise(number))
    line = ["a_doc_id", "a_page_no", "a_line_no", "a_side"]
    pairs = a.join(b, on).groupBy(*line, "b_line_no").agg(F.max("a_n").alias("n"), alike.alias("alike"), F.max(area).alias("area")).where("alike > 0.5")
    score = F.sum(col("alike") * F.when(col("area") > 0.5, 1.0).otherwise(col("area"))) * F.when(F.max("n") <= 2, 1.0).otherwise(0.5)
    scored = pairs.groupBy(*line).agg(score.alias("score"))
    return scored.where("score >= 1").select(col("a_doc_id").alias("doc_id"), col("a_page_no").alias("page_no"), col("a_line_no").alias("line_no"), col("a_side").alias("side"), F.round("score", 6).alias("score"))


def without_heads(lay: DataFrame, by_page: bool = False) -> DataFrame:
    return lay.join(running_heads(lay, by_page=by_page).select("doc_id", "line_no").distinct(), ["doc_id", "line_no"], "left_anti")


def without_math(lay: DataFrame) -> DataFrame:
    return lay.where(~F.lower("font").contains("math"))


def without_blank(lay: DataFrame) -> DataFrame:
    return lay.where(F.col("text").rlike(r"(?U)\S"))


def last_blocks(lay: DataFrame, mark: str, misses: int = 5) -> DataFrame:
    """Blocks whose text matches `mark`, page by page from the bottom, until `misses` blocks do not."""
    b = unify(lay).where("part = 0").select("doc_id", "block_no", "text").join(blocks(lay), ["doc_id", "block_no"])
    w = Window.partitionBy(*PAGE).orderBy(F.desc("y1"), "block_no")
    hit = F.col("text").rlike(mark)
    before = F.coalesce(F.sum(F.when(hit, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("_n", before).where(hit & (F.col("_n") < misses)).select("doc_id", "page_no", "block_no", "text")


def fonts(lay: DataFrame) -> DataFrame:
    """Each document's fonts with emphasis and family: fonts chained by bare names at least 0.6 alike, named by the least."""
    own = lay.groupBy("doc_id").agg(F.array_sort(F.collect_set("font")).alias("f"))
    one = own.select("doc_id", F.posexplode("f").alias("a", "x"))
    pairs = one.join(one.select("doc_id", F.col("a").alias("b"), F.col("x").alias("y")), "doc_id").where((F.col("a") < F.col("b")) & (X.font_similarity(F.col("x"), F.col("y")) >= 0.6))
    edges = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("e"))
    label = fold.labels(F.size("f"), F.coalesce("e", F.array().cast("array<struct<a:int,b:int>>")))
    named = own.join(edges, "doc_id", "left").withColumn("k", label)
    flat = named.select("doc_id", "f", F.explode(F.arrays_zip(F.col("f").alias("font"), "k")).alias("z"))
    return flat.select("doc_id", "z.font", F.get("f", F.col("z.k")).alias("family"), X.emphasis(F.col("z.font")).cast("long").alias("emphasis"))


def heading_score(lay: DataFrame) -> DataFrame:
    """Sum of the block signals: emphasis, length, longer neighbours, line counts and word count."""
    u = blocks(lay).join(majority_font(lay).select("doc_id", "block_no", "font", "size"), ["doc_id", "block_no"])
    first = F.min_by("text", "line_no")
    u = u.join(lay.groupBy("doc_id", "block_no").agg(first.alias("text")), ["doc_id", "block_no"])
    w = Window.partitionBy("doc_id").orderBy("block_no")
    e, n = X.emphasis(F.col("font")), F.col("n_chars")
    bold = F.when(e.isin(0, 2), -1.0).when(e == 3, 1.0).otherwise(2.0)
    length = F.when(n >= 150, -4.0).when((n >= 121) | (n <= 2), -2.0).otherwise(0.0)
    size = lambda k: F.lead("n_chars", k).over(w) if k > 0 else F.lag("n_chars", -k).over(w)
    rate = lambda c: F.when(c >= 75, 1.0).when(c >= 46, 0.5).otherwise(-1.0)
    prev, one, two = rate(size(-1)), rate(size(1)), rate(size(2))
    near = F.when(size(2).isNull(), 0.0).when(size(-1).isNull(), 0.5).when((prev == -1) & (one == -1) & (two == -1), -0.5).when((prev == 1) | (one == 1), 0.5).otherwise(0.0)
    words = F.when(F.size(F.split("text", " ")).between(2, 4), 0.5).otherwise(0.0)
    return u.select("doc_id", "block_no", (bold + length + near + words).alias("score"))


def recurring_rules(rules: DataFrame, heights: float = 800.0) -> DataFrame:
    """Horizontal rules of the outer quarters that no more than a few like rules of other pages repeat."""
    outer = rules.where((F.col("c") < heights / 4) | (F.col("c") > heights * 3 / 4))
    a, b = outer.alias("a"), outer.alias("b")
    iou = G.interval_iou(F.col("a.v0"), F.col("a.v1"), F.col("b.v0"), F.col("b.v1"))
    near = a.join(b, F.col("a.doc_id") == F.col("b.doc_id")).where((iou > 0.95) & (F.abs(F.col("a.c") - F.col("b.c")) < heights / 200))
    n = near.groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.rule_no").alias("rule_no")).agg(F.count("*").alias("n"))
    pages = rules.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    limit = F.least(F.lit(10.0), F.greatest(F.lit(3.0), (F.col("pages") - 2) / 3))
    return rules.join(n.join(pages, "doc_id").where(F.col("n") >= limit), ["doc_id", "rule_no"], "left_anti")


def markdown(lay: DataFrame) -> DataFrame:
    """One text for each document: unified parts as paragraphs, bold ones wrapped, a blank line between."""
    u = unify(without_blank(without_math(lay)))
    body = F.when(X.emphasis(F.col("font")).isin(1, 3), F.concat(F.lit("**"), F.trim("text"), F.lit("**"))).otherwise(F.col("text"))
    p = u.select("doc_id", F.struct("block_no", "part", body.alias("text")).alias("p"))
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]), "\n\n").alias("text"))


# What the first span of a footnote reads.
FOOT_MARK = r"(?U)\A(?:\w\d|\d\w|\d{1,3}|\w)\z"


def footnotes(spans: DataFrame, misses: int = 5) -> DataFrame:
    """Blocks that open with a raised or smaller mark, page by page from the bottom, until `misses` blocks do not.

    Raised: by over 0.05 of the height of the span after it; smaller: by over 0.05 of that one's size. All pages count.
    """
    rows = F.array_sort(F.collect_list(F.struct("line_no", "span_no", "text", "size", "y0", "y1", "oy")))
    b = spans.groupBy("doc_id", "block_no").agg(F.min("page_no").alias("page_no"), F.max("y1").alias("y1"), rows.alias("s"))
    one, two = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    raised = two["oy"] - one["oy"] > 0.05 * (two["y1"] - two["y0"])
    hit = F.coalesce(one["text"].rlike(FOOT_MARK) & (raised | (one["size"] < 0.95 * two["size"])), F.lit(False))
    w = Window.partitionBy(*PAGE).orderBy(F.desc("y1"), "block_no")
    before = F.coalesce(F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = b.withColumn("hit", hit).withColumn("_n", before).where(F.col("hit") & (F.col("_n") < misses))
    rest = F.array_join(F.transform(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda x: x["text"]), " ")
    return found.select("doc_id", "page_no", "block_no", one["text"].alias("number"), rest.alias("text"))


def like_places(boxes: DataFrame, other: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(doc_id, page_no, a, b, iou): boxes a and earlier ones b of a page whose IoUs along x and y multiply to over `least`, and each pair turned round.

    Boxes meet only where their tops lie in the same or a neighbouring band as tall as the tallest box.
    """
    page = ["doc_id", "page_no"]
    tall = boxes.unionByName(other, allowMissingColumns=True).groupBy(*page).agg(F.max(F.col("y1") - F.col("y0")).alias("tall"))
    banded = lambda d: d.join(tall, page).where("tall > 0").withColumn("band", F.floor(F.col("y0") / F.col("tall")))
    a = banded(boxes).select(*page, F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), *(F.col(c).alias(f"a_{c}") for c in (key, "x0", "y0", "x1", "y1")))
    b = banded(other).select(*page, "band", *(F.col(c).alias(f"b_{c}") for c in (key, "x0", "y0", "x1", "y1")))
    iou = G.axis_iou("a_", "b_", "x") * G.axis_iou("a_", "b_", "y")
    pairs = a.join(b, [*page, "band"]).where(F.col(f"a_{key}") > F.col(f"b_{key}")).withColumn("iou", iou).where(F.col("iou") > least)
    one = pairs.select(*page, F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), "iou")
    return one.unionByName(one.select(*page, F.col("b").alias("a"), F.col("a").alias("b"), "iou"))
