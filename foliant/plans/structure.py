"""Registered queries of the structural passes: spans, merges, lists, margins, ruled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import document, headings, layout, lists, margins, render, runs, tables
from foliant.plans.registry import BLOCKS_SQL, WITH, query
from foliant.sources.layout import MARKED_SQL, SPANS_SQL, boxes, lines_of, marked, spans

SPANS = f"{WITH}, {SPANS_SQL}"
MARKED = f"{WITH}, {MARKED_SQL}"


def _spans(spark, sf_dir):
    return spans(lines_of(spark, sf_dir))


def _marked(spark, sf_dir):
    return marked(lines_of(spark, sf_dir))


query("q_spans", f"{SPANS} SELECT doc_id, page_no, block_no, line_no, span_no, text, x0::DOUBLE AS x0, x1::DOUBLE AS x1, oy::DOUBLE AS oy, font, size::DOUBLE AS size, flags FROM sp")(lambda spark, sf_dir: _spans(spark, sf_dir).drop("y0", "y1"))


@query("q_merge_lines", f"{SPANS} SELECT doc_id, line_no, span_no, (sum(CASE WHEN f IS NULL OR (f = font AND s = size AND l = line_no) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, block_no ORDER BY line_no, span_no ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM (SELECT *, lag(font) OVER w AS f, lag(size) OVER w AS s, lag(line_no) OVER w AS l FROM sp WHERE trim(text) <> '' WINDOW w AS (PARTITION BY doc_id, block_no ORDER BY line_no, span_no))")
def q_merge_lines(spark, sf_dir):
    return runs.merge_lines(_spans(spark, sf_dir), ["line_no", "span_no"]).select("doc_id", "line_no", "span_no", "run")


@query("q_blank_spans", f"{SPANS} SELECT doc_id, line_no, min(span_no) AS span_no, string_agg(text, '' ORDER BY span_no) AS text FROM (SELECT *, sum(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY span_no) AS r FROM sp) WHERE r > 0 GROUP BY doc_id, line_no, r")
def q_blank_spans(spark, sf_dir):
    return runs.fold_blank_spans(_spans(spark, sf_dir)).select("doc_id", "line_no", "span_no", "text")


@query("q_merge_right", f"{SPANS} SELECT doc_id, line_no, span_no, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1 AS run FROM sp")
def q_merge_right(spark, sf_dir):
    one = _spans(spark, sf_dir).select("doc_id", "page_no", "line_no", "span_no", (F.col("line_no") * 100000 + F.col("span_no")).alias("block_no"), F.lit(1).alias("n_lines"), "x0", "y0", "x1", "y1")
    return runs.merge_to_right(one).select("doc_id", "line_no", "span_no", "run")


@query("q_unify_raised")
def q_unify_raised(spark, sf_dir):
    return runs.run_texts(runs.unify_spans(_spans(spark, sf_dir)))


@query("q_subscript")
def q_subscript(spark, sf_dir):
    return runs.fold_subscripts(_spans(spark, sf_dir))


@query("q_dropcap")
def q_dropcap(spark, sf_dir):
    return runs.fold_drop_caps(_spans(spark, sf_dir))


@query("q_combine_cont")
def q_combine_cont(spark, sf_dir):
    return runs.merge_sentences(runs.parsed_blocks(lines_of(spark, sf_dir))).select("doc_id", "block_no", "run", "pitch", "pitch_font", "pitch_size")


@query("q_combine_pitch")
def q_combine_pitch(spark, sf_dir):
    lay = lines_of(spark, sf_dir)
    return runs.merge_pitch(runs.parsed_blocks(lay), runs.pitch_cores(layout.line_pitch(lay))).select("doc_id", "block_no", "run")


# The same patterns without lookahead: what may follow is matched after the captured number.
_NUMBER = X.LIST_NUMBER
PLAIN = rf"^(\(?\[?{_NUMBER} ?[.:)\]\s])(?:\z|[^ %(]| {{1,3}}(?:\z|[^ %(0-9a-z])| {{4}})"
BRACKET = rf"^([(\[]{_NUMBER} ?[)\] ])(?:\z|[^ %(]| {{1,3}}(?:\z|[^ %(])| {{4}})"
WORD = rf"^([a-zA-Z,]{{2,}} +{_NUMBER}(?:[.:)\] ]|\s|\z))"
NUMBER_SQL = f"trim(coalesce(nullif(regexp_extract(text, '{PLAIN}', 1), ''), nullif(regexp_extract(text, '{BRACKET}', 1), ''), nullif(regexp_extract(text, '{WORD}', 1), '')))"


@query("q_numbered_candidates", f"{MARKED}, o AS (SELECT doc_id, block_no, arg_min(text, line_no) AS text, arg_min(font, line_no) AS font, arg_min(size, line_no) AS size FROM mk GROUP BY ALL) SELECT doc_id, block_no, {NUMBER_SQL} AS number, font, size, CASE WHEN font LIKE '%Bold%' THEN 1 ELSE 0 END + CASE WHEN font LIKE '%Italic%' THEN 2 ELSE 0 END AS emphasis FROM o WHERE {NUMBER_SQL} <> ''")
def q_numbered_candidates(spark, sf_dir):
    return lists.candidates(_marked(spark, sf_dir))


@query("q_split_numeral", f"{MARKED} SELECT doc_id, block_no, line_no, (sum(CASE WHEN line_no > f AND {NUMBER_SQL} <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block_no ORDER BY line_no))::BIGINT AS part FROM (SELECT *, min(line_no) OVER (PARTITION BY doc_id, block_no) AS f FROM mk)")
def q_split_numeral(spark, sf_dir):
    return runs.split_at_numerals(_marked(spark, sf_dir)).select("doc_id", "block_no", "line_no", "part")


@query("q_numbered_classes", "WITH c AS (SELECT l_orderkey, l_suppkey, l_linenumber AS n FROM lineitem) SELECT l_orderkey, l_suppkey, n, CASE WHEN n <= 26 THEN 'decimal' END AS class, n::INTEGER AS value, '.' AS sep FROM c")
def q_numbered_classes(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("n"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".")).alias("number"))
    r = li.select("l_orderkey", "l_suppkey", "n", X.separators(F.col("number")).alias("sep"), F.explode(X.readings(F.col("number"))).alias("r"))
    return r.select("l_orderkey", "l_suppkey", "n", F.col("r")[0]["class"].alias("class"), F.col("r")[0]["value"].alias("value"), "sep")


@query("q_numbered_legit")
def q_numbered_legit(spark, sf_dir):
    return lists.legitimate(lists.interpretations(lists.candidates(_marked(spark, sf_dir))))


@query("q_numbered")
def q_numbered(spark, sf_dir):
    return lists.numbered(_marked(spark, sf_dir))


GLYPH = r"^(●|•|◘|○|◙|⦿|‣|⁃|⁌|⁍|➡|◆|◇|◌|◈|➢|➣|➤|➥|➦|➧|➱|➮|▷|▶|▸|▹|▻|⊛|=>|->|>|\*|o|-)\s"


@query("q_bullets", f"""{MARKED}, o AS (SELECT doc_id, line_no AS block_no, font, size, x0, y0, y1, regexp_extract(text, '{GLYPH}', 1) AS glyph, text FROM mk), b AS (SELECT * FROM o WHERE glyph <> ''),
s AS (SELECT a.doc_id, a.block_no, a.glyph, a.text, sum(exp(-abs(a.x0 - b.x0) / (2 * a.y1 - a.y0))) AS score FROM b a JOIN b ON a.doc_id = b.doc_id AND a.glyph = b.glyph AND a.font = b.font AND a.size = b.size AND a.block_no <> b.block_no GROUP BY ALL HAVING score > 0.5)
SELECT doc_id, block_no, glyph, regexp_replace(substr(text, length(glyph) + 1), '^\\s+', '') AS rest, round(score, 6) AS score FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, glyph) >= 2""")
def q_bullets(spark, sf_dir):
    return lists.bullets(_marked(spark, sf_dir).withColumn("block_no", F.col("line_no")))


def _margin_blocks(spark, sf_dir):
    return layout.blocks(lines_of(spark, sf_dir)).withColumn("line_height", F.lit(12.0))


@query("q_margin_edges", f"{WITH}, {BLOCKS_SQL} SELECT doc_id, x0, x1, sum(n_lines)::BIGINT AS n FROM b WHERE x1 - x0 > 612.0 / 5 GROUP BY ALL")
def q_margin_edges(spark, sf_dir):
    return margins.edges(_margin_blocks(spark, sf_dir))


@query("q_margins")
def q_margins(spark, sf_dir):
    pages = lines_of(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    return margins.margins(margins.edges(_margin_blocks(spark, sf_dir)), pages)


def _grid_rules(spark, sf_dir):
    """A ruled grid on the first page of each document: 2 to 4 rows, 2 or 3 columns; one rule of each is drawn twice."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("doc_id") % 3 + 2).alias("r"), (F.col("doc_id") % 2 + 2).alias("c"))
    rule = lambda orient, c, v1: F.struct(F.lit(orient).alias("orient"), c.cast("double").alias("c"), F.lit(72.0).alias("v0"), v1.cast("double").alias("v1"))
    flat = F.transform(F.sequence(F.lit(0), F.col("r")), lambda i: rule("H", 72 + 30 * i, 72 + 60 * F.col("c")))
    tall = F.transform(F.sequence(F.lit(0), F.col("c")), lambda j: rule("V", 72 + 60 * j, 72 + 30 * F.col("r")))
    twice = F.array(rule("H", F.lit(73), 72 + 60 * F.col("c")))
    return d.select("doc_id", F.lit(0).cast("long").alias("page_no"), F.explode(F.concat(flat, tall, twice)).alias("r")).select("doc_id", "page_no", "r.*")


@query("q_rule_points", "SELECT doc_id, page_no, x, y FROM (SELECT doc_id, 0::BIGINT AS page_no, unnest(range(doc_id % 2 + 3)) AS j, doc_id % 3 + 3 AS n FROM documents), LATERAL (SELECT (72 + 60 * j)::DOUBLE AS x, unnest(list_transform(range(n), lambda i: (72 + 30 * i)::DOUBLE)) AS y)")
def q_rule_points(spark, sf_dir):
    return tables.crossings(tables.joined_rules(_grid_rules(spark, sf_dir)))


@query("q_tables", "SELECT doc_id, 0::BIGINT AS page_no, 0 AS table_no, 72.0::DOUBLE AS x0, 72.0::DOUBLE AS y0, (72 + 60 * (doc_id % 2 + 2))::DOUBLE AS x1, (72 + 30 * (doc_id % 3 + 2))::DOUBLE AS y1, ((doc_id % 2 + 2) * (doc_id % 3 + 2))::INTEGER AS cell_count, 'table' AS kind FROM documents")
def q_tables(spark, sf_dir):
    return tables.tables(_grid_rules(spark, sf_dir))


@query("q_rules_outside", "SELECT doc_id, 'H' AS orient, 700.0::DOUBLE AS c FROM documents")
def q_rules_outside(spark, sf_dir):
    r = _grid_rules(spark, sf_dir)
    more = r.select("doc_id", "page_no").distinct().select("*", F.lit("H").alias("orient"), F.lit(700.0).alias("c"), F.lit(72.0).alias("v0"), F.lit(200.0).alias("v1"))
    return tables.rules_outside(r.unionByName(more), tables.tables(r)).select("doc_id", "orient", "c")


TOP_SQL = "g AS (SELECT doc_id, block_no, font, size, sum(length(text)) AS chars, min(line_no) AS f FROM lay GROUP BY ALL), m AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, block_no ORDER BY chars DESC, f) = 1)"


@query("q_font_usage", f"{WITH}, {TOP_SQL} SELECT doc_id, font, CASE WHEN sum(chars) / sum(sum(chars)) OVER (PARTITION BY doc_id) > 0.1 THEN 0 ELSE 1 END AS font_code FROM m GROUP BY doc_id, font")
def q_font_usage(spark, sf_dir):
    return headings.font_usage(layout.majority_font(lines_of(spark, sf_dir)))


@query("q_size_usage", f"{WITH}, {TOP_SQL}, s AS (SELECT doc_id, size, sum(chars) / sum(sum(chars)) OVER (PARTITION BY doc_id) > 0.1 AS usual FROM m GROUP BY doc_id, size) SELECT doc_id, size, CASE WHEN usual THEN -1 WHEN size < min(CASE WHEN usual THEN size END) OVER (PARTITION BY doc_id) THEN -2 ELSE 1 END AS size_code FROM s")
def q_size_usage(spark, sf_dir):
    return headings.size_usage(layout.majority_font(lines_of(spark, sf_dir)))


@query("q_headings")
def q_headings(spark, sf_dir):
    lay = lines_of(spark, sf_dir)
    pages = lay.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    numbers = lists.numbered(marked(lay)).withColumn("vals", F.array("value"))
    return headings.signals(lay, margins.margins(margins.edges(_margin_blocks(spark, sf_dir)), pages), numbers)


def _beside(spark, sf_dir):
    """Each line as a block; two and two stand side by side. Marked ones carry their markers."""
    m = marked(lines_of(spark, sf_dir))
    bullet = F.when(F.col("text").startswith("• "), F.lit("•"))
    number = F.when(F.col("line_no") % 4 == 0, F.concat(F.lit("("), (F.col("line_no") / 4 + 1).cast("long"), F.lit(")")))
    y = F.col("y0") - 14 * (F.col("line_no") % 2)
    return m.select("doc_id", "page_no", F.col("line_no").alias("block_no"), "text", y.alias("y0"), (y + 12).alias("y1"), (F.col("line_no") % 3 == 1).alias("bold"), F.coalesce(number, bullet).alias("marker"))


@query("q_paragraphs")
def q_paragraphs(spark, sf_dir):
    return render.documents(render.paragraphs(render.block_text(_beside(spark, sf_dir))))


@query("q_paragraphs_observed", f"{WITH} SELECT doc_id, (line_no // 2)::BIGINT AS paragraph, text FROM lay WHERE line_no % 2 = 0")
def q_paragraphs_observed(spark, sf_dir):
    plain = _beside(spark, sf_dir).drop("text").join(lines_of(spark, sf_dir).select("doc_id", F.col("line_no").alias("block_no"), "text"), ["doc_id", "block_no"])
    return render.paragraphs(plain, intended=False)


@query("q_paragraphs_joined", f"{WITH} SELECT doc_id, (line_no // 2)::BIGINT AS paragraph, string_agg(text, ' ' ORDER BY line_no) AS text FROM lay GROUP BY doc_id, line_no // 2")
def q_paragraphs_joined(spark, sf_dir):
    plain = _beside(spark, sf_dir).drop("text").join(lines_of(spark, sf_dir).select("doc_id", F.col("line_no").alias("block_no"), "text"), ["doc_id", "block_no"])
    return render.paragraphs(plain)


@query("q_flagship")
def flagship(spark, sf_dir):
    """Marked lines, without tables, figures, math and running heads, through lists and merges to one Markdown text a document."""
    lay = _marked(spark, sf_dir).withColumn("font", F.when(F.col("block_no") % 6 == 5, F.lit("Serif-Bold")).otherwise(F.col("font")))
    return document.markdown(lay, boxes(lay, True, 60, 100, 300, 160), boxes(lay, False, 50, 60, 560, 130))


FOOT = rf"""{SPANS}, h AS (SELECT doc_id, block_no, min(line_no) AS line_no FROM sp GROUP BY ALL), k AS (SELECT sp.* REPLACE (CASE WHEN h.line_no IS NOT NULL AND span_no = 0 AND sp.block_no % 3 = 2 THEN (sp.block_no % 100)::VARCHAR ELSE text END AS text, CASE WHEN h.line_no IS NOT NULL AND span_no = 0 AND sp.block_no % 3 = 2 THEN size / 2 ELSE size END AS size) FROM sp LEFT JOIN h USING (doc_id, block_no, line_no)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY line_no, span_no) AS i FROM k),
b AS (SELECT doc_id, block_no, min(page_no) AS page_no, max(y1) AS y1, max(CASE WHEN i = 1 THEN text END) AS number, max(CASE WHEN i = 1 THEN oy END) AS o1, max(CASE WHEN i = 2 THEN oy END) AS o2, max(CASE WHEN i = 1 THEN size END) AS s1, max(CASE WHEN i = 2 THEN size END) AS s2, coalesce(string_agg(text, ' ' ORDER BY i) FILTER (WHERE i > 1), '') AS text FROM r GROUP BY doc_id, block_no),
m AS (SELECT *, coalesce(regexp_matches(number, '^(?:[\pL\pN_][0-9]|[0-9][\pL\pN_]|[0-9]{{1,3}}|[\pL\pN_])$') AND (o2 - o1 > 0.6 OR s1 < 0.95 * s2), false) AS hit FROM b),
n AS (SELECT *, coalesce(sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY y1 DESC, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS miss FROM m)
SELECT doc_id, page_no, block_no, number, text FROM n WHERE hit AND miss < 5"""


@query("q_footnote_marks", FOOT)
def q_footnote_marks(spark, sf_dir):
    """Every third block opens with a small number."""
    sp = _spans(spark, sf_dir)
    first = sp.groupBy("doc_id", "block_no").agg(F.min("line_no").alias("line_no")).withColumn("_h", F.lit(True))
    on = F.coalesce("_h", F.lit(False)) & (F.col("span_no") == 0) & (F.col("block_no") % 3 == 2)
    marked_spans = sp.join(first, ["doc_id", "block_no", "line_no"], "left").withColumns({"text": F.when(on, (F.col("block_no") % 100).cast("string")).otherwise(F.col("text")), "size": F.when(on, F.col("size") / 2).otherwise(F.col("size"))})
    return layout.footnotes(marked_spans.drop("_h"))
