"""Raster, open tables, borderless tables, blank units, approximate numbers and page margins against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import bands, cluster, margins, raster, runs, tables
from foliant.plans import pages, registry  # noqa: F401

RULES = "doc_id long, page_no long, orient string, c double, v0 double, v1 double"


def test_components_against_flood_fill():
    rng = np.random.default_rng(7)
    for share in (0.2, 0.45, 0.7):
        on = rng.random((13, 17)) < share
        for reach, near in ((1, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]), (0, [(0, 1), (1, 0), (0, -1), (-1, 0)])):
            seen = np.full(on.shape, -1)
            for k, start in enumerate(zip(*np.nonzero(on), strict=True)):
                todo = [start] if seen[start] < 0 else []
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < 13 and 0 <= x < 17 and on[y, x] and seen[y, x] < 0:
                        seen[y, x] = k
                        todo += [(y + a, x + b) for a, b in near]
            rows = raster.spans_of(on)
            label = raster.components(rows, reach)
            pairs = {(int(seen[y, a]), int(k)) for (y, a, _), k in zip(rows.tolist(), label, strict=True)}
            assert len(pairs) == len({p for p, _ in pairs}) == len({k for _, k in pairs}) == len(set(seen[on]))


def test_opening_step_by_step():
    rng = np.random.default_rng(3)
    on = rng.random((6, 60)) < 0.93

    def once(a, length, erode):
        back = length // 2
        out = np.zeros_like(a)
        for x in range(a.shape[1]):
            window = a[:, max(0, x - back) : max(0, min(a.shape[1], x - back + length))]
            out[:, x] = window.all(axis=1) if erode else window.any(axis=1)
        return out

    for length in (1, 2, 3):
        want = on
        for erode in (True,) * 4 + (False,) * 4:
            want = once(want, length, erode)
        assert (raster.opened(on, length) == want).all()


def test_ink_outlines_and_odd_pages(spark):
    gray = np.full((5, 5), 200, np.uint8)
    gray[2, 2] = 100
    assert raster.ink(gray).sum() == 1
    ring = np.zeros((7, 8), bool)
    ring[1:6, 1:7] = True
    ring[2:5, 2:6] = False
    assert sorted(raster.outlines(ring)) == [(1, 1, 6, 5), (1, 1, 6, 5)]
    rows = [(1, 0, 4, 4, None), (1, 1, 4, 4, b"123"), (1, 2, 0, 0, b""), (1, 3, 4, 4, b"\xff" * 16)]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, width int, height int, gray binary")
    assert raster.rules(df).collect() == []


def test_sides(spark):
    flat = [("H", y, 100, 400) for y in (100, 150, 200)]
    inner = [("V", 250, 100, 200)]
    assert tables.sides_of(flat + inner) == [(100, 100, 200), (399, 100, 200)]
    assert tables.sides_of([("H", 10, 0, 50), ("V", 0, 10, 40)]) == []  # under 100 pixels
    assert tables.sides_of([]) == []
    df = spark.createDataFrame([(1, 0, o, float(c), float(a), float(b)) for o, c, a, b in flat + inner] + [(1, 1, "H", 5.0, 0.0, 200.0)], RULES)
    assert tables.with_sides(df).count() == len(flat) + len(inner) + 3
    got = tables.tables(df).collect()
    assert [(r.page_no, r.x0, r.y0, r.x1, r.y1, r.cell_count) for r in got] == [(0, 100.0, 100.0, 399.0, 200.0, 4)]
    assert tables.tables(df, close=False).collect() == []


def test_painted_sides_by_pixels():
    rng = random.Random(5)
    for _ in range(40):
        rules = [(rng.choice("HV"), rng.randrange(0, 60), a := rng.randrange(0, 40), a + rng.randrange(20, 60)) for _ in range(rng.randrange(1, 9))]
        on = np.zeros((120, 120), bool)
        for o, c, a, b in rules:
            if o == "H":
                on[c, a:b] = True
            else:
                on[a:b, c] = True
        want, run = [], raster.spans_of(on)
        label = raster.components(run)
        for k in np.unique(label):
            own = np.zeros_like(on)
            for y, a, b in run[label == k].tolist():
                own[y, a:b] = True
            if own.sum() < 100:
                continue
            rows = [np.flatnonzero(r) for r in own if r.any()]
            for ends, back in (([int(r[0]) for r in rows], False), ([int(r[-1]) for r in rows], True)):
                xs = sorted(set(ends), reverse=back)
                side, pooled = xs[0], [xs[0]]
                for x in xs[1:]:
                    if abs(side - x) > 8:
                        break
                    pooled.append(x)
                    if ends.count(x) > ends.count(side):
                        side = x
                if sum(ends.count(x) for x in pooled) > 1:
                    ys = np.nonzero(own[:, pooled])[0]
                    want.append((side, int(ys.min()), int(ys.max())))
        assert sorted(tables.sides_of(rules)) == sorted(want)


def test_covered_and_overlaps(spark):
    df = spark.createDataFrame([(1, 0, "H", 5.0, 0.0, 10.0), (1, 0, "H", 5.0, 2.0, 4.0), (1, 0, "H", 5.0, 10.0, 12.0), (1, 0, "H", 5.0, 13.0, 14.0)], RULES)
    assert sorted((r.v0, r.v1) for r in tables.covered(df).collect()) == [(0.0, 12.0), (13.0, 14.0)]
    assert tables.without_overlaps([(0, 0, 10, 10), (0, 0, 10, 9), (20, 0, 30, 10)]) == [(0, 0, 10, 9), (20, 0, 30, 10)]
    assert tables.without_overlaps([(0, 0, 5, 5), (0, 0, 5, 5)]) == [(0, 0, 5, 5)]
    assert tables.without_overlaps([]) == [] and tables.corner_cells([]) == []


def test_borderless(spark):
    rules = [(1, 0, "H", 10.0, 0.0, 100.0), (1, 0, "H", 30.0, 1.0, 100.0), (1, 0, "H", 50.0, 0.0, 101.0), (1, 0, "H", 70.0, 0.0, 100.0), (1, 0, "H", 60.0, 300.0, 310.0), (1, 0, "V", 5.0, 0.0, 9.0)]
    df = spark.createDataFrame(rules, RULES)
    got = sorted((r.c, r.grp, r.n, r.v0, r.v1) for r in bands.alike(df).collect())
    assert got == [(10.0, 0, 1, 0.0, 101.0), (30.0, 0, 2, 1.0, 100.0), (50.0, 0, 3, 0.0, 101.0), (60.0, 1, 1, 300.0, 310.0), (70.0, 0, 4, 0.0, 100.0)]
    words = [(1, 0, 100 * y + x, 20.0 * x, float(y), 20.0 * x + 10, y + 8.0) for y in (12, 32, 52) for x in range(4 if y < 50 else 2)]
    sp = spark.createDataFrame(words, "doc_id long, page_no long, span_id long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.x0, r.y0, r.x1, r.y1, r.n_bands) for r in bands.borderless(df, sp).collect()] == [(0.0, 10.0, 101.0, 50.0, 2)]
    assert bands.borderless(df.where("false"), sp).collect() == [] and bands.borderless(df, sp.where("false")).collect() == []


SPAN = "doc_id long, page_no long, block_no long, line_no long, span_no long, text string, x0 double, y0 double, x1 double, y1 double, font string, size double"


def test_blank_units(spark):
    rows = [
        (1, 0, 0, 0, 0, " ", 0.0, 0.0, 5.0, 10.0, "A", 9.0),  # leading: goes
        (1, 0, 1, 1, 0, "word", 0.0, 20.0, 50.0, 30.0, "B", 10.0),
        (1, 0, 2, 2, 0, "", 60.0, 20.0, 61.0, 30.0, "A", 9.0),
        (1, 0, 2, 2, 1, "  ", 60.0, 20.0, 70.0, 30.0, "A", 9.0),  # moves behind "word"
        (1, 0, 2, 3, 0, " ", 64.0, 20.0, 70.0, 30.0, "A", 9.0),  # left of that one's middle: goes
        (1, 0, 3, 4, 0, " ", 66.0, 20.0, 75.0, 30.0, "A", 9.0),  # moves too
        (1, 0, 4, 5, 0, "    ", 80.0, 20.0, 90.0, 30.0, "A", 9.0),  # four spaces are not blank
        (1, 0, 5, 6, 0, " ", 99.0, 60.0, 105.0, 70.0, "A", 9.0),  # elsewhere: goes
        (1, 0, 6, 7, 0, "x", 0.0, 80.0, 9.0, 90.0, "C", 8.0),
        (1, 0, 6, 8, 0, " ", 9.0, 80.0, 12.0, 90.0, "A", 9.0),
    ]
    df = spark.createDataFrame(rows, SPAN)
    got = sorted((r.block_no, r.line_no, r.span_no, r.text, r.font, r.size) for r in runs.donate_blanks(df, "block").collect())
    assert got == [(1, 1, 0, "word", "B", 10.0), (1, 1, 1, "  ", "B", 10.0), (1, 1, 2, " ", "B", 10.0), (4, 5, 0, "    ", "A", 9.0), (6, 7, 0, "x", "C", 8.0), (6, 8, 0, " ", "A", 9.0)]
    got = sorted((r.block_no, r.line_no, r.span_no, r.text, r.font) for r in runs.donate_blanks(runs.donate_blanks(df, "block"), "line").collect())
    assert got[-2:] == [(6, 7, 0, "x", "C"), (6, 7, 1, " ", "C")] and len(got) == 6
    assert runs.donate_blanks(df.where("false"), "block").collect() == []


@pytest.mark.parametrize("name", ["q_blank_lines", "q_blank_blocks"])
def test_blank_units_move_no_words(spark, name):
    """Of the rows for each word none are shuffled: only documents are, and a row for each line."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not any("line_no" in x or "span_no" in x for x in dealt) and "Join" not in plan


@pytest.mark.parametrize("name", ["q_blank_lines", "q_blank_blocks"])
def test_blank_units_deal_documents_once(spark, name):
    """Documents are the only rows that are shuffled, lines follow them; words are sorted once in each of the two branches."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange " in x]
    assert dealt and all("hashpartitioning(doc_id" in x and "page_no" not in x for x in dealt)
    assert sum(" Sort [" in x for x in plan.splitlines()) == 2


def test_rasters_come_few_at_a_time(spark, monkeypatch):
    """Ten thousand rasters at a time do not fit a worker: the rules are planned with BATCH, and the setting is as before after."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, kept = spark.conf.get(setting), [], raster.cut
    monkeypatch.setattr(raster, "cut", lambda df, name: seen.append(spark.conf.get(setting)) or kept(df, name))
    assert registry.QUERIES["q_raster_rules"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [str(raster.BATCH)] and spark.conf.get(setting) == before


def test_approximate(spark):
    known = cluster.approximations(spark.createDataFrame([(1, x) for x in (1.0, 2.0, 10.0, None)], "g int, x double"), ["g"], "x", 5.0)
    assert sorted((r.x, r["mean"]) for r in known.collect()) == [(1.0, 1.5), (2.0, 1.5), (10.0, 10.0)]
    own = spark.createDataFrame([(i, 1, x) for i, x in enumerate((1.0, 2.0, 1.5, 8.0, 5.0, 11.0, None))] + [(9, 2, 1.0)], "id int, g int, x double")
    got = {r.id: r.approx for r in cluster.approximate(own, known, ["g"], "x", 5.0).collect()}
    assert got == {0: 1.5, 1: 1.5, 2: 2.0, 3: 10.0, 4: None, 5: None, 6: None, 9: None}


def test_page_margins(spark):
    lines = [(1, p, b, 10.0 + (b == 2), 90.0) for p in range(2) for b in (0, 1, 2, 2, 2)] + [(1, 1, 3, 40.0, 60.0)]
    df = spark.createDataFrame(lines, "doc_id long, page_no long, block_no long, x0 double, x1 double")
    b = df.groupBy("doc_id", "page_no", "block_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n_lines"))
    assert sorted((r.page_no, round(r.lo, 3), r.hi) for r in margins.extents(df).collect()) == [(0, 10.6, 90.0), (1, 10.6, 90.0)]
    got = sorted((r.page_no, round(r.x0, 3), r.x1, r.lines_in_page, r.lines_in_doc) for r in margins.per_page(margins.edge_frame(df, b)).collect())
    # Block edges 10, 10 and 11 of both pages count as their mean; a page's extent (10.6) lies next below the edge 11.
    assert got == [(0, 10.333, 90.0, 5, 10), (0, 11.0, 90.0, 5, 10), (1, 10.333, 90.0, 5, 10), (1, 11.0, 90.0, 5, 10)]
    assert margins.per_page(margins.edge_frame(df.where("false"), b.where("false"))).collect() == []


@pytest.mark.parametrize("name", ["q_approximate", "q_margin_pages", "q_blank_blocks", "q_blank_lines"])
def test_queries_without_sql_run(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
