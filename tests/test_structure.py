"""Structural passes on small fixtures: golden values, brute force, and defined results for empty and odd rows."""

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import fold, layout, lists, margins, render, runs, tables
from foliant.plans import registry, structure  # noqa: F401  (adds its queries)
from foliant.sources import sinks
from foliant.streaming import documents as stream


def test_list_number_patterns(spark):
    want = {
        "(i) Abc": "(i)", "(a) xye": "(a)", "(1) uwerasd": "(1)", "(a) the description": "(a)", "1. Something": "1.", "2 . Something": "2 .", "3 . 3 . Something": "3 . 3 .",
        "4.5.9. Different": "4.5.9.", "4.6 around": "4.6", "Chapter 1 This is a good": "Chapter 1", "Figure 1.6: dt:birdtest": "Figure 1.6:", "Algorithm 2 DecisionTreeTest(tree)": "Algorithm 2",
        "the other three features from Figure 1.3": None, "A1 other features": None, "Subsection 1.2.3 ": "Subsection 1.2.3", "Chart 3": "Chart 3", "Table 1. The Static": "Table 1.", "": None,
    }
    rows = spark.createDataFrame(list(want), "string").select("value", X.list_number(F.col("value")).alias("n")).collect()
    assert {r.value: r.n for r in rows} == want


def test_readings_and_survivors(spark):
    got = spark.createDataFrame(["1.i", "B)"], "string").select(X.readings(F.col("value")).alias("r")).collect()
    assert [[(t["class"], t["value"]) for t in r] for r in got[0].r] == [[("decimal", 1), ("lower", 9)], [("decimal", 1), ("roman_lower", 1)]]
    assert [[(t["class"], t["value"]) for t in r] for r in got[1].r] == [[("upper", 2)]]
    assert lists.survivors(["."], [1], False) == [False] and lists.survivors([".", "."], [1, 2], False) == [True, True]
    assert lists.survivors([".", "."], [4, 9], False) == [False, False] and lists.survivors(["", ""], [1, 2], True) == [False, False]

    def brute(seps, lasts):
        alive, out, i = list(zip(seps, lasts)), [], 0
        if len(alive) < 2:
            return [False] * len(alive)
        while i < len(alive):
            s, n = alive[i]
            gains = {lists.STEP.get(n - m, 0.0) * (s == t) * (2 if n in (1, 2, 3) else 1) for t, m in alive}
            out.append(sum(gains) >= 1)
            i += 1 if out[-1] else 0
            if not out[-1]:
                alive.pop(i)
        return out

    for lasts in itertools.product((1, 2, 4, 5, 6), repeat=4):
        seps = [".", ".", ")", "."]
        assert lists.survivors(seps, list(lasts), False) == brute(seps, lasts)


def test_labels(spark):
    edges = [(0, 3), (4, 5), (3, 1), (5, 1)]
    df = spark.createDataFrame([(7, edges), (2, [])], "n int, e array<struct<a:int,b:int>>")
    assert {tuple(r.l) for r in df.select(fold.labels(F.col("n"), F.col("e")).alias("l")).collect()} == {(0, 0, 2, 0, 0, 0, 6), (0, 1)}


LINE = "doc_id long, block_no long, line_no long, font string, size double, y0 double, y1 double, text string"


def test_merge_lines_compares_with_the_first(spark):
    rows = [(1, 0, 0, "A", 10.0, 0.0, 10.0, "a"), (1, 0, 1, "A", 10.0, 4.0, 14.0, "b"), (1, 0, 2, "A", 10.0, 8.0, 18.0, "c"), (1, 0, 3, None, 10.0, 8.0, 18.0, "d"), (1, 0, 4, None, 10.0, 8.0, 18.0, "e"), (1, 0, 5, "A", 10.0, 8.0, 18.0, " "), (2, 0, 0, "A", 10.0, 0.0, 10.0, "z")]
    got = {(r.doc_id, r.line_no): r.run for r in runs.merge_lines(spark.createDataFrame(rows, LINE), ["line_no"]).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 0): 0}
    assert runs.merge_lines(spark.createDataFrame([], LINE), ["line_no"]).collect() == []


def test_merge_right_grows(spark):
    rows = [(1, 0, 0, 1, 0.0, 0.0, 50.0, 10.0), (1, 0, 1, 1, 100.0, 1.0, 150.0, 11.0), (1, 0, 2, 3, 200.0, 0.0, 250.0, 11.0), (1, 0, 3, 1, 260.0, 0.0, 300.0, 11.0), (1, 0, 4, 1, 400.0, 0.0, 410.0, 11.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, block_no long, n_lines int, x0 double, y0 double, x1 double, y1 double")
    assert [r.run for r in runs.merge_to_right(df).orderBy("block_no").collect()] == [0, 0, 0, 1, 2]


def block(no, font="A", n=1, first="x", last="x", y0=0.0, y1=10.0, page=0, x0=0.0, x1=100.0, header="", chars=10):
    return (1, no, page, x0, x1, n, y0, y1, first, last, font, 10.0, font, 10.0, header, [(0, font, 10.0, chars)])


PARSED = "doc_id long, block_no long, page_no long, x0 double, x1 double, n_lines int, first_y1 double, last_y1 double, first_char string, last_char string, first_font string, first_size double, last_font string, last_size double, header string, hist array<struct<first:long,font:string,size:double,chars:long>>"


def test_merge_sentences(spark):
    rows = [block(0, last=","), block(1, y0=24.0, y1=24.0), block(2, last="."), block(3), block(4, first="X"), block(5, "B"), block(6, page=1), block(7, "B", page=1, x0=90.0, x1=300.0)]
    got = runs.merge_sentences(spark.createDataFrame(rows, PARSED)).orderBy("block_no").collect()
    assert [r.run for r in got] == [0, 0, 0, 1, 2, 3, 4, 5] and [r.pitch for r in got] == [None, 14.0, None] + [None] * 5


def test_merge_pitch(spark):
    cores = spark.createDataFrame([(1, "A", 10.0, 14.0, 0.2)], "doc_id long, font string, size double, pitch double, eps double")
    rows = [block(0, y0=10.0, y1=24.0), block(1, y0=38.1, y1=38.1), block(2, y0=52.4, y1=60.0), block(3, "B", y0=74.0, y1=74.0), block(4, "B", y0=88.0, y1=88.0)]
    assert [r.run for r in runs.merge_pitch(spark.createDataFrame(rows, PARSED), cores).orderBy("block_no").collect()] == [0, 0, 1, 2, 3]
    pitches = spark.createDataFrame([(1, "A", 10.0, p) for p in (14.0, 14.1, 14.0, 20.0, 30.0)], "doc_id long, font string, size double, pitch double")
    assert {r.pitch for r in runs.pitch_cores(pitches).collect()} == {14.0, 14.1}


SPANS = "doc_id long, block_no long, line_no long, span_no long, text string, font string, size double, y0 double, y1 double, oy double"


def line_of(spark, *spans):
    """One line of (text, size, oy) spans, which default to 10 and 8; a row each."""
    full = [(s, 10.0, 8.0)[:3] if isinstance(s, str) or s is None else (*s, 8.0)[:3] for s in spans]
    return spark.createDataFrame([(1, 0, 0, i, t, "A", size, 0.0, 10.0, oy) for i, (t, size, oy) in enumerate(full)], SPANS)


def test_subscripts_and_drop_caps(spark):
    sub = lambda *spans: [r.text for r in runs.fold_subscripts(line_of(spark, *spans)).orderBy("span_no").collect()]
    assert sub("H", ("2", 5.0, 9.5), "O", "x") == ["H_{2} O", "x"]
    assert sub("longer", ("2", 5.0, 9.5)) == ["longer", "2"]
    assert sub("only") == ["only"]
    assert sub("H", ("2", 5.0, 9.5), "O") == ["H_{2} ", "O"]  # the last span of a line is not absorbed
    assert sub("H", ("2", 5.0, 9.5), ("3", 4.0, 11.0), "x") == ["H_{2} _{3} ", "x"]
    assert sub(None, "b") == ["", "b"]
    drop = lambda *spans: [(r.text, r.style) for r in runs.fold_drop_caps(line_of(spark, *spans)).orderBy("span_no").collect()]
    assert drop(("T", 30.0), "he end", "1") == [("The end1", 3)]
    assert drop(("A", 30.0), ("b", 20.0), ("c", 10.0), ("!", 30.0)) == [("Abc", 3), ("!", 0)]
    assert drop("a ", "b", None) == [("a b", 0)]
    empty = spark.createDataFrame([], SPANS)
    assert runs.fold_subscripts(empty).count() == 0 == runs.fold_drop_caps(empty).count()


def test_unify_drops_raised_spans(spark):
    rows = [(1, 0, 0, 0, "a", "A", 10.0, 0), (1, 0, 0, 1, "2", "B", 5.0, 1), (1, 0, 0, 2, "b ", "A", 10.0, 0), (1, 0, 1, 3, "c", "A", 10.0, 0), (1, 0, 1, 4, "d", "B", 10.0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, block_no long, line_no long, span_no long, text string, font string, size double, flags int")
    assert [r.text for r in runs.run_texts(runs.unify_spans(df)).orderBy("run").collect()] == ["a b c", "d"]


def test_margins_against_brute_force(spark):
    rows = [(1, 72.0, 500.0, 9), (1, 74.0, 501.0, 3), (1, 77.5, 500.0, 2), (1, 300.0, 500.0, 8), (1, 150.0, 400.0, 1), (2, 60.0, 400.0, 1)]
    pts = spark.createDataFrame(rows, "doc_id long, x0 double, x1 double, n long")
    pages = spark.createDataFrame([(1, 3), (2, 1)], "doc_id long, pages long")
    got = sorted((r.doc_id, r.x0, r.x1) for r in margins.margins(pts, pages).collect())
    assert got == [(1, 72.0, 500.0), (1, 300.0, 500.0), (2, 60.0, 400.0)]
    blocks = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 200.0, 40.0, 3, 10.0), (1, 0, 1, 0.0, 30.0, 200.0, 60.0, 2, 10.0), (1, 0, 2, 5.0, 41.0, 205.0, 60.0, 2, 10.0), (1, 0, 3, 5.0, 90.0, 20.0, 100.0, 1, 10.0)], "doc_id long, page_no long, block_no long, x0 double, y0 double, x1 double, y1 double, n_lines int, line_height double")
    assert sorted((r.x0, r.n) for r in margins.edges(blocks).collect()) == [(0.0, 3), (5.0, 2)]


def test_table_with_a_merged_cell(spark):
    h = [("H", 0.0, 0.0, 200.0), ("H", 50.0, 0.0, 200.0), ("H", 100.0, 0.0, 200.0)]
    v = [("V", 0.0, 0.0, 100.0), ("V", 100.0, 50.0, 100.0), ("V", 200.0, 0.0, 100.0)]
    df = spark.createDataFrame([(1, 0, *r) for r in h + v], "doc_id long, page_no long, orient string, c double, v0 double, v1 double")
    got = tables.tables(df, 400.0, 400.0).collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.cell_count, r.kind) for r in got] == [(0.0, 0.0, 200.0, 100.0, 3, "table")]
    assert tables.tables(df.where("false")).collect() == []


def test_page_numbers(spark):
    rows = [(1, p, 10 * p + i, t, 0.0, 20.0 * i, 50.0, 20.0 * i + 10) for p in range(3) for i, t in enumerate([f"{p + 4}", f"body {'xyz'[p]}", "12"])]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, line_no long, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r.line_no for r in layout.running_heads(df).collect()} == {0, 10, 20}


@pytest.mark.parametrize("name", ["q_hf_score", "q_hf_removed"])
def test_heads_of_long_documents(spark, tmp_path, name):
    """Page numbers of one and of two digits, and lines that are one letter or a number, against the query's SQL."""
    texts = [(i, "\n".join(("a", "7", f"line {j * i}", "iv", "same")[(j * 7 + i) % 5] for j in range(12 * 14 + i))) for i in range(3)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(registry.SQL[name]).fetchall())
    assert want and sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_markers(spark):
    rows = [("1. One", "1."), ("**(a) Two**", "(a)"), ("three", "•"), ("four", None)]
    got = spark.createDataFrame(rows, "t string, m string").select(render.with_marker(F.col("t"), F.col("m")).alias("x")).collect()
    assert [r.x for r in got] == ["1.  One", "**(a)  Two**", "• three", "four"]


def test_stream_and_sinks(spark, tmp_path):
    from foliant.sources.layout import lines_of

    lay = lines_of(spark, "/root/testdata/sf0.001").where("doc_id < 20")
    lay.write.parquet(str(tmp_path / "in"))
    q = stream.markdown_stream(stream.lines_stream(spark, str(tmp_path / "in"), lay.schema), str(tmp_path / "out"), str(tmp_path / "chk"), once=True)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in layout.markdown(lay).select("doc_id", "text").collect()}
    sinks.write_markdown(got, str(tmp_path / "md"))
    assert spark.read.json(str(tmp_path / "md")).count() == got.count()
    assert sinks.page_texts(spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, None)], "doc_id long, page_no int, text string")).first().text == "a\n\nb"
    with pytest.raises(ValueError):
        sinks.write_rows(spark, [(1, 2)], ["a"], "t")
