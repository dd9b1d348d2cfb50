"""Merges of neighbouring lines, blocks and spans; each gives rows a run number, or folds spans into one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X
from foliant.operators import fold


def overlap(a0: float, a1: float, b0: float, b1: float) -> float:
    """Overlap over hull of two intervals; 0 if they only touch or are apart."""
    return 0.0 if b0 >= a1 or a0 >= b1 else (min(a1, b1) - max(a0, b0)) / (max(a1, b1) - min(a0, b0))


def merge_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """Numbers runs of a block's lines that share a baseline: one font and size, and y-IoU over 0.4 with the run's first line.

    A line of several fonts has a null font; it joins nothing and starts a run. Blank lines are dropped.
    """

    def joins(head, row):
        same = row["font"] is not None and (row["font"], row["size"]) == (head["font"], head["size"])
        return head if same and overlap(head["y0"], head["y1"], row["y0"], row["y1"]) > 0.4 else None

    return fold.runs(lines.where(F.col("text").rlike(r"(?U)\S")), ["doc_id", "block_no"], order, ["font", "size", "y0", "y1"], joins)


def fold_blank_spans(spans: DataFrame) -> DataFrame:
    """Appends a white-space span's text to the span kept before it on its line; leading blank spans go."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("span_no")
    run = F.sum(F.when(F.col("text").rlike(r"(?U)\S"), 1).otherwise(0)).over(w)
    kept = spans.withColumn("_r", run).where("_r > 0")
    head = [F.min_by(c, "span_no").alias(c) for c in spans.columns if c not in ("doc_id", "line_no", "text")]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "")
    return kept.groupBy("doc_id", "line_no", "_r").agg(*head, text.alias("text")).select(*spans.columns)


def split_at_numerals(lines: DataFrame) -> DataFrame:
    """Numbers the parts of each block, cut before a line that opens with a list number and lies over a third of a line below."""
    w = Window.partitionBy("doc_id", "block_no").orderBy("line_no")
    falls = F.col("y1") - F.lag("y1").over(w) > (F.lag("y1").over(w) - F.lag("y0").over(w)) / 3
    cut = F.when(falls & X.list_number(F.col("text")).isNotNull(), 1).otherwise(0)
    return lines.withColumn("_c", cut).withColumn("part", F.sum("_c").over(w).cast("long")).drop("_c")


def unify_spans(spans: DataFrame) -> DataFrame:
    """Numbers runs of a block's spans of one (font, size); `run` is null for raised spans of another font, which are dropped.

    A raised span that differs from the run's font leaves the run whole; the first span of a block is never dropped.
    """

    def step(state, row):
        key = (row["font"], row["size"])
        if state is None:
            return (0, key), (0,)
        if key == state[1]:
            return state, (state[0],)
        if row["flags"] & 1:
            return state, (None,)
        return (state[0] + 1, key), (state[0] + 1,)

    return fold.sorted_fold(spans, ["doc_id", "block_no"], ["line_no", "span_no"], ["font", "size", "flags"], T.StructType().add("run", T.LongType()), step)


def run_texts(spans: DataFrame) -> DataFrame:
    """The text of each run: spans joined by a space, unless white space meets there already."""
    l = F.array_sort(F.collect_list(F.struct("line_no", "span_no", "text", "font", "size")))
    glue = F.aggregate("l", F.lit(""), lambda acc, x: F.when((acc == "") | acc.rlike(r"(?U)\s\z") | x["text"].rlike(r"(?U)\A\s"), F.concat(acc, x["text"])).otherwise(F.concat(acc, F.lit(" "), x["text"])))
    rows = spans.where("run is not null").groupBy("doc_id", "block_no", "run").agg(l.alias("l"))
    return rows.select("doc_id", "block_no", "run", F.col("l")[0]["font"].alias("font"), F.col("l")[0]["size"].alias("size"), glue.alias("text"))


def merge_to_right(blocks: DataFrame, gap: float = 60.0) -> DataFrame:
    """Numbers runs of a page's blocks: a one-line block joins the next at its right, of like height; the grown block goes on.

    The grown block has the line count of the last one and the hull of all.
    """

    def joins(head, row):
        if head["n_lines"] != 1 or overlap(head["y0"], head["y1"], row["y0"], row["y1"]) <= 0.65 or row["x0"] - head["x1"] >= gap:
            return None
        return {"n_lines": row["n_lines"], "x0": min(head["x0"], row["x0"]), "y0": min(head["y0"], row["y0"]), "x1": max(head["x1"], row["x1"]), "y1": max(head["y1"], row["y1"])}

    return fold.runs(blocks, ["doc_id", "page_no"], ["block_no"], ["n_lines", "x0", "y0", "x1", "y1"], joins)


def _grown(head: dict, row: dict) -> dict:
    """Two parsed blocks as one: hull, summed counts, ends; the majority font is that with the most characters, ties to the first."""
    hist = dict(head["hist"])
    for k, n in row["hist"]:
        hist[k] = hist.get(k, 0) + n
    return head | {
        "x0": min(head["x0"], row["x0"]), "x1": max(head["x1"], row["x1"]), "hist": list(hist.items()), "key": max(hist, key=hist.get),
        "last_key": row["last_key"], "last_char": row["last_char"], "last_y1": row["last_y1"], "n_lines": head["n_lines"] + row["n_lines"],
    }


PARSED = ["page_no", "x0", "x1", "n_lines", "first_y1", "last_y1", "first_char", "last_char", "first_font", "first_size", "last_font", "last_size", "header", "hist"]


def _parsed(row: dict) -> dict:
    hist = [((h["font"], h["size"]), h["chars"]) for h in row["hist"]]
    return row | {"hist": hist, "key": max(dict(hist), key=dict(hist).get), "first_key": (row["first_font"], row["first_size"]), "last_key": (row["last_font"], row["last_size"])}


def _alike(head: dict, row: dict) -> bool:
    return head["key"] == row["key"] or head["last_key"] == row["first_key"]


def continues(head: dict, row: dict) -> bool:
    """Whether a block goes on with the sentence of the one before."""
    plain = not row["header"] and head["page_no"] == row["page_no"] and _alike(head, row)
    return plain and head["last_char"] not in ".?!" and row["first_char"].islower() and overlap(head["x0"], head["x1"], row["x0"], row["x1"]) > 0.85


def merge_sentences(parsed: DataFrame) -> DataFrame:
    """Numbers runs of blocks that go on with a sentence; `pitch` is what a one-line block adds to the pitches of `pitch_font`, `pitch_size`."""
    out = T.StructType().add("run", T.LongType()).add("pitch", T.DoubleType()).add("pitch_font", T.StringType()).add("pitch_size", T.DoubleType())

    def step(state, raw):
        row = _parsed(raw)
        if state is None or not continues(state[1], row):
            number = 0 if state is None else state[0] + 1
            return (number, row), (number, None, None, None)
        fall = row["first_y1"] - state[1]["last_y1"]
        extra = (round(fall, 1), *row["key"]) if row["n_lines"] == 1 and fall > 0 else (None, None, None)
        return (state[0], _grown(state[1], row)), (state[0], *extra)

    return fold.sorted_fold(parsed, ["doc_id"], ["block_no"], PARSED, out, step)


def merge_pitch(parsed: DataFrame, cores: DataFrame) -> DataFrame:
    """Numbers runs of blocks of one font whose first line lies below the last by a usual line pitch.

    `cores` holds doc_id, font, size, pitch, eps: the dense pitches; a fall within less than eps of one is usual.
    """
    models = cores.groupBy("doc_id").agg(F.collect_list(F.struct("font", "size", "pitch", "eps")).alias("cores"))

    def joins(head, raw):
        row = _parsed(raw)
        head = head if "key" in head else _parsed(head)
        fall = row["first_y1"] - head["last_y1"]
        if row["header"] or head["page_no"] != row["page_no"] or fall <= 0 or not _alike(head, row):
            return None
        usual = any((c["font"], c["size"]) == row["key"] and abs(c["pitch"] - fall) < c["eps"] for c in row["cores"] or ())
        return _grown(head, row) if usual else None

    return fold.runs(parsed.join(models, "doc_id", "left"), ["doc_id"], ["block_no"], [*PARSED, "cores"], joins).drop("cores")


def parsed_blocks(lay: DataFrame) -> DataFrame:
    """Blocks as the merges see them: ends, outer characters and fonts, and characters by font in order of appearance."""
    per = lay.groupBy("doc_id", "block_no", "font", "size").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.min("line_no").alias("first"))
    hist = per.groupBy("doc_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("first", "font", "size", "chars"))).alias("hist"))
    ends = [f("text" if c == "char" else c, "line_no").alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in ("y1", "char", "font", "size")]
    rows = lay.groupBy("doc_id", "block_no").agg(F.min("page_no").alias("page_no"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n_lines"), *ends)
    outer = {"first_char": F.substring("first_char", 1, 1), "last_char": F.expr("right(last_char, 1)")}
    return rows.withColumns(outer).join(hist, ["doc_id", "block_no"]).withColumn("header", F.lit("")).where("last_char <> ''")


def pitch_cores(pitches: DataFrame, least: int = 3) -> DataFrame:
    """Pitches of each (font, size) of a document with `least` of them within a hundredth of the largest."""
    by = ["doc_id", "font", "size"]
    scaled = pitches.withColumn("eps", F.max("pitch").over(Window.partitionBy(*by)) / 100).withColumn("_s", F.col("pitch") / F.col("eps"))
    near = F.expr("count(1) OVER (PARTITION BY doc_id, font, size ORDER BY _s RANGE BETWEEN 1D PRECEDING AND 1D FOLLOWING)")
    return scaled.withColumn("_n", near).where(F.col("_n") >= least).select(*by, "pitch", "eps").distinct()


SPAN = "struct<span_no:bigint,text:string,font:string,size:double>"


def fold_subscripts(spans: DataFrame) -> DataFrame:
    """Folds small low spans of a line into the span kept before, as `_{text} `; a null text is empty.

    A span is small if it has four characters at most and 0.95 of the size of the last small or absorbed one, or is the
    first such; it is low if its origin lies under that one's by over 0.02 of its height. What comes right after a folded
    span, in the font and size of the span that took it, is absorbed as well unless it ends the line. Longer spans are
    never what a later one is measured by. One array fold a line; nothing is lost where small spans follow one another.
    """
    line = ["doc_id", "block_no", "line_no"]
    s = F.struct("span_no", F.coalesce("text", F.lit("")).alias("text"), "font", "size", (F.col("y1") - F.col("y0")).alias("height"), "oy")
    lines = spans.groupBy(*line).agg(F.array_sort(F.collect_list(s)).alias("s")).withColumn("left", F.size("s"))

    def kept(x: Column, text: Column) -> Column:
        return F.struct(x["span_no"].alias("span_no"), text.alias("text"), x["font"].alias("font"), x["size"].alias("size"))

    def step(was: Column, x: Column) -> Column:
        head, mark = was["head"], was["mark"]
        alike = head["font"].eqNullSafe(x["font"]) & head["size"].eqNullSafe(x["size"])
        absorbed = was["open"] & alike & (was["left"] > 1)
        small = (F.length(x["text"]) <= 4) & (mark.isNull() | (x["size"] <= 0.95 * mark["size"]))
        low = ~absorbed & F.coalesce(small & (mark["height"] > 0) & (x["oy"] > mark["oy"] + 0.02 * mark["height"]), F.lit(False)) & head.isNotNull()
        starts = ~(absorbed | low)
        into = F.concat(head["text"], F.when(low, F.concat(F.lit("_{"), x["text"], F.lit("} "))).otherwise(x["text"]))
        return F.struct(
            F.when(starts & head.isNotNull(), F.concat(was["out"], F.array(head))).otherwise(was["out"]).alias("out"),
            F.when(starts, kept(x, x["text"])).otherwise(kept(head, into)).alias("head"),
            F.when(absorbed | F.coalesce(small, F.lit(False)), F.struct(x["size"].alias("size"), x["height"].alias("height"), x["oy"].alias("oy"))).otherwise(mark).alias("mark"),
            low.alias("open"),
            (was["left"] - 1).alias("left"),
        )

    none = lambda kind: F.lit(None).cast(kind)
    zero = F.struct(F.array().cast(f"array<{SPAN}>").alias("out"), none(SPAN).alias("head"), none("struct<size:double,height:double,oy:double>").alias("mark"), F.lit(False).alias("open"), F.col("left"))
    folded = F.aggregate("s", zero, step, lambda end: F.concat(end["out"], F.array(end["head"])))
    return lines.select(*line, F.explode(folded).alias("s")).select(*line, "s.*", F.lit(0).alias("style"))


def fold_drop_caps(spans: DataFrame) -> DataFrame:
    """Joins spans of a line that meet letter to letter in one font, as the last of them with style 3; then neighbours of one font and size.

    Two passes of gaps and islands. The second keeps the first span's number and style. A null text is empty.
    """
    line = ["doc_id", "block_no", "line_no"]
    own = Window.partitionBy(*line).orderBy("span_no")
    ends = F.lag("text").over(own).rlike(r"\p{L}$") & F.col("text").rlike(r"^\p{L}")

    def islands(df: DataFrame, meets: Column, pick) -> DataFrame:
        """One row a run of neighbours that meet: texts in order, the rest of the picked span, and how many they were."""
        numbered = df.withColumn("_new", F.when(F.coalesce(meets, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(own))
        texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "").alias("text")
        rest = pick(F.struct("span_no", "font", "size", "style"), "span_no").alias("_s")
        return numbered.groupBy(*line, "_run").agg(texts, rest, F.count("*").alias("_n")).select(*line, "_s.span_no", "text", "_s.font", "_s.size", "_s.style", "_n")

    base = spans.select(*line, "span_no", F.coalesce("text", F.lit("")).alias("text"), "font", "size", F.lit(0).alias("style"))
    met = islands(base, ends & (F.lag("font").over(own) == F.col("font")), F.max_by).withColumn("style", F.when(F.col("_n") > 1, 3).otherwise(0))
    alike = F.lag(F.struct("font", "size")).over(own) == F.struct("font", "size")
    return islands(met.drop("_n"), alike, F.min_by).drop("_n")


BLANK = ("", " ", "  ", "   ")


def donate_blanks(spans: DataFrame, unit: str) -> DataFrame:
    """Drops blank blocks of a page (unit "block") or blank lines of a block ("line"); their white space may move to the line kept before.

    Blank is a unit of no span but "" and one to three spaces. The first white-space span of each of its lines (for "line": the
    first that is empty or all white space) goes to the end of the last line kept before it if both overlap over 0.8 along y
    and it starts right of the middle of that line's last span, whose font and size it takes. Leading blank units go.
    """
    keys = ["doc_id", "page_no"] if unit == "block" else ["doc_id", "page_no", "block_no"]
    line = ["doc_id", "page_no", "block_no", "line_no"]
    own = Window.partitionBy(*(line[:3] if unit == "block" else line))
    gives = F.col("text").isin(*BLANK[1:]) if unit == "block" else ~F.col("text").rlike(r"(?U)\S")
    holds = ~F.coalesce("text", F.lit("")).isin(*BLANK)
    marked = spans.withColumn("_text", F.max(holds).over(own))
    pick = F.struct("span_no", "x0", "y0", "x1", "y1", "font", "size")
    # a gift is the whole span, so that the spans are not joined to what the fold says of it
    whole = F.struct(*(c for c in spans.columns if c not in line))
    # a row for each line first, so that only those rows, not the spans, are looked through by block
    each = spans.groupBy(*line).agg(F.max(holds).alias("held"), F.min_by(F.when(gives, whole), F.when(gives, F.col("span_no"))).alias("gift"), F.max_by(pick, "span_no").alias("last"))
    whose = each.withColumn("held", F.max("held").over(own)) if unit == "block" else each
    # nothing moves from lines without a gift, nor to a line that another follows before any gift
    after = F.lead("held").over(Window.partitionBy(*keys).orderBy(*(c for c in ("block_no", "line_no") if c not in keys)))
    per = whose.withColumns({"gift": F.when(~F.col("held"), F.col("gift")), "last": F.when(F.col("held"), F.col("last"))}).where("held or gift is not null").withColumn("_after", after).where("not held or not _after").drop("_after")

    def step(state, row):
        if row["held"]:
            return {"block": row["block_no"], "line": row["line_no"], **row["last"]}, (None,)
        gift = row["gift"]
        if state is None or gift is None or gift["x0"] < (state["x0"] + state["x1"]) / 2 or overlap(state["y0"], state["y1"], gift["y0"], gift["y1"]) <= 0.8:
            return state, (None,)
        state = {**state, **{k: gift[k] for k in ("text", "x0", "y0", "x1", "y1")}, "font": state["font"], "size": state["size"], "span_no": state["span_no"] + 1}
        return state, ({k: state[k] for k in ("block", "line", "span_no", "font", "size")},)

    to = T.StructType().add("block", "long").add("line", "long").add("span_no", "long").add("font", "string").add("size", "double")
    fields = ["block_no", "line_no", "held", "gift", "last"]
    moved = fold.sorted_fold(per, keys, [c for c in ("block_no", "line_no") if c not in keys], fields, T.StructType().add("to", to), step, dealt=True).where("to is not null")
    kept = marked.where("_text").drop("_text")
    gifts = moved.select("doc_id", "page_no", F.col("to.block").alias("block_no"), F.col("to.line").alias("line_no"), "gift.*", "to").withColumns({"span_no": F.col("to.span_no"), "font": F.col("to.font"), "size": F.col("to.size")})
    return kept.unionByName(gifts.select(*spans.columns))
