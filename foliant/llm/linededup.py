"""Line dedup: winnowing over line hashes, joined positions, matches extended both ways, later repeated runs deleted."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import arrow_map, stash, texts_of, unstash

#: A run counts as repeated from so many lines, or from so many words.
MIN_LINES, MIN_WORDS = 3, 50
#: A run of fewer than MIN_LINES lines with MIN_WORDS words holds a line of so many words: those are always fingerprints.
LONG_LINE = -(-MIN_WORDS // (MIN_LINES - 1))
REACH = MIN_LINES - 1
#: Runs that occur this often, and more often than one of HOT_SHARE parts of all, are joined by broadcast: at most HOT_SHARE of them.
HOT, HOT_SHARE = 1000, 50_000


def content_lines(text: bytes) -> tuple[list[int], list[bytes], np.ndarray]:
    """Number, 128-bit hash and word count of each line that is not blank; space around a line does not count."""
    at, digests, words = [], [], []
    for i, line in enumerate(text.split(b"\n")):
        if line := line.strip():
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(line))
            words.append(len(line.split()))
    return at, digests, np.array(words, np.int64)


def winnow(digests: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Positions of the least hash of each window of MIN_LINES lines (the last of equal ones), and of long lines.

    Two equal runs of MIN_LINES lines hold a window in common, so the same line of both is selected.
    """
    n = len(digests)
    if not n:
        return np.zeros(0, np.int64)
    w = min(MIN_LINES, n)
    windows = np.lib.stride_tricks.sliding_window_view(digests, w)[:, ::-1]
    least = np.arange(n - w + 1) + (w - 1) - windows.argmin(axis=1)
    return np.union1d(least, np.nonzero(words >= LONG_LINE)[0])


def line_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per selected line: its hash, its document and the REACH lines on either side of it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("k").to_pylist(), texts_of(batch), strict=True):
            at, digests, words = content_lines(text)
            for i in winnow(np.frombuffer(b"".join(digests), "<i8")[::2], words):
                a, b = max(0, i - REACH), i + REACH + 1
                for col, v in zip(cols, (digests[i], doc, key, i - a, b"".join(digests[a:b]), np.stack([words[a:b], at[a:b]]).astype(np.int32).tobytes()), strict=True):
                    col.append(v)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["fp", "doc_id", "k", "own", "near", "info"])

    return arrow_map(docs, run, "fp binary, doc_id long, k long, own int, near binary, info binary")


def extend(words: np.ndarray, own: int) -> list[tuple[int, int]]:
    """[start, end) of the shortest runs that count and hold line `own`, looking both ways.

    A longer run is the union of such runs, each of which holds a fingerprint, so no match has to be followed farther.
    """
    n, runs = len(words), []
    for a in range(max(0, own - REACH), own + 1):
        for b in range(own + 1, min(n, a + MIN_LINES) + 1):
            if b - a == MIN_LINES or words[a:b].sum() >= MIN_WORDS:
                runs.append((a, b))
    return runs


def runs_of(repeated: DataFrame) -> DataFrame:
    """Each shortest run that counts, around fingerprints that occur more than once: hash, document and line numbers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for doc, key, own, near, info in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "own", "near", "info")), strict=True):
            words, at = np.frombuffer(info, np.int32).reshape(2, -1)
            for a, b in extend(words, own):
                for col, v in zip(cols, (xxhash.xxh3_128_digest(near[16 * a : 16 * b]), doc, key, int(at[a]), at[a:b].tolist()), strict=True):
                    col.append(v)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["run", "doc_id", "k", "start", "lines"])

    return arrow_map(repeated, run, "run binary, doc_id long, k long, start int, lines array<int>")


def _without(text: pd.Series, lines: pd.Series) -> pd.DataFrame:
    out = []
    for t, gone in zip(text, lines, strict=True):
        parts = [] if t is None else t.split("\n")
        drop = set() if gone is None else {int(i) for i in gone}
        out.append((None if t is None else "\n".join(x for i, x in enumerate(parts) if i not in drop) if drop else t, len(parts), len(drop)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Delete later repeats of runs of lines. All columns of docs come back, `text` without them, and `n_lines`, `n_removed`.

    A line goes if it lies in a run of MIN_LINES lines, or of fewer lines with MIN_WORDS words, that equals a run
    which starts earlier by (doc_id, start); the earliest run stays. Runs may overlap and join up, so a repeat
    of any length goes as a whole. Blank lines never count, are looked past and stay. Space around a line does not
    count. A null text stays null with no lines. A null doc_id comes before all others. Rows that agree in doc_id
    and text are one document and come out alike; rows that share only the doc_id are two documents, in the order of
    a hash of their text.
    Columns named n_lines or n_removed are replaced.

    Lines and runs are known by 128-bit hashes. Only fingerprints that occur at least twice are extended; earliest runs are
    a partially aggregated minimum, and a run that very many documents share is joined by broadcast: a row for each
    occurrence, never a pair of them, and in no one task.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("k"), F.col("text").cast("string").alias("text"))
    without = F.pandas_udf(_without, T.StructType().add("text", T.StringType()).add("n_lines", T.IntegerType()).add("n_removed", T.IntegerType()))
    fps = stash(line_fingerprints(lean), "line-fps")
    again = fps.groupBy("fp").count().where("count > 1").select("fp")
    runs = stash(runs_of(fps.join(again, "fp")).dropDuplicates(["run", "doc_id", "k", "start"]), "line-runs")
    unstash(fps)
    place = F.struct("doc_id", "k", "start")
    first = stash(runs.groupBy("run").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-first")
    often = max(HOT, (first.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot, rest = (F.broadcast(first.where(F.col("n") > often)), first.where(F.col("n") <= often).select("run", "first"))
    met = runs.join(hot.select("run", "first"), "run").unionByName(runs.join(hot.select("run"), "run", "left_anti").join(rest, "run"))
    gone = met.where(~place.eqNullSafe(F.col("first"))).groupBy("doc_id", "k").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines_"))
    gone = gone.select(F.col("doc_id").alias("id_"), F.col("k").alias("k_"), "lines_")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc_"), F.col("doc_id").cast("long").alias("own_id_"), key.alias("own_k_"))
    out = whole.join(gone, (F.col("own_k_") == F.col("k_")) & F.col("own_id_").eqNullSafe(F.col("id_")), "left").select("doc_", without(F.col("doc_.text").cast("string"), "lines_").alias("out_"))
    return out.select(*(F.col("out_.text").alias("text") if c == "text" else F.col(f"doc_.`{c}`").alias(c) for c in kept), "out_.n_lines", "out_.n_removed")


def op1_line_winnowing(spark, sf_dir: str) -> DataFrame:
    """`documents` without later repeats of runs of lines: doc_id, text, n_lines, n_removed of every row."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_removed")


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents
), c AS (
  SELECT doc_id, ln, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS p
  FROM (SELECT doc_id, ln, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM l) WHERE t <> ''
), n AS (
  SELECT *, lead(t, 1) OVER d AS t1, lead(t, 2) OVER d AS t2, lead(w, 1) OVER d AS w1 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY ln)
), g AS (
  SELECT doc_id, p, 1 AS len, md5(t) AS h FROM n WHERE w >= 50
  UNION ALL SELECT doc_id, p, 2, md5(t || chr(10) || t1) FROM n WHERE w + w1 >= 50
  UNION ALL SELECT doc_id, p, 3, md5(t || chr(10) || t1 || chr(10) || t2) FROM n WHERE t2 IS NOT NULL
), later AS (
  SELECT doc_id, p, len FROM (SELECT *, row_number() OVER (PARTITION BY h, len ORDER BY doc_id, p) AS k FROM g) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, p + i AS p FROM (SELECT doc_id, p, unnest(range(len)) AS i FROM later)
), kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.ln) FILTER (WHERE gone.p IS NULL) AS text, count(*) AS n_lines, count(gone.p) AS n_removed
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.ln = c.ln LEFT JOIN gone ON c.doc_id = gone.doc_id AND c.p = gone.p GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0)::INTEGER AS n_lines, coalesce(k.n_removed, 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
