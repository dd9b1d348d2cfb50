"""Quality classifier: Bradley-Terry ranking of documents from preference pairs, thresholded at a score quantile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, stash, texts_of, unstash

#: Hashed pairs of neighbouring bytes, after 256 single bytes and the word and line figures.
PAIRS, EXTRA = 512, 12
WIDTH = 256 + PAIRS + EXTRA
#: Labelled documents of the commoner class in a block of the fit, and the least of the rarer one, on average.
BLOCK, LEAST = 4000, 64
#: Scores that the driver gets at once when the threshold is looked for, and intervals that it looks through before that.
LISTED, BINS = 1 << 16, 4096
#: `score` at the fitted quantile.
CUT = 0.7


def features(text: bytes) -> np.ndarray:
    """What a score sees of a text: how bytes and byte pairs are distributed, and the shape of words and lines. Length itself is left out."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    out[:256] = np.sqrt(np.bincount(raw, minlength=256) / len(raw))
    step = 1 << 20
    pairs = np.zeros(PAIRS)
    for at in range(0, len(raw) - 1, step):
        part = raw[at : at + step + 1].astype(np.int32)
        pairs += np.bincount((part[:-1] * 131 + part[1:] * 31) % PAIRS, minlength=PAIRS)
    out[256 : 256 + PAIRS] = np.sqrt(pairs / max(1, len(raw) - 1))
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    if words:
        n, lower = len(words), [w.lower() for w in words]
        sizes = np.fromiter(map(len, words), np.int64, n)
        out[256 + PAIRS :] = (
            sizes.mean() / 10, sizes.std() / 10, (sizes <= 3).mean(), (sizes >= 12).mean(),
            len(set(lower)) / n, sum(w.isupper() for w in words) / n, sum(w.isalpha() or not w.isascii() for w in words) / n, sum(w[-1] in b".!?" for w in words) / n,
            len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 5, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), sum(map(bytes.isdigit, words)) / n,
        )
    return out


@dataclass(frozen=True)
class Ranker:
    """score = sigmoid(w . z(x) - at + logit(CUT)): CUT just where the raw score is the fitted quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    at: float
    quantile: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x.astype(np.float64) - self.mean) / self.scale, -8, 8) @ self.weight
        return 1 / (1 + np.exp(-np.clip(raw - self.at + np.log(CUT / (1 - CUT)), -500, 500)))


def learn(b: np.ndarray, w: np.ndarray, rounds: int = 300, batch: int = 2048, decay: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of Bradley-Terry by logistic loss on feature differences of (better, worse) pairs drawn anew each round."""
    rng, weight, m, v = np.random.default_rng(seed), np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for i in range(1, rounds + 1):
        left, right = rng.integers(len(b), size=batch), rng.integers(len(w), size=batch)
        pull = 1 / (1 + np.exp(np.clip((b @ weight)[left] - (w @ weight)[right], -50, 50)))
        grad = (np.bincount(right, pull, len(w)) @ w - np.bincount(left, pull, len(b)) @ b) / batch + decay * weight
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weight = weight - 0.02 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return weight


def weighted_quantile(scored: DataFrame, mass: dict[int, float], q: float) -> float:
    """Of rows (q, raw) of mass[q] each, 1 in all: the value below which a part q of the mass lies, halfway to the next value.

    All rows count. The driver gets how many lie in each of BINS intervals, goes on within the one that holds the place, and
    gets the values themselves once they are few.
    """
    counts = [F.count(F.when(F.col("q") == k, 1)).alias(f"n{k}") for k in (0, 1)]
    bounds = [F.min("raw").alias("lo"), F.max("raw").alias("hi")]
    weigh = lambda r: r["n0"] * mass[0] + r["n1"] * mass[1]
    at, below, before = scored.agg(*counts, *bounds).first(), 0.0, None
    while at["n0"] + at["n1"] > LISTED and at["lo"] < at["hi"]:
        lo, hi = at["lo"], at["hi"]
        place = F.least(F.lit(BINS - 1), F.floor((F.col("raw") - lo) / (hi - lo) * BINS)).alias("bin")
        for at in sorted(scored.where(F.col("raw").between(lo, hi)).groupBy(place).agg(*counts, *bounds).collect(), key=lambda r: r["bin"]):
            if below + weigh(at) > q + 1e-9:
                break
            below, before = below + weigh(at), at["hi"]
        else:
            return before
    if at["lo"] == at["hi"]:
        first = below + mass[1 if at["n1"] else 0] > q + 1e-9
        return (before + at["lo"]) / 2 if first and before is not None else at["lo"]
    for raw, k in sorted(((r["raw"], r["q"]) for r in scored.where(F.col("raw").between(at["lo"], at["hi"])).select("raw", "q").collect()), key=lambda r: (r[0], -r[1])):
        below += mass[k]
        if below > q + 1e-9:
            return raw if before is None else (before + raw) / 2
        before = raw
    return before


def _classes(rows: pa.Table) -> list[np.ndarray]:
    """Features of a block's documents of class 0 and 1, by doc_id; of rows that share one, those with the least features."""
    codec, least = pa.Codec("zstd"), {}
    for doc, q, x in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "q", "x")), strict=True):
        x = codec.decompress(x, 4 * WIDTH, asbytes=True)
        if doc not in least or x < least[doc][1]:
            least[doc] = q, x
    return [np.array([np.frombuffer(x, np.float32) for _, (own, x) in sorted(least.items()) if own == q], np.float64).reshape(-1, WIDTH) for q in (0, 1)]


def train(docs: DataFrame, labels: DataFrame) -> Ranker | None:
    """Fit on all labelled documents; the classes' share is counted over all labels.

    Documents are dealt to blocks by their id, each block learns from pairs of its own, and the weights are the mean of the
    blocks' by their documents; mean, scale and threshold are those of all labelled documents. Where a class is so rare that
    blocks would lack it, its documents go to several blocks. The threshold is the quantile 1 - share of raw scores, both
    classes weighted to their shares: as large a part of the documents passes as the labels call good.

    None if one of the classes has no document. Labels that are null or neither 0 nor 1, and labels that
    contradict each other for one doc_id, teach nothing. Of rows that share a doc_id the one with the least features teaches.
    """
    clean = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2").select("doc_id", F.col("q").cast("int").alias("q"))
    counts = {r["q"]: r["n"] for r in clean.groupBy("q").agg(F.count("*").alias("n")).collect()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = pa.Codec("zstd", compression_level=1)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.compress(features(t).tobytes(), asbytes=True) for t in texts_of(batch)], pa.binary())], ["doc_id", "x"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # features are smaller than texts, so they are what is moved to the labels; these grow too, so the driver does not broadcast them
    taught = stash(arrow_map(texts, run, "doc_id long, x binary").join(clean.hint("merge"), "doc_id").select("doc_id", "q", "x"), "quality-taught")
    found = {r["q"]: r["n"] for r in taught.groupBy("q").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if len(found) < 2:
        unstash(taught)
        return None
    blocks, rare = -(-max(found.values()) // BLOCK), min(found, key=found.get)
    copies = min(blocks, -(-LEAST * blocks // found[rare]))
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("q") == rare, copies - 1).otherwise(0))).alias("copy")
    dealt = taught.select("doc_id", "q", "x", copy).withColumn("block", F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) + F.col("copy"), F.lit(blocks)))
    parts = max(2 * blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def by_block(rows: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        return rows.select("block", "doc_id", "q", "x").repartition(parts, "block").groupBy("block").applyInArrow(fn, schema)

    def told(rows: pa.Table, n: int, *arrays: np.ndarray) -> pa.Table:
        return pa.table({"block": rows.column("block")[:1], "n": pa.array([n], pa.int64())} | {f"a{i}": pa.array([a.tobytes()], pa.binary()) for i, a in enumerate(arrays)})

    def moments(rows: pa.Table) -> pa.Table:
        x = np.concatenate(_classes(rows)[::-1])
        return told(rows, len(x), x.mean(axis=0), x.var(axis=0) * len(x))

    once, n, mean, squares = dealt.where("copy = 0"), 0, np.zeros(WIDTH), np.zeros(WIDTH)
    for r in sorted(by_block(once, moments, "block long, n long, a0 binary, a1 binary").collect(), key=lambda r: r["block"]):
        gap = np.frombuffer(r["a0"]) - mean
        squares = squares + np.frombuffer(r["a1"]) + gap**2 * n * r["n"] / (n + r["n"])
        mean, n = mean + gap * r["n"] / (n + r["n"]), n + r["n"]
    scale = np.sqrt(squares / n) + 1e-3
    level = lambda x: np.clip((x - mean) / scale, -8, 8)

    def weights(rows: pa.Table) -> pa.Table:
        worse, better = map(level, _classes(rows))
        both = len(worse) and len(better)
        return told(rows, (len(worse) + len(better)) if both else 0, learn(better, worse) if both else np.zeros(WIDTH))

    fits = sorted(by_block(dealt, weights, "block long, n long, a0 binary").collect(), key=lambda r: r["block"])
    weight = sum(np.frombuffer(r["a0"]) * r["n"] for r in fits) / sum(r["n"] for r in fits)

    def raws(rows: pa.Table) -> pa.Table:
        raw = [level(x) @ weight for x in _classes(rows)]
        return pa.table({"q": pa.array(np.repeat([0, 1], list(map(len, raw))), pa.int32()), "raw": pa.array(np.concatenate(raw))})

    share = counts[1] / (counts[0] + counts[1])
    scored = stash(by_block(once, raws, "q int, raw double"), "quality-raw")
    at = weighted_quantile(scored, {0: (1 - share) / found[0], 1: share / found[1]}, 1 - share)
    unstash(taught, scored)
    return Ranker(mean, scale, weight, at, 1 - share)


def scores(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """(doc_id, score) for each row of docs. An empty or null text has the features zero; without a model all score CUT."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.full(batch.num_rows, CUT)
        if model is not None:
            x = np.zeros((batch.num_rows, WIDTH), np.float32)
            for i, t in enumerate(texts_of(batch)):
                x[i] = features(t)
            out = model.score(x)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """The rows of docs that score CUT or more, with all their columns."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(text), CUT))
        x = np.array([features(t.encode("utf-8", "surrogatepass") if t else b"") for t in text]).reshape(len(text), WIDTH)
        return pd.Series(model.score(x))

    return docs.where(score(F.col("text").cast("string")) >= CUT)


def _teaching(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op5_bradley_terry(spark, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from the labelled rows that are not held out: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scores(docs, train(docs, _teaching(spark, sf_dir)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
