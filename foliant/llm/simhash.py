"""SimHash near-dedup: Golay-code fuzzy hashing of fingerprint segments, pigeonhole over segments, join and verify."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import shingles
from foliant.llm.common import arrow_map, stash, texts_of, unstash
from foliant.llm.components import connected_components

#: Generator polynomial of the perfect binary (23, 12) Golay code.
GOLAY_POLY, GOLAY_N, GOLAY_K = 0b110001110101, 23, 12
#: (first bit, width) of each fingerprint segment; each fits a Golay word when padded with zeros.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys shared by more fingerprints than this are worked by the ball method instead of a pair join.
HOT_KEY = 512


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text: XXH64 (seed 42) of space-joined shingles of `width` words, repeats included."""
    return shingles.majority(shingles.shingle_hashes(text, width))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders modulo the generator of the low and high part of a word, and each remainder's error pattern."""

    def mod(x: int) -> int:
        for i in range(GOLAY_N - 1, GOLAY_N - GOLAY_K - 1, -1):
            if x >> i & 1:
                x ^= GOLAY_POLY << i - (GOLAY_N - GOLAY_K)
        return x

    low, high = np.array([mod(x) for x in range(1 << 12)]), np.array([mod(x << 12) for x in range(1 << 11)])
    error = np.zeros(1 << 11, np.int64)
    for weight in range(1, 4):
        for at in combinations(range(GOLAY_N), weight):
            e = sum(1 << i for i in at)
            error[mod(e)] = e
    return low, high, error


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within distance 3 of each 23-bit word."""
    low, high, error = _tables()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> (GOLAY_N - GOLAY_K)


def near_indices(words: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of each word and of all words one bit away, -1 for repeats: one index, or up to six.

    If two words differ by one bit at most, the index of either is among these of the other.
    """
    found = np.stack([decode(words), *(decode(words ^ (1 << i)) for i in range(width))], axis=1)
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def golay_keys(fp: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each ordered pair of segments, the first as it is and the second's codeword index.

    With two errors at most over three segments, two of the segments have one error between them at most
    (pigeonhole): one is equal, the other within one bit. `probe` gives every near index, else the own one.
    """
    fp = fp.view(np.uint64)
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in SEGMENTS]
    rows, keys = [], []
    for pair, (a, b) in enumerate(permutations(range(3), 2)):
        base = (np.int64(pair) << 40) | (seg[a] << 12)
        index = near_indices(seg[b], SEGMENTS[b][1]) if probe else decode(seg[b])[:, None]
        r, c = np.nonzero(index >= 0)
        rows.append(r)
        keys.append(base[r] | index[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of docs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, width) for t in texts_of(batch)), np.uint64, batch.num_rows).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _keyed(fps: DataFrame, probe: bool) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows, keys = golay_keys(fp, probe)
        return pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array(keys)], ["fp", "key"])

    return arrow_map(fps.select("fp"), run, "fp long, key long")


def _ball_links(fps: DataFrame) -> DataFrame:
    """Links that join all fingerprints within two bits of each other, without a pair join.

    Two fingerprints differ by two bits at most just if some word is within one bit of both. So each names the 65 words
    within one bit of it, and all that name the same word are tied to the smallest of them.
    """
    words = fps.select("fp", F.explode(F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select("word", "u")
    return words.hint("merge").join(least, "word").where("fp <> u").select("u", F.col("fp").alias("v")).distinct()


def links(fps: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """(u, v): links between distinct fingerprints that differ by one or two bits; complete up to connectivity.

    Spark takes the keys of a fingerprint for as large as the fingerprint and would broadcast them by the driver, so the
    joins are merged by hint.
    """
    build, probe = _keyed(fps, False), _keyed(fps, True)
    hot = stash(build.groupBy("key").count().where(F.col("count") > hot_key).select("key"), "hot-keys")
    some_hot = bool(hot.take(1))
    b = build.select("key", F.col("fp").alias("u"))
    if some_hot:
        b = b.join(hot, "key", "left_anti")
    found = b.hint("merge").join(probe.select("key", F.col("fp").alias("v")), "key").where("u < v and bit_count(u ^ v) <= 2").select("u", "v").distinct()
    if some_hot:
        members = build.join(hot, "key", "left_semi").unionByName(probe.join(hot, "key", "left_semi")).select("fp").distinct()
        found = found.unionByName(_ball_links(stash(members, "hot-fps")))
    return found


def near_duplicates(docs: DataFrame, width: int = 3, hot_key: int = HOT_KEY) -> DataFrame:
    """Group documents whose SimHash fingerprints differ by at most two bits.

    Returns doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.
    A null or empty text has fingerprint zero and is linked like any other; fewer than `width` words are one shingle.
    A null doc_id keeps its row and is never a component_id unless its whole component has none. Repeated rows each
    come out. Extra columns are ignored. Equal fingerprints are one node, so copies never meet in pairs.
    """
    spark = docs.sparkSession
    fp = stash(fingerprints(docs, width), "fingerprints")
    nodes = stash(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    roots = stash(connected_components(links(nodes, hot_key)), "fp-roots")
    labelled = nodes.hint("merge").join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = labelled.select("fp", "root").hint("merge").join(least, "root").select("fp", "component_id")
    return fp.hint("merge").join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def candidates(sets: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """(u, v): pairs of nodes of (node, fp) that Golay keys bring together, each node with the least node of its fingerprint or of a linked one."""
    hubs = stash(sets.groupBy("fp").agg(F.min("node").alias("hub")), "simhash-hubs")
    same = sets.join(hubs, "fp").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    of = lambda side: hubs.select(F.col("fp").alias(f"fp_{side}"), F.col("hub").alias(side))
    linked = links(hubs, hot_key).select(F.col("u").alias("fp_u"), F.col("v").alias("fp_v")).join(of("u"), "fp_u").join(of("v"), "fp_v").select("u", "v")
    return same.unionByName(linked).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def representatives(docs: DataFrame) -> DataFrame:
    """Of each group of near duplicates one row: the one with the smallest doc_id (null last), text hash and place in the table.

    Near duplicates have a similarity of 0.8 or more over shingles of five words. Golay keys of their SimHash fingerprints
    give pairs, whose sets of shingles are compared. But texts of 0.8 may differ in a quarter of the fingerprint's bits, so
    no radius that is worth a search finds them all: an exact join of the sets (`shingles.groups`) adds what is left.
    Groups are of rows, not of ids: rows without an id, or with one id and different texts, are documents of their own.
    Null and empty texts, and those of white space, are one group. An empty table stays empty; all columns come back.
    """
    rows = stash(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_"), F.monotonically_increasing_id().alias("row_")), "dedup-rows")
    of_row = shingles.groups(rows.select("row_", F.col("doc_.text").alias("text")), candidates=candidates)
    order = F.struct(F.col("doc_.doc_id").isNull(), F.col("doc_.doc_id"), F.xxhash64("doc_.text"), "row_")
    keep = rows.select("row_", order.alias("order_")).join(of_row, "row_").groupBy("root").agg(F.min("order_").alias("least")).select(F.col("least.row_").alias("row_"))
    return rows.join(keep, "row_", "left_semi").select("doc_.*")


def op10_simhash_golay(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
