"""Exact similarity of shingle sets: candidate pairs are verified, and a prefix filter over the rarest shingles completes them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, stash, texts_of, tidy, unstash
from foliant.llm.components import connected_components

#: Words in a shingle; similarity (Jaccard) of near duplicates, as a fraction of whole numbers.
WIDTH, NUM, DEN = 5, 4, 5
#: Shingles in over COMMON first prefixes come last in the order, the COMMON_MOST most frequent of them at most. Any order gives the same groups.
COMMON, COMMON_MOST = 2, 500_000
#: Logarithms of the least and largest number of bins in the histogram of a set's hashes; half as many bins as hashes between them.
BINS = (6, 16)
#: Sets in a block when all that are left meet, and shingles of each that go with it.
TILE, LEAST = 1024, 16
#: Rounds in which each set meets one other set of each shingle of its prefix, before all that are left meet.
ROUNDS = 2


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 (seed 42) of each of a text's shingles, repeats included; fewer than `width` words are one shingle, none give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    return np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """SimHash: a bit is 1 if it is set in over half of the hashes; zero without any."""
    total, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def prefix_length(n: int) -> int:
    """So many first shingles, in any one order for all, of a set of n: sets that are near share one of them at least."""
    return n - -(-NUM * n // DEN) + 1 if n else 0


def _nodes(rows: DataFrame, width: int) -> DataFrame:
    """For each row its node (rows of one set of shingles are one), the set's SimHash and histogram, and its first shingles by hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, fps, bins, first = [], [], [], []
        for text in texts_of(batch):
            every = shingle_hashes(text, width)
            own = np.unique(every)
            nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
            fps.append(majority(every))
            bins.append(histogram(own))
            first.append(own[: prefix_length(len(own))].tobytes())
        cols = [batch.column("row_"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)), *(pa.array(x, pa.binary()) for x in (bins, first))]
        return pa.RecordBatch.from_arrays(cols, ["row_", "node", "fp", "x", "first"])

    return arrow_map(rows.select("row_", F.col("text").cast("string").alias("text")), run, "row_ long, node long, fp long, x binary, first binary")


def _ordered_prefixes(rows: DataFrame, width: int, common: np.ndarray) -> DataFrame:
    """(node, size, first): the first shingles of each set, those in `common` behind all others."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, first = [], [], []
        for text in texts_of(batch):
            own = np.unique(shingle_hashes(text, width))
            nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
            sizes.append(len(own))
            if len(common) and len(own):
                late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
                own = np.concatenate([own[~late], own[late]])
            first.append(own[: prefix_length(len(own))].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(first, pa.binary())], ["node", "size", "first"])

    return arrow_map(rows.select(F.col("text").cast("string").alias("text")), run, "node long, size int, first binary")


def _tokens(prefixes: DataFrame) -> DataFrame:
    """The shingles of the column `first`, one a row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], ["token"])

    return arrow_map(prefixes.select("first"), run, "token long")


def _postings(prefixes: DataFrame) -> DataFrame:
    """(token, node, size, pos) of (node, size, first)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column("first").to_pylist()
        n = np.array([len(b) // 8 for b in raw], np.int64)
        nodes, sizes = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in ("node", "size"))
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(nodes), pa.array(sizes), pa.array(place.astype(np.int32))], ["token", "node", "size", "pos"])

    return arrow_map(prefixes, run, "token long, node long, size int, pos int")


def histogram(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes start with each bit string of one length, in the narrowest integers; their width in bytes comes first."""
    bits = min(max((len(hashes) // 2).bit_length(), BINS[0]), BINS[1])
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def may_be_near(a: bytes, b: bytes) -> bool:
    """False only if the bin-wise minimum of two histograms, which the overlap cannot exceed, is too small for the similarity."""
    x, y = (np.frombuffer(h, f"<u{h[0]}", offset=1).astype(np.int64) for h in (a, b))
    n = min(len(x), len(y))
    x, y = x.reshape(n, -1).sum(axis=1), y.reshape(n, -1).sum(axis=1)
    return (NUM + DEN) * int(np.minimum(x, y).sum()) >= NUM * int(x.sum() + y.sum())


def coarse(x: bytes) -> bytes:
    """A histogram of 64 bins in 16 bits each; where these do not suffice, one that bounds nothing."""
    counts = np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64).reshape(1 << BINS[0], -1).sum(axis=1)
    return np.where(counts.max() < 1 << 16, counts, (1 << 16) - 1).astype("<u2").tobytes()


def _live(side: DataFrame, nodes: DataFrame) -> DataFrame:
    """Postings of shingles that sets of two groups or more share, in tiles (token, big, i, j) of at most two blocks of TILE sets.

    The sets of a shingle's most frequent group need not meet each other. The others meet in pairs of blocks, and meet
    that group's blocks: a large group and a few sets beside it cost a row or a few for each set, never a row a pair.
    """
    per = side.groupBy("token", "root").agg(F.count("*").alias("n"))
    live = per.groupBy("token").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.max_by("root", F.struct("n", "root")).alias("mode")).where("all > top")
    posts = stash(side.join(live, "token").select("token", "node", "size", "root", (F.col("root") == F.col("mode")).alias("mine"), F.ceil((F.col("all") - F.col("top")) / TILE).cast("int").alias("few"), F.ceil(F.col("top") / TILE).cast("int").alias("many")), "shingle-live")

    def folded(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("least"), pa.array([coarse(x) for x in batch.column("x").to_pylist()], pa.binary())], ["node", "least", "x"])

    # a few of each set's shingles tell most pairs at which one of those they share they are told
    least = posts.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("token")), 1, LEAST).alias("least"))
    x = nodes.select("node", "x").hint("merge").join(least, "node").groupBy("node", "least").agg(F.first("x").alias("x"))
    known = arrow_map(x, folded, "node long, least array<long>, x binary")
    block = lambda n: F.pmod(F.xxhash64(F.lit(5), "node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["token", "big", "i", "j", "side", "node", "size", "root"]
    other = posts.where("not mine").withColumn("own", block("few"))
    among = other.withColumn("k", upto("few")).select("*", F.lit(False).alias("big"), F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).cast("int").alias("side"))
    with_big = other.withColumn("j", upto("many")).select("*", F.lit(True).alias("big"), F.col("own").alias("i"), F.lit(0).alias("side"))
    big = posts.where("mine").withColumn("j", block("many")).withColumn("i", upto("few")).select("*", F.lit(True).alias("big"), F.lit(1).alias("side"))
    tiles = among.select(*cols).unionByName(with_big.select(*cols)).unionByName(big.select(*cols))
    return tiles.hint("merge").join(known, "node").select(*cols, "x", "least")


def _possible(side: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v) of two groups with a shingle of both prefixes in common, if sizes and coarse histograms allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def met(rows: list) -> Iterator[pa.RecordBatch]:
            big, i, j = rows[0][1:4]
            one, two = [r for r in rows if r[4] == 0], [r for r in rows if r[4] == 1]
            if not big and i == j:
                two = one
            if not one or not two:
                return
            token = rows[0][0]
            (sx, rx), (sy, ry) = ([np.array([r[c] for r in part], np.int64) for c in (6, 7)] for part in (one, two))
            x, y = (np.frombuffer(b"".join([r[8] for r in part]), "<u2").reshape(len(part), -1) for part in (one, two))
            us, vs = [], []
            for at in range(0, len(one), 64):
                rows_ = slice(at, at + 64)
                fits = (rx[rows_, None] != ry) & (DEN * np.minimum(sx[rows_, None], sy) >= NUM * np.maximum(sx[rows_, None], sy))
                for a, b in zip(*np.nonzero(fits), strict=True) if fits.sum() < 64 else ():
                    if (NUM + DEN) * int(np.minimum(x[at + a], y[b]).sum(dtype=np.int64)) >= NUM * (sx[at + a] + sy[b]):
                        us.append(at + a)
                        vs.append(b)
                if fits.sum() >= 64:
                    shared = np.minimum(x[rows_, None], y[None]).sum(axis=2, dtype=np.int64)
                    a, b = np.nonzero(fits & ((NUM + DEN) * shared >= NUM * (sx[rows_, None] + sy)))
                    us += (a + at).tolist()
                    vs += b.tolist()
            out = set()
            for a, b in zip(us, vs, strict=True):
                told = [t for t in one[a][9] if t in two[b][9]]
                if (not told or told[0] == token) and one[a][5] != two[b][5]:
                    out.add((min(one[a][5], two[b][5]), max(one[a][5], two[b][5])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:4] != held[-1][:4]:
                    yield from met(held)
                    held = []
                held.append(row)
        if held:
            yield from met(held)

    tiles = _live(side, nodes)
    return tiles.repartition("token", "big", "i", "j").sortWithinPartitions("token", "big", "i", "j", "side").mapInArrow(run, "u long, v long").distinct()


def _near(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The pairs whose sets have the similarity: by histograms first, by the sets, worked out anew, where these allow it.

    Their files are far smaller than they are in memory, so no join broadcasts them by the driver.
    """

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array([np.unique(shingle_hashes(t, width)).tobytes() for t in texts_of(batch)], pa.binary())], ["node", "x"])

    def same(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        return (NUM + DEN) * len(np.intersect1d(x, y, assume_unique=True)) >= NUM * (len(x) + len(y))

    def checked(of: DataFrame, what: DataFrame, test) -> DataFrame:
        def run(every: pa.RecordBatch) -> pa.RecordBatch:
            good = []
            for batch in (every.slice(i, 256) for i in range(0, every.num_rows, 256)):
                good += [test(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            return every.filter(pa.array(good, pa.bool_())).select(["u", "v"])

        both = of.join(what.select(F.col("node").alias("u"), F.col("x").alias("a")).hint("merge"), "u").join(what.select(F.col("node").alias("v"), F.col("x").alias("b")).hint("merge"), "v")
        return arrow_map(both.select("u", "v", "a", "b"), run, "u long, v long")

    def asked(some: DataFrame) -> DataFrame:
        return some.select(F.col("u").alias("node")).unionByName(some.select(F.col("v").alias("node"))).distinct()

    bins = stash(nodes.join(asked(pairs), "node", "left_semi").groupBy("node").agg(F.first("x").alias("x")), "shingle-bins")
    maybe = stash(checked(pairs, bins, may_be_near), "shingle-maybe")
    at = stash(nodes.join(asked(maybe), "node", "left_semi").groupBy("node").agg(F.min("row_").alias("row_")), "shingle-at")
    texts = rows.select("row_", F.col("text").cast("string").alias("text")).join(at, "row_")
    sets = stash(arrow_map(texts.select("node", "text"), whole, "node long, x binary"), "shingle-whole")
    found = stash(checked(maybe, sets, same), "shingle-near")
    unstash(bins, maybe, at, sets)
    return found


def _rooted(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The postings with each node's group so far."""
    if roots is None:
        return shared.withColumn("root", F.col("node"))
    return shared.join(roots, "node", "left").select("token", "node", "size", "pos", F.coalesce("root", "node").alias("root"))


def _hub_pairs(side: DataFrame, seed: int) -> DataFrame:
    """(u, v): each set with one set of each shingle of its prefix, if they are in two groups and their overlap can be large enough.

    All shingles choose by one order of the sets, so many of a large group's shingles choose the same one.
    """
    hubs = side.groupBy("token").agg(F.min_by(F.struct("node", "size", "pos", "root"), F.struct(F.xxhash64(F.lit(seed), "node"), "node")).alias("hub"))
    # of what stands before the shared shingle all may be shared, of what stands behind it the shorter rest
    bound = f"(least(pos, hub.pos) + least(size - pos, hub.size - hub.pos)) * {NUM + DEN} >= {NUM} * (size + hub.size)"
    met = side.hint("merge").join(hubs, "token").where(f"root <> hub.root and {DEN} * least(size, hub.size) >= {NUM} * greatest(size, hub.size) and {bound}")
    return met.select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v")).distinct()


def _roots(near: list[DataFrame], before: DataFrame | None) -> DataFrame:
    """(node, root) over all near pairs so far, instead of `before`."""
    pairs = near[0]
    for more in near[1:]:
        pairs = pairs.unionByName(more)
    roots = stash(connected_components(pairs), "shingle-roots")
    if before is not None:
        unstash(before)
    return roots


def groups(rows: DataFrame, width: int = WIDTH, common: int = COMMON, candidates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(row_, root) for each row of (row_, text): rows are in one group if near pairs lead from one to the other.

    Near: the Jaccard similarity of their sets of shingles of `width` words is at least NUM / DEN. No pair is lost:
    every shingle of every prefix counts, however many texts share it. Texts without words are one group.
    candidates: pairs (u, v) of nodes to be verified first, from (node, fp) with the sets' SimHash fingerprints.
    With them each set meets one other set of each of its prefix's shingles; then only pairs not yet in one group meet,
    so a large group of near copies is not compared pair by pair.
    """
    nodes = stash(_nodes(rows, width), "shingle-nodes")
    with tidy(rows.sparkSession):
        often = _tokens(nodes).groupBy("token").count().where(F.col("count") > common).orderBy(F.desc("count"), "token").limit(COMMON_MOST).select("token").toArrow()["token"]  # without a Row for each
    late = np.sort(often.to_numpy().astype(np.int64).view(np.uint64))
    prefixes = stash(_ordered_prefixes(rows, width, late), "shingle-prefixes")
    again = stash(_tokens(prefixes).groupBy("token").count().where("count > 1").select("token"), "shingle-again")
    shared = stash(_postings(prefixes).join(again, "token", "left_semi").distinct(), "shingle-shared")
    unstash(prefixes, again)
    near, roots = [], None
    for i in range(ROUNDS):
        pairs = _hub_pairs(_rooted(shared, roots), i)
        if candidates is not None and not i:
            pairs = candidates(nodes.select("node", "fp").distinct()).unionByName(pairs).distinct()
        pairs = stash(pairs, "shingle-hubs")
        near.append(_near(pairs, nodes, rows, width))
        unstash(pairs)
        roots = _roots(near, roots)
    rest = stash(_possible(_rooted(shared, roots), nodes), "shingle-rest")
    unstash(shared)
    near.append(_near(rest, nodes, rows, width))
    unstash(rest)
    roots = _roots(near, roots)
    of_row = stash(nodes.select("row_", "node"), "shingle-rows")
    unstash(nodes, *near)
    return of_row.join(roots, "node", "left").select("row_", F.coalesce("root", "node").alias("root"))
