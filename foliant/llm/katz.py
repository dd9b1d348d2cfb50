"""Language-model scoring: Katz backoff n-grams with Good-Turing discounts and exactly normalised backoff weights.

Documents are cut into blocks of about BLOCK_TOKENS tokens. A block sends each different gram of one to `order` words it
holds, once and as a 64-bit hash, to a partition of the count tables chosen by that hash, which adds up all blocks'
training counts and answers in the order asked. So shuffles carry a block's different grams, not its tokens, no answer
repeats a key, and no word is hot: a frequent gram is one key of each block, and grams of a frequent history lie in all
partitions. There are as many partitions as the tokens fill blocks, so that none grows with the corpus. A gram that no
other block holds is known to be alone; then so is every longer one around it, and the block counts those by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stash, stash_bucketed, unstash

BLOCK_TOKENS = 1 << 20
#: Counts up to this are discounted.
GT_MAX = 5
#: Words in the longest gram.
ORDER = 3
#: Stand for the end of a text (a token) and for what precedes its first token (only a history).
END, BEGIN = np.uint64(1), np.uint64(2)
BLOCKS = "block long, n long, doc_ids array<long>, held binary, lens binary, words binary, ids binary"
TOLD = "bucket int, block long, kind int, keys binary, counts binary"
COUNTED = "block long, bucket int, kind int, told binary, more binary, stats array<long>"
COUNTED_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
SUMS = "bucket int, block long, kind int, keys binary, a binary, b binary, wanted binary"


CODEC = pa.Codec("zstd", compression_level=3)


def pack(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed; doubles as places in the list of their different values. The type is kept in front."""
    if x.dtype.kind == "f":
        values, codes = np.unique(x, return_inverse=True)
        listed = CODEC.compress(np.ascontiguousarray(values).tobytes(), asbytes=True)
        return f"{x.dtype.str[1:]:<3}{len(values):<13}{len(listed):<13}".encode() + listed + pack(codes.astype(np.uint32))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return f"{x.dtype.str[1:]:<3}{len(x):<13}".encode() + CODEC.compress(planes, asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    kind, n = np.dtype(blob[:3].decode().strip()), int(blob[3:16])
    if kind.kind == "f":
        end = 29 + int(blob[16:29])
        return np.frombuffer(CODEC.decompress(blob[29:end], n * kind.itemsize, asbytes=True), kind)[unpack(blob[end:])]
    planes = CODEC.decompress(blob[16:], n * kind.itemsize, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising hashes, by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def blocks_of(docs: DataFrame) -> DataFrame:
    """Tokenized documents (doc_id, text, held) in blocks; ids are places in the block's sorted word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, number = xxhash.xxh64_intdigest, TaskContext.get().partitionId() << 32
        docs, held, lens, tokens, n = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            words, ids = np.unique(np.concatenate([*tokens, np.array([END, BEGIN], np.uint64)]), return_inverse=True)
            cols = [pa.array([number], pa.int64()), pa.array([sum(lens)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (pack(np.array(held, np.uint8)), pack(np.array(lens, np.int64)), pack_keys(words), pack(ids[:-2].astype(np.uint32))))]
            return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                own = np.array([*map(digest, (text.as_py() or b"").lower().split()), int(END)], np.uint64)
                docs.append(doc)
                held.append(out)
                lens.append(len(own))
                tokens.append(own)
                n += len(own)
                if n >= BLOCK_TOKENS:
                    yield close()
                    docs, held, lens, tokens, n, number = [], [], [], [], 0, number + 1
        if docs:
            yield close()

    return docs.mapInArrow(run, BLOCKS)


def _mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    x = v * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """A block's different grams by level (words 0, bigrams 1, ...), and the order in which it asks each bucket about them.

    The gram of a level that ends at a token is the pair of the grams one level down that end at the token before (its
    history) and at the token itself (its suffix). The begin stands before a text's first token, as a word.
    """

    def __init__(self, row: dict, buckets: int, levels: int):
        self.doc_ids, self.held, self.buckets = row["doc_ids"], unpack(row["held"]).astype(bool), buckets
        self.lens, words = unpack(row["lens"]), unpack_keys(row["words"])
        ids = unpack(row["ids"]).astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.begin = int(np.searchsorted(words, BEGIN))
        self.keys, self.order = [words], [np.arange(len(words), dtype=np.int32)]
        self.places, self.of, self.history, self.suffix = [np.arange(len(ids), dtype=np.int32)], [ids], [None], [None]
        for level in range(1, levels):
            here = self.of[-1]
            before = np.roll(here, 1)
            if level == 1:
                at = self.places[0]
                before[self.starts] = self.begin
            else:
                inside = np.ones(len(ids), bool)
                for skipped in range(level - 1):
                    inside[(self.starts + skipped)[self.lens > skipped]] = False
                at = np.flatnonzero(inside).astype(np.int32)
            n = len(self.keys[-1])
            grams, place = np.unique(before[at].astype(np.int64) * n + here[at], return_inverse=True)
            of = np.zeros(len(ids), np.int32)
            of[at] = place
            self.history.append((grams // n).astype(np.int32))
            self.suffix.append((grams % n).astype(np.int32))
            keys = _mixed(self.keys[-1][self.history[-1]], self.keys[-1][self.suffix[-1]])
            for rows, x in ((self.keys, keys), (self.order, np.argsort(keys).astype(np.int32)), (self.places, at), (self.of, of)):
                rows.append(x)

    def training(self, level: int) -> np.ndarray:
        """How often each gram of a level stands in the block's training documents; the begin as often as they are."""
        at = self.places[level]
        counts = np.bincount(self.of[level][at[np.repeat(~self.held, self.lens)[at]]], minlength=len(self.keys[level]))
        if level == 0:
            counts[self.begin] = (~self.held).sum()
        return counts

    def untaught(self, level: int) -> np.ndarray:
        """Which grams of a level stand in documents held out."""
        at = self.places[level]
        found = np.bincount(self.of[level][at[np.repeat(self.held, self.lens)[at]]], minlength=len(self.keys[level])) > 0
        if level == 0:
            found[self.begin] = self.held.any()
        return found

    def _cuts(self, level: int, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The (chosen) grams by rising hash, and where among them each bucket, a range of hashes, begins."""
        order = self.order[level] if chosen is None else self.order[level][chosen[self.order[level]]]
        high = self.keys[level][order] >> np.uint64(32)
        firsts = [-(-(i << 32) // self.buckets) for i in range(self.buckets + 1)]
        return order, np.searchsorted(high, np.array(firsts, np.uint64))

    def asked(self, level: int, values: list[np.ndarray], chosen: np.ndarray | None = None) -> Iterator[tuple]:
        """(bucket, packed keys, packed values ...) of each bucket asked."""
        order, cuts = self._cuts(level, chosen)
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[bucket] : cuts[bucket + 1]]
            yield bucket, pack_keys(self.keys[level][at]), *(pack(x[at]) for x in values)

    def answers(self, level: int, told: dict[int, bytes], dtype: type, chosen: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(self.keys[level]), dtype)
        order, cuts = self._cuts(level, chosen)
        if len(order):
            out[order] = np.concatenate([unpack(told[i]) for i in np.flatnonzero(np.diff(cuts)).tolist()])
        return out


def _told(rows: list[dict], kind: int, column: str = "told") -> dict[int, bytes]:
    return {r["bucket"]: r[column] for r in rows if r["kind"] == kind}


@dataclass(frozen=True)
class Counted:
    """By level, of a block's grams: counts in all training texts, which the block speaks for (each has one such block), which other blocks hold too, which of those stand in documents held out."""

    counts: list[np.ndarray]
    speaks: list[np.ndarray]
    shared: list[np.ndarray]
    untaught: list[np.ndarray]

    def asked(self, block: Block, level: int) -> np.ndarray:
        """Grams that other blocks may hold: both grams they are made of are shared."""
        return self.shared[level - 1][block.history[level]] & self.shared[level - 1][block.suffix[level]]

    @classmethod
    def of(cls, block: Block, rows: list[dict], levels: int) -> Counted:
        known = cls([], [], [], [])
        for level in range(levels):
            asked = known.asked(block, level) if level > 1 else None
            told = block.answers(level, _told(rows, level), np.int64, asked)
            counts, speaks, shared, untaught = told >> 3, (told & 1) > 0, (told & 2) == 0, (told & 4) > 0
            if asked is not None:
                counts, speaks, shared = np.where(asked, counts, block.training(level)), speaks | ~asked, shared & asked
            for by_level, x in ((known.counts, counts), (known.speaks, speaks), (known.shared, shared), (known.untaught, untaught)):
                by_level.append(x)
        return known


def _table(columns: list, names: str, kinds: tuple) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in names.split(", ")])


def stats_of(counts: np.ndarray) -> list[int]:
    """Their sum, how many are not zero, and how many are 1, 2 ... GT_MAX + 1."""
    return [int(counts.sum()), int((counts > 0).sum()), *np.bincount(counts[counts <= GT_MAX + 1], minlength=GT_MAX + 2)[1:].tolist()]


def count(blocks: DataFrame, known: DataFrame | None, buckets: int, levels: list[int]) -> DataFrame:
    """The count tables' answers to each block, and from each partition of them (block -1) the totals and counts of counts.

    The first levels, of words and pairs, are asked for whole. Further ones go one by one, with the answers of those before.
    """
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def questions(block: Block, number: int, level: int, asked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        counts = block.training(level)
        rows = [(bucket, number, level, keys, n) for bucket, keys, n in block.asked(level, [counts.astype(np.uint32) * 2 + block.untaught(level)], asked)]
        if asked is not None:
            rows.append((number % buckets, number, level, None, pack(np.array(stats_of(counts[~asked]), np.int64))))
        for i in range(0, len(rows), 64):
            yield from _table(list(zip(*rows[i : i + 64], strict=True)), TOLD, kinds).to_batches()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, buckets, max(levels) + 1)
                for level in levels:
                    yield from questions(block, row["block"], level, None)

    def ask_on(key, own: pa.Table, told: pa.Table) -> pa.Table:
        (level,) = levels
        block = Block(own.to_pylist()[0], buckets, level + 1)
        asked = Counted.of(block, told.to_pylist(), level).asked(block, level)
        return pa.Table.from_batches(questions(block, key[0].as_py(), level, asked))

    def add(table: pa.Table) -> pa.Table:
        given = table.to_pylist()
        rows, kind, bucket = [r for r in given if r["keys"] is not None], given[0]["kind"], given[0]["bucket"]
        each = [np.zeros(0, np.uint64), *(unpack_keys(r["keys"]) for r in rows)]
        cuts = np.cumsum([*map(len, each)])
        keys, first, place, askers = np.unique(np.concatenate(each), return_index=True, return_inverse=True, return_counts=True)
        counts = np.concatenate([np.zeros(0, np.uint32), *(unpack(r["counts"]) for r in rows)]).astype(np.int64)
        total = np.bincount(place, weights=counts >> 1, minlength=len(keys)).astype(np.int64)
        untaught = np.bincount(place, weights=counts & 1, minlength=len(keys)) > 0
        told = (total * 8 + untaught * 4 + 2 * (askers == 1))[place]
        told[first] += 1
        stats = np.array(stats_of(total[keys != BEGIN] if kind == 0 else total)) + sum(unpack(r["counts"]) for r in given if r["keys"] is None)
        answers = [pack(told[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n = len(rows)
        cols = [[*(r["block"] for r in rows), -1], [bucket] * (n + 1), [kind] * (n + 1), [*answers, None], [None] * (n + 1), [None] * n + [stats.tolist()]]
        return _table(cols, COUNTED, COUNTED_KINDS)

    questioned = blocks.mapInArrow(ask, TOLD) if known is None else blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(ask_on, TOLD)
    return questioned.repartition(buckets, "bucket").groupBy("bucket", "kind").applyInArrow(add, COUNTED)


def discounts(counts_of_counts: list[int], top: int = GT_MAX) -> np.ndarray:
    """Katz's Good-Turing factor of each count 0 .. top. Where a count of counts spoils one, fewer are discounted; with none left, ones by half.

    Factors are rounded to multiples of 2^-32, so that sums of discounted counts are exact in whatever order they are added.
    """
    n = [0, *counts_of_counts]
    for k in range(top, 0, -1):
        if not all(n[r] for r in range(1, k + 2)):
            continue
        rest = (k + 1) * n[k + 1] / n[1]
        if rest >= 1:
            continue
        d = np.array([((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, k + 1)])
        d = np.round(d * 2**32) / 2**32
        if ((d > 0) & (d <= 1)).all() and d[0] < 1:
            return np.concatenate([[1], d, np.ones(top - k)])
    return np.concatenate([[1, 0.5], np.ones(top - 1)])


@dataclass(frozen=True)
class Model:
    """What all blocks know of the model: totals, and discounts by level. Counts and the sums of backoff weights stay in tables."""

    tokens: int
    words: int
    factors: tuple[np.ndarray, ...]
    unknown: float
    scale: float

    @classmethod
    def of(cls, stats: list[list[int]]) -> Model:
        tokens, known, *ones = stats[0]
        factors = tuple(discounts(level[2:]) for level in stats)
        left = sum((1 - factors[0][r]) * r * ones[r - 1] for r in range(1, GT_MAX + 1)) / tokens if tokens else 1.0
        if tokens and left <= 0:  # nothing was discounted: a token's share for what is unknown
            return cls(tokens, known, factors, 1 / (tokens + 1), tokens / (tokens + 1))
        return cls(tokens, known, factors, left, 1.0)

    def discounted(self, level: int, c: np.ndarray) -> np.ndarray:
        """Good-Turing counts of a level's grams counted c times."""
        return np.where(c > GT_MAX, 1.0, self.factors[level][np.minimum(c, GT_MAX)]) * c

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words counted c times; those not counted are one unknown word."""
        return np.where(c > 0, self.scale * self.discounted(0, c) / max(1, self.tokens), self.unknown)


def sums_of(block: Block, known: Counted, model: Model, level: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each history of a level's grams, discounted counts of those the block speaks for, and of their suffixes, summed.

    Then which histories' full sums the block wants: those followed by a gram not seen in training, and those that may have
    lost nothing to discounts, as no gram here shows that they did. Last, which it asks about or adds to. What follows a
    history unseen stands in documents held out, so nobody wants the sums of histories that do not, unless nothing after
    them is discounted anywhere; then every block that holds them adds to them, and only then they sum to the history's count.
    """
    counts, below = known.counts[level], known.counts[level - 1]
    followed = lambda at: np.bincount(block.history[level][at], minlength=len(below)) > 0
    seen = counts > 0
    at = known.speaks[level] & seen
    sums = [np.bincount(block.history[level][at], weights=w, minlength=len(below)) for w in (model.discounted(level, counts[at]), model.discounted(level - 1, below[block.suffix[level][at]]))]
    lossless = ~followed(seen & (model.discounted(level, counts) < counts))
    shared = known.shared[level - 1] & (below > 0)
    wants = shared & (followed(~seen) | followed(seen) & lossless)
    return sums, wants, wants | shared & (known.untaught[level - 1] | lossless) & (sums[0] > 0)


def weigh(blocks: DataFrame, counted: DataFrame, model: Model, buckets: int, order: int) -> DataFrame:
    """What backoff weights are made of: `sums_of` each history, added over the blocks that hold it; kind is `order` plus the history's level.

    Sums of discounted counts take few different values and pack well, probabilities would not.
    """

    def give(key, own: pa.Table, told: pa.Table) -> pa.Table:
        block, rows = Block(own.to_pylist()[0], buckets, order), []
        known = Counted.of(block, told.to_pylist(), order)
        for level in range(1, order):
            sums, wants, named = sums_of(block, known, model, level)
            rows += [(bucket, key[0].as_py(), order + level - 1, *packed) for bucket, *packed in block.asked(level - 1, [*sums, wants.astype(np.uint8)], named)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return _table(columns, SUMS, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4))

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        each = [unpack_keys(r["keys"]) for r in rows]
        cuts = np.cumsum([0, *map(len, each)])
        keys, place = np.unique(np.concatenate(each), return_inverse=True)
        a, b = (np.bincount(place, weights=np.concatenate([unpack(r[c]) for r in rows]), minlength=len(keys)) for c in "ab")
        told = []
        for r, i, j in zip(rows, cuts[:-1], cuts[1:], strict=True):
            mine = place[i:j][unpack(r["wanted"]) > 0]
            if len(mine):
                told.append((r["block"], r["bucket"], r["kind"], pack(a[mine]), pack(b[mine]), None))
        cols = list(zip(*told, strict=True)) if told else [[]] * 6
        return _table(cols, COUNTED, COUNTED_KINDS)

    sums = blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(give, SUMS)
    return sums.repartition(buckets, "bucket").groupBy("bucket", "kind").applyInArrow(add, COUNTED)


def probabilities(block: Block, rows: list[dict], known: Counted, model: Model, order: int) -> Iterator[np.ndarray]:
    """Level by level, the probability of each gram's last word after the words before it.

    A gram seen in training has its discounted share of its history's count. One not seen has the probability of its
    suffix, one level down, times the history's backoff weight: (1 - sum of P(w | history)) / (1 - sum of P(w | history's
    suffix)) over the words seen after it. Where discounting left nothing, the shares are scaled by c / (c + 1) first.
    """
    counts, p = known.counts, model.unigram(known.counts[0])
    yield p
    below = model.scale / max(1, model.tokens)
    for level in range(1, order):
        c, kind = counts[level - 1], order + level - 1
        sums, wants, _ = sums_of(block, known, model, level)
        own, lower = (np.where(wants, block.answers(level - 1, _told(rows, kind, x), np.float64, wants), mine) for x, mine in zip(("told", "more"), sums, strict=True))
        share = 1 / np.maximum(1, c)
        full = own * share > 1 - 1e-9
        share = np.where(full, 1 / (c + 1), share)
        if level > 1:
            below = shares[block.suffix[level - 1]]
        weight = np.where(own > 0, np.maximum(1 - own * share, 0) / np.maximum(1 - lower * below, 1e-12), 1.0)
        history, n = block.history[level], counts[level]
        p = np.where(n > 0, model.discounted(level, n) * share[history], weight[history] * p[block.suffix[level]])
        shares = share
        yield p


def score_blocks(blocks: DataFrame, answers: DataFrame, model: Model, buckets: int, order: int) -> DataFrame:
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(key, own: pa.Table, told: pa.Table) -> pa.Table:
        block, rows = Block(own.to_pylist()[0], buckets, order), told.to_pylist()
        known = Counted.of(block, rows, order)
        words, ids, of_token = known.counts[0], block.of[0], np.zeros(len(block.of[0]))
        for level, p in enumerate(probabilities(block, rows, known, model, order)):
            at = block.places[level]
            of_token[at] = np.log10(np.maximum(p, 1e-300))[block.of[level][at]]
        base = np.log10((words + 1) / (model.tokens + model.words + 1))
        total = lambda x: np.add.reduceat(x, block.starts)
        cols = [block.doc_ids, block.held, block.lens, total((words[ids] > 0).astype(np.int64)), np.full(len(block.lens), model.tokens), total(base[ids]), total(of_token)]
        return _table(cols, kind, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, kind)


def score(docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """Train grams of up to `order` words on the documents for which the column expression `held_out` is not true, and score all.

    Tokens: words between ASCII space, A-Z lower-cased, then one end. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-one unigrams), score (log10 probability under the model). A null text is empty and is
    its end alone. Null and repeated doc_ids each keep their row. Without training documents every token has the
    probability one of the only, unknown word. Extra columns are ignored; an empty table gives no rows.
    Words are known by a 64-bit hash.
    """
    spark = docs.sparkSession
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    blocks = stash_bucketed(blocks_of(lean), "lm-blocks", "block")
    tokens = blocks.agg(F.sum("n")).first()[0]
    if tokens is None:
        return blocks.selectExpr("explode(doc_ids) doc_id", "false held_out", "0L n_tokens", "0L n_known", "0L train_tokens", "0D base_score", "0D score")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BLOCK_TOKENS))
    tables: list[DataFrame] = []
    for levels in ([*range(min(order, 2))], *([k] for k in range(2, order))):
        known = reduce(DataFrame.unionByName, tables).where("block >= 0") if tables else None
        tables.append(stash(count(blocks, known, buckets, levels), "lm-counts"))
    counted = reduce(DataFrame.unionByName, tables)
    stats = {r["kind"]: list(r)[1:] for r in counted.where("stats is not null").groupBy("kind").agg(*(F.sum(F.col("stats")[i]) for i in range(GT_MAX + 3))).collect()}
    model = Model.of([stats[level] for level in range(order)])
    told = counted.where("block >= 0")
    weights = stash(weigh(blocks, told, model, buckets, order), "lm-weights")
    out = stash(score_blocks(blocks, told.unionByName(weights), model, buckets, order), "lm-scores")
    unstash(blocks, *tables, weights)
    return out


def op6_katz_backoff(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
