"""Mixture-controlled packing: deficit round-robin over source queues fills every window to the target token proportions."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import HELD, stash

WINDOW = 2048
#: Shares are fixed-point: tokens a window times 2**SHIFT. A closed form covers at most 2**31 windows, so products fit 63 bits.
SHIFT = 20
#: Id that ends each document.
END_ID = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Byte-level BPE ids as little-endian uint16; none are added, but added tokens of the .json file that a text holds keep their ids.

    A space before a character that is no space starts a new piece under the split pattern, whatever stands before it. So a
    text falls into chunks, one for each such space, that are encoded alone; a bounded table remembers chunks.
    Texts where a space stands before other space or the end are encoded whole. A text is cut at added tokens first.
    The rank file holds the vocabulary of the .json file of the same name, and ids are the same.
    """

    def __init__(self, path: str, remember: int = 400_000):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.codec = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.remember = remember
        self.plain = re.compile(r" (?:\s|\Z)")
        with open(os.path.splitext(path)[0] + ".json", encoding="utf-8") as f:
            self.added = {t["content"]: np.array([t["id"]], np.uint16).tobytes() for t in json.load(f)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")

    def _encode(self, text: str) -> bytes:
        return np.array(self.codec.encode_ordinary(text), np.uint16).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added.get(x) or self._ordinary(x) for x in self.cut.split(text) if x)
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if self.plain.search(text):
            return self._encode(text)
        known, out = self.known, []
        first, *rest = text.split(" ")
        for chunk in [first, *[" " + x for x in rest]]:
            ids = known.get(chunk)
            if ids is None:
                if len(known) >= self.remember:
                    known.clear()
                ids = self._encode(chunk)
                if len(chunk) < 64:
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _drop() -> bool:
    held = bool(encoder.cache_info().currsize)
    encoder.cache_clear()
    return held


HELD.append(_drop)


@dataclass(frozen=True)
class Segment:
    """`count` windows from `first`, before which queue i has given served[i] tokens.

    After j of its windows, queues up to i have given (j * share[i + 1]) >> SHIFT tokens more. Every queue thus stays
    within a token of what it is owed: what a window falls short of, a later one makes good.
    """

    first: int
    count: int
    served: tuple[int, ...]
    share: tuple[int, ...]

    def given(self, i: int, j):
        return ((j * self.share[i + 1]) >> SHIFT) - ((j * self.share[i]) >> SHIFT)


def _shares(weights: list[float], window: int) -> list[int]:
    """Cumulative fixed-point shares; each queue with a weight gets a token a window at least."""
    total, full, live = sum(weights), window << SHIFT, [w > 0 for w in weights]
    parts = [max(1 << SHIFT, int(full * w / total)) if on else 0 for w, on in zip(weights, live, strict=True)]
    largest = max(range(len(parts)), key=parts.__getitem__)
    parts[largest] += full - sum(parts)
    out = [0]
    for x in parts:
        out.append(out[-1] + x)
    return out


def schedule(totals: list[int], weights: list[float] | None = None, window: int = WINDOW) -> list[Segment]:
    """Deficit round-robin over queues of totals[i] tokens, until all are empty.

    weights: the target proportions; by default those of the totals. While all queues last, the closed form holds. The
    window in which one would run dry gives what is left of it, and the queues with the most tokens fill it up.
    """
    left, segments, at = list(totals), [], 0
    while sum(left):
        want = [(float(x) if weights is None else weights[i]) if x else 0.0 for i, x in enumerate(left)]
        if not sum(want):
            want = [float(x) for x in left]
        share, served = _shares(want, window), tuple(t - x for t, x in zip(totals, left, strict=True))
        plan = Segment(at, 0, served, tuple(share))
        fits = lambda n: all(plan.given(i, n) <= x for i, x in enumerate(left))
        lo, hi = 0, min(sum(left) // window, (1 << 31) - 1)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if fits(mid) else (lo, mid - 1)
        if lo:
            segments.append(Segment(at, lo, served, tuple(share)))
            left = [x - plan.given(i, lo) for i, x in enumerate(left)]
            at += lo
            continue
        give = [min(x, plan.given(i, 1)) for i, x in enumerate(left)]
        short = min(window, sum(left)) - sum(give)
        for i in sorted(range(len(left)), key=lambda i: give[i] - left[i]):
            more = min(short, left[i] - give[i])
            give[i], short = give[i] + more, short - more
        cum = [0]
        for x in give:
            cum.append(cum[-1] + x)
        segments.append(Segment(at, 1, served, tuple(x << SHIFT for x in cum)))
        left = [x - y for x, y in zip(left, give, strict=True)]
        at += 1
    return segments


def pieces(segments: list[Segment], starts: list[np.ndarray], queue: int, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset in it) of tokens at .. at + n of a queue. starts[queue]: its tokens before each segment."""
    done = 0
    k = int(np.searchsorted(starts[queue], at, side="right")) - 1
    while done < n:
        s = segments[k]
        x = at + done - s.served[queue]
        span = s.given(queue, s.count)
        if x >= span:
            k += 1
            continue
        a, b = s.share[queue], s.share[queue + 1]
        j = min(s.count - 1, (x << SHIFT) // (b - a))
        while s.given(queue, j) > x:
            j -= 1
        while s.given(queue, j + 1) <= x:
            j += 1
        while x < span and done < n:
            begin, end = s.given(queue, j), s.given(queue, j + 1)
            if end > x:
                size = min(end - x, n - done)
                yield done, size, s.first + j, (((j + 1) * a) >> SHIFT) - ((j * a) >> SHIFT) + x - begin
                done, x = done + size, x + size
            j += 1
        k += 1


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Each document's ids, with its place among the tokens of its source in its partition. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], np.uint16).tobytes()
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                ids = [encode(t or "") + end for t in batch.column("text").to_pylist()]
                sources, offsets = batch.column("source").to_pylist(), []
                for s, x in zip(sources, ids, strict=True):
                    offsets.append(seen.get(s, 0))
                    seen[s] = offsets[-1] + len(x) // 2
                cols = [pa.array([part] * len(ids), pa.int32()), batch.column("source"), batch.column("doc_id"), pa.array(offsets, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "source", "doc_id", "before", "ids"])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(run, "part int, source string, doc_id long, before long, ids binary")


def _taking_turns(docs: DataFrame, window: int) -> DataFrame:
    """Documents of many small sources in one queue: `at` as tokens of their source becomes that of the queue.

    Each source is cut into quanta of `window` tokens at most (ends of documents cut too). A quantum is due when the queue
    has given the share of its tokens that the source has given at the quantum's middle: so after any number of tokens
    each source is within about a quantum of what it is owed.
    """
    quanta = F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("doc_tokens") - 1) / window))
    cut = docs.withColumn("quantum", F.explode(quanta)).withColumn("low", F.greatest("at", F.col("quantum") * window)).withColumn("high", F.least(F.col("at") + F.col("doc_tokens"), (F.col("quantum") + 1) * window))
    due = (F.col("quantum") * window + F.least((F.col("quantum") + 1) * window, F.col("all"))) / (2 * F.col("all"))
    first = F.col("low") - F.col("at")
    ids = F.substring("ids", (2 * first + 1).cast("int"), (2 * (F.col("high") - F.col("low"))).cast("int"))
    lean = cut.select("doc_id", "source", first.alias("from"), "doc_tokens", ids.alias("ids"), due.alias("due"), F.xxhash64("source", "quantum").alias("tie"), "low")
    lined = lean.repartitionByRange("due", "tie", "source", "low").sortWithinPartitions("due", "tie", "source", "low")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.array([len(x) // 2 for x in batch.column("ids").to_pylist()], np.int64)
            before = seen + np.cumsum(n) - n
            seen += int(n.sum())
            cols = [batch.column(c) for c in ("doc_id", "source", "from", "doc_tokens", "ids")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(n), pa.int32()), pa.array(before)], ["doc_id", "source", "from", "doc_tokens", "ids", "run", "before"])

    kind = "doc_id long, source string, from long, doc_tokens long, ids binary, run int, before long"
    runs = stash(lined.select("doc_id", "source", "from", "doc_tokens", "ids").mapInArrow(numbered, kind), "packing-tail")
    sums = runs.groupBy("run").agg(F.sum(F.octet_length("ids") / 2).cast("long").alias("n"))  # one row a task
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return runs.join(F.broadcast(base), "run").select("doc_id", "source", (F.col("base") + F.col("before")).alias("at"), "from", "doc_tokens", "ids")


def pack(docs: DataFrame, weights: dict[str, float] | None = None, vocabulary: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pack the ids of all documents into sequences of `window` tokens; only the last may be shorter.

    weights: target token proportions by source, by default those of the corpus; sources not named get what the others
    leave. Each source is a queue, also each named one, however small; only sources below one token a window that are not
    named share one, in which they take turns in proportion (`_taking_turns`). So there are at most `window` queues;
    more named sources than that are an error.
    Returns doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids (uint16).
    A null text is empty, a null source is the source ''. Null and repeated doc_ids each keep their row. An empty table gives no pieces.
    Extra columns are ignored.

    One pass tokenizes; where a document's tokens stand in its queue is a prefix sum over (source, partition) totals, and
    its windows follow from that place in closed form: no queue is ever gathered, and none but the shared one sorted.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    tok = stash(tokenized(docs, vocabulary), "packing-ids")
    size = (F.octet_length("ids") / 2).cast("long")
    parts = stash(tok.groupBy("source", "part").agg(F.sum(size).alias("n")), "packing-parts")
    total = parts.agg(F.sum("n")).first()[0] or 0
    by_source = parts.groupBy("source").agg(F.sum("n").alias("n"))
    named = {s: float(w) for s, w in (weights or {}).items() if w > 0}
    if len(named) >= window:
        raise ValueError(f"{len(named)} sources with a weight, but a window of {window} tokens")
    wanted = spark.createDataFrame([(s,) for s in named], "source string")
    own = {r["source"]: r["n"] for r in by_source.join(F.broadcast(wanted), "source", "left_semi").collect()} if named else {}
    others = by_source.where(F.col("n") * window >= total).orderBy(F.desc("n"), "source").limit(window).collect()
    for r in others:  # at most `window` queues with that of the tail
        if r["source"] in own or len(own) < window - 1:
            own[r["source"]] = r["n"]
    names = sorted(own)
    totals = [own[s] for s in names] + [total - sum(own.values())]
    named = None if weights is None else [named.get(s, 0.0) for s in names] + [0.0]
    plan = schedule(totals, named, window)
    number = {s: i for i, s in enumerate(names)}
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("source"))).select("source", "part", "base", "all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [np.array([s.served[i] for s in plan], np.int64) for i in range(len(totals))]
        schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), *[("ids", pa.binary())] * with_ids])
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                rows = [[] for _ in schema]
                for doc, source, at, begin, doc_tokens, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "at", "from", "doc_tokens", "ids")), strict=True):
                    wide = memoryview(np.frombuffer(raw, np.uint16).astype("<u4").tobytes())
                    for start, length, seq, offset in pieces(plan, starts, number.get(source, len(names)), at, len(raw) // 2):
                        values = (doc, source, begin + start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), doc_tokens, seq, offset, raw[2 * start : 2 * (start + length)])
                        for r, v in zip(rows, values, strict=False):
                            r.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema, strict=True)], schema=schema)

    at_source = tok.join(base, ["source", "part"]).select("doc_id", "source", (F.col("base") + F.col("before")).alias("at"), F.lit(0).cast("long").alias("from"), size.alias("doc_tokens"), "ids", "all")
    placed = at_source.drop("all")
    if totals[-1]:
        mine = F.col("source").isin(names) if names else F.lit(False)
        placed = placed.where(mine).unionByName(_taking_turns(at_source.where(~mine), window))
    kind = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return placed.mapInArrow(run, kind)


def op7_mixture_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
