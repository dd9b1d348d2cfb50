"""Byte-level BPE: higher-order functions fold ranked merges over all distinct words with a literal rank map; decoding joins binary pieces.

Documents are split into words in blocks of about BLOCK_BYTES. A block sends each different word once, packed with others of
its part of the vocabulary; each distinct word of the corpus is folded once; the ids go back packed in the order asked. So
shuffles carry a block's different words, never its texts, and a frequent word is one word of each block.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import forget, release, stash, stash_bucketed, unstash
from foliant.llm.katz import pack, unpack

#: Bytes of text in a block, and parts of the vocabulary of which one is in a task's memory at a time.
BLOCK_BYTES, PARTS = 24 << 20, 2048
#: A fold takes time with the square of a word's bytes; words of more bytes than this are merged in n log n by a heap instead.
LONG_WORD = 2048
BLOCKS = "block long, doc_ids array<long>, lens binary, words binary, asks array<struct<part: int, lens: binary, raw: binary>>"
FOLDED = "part int, lens binary, raw binary, counts binary, ids binary"
ANSWERS = "block long, part int, lens binary, ids binary"
#: Folded words that a task gathers before it packs them by part.
GATHER = 1 << 18
#: Bits of a rank, an id or a place in a word; three of them are a long. Ranks are below LIMIT.
BITS = 20
LIMIT = 1 << BITS
#: White space of the split pattern, spelled out since engines differ on \s.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def spelled(pattern: str) -> str:
    """The pattern with \\s and \\S spelled out, for Java."""
    return re.sub(r"\[\^\\s", lambda _: f"[^{SPACE}", pattern).replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The id of each byte, and the rank of each pair of ids that are a piece together, as a struct of arrays.

    A pair's key is a * LIMIT + b. It lies in `slots` at key % size + moves[key % n], as key * LIMIT + rank, and no two
    pairs share a place. So the exclusive or of a place and key * LIMIT is the rank, or LIMIT at least if the pair is no piece.
    """
    if max(ranks.values(), default=0) >= LIMIT - 1:
        raise ValueError(f"ranks of {LIMIT - 1} or more")
    first = [LIMIT - 1] * 256  # a byte without a rank is no part of any pair
    for i in range(256):
        first[zlib.crc32(bytes([i])) >> 24] = ranks.get(bytes([i]), LIMIT - 1)  # these bits of the check sum tell all bytes apart
    pairs = {0: LIMIT}  # an empty place is 0
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                pairs[left * LIMIT + right] = rank
    groups: dict[int, list[int]] = {}
    n = len(pairs) // 3 | 1
    for key in pairs:
        groups.setdefault(key % n, []).append(key)
    size = 2 * len(pairs) | 1
    while any(len({k % size for k in own}) < len(own) for own in groups.values()):
        size += 2
    moves, taken = [0] * n, {}
    for g, own in sorted(groups.items(), key=lambda x: -len(x[1])):
        at, move = [k % size for k in own], 0
        while any(x + move in taken for x in at):
            move += 1
        moves[g] = move
        taken.update((x + move, k * LIMIT + pairs[k]) for x, k in zip(at, own, strict=True))
    slots = [taken.get(i, 0) for i in range(size + max(moves))]
    return F.from_json(F.lit(json.dumps({"first": first, "moves": moves, "slots": slots, "n": n, "size": size}, separators=(",", ":"))), "first array<long>, moves array<long>, slots array<long>, n long, size long")


def _let(value: Column, fn) -> Column:
    return F.element_at(F.transform(F.array(value), fn), 1)


def fold_merges(word: Column, ranks: Column) -> Column:
    """Ids of a binary word: each step joins the leftmost pair of lowest rank.

    The state is one number for each id, (rank of its pair with the next one, byte it starts at, id): the least of them is
    the pair to join, of equal ranks the leftmost, and a step looks up two ranks. Arrays are joined by `flatten`, since
    `concat` of arrays takes several times as long.
    """
    pad, done, whole, low = F.lit(LIMIT - 1).cast("long"), F.lit(LIMIT << 2 * BITS), F.lit(LIMIT), F.lit((1 << 2 * BITS) - 1)
    left, right = (lambda x, n=1: F.shiftleft(x, n * BITS)), (lambda x, n=1: F.shiftright(x, n * BITS))
    one, idle = F.lit(1), F.lit(LIMIT - 1)

    def folded(t: Column) -> Column:
        def rank(k: Column) -> Column:
            return F.least(t["slots"][t["moves"][k % t["n"]] + k % t["size"]].bitwiseXOR(left(k)), F.lit(LIMIT))

        def told(x: Column) -> Column:  # (start, id, next id) as the state has it
            return left(rank(x.bitwiseAND(low)), 2).bitwiseOR(right(x))

        def merged(q: Column, m: Column, i: Column) -> Column:
            best = right(m, 2)
            before = left(q[i - 2].bitwiseAND(low)).bitwiseOR(best)
            own = left(m.bitwiseAND(F.lit((LIMIT - 1) << BITS)).bitwiseOR(best)).bitwiseOR(q[i + 1].bitwiseAND(idle))
            return F.flatten(F.array(F.slice(q, one, i - 2), F.transform(F.array(before, own), told), F.slice(q, i + 2, whole)))

        def step(q: Column, _: Column) -> Column:
            return _let(F.array_min(q), lambda m: F.when(m >= done, q).otherwise(_let(F.array_position(q, m).cast("int"), lambda i: merged(q, m, i))))

        # a pad at both ends, in no pair of the literal, so that every pair has an id beside it
        at = F.sequence(one, F.octet_length(word))
        ids = F.flatten(F.array(F.array(pad), F.transform(at, lambda i: t["first"][F.shiftright(F.crc32(F.substring(word, i, one)), 24)]), F.array(pad)))
        start = _let(ids, lambda p: F.transform(F.zip_with(p, F.slice(p, F.lit(2), whole), lambda a, b: left(a).bitwiseOR(F.coalesce(b, pad))), lambda k, i: told(left(i.cast("long"), 2).bitwiseOR(k))))
        return _let(F.aggregate(at, start, step), lambda q: F.transform(F.slice(q, F.lit(2), F.size(q) - 2), lambda x: x.bitwiseAND(idle).cast("int")))

    return F.when(F.octet_length(word) > 0, _let(ranks, folded)).otherwise(F.array().cast("array<int>"))


class Chunks(dict):
    """The numbers of the words of a space and each key, made when first asked for."""

    def __init__(self, words: Callable[[str], bytes]):
        self.words = words

    def __missing__(self, key: str) -> bytes:
        own = self[key] = self.words(" " + key)
        return own


class Splitter:
    """Splits a text into the pattern's words and numbers them in order of appearance.

    A space before what is no space starts a word whatever precedes it, so texts fall into chunks there, and the chunks of
    the block are remembered. Texts in which a space stands before other space or the end are split whole.
    """

    def __init__(self, pattern: str):
        import regex

        space = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
        self.split = regex.compile(re.sub(r"\[\^\\s", lambda _: f"[^{space}", pattern).replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")).findall
        self.apart = re.compile(r" (?:\s|\Z)").search
        self.number: dict[str, int] = {}
        self.chunks = Chunks(self.words)

    def taken(self) -> list[bytes]:
        """The words in order of their numbers; the splitter starts anew."""
        self.chunks = Chunks(self.words)
        out, self.number = [w.encode() for w in self.number], {}
        return out

    def words(self, text: str) -> bytes:
        number = self.number
        found = [number.setdefault(w, len(number)) for w in self.split(text)]
        return struct.pack(f"<{len(found)}I", *found)

    def __call__(self, text: str) -> np.ndarray:
        if not text or self.apart(text):
            return np.frombuffer(self.words(text), "<u4")
        first, *rest = text.split(" ")
        return np.frombuffer(self.words(first) + b"".join(map(self.chunks.__getitem__, rest)), "<u4")


def blocks_of(texts: DataFrame, pattern: str) -> DataFrame:
    """Documents as numbers of their block's words, and the words themselves by parts of the vocabulary, in the order of the numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        number, splitter, docs, each, size = TaskContext.get().partitionId() << 32, Splitter(pattern), [], [], 0
        ask = pa.list_(pa.struct([("part", pa.int32()), ("lens", pa.binary()), ("raw", pa.binary())]))
        codec = pa.Codec("zstd", compression_level=3)

        def close() -> pa.RecordBatch:
            words, lens, flat = splitter.taken(), np.array([len(x) for x in each], np.int64), np.concatenate([*each, np.zeros(0, np.uint32)])
            each.clear()
            part = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % PARTS
            order = np.argsort(part, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words))
            cuts, asks = np.searchsorted(part[order], np.arange(PARTS + 1)), []
            for i in np.nonzero(np.diff(cuts))[0].tolist():
                own = [words[j] for j in order[cuts[i] : cuts[i + 1]].tolist()]
                asks.append({"part": i, "lens": pack(np.fromiter(map(len, own), np.uint32, len(own))), "raw": codec.compress(b"".join(own), asbytes=True)})
            cols = [pa.array([number], pa.int64()), pa.array([docs], pa.list_(pa.int64())), *(pa.array([pack(x)], pa.binary()) for x in (lens, place[flat])), pa.array([asks], ask)]
            return pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "lens", "words", "asks"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = text.as_py()
                docs.append(doc)
                each.append(splitter(own))
                size += len(own)
                if size >= BLOCK_BYTES:
                    yield close()
                    docs, size, number = [], 0, number + 1
                    release()
        if docs:
            yield close()
        batch = own = text = None
        release()

    return texts.mapInArrow(run, BLOCKS)


def _asked(lens: bytes, raw: bytes) -> list[bytes]:
    ends = np.cumsum(unpack(lens).astype(np.int64))
    whole = pa.Codec("zstd").decompress(raw, int(ends[-1]), asbytes=True)
    return [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def folded_words(asks: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Every distinct word of up to LONG_WORD bytes, encoded by `fold_merges`; words and their ids packed by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for lens, raw in zip(batch.column("lens").to_pylist(), batch.column("raw").to_pylist(), strict=True) for w in _asked(lens, raw) if len(w) <= LONG_WORD]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], ["word"])
        batch = words = None
        release()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part, n, codec = {}, 0, pa.Codec("zstd", compression_level=3)

        def flush() -> pa.RecordBatch:
            rows = []
            for part, own in by_part.items():
                words, ids = zip(*own, strict=True)
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32)
                rows.append((part, pack(np.fromiter(map(len, words), np.uint32, len(words))), codec.compress(b"".join(words), asbytes=True), pack(np.fromiter(map(len, ids), np.uint32, len(ids))), pack(flat)))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "lens", "raw", "counts", "ids"])

        for batch in batches:
            for word, ids in zip(batch.column("word").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                by_part.setdefault(zlib.crc32(word) % PARTS, []).append((word, ids))
            n += batch.num_rows
            if n >= GATHER:
                yield flush()
                by_part, n = {}, 0
        if by_part:
            yield flush()
        by_part = batch = None
        release()

    words = asks.select("lens", "raw").mapInArrow(run, "word binary").distinct()
    return words.select("word", fold_merges(F.col("word"), rank_literal(ranks)).alias("ids")).mapInArrow(packed, FOLDED)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word. A heap of (rank, place) over a linked list: lowest rank first, then leftmost."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i]
        if j < 0 or j >= n or ends[j] != end:  # one of the two was joined meanwhile
            continue
        ends[i], ends[j] = end, -1
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return [ranks[word[i : ends[i]]] for i in range(n) if ends[i] > 0]


def answers(asks: DataFrame, folded: DataFrame, vocabulary: str) -> DataFrame:
    """The ids of each ask's words, packed. A part's words are met before its asks, which pass one by one."""
    nothing = F.lit(None).cast("binary")
    words = folded.select("part", F.lit(0).alias("side"), F.lit(None).cast("long").alias("block"), "lens", "raw", "counts", "ids")
    rows = words.unionByName(asks.select("part", F.lit(1).alias("side"), "block", "lens", "raw", nothing.alias("counts"), nothing.alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, ranks = {}, None, None
        for batch in batches:
            out: list = []
            for part, side, block, lens, raw, counts, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    known, at = {}, part
                own = _asked(lens, raw)
                if not side:
                    flat, ends = unpack(ids), np.cumsum(unpack(counts).astype(np.int64))
                    known.update(zip(own, np.split(flat, ends[:-1]), strict=True))
                    continue
                for w in own:
                    if w not in known:  # a long one
                        ranks = ranks or load_ranks(vocabulary)
                        known[w] = np.array([ranks[w]] if w in ranks else merge(w, ranks), np.uint32)
                found = [known[w] for w in own]
                out.append((block, part, pack(np.fromiter(map(len, found), np.uint32, len(found))), pack(np.concatenate(found))))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "part", "lens", "ids"])
        known = batch = out = own = found = None
        release()

    return rows.repartition("part").sortWithinPartitions("part", "side").select("part", "side", "block", "lens", "raw", "counts", "ids").mapInArrow(run, ANSWERS)


def _texts_ids(blocks: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, ids, tokens) of each document: its words' ids, gathered from its block's answers."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("tokens", pa.list_(pa.int32()))])

    def gathered(own: pa.Table, answers: pa.Table) -> pa.Table:
        row, told, batches = own.to_pylist()[0], sorted(answers.to_pylist(), key=lambda r: r["part"]), []
        lens = np.concatenate([np.zeros(0, np.int64), *(unpack(r["lens"]).astype(np.int64) for r in told)])
        flat = np.concatenate([np.zeros(0, np.uint32), *(unpack(r["ids"]) for r in told)])
        first, words = np.cumsum(lens) - lens, unpack(row["words"])
        ends = np.cumsum(unpack(row["lens"]))
        for doc, a, b in zip(row["doc_ids"], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            mine = words[a:b]
            n = lens[mine]
            upto = np.cumsum(n)
            ids = flat[np.repeat(first[mine] - (upto - n), n) + np.arange(upto[-1] if len(n) else 0)].astype("<u4")
            batches.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), ids.astype(np.int32)))
        cuts = np.cumsum([0, *(n for _, n, _, _ in batches)])
        tokens = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *(x for *_, x in batches)])))
        return pa.table([pa.array([x[0] for x in batches], pa.int64()), pa.array([x[1] for x in batches], pa.int64()), pa.array([x[2] for x in batches], pa.string()), tokens], schema=kind)

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = gathered(own, answers)
        release()
        return out

    return blocks.select("block", "doc_ids", "lens", "words").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, tokens array<int>")


def pieces_literal(ranks: dict[bytes, int]) -> Column:
    """array<string>: the bytes of each id, as hex digits."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    return F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")


def decoded(ids: Column, literal: Column) -> Column:
    """The bytes of an array of ids: each id's binary piece, joined. Ids outside the vocabulary fail."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(literal, i + 1)), ""))


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of ids as little-endian uint32), decoded_sha256, and with_ids the ids so packed.
    A null text is empty and has no ids. No special tokens: their strings are ordinary text. Null and repeated doc_ids
    each keep their row; extra columns are ignored; an empty table gives no rows.
    """
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    ranks = load_ranks(vocabulary)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = stash_bucketed(blocks_of(texts, pattern), "bpe-blocks", "block")
    asks = blocks.select("block", F.explode("asks").alias("ask")).select("block", "ask.part", "ask.lens", "ask.raw")
    folded = stash(folded_words(asks, ranks), "bpe-folded")
    told = stash(answers(asks, folded, vocabulary), "bpe-answers")
    unstash(folded)
    out = _texts_ids(blocks, told)
    packed = F.unhex(F.array_join(F.transform("tokens", lambda i: F.concat(*(F.lpad(F.hex(F.call_function("shiftright", i, F.lit(8 * k)).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)))), ""))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(decoded(F.col("tokens"), pieces_literal(ranks)), 256).alias("decoded_sha256"), *[packed.alias("ids")] * with_ids)


def decode(ids: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) to (doc_id, text binary). Null ids give null; ids outside the vocabulary fail."""
    return ids.select("doc_id", decoded(F.col("ids"), pieces_literal(load_ranks(vocabulary or default_vocabulary()))).alias("text"))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of `documents`: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
