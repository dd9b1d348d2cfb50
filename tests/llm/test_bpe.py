"""BPE against the tiktoken library, word fold included, and an exact round trip."""

import base64
import hashlib
import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from foliant.llm import bpe, common

TEXTS = ["Hello world", "", None, "  two  spaces \n\n x", "it's we're <|endoftext|> 123 4567", "é" * 40, "a" * 3000, " 　 \x1c\x85x", "日本語 текст\tmixed\r\n", "ab" * 50 + " " * 30, "x \n", "\n y"]


def test_like_the_library(spark):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()), special_tokens={})
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, "again", "x")], "doc_id long, text string, n_tokens string")
    got = bpe.encode(docs).collect()
    want = {(i, tuple(own.encode_ordinary(t or ""))) for i, t in [*enumerate(TEXTS), (None, "null id"), (3, "again")]}
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got} == want
    for r in got:
        assert r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
    texts = {hashlib.sha256((t or "").encode()).hexdigest() for t in [*TEXTS, "null id", "again"]}
    assert {r.decoded_sha256 for r in got} == texts


def test_fold_alone_and_decoding(spark):
    ranks = bpe.load_ranks(bpe.default_vocabulary())
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    words = [w for w in (" hello", "ing", "Öung", " the", "zzzzz", "a", "gergeverbegen", " thntrerewhes")]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, w string")
    coded = rows.select("doc_id", bpe.fold_merges(F.col("w").cast("binary"), bpe.rank_literal(ranks)).alias("ids"))
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: own.encode_ordinary(w) for i, w in enumerate(words)}
    assert {r.doc_id: bytes(r.text).decode() for r in bpe.decode(coded).collect()} == dict(enumerate(words))


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert base64.b64decode("IQ==") in bpe.load_ranks(bpe.default_vocabulary())


def test_registered_query_on_a_whole_table(spark):
    """Every row of sf0.001's documents against the library."""
    from foliant.llm import queries

    sf = "/root/testdata/sf0.001"
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()), special_tokens={})
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(own.encode_ordinary(r.text or ""), "<u4")
        want.add((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = queries.QUERIES["op2_byte_bpe"](spark, sf).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_many_blocks(spark, monkeypatch):
    """Blocks of a few words and parts of several words give the same ids; so do words too long to fold."""
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()), special_tokens={})
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20)
    monkeypatch.setattr(bpe, "PARTS", 3)
    monkeypatch.setattr(bpe, "LONG_WORD", 16)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs).collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in enumerate(TEXTS * 3)}


def test_fold_by_numbers(spark):
    """Ranks are one literal, pairs of ids are looked up without strings, and pieces with several splits and runs of one letter come out as by the heap."""
    ranks = {bytes([i]): i for i in range(256)} | {w: 256 + i for i, w in enumerate([b"bc", b"abc", b"ab", b"aa", b"aaaa", b"cab", b"!!", b"ca"])}
    words = [b"abc", b"abcabc", b"aaaaaaa", b"cabcab", b"!!!!!", b"bcab", b"", b"\xff\x00a", b"ab" * 300]
    rows = spark.createDataFrame([(w,) for w in words], "w binary")
    coded = rows.select("w", bpe.fold_merges(F.col("w"), bpe.rank_literal(ranks)).alias("ids"))
    assert {bytes(r.w): r.ids for r in coded.collect()} == {w: bpe.merge(w, ranks) for w in words}
    plan = coded._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") == 1 and "hex(" not in plan


def test_workers_give_memory_back(monkeypatch):
    """A Python worker outlives its tasks: when blocks are done it holds little more than before, not the words and chunks of the last one."""

    class Frame:
        def mapInArrow(self, fn, _):
            return fn

    def own() -> float:
        return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run, letters = bpe.blocks_of(Frame(), bpe.default_pattern()), str.maketrans("0123456789", "ghijklmnop")

    def batches(n):
        for b in range(n):
            yield pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array([" ".join(f"{(b * 50 + i) * 4000 + j:x}" for j in range(4000)).translate(letters) for i in range(50)])], ["doc_id", "text"])

    assert sum(len(x.column("doc_ids")[0]) for x in run(batches(1))) == 50
    common.release()
    before = own()
    assert sum(len(x.column("doc_ids")[0]) for x in run(batches(4))) == 200
    assert own() - before < 25
