"""WARC archives with a two-level capture index: sorted compressed blocks of keys, and a sparse directory that is binary-searched before range reads."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, qualified, scratch_path, stash

#: Lines in an index block, and bytes after which an archive file ends.
BLOCK_LINES, FILE_BYTES = 500, 256 << 20
#: So many keys at most part the directory among the tasks of a look-up.
PARTS = 4096
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "surt string, page_id long, file string, offset long, length long, digest string, kind string, refers_to long"
DIRECTORY = "part int, first string, last string, file string, offset long, length long, lines int"
RECORDS = "surt string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


@dataclass(frozen=True)
class Archive:
    """Where the archives lie; their captures and the sparse directory of the index as tables."""

    base: str
    captures: DataFrame
    directory: DataFrame


def surt(url: str) -> str:
    """Sort key: host labels reversed, then path and query, without scheme or fragment, in lower case up to the path."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip()
    if not host:
        return url.strip()
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def filesystem(base: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder all executors share, named by its scheme, and the folder's path on it."""
    if ":" not in base.split("/")[0]:
        raise ValueError(f"{base} names no file system")
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", base))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose Content-Length is that of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; a response's payload must have the digest and length its headers state."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: None if x in (None, "<urn:page:none>") else int(x.removeprefix("<urn:page:").rstrip(">"))
    return {"url": fields["WARC-Target-URI"], "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload}


def write_archives(pages: DataFrame, base: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a gzip member for each row of pages and return the captures.

    Rows with equal payloads of at least min_revisit_bytes: that with the largest page_id is the response, others revisit it.
    Only payloads that occur more than once are kept for that look-up. A task writes files named after its attempt; the
    captures name files of attempts that ended well, so what a lost executor leaves is never read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    again = stash(rows.where(F.col("size") >= min_revisit_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("rep"), F.count("*").alias("n")).where("n > 1 and rep is not null").select("sha", "size", "rep"), "warc-again")
    decided = rows.join(again, ["sha", "size"], "left").select("page_id", "url", "payload", F.when(~F.col("rep").eqNullSafe(F.col("page_id")), F.col("rep")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(base)
        fs.create_dir(f"{folder}/archives", recursive=True)
        task, number, out, name, at = TaskContext.get(), 0, None, "", 0
        try:
            for whole in batches:
                for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                    rows = []
                    for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        if out is None or at >= FILE_BYTES:
                            if out is not None:
                                out.close()
                            name = f"archives/{task.partitionId():06d}-{task.taskAttemptId()}-{number:03d}.warc.gz"
                            out, at, number = fs.open_output_stream(f"{folder}/{name}", compression=None), 0, number + 1
                        member = gzip.compress(record(page, url, payload, refers), 6, mtime=0)
                        out.write(member)
                        rows.append((surt(url), page, name, at, len(member), payload_digest(payload), "revisit" if refers is not None else "response", refers))
                        at += len(member)
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in CAPTURES.split(", ")])
        finally:
            if out is not None:
                out.close()

    return stash(decided.mapInArrow(run, CAPTURES), "warc-captures")


def build_index(captures: DataFrame, base: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by (key, page) into files of compressed blocks; the directory has each block's first and last key and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(base)
        fs.create_dir(f"{folder}/index", recursive=True)
        task, lines, out, at, rows = TaskContext.get(), [], None, 0, []
        name = f"index/{task.partitionId():06d}-{task.taskAttemptId()}.gz"

        def close_block() -> None:
            nonlocal at
            block = gzip.compress("\n".join(x[1] for x in lines).encode(), 6, mtime=0)
            out.write(block)
            rows.append((task.partitionId(), lines[0][0], lines[-1][0], name, at, len(block), len(lines)))
            at += len(block)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                out = out or fs.open_output_stream(f"{folder}/{name}", compression=None)
                lines.append((row["surt"], json.dumps(row)))
                if len(lines) >= block_lines:
                    close_block()
        if lines:
            close_block()
        if out is not None:
            out.close()
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in DIRECTORY.split(", ")])

    ordered = captures.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id", "file", "offset")
    return stash(ordered.mapInArrow(run, DIRECTORY), "warc-directory")


def write(pages: DataFrame, base: str | None = None, min_revisit_bytes: int = 0) -> Archive:
    """Archives and their index under `base` (a new folder in the shared one by default).

    A null html is an empty payload, a null url the empty key; rows that repeat a page_id are records of their own, and
    of equal payloads all records with the largest page_id are responses. A null page_id revisits the largest one
    that is known, else it is a response. Extra columns are ignored; an empty table gives no files.
    """
    base = qualified(pages.sparkSession, base) if base else scratch_path(pages.sparkSession, "warc")
    captures = write_archives(pages, base, min_revisit_bytes)
    return Archive(base, captures, build_index(captures, base))


class Reader:
    """Range reads of index blocks and records."""

    def __init__(self, base: str):
        self.fs, self.folder = filesystem(base)

    def ranges(self, file: str, places: list[tuple[int, int]]) -> Iterator[bytes]:
        with self.fs.open_input_file(f"{self.folder}/{file}") as f:
            for offset, length in places:
                yield f.read_at(length, offset)

    def captures(self, blocks: list[tuple[str, int, int]], lo: str | None, hi: str | None) -> list[dict]:
        out = []
        for file, offset, length in blocks:
            for raw in self.ranges(file, [(offset, length)]):
                out += [c for c in map(json.loads, gzip.decompress(raw).decode().split("\n")) if (lo is None or c["surt"] >= lo) and (hi is None or c["surt"] <= hi)]
        return out

    def records(self, captures: list[dict]) -> Iterator[dict]:
        by_file: dict[str, list[dict]] = {}
        for c in captures:
            by_file.setdefault(c["file"], []).append(c)
        for file, own in by_file.items():
            own.sort(key=lambda c: c["offset"])
            for c, raw in zip(own, self.ranges(file, [(c["offset"], c["length"]) for c in own]), strict=True):
                yield parse(zlib.decompress(raw, 31)) | {"surt": c["surt"]}


def _batches(rows: Iterator[dict], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payloads
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], t) for n, t in zip(names, kinds, strict=True)], names)

    for row in rows:
        held.append(row)
        if len(held) >= 500:
            yield batch()
            held = []
    if held:
        yield batch()


def search(firsts: list[str], lasts: list[str], lo: str | None, hi: str | None) -> range:
    """Blocks of one sorted directory that may hold keys from lo to hi, by binary search."""
    return range(0 if lo is None else bisect.bisect_left(lasts, lo), len(firsts) if hi is None else bisect.bisect_right(firsts, hi))


def scan(archive: Archive, lo: str | None = None, hi: str | None = None, payloads: bool = False) -> DataFrame:
    """Records with keys from lo to hi (both within, None: no bound), read back from the archives.

    For each index file the directory is binary-searched; the blocks found are dealt out and range-read, then the records.
    """
    spark, base = archive.directory.sparkSession, archive.base
    parts = archive.directory.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("offset", "first", "last", "file", "length"))).alias("blocks"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks in batch.column("blocks").to_pylist():
                hit = [blocks[i] for i in search([b["first"] for b in blocks], [b["last"] for b in blocks], lo, hi)]
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array([b[k] for b in hit]) for k in ("file", "offset", "length")], ["file", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(base)
        yield from _batches((r for b in batches for row in b.to_pylist() for r in reader.records(reader.captures([(row["file"], row["offset"], row["length"])], lo, hi))), payloads)

    places = parts.select("blocks").mapInArrow(locate, "file string, offset long, length long")
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return places.repartition(n, "file", "offset").mapInArrow(read, RECORDS + ", payload binary" * payloads)


def lookup(archive: Archive, urls: DataFrame, payloads: bool = False, parts: int = PARTS) -> DataFrame:
    """Records of the given urls (column `url`), each record once however often its key is asked for.

    At most `parts` keys of the directory part it into spans. Each different key asked for goes to its span, where the
    directory's blocks are binary-searched. Each block found is range-read by one task, which keeps the captures of keys
    asked for and range-reads their records; so a key with very many captures is very many tasks.
    A null url asks for the empty key. Extra columns are ignored.
    """
    spark, base = archive.directory.sparkSession, archive.base
    cuts = sorted({r["first"] for r in archive.directory.orderBy(F.xxhash64("file", "offset"), "file", "offset").limit(parts).select("first").collect()})

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = sorted({surt(u or "") for u in batch.column(0).to_pylist()})
        return pa.RecordBatch.from_arrays([pa.array([bisect.bisect_right(cuts, k) for k in own], pa.int32()), pa.array(own, pa.string())], ["span", "key"])

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, *row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i in range(bisect.bisect_right(cuts, row[0]), bisect.bisect_right(cuts, row[1]) + 1)]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["span", "first", "last", "file", "offset", "length"])

    def find(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        order = sorted(zip(*(blocks.column(c).to_pylist() for c in ("first", "last", "file", "offset", "length")), strict=True))
        firsts, lasts, hit = [b[0] for b in order], [b[1] for b in order], {}
        for k in asked.column("key").to_pylist():
            for i in search(firsts, lasts, k, k):
                hit.setdefault(i, []).append(k)
        cols = [[order[i][2] for i in hit], [order[i][3] for i in hit], [order[i][4] for i in hit], list(hit.values())]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], ["file", "offset", "length", "keys"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(base)

        def records() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    wanted = set(row["keys"])
                    yield from reader.records([c for c in reader.captures([(row["file"], row["offset"], row["length"])], None, None) if c["surt"] in wanted])

        yield from _batches(records(), payloads)

    asked = arrow_map(urls.select(F.col("url").cast("string")), keys, "span int, key string").distinct()
    spans = arrow_map(archive.directory.select("first", "last", "file", "offset", "length"), spread, "span int, first string, last string, file string, offset long, length long")
    places = asked.groupBy("span").cogroup(spans.groupBy("span")).applyInArrow(find, "file string, offset long, length long, keys array<string>")
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return places.repartition(n, "file", "offset").mapInArrow(read, RECORDS + ", payload binary" * payloads)


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record for each row of `pages`, look every page's key up in the index, and read the records it names."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return lookup(write(pages), pages.select("url")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
