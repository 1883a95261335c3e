"""Deterministic sharded writer of WARC archives, and a reader that trusts nothing but the manifest.

Records are range-sorted by address and id. The bounds of the ranges are quantiles, by bytes, of a sample chosen by hash, so they depend
on the rows alone, never on how they were dealt out; there are MOST_SHARDS ranges at most. Each range is a shard, written by one task in order, which starts a new file
when the compressed size passes `roll_bytes`. Headers and digests are made anew, dates are a parameter and record ids are
digests: the same rows give the same bytes. A file is written under a temporary name and moved when complete; a task that is
tried again replaces it by the same bytes. The manifest, written last by Spark's own committer, names the files with their sizes
and digests, and readers open no others.

Of records with equal payloads of at least `least_revisit` bytes the one with the largest page_id is a response and the others
revisit it: their payload isn't stored again.

Null html is an empty payload; null urls are written as urn:siderea:none. A null page_id counts as smaller than any other and its
header is left out. Rows that share page_id and payload are one record told twice: none of them revisits the other. Payloads may be
of any length that fits in memory. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siderea.llm.common import read_table, save, shared_dir, tune

SHARD_BYTES = 64 << 20
ROLL_BYTES = 32 << 20
MOST_SHARDS = 10_000  # larger archives have larger shards: the driver draws the bounds from some 32 rows a shard
LEAST_REVISIT = 1000
MOST_BROADCAST = 100_000  # rows of 48 bytes
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = -(1 << 63)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if urlparse(path).scheme else "file://" + path)


def base32(digest_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record_id(page_id: int | None, digest_hex: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest_hex}'.encode()).digest(), version=4)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest_hex: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest_hex)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'urn:siderea:none'}",
        f"WARC-Payload-Digest: {base32(digest_hex)}",
        f"WARC-Block-Digest: {base32(hashlib.sha1(block).hexdigest())}",
    ]
    if page_id is not None:
        head.append(f"Siderea-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest_hex)}", f"Siderea-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member without time or name
    return z.compress(data) + z.flush()


class Roll:
    """A shard's current file."""

    def __init__(self, folder: str, shard: int, date: str):
        self.fs, self.folder = filesystem(folder)
        self.shard, self.date, self.number = shard, date, -1
        self.out = None

    def open(self) -> None:
        self.number += 1
        self.name = f"part-{self.shard:06d}-{self.number:04d}.warc.gz"
        self.temporary = posixpath.join(self.folder, f"_temporary-{self.name}-{uuid.uuid4().hex}")
        self.out = self.fs.open_output_stream(self.temporary)
        self.size, self.records, self.sha = 0, 0, hashlib.sha256()
        body = b"software: siderea\r\nformat: WARC File Format 1.1\r\n"
        info = [f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, hashlib.sha1(self.name.encode()).hexdigest())}\r\nWARC-Date: {self.date}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode(), body, b"\r\n\r\n"]
        self._put(packed(b"".join(info)))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.open()
        self._put(packed(data))
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        final = posixpath.join(self.folder, self.name)
        try:
            self.fs.move(self.temporary, final)
        except OSError:  # a store that doesn't replace: an earlier try of this task left the same bytes
            self.fs.delete_file(final)
            self.fs.move(self.temporary, final)
        return self.shard, self.number, self.name, self.records, self.size, self.sha.hexdigest()


MANIFEST = "shard int, number int, file string, records long, bytes long, sha256 string"


def _bounds(keyed: DataFrame, shards: int, rows: int) -> list[tuple[str, int]]:
    """Quantiles, by bytes, of about 32 rows for each shard, chosen by hash."""
    if shards < 2:
        return []
    every = max(1, rows // (32 * shards))
    sample = sorted((r.u, r.p, r.b) for r in keyed.filter(F.pmod(F.xxhash64("u", "p"), F.lit(every)) == 0).select("u", "p", "b").collect())
    whole, sums, out = sum(b for *_, b in sample), 0, []
    for u, p, b in sample:
        while len(out) < shards - 1 and sums >= whole * (len(out) + 1) / shards > 0:
            out.append((u, p))
        sums += b
    return out


def roles(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with payload, digest and refers_to.

    Payloads that occur more than once are found from digests alone. They are broadcast if there are at most MOST_BROADCAST of them, so
    that html isn't shuffled for the join; more are joined by digest, where Spark splits a very common one.
    """
    told = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    many = told.filter(F.length("payload") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n")
    many = save(many, "repeated-payloads")
    joined = told.join(F.broadcast(many) if many.count() <= MOST_BROADCAST else many, "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))).drop("top")


def write_archive(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) to folder, which all executors must see, and return the manifest."""
    spark = tune(pages.sparkSession)
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    keyed = pages.select(F.coalesce("url", F.lit("")).alias("u"), F.coalesce("page_id", F.lit(LEAST)).alias("p"), F.length(F.coalesce("html", F.lit("")).cast("binary")).alias("b"))
    whole = keyed.agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect()[0]
    shards = min(MOST_SHARDS, max(1, -(-(whole.b or 0) // shard_bytes)))
    bounds = _bounds(keyed, shards, whole.n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(b.column("url").to_pylist(), b.column("page_id").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect.bisect_right(bounds, (u or "", LEAST if p is None else p)) for u, p in keys], pa.int32())], [*b.schema.names, "shard"])

    cols = roles(pages, least_revisit).select("page_id", "url", "payload", "digest", "refers_to")
    placed = cols.mapInArrow(place, "page_id long, url string, payload binary, digest string, refers_to long, shard int")
    dealt = placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.coalesce("url", F.lit("")), F.coalesce("page_id", F.lit(LEAST)), "digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, done = None, []
        for b in batches:
            for page_id, url, payload, digest, refers_to, shard in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if roll is None or roll.shard != shard:
                    if roll is not None and roll.out is not None:
                        done.append(roll.close())
                    roll = Roll(folder, shard, date)
                roll.add(record(page_id, url, payload, digest, refers_to, date))
                if roll.size >= roll_bytes:
                    done.append(roll.close())
        if roll is not None and roll.out is not None:
            done.append(roll.close())
        cols = list(zip(*done, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "number", "file", "records", "bytes", "sha256"])

    dealt.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
            data = data or stream.read(chunk)
        else:
            data = stream.read(chunk)
    if parts:
        raise ValueError("a record is cut short")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def told(data: bytes) -> tuple | None:
    """(page_id, url, bytes, digest, kind, refers_to, payload) of a record, its digests verified; None for warcinfo."""
    f, block = parsed(data)
    if f["WARC-Type"] == "warcinfo":
        return None
    if base32(hashlib.sha1(block).hexdigest()) != f["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs in {f['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = base64.b32decode(f["WARC-Payload-Digest"][5:]).hex()
    if f["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload digest differs in {f['WARC-Record-ID']}")
    page, refers = f.get("Siderea-Page-ID"), f.get("Siderea-Refers-To-Page-ID")
    return (None if page is None else int(page), f["WARC-Target-URI"], size, digest, f["WARC-Type"], None if refers is None else int(refers), payload if f["WARC-Type"] == "response" else None)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest names, each file streamed by one task."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        for b in batches:
            for name, records in zip(b.column("file").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                with fs.open_input_stream(posixpath.join(at, name), compression=None) as stream:
                    for m in members(stream):
                        if (t := told(m)) is not None:
                            rows.append(t[:6])
                            n += 1
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])
                            rows = []
                if n != records:
                    raise ValueError(f"{name} holds {n} records, the manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return manifest.repartition(max(1, manifest.count()), "file").mapInArrow(run, RECORDS)


def op5_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
