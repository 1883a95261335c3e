"""Line deduplication by range-partitioned, doubly sorted line hashes that yields keep bitmaps.

Each document sends one row per distinct line key (128-bit hash) with the positions of its lines. Rows are range-partitioned by
hash, then document (largest first), so a very common line spreads over several partitions, and sorted in them likewise. A task
streams its rows: the first document of a hash is the one that keeps its lines, and at the third the others are known to lose
theirs; until then rows of two documents wait, MOST_HELD at most. Rows beyond that, and those of the first and the last hash of a
partition, of which more may lie elsewhere, are set aside undecided and decided together by a join.

A document's decisions return as a zlib-compressed bitmap of the lines to keep (bit i % 8, from the lowest, of byte i // 8);
text never travels with the lines.

Null and empty texts are one empty line. Documents are told apart by doc_id: rows that share one count once, all rows of the
largest doc_id keep their lines, and a null doc_id counts as one id smaller than all others. Other columns are not read.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from xxhash import xxh3_128_digest

from siderea.llm.common import SPACE, read_table, row_key, save, tune

LEAST = -(1 << 63)
MOST_HELD = 1000  # rows that a task holds until it knows what becomes of them
LINES = "h1 long, h2 long, doc long, k1 long, k2 long, n int, pos binary"


def _rows(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_NAMES = ["h1", "h2", "doc", "k1", "k2", "n", "pos"]


def line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text, doc, k1, k2 in zip(b.column("text").cast(pa.binary()).to_pylist(), *(b.column(c).to_pylist() for c in ("doc_id", "k1", "k2")), strict=True):
                at: dict[bytes, list[int]] = {}
                lines = (text or b"").split(b"\n")
                for i, line in enumerate(lines):
                    if len(line) >= min_chars:
                        key = line.strip(SPACE).lower()  # bytes.lower changes A-Z alone
                        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                            at.setdefault(xxh3_128_digest(key), []).append(i)
                for h, pos in at.items():
                    rows.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), LEAST if doc is None else doc, k1, k2, len(lines), np.array(pos, "<i4").tobytes()))
                if len(rows) > 20_000:
                    yield _rows(rows, _KINDS, _NAMES)
                    rows = []
            yield _rows(rows, _KINDS, _NAMES)

    return run


def decide(min_docs: int):
    """Sorted rows: those that lose their lines (seen null), and those that this partition can't decide (seen: documents of the
    hash here, min_docs at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, held, docs, first, opened, told = None, [], [], True, True, False  # the current hash, rows that wait, their documents

        def set_aside() -> None:
            out.extend((*x, len(docs)) for x in held)
            held.clear()

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            return zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True)

        for b in batches:
            for r in rows(b):
                if r[:2] != now:
                    if now is not None:
                        if opened:
                            set_aside()
                        first = False
                    now, docs, opened, told = r[:2], [], first, False
                    held.clear()
                if not docs or docs[-1] != r[2]:
                    if len(docs) < min_docs:
                        docs.append(r[2])
                    if len(docs) == min_docs:  # all but the first document's rows are decided
                        out.extend((*x, None) for x in held if x[2] != docs[0])
                        held[:] = [x for x in held if x[2] == docs[0]]
                if len(docs) == min_docs and r[2] != docs[0]:
                    # of a hash with rows set aside one tells that there are enough documents
                    out.append((*r, min_docs if opened and not told else None))
                    told = told or opened
                    docs[-1] = r[2]
                elif first or r[2] != docs[0] or not held:  # of the document that keeps its lines one row is enough
                    if first or r[2] != docs[0] or not opened:
                        held.append(r)
                    if len(held) > MOST_HELD:
                        opened = True
                        set_aside()
                if len(out) > 20_000:
                    yield _rows(out, [*_KINDS, pa.int32()], [*_NAMES, "seen"])
                    out.clear()
            yield _rows(out, [*_KINDS, pa.int32()], [*_NAMES, "seen"])
            out.clear()
        set_aside()
        yield _rows(out, [*_KINDS, pa.int32()], [*_NAMES, "seen"])

    return run


def keep_bitmap(n: int, dropped: list[bytes]) -> bytes:
    keep = np.ones(n, bool)
    for p in dropped:
        keep[np.frombuffer(p, "<i4")] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(k1, k2, n_lines, keep): for each document (doc_id, text) that loses lines, the compressed bitmap of those that stay.
    k1, k2 are row_key("doc_id", "text")."""
    tune(docs.sparkSession)
    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    order = [F.col("h1"), F.col("h2"), F.desc("doc"), F.col("k1"), F.col("k2")]
    lines = save(keyed.mapInArrow(line_rows(min_chars), LINES), "lines")  # the range bounds are drawn from it before it is dealt out
    told = save(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(decide(min_docs), LINES + ", seen int"), "line-decisions")
    # a few rows for each partition
    open_rows = told.filter("seen is not null")
    facts = open_rows.groupBy("h1", "h2").agg(F.max("doc").alias("top"), F.max("seen").alias("most"), F.count_distinct("doc").alias("docs"))
    late = open_rows.join(facts, ["h1", "h2"]).filter((F.greatest("most", "docs") >= min_docs) & (F.col("doc") < F.col("top")))
    drops = told.filter("seen is null").select("k1", "k2", "n", "pos").union(late.select("k1", "k2", "n", "pos"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [keep_bitmap(n, p) for n, p in zip(b.column("n").to_pylist(), b.column("ps").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("n").cast(pa.int64()), pa.array(keep, pa.binary())], ["k1", "k2", "n_lines", "keep"])

    return drops.groupBy("k1", "k2").agg(F.max("n").alias("n"), F.collect_list("pos").alias("ps")).mapInArrow(pack, "k1 long, k2 long, n_lines long, keep binary")


def apply_bitmap(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """Lines, lines dropped, and the text that stays."""
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), 0, text
    stay = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little").tolist()
    kept = [x for x, k in zip(lines, stay, strict=True) if k]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


@F.pandas_udf(StringType())
def kept_text(texts: pd.Series, keep: pd.Series) -> pd.Series:
    """The text that a bitmap leaves; the text itself where there is none."""
    return pd.Series([t if k is None else apply_bitmap((t or "").encode(), k)[2].decode() for t, k in zip(texts, keep, strict=True)], dtype="object")


def without_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept, kept_sha256) for each document; kept is the text that stays, "" for a null one."""
    found = bitmaps(docs, min_chars, min_docs)
    joined = docs.select("doc_id", "text", *row_key("doc_id", "text")).join(found.select("k1", "k2", "keep"), ["k1", "k2"], "left").select("doc_id", "text", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [apply_bitmap(t or b"", k) for t, k in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("keep").to_pylist(), strict=True)]
            rows = [(n, d, kept.decode(), hashlib.sha256(kept).hexdigest()) for n, d, kept in got]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "text", "n_lines", "n_dropped", "kept", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long, kept string, kept_sha256 string")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")
