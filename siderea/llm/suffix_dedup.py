"""Substring deduplication over bytes by column-wise construction of suffix order and common prefixes.

The order of a collection's suffixes is built as the Burrows-Wheeler transform of many documents is: each round inserts one
symbol per string, from the right, and derives the new order and the new common prefix lengths from the last round's by one
stable sort and range minima. Over whole documents this takes as many rounds as the longest one has bytes, each over the
whole transform so far. Two steps bound it:

- Texts are first cut into pieces of windows that share a minimizer (siderea.llm.repeats), at most 2 * WINDOW bytes long. Equal
  windows always lie in pieces of one minimizer, aligned on it, so there are WINDOW + WINDOW - ANCHOR rounds whatever the text.
- As only suffixes of one column, counted from the minimizer, can share a window, a round keeps the transform of its own
  column (the positional form) and leaves the others behind: a round costs the number of pieces, not of suffixes.

A window whose common prefix with a neighbour in its column's order reaches WINDOW bytes occurs elsewhere. Comparing is exact;
hashes only choose anchors and name whole pieces (128 bits).

Null and empty texts have no windows. A row that repeats another in full is a copy: all windows of both occur elsewhere. Rows
that share a doc_id but not the text are different documents. Null doc_ids are kept. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from siderea.llm.common import read_table, row_key, tune
from siderea.llm.repeats import Powers, U, mix, repeated_spans

WINDOW = 200
ANCHOR = 48
CHUNK = 1 << 18  # bytes looked at at once; longer texts are cut, with overlap
POS = 21

_powers = Powers(0x9E3779B97F4A7C15)


def _chunks(texts: list[bytes], window: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, first byte of each part, row, offset in the row's text) of about CHUNK bytes each."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def made():
        at = np.cumsum([0, *(len(p[2]) for p in parts)])
        return b"".join(p[2] for p in parts), at, np.array([p[0] for p in parts]), np.array([p[1] for p in parts])

    for row, t in enumerate(texts):
        if len(t) < window:
            continue
        for lo in range(0, len(t) - window + 1, CHUNK):
            part = t[lo : lo + CHUNK + window - 1]
            if size and size + len(part) > CHUNK:
                yield made()
                parts, size = [], 0
            parts.append((row, lo, part))
            size += len(part)
    if parts:
        yield made()


def finder(window: int = WINDOW, anchor: int = ANCHOR):
    """Pieces of windows (window bytes) that share a minimizer (anchor bytes); see repeats.Finder."""
    span = window - anchor + 1  # anchors a window holds

    def find(texts: list[bytes]):
        for data, at, rows, bases in _chunks(texts, window):
            a = np.frombuffer(data, np.uint8)
            sums = _powers.sums(a)
            hashes = mix((sums[anchor:] - sums[:-anchor]) * _powers.to(len(sums))[1][: len(a) - anchor + 1])
            packed = (hashes & ~U((1 << POS) - 1)) | np.arange(len(hashes), dtype=U)  # the leftmost of equal ones
            full = np.full(-(-len(packed) // span) * span, ~U(0))
            full[: len(packed)] = packed
            full = full.reshape(-1, span)
            left = np.minimum.accumulate(full, axis=1).ravel()
            right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
            n = len(a) - window + 1
            pos = (np.minimum(right[:n], left[span - 1 : span - 1 + n]) & U((1 << POS) - 1)).astype(np.int64)
            part = np.searchsorted(at, np.arange(n), side="right") - 1
            inside = np.arange(n) + window <= at[part + 1]
            new = np.r_[True, (pos[1:] != pos[:-1]) | (part[1:] != part[:-1]) | (inside[1:] != inside[:-1])]
            begin = np.flatnonzero(new)
            end = np.r_[begin[1:], n]
            ok = inside[begin]
            begin, end = begin[ok], end[ok]
            p = part[begin]
            yield rows[p], bases[p] + begin - at[p], end - begin, pos[begin] - begin, hashes[pos[begin]].view(np.int64), lambda i, d=data, b=begin, e=end: d[b[i] : e[i] + window - 1]

    return find


def marker(window: int = WINDOW, anchor: int = ANCHOR):
    """Insert the pieces of groups column by column, from the right; see repeats.Marker and the module's text."""
    back = window - anchor  # columns before the anchor

    def mark(group: np.ndarray, off: np.ndarray, nw: np.ndarray, bodies: list[bytes]) -> np.ndarray:
        s, lens = len(bodies), np.array([len(b) for b in bodies])
        flat = np.frombuffer(b"".join(bodies), np.uint8)
        which = np.repeat(np.arange(s, dtype=np.int32), lens)
        col = (np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens + off - back, lens)).astype(np.int32)
        symbols = np.full((back + window, s), 256, np.uint16)
        symbols[col, which] = flat
        del which, col
        order, prefix, low = np.arange(s), np.zeros(s + 1, np.int16), np.int64((1 << 20) - 1)
        hits = np.zeros((back + 1, s), bool)
        base, place = group.astype(np.int64) << 10, np.arange(s, dtype=np.int64)
        for j in range(back + window - 1, -1, -1):
            key = ((base[order] | symbols[j, order]) << 20) | place
            key.sort()
            came = key & low
            same = (key[1:] >> 20 == key[:-1] >> 20) & ((key[1:] >> 20 & 1023) != 256)
            least = np.minimum.reduceat(prefix, came + 1)[:-1]
            prefix = np.zeros(s + 1, np.int16)
            prefix[1:-1] = np.where(same, np.minimum(least + 1, window), 0)
            order = order[came]
            if j <= back:
                hits[j, order[(prefix[1:] >= window) | (prefix[:-1] >= window)]] = True
        # windows by pieces: a piece's first window stands in column back - off
        w = np.arange(nw.max())[:, None] + (back - off)[None, :]
        return hits[np.minimum(w, back), np.arange(s)] & (np.arange(nw.max())[:, None] < nw)

    return mark


def window_digests(window: int = WINDOW):
    def digest(body: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(xxh3_128_digest(body[i : i + window]) for i in range(len(body) - window + 1)), "<u8").reshape(-1, 2)

    return digest


def repeated_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = 65536) -> DataFrame:
    """(doc_id, text, spans): every document with the byte spans (s, e) that are covered by a window occurring elsewhere,
    disjoint and sorted; empty if there are none."""
    spans = repeated_spans(docs, finder(window, anchor), marker(window, anchor), window_digests(window), window, hot)
    grown = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (x["e"] + (window - 1)).alias("e")))
    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    return keyed.join(spans.select("k1", "k2", grown.alias("spans")), ["k1", "k2"], "left").select("doc_id", "text", "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in spans or ():
        if out and x["s"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["e"]))
        else:
            out.append((x["s"], x["e"]))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """data without the spans."""
    keep, at = [], 0
    for s, e in spans:
        keep.append(data[at:s])
        at = e
    return b"".join([*keep, data[at:]])


def without_repeats(found: DataFrame) -> DataFrame:
    """Of repeated_bytes: doc_id, n_bytes, n_removed, n_spans, kept (binary, the bytes that stay), kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, x in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                s = merged(x)
                kept = cut(t or b"", s)
                rows.append((len(t or b""), len(t or b"") - len(kept), len(s), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(repeated_bytes(docs)).drop("kept")
