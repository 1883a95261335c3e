"""Substring deduplication over words by recompression.

Each document is a string of word names. A round first names runs of one name, then pairs of a left and a right name, where a
hash bit of the name, new each round, says which side it is on. A name is the hash of what it stands for, so that equal
strings have equal names in all documents without a table of names: the global naming that the method does between rounds
needs no exchange here, and a round is a narrow map. ROUNDS rounds give symbols of up to 2 ** ROUNDS words.

Inside equal substrings equal symbols arise, but for those near the ends. For each symbol the words that its making looked at
are kept (its context, `lo` to `hi`); a window of WINDOW words that holds the whole context must hold the same symbol at the
same place wherever its words occur. Of those symbols a window takes the one with the most words, then the largest name, then
the leftmost, as its anchor. Windows with the same anchor form a piece, keyed by the words of the anchor's context; windows
that hold no whole context are keyed by all their words. Shared keys reveal the repeats, and siderea.llm.repeats verifies them,
window by window, aligned on the anchor. Words are compared by 64-bit hashes, windows by 128 bits made of those.

Null and empty texts have no words. Copies of a row, shared doc_ids, nulls and other columns: as in suffix_dedup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from siderea.llm.common import SPACE, read_table, row_key, tune
from siderea.llm.repeats import Powers, U, mix, repeated_spans
from siderea.llm.suffix_dedup import merged

WINDOW = 35
ROUNDS = 3
FAR = 1 << 40
CHUNK = 30_000  # words looked at at once
_BREAKS = bytes.maketrans(SPACE, b" " * len(SPACE))

_one, _two = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)


def words(text: bytes) -> list[bytes]:
    return [w for w in text.translate(_BREAKS).split(b" ") if w]


def parse(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Recompress the words of documents (doc: which one, ascending): each symbol's name, first word, words, context lo and hi.

    Runs and pairs are only named up to 2 ** round words; a longer run stays as its parts, so that contexts stay short.
    """
    n = len(names)
    name, start, size = names.copy(), np.arange(n), np.ones(n, np.int64)
    lo, hi, doc = np.arange(n), np.arange(1, n + 1), doc.copy()
    for r in range(1, rounds + 1):
        most = 1 << r
        # runs: up to `most` words are named; what lies around was looked at to see where the run ends
        n = len(name)
        if n < 2:
            break
        new = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], n] - 1
        length = last - first + 1
        whole = size[first] * length
        run = np.repeat((length > 1) & (whole <= most), length)
        inner = np.repeat(length, length)
        # a lone symbol looked at its neighbours; one of a run looked as far as `most` words or to the run's end and beyond
        reach = np.minimum(inner, most // np.maximum(size, 1) + 1)
        i = np.arange(n)
        a = np.maximum(i - reach, np.repeat(first, length) - 1)
        b = np.minimum(i + reach, np.repeat(last, length) + 1)
        alo = np.where((a < 0) | (doc[a] != doc), -FAR, lo[a])  # no window holds the end of a text
        bhi = np.where((b >= n) | (doc[np.minimum(b, n - 1)] != doc), FAR, hi[np.minimum(b, n - 1)])
        lo, hi = np.minimum(lo, alo), np.maximum(hi, bhi)
        head = ~run | new
        at = np.flatnonzero(head)
        end = np.r_[at[1:], n] - 1
        count = end - at + 1
        name = np.where(run[at], mix(name[at] * U(0x9FB21C651E98DF25) + count.astype(U)), name[at])
        size, start, lo, hi, doc = size[at] * count, start[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), doc[at]
        # pairs
        n = len(name)
        if n < 2:
            break
        side = (mix(name + U(r * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) >> U(40)) & U(1) == 1
        pair = np.r_[~side[:-1] & side[1:] & (doc[1:] == doc[:-1]) & (size[1:] + size[:-1] <= most), False]
        second = np.r_[False, pair[:-1]]
        after = np.r_[np.where(doc[1:] == doc[:-1], hi[1:], FAR), FAR]
        before = np.r_[-FAR, np.where(doc[1:] == doc[:-1], lo[:-1], -FAR)]
        alone = ~pair & ~second
        nlo = np.where(alone & side, np.minimum(lo, before), lo)  # a right one looked at what stands before it, a left one behind
        nhi = np.where(alone & ~side, np.maximum(hi, after), hi)
        k = np.flatnonzero(pair)
        nlo[k], nhi[k] = np.minimum(lo[k], lo[k + 1]), np.maximum(hi[k], hi[k + 1])
        named, sized = name.copy(), size.copy()
        named[k] = mix(name[k] * U(0xA0761D6478BD642F) + mix(name[k + 1] + U(0xE7037ED1A0B428DB)))
        sized[k] = size[k] + size[k + 1]
        at = np.flatnonzero(~second)
        name, size, start, lo, hi, doc = named[at], sized[at], start[at], nlo[at], nhi[at], doc[at]
    return name, start, size, lo, hi


def _chunks(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(word hashes, part of each word, row and first word of each part): about CHUNK words each, long texts in parts that overlap."""
    parts: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def made():
        n = [len(p[2]) for p in parts]
        return np.concatenate([p[2] for p in parts]), np.repeat(np.arange(len(parts)), n), np.array([p[0] for p in parts]), np.array([p[1] for p in parts])

    for row, t in enumerate(texts):
        ws = words(t)
        if len(ws) < window:
            continue
        h = np.fromiter(map(xxh3_64_intdigest, ws), U, len(ws))
        for a in range(0, len(h) - window + 1, CHUNK):
            p = h[a : a + CHUNK + window - 1]
            if size and size + len(p) > CHUNK:
                yield made()
                parts, size = [], 0
            parts.append((row, a, p))
            size += len(p)
    if parts:
        yield made()


def finder(window: int = WINDOW, rounds: int = ROUNDS):
    def find(texts: list[bytes]):
        for h, part, rows, bases in _chunks(texts, window):
            n = len(h) - window + 1
            if n < 1:
                continue
            name, start, size, lo, hi = parse(h, part, rounds)
            # by first word of a symbol: rank (words, then name, then leftmost), context
            rank = np.zeros(len(h) + window, np.int64)
            clo, chi = np.full(len(h) + window, -1), np.full(len(h) + window, 1 << 40)
            rank[start] = (size << 57) | ((name >> U(32)).astype(np.int64) << 25) | ((1 << 25) - 1 - start)
            clo[start], chi[start] = lo, hi
            best, first = np.zeros(n, np.int64), np.arange(n)
            for d in range(window):
                seen = (clo[d : d + n] >= first) & (chi[d : d + n] <= first + window)
                np.maximum(best, np.where(seen, rank[d : d + n], 0), out=best)
            none = best == 0
            pos = np.where(none, first, (1 << 25) - 1 - (best & ((1 << 25) - 1)))
            inside = part[:n] == part[window - 1 : window - 1 + n]
            new = np.r_[True, (pos[1:] != pos[:-1]) | (part[1:n] != part[: n - 1]) | (inside[1:] != inside[:-1]) | none[1:] | none[:-1]]
            begin = np.flatnonzero(new)
            end = np.r_[begin[1:], n]
            ok = inside[begin]
            begin, end = begin[ok], end[ok]
            at, lone = pos[begin], none[begin]
            a, b = np.where(lone, begin, clo[at]), np.where(lone, begin + window, np.minimum(chi[at], len(h)))
            key = mix(_one.ranges(_one.sums(h), a, b) + (b - a).astype(U) + lone.astype(U) * U(0x8EBC6AF09C88C6E3))
            p = part[begin]
            first_of = np.searchsorted(part, np.arange(len(rows)))
            yield rows[p], bases[p] + begin - first_of[p], end - begin, at - begin, key.view(np.int64), lambda i, h=h, b=begin, e=end: h[b[i] : e[i] + window - 1].tobytes()

    return find


def window_digests(window: int = WINDOW):
    def digest(body: bytes) -> np.ndarray:
        h = np.frombuffer(body, U)
        lo = np.arange(len(h) - window + 1)
        return np.stack([mix(p.ranges(p.sums(h), lo, lo + window)) for p in (_one, _two)], axis=1)

    return digest


def marker(window: int = WINDOW):
    """Windows of one group at one distance from the anchor are compared by their words; see repeats.Marker."""

    def mark(group: np.ndarray, off: np.ndarray, nw: np.ndarray, bodies: list[bytes]) -> np.ndarray:
        h = np.frombuffer(b"".join(bodies), U)
        which = np.repeat(np.arange(len(bodies)), nw)
        w = np.arange(len(which)) - np.repeat(np.cumsum(nw) - nw, nw)
        lo = w + np.repeat(np.cumsum(nw + window - 1) - (nw + window - 1), nw)
        d1, d2 = (mix(p.ranges(p.sums(h), lo, lo + window)) for p in (_one, _two))
        # the anchor's distance is told by where the window stands; equal words at another distance can't share an anchor
        place = mix(d1 + (group[which] * 4096 + (off[which] - w) + 64).astype(U) * U(0x8EBC6AF09C88C6E3))
        by = np.lexsort((d2, place))
        same = (place[by][1:] == place[by][:-1]) & (d2[by][1:] == d2[by][:-1])
        hit = np.zeros(len(which), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        out = np.zeros((nw.max(), len(bodies)), bool)
        out[w[hit], which[hit]] = True
        return out

    return mark


def repeated_words(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, hot: int = 65536) -> DataFrame:
    """(doc_id, text, spans): every document with the spans of words (s, e) covered by a window occurring elsewhere."""
    spans = repeated_spans(docs, finder(window, rounds), marker(window), window_digests(window), window, hot)
    grown = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (x["e"] + (window - 1)).alias("e")))
    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    return keyed.join(spans.select("k1", "k2", grown.alias("spans")), ["k1", "k2"], "left").select("doc_id", "text", "spans")


def without_repeats(found: DataFrame) -> DataFrame:
    """Of repeated_words: doc_id, n_words, n_removed, kept (the words that stay, joined by a space), kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, x in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                ws = words(t or b"")
                kept, at = [], 0
                for s, e in merged(x):
                    kept += ws[at:s]
                    at = e
                kept += ws[at:]
                text = b" ".join(kept)
                rows.append((len(ws), len(ws) - len(kept), text.decode(), hashlib.sha256(text).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(repeated_words(docs)).drop("kept")
