"""What the two substring operators share: from anchored pieces of text to the repeated spans of each document.

A finder cuts each document into pieces. A piece is a run of consecutive windows of one length that agree on an anchor,
chosen from a window's content alone; so equal windows always have equal anchors at equal distance from their start, and
only pieces of one anchor key need comparing, aligned at the anchor.

1. scan: count anchor keys (summed before the shuffle) and set a bit for each key seen twice or more, in a bitmap sized
   by their number. A key that the bitmap holds in error only costs a comparison.
2. scan: pieces whose key has its bit. Equal pieces collapse in each task; the text of a piece is sent once per task, and of
   pieces that a task meets again only the windows they cover, merged where they touch.
3. by key: a marker decides for each distinct piece which windows occur elsewhere. Keys with more than `hot` distinct
   pieces go by the digest of each window instead, which sums before it shuffles: no group is ever held whole.
4. marks go back to the occurrences of their piece, and to documents as merged spans.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from siderea.llm.common import row_key, save, tune

U = np.uint64
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 20, 29  # of the bitmap; the last two are powers of two: 128 kB to 64 MB
HELD_BYTES = 6 << 20  # of bodies that a task holds to send equal ones once
FLUSH_ROWS = 4000  # pieces compared at once
PIECES = "key long, c1 long, c2 long, n long, off int, nw int, body binary, k1 long, k2 long, start long, stop long"
MARKS = "key long, c1 long, c2 long, runs array<int>, off int, nw int, n long, body binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(32))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(29))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.multiply.accumulate(np.r_[U(1), np.full(size - 1, b, U)]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values.astype(U, copy=False) * self.to(len(values))[0], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The hash of values[lo:hi], wherever it stands."""
        return (sums[hi] - sums[lo]) * self.to(len(sums))[1][lo]


def in_bitmap(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    key, low = key.view(U), len(bits).bit_length() - 1
    return (bits[(key & U(len(bits) - 1)).astype(np.int64)] >> ((key >> U(low)) & U(63))) & U(1) == 1


def bitmap(keys: DataFrame) -> np.ndarray:
    """keys (key, n): a bit for each key whose n sum to 2 or more.

    BITS_A_KEY bits for each such key, between LEAST_BITS and MOST_BITS in all (a power of two); so at most 2^MOST_BITS bits come to the
    driver and go to each task. Beyond that more keys share a bit, which costs comparisons of pieces that occur once, never results.
    """
    twice = save(keys.groupBy("key").agg(F.sum("n").alias("n")).filter("n >= 2").select("key"), "keys-twice")
    low = min(MOST_BITS, max(LEAST_BITS, (BITS_A_KEY * twice.count()).bit_length())) - 6
    words = twice.groupBy(F.expr(f"key & {(1 << low) - 1}L").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(key, {low}) & 63L as int)))").alias("b"))
    out = np.zeros(1 << low, U)
    got = words.toArrow()
    if got.num_rows:
        out[got["w"].to_numpy()] = got["b"].to_numpy().view(U)
    return out


#: find(texts) yields chunks: (row, start, windows, anchor offset in the piece, key, and a function from a piece's index to its body).
Finder = Callable[[list[bytes]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[int], bytes]]]]
#: mark(group, off, nw, bodies) gives a boolean matrix, windows by pieces: does the window occur in another piece of its group?
Marker = Callable[[np.ndarray, np.ndarray, np.ndarray, list[bytes]], np.ndarray]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def count_keys(find: Finder) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, key, _ in find(_texts(b)):
                u, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.minimum(n, 2))], ["key", "n"])

    return run


class Held:
    """Distinct pieces of a task that wait to be sent: columns of numbers and one buffer of bodies."""

    def __init__(self):
        self.slot: dict[bytes, int] = {}
        self.key, self.n, self.off, self.nw, self.end, self.bodies = array("q"), array("q"), array("i"), array("i"), array("i", [0]), bytearray()

    def add(self, digest: bytes, key: int, off: int, nw: int, body: bytes) -> bool:
        """Whether the piece was there already."""
        at = self.slot.setdefault(digest, len(self.n))
        if at < len(self.n):
            self.n[at] += 1
            return True
        self.key.append(key)
        self.n.append(1)
        self.off.append(off)
        self.nw.append(nw)
        self.bodies += body
        self.end.append(len(self.bodies))
        return False

    def batch(self) -> pa.RecordBatch:
        cs = np.frombuffer(b"".join(self.slot), "<i8").reshape(-1, 2)
        body = pa.Array.from_buffers(pa.binary(), len(self.n), [None, pa.py_buffer(self.end.tobytes()), pa.py_buffer(bytes(self.bodies))])
        cols = (np.array(self.key), cs[:, 0], cs[:, 1], np.array(self.n), np.array(self.off), np.array(self.nw), body, None, None, None, None)
        return _piece_rows(cols, len(self.n))


_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _piece_rows(cols, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if x is None else pa.array(x, k) for x, k in zip(cols, _KINDS, strict=True)], _NAMES)


def touching(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans, in order of row and start, with those that touch or overlap made one."""
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > stop[:-1])])
    return row[first], start[first], np.maximum.reduceat(stop, first)


def cut_pieces(find: Finder, bits) -> Callable:
    """Rows of three kinds. Occurrences: k1, k2, start of a piece c1, c2. Pieces: for each distinct one in a task its body and how often it
    came. Spans: windows from start to stop (exclusive) of a document that are known to occur elsewhere, as the task has seen their
    piece before; touching ones are one row, so that a text of one repeated byte or word is a row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for b in batches:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for row, start, nw, off, key, body in find(_texts(b)):
                take = np.flatnonzero(in_bitmap(bits.value, key))
                for at in range(0, len(take), 4096):
                    some = take[at : at + 4096]
                    digests, again = [], np.zeros(len(some), bool)
                    for j, (i, k, o, w) in enumerate(zip(some.tolist(), key[some].tolist(), off[some].tolist(), nw[some].tolist(), strict=True)):
                        text = body(i)
                        digests.append(d := xxh3_128_digest(text))
                        again[j] = held.add(d, k, o, w, text)
                    cs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    new = some[~again]
                    if len(new):
                        yield _piece_rows((None, cs[~again, 0], cs[~again, 1], None, None, None, None, k1[row[new]], k2[row[new]], start[new], None), len(new))
                    if len(new) < len(some):
                        seen = some[again]
                        r, s, e = touching(row[seen], start[seen], start[seen] + nw[seen])
                        yield _piece_rows((None,) * 7 + (k1[r], k2[r], s, e), len(r))
                    if len(held.bodies) > HELD_BYTES:
                        yield held.batch()
                        held = Held()
        if held.slot:
            yield held.batch()

    return run


def runs_of(flags: np.ndarray) -> np.ndarray:
    """[begin, end, begin, end, ...] of the runs of True."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))


def mark_groups(mark: Marker, hot: int) -> Callable:
    """Rows sorted by key: marks for each distinct piece that has any; pieces of keys beyond hot come back with body, unmarked."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in MARKS.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names)

    def decide(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        distinct: list[list] = []
        for key, c1, c2, n, off, nw, body in rows:  # sorted by key, c1, c2
            if distinct and distinct[-1][:3] == [key, c1, c2]:
                distinct[-1][3] += n
            else:
                distinct.append([key, c1, c2, n, off, nw, body])
        keys = np.array([x[0] for x in distinct])
        group = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
        many = np.bincount(group)[group] > 1
        got: list[tuple] = [(k, c1, c2, [0, nw], None, None, None, None) for k, c1, c2, n, _, nw, _ in distinct if n > 1]
        at = np.flatnonzero(many)
        if len(at):
            sub = [distinct[i] for i in at.tolist()]
            g = np.unique(group[at], return_inverse=True)[1]
            flags = mark(g, np.array([x[4] for x in sub]), np.array([x[5] for x in sub]), [x[6] for x in sub])
            for j in np.flatnonzero(flags.any(axis=0)).tolist():
                if sub[j][3] == 1:
                    got.append((*sub[j][:3], runs_of(flags[: sub[j][5], j]).tolist(), None, None, None, None))
        if got:
            yield out(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        over = None
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("key", "c1", "c2", "n", "off", "nw", "body")), strict=True))
            if over is not None:
                k = next((i for i, r in enumerate(rows) if r[0] != over), len(rows))
                if k:
                    yield out([(r[0], r[1], r[2], None, r[4], r[5], r[3], r[6]) for r in rows[:k]])
                rows = rows[k:]
                if rows:
                    over = None
            held += rows
            if len(held) >= FLUSH_ROWS:
                last = held[-1][0]
                cut = len(held)
                while cut and held[cut - 1][0] == last:
                    cut -= 1
                if cut:
                    yield from decide(held[:cut])
                    held = held[cut:]
                if len(held) > hot:
                    over = last
                    yield out([(r[0], r[1], r[2], None, r[4], r[5], r[3], r[6]) for r in held])
                    held = []
        if held:
            yield from decide(held)

    return run


def _mark_hot(rows: DataFrame, digest: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Pieces of very common anchors, by the digests of their windows; digest gives an array (windows, 2) for a body."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c1, c2, n, body in zip(*(b.column(c).to_pylist() for c in ("c1", "c2", "n", "body")), strict=True):
                h = digest(body)
                k = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), pa.array(np.full(k, c1)), pa.array(np.full(k, c2)), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, n))], ["h1", "h2", "c1", "c2", "w", "n"])

    pieces = rows.groupBy("key", "c1", "c2").agg(F.sum("n").alias("n"), F.max("body").alias("body"))
    windows = save(pieces.mapInArrow(explode, "h1 long, h2 long, c1 long, c2 long, w int, n long"), "hot-windows")
    twice = windows.groupBy("h1", "h2").agg(F.sum("n").alias("m")).filter("m > 1").drop("m")
    back = windows.join(twice, ["h1", "h2"]).groupBy("c1", "c2").agg(F.array_sort(F.collect_set("w")).alias("ws"))
    return back.select("c1", "c2", F.expr("flatten(transform(ws, w -> array(w, w + 1)))").alias("runs"))


def repeated_spans(docs: DataFrame, find: Finder, mark: Marker, digest: Callable[[bytes], np.ndarray], window: int, hot: int = 65536) -> DataFrame:
    """(k1, k2, spans): for each document (doc_id, text) with a repeated window, the sorted runs of window starts as
    array<struct<s, e>>, e exclusive; they may overlap or touch. k1, k2 are row_key("doc_id", "text")."""
    spark = tune(docs.sparkSession, 1 << 20)
    keyed = docs.select("text", *row_key("doc_id", "text"))
    bits = spark.sparkContext.broadcast(bitmap(keyed.select("text").mapInArrow(count_keys(find), "key long, n long")))
    pieces = save(keyed.mapInArrow(cut_pieces(find, bits), PIECES), "pieces")
    bits.destroy()
    bodies = pieces.filter("body is not null").select("key", "c1", "c2", "n", "off", "nw", "body")
    marks = save(bodies.repartition("key").sortWithinPartitions("key", "c1", "c2").mapInArrow(mark_groups(mark, hot), MARKS), "marks")
    found = marks.filter("runs is not null").select("c1", "c2", "runs")
    over = marks.filter("body is not null")
    if not over.isEmpty():
        found = found.unionByName(_mark_hot(over, digest))
    spots = pieces.filter("c1 is not null and start is not null").select("c1", "c2", "k1", "k2", "start").join(found, ["c1", "c2"])
    spans = F.expr("transform(sequence(0, size(runs) div 2 - 1), i -> struct(start + runs[2 * i] as s, start + runs[2 * i + 1] as e))")
    known = pieces.filter("stop is not null").select("k1", "k2", F.struct(F.col("start").alias("s"), F.col("stop").alias("e")).alias("x"))
    return spots.select("k1", "k2", F.explode(spans).alias("x")).union(known).groupBy("k1", "k2").agg(F.array_sort(F.collect_list("x")).alias("spans"))
