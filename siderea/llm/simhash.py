"""Near-duplicate groups by SimHash, linked through a positional byte index with count filtering.

A fingerprint is eight bytes at eight positions. Two that differ in at most `bits` bits (2) share at least 8 - 2 positional bytes.
The index posts a fingerprint under its positional bytes, taken four at a time (two of the four byte pairs: six lists), as lists
of single bytes would hold 1/256 of all fingerprints each and the tally would be quadratic; of six shared bytes at least one
such four is whole, so no link is lost. In a list the shared positional bytes are tallied per pair, pairs with fewer than six are
dropped, and the rest are verified bit by bit.

Copies never meet as pairs: only different fingerprints are indexed. A list of more than `hot` fingerprints is indexed again by
six bytes (the four and two of the other four); such lists hold at most 65,536 fingerprints, and above a small size their
links are found by flipping up to two of the sixteen free bits. Each list yields a spanning forest of its links.

Null and empty texts have no shingles and fingerprint zero. Rows that repeat a doc_id are documents of their own with that id; a
null doc_id never names a component unless all of its ids are null, when component_id is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siderea.llm.common import SPACE, read_table, save, tune
from siderea.llm.components import components, spanning

SHINGLE = 3
SEED = 42
HOT = 8192
_BREAKS = bytes.maketrans(SPACE, b" " * len(SPACE))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = [w for w in text.lower().translate(_BREAKS).split(b" ") if w]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    n = max(1, len(words) - shingle + 1)
    stops = (ends - 1)[-n:].tolist() if len(words) >= shingle else [len(line)]
    return majority(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n], stops, strict=True)), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps.view(np.int64))], [*keep, "fp"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select("text", *keep).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "fp long"]))


def verified(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Count filter, then bits: which pairs share at least 8 - bits positional bytes and differ in at most `bits` bits."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= 8 - bits
    ok[ok] = np.bitwise_count(x[ok]) <= bits
    return ok


def _pairs_in_lists(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = [], []
    at, d = np.arange(len(key)), 1
    while len(at):
        at = at[at + d < len(key)]
        at = at[key[at + d] == key[at]]
        ok = at[verified(fp[at], fp[at + d], bits)] if len(at) else at
        left.append(fp[ok])
        right.append(fp[ok + d])
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _flips(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in a list of distinct fingerprints that agree in six bytes: the others are found by flipping free bits."""
    free = np.flatnonzero([(int(np.bitwise_or.reduce(fp ^ fp[0])) >> i) & 1 for i in range(64)])
    masks = [sum(1 << int(i) for i in c) for k in range(1, bits + 1) for c in combinations(free, k)]
    s, left, right = np.sort(fp), [], []
    for m in masks:
        t = s ^ np.uint64(m)
        i = np.minimum(np.searchsorted(s, t), len(s) - 1)
        ok = (s[i] == t) & (s < t)
        left.append(s[ok])
        right.append(t[ok])
    return np.concatenate(left), np.concatenate(right)


def link_lists(bits: int, hot: int, last: bool):
    """Rows (key, fp) sorted by both: links (a, b) of each list; lists beyond hot come back as (a = fp, b null, key), unless last."""

    def out(a, b, key=None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b if b is not None else [None] * n, pa.int64()), pa.array(key if key is not None else [None] * n, pa.int64())], ["a", "b", "key"])

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        big = sizes > hot
        found = []
        small = ~np.repeat(big, sizes)
        found.append(_pairs_in_lists(key[small], fp[small], bits))
        for s, n in zip(starts[big].tolist(), sizes[big].tolist(), strict=True):
            if last:
                found.append(_flips(fp[s : s + n], bits))
            else:
                yield out(fp[s : s + n].view(np.int64), None, key[s : s + n])
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        if len(a):
            yield out(*spanning(a.view(np.int64).tolist(), b.view(np.int64).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        over = None
        for b in batches:
            k, f = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            if over is not None:  # the rest of a list that was too long
                n = int(np.searchsorted(k != over, True)) if (k != over).any() else len(k)
                if n:
                    yield out(f[:n].view(np.int64), None, k[:n])
                k, f = k[n:], f[n:]
                if len(k):
                    over = None
            key, fp = np.r_[key, k], np.r_[fp, f]
            if len(key) < 20_000:
                continue
            cut = int(np.argmax(key == key[-1]))
            if cut:
                yield from links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
            if len(key) > hot and not last:
                over = int(key[-1])
                yield out(fp.view(np.int64), None, key)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from links(key, fp)

    return run


def _byte(i: int) -> str:
    return f"(shiftrightunsigned(fp, {8 * i}) & 255L)"


def _key(tag: int, which: tuple[int, ...]) -> str:
    return f"({tag}L * {1 << 8 * len(which)}L + " + " + ".join(f"{_byte(b)} * {1 << 8 * j}L" for j, b in enumerate(which)) + ")"


#: Each list's key: two of four byte pairs.
FOURS = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(4), 2)]


def similar(fps: DataFrame, bits: int = 2, hot: int = HOT) -> DataFrame:
    """Links (a, b) that join all fingerprints (fp, distinct) differing in at most `bits` bits into the right components."""
    if bits > 2:
        raise ValueError("lists of four positional bytes are complete for 2 bits at most")
    posts = fps.select("fp", F.explode(F.array(*[F.expr(_key(t, c)) for t, c in enumerate(FOURS)])).alias("key"))
    found = save(posts.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(link_lists(bits, hot, False), "a long, b long, key long"), "simhash-lists")
    links = found.filter("b is not null").select("a", "b")
    over = found.filter("key is not null").select(F.col("a").alias("fp"), F.expr(f"cast(shiftrightunsigned(key, 32) as int)").alias("t"))
    if not over.isEmpty():
        sixes = [[tuple(sorted((*c, *more))) for more in combinations([b for b in range(8) if b not in c], 2)] for c in FOURS]
        every = sorted({s for six in sixes for s in six})
        keys = F.array(*[F.array(*[F.expr(_key(every.index(s), s)) for s in six]) for six in sixes])
        again = over.select("fp", F.explode(F.get(keys, F.col("t"))).alias("key")).distinct()
        more = again.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(link_lists(bits, 512, True), "a long, b long, key long")
        links = links.union(more.select("a", "b"))
    return links


def groups(docs: DataFrame, bits: int = 2, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) for each document."""
    tune(docs.sparkSession)
    prints = save(fingerprints(docs, shingle), "fingerprints")
    least = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(similar(least.select("fp"), bits, hot)).withColumnRenamed("node", "fp")
    rooted = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
