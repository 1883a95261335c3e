"""Near-duplicate groups at a lower similarity: exact Jaccard of five-word shingles.

Two documents are linked if their sets of five-word shingles have a Jaccard similarity of at least 0.8; groups are the connected
components of the links. Links come in two steps; each is verified by the sets themselves, so no unverified pair ever joins a group.

1. SimHash fingerprints of the sets go through the positional byte index of siderea.llm.simhash. Its links and equal fingerprints are
   proposals. This joins the nearest copies, large groups of them too, by one proposal for each.
2. Of a SimHash's bits pairs at 0.8 differ in 15 % or, if short, in more, so no bound on bits finds them all. Step 2 does:
   sets are kept in one order, shingles that are common in a sample of documents last; the order changes the work, never the result.
   Linked sets of sizes x and y share ceil(4 (x + y) / 9) shingles, so their first one fifth (and one more) have a shingle in common:
   each set is posted under those, and a list holds the sets posted under one shingle. Shingles that stand in one prefix only are left
   out first, by a bitmap (siderea.llm.repeats). Sizes and places rule out pairs that can't reach the similarity, and lists whose sets
   step 1 has joined are done; no other pair is left out. Lists of up to ALL give all their pairs. Longer ones get the sets, and one
   task joins what it has verified; lists of more than `hot` are dealt into blocks and every two blocks meet.

Before sets travel, counts do: how many shingles of a set fall into each of some buckets, about three a bucket. Two sets share no more
than the sum of the lesser counts, so pairs below the similarity by that bound go unseen, and members of a list without a partner.

Equal sets (all copies among them) are one node. Texts of fewer than five words are one shingle. Null texts and texts without words
resemble nothing and are left out. Rows that repeat a doc_id are told apart by k1, k2; null doc_ids are kept. Shingles are told apart by
48 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siderea.llm.common import SPACE, save, tune
from siderea.llm.components import components
from siderea.llm.repeats import bitmap, in_bitmap
from siderea.llm.simhash import majority, similar

SHINGLE = 5
ALL = 8
HOT = 1024
SAMPLE = 20_000  # documents whose shingles tell which are common
COMMON = 5
MOST_COMMON = 200_000
FEW = 500_000  # rows of three longs that are broadcast at most
SEED = 42
_BREAKS = bytes.maketrans(SPACE, b" " * len(SPACE))


def hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray | None:
    """64-bit hashes of the shingles, None without words."""
    words = [w for w in text.lower().translate(_BREAKS).split(b" ") if w]
    if not words:
        return None
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    n = max(1, len(words) - shingle + 1)
    stops = (ends - 1)[-n:].tolist() if len(words) >= shingle else [len(line)]
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n], stops, strict=True)), np.uint64, n)


def set_of(h: np.ndarray) -> np.ndarray:
    """Sorted, of 48 bits each."""
    return np.unique(h >> np.uint64(16)).astype(np.int64)


def shingles(text: bytes) -> np.ndarray | None:
    h = hashes(text)
    return None if h is None else set_of(h)


def packed(h: np.ndarray) -> bytes:
    """Six bytes for each shingle."""
    return h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


def counts(h: np.ndarray) -> bytes:
    """How many shingles fall into each of 2^k buckets, about three in each; by their lowest bits, so that counts can be folded."""
    n = max(8, 1 << (-(-len(h) // 4) - 1).bit_length())
    return np.minimum(np.bincount(h & (n - 1), minlength=n), 255).astype(np.uint8).tobytes()


def folded(c: np.ndarray) -> np.ndarray:
    """Counts (in rows) of half as many buckets."""
    half = c.shape[-1] // 2
    return c[..., :half].astype(np.uint16) + c[..., half:]


def most_shared(a: np.ndarray, b: np.ndarray) -> int:
    while len(a) > len(b):
        a = folded(a)
    while len(b) > len(a):
        b = folded(b)
    return int(np.minimum(a, b).sum(dtype=np.int64))


def like(inter, x, y):
    """Jaccard similarity of at least 0.8, in whole numbers."""
    return 9 * inter >= 4 * (x + y)


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of h in the order: common shingles last, the most common at the end."""
    rank = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[at] == h, counts[at], 0)
    return h[np.lexsort((h, rank))][: len(h) - (4 * len(h) + 4) // 5 + 1]


def can_meet(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of sizes x and y whose first shared shingle stands at i and j can be alike."""
    return like(np.minimum(x - i, y - j), x, y)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) of at least COMMON documents of a sample, with their counts."""
    part = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [h for t in b.column("text").cast(pa.binary()).to_pylist() if (h := shingles(t or b"")) is not None]
            h, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    some = docs.filter(F.pmod("k1", F.lit(part)) == 0).select("text").mapInArrow(run, "h long, n long")
    got = some.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = got["h"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prints_of(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, k1, k2, id (of the set), fp (its fingerprint), size, prefix and counts of the documents (doc_id, text, k1, k2) that have words."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [hashes(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
            take = b.take(pa.array([i for i, h in enumerate(hs) if h is not None], pa.int64()))
            hs = [np.unique(h) for h in hs if h is not None]
            fps = np.array([majority(h) for h in hs], np.uint64).view(np.int64)
            sets = [set_of(h) for h in hs]
            ids = np.array([xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(take.column(c) for c in ("doc_id", "k1", "k2")), pa.array(ids), pa.array(fps), pa.array([len(h) for h in sets], pa.int64()), pa.array([packed(prefix(h, *sent.value)) for h in sets], pa.binary()), pa.array([counts(h) for h in sets], pa.binary())], ["doc_id", "k1", "k2", "id", "fp", "size", "prefix", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = save(docs.select("doc_id", "text", "k1", "k2").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, id long, fp long, size long, prefix binary, counts binary"), "prints")
    sent.destroy()
    return out


def prefix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, n = np.unique(np.concatenate([*(unpacked(x) for x in b.column("prefix").to_pylist()), np.zeros(0, np.int64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])


def posts(nodes: DataFrame, bits) -> DataFrame:
    """A row (key, id, place, label) for each shingle of a prefix (id, size, prefix, label) that has its bit; place holds size and position.
    Label is 0 where it is the id: longs of zeros cost a shuffle little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [unpacked(x) for x in b.column("prefix").to_pylist()]
            n = np.array([len(k) for k in keys], np.int64)
            key = np.concatenate([*keys, np.zeros(0, np.int64)])
            pos = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            ok = in_bitmap(bits.value, key)
            ids, size, label = (np.repeat(b.column(c).to_numpy(), n)[ok] for c in ("id", "size", "label"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[ok], ids, size << 32 | pos[ok], label)], ["key", "id", "place", "label"])

    return nodes.select("id", "size", "prefix", "label").mapInArrow(run, "key long, id long, place long, label long")


def meet(hot: int):
    """Rows (key, id, place, label) sorted by key: pairs (a, b) of each list, without those of one label; a longer one comes back as its
    ids and labels by key, in blocks."""

    def out(a, b=None, key=None, label=None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), *(none if x is None else pa.array(x, pa.int64()) for x in (b, key, label))], ["a", "b", "key", "label"])

    def lists(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        mixed = np.minimum.reduceat(rows[4], starts) != np.maximum.reduceat(rows[4], starts)
        rows = rows[:, np.repeat(mixed, np.diff(np.r_[starts, rows.shape[1]]))]
        if not rows.shape[1]:
            return
        starts = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        lengths = np.diff(np.r_[starts, rows.shape[1]])
        key, ids, size, pos, label = rows[:, np.repeat(lengths <= ALL, lengths)]
        at = np.arange(len(key))
        for d in range(1, ALL):
            at = at[at + d < len(key)]
            at = at[key[at + d] == key[at]]
            ok = at[(label[at] != label[at + d]) & can_meet(size[at], pos[at], size[at + d], pos[at + d])]
            if len(ok):
                yield out(np.minimum(ids[ok], ids[ok + d]), np.maximum(ids[ok], ids[ok + d]))
        for s, n in zip(starts[lengths > ALL].tolist(), lengths[lengths > ALL].tolist(), strict=True):
            ids, label = rows[1, s : s + n], rows[4, s : s + n]
            order = np.argsort(ids)
            blocks = [order[i : i + hot] for i in range(0, n, hot)]
            for i in range(len(blocks)):
                for j in range(i) if i or len(blocks) > 1 else [0]:
                    both = blocks[i] if i == j else np.r_[blocks[j], blocks[i]]
                    # named by its members, as the lists of many shingles hold the same
                    k = np.uint64(xxh64_intdigest(ids[both].tobytes(), SEED)).astype(np.int64)
                    yield out(ids[both], None, np.full(len(both), k), label[both])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            key, ids, place, label = (b.column(c).to_numpy() for c in ("key", "id", "place", "label"))
            rows = np.stack([key, ids, place >> 32, place & (1 << 32) - 1, np.where(label == 0, ids, label)])
            if held >= 20_000 and rows[0, -1] != last:  # some list ends in here
                cut = int(np.argmax(rows[0] == rows[0, -1]))
                yield from lists(np.concatenate([*parts, rows[:, :cut]], axis=1))
                parts, held, rows = [], 0, rows[:, cut:]
            parts.append(rows)
            held, last = held + rows.shape[1], rows[0, -1]
        if parts:
            yield from lists(np.concatenate(parts, axis=1))

    return run


def joined(ids: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links, each verified, that join all alike sets of a list, as far as labels haven't."""
    n = np.array([len(h) for h in sets])
    starts = np.cumsum(n) - n
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, links = np.zeros(int(token.max()) + 1, np.int64), []
    label = np.unique(label, return_inverse=True)[1]
    for i in range(len(sets) - 1):
        js = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        js = js[like(np.minimum(n[js], n[i]), n[js], n[i])]
        if not len(js):
            continue
        at = np.cumsum(n[js]) - n[js]
        mark[token[starts[i] : starts[i] + n[i]]] = 1
        inter = np.add.reduceat(mark[token[np.arange(int(n[js].sum())) + np.repeat(starts[js] - at, n[js])]], at)
        mark[token[starts[i] : starts[i] + n[i]]] = 0
        for j in js[like(inter, n[js], n[i])].tolist():
            if label[j] != label[i]:
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return links


def join_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, label, h) sorted by key: verified links (a, b)."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        links = joined(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [unpacked(r[3]) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    for rows in by_key(batches, ("key", "id", "label", "h")):
        yield out(rows)


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = [(unpacked(x), unpacked(y)) for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist(), strict=True)]
        ok = pa.array([bool(like(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))) for x, y in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])


def few(df: DataFrame) -> DataFrame:
    """df, which is saved, marked for a broadcast where it is small, as otherwise the other side of a join is shuffled before that is known."""
    return F.broadcast(df) if df.count() <= FEW else df


def sets_of(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, h): the set of each of ids, from the text of one document that has it."""
    wanted = save(nodes.select("id", "k1", "k2").join(ids.distinct(), "id"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [packed(shingles(t)) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(h, pa.binary())], ["id", "h"])

    found = docs.select("k1", "k2", "text").join(few(wanted), ["k1", "k2"]).select("id", "text")
    sets = save(found.mapInArrow(run, "id long, h binary"), "sets")
    # rows that repeat another's id and text share k1 and k2
    return sets if sets.count() == wanted.count() else save(sets.dropDuplicates(["id"]), "sets")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be alike by their counts."""
    sides = [nodes.select(F.col("id").alias(x), F.col("size").alias(f"n{x}"), F.col("counts").alias(f"c{x}")) for x in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(c, np.uint8) for c in b.column(k).to_pylist()] for k in ("ca", "cb"))
            n = zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), strict=True)
            ok = pa.array([bool(like(min(p, q), p, q) and like(most_shared(c, d), p, q)) for c, d, (p, q) in zip(x, y, n, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    pairs = few(pairs)
    return save(sides[0].join(pairs, "a").join(sides[1], "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long"), "possible")


def partnered(size: np.ndarray, label: np.ndarray, count: list[np.ndarray]) -> np.ndarray:
    """Which members of a list can, by their counts, be alike to one of another label."""
    out, buckets = np.zeros(len(size), bool), np.array([len(c) for c in count])
    rows = {n: np.flatnonzero(buckets == n) for n in np.unique(buckets).tolist()}
    whole = {n: np.stack([count[i] for i in at]) for n, at in rows.items()}
    half = {n: folded(m) for n, m in whole.items()}
    place = np.zeros(len(size), np.int64)
    for at in rows.values():
        place[at] = np.arange(len(at))
    for i in range(len(size)):
        n = int(buckets[i])
        for at, theirs, own in ((rows.get(n), whole.get(n), count[i]), (rows.get(2 * n), half.get(2 * n), count[i]), (rows.get(n // 2), whole.get(n // 2), half[n][place[i]])):
            if at is None:
                continue
            js = at[(label[at] != label[i]) & like(np.minimum(size[at], size[i]), size[at], size[i]) & ~(out[at] & out[i])]
            if len(js):
                hit = js[like(np.minimum(theirs[place[js]], own).sum(axis=1, dtype=np.int64), size[js], size[i])]
                out[hit] = True
                out[i] |= len(hit) > 0
    return out


def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, label, size, counts) sorted by key: those (key, id, label) that can have a partner in their list."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        key, ids, label, size = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        ok = partnered(size, label, [np.frombuffer(r[4], np.uint8) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (key, ids, label)], ["key", "id", "label"])

    for rows in by_key(batches, ("key", "id", "label", "size", "counts")):
        yield out(rows)


def by_key(batches: Iterator[pa.RecordBatch], cols: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows that share the first of cols, by which they are sorted."""
    rows: list[tuple] = []
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in cols), strict=True):
            if rows and rows[-1][0] != r[0]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def both_sides(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    sides = [sets.select(F.col("id").alias(x), F.col("h").alias(f"h{x}")) for x in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ha", "hb").mapInArrow(verify, "a long, b long")


def proposals(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (id, fp, size, counts) by the positional byte index: each node with the least of its fingerprint, and the fingerprints'
    links between their least nodes."""
    first = nodes.groupBy("fp").agg(F.min("id").alias("least"))
    same = nodes.join(first, "fp").filter(F.col("id") != F.col("least")).select(F.col("least").alias("a"), F.col("id").alias("b"))
    left, right = (first.select(F.col("fp").alias(f"f{x}"), F.col("least").alias(x)) for x in ("a", "b"))
    links = similar(first.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    return possible(save(same.union(links.join(left, "fa").join(right, "fb").select("a", "b")).distinct(), "proposals"), nodes)


def links_of(docs: DataFrame, nodes: DataFrame, hot: int) -> DataFrame:
    """Verified links (a, b) by shared prefixes between nodes (id, k1, k2, size, prefix, counts, label) of different labels."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(nodes.select("prefix").mapInArrow(prefix_keys, "key long, n long")))
    lists = posts(nodes, bits).repartition("key").sortWithinPartitions("key").mapInArrow(meet(hot), "a long, b long, key long, label long")
    found = save(lists, "prefix-lists")
    bits.destroy()
    pairs = possible(save(found.filter("b is not null").select("a", "b").distinct(), "pairs"), nodes)
    long = few(save(found.filter("key is not null").select("key", F.col("a").alias("id"), "label").distinct(), "long-lists"))
    members = nodes.select("id", "size", "counts").join(long, "id").select("key", "id", "label", "size", "counts")
    long = save(members.repartition("key").sortWithinPartitions("key").mapInArrow(with_partner, "key long, id long, label long"), "long-lists")
    sets = sets_of(docs, nodes, both_sides(pairs).union(long.select("id")))
    by_list = long.join(sets, "id").select("key", "id", "label", "h").repartition("key").sortWithinPartitions("key").mapInArrow(join_lists, "a long, b long")
    return alike(pairs, sets).union(by_list)


def groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, k1, k2, component) for the documents (doc_id, text, k1, k2) that have words; component is the same for all of a group."""
    tune(docs.sparkSession)
    prints = prints_of(docs, common_shingles(docs))
    one = [F.first(c).alias(c) for c in ("fp", "size", "prefix", "counts")]  # the same for all of a set
    nodes = save(prints.groupBy("id").agg(*one, F.min(F.struct("k1", "k2")).alias("k")).select("id", "k.k1", "k.k2", "fp", "size", "prefix", "counts"), "nodes")
    near = proposals(nodes)
    links = save(alike(near, sets_of(docs, nodes, both_sides(near))), "verified")
    so_far = few(components(links).select(F.col("node").alias("id"), "root"))
    labelled = nodes.join(so_far, "id", "left").withColumn("label", F.coalesce("root", F.lit(0).cast("long")))
    links = links.union(save(links_of(docs, labelled, hot), "verified"))
    named = components(links).select(F.col("node").alias("id"), "root")
    return prints.join(named, "id", "left").select("doc_id", "k1", "k2", F.coalesce("root", "id").alias("component"))
