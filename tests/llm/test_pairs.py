"""SimHash and line deduplication against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siderea.llm import line_dedup, simhash, simhash_wide
from siderea.llm.components import components

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(s):
    return re.findall("[^\x20\x09-\x0d]+", s)


def plain_fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    return [root(i) for i in range(n)]


def variants(rnd, n):
    vocab = [f"w{i}É" for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 300))] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append(" ".join(w))
    return [*out, None, "", " \n", "A b", "a B", out[0].upper() if out[0].isascii() else out[0]]


def test_fingerprint_is_spark_xxhash(spark):
    texts = ["a b c d", "Hello hello HELLO", "é É", "x"]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("hot", [8192, 2])
def test_groups(spark, hot):
    texts = variants(random.Random(5), 240)
    fps = [plain_fingerprint(t) for t in texts]
    roots = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = defaultdict(lambda: 1 << 60)
    ids = [1000 - i for i in range(len(texts))]
    for i, r in zip(ids, roots, strict=True):
        least[r] = min(least[r], i)
    want = {i: (f, least[r]) for i, f, r in zip(ids, fps, roots, strict=True)}
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA).withColumn("fp", F.lit("clash"))
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.groups(df, hot=hot).collect()}
    assert got == want


def test_dense_fingerprints_by_flips(spark):
    """Many fingerprints that differ in their low bits alone: lists beyond hot, found by flipping bits."""
    fps = [(0x123456789ABC << 16) | v for v in range(0, 3000)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.root for r in components(simhash.similar(df, hot=100)).collect()}
    assert len(roots) == 1
    assert components(simhash.similar(df, hot=100)).count() == 3000


def test_groups_edges(spark):
    assert simhash.groups(spark.createDataFrame([], SCHEMA)).collect() == []
    got = simhash.groups(spark.createDataFrame([(None, "a"), (None, "a"), (3, ""), (3, None), (2, "a")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 2), (0, 2), (2, 2), (3, 3), (3, 3)]


@pytest.mark.parametrize("few", [100_000, 40])
def test_components(spark, few):
    rnd = random.Random(1)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1300)] + [(2000, j) for j in range(2001, 2200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), few).collect()}
    n = 2200
    roots = union(n, links)
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    groups = defaultdict(set)
    for x, r in got.items():
        groups[roots[x]].add(r)
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_wide_groups_recall(spark):
    """Pairs of five-word similarity 0.8 or more meet; texts without likeness don't."""
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(4000)]
    rows, truth = [], []
    for g in range(150):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(60, 400))]
        copy = list(base)
        for _ in range(max(1, len(base) // 60)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, copy)]
        truth.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    df = spark.createDataFrame([*rows, (9001, ""), (9002, None)], SCHEMA).withColumns({"k1": F.col("doc_id"), "k2": F.lit(0).cast("long")})
    for hot in (8192, 1):
        comp = {r.doc_id: r.component for r in simhash_wide.groups(df, hot=hot).collect()}
        near = [g for g, j in enumerate(truth) if j >= 0.8]
        assert len(near) > 60
        met = sum(comp[2 * g] == comp[2 * g + 1] for g in near)
        assert met == len(near)
        assert len({comp[2 * g] for g in range(150)}) == 150
        assert 9001 not in comp and 9002 not in comp


def plain_lines(docs):
    key = lambda s: s.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    least = -(1 << 63)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(least if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != (least if i is None else i))]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def line_corpus(seed, n):
    rnd = random.Random(seed)
    pool = [f"Line {i} with É and enough text {'x' * (i % 7)}" for i in range(30)] + ["short", "", "   ", "ééééééééééééééééééé", "éééééééééééééééééééé", "a line of just twenty", "a line of twenty c"]
    hot = "The Licence line that stands in every text"
    docs = []
    for i in range(n):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 12))] + ([hot] if rnd.random() < 0.8 else []) + [f"unique {rnd.random()} text that is long"]
        docs.append((i, "\n".join((f" \t{x.upper()}" if rnd.random() < 0.3 and x.isascii() else x + rnd.choice(["", " ", "\r"])) for x in lines)))
    return [*docs, (None, hot), (None, hot + "\n" + pool[0]), (5, hot), (5, hot), (n + 5, None), (n + 6, ""), (n + 7, "\n\n")]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    docs = line_corpus(seed, 150)
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"keep": F.lit(1), "pos": F.lit("clash")})
    got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.without_repeated_lines(df).collect()], key=str)
    assert got == plain_lines(docs)


def test_lines_over_many_partitions(spark):
    """A very common line spreads over partitions: undecided rows of each are decided together."""
    docs = line_corpus(3, 300)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(docs, SCHEMA)
        got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.without_repeated_lines(df).collect()], key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain_lines(docs)


def test_lines_told_very_often(spark, monkeypatch):
    """Rows that share an id and a line by the thousand: more than a task may hold, at every place of a partition."""
    hot = "A line that very many rows of a document hold"
    docs = [(i, f"{hot}\nrow {k} of its own and long enough") for i in (5, 7) for k in range(1500)] + [(9, hot)] * 1200 + [(3, hot), (2, hot + "\n" + "Another line of two documents"), (1, "Another line of two documents")]
    df = spark.createDataFrame(docs, SCHEMA)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for n in ("1", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.without_repeated_lines(df).collect()], key=str)
        for k, v in old.items():
            spark.conf.set(k, v)
        assert got == plain_lines(docs)


def test_lines_are_decided_in_a_stream():
    """One task, by hand: what is set aside and what is decided agrees with all rows together, whatever may be held."""
    rnd = random.Random(3)
    rows = sorted({(h, 0, rnd.randrange(4), k, 0, 1, b"") for h in range(6) for k in range(rnd.randint(1, 30))}, key=lambda r: (r[0], r[1], -r[2], r[3]))
    for held in (1000, 2):
        line_dedup.MOST_HELD = held
        try:
            for cuts in ([], [5], [20, 40], list(range(0, len(rows), 3))):
                gone, aside = set(), []
                for s, e in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                    b = line_dedup._rows(rows[s:e], line_dedup._KINDS, line_dedup._NAMES)
                    for out in line_dedup.decide(3)(iter([b])):
                        for r in out.to_pylist():
                            key = (r["h1"], r["doc"], r["k1"])
                            if r["seen"] is None:
                                gone.add(key)
                            else:
                                aside.append((*key, r["seen"]))
                for h, doc, k, _ in aside:
                    same = [x for x in aside if x[0] == h]
                    if max(max(x[3] for x in same), len({x[1] for x in same})) >= 3 and doc < max(x[1] for x in same):
                        gone.add((h, doc, k))
                docs = defaultdict(set)
                for r in rows:
                    docs[r[0]].add(r[2])
                assert gone == {(r[0], r[2], r[3]) for r in rows if len(docs[r[0]]) >= 3 and r[2] < max(docs[r[0]])}
        finally:
            line_dedup.MOST_HELD = 1000


def test_bitmap_and_edges(spark):
    keep = line_dedup.keep_bitmap(11, [np.array([0, 9], "<i4").tobytes(), np.array([9], "<i4").tobytes()])
    assert [i for i in range(11) if zlib.decompress(keep)[i // 8] >> i % 8 & 1] == [1, 2, 3, 4, 5, 6, 7, 8, 10]
    assert line_dedup.apply_bitmap(b"", None) == (1, 0, b"")
    assert line_dedup.bitmaps(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_bound_what_is_shared():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        x = np.unique(rnd.integers(0, 1 << 48, rnd.integers(1, 400)))
        y = np.unique(np.r_[x[rnd.random(len(x)) < rnd.random()], rnd.integers(0, 1 << 48, rnd.integers(1, 60))])
        shared = len(np.intersect1d(x, y))
        a, b = (np.frombuffer(simhash_wide.counts(h), np.uint8) for h in (x, y))
        assert shared <= simhash_wide.most_shared(a, b) <= min(len(x), len(y))
        if simhash_wide.like(shared, len(x), len(y)):
            assert simhash_wide.partnered(np.array([len(x), len(y)]), np.array([1, 2]), [a, b]).all()


def exact_roots(texts):
    """Components by brute force over five-word shingles."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    alike = lambda x, y: 9 * len(x & y) >= 4 * (len(x) + len(y))
    return union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])


def same_groups(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumns({"k1": F.col("doc_id"), "k2": F.lit(0).cast("long")})
    comp = {r.doc_id: r.component for r in simhash_wide.groups(df, **more).collect()}
    roots = exact_roots(texts)
    both = {(comp[i], roots[i]) for i in range(len(texts))}
    assert len(both) == len({c for c, _ in both}) == len({r for _, r in both})


@pytest.mark.parametrize("hot", [1024, 10])
def test_wide_groups_of_edited_copies(spark, hot):
    """Lists far longer than ALL, of copies on both sides of 0.8 and of texts that share a passage alone: the groups of brute force."""
    rnd = random.Random(12)
    vocab = [f"v{i}" for i in range(3000)]
    passage = [rnd.choice(vocab) for _ in range(40)]
    texts = []
    for _ in range(4):
        base = [rnd.choice(vocab) for _ in range(120)]
        for k in range(70):
            copy = list(base)
            for _ in range(k % 6):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(" ".join(copy))
    texts += [" ".join([*passage, *(rnd.choice(vocab) for _ in range(rnd.randint(0, 30)))]) for _ in range(60)]
    same_groups(spark, texts, hot=hot)


def test_wide_groups_of_short_texts(spark):
    """Eight words and the same with one more share 4 of 5 shingles; of six and seven words, 2 of 3."""
    rnd = random.Random(13)
    texts = []
    for n in (1, 3, 4, 5, 6, 8, 9, 12, 20):
        for k in range(12):
            base = [f"s{rnd.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(base), " ".join([*base, f"more{k}"]), " ".join([f"less{k}", *base])]
    same_groups(spark, texts)
