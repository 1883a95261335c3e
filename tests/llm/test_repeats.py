import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siderea.llm import recompression, repeats, suffix_dedup

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


def brute(texts, unit, window, join):
    """For each text: units, removed, spans, digest of the rest."""
    seqs = [unit(t or "") for t in texts]
    seen = defaultdict(int)
    for s in seqs:
        for i in range(len(s) - window + 1):
            seen[tuple(s[i : i + window])] += 1
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((len(s), sum(gone), spans, hashlib.sha256(join([x for x, g in zip(s, gone, strict=True) if not g])).hexdigest()))
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(200)]
    para = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(20, 120))) for _ in range(12)]
    texts = []
    for _ in range(n):
        t = " ".join(rnd.choice([rnd.choice(para), " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60)))]) for _ in range(rnd.randint(0, 8)))
        if rnd.random() < 0.3:
            t += "\n" + rnd.choice(["ab ", "x", "la la lu\t"]) * rnd.randint(1, 400)
        if rnd.random() < 0.2 and texts:
            t = (texts[-1] or "")[rnd.randint(0, 50) :]
        texts.append(t)
    return [*texts, None, "", " \n\t ", "a" * 199, "b" * 200, "b" * 201, texts[0], "w " * 34, "v " * 36, "ü" * 300]


def words(s):
    return re.findall("[^\x20\x09-\x0d]+", s)


def test_bytes(spark):
    texts = corpus(1, 60)
    want = brute(texts, lambda t: list(t.encode()), 200, bytes)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    for hot in (65536, 3):
        got = suffix_dedup.without_repeats(suffix_dedup.repeated_bytes(df, hot=hot)).collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(got, key=lambda r: r.doc_id)] == want


def test_words(spark):
    texts = corpus(2, 80)
    want = brute(texts, words, 35, lambda x: " ".join(x).encode())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    for hot in (65536, 3):
        got = recompression.without_repeats(recompression.repeated_words(df, hot=hot)).collect()
        assert [(r.n_words, r.n_removed, r.kept_sha256) for r in sorted(got, key=lambda r: r.doc_id)] == [(a, b, d) for a, b, _, d in want]


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    texts = corpus(3, 20)
    from pyspark.sql import functions as F

    big = "".join((t or "") + " " for t in texts) * 2
    df = spark.createDataFrame([(1, big), (2, texts[0])], SCHEMA).withColumn("k1", F.lit("clash")).withColumn("spans", F.lit(1))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    monkeypatch.setattr(recompression, "CHUNK", 500)
    want = brute([big, texts[0]], lambda t: list(t.encode()), 200, bytes)
    # in this process: the finder alone, as workers don't see the patch
    find = suffix_dedup.finder()
    n = sum(nw.sum() for _, _, nw, *_ in find([big.encode()]))
    assert n == len(big.encode()) - 199
    n = sum(nw.sum() for _, _, nw, *_ in recompression.finder()([big.encode()]))
    assert n == len(words(big)) - 34
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(suffix_dedup.repeated_bytes(df)).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == want[0]


@pytest.mark.parametrize("op", ["bytes", "words"])
def test_edges(spark, op):
    run = (lambda d: suffix_dedup.without_repeats(suffix_dedup.repeated_bytes(d))) if op == "bytes" else (lambda d: recompression.without_repeats(recompression.repeated_words(d)))
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
    t = " ".join(f"w{i}" for i in range(100))
    got = run(spark.createDataFrame([(None, t), (None, t), (5, None), (5, "x")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in got) == [(0, True), (0, True), (5, False), (5, False)]


def test_a_text_of_one_byte_or_word_is_few_rows(spark):
    """Pieces that a task meets again are merged before they leave it; all of the text goes, as by brute force."""
    class Sent:
        value = np.full(1 << 14, -1, np.int64).view(np.uint64)

    for find, text, windows in ((suffix_dedup.finder(), "a" * 1_000_000, 999_801), (recompression.finder(), "w " * 500_000, 499_966), (suffix_dedup.finder(), "abc" * 300_000, 899_801)):
        batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([1]), pa.array([2])], ["text", "k1", "k2"])
        rows = pa.Table.from_batches(repeats.cut_pieces(find, Sent)(iter([batch]))).to_pylist()
        assert len(rows) < 400
        seen = sorted((r["start"], r["stop"]) for r in rows if r["stop"] is not None)
        assert sum(e - s for s, e in seen) + sum(r["nw"] for r in rows if r["body"]) == windows
    df = spark.createDataFrame([(1, "a" * 5_000_000), (2, "b")], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.without_repeats(suffix_dedup.repeated_bytes(df)).collect()}
    assert got == {1: (5_000_000, 5_000_000, 1), 2: (1, 0, 0)}
