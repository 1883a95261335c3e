"""Benchmark decontamination by latent semantic retrieval.

Words are lower-cased and stripped of what is neither letter nor digit. Documents become arrays of the numbers of those words that
occur in the benchmark (others cannot match), once, written to the shared folder. Document frequencies over all documents
give each word its weight. A randomised singular value decomposition of TF-IDF passages, run in Spark passes over
all passages of all documents and all items, gives each word a place in a latent space.

Every document is then searched whole: a passage is a run of blocks of BLOCK words, as long as an item plus BLOCK words, starting at
every block, so each occurrence lies whole in some passage. Passages whose weight can't reach MATCH of an item's are skipped (they
could not pass the next test); the others with a latent cosine of at least COSINE are candidates. A candidate counts if the
longest common subsequence holds MATCH of the item's weight and of its words, and the answer, the item's last sentence, is
there too (ANSWER of its words are in the subsequence's passage, in order) or nearly all of the item is (SURE). A document meets
an item in one task, so nothing is shuffled and common passages make no groups.

The benchmark is read whole by the driver. Tasks get it in blocks of items of at most MOST_ITEM_WORDS words (a longer item is a block of
its own), one fit and search of all encoded documents for each block, each with a latent space of its own. Items with fewer than LEAST_WORDS
words have no subsequence to speak of: those of LEAST_CHARS letters and digits or more (a sentence in a script without spaces is one
word) are searched as exact runs of whole words; shorter ones can't be told from chance and are not searched. Null texts hold nothing.
Rows that repeat an id or a text are answered one by one. Null ids are kept. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siderea.llm.common import SPACE, read_table, save, tune
from siderea.llm.repeats import mix

BLOCK = 8
RANK = 128
COSINE = 0.5
MATCH = 0.6
ANSWER = 0.5
SURE = 0.8
LEAST_WORDS = 5
LEAST_CHARS = 20  # of an item with fewer words than that
PASSAGE = 64  # words of a passage that the space is fitted on
FIT_WORDS = 500_000  # of documents cut at once
FIT_CHUNK = 256  # passages multiplied at once: they fit a core's cache
DENSE = 170  # words that one passage in so many holds are multiplied as dense columns, where that is faster
FIT_TASKS = 64  # each sends a matrix of vocabulary by rank
FIT_ROWS = 1024  # of such a matrix in one record
MOST_ITEM_WORDS = 50_000  # the driver sums matrices of so many rows at most
_BREAKS = bytes.maketrans(SPACE, b" " * len(SPACE))
_MARKS = re.compile(r"[\W_]+")


def normal(word: bytes) -> str:
    w = word.decode("utf-8", "replace").lower()
    return w if w.isalnum() else _MARKS.sub("", w)


class Numbers(dict):
    """Raw words to numbers of the vocabulary, -1 for others and -2 for words of marks alone; remembers what it has seen."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        w = normal(word)
        n = self.vocabulary.get(w, -1) if w else -2
        if len(word) < 60:
            self[word] = n
        return n


def numbers(text: bytes, lookup: Numbers) -> np.ndarray:
    n = np.fromiter(map(lookup.__getitem__, text.translate(_BREAKS).split()), np.int32)
    return n[n != -2]


class Items:
    def __init__(self, rows: list[tuple[int | None, str]]):
        texts = [(i, [w for w in map(normal, t.encode().translate(_BREAKS).split()) if w], t) for i, t in rows]
        texts = [(i, w, t) for i, w, t in texts if len(w) >= LEAST_WORDS or len("".join(w)) >= LEAST_CHARS]
        texts.sort(key=lambda x: len(x[1]) < LEAST_WORDS)
        self.runs = sum(len(w) < LEAST_WORDS for _, w, _ in texts)  # the last ones: searched as exact runs
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws, _ in texts for w in ws))}
        self.ids = [i for i, *_ in texts]
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws, _ in texts]
        self.answer_from = []
        for _, ws, t in texts:
            last = re.split(r"[.!?\n]+[\s]*", t.strip().rstrip(".!?\n "))[-1]
            n = len([w for w in map(normal, last.encode().translate(_BREAKS).split()) if w])
            self.answer_from.append(len(ws) - min(max(n, 1), len(ws)))


def parted(rows: list[tuple[int | None, str]], most: int) -> list[Items]:
    """All rows, in blocks of at most this many words where no single item has more."""
    parts: list[list[tuple[int | None, str]]] = []
    size = 0
    for r in rows:
        n = len(r[1].encode().translate(_BREAKS).split())
        if not parts or size + n > most:
            parts.append([])
            size = 0
        parts[-1].append(r)
        size += n
    return [items for part in parts if (items := Items(part)).words]


def encoded(docs: DataFrame, words: dict[str, int]) -> DataFrame:
    """doc_id and w: int32 numbers of its words, all words outside the vocabulary being -1."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Numbers(vocabulary.value)
        for b in batches:
            w = [numbers(t or b"", lookup).astype("<i4").tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w, pa.binary())], ["doc_id", "w"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    words = save(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, w binary"), "words")
    vocabulary.destroy()
    return words


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i4") for x in column.to_pylist()]


def renumbered(words: DataFrame, whole: dict[str, int], part: dict[str, int]) -> DataFrame:
    """words in the numbers of part; words outside it are -1."""
    if whole == part:
        return words
    new = np.full(len(whole) + 1, -1, "<i4")  # the last is that of -1
    new[[whole[w] for w in part]] = list(part.values())
    sent = words.sparkSession.sparkContext.broadcast(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([sent.value[w].tobytes() for w in _arrays(b.column("w"))], pa.binary())], ["doc_id", "w"])

    return words.mapInArrow(run, words.schema)


def weights(words: DataFrame, size: int) -> np.ndarray:
    """Inverse document frequency of each word of the vocabulary over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, docs = np.zeros(size, np.int64), 0
        for b in batches:
            for w in _arrays(b.column("w")):
                count[np.unique(w[w >= 0])] += 1
                docs += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[count[at], docs])], ["word", "n"])

    got = words.select("w").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True))
    df = np.array([n.get(i, 0) for i in range(size)], np.float64)
    return np.log((n.get(-1, 0) + 2) / (df + 1)).clip(0.05)


def _passages(w: np.ndarray) -> list[np.ndarray]:
    return [p[p >= 0] for p in (w[i : i + PASSAGE] for i in range(0, len(w), PASSAGE))]


def taken_passages(words: DataFrame, sample: int) -> DataFrame:
    """p: passages of at least two known words, about `sample` of all, by a 64-bit hash of document and place. For looking at a
    corpus only: neither leaks() nor a stage of the pipeline calls it, and latent() takes all passages."""
    total = words.agg(F.sum(F.expr(f"ceil(length(w) / {4 * PASSAGE})")).alias("n")).collect()[0].n or 0
    least = np.uint64(min((1 << 64) - 1, int(sample / max(total, 1) * (1 << 64))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for w, seed in zip(_arrays(b.column("w")), b.column("seed").to_numpy().view(np.uint64), strict=True):
                n = -(-len(w) // PASSAGE)
                hit = np.flatnonzero(mix(seed + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) <= least)
                if len(hit):
                    ps = _passages(w)
                    out += [ps[i].astype("<i4").tobytes() for i in hit.tolist() if len(ps[i]) > 1]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["p"])

    return save(words.select("w", F.xxhash64("doc_id", "w").alias("seed")).mapInArrow(cut, "p binary"), "passages")


def passages(ws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The known words of all passages of these documents, and the number of each one's passage, ascending."""
    n = np.array([len(w) for w in ws], np.int64)
    parts = -(-n // PASSAGE)
    of = np.repeat(np.cumsum(parts) - parts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) // PASSAGE
    flat = np.concatenate(ws)
    return of[flat >= 0], flat[flat >= 0]


def gram(of: np.ndarray, flat: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis, where A holds the TF-IDF of each passage as a row of unit length: frequent words as a dense part, the others as a sparse one."""
    out = np.zeros(basis.shape)
    if not len(flat):
        return out
    key, n = np.unique(of * len(idf) + flat, return_counts=True)
    of, flat = np.divmod(key, len(idf))
    new = np.diff(of, prepend=-1) > 0
    row, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    x = n * idf[flat]
    x = (x / np.sqrt(np.add.reduceat(x * x, starts))[row]).astype(np.float32)
    often = np.flatnonzero(np.bincount(flat) * DENSE > len(starts))
    column = np.full(len(idf), -1)
    column[often] = np.arange(len(often))
    column, basis = column[flat], basis.astype(np.float32, copy=False)
    top, top_out = basis[often], np.zeros((len(often), basis.shape[1]))
    bounds = np.append(starts[::FIT_CHUNK], len(x))
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        r, c, w, v = row[lo:hi] - row[lo], column[lo:hi], flat[lo:hi], x[lo:hi]
        is_dense = c >= 0
        a = np.zeros((r[-1] + 1, len(often)), np.float32)
        a[r[is_dense], c[is_dense]] = v[is_dense]
        y = a @ top
        r, w, v = r[~is_dense], w[~is_dense], v[~is_dense, None]
        if len(w):
            first = np.flatnonzero(np.diff(r, prepend=-1))
            y[r[first]] += np.add.reduceat(basis[w] * v, first, axis=0)
            by = np.argsort(w)
            first = np.flatnonzero(np.diff(w[by], prepend=-1))
            out[w[by][first]] += np.add.reduceat(y[r[by]] * v[by], first, axis=0)
        top_out += a.T @ y
    out[often] += top_out
    return out


def corpus_gram(words: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """gram of all passages of all documents: at most FIT_TASKS tasks sum theirs, and the sums are added up by blocks of rows."""
    sent = words.sparkSession.sparkContext.broadcast((idf, basis.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = sent.value
        out = np.zeros(basis.shape)
        for b in batches:
            ws, size = [], 0
            for w in _arrays(b.column("w")):
                ws.append(w)
                size += len(w)
                if size > FIT_WORDS:
                    out += gram(*passages(ws), idf, basis)
                    ws, size = [], 0
            if ws:
                out += gram(*passages(ws), idf, basis)
        at = list(range(0, len(out), FIT_ROWS)) if out.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([out[i : i + FIT_ROWS].astype("<f4").tobytes() for i in at], pa.binary())], ["at", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, m in zip(b.column("at").to_pylist(), b.column("m").to_pylist(), strict=True):
                total[at] = total.get(at, 0.0) + np.frombuffer(m, "<f4").astype("<f8")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], ["at", "m"])

    out = np.zeros(basis.shape)
    got = words.select("w").coalesce(FIT_TASKS).mapInArrow(run, "at int, m binary").repartition("at").mapInArrow(add, "at int, m binary").toArrow()
    sent.destroy()
    for at, m in zip(got["at"].to_pylist(), got["m"].to_pylist(), strict=True):
        out[at : at + FIT_ROWS] = np.frombuffer(m, "<f8").reshape(-1, basis.shape[1])
    return out


def latent(words: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """A row for each word: its place, weight included. Randomised subspace iteration: each round multiplies the basis by the
    passages' Gram matrix, a sum over all of them."""
    rank = min(rank, len(items.words), len(idf))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(idf), rank)))[0]
    of, flat = np.repeat(np.arange(len(items.words)), [len(w) for w in items.words]), np.concatenate(items.words)
    small = np.zeros((rank, rank))
    for r in range(rounds + 1):
        corpus, own = corpus_gram(words, idf, basis), gram(of, flat, idf, basis)
        # items weigh as much as the corpus, so that each has a place even where no passage resembles it
        total = corpus * (np.linalg.norm(own) / max(np.linalg.norm(corpus), 1e-12)) + own
        if r < rounds:
            basis = np.linalg.qr(total)[0]
        else:
            small = basis.T @ total
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (basis @ vectors[:, np.argsort(-values)] * idf[:, None]).astype(np.float32)


def _run_keys(w: np.ndarray, n: int) -> np.ndarray:
    """A key of the n words from each place on."""
    out = np.zeros(max(0, len(w) - n + 1), np.int64)
    for i in range(n):
        out = out * 1_000_003 + w[i : i + len(out)]
    return out


def common(item: dict[int, int], n: int, window: list[int]) -> int:
    """Bits of item positions that the longest common subsequence with window uses, by bit-parallel rows; item: masks of
    positions by word. The result has a zero bit at each position that lengthens the subsequence."""
    full = (1 << n) - 1
    v = full
    for w in window:
        m = item.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return ~v & full


class Search:
    def __init__(self, items: Items, place: np.ndarray, idf: np.ndarray, cosine: float, match: float):
        self.items, self.place, self.idf, self.cosine, self.match = items, place, idf, cosine, match
        # with a row of zeros for words outside the vocabulary
        self.place0, self.idf0 = np.vstack([place, np.zeros((1, place.shape[1]), np.float32)]), np.append(idf, 0.0)
        self.mass = np.array([idf[w].sum() for w in items.words])
        vec = np.array([place[w].sum(axis=0) for w in items.words])
        self.vec = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
        self.masks: list[dict[int, int]] = []
        self.by_blocks: dict[int, list[int]] = defaultdict(list)
        self.runs: dict[int, dict[int, list[int]]] = defaultdict(dict)  # by length and key
        whole = len(items.words) - items.runs
        for k in range(whole, len(items.words)):
            w = items.words[k]
            self.runs[len(w)].setdefault(int(_run_keys(w, len(w))[0]), []).append(k)
        for k, w in enumerate(items.words[:whole]):
            masks: dict[int, int] = defaultdict(int)
            for j, x in enumerate(w.tolist()):
                masks[x] |= 1 << j
            self.masks.append(dict(masks))
            self.by_blocks[-(-(len(w) + BLOCK - 1) // BLOCK)].append(k)

    def verified(self, k: int, w: np.ndarray, at: int, blocks: int) -> float:
        """Share of item k's words in the longest common subsequence with this passage and a block on either side, 0 if it isn't enough."""
        words, n = self.items.words[k], len(self.items.words[k])
        window = w[max(0, (at - 1) * BLOCK) : (at + blocks + 1) * BLOCK]
        window = window[window >= 0].tolist()
        used = common(self.masks[k], n, window)
        share = used.bit_count() / n
        if share < self.match:
            return 0.0
        hit = np.array([used >> i & 1 for i in range(n)], bool)
        if self.idf[words[hit]].sum() < self.match * self.mass[k]:
            return 0.0
        tail = words[self.items.answer_from[k] :]
        masks: dict[int, int] = defaultdict(int)
        for j, x in enumerate(tail.tolist()):
            masks[x] |= 1 << j
        answered = common(masks, len(tail), window).bit_count() / len(tail) >= ANSWER
        return share if answered or share >= SURE else 0.0

    def find_runs(self, docs: list[np.ndarray]) -> list[tuple[int, int, float, float, int]]:
        """The same of the items that are searched as exact runs, with their first places."""
        out, seen = [], set()
        for n, by in self.runs.items():
            keys = np.array(sorted(by), np.int64)
            for d, w in enumerate(docs):
                got = _run_keys(w, n)
                for at in np.flatnonzero(np.isin(got, keys)).tolist():
                    for k in by[int(got[at])]:
                        if (d, k) not in seen and (w[at : at + n] == self.items.words[k]).all():
                            seen.add((d, k))
                            out.append((d, k, 1.0, 1.0, at))
        return out

    def find(self, docs: list[np.ndarray]) -> list[tuple[int, int, float, float, int]]:
        """(document, item, cosine, share, first word) of the best passage for each document and item.

        Texts are laid out as blocks, with empty blocks between them, so that a passage is the sum of the blocks that follow:
        each longer passage adds one block to the last.
        """
        if not docs or not self.by_blocks:
            return []
        gap, none = max(self.by_blocks), len(self.idf)
        sizes = np.array([-(-len(w) // BLOCK) for w in docs])
        first = np.cumsum(sizes + gap) - sizes - gap
        slots = np.full((int((sizes + gap).sum()), BLOCK), none, np.int32)
        for w, f, n in zip(docs, first.tolist(), sizes.tolist(), strict=True):
            slots[f : f + n].reshape(-1)[: len(w)] = np.where(w >= 0, w, none)
        doc = np.repeat(np.arange(len(docs)), sizes + gap)
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        step = 2000
        for lo in range(0, len(slots), step):
            part = slots[lo : lo + step + gap]
            vec, mass = self.place0[part[:, 0]], self.idf0[part[:, 0]]
            for j in range(1, BLOCK):
                vec += self.place0[part[:, j]]
                mass = mass + self.idf0[part[:, j]]
            n = min(step, len(slots) - lo)
            total, heft, done = vec[:n].copy(), mass[:n].copy(), 1
            for blocks in sorted(self.by_blocks):
                while done < blocks:  # beyond the last block there is nothing
                    more = min(n, max(len(vec) - done, 0))
                    total[:more] += vec[done : done + more]
                    heft[:more] += mass[done : done + more]
                    done += 1
                ks = self.by_blocks[blocks]
                heavy = np.flatnonzero(heft >= self.match * self.mass[ks].min() - 1e-6)
                if not len(heavy):
                    continue
                v = total[heavy]
                cos = (v @ self.vec[ks].T) / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]
                for j, c in zip(*(x.tolist() for x in np.nonzero(cos >= self.cosine)), strict=True):
                    k, d = ks[c], int(doc[lo + heavy[j]])
                    at = int(lo + heavy[j] - first[d])
                    was = best.get((d, k))
                    if was and was[1] == 1.0:
                        continue
                    share = self.verified(k, docs[d], at, blocks)
                    if share and (was is None or share > was[1]):
                        best[d, k] = (float(cos[j, c]), share, at * BLOCK)
        return [(d, k, *x) for (d, k), x in best.items()]


def search_all(words: DataFrame, items: Items, schema: str, ikind: str, cosine: float, match: float) -> DataFrame:
    spark = words.sparkSession
    idf = weights(words, len(items.vocabulary))
    search = spark.sparkContext.broadcast(Search(items, latent(words, items, idf), idf, cosine, match))
    item_type = pa.int64() if ikind == "bigint" else pa.int32() if ikind == "int" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = search.value
        for b in batches:
            arrays, found, at, size = _arrays(b.column("w")), [], 0, 0
            for i, w in enumerate(arrays):  # about 200,000 words at once
                size += len(w)
                if size > 200_000 or i == len(arrays) - 1:
                    found += [(d + at, *x) for f in (s.find, s.find_runs) for d, *x in f(arrays[at : i + 1])]
                    at, size = i + 1, 0
            ids = b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.items.ids[f[1]] for f in found], item_type), *(pa.array([f[j] for f in found], t) for j, t in ((2, pa.float64()), (3, pa.float64()), (4, pa.int32())))], ["doc_id", "item_id", "cosine", "matched", "start"])

    found = save(words.mapInArrow(run, schema), "found")
    search.destroy()
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, match: float = MATCH) -> DataFrame:
    """(doc_id, item_id, cosine, matched, start) for each document (doc_id, text) and item (item_id, text) that it holds: the
    share of the item's words found in order, and the word where the passage starts."""
    spark = tune(docs.sparkSession)
    kind, ikind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {ikind}, cosine double, matched double, start int"
    blocks = parted([(r.item_id, r.text) for r in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").collect()], MOST_ITEM_WORDS)
    if not blocks:
        return spark.createDataFrame([], schema)
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for items in blocks for w in items.vocabulary))}
    words, found = encoded(docs, vocabulary), None
    for items in blocks:
        new = search_all(renumbered(words, vocabulary, items.vocabulary), items, schema, ikind, cosine, match)
        found = new if found is None else found.union(new)
    return found


def op10_lsa_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
