"""Nearest neighbours by shifted space-filling curves.

Each of `curves` orderings projects the unit vectors onto `dims` random orthonormal directions, scales each by its mean and
deviation over all vectors, shifts the cube by a random offset and orders vectors along a Hilbert curve through it. Each curve is
range-partitioned by key; ranks along it cut it into blocks of `block` vectors. A query looks at the blocks within `reach` of the
curve's length on either side of its own (one at least), compares by exact cosine, and the curves' results merge.

`reach` is a share of all vectors since the vectors given here are nearly isotropic in 64 dimensions: the fifth
neighbour's cosine is 0.47, so a window must hold a fixed share of the table for a given recall. For vectors with structure a
smaller reach does.

Vectors that are null, zero, of another length than the commonest (the longer one of equals), or hold null or non-finite
components take no part; nor do rows without vec_id. Equal vectors are compared once: a vector stands for its `k` + 1 least ids,
which is all that a result of k can show of it. Rows that share a vec_id are one item with several vectors: its score is the
best of theirs, and it is never its own neighbour. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siderea.llm.common import read_table, save, tune

CURVES = 10
DIMS = 8
BITS = 6
REACH = 1 / 14
BLOCK = 2048
SEED = 20240501


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n, dims), each coordinate below 2 ** bits, along the Hilbert curve through the cube.

    Each level of bits, from the top, names a subcube in Gray-code order; the cube is then turned so that the subcube's curve
    starts and ends where its neighbours' do: an entry corner (a mask of flipped axes) and a direction (a rotation of axes).
    """
    n, dims = x.shape
    full = (1 << dims) - 1
    entry, turn, out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        corner = np.zeros(n, np.int64)
        for i in range(dims):
            corner |= (x[:, i] >> level & 1) << i
        corner ^= entry
        r = turn + 1
        corner = (corner >> r | corner << (dims - r)) & full
        w = corner.copy()  # inverse Gray code
        s = 1
        while s < dims:
            w ^= w >> s
            s <<= 1
        out = out << dims | w
        # entry corner and direction of subcube w
        e = np.where(w == 0, 0, ((w - 1) // 2 * 2) ^ ((w - 1) // 2 * 2 >> 1))
        odd = np.where(w % 2 == 0, w - 1, w)
        ones = _trailing_ones(np.maximum(odd, 0), dims)
        d = np.where(w == 0, 0, ones % dims)
        entry ^= ((e << r) | (e >> (dims - r))) & full
        turn = (turn + d + 1) % dims
    return out


def _trailing_ones(v: np.ndarray, dims: int) -> np.ndarray:
    count, still = np.zeros(len(v), np.int64), np.ones(len(v), bool)
    for i in range(dims):
        still &= v >> i & 1 == 1
        count += still
    return count


def frames(length: int, curves: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (length, curves * dims) and shifts (curves * dims); fewer dims where vectors are shorter."""
    rnd, dims = np.random.default_rng(seed), min(dims, length)
    return np.hstack([np.linalg.qr(rnd.normal(size=(length, dims)))[0] for _ in range(curves)]), rnd.random(curves * dims) * 0.5


def _matrix(column: pa.Array) -> np.ndarray:
    v = column.values if isinstance(column, pa.ListArray) else column.flatten()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, len(v)))


def _even(m: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component is near one: a cosine's bits stay, and no product leaves its range."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vec) of the rows that take part, and their length."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select("vec_id", F.col("embedding").cast(kind).alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    v = v.filter(~F.exists("vec", bad)).filter(F.exists("vec", lambda x: x != 0))
    length = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    n = length[0].n if length else 0
    return v.filter(F.size("vec") == n), n


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, reach: float = REACH, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of vectors (vec_id, embedding) that is_query (on vec_id) names."""
    spark = tune(vectors.sparkSession)
    v, length = usable(vectors)
    if not length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = min(dims, length)
    v = v.withColumns({"v1": F.xxhash64(F.lit(1), "vec"), "v2": F.xxhash64(F.lit(2), "vec")})
    kind = v.schema["vec"].dataType.simpleString()
    asked = save(v.filter(is_query).select(F.col("vec_id").alias("query_id"), "v1", "v2"), "queries")
    few = v.withColumn("r", F.dense_rank().over(Window.partitionBy("v1", "v2").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    items = few.groupBy("v1", "v2").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("vec").alias("vec"))
    queried = asked.select("v1", "v2").distinct().withColumn("q", F.lit(True))
    items = save(items.join(queried, ["v1", "v2"], "left").withColumn("q", F.coalesce("q", F.lit(False))), "items")
    way, shift = frames(length, curves, dims, seed)
    # mean and deviation of each projection, over all vectors
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(way.shape[1]), np.zeros(way.shape[1])
        for b in batches:
            if b.num_rows:
                p = _unit(_matrix(b.column("vec"))) @ way
                n, s, ss = n + len(p), s + p.sum(axis=0), ss + (p * p).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.tolist()])], ["n", "s", "ss"])

    got = items.select("vec").mapInArrow(moments, "n long, s array<double>, ss array<double>").select("n", F.posexplode(F.arrays_zip("s", "ss"))).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col.s").alias("s"), F.sum("col.ss").alias("ss")).orderBy("pos").collect()
    total = got[0].n
    mean = np.array([r.s for r in got]) / total
    dev = np.sqrt(np.maximum(np.array([r.ss for r in got]) / total - mean**2, 1e-18))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cube = 0.5 * (1 + np.tanh(0.8 * (_unit(_matrix(b.column("vec"))) @ way - mean) / dev))
            cells = np.minimum(((cube + shift) / 1.5 * (1 << bits)).astype(np.int64), (1 << bits) - 1)
            for c in range(curves):
                h = hilbert_index(cells[:, c * dims : (c + 1) * dims], bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), c, np.int32)), pa.array(h), *(b.column(x) for x in ("v1", "v2", "ids", "vec", "q"))], ["curve", "key", "v1", "v2", "ids", "vec", "q"])

    along = items.mapInArrow(keys, f"curve int, key long, v1 long, v2 long, ids array<long>, vec {kind}, q boolean")
    order = ["curve", "key", "v1", "v2"]
    laid = along.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    laid = save(laid, "curves")  # written, so that a row's place never changes
    # one row for each partition and curve in it
    places = laid.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = places.select("curve", "part", (before - F.col("first")).alias("move"))
    ranked = laid.join(places, ["curve", "part"]).withColumn("block", F.expr(f"cast((at + move) div {block} as int)"))
    blocks = -(-total // block)
    wide = max(1, int(np.ceil(reach * blocks)))
    cols = ["curve", "block", "side", "v1", "v2", "ids", "vec"]
    here = ranked.withColumn("side", F.lit(0)).select(*cols)
    near = F.sequence(F.greatest(F.lit(0), F.col("block") - wide), F.least(F.lit(blocks - 1), F.col("block") + wide))
    asks = ranked.filter("q").withColumns({"side": F.lit(1), "ids": F.lit(None).cast("array<long>")}).withColumn("block", F.explode(near)).select(*cols)
    both = here.unionByName(asks).repartition("curve", "block").sortWithinPartitions("curve", "block", "side")
    found = save(both.mapInArrow(compare(k + 1), "v1 long, v2 long, vec_id long, score double"), "found")
    best = found.groupBy("v1", "v2", "vec_id").agg(F.max("score").alias("score"))
    most = Window.partitionBy("v1", "v2").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("r", F.row_number().over(most)).filter(F.col("r") <= k + 1).drop("r")
    told = asked.join(best, ["v1", "v2"]).filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return told.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def compare(k: int):
    """Rows sorted by (curve, block, side): each block's vectors (side 0) against its queries (side 1), the k best ids of each."""

    def top(vectors: list[np.ndarray], ids: list[list[int]], names: list[tuple[int, int]], queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        m = _even(np.vstack(vectors))
        norm = np.sqrt((m * m).sum(axis=1))
        for i in range(0, len(queries), 512):
            q = _even(queries[i : i + 512])
            score = (q @ m.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * norm[None, :])
            least = np.partition(score, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])]
            rows: list[tuple] = []
            for j, s in enumerate(score):
                hits = [(-float(s[c]), x) for c in np.flatnonzero(s >= least[j]).tolist() for x in ids[c]]
                rows += [(*names[i + j], x, -n) for n, x in sorted(hits)[:k]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["v1", "v2", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, ids = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("vec"))
            group = np.stack([b.column(c).to_numpy() for c in ("curve", "block", "side")], axis=1)
            cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(m)], strict=True):
                curve, block, side = group[s].tolist()
                if (curve, block) != now:
                    now, vectors, ids = (curve, block), [], []
                if side == 0:
                    vectors.append(m[s:e])
                    ids += b.column("ids").slice(s, e - s).to_pylist()
                elif vectors:
                    names = list(zip(b.column("v1").slice(s, e - s).to_pylist(), b.column("v2").slice(s, e - s).to_pylist(), strict=True))
                    yield from top(vectors, ids, names, m[s:e])

    return run


def op3_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
