"""Mixing sources to target weights by the cube method of balanced sampling.

Each source gets a target of words; target / words of the source is how often each of its documents is taken on average. The
whole part is certain; the fraction is an inclusion probability. Which documents are taken once more is a balanced sample:
in the flight phase three documents at a time move along the vector that leaves the source's totals of words and of
documents unchanged, until one of them is in or out. Blocks of a source (by hash) fly in parallel and leave at most two
documents each; those of all blocks fly on together, level by level, until one block is left. In the landing phase the last two
move along words alone, the last one is rounded, and up to two documents of the group change sides where that brings its words
nearer to what was due. Documents fly in the order of a hash: among neighbours of like size a large one
would hardly move and be left to land.

The draws are seeded by block, and the order is one of hashes: reruns agree. Rows that are equal in doc_id, source
and size may swap their draws.

Null and empty texts have size 0 and are taken 0 words. A null source is a source of its own, last in order. Null and repeated
doc_ids are kept, one row per input row. Where all sizes are 0 all targets are 0. Other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siderea.llm.common import WORD, read_table, save

WEIGHTS = (5, 2, 1)
MOST = 3  # times its size, for sources and documents
BLOCK = 2_000
EPS = 1e-9


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words for each source: all words shared by weight (repeating, sources by code point, null last), none above `most` times
    its size, what is above shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    rest, left = float(sum(sizes.values())), list(order)
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in left}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left.remove(s)
        rest -= sum(out[s] for s in over)
    return out


def _move(p: list[float], u: tuple[float, ...], draw: float) -> list[float]:
    """One step along u or against it, as far as the cube goes, so that the expectation stays."""
    up = min((1 - x) / v if v > 0 else -x / v for x, v in zip(p, u, strict=True) if v)
    down = min(x / v if v > 0 else (x - 1) / v for x, v in zip(p, u, strict=True) if v)
    step = up if draw * (up + down) < down else -down
    got = [x + step * v for x, v in zip(p, u, strict=True)]
    return [0.0 if x < EPS else 1.0 if x > 1 - EPS else x for x in got]


def flight(sizes: Sequence[float], probs: Sequence[float], seed: str) -> list[float]:
    """Probabilities after the flight: all but two at most are 0 or 1; totals of size and of number are kept."""
    rnd, out, air = random.Random(seed), list(probs), []
    for i in range(len(out)):
        if not EPS < out[i] < 1 - EPS:
            continue
        air.append(i)
        while len(air) == 3:
            a, b, c = (float(sizes[k]) for k in air)
            u = (b - c, c - a, a - b)
            scale = max(map(abs, u))
            u = tuple(x / scale for x in u) if scale else (1.0, -1.0, 0.0)
            for k, x in zip(air, _move([out[k] for k in air], u, rnd.random()), strict=True):
                out[k] = x
            air = [k for k in air if 0 < out[k] < 1]
    return out


def landing(sizes: Sequence[float], probs: Sequence[float], seed: str) -> list[float]:
    """0 or 1 for those that are left: pairs move along words alone, the last is rounded."""
    rnd, out, air = random.Random(seed + "/landing"), list(probs), []
    for i in range(len(out)):
        if not EPS < out[i] < 1 - EPS:
            continue
        air.append(i)
        if len(air) == 2:
            a, b = (float(sizes[k]) for k in air)
            u = (b, -a) if max(a, b) else (1.0, -1.0)
            scale = max(map(abs, u))
            for k, x in zip(air, _move([out[k] for k in air], (u[0] / scale, u[1] / scale), rnd.random()), strict=True):
                out[k] = x
            air = [k for k in air if 0 < out[k] < 1]
    return [float(round(x)) if 0 < x < 1 else x for x in out]


def settle(sizes: Sequence[float], due: float, taken: Sequence[float], flips: int = 2) -> list[float]:
    """Change the side of up to `flips` documents, each the one whose size is nearest to what is missing or too much."""
    out = list(taken)
    for _ in range(flips):
        over = sum(s for s, x in zip(sizes, out, strict=True) if x) - due
        side = [i for i, x in enumerate(out) if x == (over > 0) and 0 < sizes[i] < 2 * abs(over)]
        if not side:
            break
        i = min(side, key=lambda k: (abs(sizes[k] - abs(over)), k))
        out[i] = 1.0 - out[i]
    return out


def _fly(last: bool):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("order", "ascending"), ("size", "descending"), ("doc_id", "ascending")])
        sizes, probs = group["size"].to_pylist(), group["p"].to_pylist()
        seed = f"{group['source'][0]}/{group['block'][0]}/{len(sizes)}"
        got = flight(sizes, probs, seed)
        if last:
            got = settle(sizes, sum(s * p for s, p in zip(sizes, probs, strict=True)), landing(sizes, got, seed))
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(got, pa.float64()))

    return run


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, source, text): doc_id, source, size, source_size, target, times (how often the mix takes the document), taken.

    One row per source comes to the driver; everything else stays distributed, and no text is shuffled.
    """
    spark = docs.sparkSession
    sized = save(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    sources = [(r.source, r.n, r.words) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()]
    goal = targets({s: w for s, _, w in sources}, weights, most)
    rows = [(s, w, goal[s], goal[s] / w if w else 0.0, max(1, -(-n // block))) for s, n, w in sources]
    plan = spark.createDataFrame(rows, f"source {docs.schema['source'].dataType.simpleString()}, source_size long, target double, ratio double, blocks int").withColumnRenamed("source", "s")
    with_plan = sized.join(plan, sized["source"].eqNullSafe(plan["s"])).drop("s")
    ratio = F.when(F.col("ratio") >= most, F.lit(float(most))).otherwise(F.col("ratio"))
    units = with_plan.withColumn("base", F.floor(ratio + EPS)).withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("base")))
    units = units.withColumn("order", F.xxhash64("doc_id", "size", "source")).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "order"), F.col("blocks")).cast("int")).drop("ratio")
    flies = (F.col("p") > EPS) & (F.col("size") > 0)
    done = [units.filter(~flies).withColumn("p", F.lit(0.0))]
    air, most_blocks = units.filter(flies), max([r[4] for r in rows], default=1)
    while True:
        last = most_blocks == 1
        flown = save(air.groupBy("source", "block").applyInArrow(_fly(last), air.schema), "flight")
        settled = F.col("p").isin(0.0, 1.0)
        done.append(flown.filter(settled))
        if last:
            break
        most_blocks = -(-2 * most_blocks // block)
        air = flown.filter(~settled).withColumn("block", F.pmod(F.col("block"), F.lit(most_blocks)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    times = (F.col("base") + F.col("p")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "times")
