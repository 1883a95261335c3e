"""Connected components of a graph of links, without ever holding an unbounded component or all links in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siderea.llm.common import save

#: So few links are joined by one task; more are contracted first.
FEW = 100_000
ROWS_IN_A_FILE = 500_000


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x in batches:
        a += x.column("a").to_pylist()
        b += x.column("b").to_pylist()
    root, node = spanning(a, b)
    tops = sorted(set(root))
    yield pa.RecordBatch.from_arrays([pa.array(node + tops, pa.int64()), pa.array(root + tops, pa.int64())], ["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for each node of edges (a, b: longs): root is one node of its component, the same for all.

    Each round gives every node the least of itself and its neighbours as parent (a minimum, summed before the shuffle), jumps
    once to the parent's parent and contracts the links onto the parents. Nodes that aren't a least neighbour vanish, so the
    number of rounds grows with the logarithm of a component's width. When at most `few` links are left, one task joins them.
    Each round's tables are written, which cuts lineage; they shrink from round to round, and so do their files.
    """
    links = save(_ordered(edges), "links")
    roots: DataFrame | None = None
    size = 0
    while (rows := links.count()) > few:
        files = -(-rows // ROWS_IN_A_FILE)
        size = max(size, files)
        near = links.union(links.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        parent = save(near.select(F.col("a").alias("node"), F.least("a", "m").alias("parent")).coalesce(files), "parents")
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        step = save(parent.join(above, "parent").select("node", F.col("next").alias("root")).coalesce(files), "roots")
        roots = step if roots is None else save(_onward(roots, step).coalesce(size), "roots")
        left = step.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("y"))
        links = save(_ordered(links.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))).coalesce(files), "links")
    if not rows:
        return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    last = save(links.coalesce(1).mapInArrow(_joined, "node long, root long"), "roots")
    return last if roots is None else save(_onward(roots, last).coalesce(size), "roots")


def _onward(roots: DataFrame, step: DataFrame) -> DataFrame:
    onward = step.select(F.col("node").alias("root"), F.col("root").alias("r"))
    return roots.join(onward, "root", "left").select("node", F.coalesce("r", "root").alias("root"))


def spanning(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Fewest links that join what these join: each node with the least of its group."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    found = [(root(x), x) for x in up]
    found = [(r, x) for r, x in found if r != x]
    return [r for r, _ in found], [x for _, x in found]
