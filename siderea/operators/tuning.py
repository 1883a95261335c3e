"""Weight proposals, frame windows, tile subsets, parameter sweeps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clipped(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def weight_proposal(rows: DataFrame, by: list[str], low: float = 0.05, high: float = 1.0) -> DataFrame:
    """rows (by, focus, value): multiplier = max(0, mean of control) / mean of focus, clipped. Values are whole numbers."""
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("value"))).cast("double"), F.count_if(c).cast("double"))
    s = rows.groupBy(*by).agg(mean(F.col("focus")).alias("focus_mean"), mean(~F.col("focus")).alias("control_mean"))
    return s.withColumn("multiplier", clipped(F.coalesce(F.try_divide(F.greatest(F.col("control_mean"), F.lit(0.0)), F.col("focus_mean")), F.lit(1.0)), low, high))


def tile_policy(rows: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """rows (tile, residual, contribution): multiplier = clip(1 - residual / contribution)."""
    return rows.withColumn("multiplier", clipped(F.coalesce(1 - F.try_divide(F.col("residual"), F.col("contribution")), F.lit(1.0)), low, high))


def frame_windows(frames: DataFrame, by: list[str], order: str, sizes: list[int], stride: int = 1) -> DataFrame:
    """Contiguous runs of frames of given sizes, every `stride` frames: by, size, first, last, total (of value)."""
    w = Window.partitionBy(*by).orderBy(order)
    d = frames.withColumn("i", F.row_number().over(w) - 1)
    out = None
    for n in sizes:
        r = w.rowsBetween(0, n - 1)
        one = d.select(*by, F.lit(n).alias("size"), F.col(order).alias("first"), F.max(order).over(r).alias("last"), F.sum("value").over(r).alias("total"), F.count("*").over(r).alias("k"), "i").filter((F.col("k") == n) & (F.col("i") % stride == 0))
        out = one if out is None else out.unionByName(one)
    return out.drop("k", "i")


def sweep(grids: dict[str, DataFrame]) -> DataFrame:
    """All combinations of small tables of settings."""
    out = None
    for d in grids.values():
        out = d if out is None else out.crossJoin(d)  # settings, not data
    return out


def rank_runs(runs: DataFrame, gates: list[str], order: list[str]) -> DataFrame:
    return runs.withColumn("rank", F.row_number().over(Window.orderBy(*[F.desc(g) for g in gates], *order)))


def overlap(a: str, b: str) -> Column:
    """Area shared by rectangles a and b (y0, y1, x0, x1)."""
    side = lambda p, q: F.greatest(F.lit(0), F.least(F.col(f"{a}.{q}"), F.col(f"{b}.{q}")) - F.greatest(F.col(f"{a}.{p}"), F.col(f"{b}.{p}")))
    return side("y0", "y1") * side("x0", "x1")


def greedy_tiles(tiles: DataFrame, score: str, most: int) -> DataFrame:
    """Best first, none overlapping one already taken. tiles (id, y0, y1, x0, x1, score), of one comparison."""

    def pick(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([score, "id"], ascending=[False, True])
        kept: list = []
        for t in p.itertuples():
            if len(kept) == most:
                break
            if all(t.y1 <= k.y0 or k.y1 <= t.y0 or t.x1 <= k.x0 or k.x1 <= t.x0 for k in kept):
                kept.append(t)
        return p.loc[[k.Index for k in kept], tiles_cols]

    tiles_cols = tiles.columns
    return tiles.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(pick, tiles.schema)
