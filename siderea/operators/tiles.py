"""Images as tiles, one row each: stencils, warps and stacks in numpy, with one shuffle of tiles and their borders.

tiles (by..., y0, x0, h, w, data): data holds h rows of w values; what has no value is NaN or null. Tiles lie on a grid of `tile` pixels a side, so a
group of the functions below holds one tile of each frame (stack) or a tile and what surrounds it (stencil, warp): choose `tile` so that frames *
tile * tile * 8 bytes fit a task. Frames without a tile somewhere have no values there.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siderea.model import Rejection

TILE = "y0 int, x0 int, h int, w int, data array<double>"


def _by(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def from_pixels(images: DataFrame, by: list[str], tile: int) -> DataFrame:
    """Of images (by, y, x, v) without gaps; null is NaN."""
    corner = [F.expr(f"cast(y div {tile} * {tile} as int)").alias("y0"), F.expr(f"cast(x div {tile} * {tile} as int)").alias("x0")]
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))).alias("v"))))
    t = images.groupBy(*by, *corner).agg(cells.alias("c"), (F.max("y") + 1).alias("ye"), (F.max("x") + 1).alias("xe"))
    return t.select(*by, "y0", "x0", (F.col("ye") - F.col("y0")).alias("h"), (F.col("xe") - F.col("x0")).alias("w"), F.transform("c", lambda s: s["v"]).alias("data"))


def to_pixels(tiles: DataFrame, by: list[str], *arrays: str) -> DataFrame:
    """(by, y, x) and a column for each of arrays; what has no value is null."""
    value = lambda a: F.when(~F.isnan(F.col(f"_v.{a}").cast("double")), F.col(f"_v.{a}")).alias(a)
    p = tiles.select(*by, "y0", "x0", "w", F.posexplode(F.arrays_zip(*arrays)).alias("_i", "_v"))
    return p.select(*by, (F.col("y0") + F.expr("_i div w").cast("int")).alias("y"), (F.col("x0") + F.col("_i") % F.col("w")).alias("x"), *[value(a) for a in arrays])


def _flat(data: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, null as NaN, and where each list begins and the last ends."""
    ends = data.offsets.to_numpy()
    return np.asarray(data.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False), float), ends - ends[0]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Lists of such sizes from values in a row; NaN is null."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.float64(), mask=np.isnan(values)))


def whole_groups(df: DataFrame, keys: list[str], cells: int, run: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """run(batch, starts) over batches of whole groups, rows of equal keys; starts are the first rows of each. So many groups come at once that their
    data, and `cells` values for each, are about a million; one at least."""

    def some(b: pa.RecordBatch, starts: np.ndarray):
        ends = b.column("data").offsets.to_numpy().astype(np.int64) if "data" in b.schema.names else np.arange(b.num_rows + 1)
        ends = ends[[*starts, b.num_rows]] + np.arange(len(starts) + 1) * cells
        at, rows = 0, [*starts.tolist(), b.num_rows]
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20), "right")) - 1)
            yield run(b.slice(rows[at], rows[to] - rows[at]), starts[at:to] - rows[at])
            at = to

    def batches(it):
        left = None
        for b in it:
            if b.num_rows == 0:
                continue
            b = pa.concat_batches([left, b]) if left is not None else b
            change = np.zeros(b.num_rows - 1, bool)
            for c in keys:
                code = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                change |= code[1:] != code[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            if len(starts) > 1:
                yield from some(b.slice(0, starts[-1]), starts[:-1])
            left = b.slice(starts[-1])
        if left is not None:
            yield from some(left, np.zeros(1, np.int64))

    # a number, as Spark would otherwise put small rows into a few tasks, however long each group takes
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(batches, schema)


def stencil(tiles: DataFrame, by: list[str], tile: int, halo: int, f: Callable[[np.ndarray, int, int], dict[str, np.ndarray]], fields: str) -> DataFrame:
    """f(region, y, x) for each tile: region is the tile with `halo` (at most tile) pixels on each side, NaN beyond the image, and starts at (y, x);
    it returns columns (fields). Tiles send their neighbours borders alone."""
    part = _by(tiles, by) + "ty int, tx int, " + TILE
    kinds = to_arrow_schema(StructType.fromDDL(_by(tiles, by) + fields))

    def borders(it):
        for b in it:
            y0, x0, h, w = (b.column(c).to_numpy() for c in ("y0", "x0", "h", "w"))
            v, at = _flat(b.column("data"))
            for hh, ww in sorted(set(zip(h.tolist(), w.tolist(), strict=True))):
                alike = np.flatnonzero((h == hh) & (w == ww))
                a = v[at[alike][:, None] + np.arange(hh * ww)].reshape(-1, hh, ww)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        ys, xs = (slice(0, min(halo, n)) if d < 0 else slice(max(0, n - halo), n) if d > 0 else slice(0, n) for d, n in ((dy, hh), (dx, ww)))
                        ty, tx = y0[alike] // tile + dy, x0[alike] // tile + dx
                        there = (ty >= 0) & (tx >= 0)
                        piece = a[there, ys, xs]
                        if not piece.size:
                            continue
                        n, size = len(piece), piece.shape[1:]
                        own = alike[there]
                        numbers = [ty[there], tx[there], y0[own] + ys.start, x0[own] + xs.start, np.full(n, size[0]), np.full(n, size[1])]
                        keys = b.select(by).take(pa.array(own)).columns
                        yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c.astype(np.int32)) for c in numbers], _lists(piece.ravel(), np.full(n, size[0] * size[1]))], names=[*by, "ty", "tx", "y0", "x0", "h", "w", "data"])

    def run(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        ty, tx, y0, x0, h, w = (b.column(c).to_pylist() for c in ("ty", "tx", "y0", "x0", "h", "w"))
        v, at = _flat(b.column("data"))
        got, rows = [], []
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
            i, j = ty[first], tx[first]
            own = [k for k in range(first, end) if y0[k] // tile == i and x0[k] // tile == j]
            if not own:  # a border beyond the image
                continue
            y, x, tall, wide = i * tile - halo, j * tile - halo, h[own[0]] + 2 * halo, w[own[0]] + 2 * halo
            region = np.full((tall, wide), np.nan)
            for k in range(first, end):
                a, c = y0[k] - y, x0[k] - x
                if a < tall and c < wide:
                    region[a : a + h[k], c : c + w[k]] = v[at[k] : at[k + 1]].reshape(h[k], w[k])[: tall - a, : wide - c]
            got.append(f(region, y, x))
            rows.append(first)
        columns = [np.concatenate([np.asarray(g[c]) for g in got]) if got else np.zeros(0) for c in names]
        keys = b.select(by).take(pa.array(np.repeat(rows, [len(g[names[0]]) for g in got]).astype(np.int64))).columns
        return pa.RecordBatch.from_arrays([*keys, *[pa.array(c, mask=np.isnan(c) if c.dtype.kind == "f" else None).cast(kinds.field(n).type) for n, c in zip(names, columns, strict=True)]], names=[*by, *names])

    names = [x.split()[0] for x in fields.split(", ")]
    return whole_groups(tiles.select(*by, "y0", "x0", "h", "w", "data").mapInArrow(borders, part), [*by, "ty", "tx"], tile * tile, run, _by(tiles, by) + fields)


def local_maxima(tiles: DataFrame, by: list[str], tile: int, threshold: float) -> DataFrame:
    """(by, y, x, v): pixels above threshold that none of eight neighbours exceeds; the image's edge has none."""

    def f(a: np.ndarray, y0: int, x0: int) -> dict[str, np.ndarray]:
        c = a[1:-1, 1:-1]
        near = np.stack([a[1 + i : a.shape[0] - 1 + i, 1 + j : a.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
        with np.errstate(invalid="ignore"):
            y, x = np.nonzero((c > threshold) & (near <= c).all(axis=0))
        return {"y": (y + y0 + 1).astype(np.int32), "x": (x + x0 + 1).astype(np.int32), "v": c[y, x]}

    return stencil(tiles, by, tile, 1, f, "y int, x int, v double")


KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], int]] = {
    "bilinear": (lambda d: np.maximum(1 - np.abs(d), 0), 1),
    "lanczos3": (lambda d: np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0), 3),
}


def warp(tiles: DataFrame, by: list[str], matrices: DataFrame, tile: int, height: int, width: int, kernel: str = "bilinear") -> DataFrame:
    """tiles seen through each image's own matrix (by, matrix: nine numbers by row, moving to reference), on the reference's grid; NaN where the
    kernel would leave the image or meets no value. A source tile goes to the target tiles that its corners, moved, enclose."""
    k_, r = KERNELS[kernel]
    side = _by(tiles, by) + "ty int, tx int, matrix array<double>, " + TILE
    rows_of, cols_of = -(-height // tile), -(-width // tile)
    cells = F.explode(F.sequence(F.lit(0), F.lit(rows_of * cols_of - 1)))
    # every target tile exists, whether any source falls on it or not
    grid = matrices.select(*by, "matrix", cells.alias("_c")).select(*by, F.expr(f"cast(_c div {cols_of} as int)").alias("ty"), F.expr(f"cast(_c % {cols_of} as int)").alias("tx"), "matrix", *[F.lit(0).alias(c) for c in ("y0", "x0", "h", "w")], F.array().cast("array<double>").alias("data"))

    def spread(it):
        for b in it:
            y0, x0, h, w = (b.column(c).to_numpy().astype(float) for c in ("y0", "x0", "h", "w"))
            m = _flat(b.column("matrix"))[0].reshape(-1, 3, 3)
            ys, xs = (y0 - r, y0 + h - 1 + r), (x0 - r, x0 + w - 1 + r)
            c = np.stack([np.stack([x, y, np.ones(len(x))], axis=1) for y in ys for x in xs], axis=1) @ m.transpose(0, 2, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                c = c[:, :, :2] / c[:, :, 2:]
                lo, hi = np.floor(c.min(axis=1)).astype(int), np.ceil(c.max(axis=1)).astype(int)
            (fx, fy), (lx, ly) = np.maximum(lo // tile, 0).T, np.minimum(hi // tile, [cols_of - 1, rows_of - 1]).T
            wide, tall = np.maximum(lx - fx + 1, 0), np.maximum(ly - fy + 1, 0)
            own = np.repeat(np.arange(b.num_rows), wide * tall)
            i = np.arange(len(own)) - np.repeat(np.cumsum(wide * tall) - wide * tall, wide * tall)
            p = b.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*p.select(by).columns, pa.array((fy[own] + i // wide[own]).astype(np.int32)), pa.array((fx[own] + i % wide[own]).astype(np.int32)), *p.select(["matrix", "y0", "x0", "h", "w", "data"]).columns], names=[*by, "ty", "tx", "matrix", "y0", "x0", "h", "w", "data"])

    def run(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        ty, tx = (b.column(c).to_numpy()[starts].astype(np.int64) for c in ("ty", "tx"))
        of = np.repeat(np.arange(len(starts)), np.diff([*starts, b.num_rows]))
        v, at = _flat(b.column("data"))
        y0, x0, h, w = (b.column(c).to_numpy().astype(np.int64) for c in ("y0", "x0", "h", "w"))
        # a canvas for each group, in a row, from its pieces; a group without any has none
        some, far = h > 0, np.iinfo(np.int64).max
        cy, cx, ey, ex = np.full(len(starts), far), np.full(len(starts), far), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for into, reduce, values in ((cy, np.minimum, y0), (cx, np.minimum, x0), (ey, np.maximum, y0 + h), (ex, np.maximum, x0 + w)):
            reduce.at(into, of[some], values[some])
        empty = cy == far
        cy[empty] = cx[empty] = 0
        ch, cw = np.where(empty, 0, ey - cy), np.where(empty, 0, ex - cx)
        base = np.concatenate([[0], np.cumsum(ch * cw)])
        a = np.full(base[-1] + 1, np.nan)
        k = np.repeat(np.arange(b.num_rows), np.diff(at))
        n = np.arange(len(v)) - at[:-1][k]
        a[base[of[k]] + (y0[k] + n // w[k] - cy[of[k]]) * cw[of[k]] + x0[k] + n % w[k] - cx[of[k]]] = v
        # the target's pixels, in a row
        high, wide = np.minimum(height, (ty + 1) * tile) - ty * tile, np.minimum(width, (tx + 1) * tile) - tx * tile
        g = np.repeat(np.arange(len(starts)), high * wide)
        n = np.arange(len(g)) - np.repeat(np.cumsum(high * wide) - high * wide, high * wide)
        y, x = (ty[g] * tile + n // wide[g]).astype(float), (tx[g] * tile + n % wide[g]).astype(float)
        i = np.linalg.inv(_flat(b.column("matrix").take(pa.array(starts)))[0].reshape(-1, 3, 3))[g].transpose(1, 2, 0)
        d = i[2, 0] * x + i[2, 1] * y + i[2, 2]
        d = np.where(np.abs(d) > 1e-12, d, np.nan)
        sx, sy = (i[0, 0] * x + i[0, 1] * y + i[0, 2]) / d, (i[1, 0] * x + i[1, 1] * y + i[1, 2]) / d
        lo = r - 1 if r > 1 else 0
        with np.errstate(invalid="ignore"):
            ok = (sx >= lo) & (sy >= lo) & ((sx < width - r) & (sy < height - r) if r > 1 else (sx <= width - 1) & (sy <= height - 1))
        out, g, sy, sx = np.full(y.shape, np.nan), g[ok], sy[ok], sx[ok]
        fy, fx = np.floor(sy).astype(np.int64), np.floor(sx).astype(np.int64)
        total, weight = np.zeros(len(fy)), np.zeros(len(fy))
        for p in range(-r + 1, r + 1):
            for q in range(-r + 1, r + 1):
                s = k_(sy - (fy + p)) * k_(sx - (fx + q))
                yy, xx = fy + p - cy[g], fx + q - cx[g]
                there = (yy >= 0) & (xx >= 0) & (yy < ch[g]) & (xx < cw[g]) & (s != 0)
                c = a[np.where(there, base[g] + yy * cw[g] + xx, len(a) - 1)]
                use = np.isfinite(c)
                total += np.where(use, s * c, 0)
                weight += np.where(use, s, 0)
        out[ok] = np.where(np.abs(weight) > 1e-12, total / np.where(weight == 0, 1, weight), np.nan)
        return pa.RecordBatch.from_arrays([*b.select(by).take(pa.array(starts)).columns, *[pa.array(c.astype(np.int32)) for c in (ty * tile, tx * tile, high, wide)], _lists(out, high * wide)], names=[*by, "y0", "x0", "h", "w", "data"])

    moved = tiles.join(matrices, by).select(*by, "matrix", "y0", "x0", "h", "w", "data").mapInArrow(spread, side)
    return whole_groups(moved.unionByName(grid), [*by, "ty", "tx"], tile * tile, run, _by(tiles, by) + TILE)


def rejected(cube: np.ndarray, policy: Rejection) -> tuple[np.ndarray, np.ndarray]:
    """Which values (frames first) are flagged low and high, guard included; the statistics of siderea.operators.stack without rounding."""
    ok = np.isfinite(cube)
    low, high = np.zeros(cube.shape, bool), np.zeros(cube.shape, bool)
    with np.errstate(invalid="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # pixels without any value
        for _ in range(policy.iterations if policy.method != "none" else 0):
            live = np.where(ok & ~low & ~high, cube, np.nan)
            if policy.method == "minmax":
                lo, hi = live == np.nanmin(live, axis=0), live == np.nanmax(live, axis=0)
                spread = np.nanmin(live, axis=0) < np.nanmax(live, axis=0)
                lo, hi = lo & spread, hi & spread
            else:
                centre, scale = np.nanmedian(live, axis=0), np.nanstd(live, axis=0)
                if policy.method in ("mad", "median_sigma"):
                    scale = 1.4826 * np.nanmedian(np.abs(live - centre), axis=0)
                elif policy.method == "winsorized_sigma":
                    q1, q3 = np.nanpercentile(live, [25, 75], axis=0)
                    scale = np.where(q3 > q1, (q3 - q1) / 1.349, scale)
                    drawn = np.clip(live, centre - policy.low * scale, centre + policy.high * scale)
                    centre, std = np.nanmean(drawn, axis=0), np.nanstd(drawn, axis=0)
                    scale = np.where(std > 0, std, scale)
                elif policy.method not in ("sigma", "sigma_clip"):
                    raise ValueError(f"no such rejection: {policy.method}")
                lo, hi = (scale > 0) & (live < centre - policy.low * scale), (scale > 0) & (live > centre + policy.high * scale)
            n, gone = np.isfinite(live).sum(axis=0), (lo | hi).sum(axis=0)
            go = (n - gone >= policy.min_samples) & (gone <= n * policy.max_fraction)
            low |= lo & go
            high |= hi & go & ~lo
    return low, high


def stack(tiles: DataFrame, by: list[str], order: str, rejection: Rejection = Rejection()) -> DataFrame:
    """Mean over the frames of each group: by, the tile, master, coverage, n_low, n_high (arrays). order: a column by which frames are summed, so
    that reruns agree to the bit."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        cube = np.stack([np.asarray(d, float) for d in p["data"]])
        low, high = rejected(cube, rejection)
        keep = np.isfinite(cube) & ~low & ~high
        n = keep.sum(axis=0)
        row = {c: p[c].iloc[0] for c in [*by, "y0", "x0", "h", "w"]}
        return pd.DataFrame([{**row, "master": np.where(n > 0, np.where(keep, cube, 0).sum(axis=0) / np.maximum(n, 1), 0.0), "coverage": n.astype(np.int32), "n_low": low.sum(axis=0).astype(np.int32), "n_high": high.sum(axis=0).astype(np.int32)}])

    fields = "y0 int, x0 int, h int, w int, master array<double>, coverage array<int>, n_low array<int>, n_high array<int>"
    return tiles.select(*by, order, "y0", "x0", "h", "w", "data").groupBy(*by, "y0", "x0").applyInPandas(one, _by(tiles, by) + fields)
