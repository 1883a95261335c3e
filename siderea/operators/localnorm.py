"""Local normalisation: per-tile affine coefficients towards a reference, repaired, interpolated and applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderea.operators.compare import ratio
from siderea.operators.stack import pop_std


def tile_of(c: str, n: int) -> Column:
    return F.expr(f"cast({c} div {n} as int)")


def coefficients(pairs: DataFrame, by: list[str], centre: str = "mean", eps: float = 1e-6) -> DataFrame:
    """pairs (by, c, r): scale and offset that bring c's centre and deviation to r's; statuses empty, offset_only, ok."""
    ok = F.col("c").isNotNull() & F.col("r").isNotNull()
    both = lambda e: F.when(ok, e)
    n = F.count(both(F.col("c")))
    mid = (lambda col: F.percentile(both(F.col(col)), F.lit(0.5))) if centre == "median" else (lambda col: ratio(F.sum(both(F.col(col))), n))
    std = lambda col: pop_std(n, F.sum(both(F.col(col))), F.sum(both(F.col(col) * F.col(col))))
    s = pairs.groupBy(*by).agg(n.alias("n"), mid("c").alias("mc"), mid("r").alias("mr"), F.when(n > 0, std("c")).alias("sc"), F.when(n > 0, std("r")).alias("sr"))
    status = F.when(F.col("n") == 0, "empty").when((F.col("sc") <= eps) | (F.col("sr") <= eps), "offset_only").otherwise("ok")
    scale = F.when(F.col("status") == "ok", F.try_divide(F.col("sr"), F.col("sc"))).otherwise(1.0)
    s = s.withColumn("status", status).withColumn("scale", scale)
    return s.withColumn("offset", F.when(F.col("status") == "empty", 0.0).otherwise(F.col("mr") - F.col("mc") * F.col("scale"))).select(*by, "n", "scale", "offset", "status")


def grid_coefficients(images: DataFrame, reference: DataFrame, tile: int, centre: str = "mean") -> DataFrame:
    """images (frame, y, x, v) against reference (y, x, v): coefficients by frame and tile."""
    pairs = images.select("frame", "y", "x", F.col("v").alias("c")).join(reference.select("y", "x", F.col("v").alias("r")), ["y", "x"])
    return coefficients(pairs.withColumns({"ty": tile_of("y", tile), "tx": tile_of("x", tile)}), ["frame", "ty", "tx"], centre)


def fill_nearest(grid: DataFrame, by: list[str], default: float) -> DataFrame:
    """grid (by, ty, tx, value, valid): invalid cells take the nearest valid cell's value, the first by row and column of equals.

    The cells of one grid meet each other, by its key: some hundred per frame.
    """
    bad = grid.filter(~F.col("valid")).select(*by, "ty", "tx")
    good = grid.filter("valid").select(*by, F.col("ty").alias("gy"), F.col("tx").alias("gx"), "value")
    d = (F.col("ty") - F.col("gy")) * (F.col("ty") - F.col("gy")) + (F.col("tx") - F.col("gx")) * (F.col("tx") - F.col("gx"))
    near = bad.join(good, by, "left").groupBy(*by, "ty", "tx").agg(F.min(F.when(F.col("gy").isNotNull(), F.struct(d.alias("d"), "gy", "gx", "value"))).alias("m"))
    filled = near.select(*by, "ty", "tx", F.coalesce(F.col("m.value"), F.lit(float(default))).alias("value"))
    return grid.filter("valid").select(*by, "ty", "tx", F.col("value").cast("double").alias("value")).unionByName(filled)


def _between(pixels: DataFrame, c: str, tile: int, length: int, cells: int) -> DataFrame:
    """Lower cell and weight of the upper one along one axis, centres of tiles being the nodes; clamped at the ends."""
    centre = lambda i: (i * tile + F.least(F.lit(length), (i + 1) * tile) - 1) / 2.0
    k = F.least(F.greatest(F.floor((F.col(c) - (tile - 1) / 2.0) / tile).cast("int"), F.lit(0)), F.lit(max(cells - 2, 0)))
    a, b = centre(k), centre(k + 1)
    t = F.least(F.greatest((F.col(c) - a) / (b - a), F.lit(0.0)), F.lit(1.0))
    return pixels.withColumns({f"{c}k": k, f"{c}t": F.lit(0.0) if cells == 1 else t})


def bilinear_field(grid: DataFrame, pixels: DataFrame, by: list[str], tile: int, height: int, width: int) -> DataFrame:
    """The value of grid (by, ty, tx, value) at pixels (by, y, x), linear along x, then along y."""
    rows, cols = -(-height // tile), -(-width // tile)
    p = _between(_between(pixels, "y", tile, height, rows), "x", tile, width, cols)
    corners = F.array(*[F.struct(F.least(F.col("yk") + dy, F.lit(rows - 1)).alias("ty"), F.least(F.col("xk") + dx, F.lit(cols - 1)).alias("tx"), ((F.col("yt") if dy else 1 - F.col("yt")) * (F.col("xt") if dx else 1 - F.col("xt"))).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    c = p.select(*by, "y", "x", F.explode(corners).alias("k")).select(*by, "y", "x", "k.ty", "k.tx", "k.w").join(grid, [*by, "ty", "tx"])
    return c.groupBy(*by, "y", "x").agg(F.sum(F.col("w") * F.col("value")).alias("field"))


def apply_field(v: Column, scale: Column, offset: Column, ok: Column) -> Column:
    return F.when(ok, v * scale + offset).otherwise(v.cast("double"))


def match_global(images: DataFrame, reference: DataFrame) -> DataFrame:
    """(v - median) / deviation * reference's deviation + reference's median, by frame."""
    one = lambda d, by: d.groupBy(*by).agg(F.percentile("v", F.lit(0.5)).alias("m"), pop_std(F.count("v"), F.sum("v"), F.sum(F.col("v") * F.col("v"))).alias("s"))
    r = one(reference, []).select(F.col("m").alias("rm"), F.col("s").alias("rs"))
    d = images.join(one(images, ["frame"]), "frame").crossJoin(F.broadcast(r))  # one row
    return d.withColumn("matched", F.coalesce(F.try_divide(F.col("v") - F.col("m"), F.col("s")), F.lit(0.0)) * F.col("rs") + F.col("rm")).drop("m", "s", "rm", "rs")


def rank_in(by: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
