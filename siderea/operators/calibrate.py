"""Master frames and the calibration of lights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siderea.model import Rejection
from siderea.operators.stack import stack

PIXEL = ["y", "x"]


def master(images: DataFrame, by: list[str], rejection: Rejection = Rejection("winsorized_sigma")) -> DataFrame:
    """One image per group: the stack of its frames (by, y, x, master, coverage)."""
    return stack(images, [*by, *PIXEL], "mean", rejection).select(*by, *PIXEL, "master", "coverage")


def master_flat(flats: DataFrame, bias: DataFrame, by: list[str], floor: float = 1e-6, flat_dark: DataFrame | None = None) -> DataFrame:
    """Each flat less the bias, and less the master of its darks if there is one, is divided by its own median; their mean is the flat, at
    least `floor`."""
    d = flats.join(bias.select(*by, *PIXEL, F.col("master").alias("b")), [*by, *PIXEL], "left")
    less = F.coalesce("b", F.lit(0.0))
    if flat_dark is not None:
        d = d.join(flat_dark.select(*by, *PIXEL, F.col("master").alias("fd")), [*by, *PIXEL], "left")
        less = less + F.coalesce("fd", F.lit(0.0))
    d = d.withColumn("r", F.round(F.col("v") - less).cast("bigint"))
    level = d.groupBy(*by, "frame").agg(F.percentile("r", F.lit(0.5)).alias("level"))
    # in millionths of the level, so that the sum is exact
    n = d.join(level, [*by, "frame"]).withColumn("n", F.round(F.try_divide(F.col("r") * 1000000, F.col("level"))).cast("bigint"))
    out = n.groupBy(*by, *PIXEL).agg((F.try_divide(F.sum("n").cast("double"), F.count("n").cast("double")) / 1000000).alias("flat"))
    return out.withColumn("flat", F.greatest("flat", F.lit(floor)))


def calibrated(v: Column, bias: Column, dark: Column, flat: Column, t_light: Column, t_dark: Column, floor: float = 1e-6, pedestal: float = 0.0, dark_includes_bias: bool = True) -> Column:
    """v less the scaled dark (or the bias where there is no dark), over the flat, plus the pedestal."""
    scale = F.when(t_dark.isNotNull() & (t_dark != 0) & t_light.isNotNull(), F.try_divide(t_light, t_dark)).otherwise(1.0)
    base = v - dark * scale
    if not dark_includes_bias:
        base = base - F.coalesce(bias, F.lit(0.0))
    less = F.when(dark.isNotNull(), base).otherwise(v - F.coalesce(bias, F.lit(0.0)))
    return F.when(flat.isNotNull(), less / F.greatest(flat, F.lit(floor))).otherwise(less) + pedestal


def overscan(images: DataFrame, width: int, height: int, columns: int, rows: int, trim: bool = True) -> DataFrame:
    """Subtract each frame's median over the last columns and the last rows; a pixel of the corner counts twice."""
    strip = images.filter(F.col("x") >= width - columns).select("frame", "v").unionAll(images.filter(F.col("y") >= height - rows).select("frame", "v"))
    level = strip.groupBy("frame").agg(F.percentile("v", F.lit(0.5)).alias("level"))
    out = images.join(level, "frame", "left").withColumn("v", F.col("v") - F.coalesce("level", F.lit(0.0))).drop("level")
    return out.filter((F.col("x") < width - columns) & (F.col("y") < height - rows)) if trim else out


def image_stats(images: DataFrame, by: list[str]) -> DataFrame:
    """min, max, mean, median and population deviation, by group; whole numbers are summed exactly."""
    n, s = F.count("v").cast("double"), F.sum("v").cast("double")
    ss = F.sum(F.col("v") * F.col("v")).cast("double")
    std = F.sqrt(F.greatest(F.try_divide(ss - F.try_divide(s * s, n), n), F.lit(0.0)))
    return images.groupBy(*by).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.try_divide(s, n).alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), std.alias("std"))


def robust_background(images: DataFrame, by: list[str]) -> DataFrame:
    """median, mad, noise (1.4826 mad, else the deviation, else 1), by group."""
    med = images.groupBy(*by).agg(F.percentile("v", F.lit(0.5)).alias("median"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.count("v").alias("n"))
    off = images.join(med, by).groupBy(*by).agg(F.percentile(F.abs(F.col("v") - F.col("median")), F.lit(0.5)).alias("mad"))
    d, s, ss = (F.col(c).cast("double") for c in ("n", "s", "ss"))
    std = F.sqrt(F.greatest((ss - s * s / d) / d, F.lit(0.0)))
    noise = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).when(std > 0, std).otherwise(1.0)
    return med.join(off, by).select(*by, "median", "mad", std.alias("std"), noise.alias("noise"), "n")


def cosmetic(images: DataFrame, by: list[str], hot: float = 8.0, cold: float = 8.0) -> DataFrame:
    """Pixels beyond median -+ k noise become the median and get their bits."""
    b = robust_background(images, by).select(*by, "median", "noise")
    d = images.join(b, by)
    h, c = F.col("v") > F.col("median") + hot * F.col("noise"), F.col("v") < F.col("median") - cold * F.col("noise")
    return d.withColumns({"dq": F.when(h, 4 + 32).when(c, 8 + 32).otherwise(0), "fixed": F.when(h | c, F.col("median")).otherwise(F.col("v").cast("double"))}).drop("median", "noise")


def neighbours(images: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """Each pixel with its eight neighbours (by, y, x, v, nv); beyond the edge the nearest pixel stands in.

    Eight copies per row: for images of some hundred pixels a side use packed tiles instead.
    """
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    at = images.select(*by, "y", "x", "v", F.explode(steps).alias("s"))
    at = at.select(*by, "y", "x", "v", F.least(F.greatest(F.col("y") + F.col("s.dy"), F.lit(0)), F.lit(height - 1)).alias("ny"), F.least(F.greatest(F.col("x") + F.col("s.dx"), F.lit(0)), F.lit(width - 1)).alias("nx"))
    return at.join(images.select(*by, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("nv")), [*by, "ny", "nx"]).drop("ny", "nx")


def isolated_defects(images: DataFrame, by: list[str], width: int, height: int, hot: float = 8.0, structure: float = 1.5, support: int = 2) -> DataFrame:
    """Hot pixels that also stand out of their neighbourhood and have fewer than `support` bright neighbours."""
    b = robust_background(images, by).select(*by, "median", "noise")
    n = neighbours(images, by, width, height).join(b, by)
    limit = F.col("median") + hot * F.col("noise")
    near = n.groupBy(*by, "y", "x").agg(F.first("v").alias("v"), F.first("median").alias("median"), F.first("noise").alias("noise"), F.percentile("nv", F.lit(0.5)).alias("local"), F.count_if(F.col("nv") > F.col("median") + structure * F.col("noise")).alias("bright"))
    return near.filter((F.col("v") > limit) & (F.col("v") > F.col("local") + hot * F.col("noise")) & (F.col("bright") < support)).select(*by, "y", "x", "v", "local", "bright")
