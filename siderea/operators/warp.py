"""Resampling: block means, integer shifts, and inverse mapping through kernels (nearest, bilinear, bicubic, Lanczos-3).

A target pixel reads up to (2 r)^2 taps; taps are exploded and joined to the source by pixel, all frames at once.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siderea.operators.compare import ratio


def block_mean(images: DataFrame, by: list[str], n: int) -> DataFrame:
    return images.groupBy(*by, F.expr(f"cast(y div {n} as int)").alias("y"), F.expr(f"cast(x div {n} as int)").alias("x")).agg(ratio(F.sum("v"), F.count("v")).alias("v"))


def shift(images: DataFrame, by: list[str], dx: Column, dy: Column, width: int, height: int, fill: float = 0.0) -> DataFrame:
    """Each pixel moved by whole dx, dy; coverage 0 and fill where nothing came."""
    moved = images.select(*by, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), "v")
    out = images.select(*by, "y", "x").join(moved, [*by, "y", "x"], "left")
    return out.select(*by, "y", "x", F.coalesce("v", F.lit(fill)).alias("v"), F.when(F.col("v").isNull(), 0).otherwise(1).alias("coverage"))


def cubic(d: Column, a: float = -0.5) -> Column:
    x = F.abs(d)
    return F.when(x <= 1, (a + 2) * x * x * x - (a + 3) * x * x + 1).when(x < 2, a * x * x * x - 5 * a * x * x + 8 * a * x - 4 * a).otherwise(0.0)


def sinc(d: Column) -> Column:
    return F.when(F.abs(d) < 1e-8, 1.0).otherwise(F.try_divide(F.sin(math.pi * d), math.pi * d))


def lanczos3(d: Column) -> Column:
    return F.when(F.abs(d) >= 3, 0.0).otherwise(sinc(d) * sinc(d / 3))


def linear(d: Column) -> Column:
    return F.greatest(1 - F.abs(d), F.lit(0.0))


#: Kernel and radius.
KERNELS = {"bilinear": (linear, 1), "bicubic": (cubic, 2), "lanczos3": (lanczos3, 3)}


def warp(images: DataFrame, by: list[str], matrix: list[list[float]], width: int, height: int, kernel: str = "bilinear", fill: float = 0.0, clamp: float | None = None) -> DataFrame:
    """images seen through matrix (moving to reference): v, coverage and, outside, the WARP_EDGE bit.

    clamp: keep values within [min - clamp * range, max + clamp * range] of their taps.
    """
    i = np.linalg.inv(np.asarray(matrix, float))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    d = i[2, 0] * x + i[2, 1] * y + i[2, 2]
    t = images.select(*by, "y", "x").withColumn("d", F.when(F.abs(d) > 1e-12, d))
    t = t.withColumns({"sx": (float(i[0, 0]) * x + float(i[0, 1]) * y + float(i[0, 2])) / F.col("d"), "sy": (float(i[1, 0]) * x + float(i[1, 1]) * y + float(i[1, 2])) / F.col("d")})
    if kernel == "nearest":
        f, r = None, 1
        inside = F.col("sx").between(0, width - 1) & F.col("sy").between(0, height - 1)
        taps = F.array(F.struct(F.rint("sy").cast("int").alias("ky"), F.rint("sx").cast("int").alias("kx"), F.lit(1.0).alias("k")))
    else:
        f, r = KERNELS[kernel]
        inside = F.col("sx").between(0, width - 1) & F.col("sy").between(0, height - 1)
        if r > 1:
            inside = (F.col("sx") >= r - 1) & (F.col("sx") < width - r) & (F.col("sy") >= r - 1) & (F.col("sy") < height - r)
        bx, by_ = F.floor("sx").cast("int"), F.floor("sy").cast("int")
        at = range(-r + 1, r + 1)
        taps = F.array(*[F.struct((by_ + j).alias("ky"), (bx + k).alias("kx"), (f(F.col("sy") - (by_ + j)) * f(F.col("sx") - (bx + k))).alias("k")) for j in at for k in at])
    seen = t.filter(inside).select(*by, "y", "x", F.explode(taps).alias("t")).select(*by, "y", "x", F.col("t.ky").alias("ky"), F.col("t.kx").alias("kx"), F.col("t.k").alias("k")).filter("k <> 0")
    src = images.select(*by, F.col("y").alias("ky"), F.col("x").alias("kx"), "v")
    g = seen.join(src, [*by, "ky", "kx"]).groupBy(*by, "y", "x").agg(F.sum(F.col("k") * F.col("v")).alias("s"), F.sum("k").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.try_divide(F.col("s"), F.col("w"))
    if clamp is not None and clamp >= 0:
        span = clamp * (F.col("hi") - F.col("lo"))
        v = F.least(F.greatest(v, F.col("lo") - span), F.col("hi") + span)
    out = t.select(*by, "y", "x").join(g.select(*by, "y", "x", v.alias("v")), [*by, "y", "x"], "left")
    return out.select(*by, "y", "x", F.coalesce("v", F.lit(float(fill))).alias("v"), F.when(F.col("v").isNull(), 0).otherwise(1).alias("coverage"), F.when(F.col("v").isNull(), 64).otherwise(0).alias("dq"))
