"""Stars: local maxima, moments, the best of each cell, greedy suppression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siderea.operators.calibrate import neighbours, robust_background


def local_maxima(images: DataFrame, by: list[str], width: int, height: int, threshold) -> DataFrame:
    """Inner pixels above threshold that no neighbour exceeds."""
    n = neighbours(images, by, width, height).groupBy(*by, "y", "x").agg(F.first("v").alias("v"), F.max("nv").alias("most"))
    return n.filter((F.col("v") >= F.col("most")) & (F.col("v") > threshold) & (F.col("y") > 0) & (F.col("x") > 0) & (F.col("y") < height - 1) & (F.col("x") < width - 1)).select(*by, "y", "x", "v")


def measure(candidates: DataFrame, images: DataFrame, by: list[str], radius: int = 4) -> DataFrame:
    """Flux above the background, centroid, second moments, signal to noise, sharpness in the patch around each candidate."""
    b = robust_background(images, by).select(*by, "median", "noise")
    side = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)])
    spots = candidates.select(*by, F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("v").alias("cv"), F.explode(side).alias("s"))
    spots = spots.withColumns({"y": F.col("cy") + F.col("s.dy"), "x": F.col("cx") + F.col("s.dx")}).drop("s")
    p = spots.join(images.select(*by, "y", "x", "v"), [*by, "y", "x"]).join(b, by)
    p = p.withColumn("g", F.greatest(F.col("v") - F.col("median"), F.lit(0.0)))
    m = p.groupBy(*by, "cy", "cx").agg(F.first("cv").alias("cv"), F.first("median").alias("median"), F.first("noise").alias("noise"), F.count_if(F.col("g") > 0).alias("npix"),
        *[F.sum(e).alias(a) for a, e in (("flux", F.col("g")), ("gx", F.col("g") * F.col("x")), ("gy", F.col("g") * F.col("y")), ("gxx", F.col("g") * F.col("x") * F.col("x")), ("gyy", F.col("g") * F.col("y") * F.col("y")), ("gxy", F.col("g") * F.col("x") * F.col("y")))])
    m = m.filter("flux > 0").withColumns({"sx": F.col("gx") / F.col("flux"), "sy": F.col("gy") / F.col("flux")})
    m = m.withColumns({"mxx": F.col("gxx") / F.col("flux") - F.col("sx") * F.col("sx"), "myy": F.col("gyy") / F.col("flux") - F.col("sy") * F.col("sy"), "mxy": F.col("gxy") / F.col("flux") - F.col("sx") * F.col("sy")})
    trace = F.greatest(F.col("mxx") + F.col("myy"), F.lit(0.0))
    root = F.sqrt(F.greatest((F.col("mxx") - F.col("myy")) * (F.col("mxx") - F.col("myy")) + 4 * F.col("mxy") * F.col("mxy"), F.lit(0.0)))
    major, minor = F.greatest((trace + root) / 2, F.lit(0.0)), F.greatest((trace - root) / 2, F.lit(0.0))
    sigma = F.sqrt(F.greatest((major + minor) / 2, F.lit(0.0)))
    peak = F.greatest(F.col("cv") - F.col("median"), F.lit(0.0))
    return m.select(*by, F.col("cy").alias("y"), F.col("cx").alias("x"), "sx", "sy", "flux", peak.alias("peak"), F.when(sigma > 0, sigma * 2.354820045).alias("fwhm"), F.when(major > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - minor / major))).alias("ecc"),
        (F.col("flux") / F.greatest(F.col("noise") * F.sqrt(F.greatest(F.col("npix"), F.lit(1)).cast("double")), F.lit(1e-6))).alias("snr"), (peak / F.greatest("flux", F.lit(1e-6))).alias("sharpness"), "npix")


def top_per_cell(stars: DataFrame, by: list[str], cell: int, k: int, flux: str = "v") -> DataFrame:
    """The k brightest of each cell; Spark cuts each task's rows to k before it shuffles them."""
    w = Window.partitionBy(*by, "cy", "cx").orderBy(F.desc(flux), "y", "x")
    d = stars.withColumns({"cy": F.expr(f"cast(y div {cell} as int)"), "cx": F.expr(f"cast(x div {cell} as int)")})
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def suppress(stars: DataFrame, by: list[str], separation: float, most: int, flux: str = "v") -> DataFrame:
    """Greedy: brightest first, none nearer than separation to one already taken; at most `most` per group. Sequential by
    nature, one group of at most some thousand candidates at a time."""

    def pick(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([flux, "y", "x"], ascending=[False, True, True])
        taken: list[tuple[float, float]] = []
        rows = []
        for i, y, x in zip(p.index, p["y"], p["x"], strict=True):
            if len(taken) == most:
                break
            if all((y - a) ** 2 + (x - b) ** 2 >= separation**2 for a, b in taken):
                taken.append((y, x))
                rows.append(i)
        return p.loc[rows]

    return stars.groupBy(*by).applyInPandas(pick, stars.schema)


def render(width: int, height: int, stars: DataFrame, sigma: float = 1.4) -> DataFrame:
    """Sum of Gaussians per pixel; stars (sx, sy, flux)."""
    spark = stars.sparkSession
    px = spark.range(width * height).select(F.expr(f"cast(id div {width} as int)").alias("y"), F.expr(f"cast(id % {width} as int)").alias("x"))
    reach = int(6 * sigma) + 1  # beyond it a star adds less than 1e-7 of its flux
    cells = stars.withColumn("x", F.explode(F.sequence(F.floor(F.col("sx") - reach).cast("int"), F.ceil(F.col("sx") + reach).cast("int")))).withColumn("y", F.explode(F.sequence(F.floor(F.col("sy") - reach).cast("int"), F.ceil(F.col("sy") + reach).cast("int"))))
    g = F.col("flux") * F.exp(-((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2) / (2 * sigma * sigma))
    return px.join(cells.withColumn("g", g), ["y", "x"], "left").groupBy("y", "x").agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("v"))

