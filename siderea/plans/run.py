"""From a folder of image files to a master per filter, on tiles; and the tile operators as queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siderea.model import Rejection
from siderea.operators import register, tiles
from siderea.plans import queries as Q
from siderea.plans.queries import IMAGES_SQL, ORACLE, STD, query
from siderea.sources import fits
from siderea.sources.shared import shared_folder
from siderea.sources.tables import images

NO_SENSOR = "none"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what follows reads it more than once, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def frame_tiles(spark: SparkSession, folder: str, tile: int) -> tuple[DataFrame, DataFrame]:
    """The manifest (with sensor, a key of what calibration frames must share) and all tiles (frame_id, frame_type, filter, sensor, exposure_s)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(NO_SENSOR)) for c in ("gain", "offset", "binning_x", "binning_y", "width", "height")]
    manifest = kept(fits.scan(spark, folder).withColumn("sensor", F.concat_ws("/", *parts)), "manifest")
    spark.dataSource.register(fits.FitsSource)
    t = spark.read.format("fits").option("tile", tile).load(folder).withColumn("data", F.col("data").cast("array<double>"))
    cols = ["path", "frame_id", "frame_type", F.coalesce("filter", F.lit(NO_SENSOR)).alias("filter"), "sensor", "exposure_s"]
    return manifest, t.join(manifest.filter("frame_id is not null").select(*cols), "path").drop("path")


def masters(t: DataFrame, rejection: Rejection) -> tuple[DataFrame, DataFrame]:
    """Of tiles: the dark of each sensor with its mean exposure, else the bias, and the flat of each sensor and filter, mean one."""
    one = lambda kind, by: tiles.stack(t.filter(F.col("frame_type") == kind), by, "frame_id", rejection)
    exposure = t.filter("frame_type = 'dark'").groupBy("sensor").agg(F.avg("exposure_s").alias("t_dark"))
    dark = one("dark", ["sensor"]).select("sensor", "y0", "x0", F.col("master").alias("dark")).join(exposure, "sensor")
    bias = one("bias", ["sensor"]).select("sensor", "y0", "x0", F.col("master").alias("bias"))
    flat = one("flat", ["sensor", "filter"]).select("sensor", "filter", "y0", "x0", F.col("master").alias("raw")).join(bias, ["sensor", "y0", "x0"], "left")
    flat = flat.withColumn("flat", F.when(F.col("bias").isNull(), F.col("raw")).otherwise(F.zip_with("raw", "bias", lambda a, b: a - b)))
    level = flat.select("sensor", "filter", F.explode("flat").alias("f")).groupBy("sensor", "filter").agg(F.avg("f").alias("level"))
    flat = flat.join(level, ["sensor", "filter"]).select("sensor", "filter", "y0", "x0", F.transform("flat", lambda f: f / F.col("level")).alias("flat"))
    return dark.join(bias, ["sensor", "y0", "x0"], "full_outer"), flat


def calibrated(t: DataFrame, dark: DataFrame, flat: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Light tiles less the dark, scaled to their exposure (or the bias where there is no dark), over the flat."""
    d = t.filter("frame_type = 'light'").join(dark, ["sensor", "y0", "x0"], "left").join(flat, ["sensor", "filter", "y0", "x0"], "left")
    scale = F.coalesce(F.try_divide("exposure_s", F.when(F.col("t_dark") != 0, F.col("t_dark"))), F.lit(1.0))
    less = F.when(F.col("dark").isNotNull(), F.zip_with("data", "dark", lambda v, b: v - b * scale)).when(F.col("bias").isNotNull(), F.zip_with("data", "bias", lambda v, b: v - b)).otherwise(F.col("data"))
    d = d.withColumn("data", less)
    over = F.when(F.col("flat").isNotNull(), F.zip_with("data", "flat", lambda v, f: v / F.greatest(f, F.lit(floor)))).otherwise(F.col("data"))
    return d.select("frame_id", "filter", "y0", "x0", "h", "w", over.alias("data"))


def catalogue(t: DataFrame, tile: int, sigma: float = 5.0, most: int = 200) -> DataFrame:
    """(frame, x, y, flux) of each frame's brightest local maxima above its median + sigma noise, at the centroid of their nine pixels."""
    pixels = t.select("frame_id", F.explode("data").alias("v")).filter("v is not null and not isnan(v)")
    med = pixels.groupBy("frame_id").agg(F.percentile_approx("v", F.lit(0.5), F.lit(2000)).alias("med"))
    noise = pixels.join(med, "frame_id").groupBy("frame_id", "med").agg((1.4826 * F.percentile_approx(F.abs(F.col("v") - F.col("med")), F.lit(0.5), F.lit(2000))).alias("noise"))
    base = t.join(noise, "frame_id").select(F.col("frame_id").alias("frame"), "y0", "x0", "h", "w", F.transform("data", lambda v: (v - F.col("med")) / F.greatest("noise", F.lit(1e-6))).alias("data"))

    def f(a: np.ndarray, y0: int, x0: int) -> dict[str, np.ndarray]:
        c = a[1:-1, 1:-1]
        near = np.stack([a[1 + i : a.shape[0] - 1 + i, 1 + j : a.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        with np.errstate(invalid="ignore"):
            y, x = np.nonzero((c > sigma) & (near <= c).all(axis=0))
        g = np.maximum(near[:, y, x], 0)
        total = g.sum(axis=0)
        dy, dx = (np.array(s, float)[:, None] for s in zip(*[(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], strict=True))
        return {"x": x + x0 + 1 + (g * dx).sum(axis=0) / total, "y": y + y0 + 1 + (g * dy).sum(axis=0) / total, "flux": total}

    found = tiles.stencil(base, ["frame"], tile, 1, f, "x double, y double, flux double")
    first = Window.partitionBy("frame").orderBy(F.desc("flux"), "y", "x")
    return found.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= most).drop("_k")


def process(spark: SparkSession, folder: str, tile: int = 128, model: str = "similarity", rejection: Rejection = Rejection("winsorized_sigma"), kernel: str = "bilinear", min_inliers: int = 6) -> dict[str, DataFrame]:
    """manifest, solutions (frame, matrix, inliers, rms, status), master (filter, tiles) and ledger (frame_id, status) of a folder of frames.

    The reference is the light with most stars, the least id of equals. Frames that don't register take no part, and the ledger says so.
    """
    manifest, t = frame_tiles(spark, folder, tile)
    lights = kept(calibrated(t, *masters(t, rejection)), "lights")
    stars = kept(catalogue(lights, tile), "stars")
    best = stars.groupBy("frame").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "frame").limit(1)
    solved = register.register(stars.withColumn("frame", F.substring("frame", 2, 12).cast("long")), stars.join(best, "frame"), model, 3.0, min_inliers)
    solutions = kept(solved.withColumn("frame", F.format_string("F%06d", "frame")), "solutions")
    size = manifest.filter("frame_type = 'light'").agg(F.max("height").alias("h"), F.max("width").alias("w")).collect()[0]
    matrices = solutions.filter("status = 'ok'").select(F.col("frame").alias("frame_id"), F.flatten("matrix").alias("matrix"))
    if size.h is None:
        raise ValueError("the folder holds no lights")
    warped = tiles.warp(lights.drop("filter"), ["frame_id"], matrices, tile, size.h, size.w, kernel).join(lights.select("frame_id", "filter").distinct(), "frame_id")
    master = kept(tiles.stack(warped, ["filter"], "frame_id", rejection), "master")
    status = F.when(F.col("frame_id").isNull(), "unreadable").when(F.col("frame_type") != "light", "calibration").when(F.col("status") == "ok", "integrated").when(F.col("status").isNull(), "registration_missing").otherwise("registration_rejected")
    ledger = manifest.select("path", "frame_id", "frame_type").join(solutions.select(F.col("frame").alias("frame_id"), "status"), "frame_id", "left").select("path", "frame_id", status.alias("status"))
    return {"manifest": manifest, "solutions": solutions, "master": master, "ledger": ledger}


def write_master(master: DataFrame, folder: str) -> pd.DataFrame:
    """A FITS file per filter, put together from its tiles by one task each; returns (filter, path)."""
    p = tiles.to_pixels(master, ["filter"], "master").select(F.xxhash64("filter").alias("frame"), "filter", "y", "x", F.col("master").alias("v"))
    names = p.select("frame", "filter").distinct()
    return fits.write_images(p.select("frame", "y", "x", "v"), folder).join(names, "frame").select("filter", "path").toPandas()


# --- the tile operators on the driver's tables ---------------------------------------------------------------------------


@query(ORACLE["local_max"])
def tile_local_max(spark, sf):
    t = tiles.from_pixels(images(spark, sf), ["frame"], 4)
    return tiles.local_maxima(t, ["frame"], 4, 100000.0).filter("y between 1 and 6 and x between 1 and 6").select("frame", "y", "x", F.col("v").cast("bigint").alias("v"))


@query(f"WITH {IMAGES_SQL}, st AS (SELECT filt, y, x, quantile_cont(v, 0.5) AS c, {STD} AS s FROM images GROUP BY filt, y, x), f AS (SELECT i.filt, i.y, i.x, v, s > 0 AND v < c - 1.5 * s AS lo, s > 0 AND v > c + 1.5 * s AS hi FROM images i JOIN st USING (filt, y, x)), g AS (SELECT filt, y, x, count(*) - count(*) FILTER (lo OR hi) >= 3 AND count(*) FILTER (lo OR hi) <= count(*) * 0.5 AS go FROM f GROUP BY filt, y, x) SELECT filt, y, x, round(CAST(sum(v) FILTER (NOT (go AND (lo OR hi))) AS DOUBLE) / count(*) FILTER (NOT (go AND (lo OR hi))), 4) AS master, CAST(count(*) FILTER (NOT (go AND (lo OR hi))) AS INTEGER) AS coverage, CAST(count(*) FILTER (go AND lo) AS INTEGER) AS n_low, CAST(count(*) FILTER (go AND hi) AS INTEGER) AS n_high FROM f JOIN g USING (filt, y, x) GROUP BY filt, y, x")
def tile_stack(spark, sf):
    t = tiles.from_pixels(images(spark, sf), ["frame", "filt"], 4)
    s = tiles.stack(t, ["filt"], "frame", Rejection("sigma", 1.5, 1.5))
    return tiles.to_pixels(s, ["filt"], "master", "coverage", "n_low", "n_high").withColumn("master", F.round("master", 4))


@query(ORACLE["bilinear_warp"])
def tile_warp(spark, sf):
    im = images(spark, sf)
    m = F.array(*[F.lit(float(v)) for row in Q.MOVE for v in row])
    w = tiles.warp(tiles.from_pixels(im, ["frame"], 4), ["frame"], im.select("frame").distinct().withColumn("matrix", m), 4, 8, 8)
    v, none = F.col("data"), F.col("data").isNull()
    p = tiles.to_pixels(w, ["frame"], "data").select("frame", "y", "x", F.round(F.when(none, 0.0).otherwise(v), 4).alias("v"), F.when(none, 0).otherwise(1).alias("coverage"), F.when(none, 64).otherwise(0).alias("dq"))
    return p.select(*Q.QUERIES["bilinear_warp"](spark, sf).columns)
