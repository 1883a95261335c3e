"""Masks of invalid samples: from values, coverage, sidecars and detectors, and what they do to a stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siderea.model import DQ_FLAGS
from siderea.operators.calibrate import isolated_defects, robust_background
from siderea.operators.stack import pop_std


def finite(v: Column) -> Column:
    d = v.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) != float("inf")), F.lit(False))


def replace_hot(images: DataFrame, by: list[str], sigma: float = 8.0) -> DataFrame:
    """What exceeds median + sigma deviations becomes the median (fixed); hot tells where."""
    s = images.groupBy(*by).agg(F.percentile("v", F.lit(0.5)).alias("median"), pop_std(F.count("v"), F.sum("v"), F.sum(F.col("v") * F.col("v"))).alias("std"))
    hot = F.col("v") > F.col("median") + sigma * F.col("std")
    return images.join(s, by).withColumns({"hot": hot, "fixed": F.when(hot, F.col("median")).otherwise(F.col("v").cast("double"))}).drop("median", "std")


def from_coverage(coverage: Column, flag: int) -> Column:
    return F.when(finite(coverage) & (coverage > 0.5), 0).otherwise(flag)


def source_mask(frames: DataFrame, data: str, length: Column) -> DataFrame:
    """frames (data: an array) gain status (ok, missing, shape_mismatch) and invalid, the number of values that aren't finite; null where refused."""
    status = F.when(F.col(data).isNull(), "missing").when(F.size(data) != length, "shape_mismatch").otherwise("ok")
    return frames.withColumn("status", status).withColumn("invalid", F.when(F.col("status") == "ok", F.size(F.filter(data, lambda v: ~finite(v)))))


def flag_counts(samples: DataFrame, by: list[str], dq: str = "dq") -> DataFrame:
    """By group: samples, those with any bit, and how many have each."""
    bit = lambda b: F.count_if(F.col(dq).bitwiseAND(F.lit(b)) != 0)
    return samples.groupBy(*by).agg(F.count("*").alias("samples"), F.count_if(F.col(dq) != 0).alias("invalid"), *[bit(b).alias(n) for n, b in DQ_FLAGS.items()])


def sidecar_bits(v: Column) -> Column:
    """Bits stored as floats: rounded half to even; what isn't finite is NO_DATA."""
    return F.when(finite(v), F.rint(v).cast("int")).otherwise(DQ_FLAGS["no_data"])


def thresholds(images: DataFrame, by: list[str], hot: float = 8.0, cold: float = 8.0) -> DataFrame:
    """One row per frame: the values beyond which a pixel counts as hot or cold."""
    b = robust_background(images, by)
    return b.select(*by, "median", "noise", (F.col("median") + hot * F.col("noise")).alias("hot_above"), (F.col("median") - cold * F.col("noise")).alias("cold_below"))


def threshold_mask(images: DataFrame, by: list[str], hot: float = 8.0, cold: float = 8.0) -> DataFrame:
    """Pixels beyond their frame's thresholds, with the bit; nothing is replaced."""
    t = thresholds(images, by, hot, cold)
    d = images.join(t.select(*by, "hot_above", "cold_below"), by)
    dq = F.when(F.col("v") > F.col("hot_above"), DQ_FLAGS["hot_pixel"]).when(F.col("v") < F.col("cold_below"), DQ_FLAGS["cold_pixel"])
    return d.select(*by, "y", "x", dq.alias("dq")).filter("dq is not null")


def masked(samples: DataFrame, mask: DataFrame, on: list[str]) -> DataFrame:
    """samples whose place the mask names have no value."""
    m = mask.select(*on).distinct().withColumn("_masked", F.lit(True))
    return samples.join(m, on, "left").withColumn("v", F.when(F.col("_masked").isNull(), F.col("v"))).drop("_masked")


def discs(stars: DataFrame, by: list[str], radius: float, min_pixels: int, max_sharpness: float) -> DataFrame:
    """Places (by, y, x) within radius of a star (by, sy, sx, npix, sharpness) of at least min_pixels that is no sharper than max_sharpness."""
    r = int(radius)
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius])
    s = stars.filter((F.col("npix") >= min_pixels) & (F.col("sharpness") <= max_sharpness)).withColumn("_s", F.explode(steps))
    return s.select(*by, (F.col("sy") + F.col("_s.dy")).alias("y"), (F.col("sx") + F.col("_s.dx")).alias("x")).distinct()


def unprotected_defects(images: DataFrame, stars: DataFrame, by: list[str], width: int, height: int, hot: float = 8.0, radius: float = 3.0, min_pixels: int = 3, max_sharpness: float = 0.95) -> DataFrame:
    """Isolated defects, less those inside the discs around stars."""
    return isolated_defects(images, by, width, height, hot).join(discs(stars, by, radius, min_pixels, max_sharpness), [*by, "y", "x"], "left_anti")


def transformed(v: Column, scale: float | None = None, offset: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """v scale + offset, then kept within low and high; each part only where it is given."""
    out = v.cast("double")
    out = out if scale is None else out * scale
    out = out if offset is None else out + offset
    out = out if low is None else F.greatest(out, F.lit(float(low)))
    return out if high is None else F.least(out, F.lit(float(high)))


def named_flag_counts(maps: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """maps (by, dq): pixels by flag name, in one scan; valid counts those without any bit. Names are taken in lower case and once each; a
    name that isn't a flag's counts nothing and is marked unknown."""
    names = list(dict.fromkeys(f.lower() for f in flags))
    bits = {"valid": 0, **DQ_FLAGS}
    hit = {n: F.col("dq") == 0 if n == "valid" else F.col("dq").bitwiseAND(bits[n]) != 0 if n in bits else F.lit(False) for n in names}
    wide = maps.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in hit.items()])
    known = F.col("flag").isin(list(bits))
    return wide.unpivot(by, names, "flag", "n").withColumn("unknown", ~known)


def merged_counts(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Counts of parts (by, flag, n) added up."""
    out = parts[0].select(*by, "flag", "n")
    for p in parts[1:]:
        out = out.unionByName(p.select(*by, "flag", "n"))
    return out.groupBy(*by, "flag").agg(F.sum("n").alias("n"))
