"""Frame quality: weight, gate, reference, orientation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderea.model import QualityGate


# The constants of this product.
def combined_weight(star_count: Column, snr: Column, fwhm: Column, ecc: Column, rms: Column, saturation: Column) -> Column:
    width = F.greatest(F.when(fwhm.isNull() | (fwhm == 0), 3.0).otherwise(fwhm), F.lit(0.75))
    return (
        F.greatest(F.coalesce(snr, F.lit(0.0)), F.lit(0.0))
        * F.sqrt(F.greatest(F.coalesce(star_count, F.lit(0)), F.lit(1)).cast("double"))
        * (1.0 / (width * width))
        * F.greatest(F.lit(0.05), 1.0 - F.coalesce(ecc, F.lit(0.0)))
        * (1.0 / F.greatest(rms, F.lit(1e-6)))
        * F.greatest(F.lit(0.0), 1.0 - 5.0 * F.greatest(F.coalesce(saturation, F.lit(0.0)), F.lit(0.0)))
    )


def effective_min_stars(pixels: Column, gate: QualityGate) -> Column:
    """Scaled by the side of the image, rounded half to even, between 1 and what is configured."""
    if not gate.adaptive:
        return F.lit(gate.min_stars)
    n = F.bround(gate.min_stars * (F.sqrt(pixels.cast("double")) / max(gate.reference_side, 1.0))).cast("int")
    return F.when(F.coalesce(pixels, F.lit(0)) <= 0, gate.min_stars).otherwise(F.greatest(F.lit(1), F.least(F.lit(gate.min_stars), n)))


def apply_gate(q: DataFrame, gate: QualityGate) -> DataFrame:
    """q (star_count, fwhm, saturation, score, pixels) gains reasons and status."""
    least = effective_min_stars(F.col("pixels"), gate)
    reasons = [F.when(F.coalesce(F.col("star_count"), F.lit(0)) < least, "star_count"), F.when(F.col("fwhm").isNull(), "fwhm_px") if gate.require_fwhm else F.lit(None).cast("string"),
               F.when(F.coalesce(F.col("saturation"), F.lit(0.0)) > gate.max_saturation, "saturation_fraction"), F.when(F.coalesce(F.col("score"), F.lit(0.0)) < gate.min_score, "quality_score")]
    d = q.withColumns({"min_stars": least, "reasons": F.array_compact(F.array(*reasons))})
    return d.withColumn("status", F.when(F.size("reasons") == 0, "accepted").otherwise("rejected"))


def reason_counts(gated: DataFrame) -> DataFrame:
    return gated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def reference(gated: DataFrame) -> DataFrame:
    """The best accepted frame, or of all where none is: most stars, score, then least fwhm, eccentricity, noise, id."""
    best = [F.desc("accepted"), F.desc("star_count"), F.desc("score"), F.coalesce("fwhm", F.lit(999.0)), F.coalesce("ecc", F.lit(1.0)), F.coalesce("rms", F.lit(0.0)), F.col("frame_id")]
    return gated.withColumn("accepted", (F.col("status") == "accepted").cast("int")).orderBy(*best).limit(1).select("frame_id", "star_count", "score", (F.col("accepted") == 0).alias("fallback"))


def dominant(frames: DataFrame, *keys: str) -> DataFrame:
    """The most common combination of keys that are known; of equals the least."""
    known = frames.filter(" and ".join(f"{k} is not null and cast({k} as string) <> 'unknown'" for k in keys))
    return known.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(1)


def metric_summary(rows: DataFrame, metric: str, id_col: str, worst: str = "max") -> DataFrame:
    """min, median, mean of a metric (a whole number) and the frame where it is worst, first on ties."""
    v = F.col(metric)
    pick = F.struct((-v if worst == "max" else v).alias("a"), F.col(id_col).alias("b"))
    return rows.filter(v.isNotNull()).agg(
        F.min(v).alias("least"), F.percentile(v, F.lit(0.5)).alias("median"), F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double")).alias("mean"), F.max(v).alias("most"), F.min(pick)["b"].alias("worst_frame"),
    )


def rank_fraction(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """(rank - 1) / max(n - 1, 1)."""
    n = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn("fraction", (F.rank().over(Window.partitionBy(*by).orderBy(*order)) - 1) / F.greatest(n - 1, F.lit(1)))


def evenly_spaced(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """n rows at even distances, first and last included."""
    d = rows.withColumns({"_i": F.row_number().over(Window.orderBy(*order)) - 1, "_n": F.count("*").over(Window.partitionBy())})
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / max(n - 1, 1)).cast("int"))
    return d.filter((F.col("_n") <= n) | F.array_contains(at, F.col("_i"))).drop("_i", "_n")
