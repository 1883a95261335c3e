"""Stacking: reject outliers among the samples of a pixel, combine what stays.

One shuffle on the pixel carries everything: windows over the pixel give centre, scale, flags and guard, and the final aggregate
is partitioned alike. Without rejection the aggregate alone runs, partial before the shuffle. Values are scaled integers: sums
are exact and do not depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderea.model import Rejection


def dealt(df: DataFrame, px: list[str], bytes_each: int = 4 << 20) -> DataFrame:
    """df by pixel, in so many partitions that what a task sorts doesn't grow with the input: as Spark's estimate (of compressed files, so some
    twentieth of what is held) says, the session's number at least."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = min(size // bytes_each, 10_000) if size < 1 << 50 else 0  # beyond that there is no estimate
    return df.repartition(n, *px) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*px)


def valid(v: str = "v", dq: str | None = "dq") -> Column:
    """A sample counts if it has a value and no data-quality bit."""
    ok = F.col(v).isNotNull()
    return ok & (F.coalesce(F.col(dq), F.lit(0)) == 0) if dq else ok


def usable_weight(w: Column) -> Column:
    """Missing is 1; what isn't a positive finite number is 0. Whole numbers stay whole, so that sums of them are exact."""
    d = w.cast("double")
    return F.when(w.isNull(), 1).when(F.isnan(d) | (d <= 0) | (d == float("inf")), 0).otherwise(w)


def pop_std(n: Column, s: Column, ss: Column) -> Column:
    """Population deviation from exact sums."""
    n, s, ss = n.cast("double"), s.cast("double"), ss.cast("double")
    return F.sqrt(F.greatest((ss - s * s / n) / n, F.lit(0.0)))


def centre_and_scale(df: DataFrame, px: list[str], method: str, low: float, high: float) -> DataFrame:
    """df (with ok) gains centre and scale by pixel over its ok samples."""
    w = Window.partitionBy(*px)
    x = F.when(F.col("ok"), F.col("v"))
    med = F.percentile(x, F.lit(0.5)).over(w)
    n, s, ss = (F.sum(e).over(w) for e in (F.when(F.col("ok"), 1), x, F.when(F.col("ok"), F.col("v") * F.col("v"))))
    if method in ("sigma", "sigma_clip"):
        return df.withColumns({"centre": med, "scale": pop_std(n, s, ss)})
    if method in ("mad", "median_sigma"):
        d = df.withColumn("centre", med)
        off = F.percentile(F.when(F.col("ok"), F.abs(F.col("v") - F.col("centre"))), F.lit(0.5)).over(w)
        return d.withColumn("scale", off * 1.4826)
    if method == "winsorized_sigma":
        d = df.withColumns({"_m": med, "_q1": F.percentile(x, F.lit(0.25)).over(w), "_q3": F.percentile(x, F.lit(0.75)).over(w), "_sd": pop_std(n, s, ss)})
        d = d.withColumn("_s0", F.when(F.col("_q3") > F.col("_q1"), (F.col("_q3") - F.col("_q1")) / 1.349).otherwise(F.col("_sd")))
        # clipped values are rounded to whole units, so that their sums are exact
        clip = F.round(F.greatest(F.least(F.col("v").cast("double"), F.col("_m") + high * F.col("_s0")), F.col("_m") - low * F.col("_s0"))).cast("bigint")
        d = d.withColumn("_c", F.when(F.col("ok"), clip))
        cn, cs, css = (F.sum(e).over(w) for e in (F.when(F.col("ok"), 1), F.col("_c"), F.col("_c") * F.col("_c")))
        d = d.withColumns({"centre": cs.cast("double") / cn, "_cs": pop_std(cn, cs, css)})
        return d.withColumn("scale", F.when(F.col("_cs") > 0, F.col("_cs")).otherwise(F.col("_s0"))).drop("_m", "_q1", "_q3", "_sd", "_s0", "_c", "_cs")
    raise ValueError(f"no such rejection: {method}")


def flag(df: DataFrame, px: list[str], policy: Rejection) -> DataFrame:
    """df (with ok) gains lo and hi: flagged samples, before the guard."""
    w = Window.partitionBy(*px)
    x = F.when(F.col("ok"), F.col("v"))
    if policy.method == "minmax":
        d = df.withColumns({"_lo": F.min(x).over(w), "_hi": F.max(x).over(w)})
        spread = F.col("ok") & (F.col("_lo") < F.col("_hi"))
        return d.withColumns({"lo": spread & (F.col("v") == F.col("_lo")), "hi": spread & (F.col("v") == F.col("_hi"))}).drop("_lo", "_hi")
    if policy.method == "percentile":
        p, q = min(max(policy.low, 0), 49) / 100, min(max(policy.high, 51), 100) / 100
        d = df.withColumns({"_lo": F.percentile(x, F.lit(p)).over(w), "_hi": F.percentile(x, F.lit(q)).over(w)})
        return d.withColumns({"lo": F.col("ok") & (F.col("v") < F.col("_lo")), "hi": F.col("ok") & (F.col("v") > F.col("_hi"))}).drop("_lo", "_hi")
    d = centre_and_scale(df, px, policy.method, policy.low, policy.high)
    on = F.col("ok") & (F.col("scale") > 0)
    return d.withColumns({"lo": on & (F.col("v") < F.col("centre") - policy.low * F.col("scale")), "hi": on & (F.col("v") > F.col("centre") + policy.high * F.col("scale"))}).drop("centre", "scale")


def reject(samples: DataFrame, px: list[str], policy: Rejection, dq: str | None = None) -> DataFrame:
    """samples gain ok (before), keep (after), low and high (rejected). All of a pixel's flags count or none (the guard)."""
    d = samples.withColumn("ok", valid("v", dq))
    if policy.method == "none":
        return d.withColumns({"keep": F.col("ok"), "low": F.lit(False), "high": F.lit(False)})
    w = Window.partitionBy(*px)
    d = d.repartition(*px).withColumns({"before": F.col("ok"), "low": F.lit(False), "high": F.lit(False)})
    for _ in range(policy.iterations):
        d = flag(d, px, policy)
        n = F.coalesce(F.sum(F.when(F.col("ok"), 1)).over(w), F.lit(0))
        r = F.coalesce(F.sum(F.when(F.col("lo") | F.col("hi"), 1)).over(w), F.lit(0))
        d = d.withColumn("_go", (n - r >= policy.min_samples) & (r <= n * policy.max_fraction))
        # a sample that is both (a pixel of one value pair) counts as low
        d = d.withColumns({"low": F.col("low") | (F.col("_go") & F.col("lo")), "high": F.col("high") | (F.col("_go") & F.col("hi") & ~F.col("lo"))})
        d = d.withColumn("ok", F.col("ok") & ~F.col("low") & ~F.col("high")).drop("_go", "lo", "hi")
    return d.withColumn("keep", F.col("ok")).withColumn("ok", F.col("before")).drop("before")


def combine(d: DataFrame, px: list[str], method: str = "mean", weight: str | None = None) -> DataFrame:
    """One row per pixel: master (0 where nothing is kept), coverage, weight, variance (population), low and high counts, dq.

    Weights other than whole numbers make sums depend on the order of rows in the last bits.
    """
    keep = F.col("keep")
    one = F.when(keep, 1)
    n = F.coalesce(F.sum(one), F.lit(0)).cast("bigint")
    v = F.when(keep, F.col("v"))
    if method == "weighted_mean":
        g = usable_weight(F.col(weight)) if weight else F.lit(1)
        s, sw, ss = F.sum(F.when(keep, F.col("v") * g)), F.sum(F.when(keep, g)), F.sum(F.when(keep, F.col("v") * F.col("v") * g))
        master = F.try_divide(s.cast("double"), sw.cast("double"))
        var = F.greatest(F.try_divide(ss.cast("double"), sw.cast("double")) - master * master, F.lit(0.0))
        weight_map = F.coalesce(sw.cast("double"), F.lit(0.0))
    elif method in ("mean", "median", "sum"):
        s, ss = F.sum(v), F.sum(F.when(keep, F.col("v") * F.col("v")))
        master = {"mean": F.try_divide(s.cast("double"), n.cast("double")), "median": F.percentile(v, F.lit(0.5)), "sum": s.cast("double")}[method]
        var = F.greatest(F.try_divide(ss.cast("double") - F.try_divide(s.cast("double") * s.cast("double"), n.cast("double")), n.cast("double")), F.lit(0.0))
        weight_map = n.cast("double")
    else:
        raise ValueError(f"no such combination: {method}")
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), 1)), F.lit(0)).cast("bigint")
    return d.groupBy(*px).agg(
        F.coalesce(master, F.lit(0.0)).alias("master"), n.alias("coverage"), weight_map.alias("weight"), F.coalesce(var, F.lit(0.0)).alias("variance"),
        count("low").alias("n_low"), count("high").alias("n_high"), F.when(n == 0, 1).otherwise(0).alias("dq"),
    )


def stack(samples: DataFrame, px: list[str], method: str = "mean", rejection: Rejection = Rejection(), weight: str | None = None, dq: str | None = None) -> DataFrame:
    return combine(reject(samples, px, rejection, dq), px, method, weight)


def sigma_clip_mean(samples: DataFrame, px: list[str], low: float = 3.0, high: float = 3.0) -> DataFrame:
    """One pass without guard: the mean of what lies within median -+ k deviations, else the median."""
    d = centre_and_scale(samples.withColumn("ok", valid("v", None)).repartition(*px), px, "sigma", low, high)
    inside = F.col("ok") & (F.col("v") >= F.col("centre") - low * F.col("scale")) & (F.col("v") <= F.col("centre") + high * F.col("scale"))
    s, n = F.sum(F.when(inside, F.col("v"))), F.sum(F.when(inside, 1))
    return d.groupBy(*px).agg(F.coalesce(F.try_divide(s.cast("double"), n.cast("double")), F.max("centre"), F.lit(0.0)).alias("master"), F.coalesce(n, F.lit(0)).cast("bigint").alias("coverage"))


def closure(d: DataFrame) -> DataFrame:
    """One row: counts of samples before and after rejection, and whether they add up."""
    count = lambda c: F.count_if(c).cast("bigint")
    r = d.agg(
        F.count("*").cast("bigint").alias("input_samples"), count(F.col("ok")).alias("valid_before"), count(~F.col("ok")).alias("invalid"), count(F.col("keep")).alias("valid_after"),
        count(F.col("low")).alias("low_rejected"), count(F.col("high")).alias("high_rejected"),
    )
    ok = (F.col("valid_before") + F.col("invalid") == F.col("input_samples")) & (F.col("valid_before") == F.col("valid_after") + F.col("low_rejected") + F.col("high_rejected"))
    return r.withColumn("closed", ok)


def normalised_weights(frames: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Weights divided by their median within `by`, at least 1e-6."""
    d = frames.withColumn("raw", F.greatest(F.coalesce(value, F.lit(1.0)), F.lit(1e-6)))
    med = d.groupBy(*by).agg(F.percentile("raw", F.lit(0.5)).alias("med"))
    return d.join(med, by).withColumn("weight", F.greatest(F.col("raw") / F.greatest(F.col("med"), F.lit(1e-6)), F.lit(1e-6))).drop("med")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
