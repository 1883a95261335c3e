"""Comparing a candidate image with a reference: pairs(y, x, c, r, ...) with whole-number values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def diff_stats(pairs: DataFrame, by: list[str]) -> DataFrame:
    d = pairs.withColumn("d", F.col("c") - F.col("r"))
    n, p = F.count("d"), F.percentile(F.abs("d"), F.array(*[F.lit(x) for x in (0.5, 0.9, 0.99, 0.999)]))
    rms, ref = F.sqrt(ratio(F.sum(F.col("d") * F.col("d")), n)), F.sqrt(ratio(F.sum(F.col("r") * F.col("r")), n))
    out = d.groupBy(*by).agg(n.alias("n"), ratio(F.sum("d"), n).alias("mean_diff"), rms.alias("rms_diff"), F.max(F.abs("d")).alias("max_abs_diff"), p.alias("p"), F.coalesce(F.try_divide(rms, ref), F.lit(0.0)).alias("relative_rms"))
    return out.select(*by, "n", "mean_diff", "rms_diff", "max_abs_diff", *[F.col("p")[i].alias(f"p{n}") for i, n in enumerate(("50", "90", "99", "999"))], "relative_rms")


def linear_fit(pairs: DataFrame, by: list[str]) -> DataFrame:
    """r = scale c + offset by least squares, from exact sums; scale is null where c has no spread."""
    n, sx, sy, sxx, sxy = F.count("*"), F.sum("c"), F.sum("r"), F.sum(F.col("c") * F.col("c")), F.sum(F.col("c") * F.col("r"))
    s = pairs.groupBy(*by).agg(n.alias("n"), sx.cast("double").alias("sx"), sy.cast("double").alias("sy"), sxx.cast("double").alias("sxx"), sxy.cast("double").alias("sxy"))
    scale = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.withColumn("scale", scale).select(*by, "n", "scale", ((F.col("sy") - F.col("scale") * F.col("sx")) / F.col("n")).alias("offset"))


def robust_linear_fit(pairs: DataFrame, by: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """The same over the pairs inside both variables' percentile box."""
    ps = F.array(F.lit(low), F.lit(high))
    box = pairs.groupBy(*by).agg(F.percentile("c", ps).alias("pc"), F.percentile("r", ps).alias("pr"))
    inside = pairs.join(box, by).filter("c between pc[0] and pc[1] and r between pr[0] and pr[1]")
    return linear_fit(inside, by)


def tail_tiles(pairs: DataFrame, by: list[str], tile: int, at: float = 0.99, limit: int = 16) -> DataFrame:
    """Tiles by their share in the tail: pixels whose difference reaches the percentile `at` of its group."""
    d = pairs.withColumn("d", F.col("c") - F.col("r"))
    cut = d.groupBy(*by).agg(F.percentile(F.abs("d"), F.lit(at)).alias("cut"))
    t = d.join(cut, by).withColumns({"ty": F.expr(f"cast(y div {tile} as int)"), "tx": F.expr(f"cast(x div {tile} as int)"), "tail": F.abs("d") >= F.col("cut")})
    out = t.groupBy(*by, "ty", "tx").agg(F.count_if("tail").alias("tail_pixels"), F.count_if(F.col("tail") & (F.col("d") < 0)).alias("negative"), F.count_if(F.col("tail") & (F.col("d") > 0)).alias("positive"), F.max(F.abs("d")).alias("max_abs"))
    return out.filter("tail_pixels > 0").orderBy(F.desc("tail_pixels"), F.desc("max_abs"), *by, "ty", "tx").limit(limit)


def top_pixels(pairs: DataFrame, k: int, ids: list[str]) -> DataFrame:
    d = pairs.withColumn("d", F.col("c") - F.col("r"))
    return d.orderBy(F.abs("d").desc(), *ids).limit(k).select(*ids, "c", "r", "d")


def pearson(pairs: DataFrame, by: list[str]) -> DataFrame:
    """From exact sums; null where a side has no spread."""
    s = pairs.groupBy(*by).agg(F.count("*").cast("double").alias("n"), *[F.sum(e).cast("double").alias(a) for a, e in (("sx", F.col("c")), ("sy", F.col("r")), ("sxx", F.col("c") * F.col("c")), ("syy", F.col("r") * F.col("r")), ("sxy", F.col("c") * F.col("r")))])
    vx, vy = (F.greatest(F.col("n") * F.col(q) - F.col(p) * F.col(p), F.lit(0.0)) for p, q in (("sx", "sxx"), ("sy", "syy")))
    return s.select(*by, F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(vx) * F.sqrt(vy)).alias("r"))


def drift(baseline: DataFrame, candidate: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: rows on either side alone, changed rows, largest and summed change. Values are whole numbers."""
    b, c = baseline.select(*keys, F.col(value).alias("b")), candidate.select(*keys, F.col(value).alias("c"))
    d = F.abs(F.col("c") - F.col("b"))
    return b.join(c, keys, "full_outer").agg(
        F.count_if(F.col("c").isNull()).alias("only_baseline"), F.count_if(F.col("b").isNull()).alias("only_candidate"), F.count_if(d > 0).alias("changed"),
        F.coalesce(F.max(d), F.lit(0)).cast("bigint").alias("largest"), F.coalesce(F.sum(d), F.lit(0)).cast("bigint").alias("total"),
    )


def signature(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """SHA-256 of each group's values in order."""
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value].cast("string")), ","), 256).alias("sha256"))


def residuals(pairs: DataFrame, by: list[str]) -> DataFrame:
    """mean, median, rms, MAD, p95 and largest of c - r."""
    d = pairs.withColumn("d", F.col("c") - F.col("r"))
    first = d.groupBy(*by).agg(F.count("d").alias("n"), ratio(F.sum("d"), F.count("d")).alias("mean"), F.percentile("d", F.lit(0.5)).alias("median"), F.sqrt(ratio(F.sum(F.col("d") * F.col("d")), F.count("d"))).alias("rms"), F.percentile(F.abs("d"), F.lit(0.95)).alias("p95"), F.max(F.abs("d")).alias("largest"))
    mad = d.join(first.select(*by, "median"), by).groupBy(*by).agg(F.percentile(F.abs(F.col("d") - F.col("median")), F.lit(0.5)).alias("mad"))
    return first.join(mad, by)


def finite(pairs: DataFrame) -> DataFrame:
    """Pairs whose sides are both finite numbers."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return pairs.filter(ok("c") & ok("r"))


def fitted(pairs: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """Pairs with scale c + offset for c; groups without a fit go."""
    good = fit.filter("scale is not null").select(*by, F.col("scale").alias("_s"), F.col("offset").alias("_o"))
    return pairs.join(good, by).withColumn("c", F.col("_s") * F.col("c") + F.col("_o")).drop("_s", "_o")


def fit_report(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The least-squares fit of finite pairs with the differences it leaves; groups of fewer than two pairs or without spread have none."""
    d = finite(pairs)
    fit = linear_fit(d, by).filter("n >= 2")
    return fit.join(diff_stats(fitted(d, fit, by), by).drop("n"), by)


def robust_fit_report(pairs: DataFrame, by: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """The fit inside both percentile boxes: how many pairs and which part of all it rests on, and the differences that it leaves in all
    pairs (all_rms, all_p99, all_max) and in those of the box (fit_rms, fit_p99, fit_max)."""
    d, ps = finite(pairs), F.array(F.lit(low), F.lit(high))
    box = d.groupBy(*by).agg(F.percentile("c", ps).alias("pc"), F.percentile("r", ps).alias("pr"), F.count("*").alias("pairs"))
    inside = d.join(box, by).withColumn("inside", F.expr("c between pc[0] and pc[1] and r between pr[0] and pr[1]")).drop("pc", "pr")
    fit = linear_fit(inside.filter("inside"), by).filter("n >= 2")
    left = fitted(inside, fit, by).withColumn("d", F.abs(F.col("c") - F.col("r")))

    def stats(name: str, x: Column) -> list[Column]:
        return [F.sqrt(F.avg(x * x)).alias(f"{name}_rms"), F.percentile(x, F.lit(0.99)).alias(f"{name}_p99"), F.max(x).alias(f"{name}_max")]

    rest = left.groupBy(*by).agg(F.max("pairs").alias("pairs"), *stats("all", F.col("d")), *stats("fit", F.when(F.col("inside"), F.col("d"))))
    out = fit.withColumnRenamed("n", "fit_pixels").join(rest, by)
    return out.withColumn("fit_fraction", ratio(F.col("fit_pixels"), F.col("pairs"))).drop("pairs")


def hotspots(pairs: DataFrame, by: list[str], tile: int, limit: int = 16) -> DataFrame:
    """Of each group the tiles whose differences have the largest 99th percentile, then rms; the first by place of equals."""
    d = finite(pairs).withColumns({"d": F.col("c") - F.col("r"), "ty": F.expr(f"cast(y div {tile} as int)"), "tx": F.expr(f"cast(x div {tile} as int)")})
    n = F.count("d")
    t = d.groupBy(*by, "ty", "tx").agg(n.alias("pixels"), ratio(F.sum("d"), n).alias("mean_diff"), F.sqrt(ratio(F.sum(F.col("d") * F.col("d")), n)).alias("rms_diff"), F.percentile(F.abs("d"), F.lit(0.99)).alias("p99_abs_diff"), F.max(F.abs("d")).alias("max_abs_diff"))
    w = Window.partitionBy(*by).orderBy(F.desc("p99_abs_diff"), F.desc("rms_diff"), "ty", "tx")
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def tail_summary(pairs: DataFrame, by: list[str], height: int, width: int, edge: int, at: float = 0.999) -> DataFrame:
    """The tail of each group's differences: its threshold, pixels, signs, and the part within `edge` pixels of the border."""
    d = finite(pairs).withColumn("d", F.col("c") - F.col("r"))
    cut = d.groupBy(*by).agg(F.percentile(F.abs("d"), F.lit(at)).alias("threshold"), F.count("*").alias("compared"))
    border = F.least(F.col("x"), F.col("y"), F.lit(width - 1) - F.col("x"), F.lit(height - 1) - F.col("y"))
    tail = d.join(cut, by).filter(F.abs("d") >= F.col("threshold"))
    n = F.count("*")
    return tail.groupBy(*by).agg(F.max("threshold").alias("threshold"), F.max("compared").alias("compared"), n.alias("tail_pixels"), F.count_if(F.col("d") < 0).alias("negative"), F.count_if(F.col("d") > 0).alias("positive"), ratio(F.count_if(border <= edge), n).alias("edge_fraction"))
