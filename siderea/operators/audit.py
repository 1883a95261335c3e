"""Audits over runs: rectangles, contributions, contrasts, parsed warnings, triage, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderea.functions.metadata import digits, warning_value
from siderea.operators.compare import ratio


def overlapping(a: DataFrame, b: DataFrame, cell: int) -> DataFrame:
    """Pairs of rectangles (id, y0, y1, x0, x1; whole numbers) that share area, and how much. They meet by grid cell, each pair in
    the cell that holds the corner of its intersection."""

    def cells(d: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.expr(f"cast(floor({lo} / {cell}) as int)"), F.expr(f"cast(floor(({hi} - 1) / {cell}) as int)"))
        d = d.withColumn("cy", F.explode(span("y0", "y1"))).withColumn("cx", F.explode(span("x0", "x1")))
        return d.select("cy", "cx", *[F.col(c).alias(f"{p}{c}") for c in ("id", "y0", "y1", "x0", "x1")])

    j = cells(a, "a").join(cells(b, "b"), ["cy", "cx"])
    top, left = F.greatest("ay0", "by0"), F.greatest("ax0", "bx0")
    h, w = F.least("ay1", "by1") - top, F.least("ax1", "bx1") - left
    return j.filter((h > 0) & (w > 0) & (F.col("cy") == F.floor(top / cell)) & (F.col("cx") == F.floor(left / cell))).select(F.col("aid").alias("a"), F.col("bid").alias("b"), (h * w).alias("area"))


def controls(frames: DataFrame, focus: Column, before: int, after: int, order: str, weight: str) -> DataFrame:
    """Frames of positive weight up to `before` places ahead of the focus run and `after` behind it."""
    d = frames.withColumns({"_i": F.row_number().over(Window.orderBy(order)), "_f": focus})
    ends = d.filter("_f").agg(F.min("_i").alias("lo"), F.max("_i").alias("hi"))
    j = d.crossJoin(F.broadcast(ends))  # one row
    near = F.col("_i").between(F.col("lo") - before, F.col("lo") - 1) | F.col("_i").between(F.col("hi") + 1, F.col("hi") + after)
    return j.filter(near & ~F.col("_f") & (F.col(weight) > 0)).drop("_i", "_f", "lo", "hi")


def matrix_delta(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Two runs' (key, m array, status): Frobenius norm of the difference and whether statuses agree."""
    b, c = (d.select(key, F.col("m").alias(f"m{x}"), F.col("status").alias(f"s{x}")) for d, x in ((baseline, "b"), (candidate, "c")))
    norm = F.sqrt(F.aggregate(F.zip_with("mb", "mc", lambda p, q: (q - p) * (q - p)), F.lit(0.0), lambda s, x: s + x))
    return b.join(c, key, "full_outer").select(key, norm.alias("delta"), F.col("sb").eqNullSafe(F.col("sc")).alias("same_status"))


def metric_ratios(baseline: DataFrame, candidate: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric (whole numbers) on either side, and their ratio."""
    side = lambda d, n: d.unpivot(key, metrics, "metric", "v").groupBy("metric").agg(ratio(F.sum("v"), F.count("v")).alias(n))
    return side(baseline, "baseline").join(side(candidate, "candidate"), "metric").withColumn("ratio", F.try_divide("candidate", "baseline"))


def contributions(samples: DataFrame, px: list[str], by: list[str]) -> DataFrame:
    """samples (px, v, w, keep): each frame's part in its pixels' weighted means, summed over by: sum of w v, share of weight, kept."""
    d = samples.withColumn("g", F.when(F.col("keep"), F.greatest(F.col("w"), F.lit(0))).otherwise(0))
    return d.groupBy(*by).agg(F.sum(F.col("g") * F.col("v")).alias("weighted"), F.sum("g").alias("weight"), F.count_if("keep").alias("accepted"), F.count("*").alias("samples")).withColumn("accepted_fraction", ratio(F.col("accepted"), F.col("samples")))


def contrast(rows: DataFrame, by: list[str], focus: Column, value: str) -> DataFrame:
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col(value))).cast("double"), F.count_if(c).cast("double"))
    return rows.groupBy(*by).agg(mean(focus).alias("focus"), mean(~focus).alias("control")).withColumn("contrast", F.col("focus") - F.col("control"))


def parsed_warnings(rows: DataFrame, key: str, warnings: str, numbers: list[str], texts: list[str]) -> DataFrame:
    """key=value warnings to typed columns; the last of each key counts."""
    w = rows.select(key, F.explode_outer(warnings).alias("x"))
    return w.groupBy(key).agg(*[F.max(warning_value(F.col("x"), n).try_cast("double")).alias(n) for n in numbers], *[F.max(warning_value(F.col("x"), t)).alias(t) for t in texts])


def triage(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """(key, failed) of two runs: frames that fail anew or recovered."""
    b, c = baseline.select(key, F.col("failed").alias("b")), candidate.select(key, F.col("failed").alias("c"))
    j = b.join(c, key)
    return j.filter("b <> c").select(key, F.when(F.col("c"), "extra_failed").otherwise("recovered").alias("change"))


def memory_plan(frames: Column, height: Column, width: Column, masters: Column, batch: Column) -> dict[str, Column]:
    """Bytes of float32 surfaces, and their peak."""
    one = (height * width * 4).cast("bigint")
    parts = {"frame_bytes": frames * one, "master_bytes": masters * one, "batch_bytes": batch * one, "output_bytes": one * 7}
    total = None
    for p in parts.values():
        total = p if total is None else total + p
    return {**parts, "peak_bytes": total}


def focus_frames(frames: DataFrame, key: str, named: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """Frames that are named, or whose number (all digits of the id) lies between those of two ids, in either order."""
    chosen = F.col(key).isin(named) if named else F.lit(False)
    if first and last:
        a, b = digits(F.lit(first)), digits(F.lit(last))
        chosen = chosen | F.coalesce(digits(F.col(key)).between(F.least(a, b), F.greatest(a, b)), F.lit(False))
    return frames.filter(chosen)


def matrix_deltas(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Two runs' (key, m: nine numbers by rows, status): norms of the difference of the matrices, of their linear parts and of their
    translations, null where a side lacks the frame."""
    b, c = (d.select(key, F.col("m").alias(f"m{x}"), F.col("status").alias(f"s{x}"), F.lit(True).alias(f"in_{n}")) for d, x, n in ((baseline, "b", "baseline"), (candidate, "c", "candidate")))
    j = b.join(c, key, "full_outer").withColumn("d2", F.zip_with("mb", "mc", lambda p, q: (q - p) * (q - p)))
    norm = lambda places: F.sqrt(sum((F.get("d2", F.lit(i)) for i in places[1:]), F.get("d2", F.lit(places[0]))))
    there = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return j.select(key, there("in_baseline"), there("in_candidate"), norm(list(range(9))).alias("matrix_delta"), norm([0, 1, 3, 4]).alias("linear_delta"), norm([2, 5]).alias("translation_delta"), F.col("sb").eqNullSafe(F.col("sc")).alias("same_status"))


def matrix_delta_summary(deltas: DataFrame, max_translation: float = 0.5, max_matrix: float = 0.05) -> DataFrame:
    """One row: frames on either side, missing ones, changed statuses, the largest deltas and their 95th percentiles, and whether all is
    within the limits. Without a common frame the limits aren't kept."""
    both = F.col("in_baseline") & F.col("in_candidate")
    p95 = lambda c: F.percentile(c, F.lit(0.95))
    out = deltas.agg(
        F.count_if("in_baseline").alias("baseline_rows"), F.count_if("in_candidate").alias("candidate_rows"), F.count_if(both).alias("common_rows"), F.count_if(~both).alias("missing_rows"),
        F.count_if(both & ~F.col("same_status")).alias("status_mismatches"), F.max("translation_delta").alias("max_translation"), p95("translation_delta").alias("p95_translation"),
        F.max("matrix_delta").alias("max_matrix"), p95("matrix_delta").alias("p95_matrix"),
    )
    within = F.coalesce((F.col("max_translation") <= max_translation) & (F.col("max_matrix") <= max_matrix), F.lit(False))
    return out.withColumn("passed", within & (F.col("baseline_rows") == F.col("candidate_rows")) & (F.col("missing_rows") == 0) & (F.col("status_mismatches") == 0))


def metric_badness(baseline: DataFrame, candidate: DataFrame, key: str, directions: dict[str, str]) -> DataFrame:
    """Each metric's mean, median and worst frame on either side, and by what factor the candidate is worse: candidate over baseline where
    high is bad, else baseline over candidate; null where the divisor isn't positive."""
    bad_high = F.col("metric").isin([m for m, d in directions.items() if d == "high"])

    def side(d: DataFrame, n: str) -> DataFrame:
        v = d.select(key, *[F.col(m).cast("double").alias(m) for m in directions]).unpivot(key, list(directions), "metric", "v").filter("v is not null and not isnan(v) and abs(v) < double('infinity')")
        worst = F.min(F.struct(F.when(bad_high, -F.col("v")).otherwise(F.col("v")).alias("o"), F.col(key).alias("k")))
        return v.groupBy("metric").agg(F.count("*").alias(f"{n}_frames"), F.avg("v").alias(f"{n}_mean"), F.percentile("v", F.lit(0.5)).alias(f"{n}_median"), worst["k"].alias(f"{n}_worst"))

    def factor(stat: str) -> Column:
        b, c = F.col(f"baseline_{stat}"), F.col(f"candidate_{stat}")
        return F.when(bad_high, F.when(b > 0, F.try_divide(c, b))).otherwise(F.when(c > 0, F.try_divide(b, c)))

    j = side(baseline, "baseline").join(side(candidate, "candidate"), "metric", "full_outer")
    return j.withColumns({"bad_mean_ratio": factor("mean"), "bad_median_ratio": factor("median")})


def delta_contributions(samples: DataFrame, px: list[str], by: list[str]) -> DataFrame:
    """samples (px, v, w, ok, keep, low, high): what each frame adds to its pixels' weighted means. A kept sample adds w (v - m) / W to
    a pixel of mean m and weight W, any other sample adds nothing; the mean is over all samples."""
    over = Window.partitionBy(*px)
    d = samples.withColumn("_g", F.when(F.col("keep"), F.greatest(F.col("w").cast("double"), F.lit(0.0))).otherwise(0.0))
    d = d.withColumns({"_W": F.sum("_g").over(over), "_S": F.sum(F.col("_g") * F.col("v")).over(over)})
    d = d.withColumn("_d", F.col("v") - F.try_divide("_S", "_W")).withColumn("_c", F.coalesce(F.try_divide(F.col("_g") * F.col("_d"), F.col("_W")), F.lit(0.0)))
    out = d.groupBy(*by).agg(
        F.count_if("ok").alias("valid_pixels"), F.count_if("keep").alias("accepted_pixels"), F.count_if(F.col("low") & F.col("ok")).alias("low_rejected"), F.count_if(F.col("high") & F.col("ok")).alias("high_rejected"),
        F.avg(F.when(F.col("keep"), F.col("_g") * F.col("_d"))).alias("weighted_delta"), F.avg("_c").alias("contribution"),
    )
    return out.withColumns({"accepted_fraction": ratio(F.col("accepted_pixels"), F.col("valid_pixels")), "rejected_fraction": ratio(F.col("low_rejected") + F.col("high_rejected"), F.col("valid_pixels"))})


def focus_control(rows: DataFrame, focus: Column, control: Column, frame: str = "frame", tile: str = "tile") -> DataFrame:
    """Rows of delta_contributions by tile and frame, rolled up for frames in focus and control frames and contrasted: (metric, focus,
    control, focus_minus_control)."""
    d = rows.withColumn("side", F.when(focus, "focus").when(control, "control")).filter("side is not null")
    sums = d.groupBy("side").agg(
        F.count_distinct(frame).cast("double").alias("frames"), F.count("*").cast("double").alias("tile_frames"), ratio(F.sum("accepted_pixels"), F.sum("valid_pixels")).alias("accepted_fraction"),
        ratio(F.sum(F.col("low_rejected") + F.col("high_rejected")), F.sum("valid_pixels")).alias("rejected_fraction"), ratio(F.sum("high_rejected"), F.sum("valid_pixels")).alias("high_rejected_fraction"),
        F.avg("weighted_delta").alias("weighted_delta"), F.avg("contribution").alias("contribution"),
    )
    tiles = d.groupBy("side", tile).agg(F.sum("contribution").alias("s")).groupBy("side").agg(F.avg("s").alias("tile_contribution"))
    names = ["frames", "tile_frames", "accepted_fraction", "rejected_fraction", "high_rejected_fraction", "weighted_delta", "contribution", "tile_contribution"]
    long = sums.join(tiles, "side").unpivot("side", names, "metric", "v")
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("v"))).alias(s)
    return long.groupBy("metric").agg(at("focus"), at("control")).withColumn("focus_minus_control", F.col("focus") - F.col("control"))
