"""Rules that decide what becomes of a run, a reference, a frame or a proposal. Names of outcomes are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderea.operators.compare import ratio


def recommendation(tail: Column, negative: Column, positive: Column, edge_fraction: Column, top_tile: Column, top_local: Column) -> Column:
    """What the tail of a comparison suggests. top_tile: tail pixels of the tile with most; top_local: their share of its valid pixels."""
    share = lambda c: F.coalesce(ratio(c, tail), F.lit(0.0))
    return (
        F.when(tail <= 0, "no_tail_pixels").when(edge_fraction >= 0.5, "edge_dominated_tail").when((share(top_tile) >= 0.1) | (F.coalesce(top_local, F.lit(0.0)) >= 0.1), "localized_tail")
        .when((share(negative) >= 0.95) | (share(positive) >= 0.95), "signed_global_tail").otherwise("diffuse_tail")
    )


def resume_action(resident: Column, failed_stage: Column, complete: Column, can_reenter: Column, started: Column, boundary_action: Column, calibration_ready: Column, masters_ready: Column, missing: Column) -> Column:
    """Of a run's state. boundary_action: what a ready boundary allows, null if none. The order matters."""
    open_ = ~complete
    return (
        F.when(~resident, "not_resident_run").when(failed_stage.isNotNull() & (failed_stage != ""), "blocked_failed_resident_run").when(open_ & can_reenter, "reenter_from_run_invocation")
        .when(open_ & started & boundary_action.isNotNull(), boundary_action).when(open_ & started & calibration_ready, "blocked_calibration_boundary_reentry_unavailable")
        .when(open_ & started & masters_ready, "blocked_master_cache_reentry_unavailable").when(open_, "blocked_incomplete_resident_run").when(missing > 0, "blocked_missing_resident_artifacts").otherwise("noop_complete")
    )


def registration_decision(status: Column, inliers: Column, rms: Column, capacity: Column, action: str, min_inliers: int, max_rms: float | None) -> Column:
    """action: off, warn or exclude. Few inliers are no reason where the smaller catalogue (capacity) has fewer stars than that."""
    d = rms.cast("double")
    few = (inliers < min_inliers) & (capacity.isNull() | (capacity >= min_inliers))
    wide = F.lit(False) if max_rms is None else F.coalesce(F.isnan(d) | (F.abs(d) == float("inf")) | (d > max_rms), F.lit(True))
    if action == "off":
        return F.lit("disabled")
    named = F.when(status == "reference", "reference").when(status == "excluded", "already_excluded").when(status == "failed", "already_failed").when(status != "ok", "not_applicable")
    return named.when(F.coalesce(few, F.lit(False)) | wide, "rejected" if action == "exclude" else "warning").otherwise("accepted")


def health(frames: DataFrame, by: list[str], action: str = "exclude", min_fraction: float = 0.75, min_frames: int = 2) -> DataFrame:
    """frames (by, accepted): accepted frames and share, failed checks and the gate's status."""
    s = frames.groupBy(*by).agg(F.count("*").alias("frames"), F.count_if("accepted").alias("accepted"))
    s = s.withColumn("fraction", F.coalesce(ratio(F.col("accepted"), F.col("frames")), F.lit(0.0)))
    failed = F.array_compact(F.array(F.when(F.col("accepted") < min_frames, "min_accepted_frames"), F.when(F.col("fraction") < min_fraction, "min_accepted_fraction")))
    s = s.withColumn("failed_checks", F.array_join(failed, ",") if action != "off" else F.lit(""))
    bad = "warning" if action == "warn" else "failed"
    return s.withColumn("status", F.lit("disabled") if action == "off" else F.when(F.col("failed_checks") == "", "passed").otherwise(bad))


def admission(gate: Column, enforced: Column, allowed: Column) -> Column:
    """Whether a reference frame whose quality gate says so may be used."""
    rejected = F.coalesce(gate, F.lit("unknown")) == "rejected"
    return F.when(rejected & enforced & ~allowed, "blocked").when(rejected, "allowed_quality_rejected_reference").otherwise("accepted")


def engine_reason(backend: Column, rejection: Column, accelerator: Column, fast_path: Column) -> Column:
    """Why an integration takes the engine it takes; only the first is the fast path."""
    return (
        F.when(accelerator & (rejection == "none") & fast_path, "explicit_cuda_fast_path_requested").when(accelerator & (rejection != "none"), "stack_engine_required_for_rejection")
        .when(accelerator & (backend == "cuda") & ~fast_path, "cuda_backend_stack_engine_default_requires_fast_path_policy").when(accelerator & ~fast_path, "stack_engine_default_requires_explicit_cuda_fast_path")
        .when(backend == "cuda", "cuda_requested_but_unavailable").otherwise("stack_engine_default")
    )


def requested_reference(frames: DataFrame, requests: DataFrame, best: Column) -> DataFrame:
    """requests (run, wanted) against frames (run, frame_id, path): the first frame whose id, name or stem is wanted, null if none is; the
    run's best where nothing is wanted."""
    name = F.element_at(F.split("path", "/"), -1)
    tokens = frames.select("run", "frame_id", F.explode(F.array_distinct(F.array(F.col("frame_id").cast("string"), name, F.regexp_replace(name, r"\.[^.]*$", "")))).alias("wanted"))
    found = requests.join(tokens, ["run", "wanted"], "left").groupBy("run", "wanted").agg(F.min("frame_id").alias("found"))
    return found.select("run", "wanted", F.when(F.coalesce("wanted", F.lit("")) == "", best).otherwise(F.col("found")).alias("reference"))


def raw_weight(mode: str, snr: Column, score: Column, weight: Column, noise: Column) -> Column:
    """A frame's weight before it is normalised: none, simple_snr, combined or variance_aware. Zero and null are passed over."""
    some = lambda *cs: F.coalesce(*[F.when(c != 0, c.cast("double")) for c in cs], F.lit(1.0))
    if mode == "none":
        return F.lit(1.0)
    if mode == "simple_snr":
        return some(snr, weight)
    if mode == "combined":
        return some(score, weight)
    if mode == "variance_aware":
        return F.when(noise.isNull(), some(weight)).otherwise(1.0 / F.greatest(noise * noise, F.lit(1e-12)))
    raise ValueError(f"no such weighting: {mode}")


def star_summary(stars: DataFrame, by: list[str]) -> DataFrame:
    """Medians of width, eccentricity, signal to noise and flux, and the width's interquartile range; nulls are passed over."""
    mid = lambda c: F.percentile(c, F.lit(0.5))
    q = F.percentile("fwhm", F.array(F.lit(0.25), F.lit(0.75)))
    return stars.groupBy(*by).agg(mid("fwhm").alias("fwhm_median"), (q[1] - q[0]).alias("fwhm_iqr"), mid("ecc").alias("ecc_median"), mid("snr").alias("snr_median"), mid("flux").alias("flux_median"))


def tiled_stats(tiles: DataFrame, by: list[str]) -> DataFrame:
    """tiles (by, n, lo, hi, s, ss, med), sums of whole numbers: min, max, mean, deviation; `median` is the mean of the tiles' medians by pixels,
    so it depends on the tiles."""
    n = F.sum("n").cast("double")
    t = tiles.groupBy(*by).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), ratio(F.sum("s"), n).alias("mean"), ratio(F.sum("ss"), n).alias("_q"), ratio(F.sum(F.col("med") * F.col("n")), n).alias("median"))
    return t.withColumn("std", F.sqrt(F.greatest(F.col("_q") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("_q")


def single_pass(samples: DataFrame, px: list[str], low: float, high: float, min_samples: int = 3, max_fraction: float = 0.5) -> DataFrame:
    """Mean after one rejection around the median, with the guard; a pixel without spread rejects too what differs from the median."""
    w = Window.partitionBy(*px)
    d = samples.repartition(*px).withColumns({"c": F.percentile("v", F.lit(0.5)).over(w), "n": F.count("v").over(w), "s": F.sum("v").over(w), "ss": F.sum(F.col("v") * F.col("v")).over(w)})
    n, s, ss = (F.col(k).cast("double") for k in ("n", "s", "ss"))
    d = d.withColumn("sd", F.sqrt(F.greatest((ss - s * s / n) / n, F.lit(0.0))))
    d = d.withColumns({"lo": F.col("v") < F.col("c") - low * F.col("sd"), "hi": F.col("v") > F.col("c") + high * F.col("sd")})
    r = F.count_if(F.col("lo") | F.col("hi")).over(w)
    d = d.withColumn("go", (F.col("n") - r >= min_samples) & (r <= F.col("n") * max_fraction))
    keep = ~(F.col("go") & (F.col("lo") | F.col("hi")))
    return d.groupBy(*px).agg(ratio(F.sum(F.when(keep, F.col("v"))), F.count_if(keep)).alias("master"), F.count_if(keep).alias("coverage"), F.count_if(F.col("go") & F.col("lo")).alias("n_low"), F.count_if(F.col("go") & F.col("hi")).alias("n_high"))


def select_frames(frames: DataFrame, by: list[str], strategy: str, most: int) -> DataFrame:
    """frames (by, frame, weight): the lowest_weight ones, the downweighted ones (below 1, lowest first) or the first by id (frame_id)."""
    if strategy not in ("lowest_weight", "downweighted", "frame_id"):
        raise ValueError(f"no such strategy: {strategy}")
    d = frames.filter("weight < 1") if strategy == "downweighted" else frames
    order = ["frame"] if strategy == "frame_id" else ["weight", "frame"]
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)


def best_candidate(candidates: DataFrame, by: list[str], passed: str, score: str, id_col: str) -> DataFrame:
    """The candidate that passed, if any did, with the highest score; the least id of equals."""
    w = Window.partitionBy(*by).orderBy(F.desc(passed), F.desc(score), id_col)
    return candidates.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def append_unique(values: Column, more: Column) -> Column:
    """values with what of more isn't there yet, in order."""
    return F.array_distinct(F.concat(F.coalesce(values, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>"))))


def source_records(warped: DataFrame, normalised: DataFrame | None) -> DataFrame:
    """(frame_id, path) that integration reads: the normalised ones if that stage ran at all, else the warped; source names which."""
    d, name = (warped, "warp") if normalised is None else (normalised, "local_normalization")
    return d.select("frame_id", "path", F.lit(name).alias("source"))


def is_integer_shift(m: Column, tolerance: float = 1e-6) -> Column:
    """m: nine numbers by row. Identity but for whole translations."""
    near = lambda i, want: F.abs(m[i] - want) <= tolerance
    out = near(2, F.rint(m[2])) & near(5, F.rint(m[5]))
    for i, want in ((0, 1.0), (1, 0.0), (3, 0.0), (4, 1.0), (6, 0.0), (7, 0.0), (8, 1.0)):
        out = out & near(i, want)
    return out


def passthrough(warped: DataFrame, reference: int) -> DataFrame:
    """Rows of a run without local normalisation: each frame's warped image, unchanged."""
    return warped.select("frame_id", F.lit(reference).alias("reference_frame_id"), F.col("path").alias("normalized_path"), F.lit("disabled").alias("status"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"))


def mask_rollup(frames: DataFrame, by: list[str]) -> DataFrame:
    """frames (by, weight, given, category): active frames, masked ones (weight 0), those without a known category, and frames whose given
    weight is missing or differs."""
    zero = F.col("weight") <= 0
    known = F.col("category").isNotNull() & (F.col("category") != "unknown")
    s = frames.groupBy(*by).agg(
        F.count("*").alias("frames"), F.count_if(~zero).alias("active"), F.count_if(zero).alias("masked"), F.count_if(zero & ~known).alias("unknown_zero_weight"),
        F.count_if(F.col("given").isNull()).alias("weight_missing"), F.count_if(F.col("given") != F.col("weight")).alias("weight_mismatch"),
    )
    return s.withColumn("passed", F.col("unknown_zero_weight") + F.col("weight_missing") + F.col("weight_mismatch") == 0)


def growth(baseline: DataFrame, candidate: DataFrame, key: str, limits: dict[str, float]) -> DataFrame:
    """Metrics of two runs: the candidate's over the baseline's, and whether each stays within its factor."""
    j = baseline.select(key, *[F.col(m).alias(f"b_{m}") for m in limits]).join(candidate.select(key, *[F.col(m).alias(f"c_{m}") for m in limits]), key)
    grown = {f"{m}_ratio": ratio(F.col(f"c_{m}"), F.col(f"b_{m}")) for m in limits}
    failed = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"{m}_ratio") > f, F.col(f"c_{m}") > 0), m) for m, f in limits.items()]))
    return j.withColumns(grown).select(key, *grown, F.array_join(failed, ",").alias("failed"))


def parity(pairs: DataFrame, by: list[str], max_rms: float, max_relative: float) -> DataFrame:
    """pairs (by, c, r): rms of the difference, over the reference's rms, and whether both are small enough."""
    d = pairs.withColumn("d", F.col("c") - F.col("r"))
    rms = lambda c: F.sqrt(ratio(F.sum(F.col(c) * F.col(c)), F.count(c)))
    s = d.groupBy(*by).agg(rms("d").alias("rms"), F.coalesce(F.try_divide(rms("d"), rms("r")), F.lit(0.0)).alias("relative"))
    return s.withColumn("passed", (F.col("rms") <= max_rms) & (F.col("relative") <= max_relative))


def determinism(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, sha256) of two runs: same, different, or on one side alone."""
    j = a.select(key, F.col("sha256").alias("x")).join(b.select(key, F.col("sha256").alias("y")), key, "full_outer")
    return j.select(key, F.when(F.col("y").isNull(), "baseline_only").when(F.col("x").isNull(), "candidate_only").when(F.col("x") == F.col("y"), "same").otherwise("different").alias("outcome"))


def proposal_audit(tiles: DataFrame, multiplier: float, scale: float = 1.0) -> DataFrame:
    """tiles (tile, contribution, signed): what a multiplier of the focus frames would change, and whether it moves the tile towards the reference."""
    delta = (F.lit(multiplier) - 1.0) * F.col("contribution") * scale
    d = tiles.withColumn("predicted", delta)
    toward = F.when((F.col("signed") != 0) & (F.col("predicted") != 0), F.col("signed") * F.col("predicted") < 0)
    return d.withColumns({"toward": toward, "after": F.col("signed") + F.col("predicted")})


def proposal_verdict(audited: DataFrame) -> DataFrame:
    s = audited.agg(F.count("toward").alias("known"), F.count_if("toward").alias("toward"))
    return s.withColumn("recommendation", F.when(F.col("known") - F.col("toward") > F.col("toward"), "reject_downweight_direction").otherwise("directionally_promising"))


def policy_replay(contributions: DataFrame, proposal: DataFrame) -> DataFrame:
    """contributions (tile, frame, contribution) of chosen frames, proposal (tile, multiplier, canonical): by tile the sums before and after the
    multiplier, and how far their change is from the canonical one."""
    p = proposal.select("tile", F.coalesce("multiplier", F.lit(1.0)).alias("m"), "canonical")
    s = contributions.groupBy("tile").agg(F.sum("contribution").alias("original"))
    d = p.join(s, "tile", "left").withColumn("proposed", F.col("original") * F.col("m"))
    return d.select("tile", F.col("m").alias("multiplier"), "original", "proposed", ((F.col("proposed") - F.col("original")) - (F.col("m") - 1.0) * F.col("canonical")).alias("delta_minus_canonical"))


def timing_ratios(ours: DataFrame, theirs: DataFrame, key: str, least: float = 1.25) -> DataFrame:
    """(key, seconds) on either side: how many times as fast, and whether that is enough."""
    j = ours.select(key, F.col("seconds").alias("a")).join(theirs.select(key, F.col("seconds").alias("b")), key)
    s = j.withColumn("speedup", ratio(F.col("b"), F.col("a")))
    return s.select(key, "speedup", F.coalesce(F.col("speedup") >= least, F.lit(False)).alias("passed"))


def two_pair_similarity(ra: tuple[Column, Column], rb: tuple[Column, Column], ma: tuple[Column, Column], mb: tuple[Column, Column], least: float) -> dict[str, Column]:
    """a, b, tx, ty of the similarity that takes two moving points to two reference points; null where either pair is closer than least."""
    rx, ry, mx, my = rb[0] - ra[0], rb[1] - ra[1], mb[0] - ma[0], mb[1] - ma[1]
    q = mx * mx + my * my
    ok = (F.sqrt(q) >= least) & (F.sqrt(rx * rx + ry * ry) >= least)
    a, b = F.when(ok, F.try_divide(mx * rx + my * ry, q)), F.when(ok, F.try_divide(mx * ry - my * rx, q))
    return {"a": a, "b": b, "tx": ra[0] - (a * ma[0] - b * ma[1]), "ty": ra[1] - (b * ma[0] + a * ma[1])}
