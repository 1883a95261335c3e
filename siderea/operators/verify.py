"""Contracts: facts of a run against what they must be. Names of checks and outcomes are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderea.operators.compare import ratio


def failing(tests: dict[str, Column]) -> Column:
    """Names of the tests that fail; a test that can't be decided fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in tests.items()]))


def registration_contract(rows: DataFrame, by: list[str], max_rms: float | None = None, min_inliers: int | None = None, all_accepted: bool = False) -> DataFrame:
    """rows (by, accepted, rms, inliers): thresholds hold for accepted frames only; an accepted frame without the figure fails."""
    ok, rms = F.col("accepted"), F.col("rms").cast("double")
    known = ~F.isnan(rms) & (F.abs(rms) < float("inf"))
    s = rows.groupBy(*by).agg(
        F.count("*").alias("frames"), F.count_if(ok).alias("accepted"), F.max(F.when(ok & known, rms)).alias("max_rms"), F.min(F.when(ok, F.col("inliers"))).alias("min_inliers"),
        F.count_if(ok & ~F.coalesce(known & (rms <= (max_rms or 0)), F.lit(False))).alias("_wide"), F.count_if(ok & ~F.coalesce(F.col("inliers") >= (min_inliers or 0), F.lit(False))).alias("_few"),
    )
    some = F.col("accepted") > 0
    tests = {"registration_outputs_present": F.col("frames") > 0}
    if max_rms is not None or min_inliers is not None or all_accepted:
        tests["accepted_registration_outputs_present"] = some
    if max_rms is not None:
        tests["accepted_registration_rms_within_threshold"] = some & (F.col("_wide") == 0)
    if min_inliers is not None:
        tests["accepted_registration_inliers_meet_threshold"] = some & (F.col("_few") == 0)
    if all_accepted:
        tests["all_registration_outputs_accepted"] = F.col("accepted") == F.col("frames")
    return s.withColumn("failed_checks", failing(tests)).drop("_wide", "_few")


def warp_contract(outputs: DataFrame, skipped: DataFrame, registered: DataFrame, by: list[str], min_valid: float | None = None, max_skipped: int | None = None, artifacts: bool = False, all_registered: bool = False) -> DataFrame:
    """outputs (by, frame, valid_fraction, ready), skipped (by, frame, reason) and registered (by, frame): a run that warped nothing, left
    frames out without a reason or lost an accepted one fails. Runs known by any of the three take part."""
    few = F.lit(False) if min_valid is None else ~F.coalesce(F.col("valid_fraction") >= min_valid, F.lit(False))
    o = outputs.groupBy(*by).agg(F.count("*").alias("outputs"), F.min("valid_fraction").alias("least_valid"), F.count_if(few).alias("_few"), F.count_if(~F.coalesce("ready", F.lit(False))).alias("_unready"))
    s = skipped.groupBy(*by).agg(F.count("*").alias("skipped"), F.count_if(F.trim(F.coalesce("reason", F.lit(""))) == "").alias("_unsaid"))
    lost = registered.join(outputs.select(*by, "frame").distinct(), [*by, "frame"], "left_anti").groupBy(*by).agg(F.count_distinct("frame").alias("lost"))
    known = registered.groupBy(*by).agg(F.count_distinct("frame").alias("_known"))
    d = o.join(s, by, "full_outer").join(known, by, "full_outer").join(lost, by, "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("outputs", "skipped", "lost", "_few", "_unready", "_unsaid", "_known")})
    some = F.col("outputs") > 0
    tests = {"warp_outputs_present": some, "skipped_warp_rows_have_reasons": F.col("_unsaid") == 0}
    if artifacts:
        tests["warp_output_artifacts_ready"] = some & (F.col("_unready") == 0)
    if min_valid is not None:
        tests["warp_valid_fraction_meets_threshold"] = some & (F.col("_few") == 0)
    if max_skipped is not None:
        tests["warp_skipped_frames_within_threshold"] = F.col("skipped") <= max_skipped
    if all_registered:
        tests["all_accepted_registration_frames_warped"] = (F.col("_known") > 0) & (F.col("lost") == 0)
    return d.withColumn("failed_checks", failing(tests)).select(*by, "outputs", "skipped", "lost", "least_valid", "failed_checks")


def pixel_closure(groups: DataFrame) -> DataFrame:
    """groups gain failed_checks: do masked frames, coverage, rejections and samples agree? One row a group: mask_passed, unknown_zero,
    mask_active, link_active, provenance_active, coverage_active, coverage_geometric, output_geometric, frames (counts, null if not recorded),
    geometric_available, coverage_available, summary_match (null if not recorded), terms (array), rejection, coverage_rejected,
    provenance_rejected, closure_status, valid_before, valid_after, rejected."""
    c = F.col
    active = c("mask_active")
    same = lambda n: c(n).isNull() | (active == c(n))
    has = lambda t: F.array_contains("terms", t)
    counted = F.coalesce(c("coverage_geometric") > 0, F.lit(False)) | F.coalesce(c("output_geometric") > 0, F.lit(False))
    geometric = c("geometric_available") | counted
    covered = c("coverage_available") | has("post_rejection_coverage") | has("low_rejection") | has("high_rejection")
    rejecting = (F.coalesce("rejection", F.lit("none")) != "none") & (has("low_rejection") | has("high_rejection"))
    sums = c("valid_before").isNull() | c("valid_after").isNull() | c("rejected").isNull() | (c("valid_before") - c("valid_after") == c("rejected"))
    tests = {
        "frame_mask_contract_passed": c("mask_passed") & (c("unknown_zero") == 0),
        "frame_mask_active_matches_output_link": c("link_active").isNull() | active.eqNullSafe(c("link_active")),
        "active_frame_count_matches_provenance": active.isNotNull() & same("provenance_active") & same("coverage_active"),
        "geometric_coverage_count_matches_active": ~geometric | (active.isNotNull() & same("coverage_geometric") & same("output_geometric")),
        "post_rejection_coverage_present": ~covered | has("post_rejection_coverage"),
        "geometric_coverage_present": ~geometric | c("geometric_available") | has("geometric_warp_coverage") | counted,
        "dq_summary_matches_provenance": c("summary_match").isNull() | c("summary_match"),
        "rejection_sample_count_recorded": ~rejecting | (c("coverage_rejected").isNotNull() & c("provenance_rejected").isNotNull()),
        "rejection_sample_count_matches": ~rejecting | c("coverage_rejected").eqNullSafe(c("provenance_rejected")),
        "sample_accounting_closure_passed": ~(rejecting | has("post_rejection_coverage")) | (F.coalesce(c("closure_status") == "passed", F.lit(False)) & sums),
        "active_not_greater_than_input_frame_count": c("frames").isNull() | active.isNull() | (active <= c("frames")),
    }
    return groups.withColumn("failed_checks", failing(tests))


def source_dq_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, active, applied, status, source, order, required, invalid, would_invalid, flagged), one a frame: sums over active frames,
    samples whose mask came too late for star detection, and whether all that was invalid was applied."""
    n = lambda c, on=F.lit(True): F.coalesce(F.sum(F.when(on, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("bigint")
    active, applied = F.col("active"), F.coalesce("applied", F.lit(False))
    order = F.when(F.coalesce("order", F.lit("")) != "", F.col("order")).when(F.col("source").startswith("resident_post_registration_pre_warp"), "post_registration_pre_warp").when(F.col("source").startswith("resident_calibrated"), "calibration_pre_registration").otherwise("unspecified")
    seen = order == "calibration_pre_registration"
    s = rows.groupBy(*by).agg(
        F.count("*").alias("frames"), F.count_if(active).alias("active_frames"), n("invalid", active).alias("invalid"), n("would_invalid", active).alias("would_invalid"), n("flagged", active).alias("flagged"),
        n("invalid", active & applied).alias("applied"), n("invalid").alias("_all"), n("invalid", applied).alias("_all_applied"), F.count_if(active & (F.col("invalid") > 0)).alias("frames_with_invalid"),
        F.count_if(F.col("status").startswith("unsupported")).alias("unsupported"), F.count_if(F.col("status") == "native_method_unavailable").alias("native_missing"),
        n("invalid", ~seen & F.coalesce("required", F.lit(True))).alias("required_not_visible"),
    )
    passed = (F.col("unsupported") == 0) & (F.col("native_missing") == 0) & (F.col("applied") == F.col("invalid")) & (F.col("_all_applied") == F.col("_all"))
    return s.withColumns({"guarded": F.greatest(F.lit(0), F.col("would_invalid") - F.col("invalid")), "passed": passed}).drop("_all", "_all_applied")


def reentry(invocation: Column, masters: Column, artifacts: Column, contract: Column) -> dict[str, Column]:
    """From what an unfinished run left behind: the strongest boundary that is ready, the strongest that can be resumed, and what to do."""
    calibration = masters & artifacts & contract
    strongest = F.when(calibration, "resident_calibration").when(masters, "resident_master_cache")
    action = (
        F.when(invocation & calibration, "reenter_from_calibration_boundary").when(invocation & masters, "reenter_from_master_cache_boundary")
        .when(calibration, "blocked_calibration_boundary_reentry_missing_invocation").when(masters, "blocked_master_cache_reentry_missing_invocation")
        .when(invocation, "reenter_from_run_invocation").otherwise("blocked_incomplete_resident_run")
    )
    first = F.when(invocation, "pre_integration_invocation")
    return {"strongest_ready": F.coalesce(strongest, first), "strongest_supported": F.when(invocation, F.coalesce(strongest, first)), "resume_action": action}


def input_attribution(replay_passed: Column, exact_status: Column, exact_passed: Column, same_pre: Column, pre: Column, most: int = 16) -> dict[str, Column]:
    """Where a run's rejections differ from a replay's: same_pre, differing rejections of equal samples; pre, differing samples. exact_passed
    is null where the exact input was not run."""
    exact = F.coalesce(exact_passed, F.lit(False))
    parity, attributed = (pre == 0) & (same_pre <= most), replay_passed & exact
    status = (
        F.when(parity, "resident_output_parity_ready").when(attributed & (pre == 0), "resident_registration_warp_input_delta")
        .when(attributed, "resident_geometric_coverage_or_transform_delta").otherwise("unattributed")
    )
    advice = (
        F.when(~replay_passed, "fix_cpu_registered_replay_or_run_artifacts").when(exact_status != "completed", "run_cuda_exact_input_audit_when_cuda_is_available")
        .when(~F.coalesce(exact_passed, F.lit(True)), "fix_resident_hardened_winsorized_kernel_semantics").when(pre != 0, "target_resident_geometric_coverage_or_transform_parity")
        .when(same_pre > most, "target_resident_registration_warp_input_parity").otherwise("resident_rejection_input_semantics_ready")
    )
    return {"attribution": status, "recommendation": advice, "passed": replay_passed & exact & (status != "unattributed")}


#: What can be made faster, and the stage whose time shows it.
TARGETS = {
    "io_upload_calibration_pipeline": "light_read_upload_calibrate",
    "resident_registration_warp": "resident_registration_warp",
    "output_write_policy": "output_write",
    "resident_master_cache": "master_build_or_load",
}


def guidance(stages: DataFrame, by: list[str]) -> DataFrame:
    """stages (by, stage, actual, baseline, status, kind) ranked by what there is to gain: seconds, a quarter more where it got slower, none
    where workers' times are added up. Stages without any figure are left out; share is of the seconds ranked."""
    ids, names = list(TARGETS), list(TARGETS.values())
    at = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("stage"))
    d = stages.filter(F.col("stage").isin(names) & (F.col("actual").isNotNull() | F.col("baseline").isNotNull())).withColumn("_at", at)
    cumulative = F.coalesce(F.col("kind") == "worker_cumulative", F.lit(False))
    now = F.coalesce(F.col("actual").cast("double"), F.lit(0.0))
    d = d.withColumns({"target": F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("_at").cast("int")), "score": F.when(cumulative, 0.0).otherwise(now * F.when(F.col("status") == "regressed", 1.25).otherwise(1.0))})
    total = F.sum(F.when(cumulative, 0.0).otherwise(now)).over(Window.partitionBy(*by))
    d = d.withColumns({"rank": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "_at")), "share": F.when(total > 0, ratio(F.col("actual"), total))})
    return d.select(*by, "rank", "target", "score", "share")


def grid_contract(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells (by, row, col, scale, offset, valid, filled) of a normalisation's grids against headers repeated in each row (rows, cols,
    empty_filled, status): the grid is whole, each cell has its coefficients, and the cells filled are those counted."""
    head = [*by, "rows", "cols", "empty_filled", "status"]
    s = cells.groupBy(*head).agg(
        F.count("*").alias("cells"), F.count_distinct("row", "col").alias("_places"), F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"),
        F.count("scale").alias("_scales"), F.count("offset").alias("_offsets"), F.count_if(F.coalesce(F.col("valid") >= 0, F.lit(False))).alias("_counted"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid_pixels"), F.count_if("filled").alias("filled"),
    )
    size = F.col("rows") * F.col("cols")
    whole = (F.col("_places") == size) & (F.col("cells") == size) & (F.col("_r0") == 0) & (F.col("_c0") == 0) & (F.col("_r1") == F.col("rows") - 1) & (F.col("_c1") == F.col("cols") - 1)
    tests = {
        "grid_rows_positive": F.col("rows") > 0, "grid_cols_positive": F.col("cols") > 0, "status_grid_shape": whole, "repaired_scale_grid_shape": whole & (F.col("_scales") == size),
        "repaired_offset_grid_shape": whole & (F.col("_offsets") == size), "valid_pixel_grid_shape": whole & (F.col("_counted") == size), "empty_tile_repair_recorded": F.col("empty_filled") == F.col("filled"),
        "nonempty_status_has_valid_pixels": F.col("status").isin("reference", "skipped_zero_weight", "empty") | (F.col("valid_pixels") > 0),
    }
    return s.withColumn("failed_checks", failing(tests)).select(*by, "cells", "valid_pixels", "filled", "failed_checks")
