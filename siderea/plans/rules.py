"""Masks, decisions, roll-ups and run comparisons as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siderea.operators import compare, decisions, masks, quality, stack
from siderea.plans import queries as Q
from siderea.plans.queries import IMAGES_SQL, MAX_SQL, PAIRS_SQL, SAMPLES_SQL, STD, query, rounded
from siderea.sources.tables import cents, images, samples, table

NOISE_SQL = f"md AS (SELECT frame, quantile_cont(v, 0.5) AS med, {STD} AS std FROM images GROUP BY frame), bg AS (SELECT frame, any_value(med) AS med, any_value(std) AS std, CASE WHEN quantile_cont(abs(v - med), 0.5) > 0 THEN quantile_cont(abs(v - med), 0.5) * 1.4826 WHEN any_value(std) > 0 THEN any_value(std) ELSE 1.0 END AS noise FROM images JOIN md USING (frame) GROUP BY frame)"


# --- masks ------------------------------------------------------------------------------------------------------------


@query(f"WITH {IMAGES_SQL}, md AS (SELECT frame, quantile_cont(v, 0.5) AS med, {STD} AS std FROM images GROUP BY frame) SELECT frame, y, x, v > med + 2.0 * std AS hot, CASE WHEN v > med + 2.0 * std THEN med ELSE CAST(v AS DOUBLE) END AS fixed FROM images JOIN md USING (frame)")
def replace_hot(spark, sf):
    return masks.replace_hot(images(spark, sf), ["frame"], 2.0).select("frame", "y", "x", "hot", "fixed")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax = 0 THEN 64 WHEN l_quantity / 50.0 > 0.5 THEN 0 ELSE 64 END AS dq FROM lineitem")
def coverage_mask(spark, sf):
    c = F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_quantity") / 50.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", masks.from_coverage(c, 64).alias("dq"))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'missing' WHEN vec_id % 5 = 0 THEN 'shape_mismatch' ELSE 'ok' END AS status, CASE WHEN vec_id % 7 <> 0 AND vec_id % 5 <> 0 THEN CAST(len(list_filter(embedding, lambda x: x > 0.2)) AS INTEGER) END AS invalid FROM embeddings")
def source_invalid_mask(spark, sf):
    """Arrays with values that aren't finite (those above 0.2 here), absent arrays and ones of another length than expected."""
    k = F.col("vec_id")
    data = F.when(k % 7 != 0, F.transform("embedding", lambda v: F.when(v > 0.2, float("nan")).otherwise(v.cast("double"))))
    e = table(spark, sf, "embeddings").select("vec_id", data.alias("data"))
    return masks.source_mask(e, "data", F.when(k % 5 == 0, 60).otherwise(64)).select("vec_id", "status", "invalid")


@query(f"WITH {SAMPLES_SQL} SELECT frame, count(*) AS samples, count(*) FILTER (dq <> 0) AS invalid, count(*) FILTER (dq & 2 <> 0) AS saturated, count(*) FILTER (dq & 4 <> 0) AS hot_pixel, count(*) FILTER (dq & 1 <> 0) AS no_data FROM samples GROUP BY frame")
def dq_invalid_mask(spark, sf):
    return masks.flag_counts(samples(spark, sf), ["frame"]).select("frame", "samples", "invalid", "saturated", "hot_pixel", "no_data")


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 1 ELSE CAST(round_even(l_quantity / 4.0, 0) AS INTEGER) END AS dq FROM lineitem")
def sidecar_bits(spark, sf):
    v = F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 4.0).otherwise(float("inf"))
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", masks.sidecar_bits(v).alias("dq"))


@query(f"WITH {IMAGES_SQL}, {NOISE_SQL} SELECT frame, med AS median, round(noise, 6) AS noise, round(med + 3.0 * noise, 6) AS hot_above, round(med - 2.5 * noise, 6) AS cold_below FROM bg")
def inline_thresholds(spark, sf):
    return rounded(masks.thresholds(images(spark, sf), ["frame"], 3.0, 2.5), "noise", "hot_above", "cold_below")


@query(f"WITH {IMAGES_SQL}, {NOISE_SQL}, m AS (SELECT frame, y, x, CASE WHEN v > med + 2.0 * noise THEN 4 WHEN v < med - 2.0 * noise THEN 8 END AS dq FROM images JOIN bg USING (frame)) SELECT * FROM m WHERE dq IS NOT NULL")
def inline_cosmetic_mask(spark, sf):
    return masks.threshold_mask(images(spark, sf), ["frame"], 2.0, 2.0)


@query(f"WITH {IMAGES_SQL}, {NOISE_SQL}, m AS (SELECT filt, y, x, v, v > med + 2.0 * noise OR v < med - 2.0 * noise AS bad FROM images JOIN bg USING (frame)) SELECT filt, y, x, round(coalesce(CAST(sum(v) FILTER (NOT bad) AS DOUBLE) / count(*) FILTER (NOT bad), 0), 6) AS master, count(*) FILTER (NOT bad) AS coverage FROM m GROUP BY filt, y, x")
def masked_stack(spark, sf):
    """Pixels that the mask names have no value in the stack."""
    im = images(spark, sf)
    d = masks.masked(im, masks.threshold_mask(im, ["frame"], 2.0, 2.0), ["frame", "y", "x"])
    return rounded(stack.stack(d, ["filt", "y", "x"]).select("filt", "y", "x", "master", "coverage"), "master")


ISOLATED_SQL = f"{MAX_SQL}, {NOISE_SQL}, iso AS (SELECT nb.frame, y, x, any_value(v) AS v FROM nb JOIN bg ON bg.frame = nb.frame GROUP BY nb.frame, y, x HAVING any_value(v) > any_value(med + 1.5 * noise) AND any_value(v) > quantile_cont(nv, 0.5) + 1.5 * any_value(noise) AND count(*) FILTER (nv > med + 1.5 * noise) < 2)"


@query(f"WITH {ISOLATED_SQL} SELECT i.frame, i.y, i.x, i.v FROM iso i WHERE NOT EXISTS (SELECT 1 FROM mx s WHERE s.frame = i.frame AND 1 + s.frame % 5 >= 3 AND s.x % 3 * 0.45 <= 0.8 AND (s.y - i.y) * (s.y - i.y) + (s.x - i.x) * (s.x - i.x) <= 4)")
def star_protected_defects(spark, sf):
    m = Q._maxima(spark, sf)
    s = m.select("frame", F.col("y").alias("sy"), F.col("x").alias("sx"), (F.col("frame") % 5 + 1).alias("npix"), (F.col("x") % 3 * 0.45).alias("sharpness"))
    return masks.unprotected_defects(images(spark, sf), s, ["frame"], 8, 8, 1.5, 2.0, 3, 0.8).select("frame", "y", "x", "v")


@query(f"WITH {IMAGES_SQL} SELECT frame, y, x, round(least(greatest(CAST(v AS DOUBLE) * 0.5 + 100, -50000), 60000), 3) AS v FROM images")
def candidate_transform(spark, sf):
    return images(spark, sf).select("frame", "y", "x", F.round(masks.transformed(F.col("v"), 0.5, 100.0, -50000.0, 60000.0), 3).alias("v"))


# --- decisions on runs and frames ----------------------------------------------------------------------------------------


@query(f"""WITH {PAIRS_SQL}, ct AS (SELECT filt, quantile_cont(abs(c - r), 0.9) AS cut FROM pairs GROUP BY filt),
t AS (SELECT filt, y, x, count(*) AS valid, count(*) FILTER (abs(c - r) >= cut) AS tail, count(*) FILTER (abs(c - r) >= cut AND c < r) AS neg, count(*) FILTER (abs(c - r) >= cut AND c > r) AS pos, max(abs(c - r)) FILTER (abs(c - r) >= cut) AS top FROM pairs JOIN ct USING (filt) GROUP BY filt, y, x),
k AS (SELECT *, row_number() OVER (PARTITION BY filt ORDER BY tail DESC, top DESC NULLS LAST, y, x) AS k FROM t),
f AS (SELECT filt, CAST(sum(tail) AS BIGINT) AS tail, sum(neg) AS neg, sum(pos) AS pos, sum(tail) FILTER (y IN (0, 7) OR x IN (0, 7)) AS edge, max(tail) FILTER (k = 1) AS top, max(CAST(tail AS DOUBLE) / valid) FILTER (k = 1) AS local FROM k GROUP BY filt)
SELECT filt, tail, CASE WHEN tail = 0 THEN 'no_tail_pixels' WHEN CAST(edge AS DOUBLE) / tail >= 0.5 THEN 'edge_dominated_tail' WHEN CAST(top AS DOUBLE) / tail >= 0.1 OR local >= 0.1 THEN 'localized_tail' WHEN CAST(neg AS DOUBLE) / tail >= 0.95 OR CAST(pos AS DOUBLE) / tail >= 0.95 THEN 'signed_global_tail' ELSE 'diffuse_tail' END AS recommendation FROM f""")
def outlier_recommendation(spark, sf):
    """By filter, tiles of one pixel."""
    p = Q._pairs(spark, sf).withColumn("d", F.col("c") - F.col("r"))
    cut = p.groupBy("filt").agg(F.percentile(F.abs("d"), F.lit(0.9)).alias("cut"))
    tail = F.abs("d") >= F.col("cut")
    t = p.join(cut, "filt").groupBy("filt", "y", "x").agg(F.count("*").alias("valid"), F.count_if(tail).alias("tail"), F.count_if(tail & (F.col("d") < 0)).alias("neg"), F.count_if(tail & (F.col("d") > 0)).alias("pos"), F.max(F.when(tail, F.abs("d"))).alias("top"))
    best = F.max(F.struct("tail", "top", (-F.col("y")).alias("a"), (-F.col("x")).alias("b"), "valid"))
    edge = F.col("y").isin(0, 7) | F.col("x").isin(0, 7)
    f = t.groupBy("filt").agg(F.sum("tail").alias("tail"), F.sum("neg").alias("neg"), F.sum("pos").alias("pos"), F.sum(F.when(edge, F.col("tail"))).alias("edge"), best.alias("best"))
    return f.select("filt", "tail", decisions.recommendation(F.col("tail"), F.col("neg"), F.col("pos"), compare.ratio(F.col("edge"), F.col("tail")), F.col("best.tail"), compare.ratio(F.col("best.tail"), F.col("best.valid"))).alias("recommendation"))


RUN_SQL = "r AS (SELECT o_orderkey AS k, o_orderkey % 9 <> 0 AS resident, CASE WHEN o_custkey % 11 = 0 THEN 'warp' END AS failed, o_orderkey % 4 = 0 AS complete, o_custkey % 5 = 0 AS reenter, o_orderkey % 3 <> 0 AS started, CASE WHEN o_custkey % 6 = 1 THEN 'reenter_from_boundary' END AS boundary, o_custkey % 6 = 2 AS cal, o_custkey % 6 = 3 AS masters, o_custkey % 3 AS missing FROM orders)"


@query(f"WITH {RUN_SQL} SELECT k, CASE WHEN NOT resident THEN 'not_resident_run' WHEN failed IS NOT NULL THEN 'blocked_failed_resident_run' WHEN complete THEN CASE WHEN missing > 0 THEN 'blocked_missing_resident_artifacts' ELSE 'noop_complete' END WHEN reenter THEN 'reenter_from_run_invocation' WHEN started THEN coalesce(boundary, CASE WHEN cal THEN 'blocked_calibration_boundary_reentry_unavailable' WHEN masters THEN 'blocked_master_cache_reentry_unavailable' ELSE 'blocked_incomplete_resident_run' END) ELSE 'blocked_incomplete_resident_run' END AS action FROM r")
def resume_preflight(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    action = decisions.resume_action(k % 9 != 0, F.when(c % 11 == 0, "warp"), k % 4 == 0, c % 5 == 0, k % 3 != 0, F.when(c % 6 == 1, "reenter_from_boundary"), c % 6 == 2, c % 6 == 3, c % 3)
    return table(spark, sf, "orders").select(k.alias("k"), action.alias("action"))


REG_SQL = "g AS (SELECT o_orderkey AS k, o_orderpriority AS run, CASE o_orderkey % 8 WHEN 0 THEN 'reference' WHEN 1 THEN 'excluded' WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' ELSE 'ok' END AS status, o_custkey % 20 AS inliers, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE o_custkey % 4 * 0.75 END AS rms, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 9 END AS capacity FROM orders), dec AS (SELECT k, run, status, CASE WHEN status = 'reference' THEN 'reference' WHEN status = 'excluded' THEN 'already_excluded' WHEN status = 'failed' THEN 'already_failed' WHEN status <> 'ok' THEN 'not_applicable' WHEN rms IS NULL OR rms > 2.0 OR (inliers < 6 AND coalesce(capacity, 6) >= 6) THEN 'rejected' ELSE 'accepted' END AS decision FROM g)"


def _registered(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(k % 8 == 0, "reference").when(k % 8 == 1, "excluded").when(k % 8 == 2, "failed").when(k % 8 == 3, "skipped").otherwise("ok")
    g = table(spark, sf, "orders").select(k.alias("k"), F.col("o_orderpriority").alias("run"), status.alias("status"), (c % 20).alias("inliers"), F.when(c % 13 == 0, float("nan")).otherwise(c % 4 * 0.75).alias("rms"), F.when(c % 3 > 0, c % 9).alias("capacity"))
    return g.withColumn("decision", decisions.registration_decision(F.col("status"), F.col("inliers"), F.col("rms"), F.col("capacity"), "exclude", 6, 2.0))


@query(f"WITH {REG_SQL} SELECT k, decision FROM dec")
def registration_quality(spark, sf):
    return _registered(spark, sf).select("k", "decision")


@query(f"WITH {REG_SQL} SELECT run, decision, count(*) AS n, min(k) AS first, max(k) AS last FROM dec GROUP BY run, decision")
def registration_quality_summary(spark, sf):
    return _registered(spark, sf).groupBy("run", "decision").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))


@query(f"WITH {REG_SQL}, s AS (SELECT run, count(*) AS frames, count(*) FILTER (decision IN ('accepted', 'reference')) AS accepted FROM dec GROUP BY run) SELECT run, accepted, round(CAST(accepted AS DOUBLE) / frames, 6) AS fraction, concat_ws(',', CASE WHEN accepted < 2 THEN 'min_accepted_frames' END, CASE WHEN CAST(accepted AS DOUBLE) / frames < 0.34 THEN 'min_accepted_fraction' END) AS failed_checks, CASE WHEN accepted >= 2 AND CAST(accepted AS DOUBLE) / frames >= 0.34 THEN 'passed' ELSE 'failed' END AS status FROM s")
def registration_health(spark, sf):
    d = _registered(spark, sf).withColumn("accepted", F.col("decision").isin("accepted", "reference"))
    return rounded(decisions.health(d, ["run"], min_fraction=0.34).select("run", "accepted", "fraction", "failed_checks", "status"), "fraction")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN 'accepted' WHEN o_custkey % 2 = 0 AND o_custkey % 5 <> 0 THEN 'blocked' ELSE 'allowed_quality_rejected_reference' END AS status FROM orders")
def reference_admission(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    gate = F.when(k % 3 == 0, "rejected").when(k % 3 == 1, "accepted")
    return table(spark, sf, "orders").select(k.alias("k"), decisions.admission(gate, c % 2 == 0, c % 5 == 0).alias("status"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 <> 0 THEN 'stack_engine_required_for_rejection' WHEN p_size % 5 = 0 THEN 'explicit_cuda_fast_path_requested' WHEN p_partkey % 2 = 0 THEN 'cuda_backend_stack_engine_default_requires_fast_path_policy' ELSE 'stack_engine_default_requires_explicit_cuda_fast_path' END WHEN p_partkey % 2 = 0 THEN 'cuda_requested_but_unavailable' ELSE 'stack_engine_default' END AS reason FROM part")
def engine_selection(spark, sf):
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", decisions.engine_reason(F.when(k % 2 == 0, "cuda").otherwise("cpu"), F.when(s % 3 == 0, "none").otherwise("sigma"), s % 2 == 0, s % 5 == 0).alias("reason"))


@query("WITH f AS (SELECT s_nationkey AS run, s_suppkey AS frame_id FROM supplier), w AS (SELECT n_nationkey AS run, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN (SELECT CAST(min(frame_id) AS VARCHAR) FROM f WHERE f.run = n_nationkey) WHEN 2 THEN 'L' || (SELECT CAST(max(frame_id) AS VARCHAR) FROM f WHERE f.run = n_nationkey) || '.fits' ELSE 'nowhere' END AS wanted FROM nation) SELECT run, wanted, CASE WHEN coalesce(wanted, '') = '' THEN -1 ELSE (SELECT min(frame_id) FROM f WHERE f.run = w.run AND wanted IN (CAST(frame_id AS VARCHAR), 'L' || frame_id || '.fits', 'L' || frame_id)) END AS reference FROM w")
def reference_override(spark, sf):
    f = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("frame_id"), F.concat(F.lit("lights/L"), F.col("s_suppkey").cast("string"), F.lit(".fits")).alias("path"))
    ends = f.groupBy("run").agg(F.min("frame_id").cast("string").alias("lo"), F.max("frame_id").cast("string").alias("hi"))
    k = F.col("run")
    wanted = F.when(k % 4 == 0, "").when(k % 4 == 1, F.col("lo")).when(k % 4 == 2, F.concat(F.lit("L"), "hi", F.lit(".fits"))).otherwise("nowhere")
    w = table(spark, sf, "nation").select(F.col("n_nationkey").alias("run")).join(ends, "run", "left").select("run", wanted.alias("wanted"))
    return decisions.requested_reference(f, w, F.lit(-1).cast("bigint"))


def _weights_sql(raw: str) -> str:
    return f"WITH r AS (SELECT s_nationkey AS filt, s_suppkey AS frame, greatest({raw}, 1e-6) AS raw FROM (SELECT *, CAST(round(s_acctbal) AS BIGINT) % 7 AS snr, s_suppkey % 5 AS score, s_suppkey % 3 AS w, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 * 0.5 END AS noise FROM supplier)), m AS (SELECT filt, greatest(quantile_cont(raw, 0.5), 1e-6) AS m FROM r GROUP BY filt) SELECT frame, round(greatest(raw / m, 1e-6), 6) AS weight FROM r JOIN m USING (filt)"


def _weights(spark, sf, mode):
    k = F.col("s_suppkey")
    raw = decisions.raw_weight(mode, F.round("s_acctbal").cast("bigint") % 7, k % 5, k % 3, F.when(k % 4 > 0, k % 4 * 0.5))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("filt"), k.alias("frame"), raw.alias("value"))
    return rounded(stack.normalised_weights(s, F.col("value"), ["filt"]).select("frame", "weight"), "weight")


@query(_weights_sql("CAST(coalesce(nullif(snr, 0), nullif(w, 0), 1) AS DOUBLE)"))
def weights_simple_snr(spark, sf):
    return _weights(spark, sf, "simple_snr")


@query(_weights_sql("CAST(coalesce(nullif(score, 0), nullif(w, 0), 1) AS DOUBLE)"))
def weights_combined(spark, sf):
    return _weights(spark, sf, "combined")


@query(_weights_sql("CASE WHEN noise IS NULL THEN CAST(coalesce(nullif(w, 0), 1) AS DOUBLE) ELSE 1.0 / greatest(noise * noise, 1e-12) END"))
def weights_variance_aware(spark, sf):
    return _weights(spark, sf, "variance_aware")


# --- statistics ------------------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT l_suppkey AS frame, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS fwhm, l_discount AS ecc, l_tax * 100 AS snr, l_extendedprice AS flux FROM lineitem) SELECT frame, round(quantile_cont(fwhm, 0.5), 6) AS fwhm_median, round(quantile_cont(fwhm, 0.75) - quantile_cont(fwhm, 0.25), 6) AS fwhm_iqr, round(quantile_cont(ecc, 0.5), 6) AS ecc_median, round(quantile_cont(snr, 0.5), 6) AS snr_median, round(quantile_cont(flux, 0.5), 4) AS flux_median FROM s GROUP BY frame")
def star_summary(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("frame"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity")).alias("fwhm"), F.col("l_discount").alias("ecc"), (F.col("l_tax") * 100).alias("snr"), F.col("l_extendedprice").alias("flux"))
    return rounded(rounded(decisions.star_summary(s, ["frame"]), "fwhm_median", "fwhm_iqr", "ecc_median", "snr_median"), "flux_median", digits=4)


@query(f"WITH {IMAGES_SQL}, t AS (SELECT frame, count(*) AS n, min(v) AS lo, max(v) AS hi, sum(v) AS s, sum(v * v) AS ss, quantile_cont(v, 0.5) AS med FROM images GROUP BY frame, y // 4, x // 4) SELECT frame, CAST(sum(n) AS BIGINT) AS n, min(lo) AS lo, max(hi) AS hi, round(CAST(sum(s) AS DOUBLE) / sum(n), 4) AS mean, round(sqrt(greatest(CAST(sum(ss) AS DOUBLE) / sum(n) - (CAST(sum(s) AS DOUBLE) / sum(n)) * (CAST(sum(s) AS DOUBLE) / sum(n)), 0)), 3) AS std, round(sum(med * n) / sum(n), 4) AS median FROM t GROUP BY frame")
def tiled_stats(spark, sf):
    t = images(spark, sf).groupBy("frame", F.expr("y div 4").alias("ty"), F.expr("x div 4").alias("tx")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.percentile("v", F.lit(0.5)).alias("med"))
    s = decisions.tiled_stats(t, ["frame"])
    return s.select("frame", "n", "lo", "hi", F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std"), F.round("median", 4).alias("median"))


@query(f"""WITH {SAMPLES_SQL}, st AS (SELECT px, quantile_cont(v, 0.5) AS c, {STD} AS s FROM samples GROUP BY px), f AS (SELECT px, v, v < c - 1.5 * s AS lo, v > c + 1.5 * s AS hi FROM samples JOIN st USING (px)),
g AS (SELECT px, count(*) - count(*) FILTER (lo OR hi) >= 3 AND count(*) FILTER (lo OR hi) <= count(*) * 0.5 AS go FROM f GROUP BY px)
SELECT px, round(CAST(sum(v) FILTER (NOT (go AND (lo OR hi))) AS DOUBLE) / count(*) FILTER (NOT (go AND (lo OR hi))), 6) AS master, count(*) FILTER (NOT (go AND (lo OR hi))) AS coverage, count(*) FILTER (go AND lo) AS n_low, count(*) FILTER (go AND hi) AS n_high FROM f JOIN g USING (px) GROUP BY px""")
def integrate_single_pass(spark, sf):
    return rounded(decisions.single_pass(samples(spark, sf), ["px"], 1.5, 1.5), "master")


@query("SELECT l_suppkey AS frame, count(*) FILTER (l_quantity % 5 > 0) AS active, count(*) FILTER (l_quantity % 5 <= 0) AS zero FROM lineitem GROUP BY 1")
def weight_counts(spark, sf):
    w = F.col("l_quantity") % 5
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("frame")).agg(F.count_if(w > 0).alias("active"), F.count_if(w <= 0).alias("zero"))


# --- choices -------------------------------------------------------------------------------------------------------


@query("SELECT run, frame, CAST(rank AS INTEGER) AS rank FROM (SELECT s_nationkey AS run, s_suppkey AS frame, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 6 * 0.25, s_suppkey) AS rank FROM supplier WHERE s_suppkey % 6 * 0.25 < 1) WHERE rank <= 3")
def select_downweighted(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("frame"), (F.col("s_suppkey") % 6 * 0.25).alias("weight"))
    return decisions.select_frames(s, ["run"], "downweighted", 3).select("run", "frame", "rank")


@query("SELECT run, id FROM (SELECT c_nationkey AS run, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey % 7 = 0) DESC, round(c_acctbal * 100) DESC, c_custkey) AS k FROM customer) WHERE k = 1")
def policy_decision(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("run"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7 == 0).alias("passed"), cents("c_acctbal").alias("score"))
    return decisions.best_candidate(c, ["run"], "passed", "score", "id").select("run", "id")


@query("WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents), a AS (SELECT doc_id, w[1:20] AS p, w[11:60] AS q FROM d), u AS (SELECT doc_id, list_concat(p, q) AS l FROM a) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS ids FROM u".replace("\\\\", "\\"))
def ordered_union(spark, sf):
    w = F.coalesce(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")), F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(decisions.append_unique(F.slice(w, 1, 20), F.slice(w, 11, 50)), " ").alias("ids"))


@query("SELECT s_suppkey AS frame_id, 'norm/' || s_suppkey AS path, 'local_normalization' AS source FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT p_partkey, 'warp/' || p_partkey, 'warp' FROM part")
def source_records(spark, sf):
    """Of a run with local normalisation and of one without."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("frame_id"), F.concat(F.lit("norm/"), F.col("s_suppkey").cast("string")).alias("path"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("frame_id"), F.concat(F.lit("warp/"), F.col("p_partkey").cast("string")).alias("path"))
    return decisions.source_records(s.withColumn("path", F.lit("warp")), s.filter("frame_id % 2 = 0")).unionByName(decisions.source_records(p, None))


@query("SELECT p_partkey, p_partkey % 3 = 0 AND p_size % 2 = 0 AND p_partkey % 5 <> 0 AS whole FROM part")
def integer_shift(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    m = F.array(F.lit(1.0), F.lit(0.0), s / 2.0, F.when(k % 5 == 0, 0.01).otherwise(0.0), F.lit(1.0), k / 3.0, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return table(spark, sf, "part").select("p_partkey", decisions.is_integer_shift(m).alias("whole"))


@query("SELECT s_suppkey AS frame_id, 7 AS reference_frame_id, s_name AS normalized_path, 'disabled' AS status, CAST(1 AS DOUBLE) AS scale, CAST(0 AS DOUBLE) AS \"offset\" FROM supplier")
def passthrough_norm(spark, sf):
    return decisions.passthrough(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("frame_id"), F.col("s_name").alias("path")), 7)


# --- roll-ups and comparisons of runs ----------------------------------------------------------------------------------


@query("WITH f AS (SELECT o_orderpriority AS run, o_orderkey % 4 AS w, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey % 4 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END END AS g, CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'quality' END AS cat FROM orders), s AS (SELECT run, count(*) AS frames, count(*) FILTER (w > 0) AS active, count(*) FILTER (w <= 0) AS masked, count(*) FILTER (w <= 0 AND coalesce(cat, 'unknown') = 'unknown') AS unknown_zero_weight, count(*) FILTER (g IS NULL) AS weight_missing, count(*) FILTER (g <> w) AS weight_mismatch FROM f GROUP BY run) SELECT *, unknown_zero_weight = 0 AND weight_missing = 0 AND weight_mismatch = 0 AS passed FROM s")
def frame_mask_summary(spark, sf):
    k = F.col("o_orderkey")
    given = F.when(k % 10 > 0, k % 4 + F.when(k % 7 == 0, 1).otherwise(0))
    category = F.when(F.col("o_custkey") % 3 == 1, "unknown").when(F.col("o_custkey") % 3 == 2, "quality")
    return decisions.mask_rollup(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run"), (k % 4).alias("weight"), given.alias("given"), category.alias("category")), ["run"])


@query("WITH s AS (SELECT l_suppkey AS k, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag = 'A') AS b1, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag = 'R') AS c1, count(*) FILTER (l_returnflag = 'A') AS b2, count(*) FILTER (l_returnflag = 'R') AS c2 FROM lineitem GROUP BY 1) SELECT k, round(CAST(c1 AS DOUBLE) / b1, 6) AS rms_ratio, round(CAST(c2 AS DOUBLE) / b2, 6) AS p99_ratio, concat_ws(',', CASE WHEN CAST(c1 AS DOUBLE) / b1 > 1.05 THEN 'rms' END, CASE WHEN CAST(c2 AS DOUBLE) / b2 > 1.2 THEN 'p99' END) AS failed FROM s WHERE b2 > 0 AND c2 > 0")
def candidate_growth(spark, sf):
    li = table(spark, sf, "lineitem")
    side = lambda f: li.filter(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(cents("l_extendedprice")).alias("rms"), F.count("*").alias("p99"))
    return rounded(decisions.growth(side("A"), side("R"), "k", {"rms": 1.05, "p99": 1.2}), "rms_ratio", "p99_ratio")


@query(f"WITH {PAIRS_SQL}, s AS (SELECT frame, sqrt(CAST(sum((c - r) * (c - r)) AS DOUBLE) / count(*)) AS rms, sqrt(CAST(sum(r * r) AS DOUBLE) / count(*)) AS ref FROM pairs GROUP BY frame) SELECT frame, round(rms, 4) AS rms, round(coalesce(rms / nullif(ref, 0), 0), 6) AS relative, rms <= 200000 AND coalesce(rms / nullif(ref, 0), 0) <= 1.5 AS passed FROM s")
def parity_summary(spark, sf):
    s = decisions.parity(Q._pairs(spark, sf), ["frame"], 200000, 1.5)
    return s.select("frame", F.round("rms", 4).alias("rms"), F.round("relative", 6).alias("relative"), "passed")


@query("WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 7 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'baseline_only' WHEN a.h IS NULL THEN 'candidate_only' WHEN a.h = b.h THEN 'same' ELSE 'different' END AS outcome FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def determinism(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256).alias("sha256")
    return decisions.determinism(d.filter(k % 5 != 0).select("doc_id", sha(F.col("text"))), d.filter(k % 7 != 0).select("doc_id", sha(F.when(k % 4 == 0, "x").otherwise(F.col("text")))), "doc_id")


TILES_SQL = "t AS (SELECT s_suppkey AS tile, CAST(s_nationkey - 5 AS DOUBLE) AS contribution, CASE WHEN s_suppkey % 9 > 0 THEN CAST(s_suppkey % 11 - 4 AS DOUBLE) END AS signed FROM supplier), p AS (SELECT *, -0.25 * contribution * 2.0 AS predicted FROM t)"


def _tiles(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("tile"), (F.col("s_nationkey") - 5).cast("double").alias("contribution"), F.when(k % 9 > 0, (k % 11 - 4).cast("double")).alias("signed"))


@query(f"WITH {TILES_SQL} SELECT tile, round(predicted, 6) + 0.0 AS predicted, CASE WHEN signed <> 0 AND predicted <> 0 THEN (signed > 0) <> (predicted > 0) END AS toward, round(signed + predicted, 6) + 0.0 AS after FROM p")
def proposal_audit(spark, sf):
    d = decisions.proposal_audit(_tiles(spark, sf), 0.75, 2.0)
    return d.select("tile", (F.round("predicted", 6) + 0.0).alias("predicted"), "toward", (F.round("after", 6) + 0.0).alias("after"))


@query(f"WITH {TILES_SQL}, c AS (SELECT count(*) FILTER (signed <> 0 AND predicted <> 0) AS known, count(*) FILTER (signed * predicted < 0) AS toward FROM p) SELECT known, toward, CASE WHEN known - toward > toward THEN 'reject_downweight_direction' ELSE 'directionally_promising' END AS recommendation FROM c")
def proposal_verdict(spark, sf):
    return decisions.proposal_verdict(decisions.proposal_audit(_tiles(spark, sf), 0.75, 2.0))


@query("WITH c AS (SELECT l_suppkey AS tile, sum(CAST(round(l_extendedprice * 100) AS BIGINT) % 1000) AS o FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), p AS (SELECT s_suppkey AS tile, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 * 0.25 ELSE 1.0 END AS m, s_nationkey * 10 AS canonical FROM supplier) SELECT tile, CAST(m AS DOUBLE) AS multiplier, CAST(o AS BIGINT) AS original, round(o * CAST(m AS DOUBLE), 6) AS proposed, round(o * CAST(m AS DOUBLE) - o - (CAST(m AS DOUBLE) - 1) * canonical, 6) + 0.0 AS delta_minus_canonical FROM p LEFT JOIN c USING (tile)")
def policy_replay(spark, sf):
    k = F.col("s_suppkey")
    c = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("tile"), F.col("l_orderkey").alias("frame"), (cents("l_extendedprice") % 1000).alias("contribution"))
    p = table(spark, sf, "supplier").select(k.alias("tile"), F.when(k % 4 > 0, k % 4 * 0.25).alias("multiplier"), (F.col("s_nationkey") * 10).alias("canonical"))
    d = decisions.policy_replay(c, p)
    return d.select("tile", "multiplier", "original", F.round("proposed", 6).alias("proposed"), (F.round("delta_minus_canonical", 6) + 0.0).alias("delta_minus_canonical"))


@query("WITH a AS (SELECT l_suppkey AS k, sum(l_linenumber) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey AS k, sum(l_linenumber) AS s FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT k, round(CAST(b.s AS DOUBLE) / a.s, 6) AS speedup, CAST(b.s AS DOUBLE) / a.s >= 1.25 AS passed FROM a JOIN b USING (k)")
def timing_ratios(spark, sf):
    li = table(spark, sf, "lineitem")
    side = lambda f: li.filter(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_linenumber").alias("seconds"))
    return rounded(decisions.timing_ratios(side("A"), side("N"), "k"), "speedup")


@query("WITH q AS (SELECT p_partkey AS k, CAST(p_size % 7 AS DOUBLE) AS rx, CAST(p_partkey % 5 AS DOUBLE) AS ry, CAST(p_partkey % 4 AS DOUBLE) AS mx, CAST(p_size % 3 AS DOUBLE) AS my FROM part), s AS (SELECT *, CASE WHEN sqrt(mx * mx + my * my) >= 1.5 AND sqrt(rx * rx + ry * ry) >= 1.5 THEN (mx * rx + my * ry) / (mx * mx + my * my) END AS a, CASE WHEN sqrt(mx * mx + my * my) >= 1.5 AND sqrt(rx * rx + ry * ry) >= 1.5 THEN (mx * ry - my * rx) / (mx * mx + my * my) END AS b FROM q) SELECT k, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(10 - (a * 2 - b * 3), 6) + 0.0 AS tx, round(20 - (b * 2 + a * 3), 6) + 0.0 AS ty FROM s")
def two_pair_similarity(spark, sf):
    """Of reference points (10, 20) and (10, 20) + r, moving points (2, 3) and (2, 3) + m."""
    s, k, one = F.col("p_size"), F.col("p_partkey"), lambda v: F.lit(float(v))
    got = decisions.two_pair_similarity((one(10), one(20)), (10 + s % 7, 20 + k % 5), (one(2), one(3)), (2 + k % 4, 3 + s % 3), 1.5)
    return table(spark, sf, "part").select(k.alias("k"), *[(F.round(v, 6) + 0.0).alias(n) for n, v in got.items()])


@query(f"WITH {IMAGES_SQL}, {NOISE_SQL} SELECT frame, round(med + 5.0 * noise, 4) AS threshold FROM bg")
def adaptive_threshold(spark, sf):
    return masks.thresholds(images(spark, sf), ["frame"], 5.0).select("frame", F.round("hot_above", 4).alias("threshold"))


@query("WITH o AS (SELECT o_orderpriority AS run, o_orderkey AS k, o_orderkey % 17 AS stars FROM orders), b AS (SELECT run, max(stars) AS best, count(*) AS n FROM o GROUP BY run), r AS (SELECT run, k, stars, rank() OVER (PARTITION BY run ORDER BY stars DESC) AS rk FROM o) SELECT run, k, round((rk - 1) / CAST(greatest(n - 1, 1) AS DOUBLE), 6) AS fraction, round(stars / CAST(best AS DOUBLE), 6) AS star_ratio, stars / CAST(best AS DOUBLE) >= 0.5 AND (rk - 1) / CAST(greatest(n - 1, 1) AS DOUBLE) <= 0.75 AS passed FROM r JOIN b USING (run)")
def reference_health(spark, sf):
    """Whether a frame would do as reference: its rank among the run's frames and its stars against the best one's."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 17).alias("stars"))
    r = quality.rank_fraction(o, ["run"], [F.desc("stars")]).join(o.groupBy("run").agg(F.max("stars").alias("best")), "run").withColumn("star_ratio", compare.ratio(F.col("stars"), F.col("best")))
    return r.select("run", "k", F.round("fraction", 6).alias("fraction"), F.round("star_ratio", 6).alias("star_ratio"), ((F.col("star_ratio") >= 0.5) & (F.col("fraction") <= 0.75)).alias("passed"))
