"""Queries of reports on runs and comparisons: fits with what they leave, tails, contributions of frames, matrices and metrics of two
runs, bindings, counts, refined shifts, reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from siderea.functions import metadata as meta
from siderea.model import Rejection
from siderea.operators import audit, calibrate, compare, masks, matching, register, stack
from siderea.plans import queries as Q
from siderea.plans.queries import BIAS_SQL, CAT_SQL, DARK_SQL, FIT, FLAT_SQL, FRAMES_SQL, IMAGES_SQL, PAIRS_SQL, SAMPLES_SQL, SENSOR, STD, query, rounded
from siderea.sources.tables import images, samples, table

# --- fits and tails -----------------------------------------------------------------------------------------------------------

FITTED = """k AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS scale FROM s WHERE n >= 2)"""


@query(f"WITH {PAIRS_SQL}, s AS (SELECT frame, {FIT} FROM pairs GROUP BY frame), {FITTED}, d AS (SELECT frame, n, scale, (sy - scale * sx) / n AS o, scale * c + (sy - scale * sx) / n - r AS d FROM pairs JOIN k USING (frame) WHERE scale IS NOT NULL) SELECT frame, CAST(max(n) AS BIGINT) AS n, round(max(scale), 6) AS scale, round(max(o), 3) AS offset, round(sqrt(avg(d * d)), 3) AS rms_diff, round(quantile_cont(abs(d), 0.99), 3) AS p99, round(max(abs(d)), 3) AS max_abs_diff FROM d GROUP BY frame")
def fit_report(spark, sf):
    r = compare.fit_report(Q._pairs(spark, sf), ["frame"]).select("frame", "n", "scale", "offset", "rms_diff", "p99", "max_abs_diff")
    return rounded(rounded(r, "scale"), "offset", "rms_diff", "p99", "max_abs_diff", digits=3)


@query(f"""WITH {PAIRS_SQL}, bx AS (SELECT filt, quantile_cont(c, 0.05) AS c0, quantile_cont(c, 0.95) AS c1, quantile_cont(r, 0.05) AS r0, quantile_cont(r, 0.95) AS r1 FROM pairs GROUP BY filt),
b AS (SELECT pairs.*, c BETWEEN c0 AND c1 AND r BETWEEN r0 AND r1 AS inside FROM pairs JOIN bx USING (filt)), s AS (SELECT filt, {FIT} FROM b WHERE inside GROUP BY filt), {FITTED},
d AS (SELECT filt, n, scale, inside, abs(scale * c + (sy - scale * sx) / n - r) AS d FROM b JOIN k USING (filt))
SELECT filt, CAST(max(n) AS BIGINT) AS fit_pixels, round(max(n) / count(*), 6) AS fit_fraction, round(max(scale), 6) AS scale, round(sqrt(avg(d * d)), 3) AS all_rms, round(max(d), 3) AS all_max, round(sqrt(avg(d * d) FILTER (inside)), 3) AS fit_rms, round(quantile_cont(d, 0.99) FILTER (inside), 3) AS fit_p99 FROM d GROUP BY filt""")
def robust_fit_report(spark, sf):
    r = compare.robust_fit_report(Q._pairs(spark, sf), ["filt"], 0.05, 0.95).select("filt", "fit_pixels", "fit_fraction", "scale", "all_rms", "all_max", "fit_rms", "fit_p99")
    return rounded(rounded(r, "scale", "fit_fraction"), "all_rms", "all_max", "fit_rms", "fit_p99", digits=3)


@query(f"WITH {PAIRS_SQL}, t AS (SELECT frame, CAST(y // 4 AS INTEGER) AS ty, CAST(x // 4 AS INTEGER) AS tx, count(*) AS pixels, CAST(sum(c - r) AS DOUBLE) / count(*) AS m, sqrt(CAST(sum((c - r) * (c - r)) AS DOUBLE) / count(*)) AS s, quantile_cont(abs(c - r), 0.99) AS p FROM pairs GROUP BY frame, y // 4, x // 4) SELECT frame, ty, tx, pixels, round(m, 3) AS mean_diff, round(s, 3) AS rms_diff, round(p, 3) AS p99_abs_diff, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY p DESC, s DESC, ty, tx) AS k FROM t) WHERE k <= 2")
def diff_hotspots(spark, sf):
    return rounded(compare.hotspots(Q._pairs(spark, sf), ["frame"], 4, 2).drop("max_abs_diff"), "mean_diff", "rms_diff", "p99_abs_diff", digits=3)


@query(f"WITH {PAIRS_SQL}, ct AS (SELECT filt, quantile_cont(abs(c - r), 0.99) AS cut, count(*) AS compared FROM pairs GROUP BY filt) SELECT filt, round(max(cut), 3) AS threshold, max(compared) AS compared, count(*) AS tail_pixels, count(*) FILTER (c < r) AS negative, count(*) FILTER (c > r) AS positive, round(count(*) FILTER (least(x, y, 7 - x, 7 - y) <= 1) / count(*), 6) AS edge_fraction FROM pairs JOIN ct USING (filt) WHERE abs(c - r) >= cut GROUP BY filt")
def tail_summary(spark, sf):
    return rounded(rounded(compare.tail_summary(Q._pairs(spark, sf), ["filt"], 8, 8, 1, 0.99), "edge_fraction"), "threshold", digits=3)


# --- frames of a run -----------------------------------------------------------------------------------------------------------

CONTRIBUTION_SQL = f"""st AS (SELECT px, quantile_cont(v, 0.5) AS c, {STD} AS s FROM samples GROUP BY px),
f AS (SELECT a.*, st.s > 0 AND v < c - 1.5 * st.s AS lo, st.s > 0 AND v > c + 1.5 * st.s AS hi FROM samples a JOIN st USING (px)),
g AS (SELECT px, count(*) - count(*) FILTER (lo OR hi) >= 3 AND count(*) FILTER (lo OR hi) <= count(*) * 0.5 AS ok FROM f GROUP BY px),
k AS (SELECT f.* REPLACE (lo AND ok AS lo, hi AND ok AS hi) FROM f JOIN g USING (px)),
m AS (SELECT px, CAST(sum(w * v) AS DOUBLE) / sum(w) AS m, CAST(sum(w) AS DOUBLE) AS sw FROM k WHERE NOT lo AND NOT hi GROUP BY px),
r AS (SELECT px % 16 AS tile, frame, count(*) AS valid_pixels, count(*) FILTER (NOT lo AND NOT hi) AS accepted_pixels, count(*) FILTER (lo) AS low_rejected, count(*) FILTER (hi) AS high_rejected,
  avg(w * (v - m)) FILTER (NOT lo AND NOT hi) AS weighted_delta, avg(CASE WHEN lo OR hi THEN 0.0 ELSE w * (v - m) / sw END) AS contribution FROM k JOIN m USING (px) GROUP BY px % 16, frame)"""


def _contributions(spark, sf):
    d = stack.reject(samples(spark, sf), ["px"], Rejection("sigma", 1.5, 1.5)).withColumn("tile", F.col("px") % 16)
    return audit.delta_contributions(d, ["px"], ["tile", "frame"])


@query(f"WITH {SAMPLES_SQL}, {CONTRIBUTION_SQL} SELECT tile, frame, valid_pixels, accepted_pixels, low_rejected, high_rejected, round(weighted_delta, 2) AS weighted_delta, round(contribution, 3) AS contribution, round(accepted_pixels / valid_pixels, 6) AS accepted_fraction, round((low_rejected + high_rejected) / valid_pixels, 6) AS rejected_fraction FROM r")
def delta_contributions(spark, sf):
    return rounded(rounded(rounded(_contributions(spark, sf), "accepted_fraction", "rejected_fraction"), "contribution", digits=3), "weighted_delta", digits=2)


@query(f"""WITH {SAMPLES_SQL}, {CONTRIBUTION_SQL}, q AS (SELECT *, CASE WHEN frame <= 4 THEN 'focus' ELSE 'control' END AS side FROM r WHERE frame <= 9),
u AS (SELECT side, CAST(count(DISTINCT frame) AS DOUBLE) AS frames, CAST(count(*) AS DOUBLE) AS tile_frames, CAST(sum(accepted_pixels) AS DOUBLE) / sum(valid_pixels) AS accepted_fraction, CAST(sum(low_rejected + high_rejected) AS DOUBLE) / sum(valid_pixels) AS rejected_fraction,
  CAST(sum(high_rejected) AS DOUBLE) / sum(valid_pixels) AS high_rejected_fraction, avg(weighted_delta) AS weighted_delta, avg(contribution) AS contribution, (SELECT avg(s) FROM (SELECT sum(contribution) AS s FROM q i WHERE i.side = q.side GROUP BY tile)) AS tile_contribution FROM q GROUP BY side),
l AS (UNPIVOT u ON frames, tile_frames, accepted_fraction, rejected_fraction, high_rejected_fraction, weighted_delta, contribution, tile_contribution INTO NAME metric VALUE v),
z AS (SELECT metric, max(v) FILTER (side = 'focus') AS focus, max(v) FILTER (side = 'control') AS control FROM l GROUP BY metric)
SELECT metric, round(focus, 2) AS focus, round(control, 2) AS control, round(focus - control, 2) AS focus_minus_control FROM z""")
def focus_control(spark, sf):
    f = F.col("frame")
    return rounded(audit.focus_control(_contributions(spark, sf), f <= 4, (f > 4) & (f <= 9)), "focus", "control", "focus_minus_control", digits=2)


@query("SELECT 'F' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS frame_id FROM supplier WHERE s_suppkey BETWEEN 3 AND 7 OR s_suppkey = 9")
def focus_frames(spark, sf):
    f = table(spark, sf, "supplier").select(F.format_string("F%06d", "s_suppkey").alias("frame_id"))
    return audit.focus_frames(f, "frame_id", ["F000009"], "F000007", "F000003")


# --- two runs -----------------------------------------------------------------------------------------------------------

MATRICES_SQL = """b AS (SELECT s_suppkey AS k, 1.0::DOUBLE + s_nationkey / 1000 AS a, s_suppkey / 7 AS t, CASE WHEN s_suppkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS s FROM supplier WHERE s_suppkey % 11 <> 0),
c AS (SELECT s_suppkey AS k, 1.0::DOUBLE + s_nationkey / 900 AS a, s_suppkey / 8 AS t, CASE WHEN s_suppkey % 6 = 0 THEN 'failed' ELSE 'ok' END AS s FROM supplier WHERE s_suppkey % 13 <> 0),
j AS (SELECT coalesce(b.k, c.k) AS frame, b.k IS NOT NULL AS in_baseline, c.k IS NOT NULL AS in_candidate, sqrt(2 * (c.a - b.a) ** 2 + 5 * (c.t - b.t) ** 2) AS matrix_delta, sqrt(2 * (c.a - b.a) ** 2) AS linear_delta, sqrt(5 * (c.t - b.t) ** 2) AS translation_delta, b.s IS NOT DISTINCT FROM c.s AS same_status FROM b FULL JOIN c ON b.k = c.k)"""


def _matrices(spark, sf):
    def side(skip, scale, step, fail):
        a, t = F.lit(1.0) + F.col("s_nationkey") / scale, F.col("s_suppkey") / step
        m = [a, F.lit(0.0), t, F.lit(0.0), a, t * 2, F.lit(0.0), F.lit(0.0), F.lit(1.0)]
        s = table(spark, sf, "supplier").filter(F.col("s_suppkey") % skip != 0)
        return s.select(F.col("s_suppkey").alias("frame"), F.array(*m).alias("m"), F.when(F.col("s_suppkey") % fail == 0, "failed").otherwise("ok").alias("status"))

    return audit.matrix_deltas(side(11, 1000, 7, 5), side(13, 900, 8, 6), "frame")


@query(f"WITH {MATRICES_SQL} SELECT frame, in_baseline, in_candidate, round(matrix_delta, 6) AS matrix_delta, round(linear_delta, 6) AS linear_delta, round(translation_delta, 6) AS translation_delta, same_status FROM j")
def matrix_deltas(spark, sf):
    return rounded(_matrices(spark, sf), "matrix_delta", "linear_delta", "translation_delta")


@query(f"WITH {MATRICES_SQL}, o AS (SELECT count(*) FILTER (in_baseline) AS baseline_rows, count(*) FILTER (in_candidate) AS candidate_rows, count(*) FILTER (in_baseline AND in_candidate) AS common_rows, count(*) FILTER (NOT (in_baseline AND in_candidate)) AS missing_rows, count(*) FILTER (in_baseline AND in_candidate AND NOT same_status) AS status_mismatches, round(max(translation_delta), 6) AS max_translation, round(quantile_cont(translation_delta, 0.95), 6) AS p95_translation, round(max(matrix_delta), 6) AS max_matrix, round(quantile_cont(matrix_delta, 0.95), 6) AS p95_matrix FROM j) SELECT *, max_translation <= 5 AND max_matrix <= 5 AND baseline_rows = candidate_rows AND missing_rows = 0 AND status_mismatches = 0 AS passed FROM o")
def matrix_delta_summary(spark, sf):
    return rounded(audit.matrix_delta_summary(_matrices(spark, sf), 5, 5), "max_translation", "p95_translation", "max_matrix", "p95_matrix")


@query("""WITH u AS (SELECT c_custkey AS k, 'c_acctbal' AS metric, CAST(c_acctbal AS DOUBLE) AS v, CAST(c_acctbal AS DOUBLE) AS o FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey, -c_nationkey FROM customer),
s AS (SELECT metric, k % 2 AS side, count(*) AS n, avg(v) AS a, quantile_cont(v, 0.5) AS m, arg_min(k, (o, k)) AS w FROM u GROUP BY metric, k % 2), j AS (SELECT b.metric, b.n AS baseline_frames, b.a AS ba, b.m AS bm, b.w AS baseline_worst, c.n AS candidate_frames, c.a AS ca, c.m AS cm, c.w AS candidate_worst FROM s b JOIN s c USING (metric) WHERE b.side = 0 AND c.side = 1)
SELECT metric, baseline_frames, candidate_frames, round(ba, 6) AS baseline_mean, round(ca, 6) AS candidate_mean, round(bm, 6) AS baseline_median, round(cm, 6) AS candidate_median, baseline_worst, candidate_worst,
  round(CASE WHEN metric = 'c_nationkey' THEN CASE WHEN ba > 0 THEN ca / ba END WHEN ca > 0 THEN ba / ca END, 6) AS bad_mean_ratio, round(CASE WHEN metric = 'c_nationkey' THEN CASE WHEN bm > 0 THEN cm / bm END WHEN cm > 0 THEN bm / cm END, 6) AS bad_median_ratio FROM j""")
def metric_badness(spark, sf):
    c = table(spark, sf, "customer")
    r = audit.metric_badness(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 2 = 1"), "c_custkey", {"c_acctbal": "low", "c_nationkey": "high"})
    return rounded(r, *[f"{s}_{x}" for s in ("baseline", "candidate") for x in ("mean", "median")], "bad_mean_ratio", "bad_median_ratio")


# --- plans -----------------------------------------------------------------------------------------------------------


@query(f"WITH {FRAMES_SQL}, li AS (SELECT * FROM fr WHERE frame_type = 'light' AND filter IN ('BUILDING', 'MACHINERY') AND exposure <= 2) SELECT frame_id, frame_type FROM fr WHERE frame_type <> 'light' AND EXISTS (SELECT 1 FROM li WHERE li.gain = fr.gain AND li.bin = fr.bin) AND (frame_type = 'bias' OR frame_type = 'dark' AND EXISTS (SELECT 1 FROM li WHERE abs(li.exposure - fr.exposure) <= 1e-6) OR frame_type = 'flat' AND filter IN (SELECT filter FROM li))")
def compatible_frames(spark, sf):
    f = Q._frames(spark, sf)
    lights = f.filter("frame_type = 'light' and filter in ('BUILDING', 'MACHINERY') and exposure <= 2")
    return matching.compatible(f, lights, SENSOR).select("frame_id", "frame_type")


@query("""WITH f AS (SELECT o_orderkey AS k, o_custkey % 3 AS kind, o_orderstatus AS filter, o_orderkey % 4 AS gain, o_custkey % 5 AS w FROM orders), u AS (SELECT 'frame_type' AS key, 'T' || CAST(kind AS VARCHAR) AS value FROM f UNION ALL SELECT 'filter', CASE WHEN filter = 'P' THEN 'none' ELSE filter END FROM f
UNION ALL SELECT 'exposure_s', CAST(gain AS VARCHAR) FROM f UNION ALL SELECT 'gain', CASE WHEN gain = 1 THEN 'None' ELSE CAST(gain AS VARCHAR) END FROM f UNION ALL SELECT 'temperature_c', 'None' FROM f UNION ALL SELECT 'shape', CAST(w AS VARCHAR) || 'x8' FROM f UNION ALL SELECT 'count', NULL FROM f)
SELECT key, value, count(*) AS n FROM u GROUP BY key, value UNION ALL SELECT 'skipped_count', NULL, 2""")
def frame_counts(spark, sf):
    o, gain = table(spark, sf, "orders"), F.col("o_orderkey") % 4
    f = o.select(
        F.concat(F.lit("T"), (F.col("o_custkey") % 3).cast("string")).alias("frame_type"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("").alias("filter"), gain.alias("exposure_s"),
        F.when(gain != 1, gain).alias("gain"), F.lit(None).cast("double").alias("temperature_c"), (F.col("o_custkey") % 5).alias("width"), F.lit(8).alias("height"),
    )
    return matching.frame_counts(f, 2)


@query(f"WITH {SAMPLES_SQL}, u AS (SELECT filt, dq, unnest(['valid', 'saturated', 'hot_pixel', 'no_such_flag']) AS flag FROM samples) SELECT filt, flag, CAST(count(*) FILTER (CASE flag WHEN 'valid' THEN dq = 0 WHEN 'saturated' THEN dq & 2 <> 0 WHEN 'hot_pixel' THEN dq & 4 <> 0 ELSE false END) AS BIGINT) AS n FROM u GROUP BY filt, flag")
def merged_flag_counts(spark, sf):
    s = samples(spark, sf)
    parts = [masks.named_flag_counts(s.filter(F.col("px") % 3 == i), ["filt"], ["valid", "Saturated", "hot_pixel", "no_such_flag", "valid"]) for i in range(3)]
    return masks.merged_counts(parts, ["filt"])


# --- calibration and registration -----------------------------------------------------------------------------------------------------------


@query(f"WITH {IMAGES_SQL} SELECT frame, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, quantile_cont(v, 0.5) AS median, round({STD}, 4) AS std FROM images GROUP BY frame")
def image_stats(spark, sf):
    return rounded(calibrate.image_stats(images(spark, sf), ["frame"]), "mean", "std", digits=4)


@query(f"WITH {IMAGES_SQL}, {BIAS_SQL}, {DARK_SQL}, {FLAT_SQL.replace('FROM images i JOIN b USING (filt, y, x) WHERE', 'FROM images i JOIN (SELECT filt, y, x, b.master + d.master AS master FROM b JOIN d USING (filt, y, x)) USING (filt, y, x) WHERE')} SELECT filt, y, x, flat FROM f")
def master_flat_less_dark(spark, sf):
    bias, dark = (calibrate.master(Q._role(spark, sf, k), ["filt"], Rejection()) for k in (0, 1))
    return calibrate.master_flat(Q._flats(spark, sf), bias, ["filt"], flat_dark=dark)


SHIFTED_SQL = """sh AS (SELECT frame, frame % 3 - 1 AS dx, frame % 2 AS dy FROM (SELECT DISTINCT frame FROM cat)),
mv AS (SELECT frame, id, x + dx AS x, y + dy AS y FROM cat JOIN sh USING (frame))"""


def _shifts(spark, sf):
    c, r = Q._catalogues(spark, sf)
    return c, r, c.select("frame").distinct().select("frame", (F.col("frame") % 3 - 1).alias("dx"), (F.col("frame") % 2).alias("dy"))


@query(f"""WITH {CAT_SQL}, {SHIFTED_SQL}, d AS (SELECT frame, m.id AS mi, r.id AS ri, r.x - m.x AS ex, r.y - m.y AS ey, (m.x - r.x) ** 2 + (m.y - r.y) ** 2 AS d2 FROM mv m, rc r), k AS (SELECT *, row_number() OVER (PARTITION BY frame, mi ORDER BY d2, ri) AS a, row_number() OVER (PARTITION BY frame, ri ORDER BY d2, mi) AS b FROM d),
p AS (SELECT frame, count(*) AS n, avg(ex) AS ax, avg(ey) AS ay FROM k WHERE a = 1 AND b = 1 AND d2 <= 4 GROUP BY frame), q AS (SELECT frame, sqrt(avg((ex - ax) ** 2 + (ey - ay) ** 2)) AS rms FROM k JOIN p USING (frame) WHERE a = 1 AND b = 1 AND d2 <= 4 GROUP BY frame)
SELECT frame, round(dx + coalesce(ax, 0), 6) AS dx, round(dy + coalesce(ay, 0), 6) AS dy, coalesce(n, 0) AS inliers, round(rms, 6) AS rms FROM sh LEFT JOIN p USING (frame) LEFT JOIN q USING (frame)""")
def refined_shift(spark, sf):
    return rounded(register.refined_shift(*_shifts(spark, sf), ["frame"], 2.0), "dx", "dy", "rms")


@query(f"WITH {CAT_SQL}, {SHIFTED_SQL}, d AS (SELECT frame, m.id, min((m.x - r.x) ** 2 + (m.y - r.y) ** 2) AS d2 FROM mv m, rc r GROUP BY frame, m.id) SELECT frame, count(*) FILTER (d2 <= 2.25) AS inliers, round(sqrt(avg(d2) FILTER (d2 <= 2.25)), 6) AS rms FROM d GROUP BY frame")
def nearest_inliers(spark, sf):
    c, _, shifts = _shifts(spark, sf)
    one = shifts.select("frame", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.col("dx").cast("double").alias("tx"), F.col("dy").cast("double").alias("ty"))
    return rounded(register.nearest_inliers(c, c.filter("frame = 0").drop("frame"), one, ["frame"], 1.5), "rms")


@query("""SELECT s_suppkey, concat_ws(',', CASE WHEN k % 7 = 0 THEN 'status:failed' END, CASE WHEN k % 5 = 0 THEN 'shape' END, CASE WHEN k % 5 = 1 THEN 'non_finite' END, CASE WHEN k % 5 = 2 AND k % 2 = 0 THEN 'projective_row' END, CASE WHEN k % 5 = 3 THEN 'singular' END,
CASE WHEN k % 7 <> 0 AND k % 3 > 0 AND k % 9 < 4 THEN 'inliers' END, CASE WHEN k % 7 <> 0 AND (k % 10 = 9 OR k % 10 > 6) THEN 'rms' END) AS reasons FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)""")
def solution_reasons(spark, sf):
    k = F.col("s_suppkey")
    row = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    good, bent = row(1, 0, 3, 0, 1, 4, 0, 0, 1), row(1, 0, 3, 0, 1, 4, 0.01, 0, 1)
    m = F.when(k % 5 == 0, row(1, 0, 0, 1)).when(k % 5 == 1, row(1, 0, "nan", 0, 1, 4, 0, 0, 1)).when((k % 5 == 2) & (k % 2 == 0), bent).when(k % 5 == 3, row(1, 2, 0, 2, 4, 0, 0, 0, 1)).otherwise(good)
    status, rms = F.when(k % 7 == 0, "failed").otherwise("ok"), F.when(k % 10 == 9, float("nan")).otherwise((k % 10) / 4.0)
    why = register.solution_reasons(m, F.lit("similarity"), status, k % 9, rms, 4, 1.5, k % 3 > 0)
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(why, ",").alias("reasons"))


@query("""WITH p AS (SELECT page_id AS k, 'n/' || CAST(page_id % 40 AS VARCHAR) || '/L' || CAST(page_id // 2 AS VARCHAR) || '.fits' AS path FROM pages WHERE page_id % 4 <> 3), s AS (SELECT page_id AS k, page_id % 6 AS m FROM pages),
n AS (SELECT s.k, count(p.k) AS n, min(p.k) AS lo FROM s LEFT JOIN p ON p.k // 2 = s.k // 2 AND m IN (1, 2) GROUP BY s.k)
SELECT s.k AS sidecar_id, CASE WHEN m = 0 AND s.k % 4 <> 3 THEN CAST(s.k AS VARCHAR) WHEN m IN (1, 2) AND n = 1 THEN CAST(lo AS VARCHAR) END AS frame_id,
CASE WHEN m = 5 THEN 'skipped' WHEN m = 0 THEN CASE WHEN s.k % 4 <> 3 THEN 'bound' ELSE 'unmatched' END WHEN m IN (1, 2) THEN CASE WHEN n = 0 THEN 'unmatched' WHEN n = 1 THEN 'bound' ELSE 'ambiguous' END ELSE 'unmatched' END AS status FROM s JOIN n ON s.k = n.k""")
def bind_manifest(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    half = F.expr("cast(page_id div 2 as string)")
    f = p.select(k.alias("frame_id"), F.concat(F.lit("N/"), (k % 40).cast("string"), F.lit("/l"), half, F.lit(".FITS")).alias("path"), F.when(k % 4 != 3, "light").otherwise("dark").alias("frame_type"))
    m = k % 6
    named, path = F.when(m == 0, k.cast("string")).when(m == 1, "nobody"), F.when(m.isin(1, 2), F.concat(F.lit("other/L"), half, F.lit(".fits"))).otherwise(F.concat(F.lit("none"), k.cast("string")))
    s = p.select(k.alias("sidecar_id"), named.alias("frame_id"), path.alias("path"), F.when(m == 5, "").otherwise("mask.fits").alias("mask_path"))
    return matching.bind_sidecars(f, s, meta.path_keys)
