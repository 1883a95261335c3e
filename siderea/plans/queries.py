"""The registered queries of the engine on the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siderea.functions import metadata as meta
from siderea.model import DQ_FLAGS, QualityGate, Rejection
from siderea.operators import calibrate, compare, ledger, localnorm, matching, quality, register, stack, stars, tuning, warp
from siderea.sources import fits
from siderea.sources.shared import shared_folder
from siderea.sources.tables import IMAGES_SQL, SAMPLES_SQL, cents, images, samples, table, whole_images
from siderea.streaming import running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- stacking -----------------------------------------------------------------------------------------------------------

OUT = "round(master, 6) AS master, CAST(coverage AS BIGINT) AS coverage, CAST(n_low AS BIGINT) AS n_low, CAST(n_high AS BIGINT) AS n_high"


def _maps(df: DataFrame) -> DataFrame:
    return rounded(df.select("px", "master", "coverage", "n_low", "n_high"), "master")


def _reject_sql(stats: str, lo: str, hi: str, min_samples: int = 3, fraction: float = 0.5) -> str:
    """stats: CTEs that end in one named st (px, ...); lo, hi: predicates over v and st's columns."""
    return f"""WITH {SAMPLES_SQL}, {stats},
f AS (SELECT s.px, v, {lo} AS lo, {hi} AS hi FROM samples s JOIN st USING (px)),
g AS (SELECT px, count(*) AS n, count(*) FILTER (lo OR hi) AS r FROM f GROUP BY px),
k AS (SELECT f.px, v, lo AND ok AS lo, hi AND ok AND NOT lo AS hi FROM f JOIN (SELECT px, n - r >= {min_samples} AND r <= n * {fraction} AS ok FROM g) USING (px)),
m AS (SELECT px, coalesce(CAST(sum(v) FILTER (NOT lo AND NOT hi) AS DOUBLE) / count(*) FILTER (NOT lo AND NOT hi), 0) AS master, count(*) FILTER (NOT lo AND NOT hi) AS coverage, count(*) FILTER (lo) AS n_low, count(*) FILTER (hi) AS n_high FROM k GROUP BY px)
SELECT px, {OUT} FROM m"""


STD = "sqrt(greatest((CAST(sum(v * v) AS DOUBLE) - CAST(sum(v) AS DOUBLE) * CAST(sum(v) AS DOUBLE) / CAST(count(*) AS DOUBLE)) / CAST(count(*) AS DOUBLE), 0))"
K = 1.5


@query(f"WITH {SAMPLES_SQL} SELECT px, round(CAST(sum(v) AS DOUBLE) / count(*), 6) AS master, count(*) AS coverage, greatest((CAST(sum(v * v) AS DOUBLE) - CAST(sum(v) AS DOUBLE) * CAST(sum(v) AS DOUBLE) / CAST(count(*) AS DOUBLE)) / CAST(count(*) AS DOUBLE), 0) AS variance FROM samples GROUP BY px")
def stack_mean(spark, sf):
    return rounded(stack.stack(samples(spark, sf), ["px"]).select("px", "master", "coverage", "variance"), "master")


@query(f"WITH {SAMPLES_SQL} SELECT px, filt, round(CAST(sum(v * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 6) AS master, count(*) AS coverage, CAST(sum(w) AS DOUBLE) AS weight FROM samples GROUP BY px, filt")
def stack_weighted_mean(spark, sf):
    return rounded(stack.stack(samples(spark, sf), ["px", "filt"], "weighted_mean", weight="w").select("px", "filt", "master", "coverage", "weight"), "master")


@query(f"WITH {SAMPLES_SQL} SELECT px, quantile_cont(v, 0.5) AS master, count(*) AS coverage FROM samples GROUP BY px")
def stack_median(spark, sf):
    return stack.stack(samples(spark, sf), ["px"], "median").select("px", "master", "coverage")


@query(f"WITH {SAMPLES_SQL} SELECT px, CAST(sum(v) AS DOUBLE) AS master, count(*) AS coverage FROM samples GROUP BY px")
def stack_sum(spark, sf):
    return stack.stack(samples(spark, sf), ["px"], "sum").select("px", "master", "coverage")


@query(f"WITH {SAMPLES_SQL} SELECT px, coalesce(round(CAST(sum(v) FILTER (dq = 0) AS DOUBLE) / count(*) FILTER (dq = 0), 6), 0) AS master, count(*) FILTER (dq = 0) AS coverage, CASE WHEN count(*) FILTER (dq = 0) = 0 THEN 1 ELSE 0 END AS dq FROM samples GROUP BY px")
def stack_valid_only(spark, sf):
    return rounded(stack.stack(samples(spark, sf), ["px"], dq="dq").select("px", "master", "coverage", "dq"), "master")


@query(_reject_sql(f"st AS (SELECT px, quantile_cont(v, 0.5) AS c, {STD} AS s FROM samples GROUP BY px)", f"s > 0 AND v < c - {K} * s", f"s > 0 AND v > c + {K} * s"))
def reject_sigma(spark, sf):
    return _maps(stack.stack(samples(spark, sf), ["px"], rejection=Rejection("sigma", K, K)))


@query(_reject_sql("md AS (SELECT px, quantile_cont(v, 0.5) AS c FROM samples GROUP BY px), st AS (SELECT px, any_value(c) AS c, quantile_cont(abs(v - c), 0.5) * 1.4826 AS s FROM samples JOIN md USING (px) GROUP BY px)", "s > 0 AND v < c - 2.0 * s", "s > 0 AND v > c + 2.0 * s"))
def reject_mad(spark, sf):
    return _maps(stack.stack(samples(spark, sf), ["px"], rejection=Rejection("mad", 2.0, 2.0)))


@query(_reject_sql("st AS (SELECT px, min(v) AS a, max(v) AS b FROM samples GROUP BY px)", "a < b AND v = a", "a < b AND v = b"))
def reject_minmax(spark, sf):
    return _maps(stack.stack(samples(spark, sf), ["px"], rejection=Rejection("minmax")))


@query(_reject_sql("st AS (SELECT px, quantile_cont(v, 0.10) AS a, quantile_cont(v, 0.90) AS b FROM samples GROUP BY px)", "v < a", "v > b"))
def reject_percentile(spark, sf):
    return _maps(stack.stack(samples(spark, sf), ["px"], rejection=Rejection("percentile", 10, 90)))


WINSOR = f"""q AS (SELECT px, quantile_cont(v, 0.5) AS m, CASE WHEN quantile_cont(v, 0.75) > quantile_cont(v, 0.25) THEN (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 ELSE {STD} END AS s0 FROM samples GROUP BY px),
cl AS (SELECT px, s0, CAST(round(greatest(least(CAST(v AS DOUBLE), m + {K} * s0), m - {K} * s0)) AS BIGINT) AS v FROM samples JOIN q USING (px)),
st AS (SELECT px, CAST(sum(v) AS DOUBLE) / count(*) AS c, CASE WHEN {STD} > 0 THEN {STD} ELSE any_value(s0) END AS s FROM cl GROUP BY px)"""


@query(_reject_sql(WINSOR, f"s > 0 AND v < c - {K} * s", f"s > 0 AND v > c + {K} * s"))
def reject_winsorized(spark, sf):
    return _maps(stack.stack(samples(spark, sf), ["px"], rejection=Rejection("winsorized_sigma", K, K)))


@query(_reject_sql(f"st AS (SELECT px, quantile_cont(v, 0.5) AS c, {STD} AS s FROM samples GROUP BY px)", "s > 0 AND v < c - 0.8 * s", "s > 0 AND v > c + 0.8 * s", 20, 0.4))
def reject_guard(spark, sf):
    return _maps(stack.stack(samples(spark, sf), ["px"], rejection=Rejection("sigma", 0.8, 0.8, 20, 0.4)))


@query(f"""WITH {SAMPLES_SQL},
st AS (SELECT px, quantile_cont(v, 0.5) AS c, {STD} AS s FROM samples GROUP BY px), f AS (SELECT s.px, v, s > 0 AND v < c - 1.8 * s AS lo, s > 0 AND v > c + 1.8 * s AS hi FROM samples s JOIN st USING (px)),
g AS (SELECT px, count(*) - count(*) FILTER (lo OR hi) >= 3 AND count(*) FILTER (lo OR hi) <= count(*) * 0.5 AS ok FROM f GROUP BY px), k AS (SELECT f.px, v, lo AND ok AS lo, hi AND ok AS hi FROM f JOIN g USING (px)),
st2 AS (SELECT px, quantile_cont(v, 0.5) AS c, {STD} AS s FROM k WHERE NOT lo AND NOT hi GROUP BY px), f2 AS (SELECT k.px, v, k.lo, k.hi, NOT lo AND NOT hi AS live, s > 0 AND v < c - 1.8 * s AS lo2, s > 0 AND v > c + 1.8 * s AS hi2 FROM k JOIN st2 USING (px)),
g2 AS (SELECT px, count(*) FILTER (live) - count(*) FILTER (live AND (lo2 OR hi2)) >= 3 AND count(*) FILTER (live AND (lo2 OR hi2)) <= count(*) FILTER (live) * 0.5 AS ok FROM f2 GROUP BY px),
m AS (SELECT f2.px, v, lo OR (live AND lo2 AND ok) AS lo, hi OR (live AND hi2 AND ok) AS hi FROM f2 JOIN g2 USING (px))
SELECT px, round(CAST(sum(v) FILTER (NOT lo AND NOT hi) AS DOUBLE) / count(*) FILTER (NOT lo AND NOT hi), 6) AS master, count(*) FILTER (NOT lo AND NOT hi) AS coverage, count(*) FILTER (lo) AS n_low, count(*) FILTER (hi) AS n_high FROM m GROUP BY px""")
def sigma_clip_two_iterations(spark, sf):
    return _maps(stack.stack(samples(spark, sf), ["px"], rejection=Rejection("sigma", 1.8, 1.8, iterations=2)))


@query(f"""WITH {SAMPLES_SQL}, st AS (SELECT px, quantile_cont(v, 0.5) AS c, {STD} AS s FROM samples GROUP BY px)
SELECT s.px, round(coalesce(CAST(sum(v) FILTER (v >= c - s AND v <= c + s) AS DOUBLE) / nullif(count(*) FILTER (v >= c - s AND v <= c + s), 0), max(c)), 6) AS master, count(*) FILTER (v >= c - s AND v <= c + s) AS coverage FROM samples s JOIN st USING (px) GROUP BY s.px""")
def sigma_clip_integrate(spark, sf):
    return rounded(stack.sigma_clip_mean(samples(spark, sf), ["px"], 1.0, 1.0), "master")


# --- data quality -----------------------------------------------------------------------------------------------------------


@query(f"WITH {SAMPLES_SQL} SELECT filt, 'valid' AS flag, count(*) FILTER (dq = 0) AS n FROM samples GROUP BY filt UNION ALL SELECT filt, 'saturated', count(*) FILTER (dq & 2 <> 0) FROM samples GROUP BY filt HAVING count(*) FILTER (dq & 2 <> 0) > 0 UNION ALL SELECT filt, 'hot_pixel', count(*) FILTER (dq & 4 <> 0) FROM samples GROUP BY filt HAVING count(*) FILTER (dq & 4 <> 0) > 0")
def dq_mark_summary(spark, sf):
    counts = [F.count_if(F.col("dq") == 0).alias("valid"), *[F.count_if(F.col("dq").bitwiseAND(b) != 0).alias(n) for n, b in DQ_FLAGS.items()]]
    wide = samples(spark, sf).groupBy("filt").agg(*counts)
    return wide.unpivot("filt", ["valid", *DQ_FLAGS], "flag", "n").filter("n > 0 or flag = 'valid'")


@query(_reject_sql(f"st AS (SELECT px, quantile_cont(v, 0.5) AS c, {STD} AS s FROM samples GROUP BY px)", f"s > 0 AND v < c - {K} * s", f"s > 0 AND v > c + {K} * s").replace("FROM samples GROUP BY px", "FROM samples WHERE dq = 0 GROUP BY px").replace("FROM samples s JOIN", "FROM samples s JOIN").replace("JOIN st USING (px))", "JOIN st USING (px) WHERE dq = 0)").split("m AS (SELECT")[0].rstrip().rstrip(",") + " SELECT (SELECT count(*) FROM samples) AS input_samples, (SELECT count(*) FROM samples WHERE dq = 0) AS valid_before, (SELECT count(*) FROM samples WHERE dq <> 0) AS invalid, count(*) FILTER (NOT lo AND NOT hi) AS valid_after, count(*) FILTER (lo) AS low_rejected, count(*) FILTER (hi) AS high_rejected, true AS closed FROM k")
def sample_closure(spark, sf):
    return stack.closure(stack.reject(samples(spark, sf), ["px"], Rejection("sigma", K, K), dq="dq"))


# --- calibration -----------------------------------------------------------------------------------------------------------

ROLE = "CASE frame % 4 WHEN 0 THEN 'bias' WHEN 1 THEN 'dark' WHEN 2 THEN 'flat' ELSE 'light' END"
BIAS_SQL = "b AS (SELECT filt, y, x, CAST(sum(v) AS DOUBLE) / count(*) AS master FROM images WHERE frame % 4 = 0 GROUP BY ALL)"
DARK_SQL = "d AS (SELECT filt, y, x, CAST(sum(v) AS DOUBLE) / count(*) AS master FROM images WHERE frame % 4 = 1 GROUP BY ALL)"
FLAT_SQL = """fr AS (SELECT i.*, CAST(round(v + 10000000 - master) AS BIGINT) AS r FROM images i JOIN b USING (filt, y, x) WHERE frame % 4 = 2),
fl AS (SELECT filt, frame, quantile_cont(r, 0.5) AS level FROM fr GROUP BY ALL),
f AS (SELECT filt, y, x, greatest(CAST(sum(CAST(round(CAST(r * 1000000 AS DOUBLE) / level) AS BIGINT)) AS DOUBLE) / count(*) / 1000000, 1e-6) AS flat FROM fr JOIN fl USING (filt, frame) GROUP BY ALL)"""


def _role(spark, sf, k):
    return images(spark, sf).filter(F.col("frame") % 4 == k)


@query(f"WITH {IMAGES_SQL}, {BIAS_SQL} SELECT filt, y, x, round(master, 6) AS master FROM b")
def master_bias(spark, sf):
    return rounded(calibrate.master(_role(spark, sf, 0), ["filt"], Rejection()).drop("coverage"), "master")


@query(f"WITH {IMAGES_SQL}, {BIAS_SQL}, {DARK_SQL} SELECT filt, y, x, round(d.master - b.master, 6) AS master FROM d JOIN b USING (filt, y, x)")
def master_dark(spark, sf):
    d, b = (calibrate.master(_role(spark, sf, k), ["filt"], Rejection()).select("filt", "y", "x", F.col("master").alias(n)) for k, n in ((1, "d"), (0, "b")))
    return d.join(b, ["filt", "y", "x"]).select("filt", "y", "x", F.round(F.col("d") - F.col("b"), 6).alias("master"))


def _flats(spark, sf):
    return _role(spark, sf, 2).withColumn("v", F.col("v") + 10_000_000)  # a pedestal, as flats are positive


@query(f"WITH {IMAGES_SQL}, {BIAS_SQL}, {FLAT_SQL} SELECT filt, y, x, flat FROM f")
def master_flat(spark, sf):
    return calibrate.master_flat(_flats(spark, sf), calibrate.master(_role(spark, sf, 0), ["filt"], Rejection()), ["filt"])


@query(f"WITH {IMAGES_SQL}, {BIAS_SQL}, {DARK_SQL}, {FLAT_SQL} SELECT frame, i.y, i.x, round((v - d.master * (1.0 / 2.0)) / greatest(flat, 0.05) + 100, 3) AS v FROM images i JOIN b USING (filt, y, x) JOIN d USING (filt, y, x) JOIN f USING (filt, y, x) WHERE frame % 4 = 3")
def calibrate_light(spark, sf):
    bias = calibrate.master(_role(spark, sf, 0), ["filt"], Rejection())
    m = bias.select("filt", "y", "x", F.col("master").alias("b"))
    m = m.join(calibrate.master(_role(spark, sf, 1), ["filt"], Rejection()).select("filt", "y", "x", F.col("master").alias("d")), ["filt", "y", "x"]).join(calibrate.master_flat(_flats(spark, sf), bias, ["filt"]), ["filt", "y", "x"])
    lights = _role(spark, sf, 3).join(m, ["filt", "y", "x"])
    v = calibrate.calibrated(F.col("v"), F.col("b"), F.col("d"), F.col("flat"), F.lit(1.0), F.lit(2.0), 0.05, 100.0)
    return lights.select("frame", "y", "x", F.round(v, 3).alias("v"))


@query(f"WITH {IMAGES_SQL}, s AS (SELECT frame, v FROM images WHERE x >= 6 UNION ALL SELECT frame, v FROM images WHERE y >= 7), l AS (SELECT frame, quantile_cont(v, 0.5) AS level FROM s GROUP BY frame) SELECT frame, y, x, v - level AS v FROM images JOIN l USING (frame) WHERE x < 6 AND y < 7")
def overscan(spark, sf):
    return calibrate.overscan(images(spark, sf), 8, 8, 2, 1).select("frame", "y", "x", "v")


BG = f"""md AS (SELECT frame, quantile_cont(v, 0.5) AS median, {STD} AS sd FROM images GROUP BY frame),
bg AS (SELECT frame, any_value(median) AS median, quantile_cont(abs(v - median), 0.5) AS mad, any_value(sd) AS sd FROM images JOIN md USING (frame) GROUP BY frame),
nz AS (SELECT frame, median, mad, CASE WHEN mad > 0 THEN mad * 1.4826 WHEN sd > 0 THEN sd ELSE 1.0 END AS noise FROM bg)"""


@query(f"WITH {IMAGES_SQL}, {BG} SELECT frame, median, mad, round(noise, 6) AS noise FROM nz")
def robust_background(spark, sf):
    return rounded(calibrate.robust_background(images(spark, sf), ["frame"]).select("frame", "median", "mad", "noise"), "noise")


@query(f"WITH {IMAGES_SQL}, {BG} SELECT frame, y, x, CASE WHEN v > median + 2.0 * noise THEN 36 WHEN v < median - 2.0 * noise THEN 40 ELSE 0 END AS dq, CASE WHEN v > median + 2.0 * noise OR v < median - 2.0 * noise THEN median ELSE CAST(v AS DOUBLE) END AS fixed FROM images JOIN nz USING (frame)")
def cosmetic_global(spark, sf):
    return calibrate.cosmetic(images(spark, sf), ["frame"], 2.0, 2.0).select("frame", "y", "x", "dq", "fixed")


NB = "nb AS (SELECT a.frame, a.y, a.x, a.v, n.v AS nv FROM images a, (SELECT unnest([-1, 0, 1]) AS dy) s, (SELECT unnest([-1, 0, 1]) AS dx) t, images n WHERE (dy <> 0 OR dx <> 0) AND n.frame = a.frame AND n.y = least(greatest(a.y + dy, 0), 7) AND n.x = least(greatest(a.x + dx, 0), 7))"


@query(f"WITH {IMAGES_SQL}, {BG}, {NB}, g AS (SELECT frame, y, x, any_value(v) AS v, quantile_cont(nv, 0.5) AS local, count(*) FILTER (nv > median + 1.0 * noise) AS bright, any_value(median) AS median, any_value(noise) AS noise FROM nb JOIN nz USING (frame) GROUP BY ALL) SELECT frame, y, x, v, local, bright FROM g WHERE v > median + 2.0 * noise AND v > local + 2.0 * noise AND bright < 2".replace("GROUP BY ALL)", "GROUP BY frame, y, x)"))
def isolated_defects(spark, sf):
    return calibrate.isolated_defects(images(spark, sf), ["frame"], 8, 8, 2.0, 1.0, 2)


# --- metadata and planning -----------------------------------------------------------------------------------------------------------

TYPE_SQL = "CASE WHEN contains(t, 'bias') OR contains(t, 'zero') THEN 'bias' WHEN contains(t, 'dark') THEN 'dark' WHEN contains(t, 'flat') THEN 'flat' WHEN contains(t, 'light') OR contains(t, 'object') OR contains(t, 'science') THEN 'light' ELSE 'unknown' END"


@query(f"SELECT p_partkey, {TYPE_SQL} AS frame_type FROM (SELECT p_partkey, replace(replace(lower(trim(CASE p_partkey % 5 WHEN 0 THEN 'Master_Bias ' WHEN 1 THEN 'DARK-frame ' WHEN 2 THEN 'Sky Flat' WHEN 3 THEN 'Science ' ELSE '' END || p_type)), '_', ' '), '-', ' ') AS t FROM part)")
def classify_frame_type(spark, sf):
    p = table(spark, sf, "part")
    word = F.element_at(F.array(*map(F.lit, ("Master_Bias ", "DARK-frame ", "Sky Flat", "Science ", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", meta.frame_type(F.concat(word, "p_type")).alias("frame_type"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS gain, CAST(trunc(value) AS INTEGER) AS exposure, json_extract_string(props, '$.missing') AS first_found FROM events")
def header_values(spark, sf):
    h = F.from_json("props", "map<string,string>")
    e = table(spark, sf, "events").withColumn("h", h)
    return e.select("event_id", meta.as_float(meta.first_header_value(F.col("h"), ["K", "k"])).alias("gain"), meta.as_int(F.col("value").cast("string")).alias("exposure"), meta.first_header_value(F.col("h"), ["missing"]).alias("first_found"))


@query("SELECT 'type' AS key, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'k', json_extract_string(props, '$.k'), count(*) FROM events GROUP BY 2")
def summarize_frames(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("type"), F.get_json_object("props", "$.k").alias("k"))
    g = e.groupingSets([["type"], ["k"]], "type", "k").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 1, "type").otherwise("k").alias("key"), F.when(F.col("g") == 1, F.col("type")).otherwise(F.col("k")).alias("value"), "n")


FRAMES_SQL = """fr AS (SELECT 'F' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS frame_id, CASE o_orderkey % 4 WHEN 0 THEN 'bias' WHEN 1 THEN 'dark' WHEN 2 THEN 'flat' ELSE 'light' END AS frame_type,
  c_mktsegment AS filter, CAST(o_totalprice AS BIGINT) // 50000 AS exposure, o_orderpriority AS gain, c_nationkey % 5 AS bin FROM orders JOIN customer ON o_custkey = c_custkey)"""
KEY_SQL = "frame_type, CASE WHEN frame_type IN ('flat', 'light') THEN filter END AS gf, CASE WHEN frame_type IN ('dark', 'light') THEN exposure END AS ge, gain, bin"
GROUP_SQL = f"""gr AS (SELECT frame_type, gf, ge, gain, bin, list(frame_id ORDER BY frame_id) AS frames, count(*) AS n_frames, 'G' || substr(sha1(concat_ws('|', frame_type, coalesce(gf, 'None'), coalesce(CAST(ge AS VARCHAR), 'None'), gain, CAST(bin AS VARCHAR))), 1, 10) AS group_id
  FROM (SELECT frame_id, {KEY_SQL} FROM fr) GROUP BY frame_type, gf, ge, gain, bin)"""
SENSOR = ["gain", "bin"]


def _frames(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    kind = F.element_at(F.array(*map(F.lit, ("bias", "dark", "flat", "light"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.concat(F.lit("F"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("frame_id"), kind.alias("frame_type"), F.col("c_mktsegment").alias("filter"),
        F.expr("cast(round(o_totalprice) as bigint) div 50000").alias("exposure"), F.col("o_orderpriority").alias("gain"), (F.col("c_nationkey") % 5).alias("bin"),
    )


@query(f"WITH {FRAMES_SQL}, {GROUP_SQL} SELECT group_id, frame_type, n_frames, frames[1] AS first_frame FROM gr")
def group_frames(spark, sf):
    return matching.group_frames(_frames(spark, sf), SENSOR).select("group_id", "frame_type", "n_frames", F.col("frames")[0].alias("first_frame"))


def _lights_and_groups(spark, sf):
    f = _frames(spark, sf)
    return f.filter("frame_type = 'light'"), matching.group_frames(f, SENSOR).drop("frames")


def _match_sql(kind, extra="", order="", name="g"):
    return f"(SELECT frame_id, group_id AS {name} FROM (SELECT l.frame_id, g.group_id, row_number() OVER (PARTITION BY l.frame_id ORDER BY {order} g.group_id) AS k FROM (SELECT * FROM fr WHERE frame_type = 'light') l LEFT JOIN (SELECT * FROM gr WHERE frame_type = '{kind}') g ON l.gain IS NOT DISTINCT FROM g.gain AND l.bin IS NOT DISTINCT FROM g.bin {extra}) WHERE k = 1)"


BIAS_MATCH, DARK_MATCH = _match_sql("bias", name="bias_group"), _match_sql("dark", order="(l.exposure IS NOT DISTINCT FROM g.ge) DESC,", name="dark_group")
FLAT_MATCH = _match_sql("flat", extra="AND l.filter IS NOT DISTINCT FROM g.gf", name="flat_group")


@query(f"WITH {FRAMES_SQL}, {GROUP_SQL} SELECT * FROM {BIAS_MATCH}")
def match_bias(spark, sf):
    return matching.find_bias(*_lights_and_groups(spark, sf), SENSOR)


@query(f"WITH {FRAMES_SQL}, {GROUP_SQL} SELECT * FROM {DARK_MATCH}")
def match_dark_exact_or_first(spark, sf):
    return matching.find_dark(*_lights_and_groups(spark, sf), SENSOR)


@query(f"WITH {FRAMES_SQL}, {GROUP_SQL} SELECT * FROM {FLAT_MATCH}")
def match_flat(spark, sf):
    return matching.find_flat(*_lights_and_groups(spark, sf), SENSOR)


@query(f"WITH {FRAMES_SQL}, {GROUP_SQL} SELECT frame_id, bias_group, dark_group, flat_group, CASE WHEN dark_group IS NOT NULL AND flat_group IS NOT NULL THEN 'ready' ELSE 'blocked' END AS status, (CASE WHEN bias_group IS NULL THEN 1 ELSE 0 END) + (CASE WHEN dark_group IS NULL THEN 1 ELSE 0 END) + (CASE WHEN flat_group IS NULL THEN 1 ELSE 0 END) AS n_missing FROM {BIAS_MATCH} JOIN {DARK_MATCH} USING (frame_id) JOIN {FLAT_MATCH} USING (frame_id)")
def light_plan(spark, sf):
    return matching.light_plan(*_lights_and_groups(spark, sf), SENSOR).select("frame_id", "bias_group", "dark_group", "flat_group", "status", F.size("warnings").alias("n_missing"))


@query(f"WITH {FRAMES_SQL}, li AS (SELECT * FROM fr WHERE frame_type = 'light' AND filter = 'BUILDING' AND exposure = 3), ca AS (SELECT * FROM fr WHERE frame_type <> 'light' AND EXISTS (SELECT 1 FROM li WHERE li.gain = fr.gain AND li.bin = fr.bin)), ch AS (SELECT frame_id, frame_type FROM (SELECT *, row_number() OVER (PARTITION BY frame_type, gain, bin ORDER BY frame_id) AS k FROM ca) WHERE k <= 2 UNION SELECT frame_id, frame_type FROM li) SELECT frame_id, frame_type, 'F' || lpad(CAST(row_number() OVER (ORDER BY frame_type, frame_id) AS VARCHAR), 6, '0') AS new_id FROM ch")
def subset_semi_join(spark, sf):
    f = _frames(spark, sf)
    return matching.subset(f, f.filter("frame_type = 'light' and filter = 'BUILDING' and exposure = 3"), 2, SENSOR)


# --- quality -----------------------------------------------------------------------------------------------------------

QUAL_SQL = f"""{BG}, qs AS (SELECT frame AS frame_id, filt, count(*) FILTER (v > median + 1.5 * noise) AS star_count, max(v) AS peak, any_value(median) AS median, any_value(noise) AS noise, count(*) AS pixels, CAST(count(*) FILTER (v >= 250000) AS DOUBLE) / count(*) AS saturation FROM images JOIN nz USING (frame) GROUP BY frame, filt),
q AS (SELECT *, round((peak - median) / noise, 6) AS snr FROM qs),
qw AS (SELECT *, round(greatest(snr, 0) * sqrt(CAST(greatest(star_count, 1) AS DOUBLE)) * (1.0 / (3.0 * 3.0)) * greatest(0.05, 1.0 - 0.0) * (1.0 / greatest(noise / 1000000, 1e-6)) * greatest(0.0, 1.0 - 5.0 * greatest(saturation, 0.0)), 6) AS score FROM q)"""


def _quality(spark, sf):
    im = images(spark, sf)
    b = calibrate.robust_background(im, ["frame"]).select("frame", "median", "noise")
    q = im.join(b, "frame").groupBy(F.col("frame").alias("frame_id"), "filt").agg(F.count_if(F.col("v") > F.col("median") + 1.5 * F.col("noise")).alias("star_count"), F.max("v").alias("peak"), F.first("median").alias("median"), F.first("noise").alias("noise"), F.count("*").alias("pixels"), (F.count_if(F.col("v") >= 250000).cast("double") / F.count("*")).alias("saturation"))
    q = q.withColumn("snr", F.round((F.col("peak") - F.col("median")) / F.col("noise"), 6)).withColumns({"fwhm": F.lit(None).cast("double"), "ecc": F.lit(None).cast("double"), "rms": F.col("noise") / 1000000})
    return q.withColumn("score", F.round(quality.combined_weight(F.col("star_count"), F.col("snr"), F.col("fwhm"), F.col("ecc"), F.col("rms"), F.col("saturation")), 6))


@query(f"WITH {IMAGES_SQL}, {QUAL_SQL} SELECT frame_id, star_count, snr, saturation, round(score, 4) AS score FROM qw")
def frame_quality(spark, sf):
    return rounded(_quality(spark, sf).select("frame_id", "star_count", "snr", "saturation", "score"), "score", digits=4)


GATE = QualityGate(min_stars=40, max_saturation=0.03, min_score=2.0)
GATE_SQL = "qg AS (SELECT *, star_count < 5 AS r1, saturation > 0.03 AS r2, score < 2.0 AS r3, CASE WHEN star_count < 5 OR saturation > 0.03 OR score < 2.0 THEN 'rejected' ELSE 'accepted' END AS status FROM qw)"


@query(f"WITH {IMAGES_SQL}, {QUAL_SQL}, {GATE_SQL} SELECT frame_id, status, array_to_string(list_filter([CASE WHEN r1 THEN 'star_count' END, CASE WHEN r2 THEN 'saturation_fraction' END, CASE WHEN r3 THEN 'quality_score' END], lambda x: x IS NOT NULL), ',') AS reasons FROM qg")
def quality_gate(spark, sf):
    return quality.apply_gate(_quality(spark, sf), GATE).select("frame_id", "status", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {IMAGES_SQL}, {QUAL_SQL}, {GATE_SQL}, u AS (SELECT 'star_count' AS reason, count(*) FILTER (r1) AS n FROM qg UNION ALL SELECT 'saturation_fraction', count(*) FILTER (r2) FROM qg UNION ALL SELECT 'quality_score', count(*) FILTER (r3) FROM qg) SELECT reason, n FROM u WHERE n > 0")
def gate_reason_counts(spark, sf):
    return quality.reason_counts(quality.apply_gate(_quality(spark, sf), GATE))


@query(f"WITH {IMAGES_SQL}, {QUAL_SQL}, m AS (SELECT filt, quantile_cont(greatest(score, 1e-6), 0.5) AS med FROM qw GROUP BY filt) SELECT frame_id, round(greatest(greatest(score, 1e-6) / greatest(med, 1e-6), 1e-6), 5) AS weight FROM qw JOIN m USING (filt)")
def quality_weights(spark, sf):
    return rounded(stack.normalised_weights(_quality(spark, sf), F.col("score"), ["filt"]).select("frame_id", "weight"), "weight", digits=5)


@query(f"WITH {IMAGES_SQL}, {QUAL_SQL}, {GATE_SQL} SELECT frame_id, star_count, round(score, 4) AS score, status <> 'accepted' AS fallback FROM qg ORDER BY (status = 'accepted') DESC, star_count DESC, score DESC, noise / 1000000, frame_id LIMIT 1")
def reference_selection(spark, sf):
    return rounded(quality.reference(quality.apply_gate(_quality(spark, sf), GATE)), "score", digits=4)


@query("SELECT c_mktsegment AS side, c_nationkey AS rot, count(*) AS n FROM customer GROUP BY 1, 2 ORDER BY n DESC, side, rot LIMIT 1")
def orientation_mode(spark, sf):
    return quality.dominant(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("side"), F.col("c_nationkey").alias("rot")), "side", "rot")


@query("WITH s AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders) SELECT min(v) AS least, quantile_cont(v, 0.5) AS median, round(CAST(sum(v) AS DOUBLE) / count(*), 6) AS mean, max(v) AS most, (SELECT id FROM s ORDER BY v DESC, id LIMIT 1) AS worst_frame FROM s")
def metric_summary(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), cents("o_totalprice").alias("v"))
    return rounded(quality.metric_summary(s, "v", "id"), "mean")


@query("SELECT s_suppkey, s_nationkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) - 1 AS DOUBLE) / greatest(count(*) OVER (PARTITION BY s_nationkey) - 1, 1) AS fraction FROM supplier")
def rank_fraction(spark, sf):
    return quality.rank_fraction(table(spark, sf, "supplier"), ["s_nationkey"], [F.desc("s_acctbal")]).select("s_suppkey", "s_nationkey", "fraction")


# --- comparison -----------------------------------------------------------------------------------------------------------

PAIRS_SQL = f"{IMAGES_SQL}, rf AS (SELECT filt, min(frame) AS ref FROM images GROUP BY filt), pairs AS (SELECT i.filt, i.frame, i.y, i.x, i.v AS c, r.v AS r FROM images i JOIN rf USING (filt) JOIN images r ON r.frame = ref AND r.y = i.y AND r.x = i.x WHERE i.frame <> ref)"


def _pairs(spark, sf):
    im = images(spark, sf)
    rf = im.groupBy("filt").agg(F.min("frame").alias("ref"))
    r = im.join(rf, "filt").filter("frame = ref").select("filt", "ref", "y", "x", F.col("v").alias("r"))
    return im.join(r, ["filt", "y", "x"]).filter("frame <> ref").select("filt", "frame", "y", "x", F.col("v").alias("c"), "r")


def _ps(expr):
    return ", ".join(f"round(quantile_cont({expr}, {p}), 3) AS p{n}" for p, n in ((0.5, 50), (0.9, 90), (0.99, 99), (0.999, 999)))


@query(f"WITH {PAIRS_SQL} SELECT filt, count(*) AS n, round(CAST(sum(c - r) AS DOUBLE) / count(*), 6) AS mean_diff, round(sqrt(CAST(sum((c - r) * (c - r)) AS DOUBLE) / count(*)), 4) AS rms_diff, max(abs(c - r)) AS max_abs_diff, {_ps('abs(c - r)')}, round(sqrt(CAST(sum((c - r) * (c - r)) AS DOUBLE) / count(*)) / sqrt(CAST(sum(r * r) AS DOUBLE) / count(*)), 6) AS relative_rms FROM pairs GROUP BY filt")
def diff_stats(spark, sf):
    d = rounded(compare.diff_stats(_pairs(spark, sf), ["filt"]), "mean_diff", "relative_rms")
    return rounded(rounded(d, "p50", "p90", "p99", "p999", digits=3), "rms_diff", digits=4)


FIT = "CAST(count(*) AS DOUBLE) AS n, CAST(sum(c) AS DOUBLE) AS sx, CAST(sum(r) AS DOUBLE) AS sy, CAST(sum(c * c) AS DOUBLE) AS sxx, CAST(sum(c * r) AS DOUBLE) AS sxy, CAST(sum(r * r) AS DOUBLE) AS syy"
FIT_OUT = "CAST(n AS BIGINT) AS n, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 6) AS scale, round((sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n, 3) AS offset"


@query(f"WITH {PAIRS_SQL}, s AS (SELECT frame, {FIT} FROM pairs GROUP BY frame) SELECT frame, {FIT_OUT} FROM s")
def linear_fit(spark, sf):
    return rounded(rounded(compare.linear_fit(_pairs(spark, sf), ["frame"]), "scale"), "offset", digits=3)


@query(f"WITH {PAIRS_SQL}, bx AS (SELECT filt, quantile_cont(c, 0.05) AS c0, quantile_cont(c, 0.95) AS c1, quantile_cont(r, 0.05) AS r0, quantile_cont(r, 0.95) AS r1 FROM pairs GROUP BY filt), s AS (SELECT filt, {FIT} FROM pairs JOIN bx USING (filt) WHERE c BETWEEN c0 AND c1 AND r BETWEEN r0 AND r1 GROUP BY filt) SELECT filt, {FIT_OUT} FROM s")
def robust_linear_fit(spark, sf):
    return rounded(rounded(compare.robust_linear_fit(_pairs(spark, sf), ["filt"], 0.05, 0.95), "scale"), "offset", digits=3)


@query(f"WITH {PAIRS_SQL}, ct AS (SELECT filt, quantile_cont(abs(c - r), 0.99) AS cut FROM pairs GROUP BY filt), t AS (SELECT filt, y // 4 AS ty, x // 4 AS tx, count(*) FILTER (abs(c - r) >= cut) AS tail_pixels, count(*) FILTER (abs(c - r) >= cut AND c < r) AS negative, count(*) FILTER (abs(c - r) >= cut AND c > r) AS positive, max(abs(c - r)) AS max_abs FROM pairs JOIN ct USING (filt) GROUP BY ALL) SELECT filt, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, tail_pixels, negative, positive, max_abs FROM t WHERE tail_pixels > 0 ORDER BY tail_pixels DESC, max_abs DESC, filt, ty, tx LIMIT 16".replace("GROUP BY ALL", "GROUP BY filt, y // 4, x // 4"))
def tail_tiles(spark, sf):
    return compare.tail_tiles(_pairs(spark, sf), ["filt"], 4)


@query(f"WITH {PAIRS_SQL} SELECT frame, y, x, c, r, c - r AS d FROM pairs ORDER BY abs(c - r) DESC, frame, y, x LIMIT 25")
def top_pixels(spark, sf):
    return compare.top_pixels(_pairs(spark, sf), 25, ["frame", "y", "x"])


@query("WITH a AS (SELECT l_orderkey AS k, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, CAST(o_orderkey % 100 AS BIGINT) AS v FROM orders WHERE o_orderkey % 7 <> 0), j AS (SELECT a.v AS b, b.v AS c FROM a FULL JOIN b USING (k)) SELECT count(*) FILTER (c IS NULL) AS only_baseline, count(*) FILTER (b IS NULL) AS only_candidate, count(*) FILTER (abs(c - b) > 0) AS changed, coalesce(max(abs(c - b)), 0) AS largest, CAST(coalesce(sum(abs(c - b)), 0) AS BIGINT) AS total FROM j")
def drift(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").cast("bigint").alias("v"))
    b = table(spark, sf, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 100).alias("v"))
    return compare.drift(a, b, ["k"], "v")


@query(f"WITH {PAIRS_SQL}, s AS (SELECT frame, {FIT} FROM pairs GROUP BY frame) SELECT frame, round((n * sxy - sx * sy) / (sqrt(greatest(n * sxx - sx * sx, 0)) * sqrt(greatest(n * syy - sy * sy, 0))), 6) AS r FROM s")
def pearson(spark, sf):
    return rounded(compare.pearson(_pairs(spark, sf), ["frame"]), "r")


@query(f"WITH {IMAGES_SQL} SELECT frame, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x)) AS sha256 FROM images GROUP BY frame")
def data_signature(spark, sf):
    return compare.signature(images(spark, sf), ["frame"], ["y", "x"], "v")


@query(f"WITH {PAIRS_SQL}, f AS (SELECT frame, count(*) AS n, round(CAST(sum(c - r) AS DOUBLE) / count(*), 6) AS mean, quantile_cont(c - r, 0.5) AS median, round(sqrt(CAST(sum((c - r) * (c - r)) AS DOUBLE) / count(*)), 4) AS rms, round(quantile_cont(abs(c - r), 0.95), 3) AS p95, max(abs(c - r)) AS largest FROM pairs GROUP BY frame), d AS (SELECT frame, quantile_cont(abs(c - r - median), 0.5) AS mad FROM pairs JOIN f USING (frame) GROUP BY frame) SELECT * FROM f JOIN d USING (frame)")
def residuals(spark, sf):
    return rounded(rounded(rounded(compare.residuals(_pairs(spark, sf), ["frame"]), "mean"), "rms", digits=4), "p95", digits=3)


@query("SELECT s_suppkey, round(sqrt(a * a + c * c), 6) AS scale_x, round(sqrt(b * b + d * d), 6) AS scale_y, round(degrees(atan2(c, a)), 6) AS rotation_deg, round(a * d - b * c, 6) AS det FROM (SELECT s_suppkey, 1.0 + s_nationkey / 100.0 AS a, -s_nationkey / 50.0 AS b, s_nationkey / 40.0 AS c, 1.0 - s_suppkey / 1000.0 AS d FROM (SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, CAST(s_nationkey AS DOUBLE) AS s_nationkey FROM supplier))")
def matrix_metrics(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("double").alias("s_suppkey"), F.col("s_nationkey").cast("double").alias("n"))
    n, k = F.col("n"), F.col("s_suppkey")
    return s.select("s_suppkey", *[F.round(c, 6).alias(a) for a, c in register.matrix_metrics(1.0 + n / 100.0, -n / 50.0, n / 40.0, 1.0 - k / 1000.0).items()])


# --- local normalisation -----------------------------------------------------------------------------------------------------------

COEF_SQL = f"""{PAIRS_SQL}, cs AS (SELECT frame, CAST(y // 4 AS INTEGER) AS ty, CAST(x // 4 AS INTEGER) AS tx, count(*) AS n, CAST(sum(c) AS DOUBLE) / count(*) AS mc, CAST(sum(r) AS DOUBLE) / count(*) AS mr, {STD.replace('v', 'c')} AS sc, {STD.replace('v', 'r')} AS sr FROM pairs GROUP BY frame, y // 4, x // 4),
co AS (SELECT frame, ty, tx, n, CASE WHEN sc <= 1e-6 OR sr <= 1e-6 THEN 1.0 ELSE sr / sc END AS scale, mr - mc * (CASE WHEN sc <= 1e-6 OR sr <= 1e-6 THEN 1.0 ELSE sr / sc END) AS "offset", CASE WHEN sc <= 1e-6 OR sr <= 1e-6 THEN 'offset_only' ELSE 'ok' END AS status FROM cs)""".replace("sqrt(greatest((CAST(sum(c * c)", "sqrt(greatest((CAST(sum(c * c)")


def _grid(spark, sf):
    p = _pairs(spark, sf).withColumns({"ty": localnorm.tile_of("y", 4), "tx": localnorm.tile_of("x", 4)})
    return localnorm.coefficients(p, ["frame", "ty", "tx"])


@query(f'WITH {COEF_SQL} SELECT frame, ty, tx, n, round(scale, 6) AS scale, round("offset", 3) AS "offset", status FROM co')
def grid_norm(spark, sf):
    return rounded(rounded(_grid(spark, sf), "scale"), "offset", digits=3)


@query(f"WITH {PAIRS_SQL}, s AS (SELECT frame, count(*) AS n, quantile_cont(c, 0.5) AS mc, quantile_cont(r, 0.5) AS mr, {STD.replace('v', 'c')} AS sc, {STD.replace('v', 'r')} AS sr FROM pairs GROUP BY frame) SELECT frame, n, round(sr / sc, 6) AS scale, round(mr - mc * (sr / sc), 3) AS \"offset\", 'ok' AS status FROM s")
def tile_norm(spark, sf):
    return rounded(rounded(localnorm.coefficients(_pairs(spark, sf), ["frame"], "median"), "scale"), "offset", digits=3)


CELLS_SQL = "cells AS (SELECT CAST(s_suppkey % 3 AS INTEGER) AS g, CAST(s_suppkey // 3 % 10 AS INTEGER) AS ty, CAST(s_suppkey // 30 % 10 AS INTEGER) AS tx, CAST(max(round(s_acctbal * 100)) AS DOUBLE) AS value, max(s_suppkey) % 4 <> 0 AS valid FROM supplier GROUP BY 1, 2, 3)"


def _cells(spark, sf):
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 3).cast("int").alias("g"), F.expr("cast(s_suppkey div 3 % 10 as int)").alias("ty"), F.expr("cast(s_suppkey div 30 % 10 as int)").alias("tx"), F.round(F.col("s_acctbal") * 100).alias("a"), "s_suppkey")
    return s.groupBy("g", "ty", "tx").agg(F.max("a").alias("value"), (F.max("s_suppkey") % 4 != 0).alias("valid"))


@query(f"WITH {CELLS_SQL} SELECT g, ty, tx, value FROM cells WHERE valid UNION ALL SELECT g, ty, tx, value FROM (SELECT b.g, b.ty, b.tx, o.value, row_number() OVER (PARTITION BY b.g, b.ty, b.tx ORDER BY (b.ty - o.ty) * (b.ty - o.ty) + (b.tx - o.tx) * (b.tx - o.tx), o.ty, o.tx) AS k FROM cells b JOIN cells o ON b.g = o.g AND NOT b.valid AND o.valid) WHERE k = 1")
def nearest_fill(spark, sf):
    return localnorm.fill_nearest(_cells(spark, sf), ["g"], 0.0)


@query(f"WITH {COEF_SQL}, p AS (SELECT DISTINCT frame, y, x, least(greatest((y - 1.5) / 4.0, 0), 1) AS ft, least(greatest((x - 1.5) / 4.0, 0), 1) AS gt FROM pairs) SELECT p.frame, p.y, p.x, round(a.scale * (1 - ft) * (1 - gt) + b.scale * (1 - ft) * gt + c.scale * ft * (1 - gt) + d.scale * ft * gt, 6) AS field FROM p JOIN co a ON a.frame = p.frame AND a.ty = 0 AND a.tx = 0 JOIN co b ON b.frame = p.frame AND b.ty = 0 AND b.tx = 1 JOIN co c ON c.frame = p.frame AND c.ty = 1 AND c.tx = 0 JOIN co d ON d.frame = p.frame AND d.ty = 1 AND d.tx = 1")
def bilinear_field(spark, sf):
    g = _grid(spark, sf).select("frame", "ty", "tx", F.col("scale").alias("value"))
    return rounded(localnorm.bilinear_field(g, _pairs(spark, sf).select("frame", "y", "x"), ["frame"], 4, 8, 8), "field")


# --- stars -----------------------------------------------------------------------------------------------------------

MAX_SQL = f"{IMAGES_SQL}, {NB}, mx AS (SELECT frame, y, x, any_value(v) AS v FROM nb GROUP BY frame, y, x HAVING any_value(v) >= max(nv) AND any_value(v) > 100000 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6)"


def _maxima(spark, sf):
    return stars.local_maxima(images(spark, sf), ["frame"], 8, 8, F.lit(100000))


@query(f"WITH {MAX_SQL} SELECT * FROM mx")
def local_max(spark, sf):
    return _maxima(spark, sf)


@query(f"WITH {MAX_SQL} SELECT frame, y, x, v, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame, y // 4, x // 4 ORDER BY v DESC, y, x) AS rank FROM mx) WHERE rank <= 1")
def grid_top_k(spark, sf):
    return stars.top_per_cell(_maxima(spark, sf), ["frame"], 4, 1).select("frame", "y", "x", "v", "rank")


@query(f"WITH {MAX_SQL}, {BG}, p AS (SELECT m.frame, m.y AS cy, m.x AS cx, m.v AS cv, i.y, i.x, median, noise, greatest(i.v - median, 0.0) AS g FROM mx m JOIN images i ON i.frame = m.frame AND i.y BETWEEN m.y - 2 AND m.y + 2 AND i.x BETWEEN m.x - 2 AND m.x + 2 JOIN nz ON nz.frame = m.frame) SELECT frame, cy AS y, cx AS x, round(sum(g), 3) AS flux, round(sum(g * x) / sum(g), 6) AS sx, round(sum(g * y) / sum(g), 6) AS sy, count(*) FILTER (g > 0) AS npix, round(sum(g) / greatest(any_value(noise) * sqrt(CAST(greatest(count(*) FILTER (g > 0), 1) AS DOUBLE)), 1e-6), 6) AS snr FROM p GROUP BY frame, cy, cx HAVING sum(g) > 0")
def star_moments(spark, sf):
    m = stars.measure(_maxima(spark, sf), images(spark, sf), ["frame"], 2)
    return m.select("frame", "y", "x", F.round("flux", 3).alias("flux"), F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), "npix", F.round("snr", 6).alias("snr"))


@query()
def star_nms(spark, sf):
    return stars.suppress(_maxima(spark, sf), ["frame"], 2.5, 5)


# --- warp -----------------------------------------------------------------------------------------------------------


@query(f"WITH {IMAGES_SQL} SELECT frame, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(sum(v) AS DOUBLE) / count(*) AS v FROM images GROUP BY frame, y // 2, x // 2")
def block_mean(spark, sf):
    return warp.block_mean(images(spark, sf), ["frame"], 2)


@query(f"WITH {IMAGES_SQL} SELECT t.frame, t.y, t.x, coalesce(CAST(s.v AS DOUBLE), 0.0) AS v, CASE WHEN s.v IS NULL THEN 0 ELSE 1 END AS coverage FROM images t LEFT JOIN images s ON s.frame = t.frame AND s.y = t.y - CAST(t.frame // 5 % 5 - 2 AS INTEGER) AND s.x = t.x - CAST(t.frame % 5 - 2 AS INTEGER)")
def shift_warp(spark, sf):
    return warp.shift(images(spark, sf), ["frame"], F.expr("cast(frame % 5 - 2 as int)"), F.expr("cast(frame div 5 % 5 - 2 as int)"), 8, 8)


MOVE = [[1.0, 0.0, 0.25], [0.0, 1.0, -0.5], [0.0, 0.0, 1.0]]


def _taps_sql(kernel: str, lo: int, hi: int, inside: str) -> str:
    return f"""WITH {IMAGES_SQL}, t AS (SELECT frame, y, x, x - 0.25 AS sx, y + 0.5 AS sy FROM images), k AS (SELECT t.frame, t.y, t.x, {kernel.replace('$', '(sy - (floor(sy) + j))')} * {kernel.replace('$', '(sx - (floor(sx) + i))')} AS k, CAST(floor(sy) + j AS INTEGER) AS ky, CAST(floor(sx) + i AS INTEGER) AS kx FROM t, range({lo}, {hi}) AS a(j), range({lo}, {hi}) AS b(i) WHERE {inside}),
g AS (SELECT k.frame, k.y, k.x, sum(k * v) / sum(k) AS v FROM k JOIN images s ON s.frame = k.frame AND s.y = ky AND s.x = kx WHERE k <> 0 GROUP BY ALL)
SELECT t.frame, t.y, t.x, round(coalesce(g.v, 0.0), 4) AS v, CASE WHEN g.v IS NULL THEN 0 ELSE 1 END AS coverage, CASE WHEN g.v IS NULL THEN 64 ELSE 0 END AS dq FROM t LEFT JOIN g USING (frame, y, x)""".replace("GROUP BY ALL", "GROUP BY k.frame, k.y, k.x")


@query(_taps_sql("greatest(1 - abs($), 0)", 0, 2, "sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7"))
def bilinear_warp(spark, sf):
    return rounded(warp.warp(images(spark, sf), ["frame"], MOVE, 8, 8, "bilinear"), "v", digits=4)


@query(_taps_sql("(CASE WHEN abs($) <= 1 THEN 1.5 * abs($) * abs($) * abs($) - 2.5 * abs($) * abs($) + 1 WHEN abs($) < 2 THEN -0.5 * abs($) * abs($) * abs($) + 2.5 * abs($) * abs($) - 4 * abs($) + 2 ELSE 0 END)", -1, 3, "sx >= 1 AND sx < 6 AND sy >= 1 AND sy < 6"))
def bicubic_warp(spark, sf):
    return rounded(warp.warp(images(spark, sf), ["frame"], MOVE, 8, 8, "bicubic"), "v", digits=4)


@query(_taps_sql("(CASE WHEN abs($) >= 3 THEN 0 WHEN abs($) < 1e-8 THEN 1 ELSE sin(pi() * $) / (pi() * $) * sin(pi() * $ / 3) / (pi() * $ / 3) END)", -2, 4, "sx >= 2 AND sx < 5 AND sy >= 2 AND sy < 5"))
def lanczos_warp(spark, sf):
    return rounded(warp.warp(images(spark, sf), ["frame"], MOVE, 8, 8, "lanczos3"), "v", digits=4)


# --- registration -----------------------------------------------------------------------------------------------------------


@query(f"WITH {IMAGES_SQL}, s AS (SELECT i.frame, dy, dx, CAST(count(*) AS DOUBLE) AS n, CAST(sum(i.v) AS DOUBLE) AS sx, CAST(sum(r.v) AS DOUBLE) AS sy, CAST(sum(i.v * i.v) AS DOUBLE) AS sxx, CAST(sum(r.v * r.v) AS DOUBLE) AS syy, CAST(sum(i.v * r.v) AS DOUBLE) AS sxy FROM images i, range(-2, 3) a(dy), range(-2, 3) b(dx), images r WHERE r.frame = 0 AND r.y = i.y + dy AND r.x = i.x + dx AND i.frame < 200 GROUP BY i.frame, dy, dx), p AS (SELECT frame, dx, dy, round((n * sxy - sx * sy) / (sqrt(greatest(n * sxx - sx * sx, 0)) * sqrt(greatest(n * syy - sy * sy, 0))), 9) AS ncc FROM s) SELECT frame, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, round(ncc, 6) AS ncc FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ncc DESC, dy, dx) AS k FROM p) WHERE k = 1".replace(" AND i.frame < 200", ""))
def ncc_shift_search(spark, sf):
    im = whole_images(spark, sf)
    return rounded(register.ncc_search(im, im.filter("frame = 0"), ["frame"], 2), "ncc")


SIM_SQL = """pr AS (SELECT l_suppkey AS g, l_linenumber * 1000 + l_partkey % 997 AS mx, l_partkey % 1009 AS my, l_orderkey % 991 AS rx, CAST(l_quantity AS BIGINT) * 17 AS ry FROM lineitem),
s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, CAST(sum(mx) AS DOUBLE) AS sx, CAST(sum(my) AS DOUBLE) AS sy, CAST(sum(rx) AS DOUBLE) AS ux, CAST(sum(ry) AS DOUBLE) AS uy, CAST(sum(mx * mx + my * my) AS DOUBLE) AS q, CAST(sum(mx * rx + my * ry) AS DOUBLE) AS p, CAST(sum(mx * ry - my * rx) AS DOUBLE) AS c FROM pr GROUP BY g),
f AS (SELECT *, (n * p - sx * ux - sy * uy) / (n * q - sx * sx - sy * sy) AS a, (n * c - sx * uy + sy * ux) / (n * q - sx * sx - sy * sy) AS b FROM s),
e AS (SELECT g, sqrt(avg((a * mx - b * my + (ux - (a * sx - b * sy)) / n - rx) ** 2 + (b * mx + a * my + (uy - (b * sx + a * sy)) / n - ry) ** 2)) AS rms FROM pr JOIN f USING (g) GROUP BY g)"""


@query(f"WITH {SIM_SQL} SELECT g, CAST(n AS BIGINT) AS pairs, round(a, 8) AS a, round(b, 8) AS b, round((ux - (a * sx - b * sy)) / n, 4) AS tx, round((uy - (b * sx + a * sy)) / n, 4) AS ty, round(sqrt(a * a + b * b), 8) AS scale, round(rms, 3) AS rms, 'ok' AS status FROM f JOIN e USING (g)")
def similarity_moments(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 997).cast("bigint").alias("mx"), (F.col("l_partkey") % 1009).alias("my"), (F.col("l_orderkey") % 991).alias("rx"), (F.col("l_quantity").cast("bigint") * 17).alias("ry"))
    s = register.similarity(li, ["g"]).drop("rotation")
    return rounded(rounded(rounded(s, "a", "b", "scale", digits=8), "tx", "ty", digits=4), "rms", digits=3)


CAT_SQL = f"{MAX_SQL}, cat AS (SELECT frame, y * 8 + x AS id, y, x FROM mx), rc AS (SELECT id, y, x FROM cat WHERE frame = 0)"


def _catalogues(spark, sf):
    c = _maxima(spark, sf).select("frame", (F.col("y") * 8 + F.col("x")).alias("id"), "y", "x")
    r = c.filter("frame = 0").drop("frame")
    return c, c.select("frame").distinct().crossJoin(F.broadcast(r))  # one catalogue


@query(f"WITH {CAT_SQL}, o AS (SELECT frame, m.id AS mi, r.id AS ri, r.x - m.x AS dx, r.y - m.y AS dy FROM cat m, rc r), v AS (SELECT a.frame, a.mi, a.ri, a.dx, a.dy, count(*) AS votes FROM o a JOIN o b ON a.frame = b.frame AND (a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy) <= 1 WHERE abs(a.dx) <= 4 AND abs(a.dy) <= 4 AND abs(b.dx) <= 4 AND abs(b.dy) <= 4 GROUP BY ALL) SELECT frame, dx, dy, votes FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY votes DESC, ri, mi) AS k FROM v) WHERE k = 1".replace("GROUP BY ALL", "GROUP BY a.frame, a.mi, a.ri, a.dx, a.dy"))
def translation_vote(spark, sf):
    c, r = _catalogues(spark, sf)
    return register.votes(c, r, ["frame"], 1.0, 4.0)


@query(f"WITH {CAT_SQL}, d AS (SELECT frame, m.id AS mi, r.id AS ri, (m.x - r.x) * (m.x - r.x) + (m.y - r.y) * (m.y - r.y) AS d2 FROM cat m, rc r), k AS (SELECT *, row_number() OVER (PARTITION BY frame, mi ORDER BY d2, ri) AS a, row_number() OVER (PARTITION BY frame, ri ORDER BY d2, mi) AS b FROM d) SELECT frame, mi, ri, d2 FROM k WHERE a = 1 AND b = 1 AND d2 <= 4")
def mutual_nn(spark, sf):
    c, r = _catalogues(spark, sf)
    return register.mutual_neighbours(c, r, ["frame"], 2.0).select("frame", "mi", "ri", "d2")


@query()
def phase_correlation(spark, sf):
    im = images(spark, sf)
    return register.phase_correlation(im, im.filter("frame = 0"), 8, 8)


@query()
def star_registration(spark, sf):
    c = _maxima(spark, sf).select("frame", "x", "y", F.col("v").alias("flux"))
    return register.register(c, c.filter("frame = 0"), "translation", 1.5, 3).select("frame", "inliers", "rms", "status", F.col("matrix")[0][2].alias("dx"), F.col("matrix")[1][2].alias("dy"))


# --- ledger -----------------------------------------------------------------------------------------------------------

STAGE_SQL = """l AS (SELECT o_orderkey AS frame_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 11 = 0 THEN 'rejected' WHEN o_orderkey % 13 <> 0 THEN 'accepted' ELSE 'missing' END AS quality,
  CASE o_orderkey % 17 WHEN 0 THEN 'failed' WHEN 1 THEN 'quality_rejected' WHEN 2 THEN 'missing' ELSE 'ok' END AS registration, CASE o_orderkey % 19 WHEN 0 THEN 'skipped' ELSE 'ok' END AS warp,
  CASE o_orderkey % 23 WHEN 0 THEN 'empty' ELSE 'ok' END AS local_norm, CASE o_orderkey % 5 WHEN 0 THEN 'zero_weight' WHEN 1 THEN 'missing' WHEN 2 THEN 'seen' ELSE 'used' END AS integration FROM orders),
c AS (SELECT *, (CASE WHEN integration = 'used' AND quality = 'rejected' THEN 1 ELSE 0 END) + (CASE WHEN integration = 'used' AND registration IN ('quality_rejected', 'failed', 'missing') THEN 1 ELSE 0 END) + (CASE WHEN integration = 'used' AND warp = 'skipped' THEN 1 ELSE 0 END) + (CASE WHEN integration = 'used' AND local_norm = 'empty' THEN 1 ELSE 0 END) AS n_conflicts FROM l),
fs AS (SELECT *, CASE WHEN integration = 'used' AND n_conflicts > 0 THEN 'integration_conflict' WHEN integration = 'used' THEN 'integrated' WHEN quality = 'rejected' OR registration = 'quality_rejected' THEN 'quality_rejected' WHEN registration IN ('failed', 'missing') THEN 'registration_rejected'
  WHEN warp = 'skipped' THEN 'warp_skipped' WHEN local_norm = 'empty' THEN 'local_norm_rejected' WHEN integration = 'zero_weight' THEN 'zero_weight' WHEN integration <> 'missing' THEN 'not_integrated' ELSE 'pending' END AS final_status FROM c)"""


def _account(spark, sf):
    o, k = table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id")), F.col("frame_id")
    stages = {
        "quality": o.filter((k % 13 != 0) | ((k % 2 == 0) & (k % 11 == 0))).withColumn("status", F.when((k % 2 == 0) & (k % 11 == 0), "rejected").otherwise("accepted")),
        "registration": o.filter(k % 17 != 2).withColumn("status", F.when(k % 17 == 0, "failed").when(k % 17 == 1, "quality_rejected").otherwise("ok")),
        "warp": o.withColumn("status", F.when(k % 19 == 0, "skipped").otherwise("ok")),
        "local_norm": o.withColumn("status", F.when(k % 23 == 0, "empty").otherwise("ok")),
        "integration": o.filter(k % 5 != 1).withColumn("status", F.when(k % 5 == 0, "zero_weight").when(k % 5 == 2, "seen").otherwise("used")),
    }
    return ledger.account(stages)


@query(f"WITH {STAGE_SQL} SELECT frame_id, quality, registration, warp, local_norm, integration FROM l")
def frame_ledger(spark, sf):
    return _account(spark, sf).drop("conflicts", "final_status")


@query(f"WITH {STAGE_SQL} SELECT frame_id, final_status, n_conflicts FROM fs")
def status_cascade(spark, sf):
    return _account(spark, sf).select("frame_id", "final_status", F.size("conflicts").alias("n_conflicts"))


@query(f"WITH {STAGE_SQL} SELECT final_status, count(*) AS n FROM fs WHERE final_status <> 'integrated' GROUP BY 1")
def exception_summary(spark, sf):
    return ledger.exceptions(_account(spark, sf))


@query("WITH f AS (SELECT count(*) AS n, count(DISTINCT l_orderkey) AS o, min(l_discount) AS d0, max(l_discount) AS d1 FROM lineitem) SELECT 3 AS checks, n > 0 AND n = o AND d0 BETWEEN 0 AND 1 AND d1 BETWEEN 0 AND 1 AS passed, concat_ws(',', CASE WHEN n = 0 THEN 'rows' END, CASE WHEN n <> o THEN 'orders_are_rows' END, CASE WHEN NOT (d0 BETWEEN 0 AND 1 AND d1 BETWEEN 0 AND 1) THEN 'discount_range' END) AS failed FROM f")
def contract_checks(spark, sf):
    row = table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("o"), F.min("l_discount").alias("d0"), F.max("l_discount").alias("d1"))
    out = ledger.checks(row, {"rows": F.col("n") > 0, "orders_are_rows": F.col("n") == F.col("o"), "discount_range": F.col("d0").between(0, 1) & F.col("d1").between(0, 1)})
    return out.select("checks", "passed", F.array_join("failed_checks", ",").alias("failed"))


@query("SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_values(spark, sf):
    return ledger.duplicates(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 10 <> 0), c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 9 <> 0) SELECT k, b.v AS b, c.v AS c, CASE WHEN c.v IS NULL THEN 'removed' WHEN b.v IS NULL THEN 'added' ELSE 'changed' END AS change FROM b FULL JOIN c USING (k) WHERE b.v IS DISTINCT FROM c.v")
def diff_frames(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return ledger.changes(o.filter("k % 10 <> 0"), o.filter("k % 9 <> 0").withColumn("v", F.when(F.col("k") % 3 == 0, "X").otherwise(F.col("v"))), "k", "v")


# --- tuning -----------------------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT l_suppkey AS tile, l_returnflag = 'R' AS focus, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem), s AS (SELECT tile, CAST(sum(v) FILTER (focus) AS DOUBLE) / nullif(count(*) FILTER (focus), 0) AS f, CAST(sum(v) FILTER (NOT focus) AS DOUBLE) / nullif(count(*) FILTER (NOT focus), 0) AS c FROM r GROUP BY tile) SELECT tile, round(f, 4) AS focus_mean, round(c, 4) AS control_mean, round(least(greatest(coalesce(greatest(c, 0) / f, 1.0), 0.05), 1.0), 6) AS multiplier FROM s")
def weight_proposal(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tile"), (F.col("l_returnflag") == "R").alias("focus"), cents("l_extendedprice").alias("value"))
    return rounded(rounded(tuning.weight_proposal(r, ["tile"]), "focus_mean", "control_mean", digits=4), "multiplier")


@query("SELECT s_suppkey AS tile, round(CASE WHEN s_nationkey = 0 THEN 1.0 ELSE least(greatest(1 - (CAST(round(s_acctbal * 100) AS BIGINT) % 100) / (s_nationkey * 4.0), 0.0), 1.0) END, 6) AS multiplier FROM supplier")
def tile_policy(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tile"), (cents("s_acctbal") % 100).cast("double").alias("residual"), (F.col("s_nationkey") * 4.0).alias("contribution"))
    return rounded(tuning.tile_policy(s).select("tile", "multiplier"), "multiplier")


@query("WITH f AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS value FROM orders GROUP BY 1, 2), w AS (SELECT p, 3 AS size, d AS first, max(d) OVER r AS last, CAST(sum(value) OVER r AS BIGINT) AS total, count(*) OVER r AS k, row_number() OVER (PARTITION BY p ORDER BY d) - 1 AS i FROM f WINDOW r AS (PARTITION BY p ORDER BY d ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT p, size, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, total FROM w WHERE k = 3 AND i % 2 = 0")
def frame_window_search(spark, sf):
    f = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").cast("string").alias("d")).agg(F.sum(cents("o_totalprice")).alias("value"))
    return tuning.frame_windows(f, ["p"], "d", [3], 2)


@query("SELECT r_regionkey, n_nationkey FROM region, nation")
def sweep_cross(spark, sf):
    return tuning.sweep({"r": table(spark, sf, "region").select("r_regionkey"), "n": table(spark, sf, "nation").select("n_nationkey")})


@query("SELECT n_nationkey, CAST(row_number() OVER (ORDER BY (n_regionkey > 1) DESC, n_name, n_nationkey) AS INTEGER) AS rank FROM nation")
def rank_sweep(spark, sf):
    n = table(spark, sf, "nation").withColumn("ok", F.col("n_regionkey") > 1)
    return tuning.rank_runs(n, ["ok"], ["n_name", "n_nationkey"]).select("n_nationkey", "rank")


@query()
def greedy_tiles(spark, sf):
    k = F.col("s_suppkey")
    t = table(spark, sf, "supplier").select(k.alias("id"), (k % 10 * 3).alias("y0"), (k % 10 * 3 + 4).alias("y1"), (k % 7 * 3).alias("x0"), (k % 7 * 3 + 4).alias("x1"), cents("s_acctbal").alias("score"))
    return tuning.greedy_tiles(t, "score", 16)


# --- sources and streams -----------------------------------------------------------------------------------------------------------


@query("SELECT vec_id AS frame, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, CAST(embedding[p + 1] AS DOUBLE) AS v, 0 AS dq FROM (SELECT vec_id, embedding, unnest(range(64)) AS p FROM embeddings)")
def fits_round_trip(spark, sf):
    """Write all frames as FITS files and scan them tile by tile."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("p", "v"))
    folder = shared_folder(spark, "fits")
    fits.write_images(e.select("frame", F.expr("cast(p div 8 as int)").alias("y"), F.expr("cast(p % 8 as int)").alias("x"), "v"), folder).count()
    spark.dataSource.register(fits.FitsSource)
    p = fits.pixels(spark.read.format("fits").option("tile", 8).load(folder))
    return p.select(F.regexp_extract("path", r"(\d+)\.fits$", 1).cast("bigint").alias("frame"), "y", "x", F.col("v").cast("double").alias("v"), "dq")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def stream_running_mean(spark, sf):
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    m = running.drain(running.running_mean(events, "ts", ["event_type"], cents("value")))
    return rounded(m.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "mean", "n"), "mean")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: sigma-clipped stack."""
    return reject_sigma(spark, sf)


__all__ = ["ORACLE", "QUERIES", "entry"]
