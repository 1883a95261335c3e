"""Further queries: masks, audits, decisions, local normalisation end to end, sampling, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from siderea.model import Rejection
from siderea.operators import audit, compare, localnorm, quality, register, stack, stars, warp
from siderea.plans import queries as Q
from siderea.plans.queries import CAT_SQL, COEF_SQL, IMAGES_SQL, PAIRS_SQL, SAMPLES_SQL, STD, query, rounded
from siderea.sources.tables import cents, images, samples, table

BOX_SQL = "bx AS (SELECT s_suppkey AS id, s_suppkey % 37 * 3 AS y0, s_suppkey % 37 * 3 + 1 + s_nationkey AS y1, s_suppkey % 41 * 2 AS x0, s_suppkey % 41 * 2 + 5 AS x1 FROM supplier)"


def _boxes(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), (k % 37 * 3).alias("y0"), (k % 37 * 3 + 1 + F.col("s_nationkey")).alias("y1"), (k % 41 * 2).alias("x0"), (k % 41 * 2 + 5).alias("x1"))


@query(f"WITH {BOX_SQL} SELECT a.id AS a, b.id AS b, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS area FROM bx a JOIN bx b ON a.y0 < b.y1 AND b.y0 < a.y1 AND a.x0 < b.x1 AND b.x0 < a.x1 WHERE a.id < b.id")
def rectangle_overlap(spark, sf):
    b = _boxes(spark, sf)
    return audit.overlapping(b, b, 8).filter("a < b")


@query("WITH f AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i, s_suppkey BETWEEN 40 AND 45 AS foc FROM supplier), e AS (SELECT min(i) AS lo, max(i) AS hi FROM f WHERE foc) SELECT s_suppkey FROM f, e WHERE (i BETWEEN lo - 5 AND lo - 1 OR i BETWEEN hi + 1 AND hi + 5) AND NOT foc AND s_acctbal > 0")
def control_frames(spark, sf):
    return audit.controls(table(spark, sf, "supplier"), F.col("s_suppkey").between(40, 45), 5, 5, "s_suppkey", "s_acctbal").select("s_suppkey")


@query("SELECT coalesce(a.k, b.k) AS k, round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 6) AS delta, a.s IS NOT DISTINCT FROM b.s AS same_status FROM (SELECT o_orderkey AS k, o_orderkey % 10 * 0.25 AS x, o_custkey % 7 * 0.5 AS y, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey AS k, o_orderkey % 11 * 0.25 AS x, o_custkey % 5 * 0.5 AS y, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 6 <> 0) b ON a.k = b.k")
def matrix_delta(spark, sf):
    o, k, c = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    a = o.filter(k % 5 != 0).select(k.alias("k"), F.array(k % 10 * 0.25, c % 7 * 0.5).alias("m"), F.col("o_orderstatus").alias("status"))
    b = o.filter(k % 6 != 0).select(k.alias("k"), F.array(k % 11 * 0.25, c % 5 * 0.5).alias("m"), F.when(k % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"))
    return rounded(audit.matrix_delta(a, b, "k"), "delta")


@query("WITH b AS (SELECT CAST(avg(l_linenumber) AS DOUBLE) AS x, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS y, CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS z FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS y, CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS z FROM lineitem WHERE l_returnflag = 'R') SELECT 'price' AS metric, round(b.y, 4) AS baseline, round(c.y, 4) AS candidate, round(c.y / b.y, 6) AS ratio FROM b, c UNION ALL SELECT 'line', round(b.z, 4), round(c.z, 4), round(c.z / b.z, 6) FROM b, c")
def quality_metrics_compare(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("k"), cents("l_extendedprice").alias("price"), F.col("l_linenumber").cast("bigint").alias("line"))
    r = audit.metric_ratios(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), "k", ["price", "line"])
    return rounded(rounded(r, "baseline", "candidate", digits=4), "ratio")


@query(f"WITH {SAMPLES_SQL}, st AS (SELECT px, quantile_cont(v, 0.5) AS c, {STD} AS s FROM samples GROUP BY px), f AS (SELECT s.*, s > 0 AND abs(v - c) > 1.5 * s AS out FROM (SELECT samples.*, c, st.s AS s FROM samples JOIN st USING (px)) s), g AS (SELECT px, count(*) - count(*) FILTER (out) >= 3 AND count(*) FILTER (out) <= count(*) * 0.5 AS ok FROM f GROUP BY px), k AS (SELECT f.*, NOT (out AND ok) AS keep FROM f JOIN g USING (px)) SELECT frame, CAST(coalesce(sum(w * v) FILTER (keep), 0) AS BIGINT) AS weighted, CAST(coalesce(sum(w) FILTER (keep), 0) AS BIGINT) AS weight, count(*) FILTER (keep) AS accepted, count(*) AS samples, round(CAST(count(*) FILTER (keep) AS DOUBLE) / count(*), 6) AS accepted_fraction FROM k GROUP BY frame".replace("(SELECT s.*, s > 0 AND abs(v - c) > 1.5 * s AS out FROM", "(SELECT s.*, s.s > 0 AND (v < c - 1.5 * s.s OR v > c + 1.5 * s.s) AS out FROM"))
def frame_contribution(spark, sf):
    d = stack.reject(samples(spark, sf), ["px"], Rejection("sigma", 1.5, 1.5))
    return rounded(audit.contributions(d, ["px"], ["frame"]), "accepted_fraction")


@query("SELECT l_suppkey, round(CAST(sum(l_linenumber) FILTER (l_returnflag = 'R') AS DOUBLE) / nullif(count(*) FILTER (l_returnflag = 'R'), 0), 6) AS focus, round(CAST(sum(l_linenumber) FILTER (l_returnflag <> 'R') AS DOUBLE) / nullif(count(*) FILTER (l_returnflag <> 'R'), 0), 6) AS control FROM lineitem GROUP BY 1")
def group_contrast(spark, sf):
    return rounded(audit.contrast(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "R", "l_linenumber").drop("contrast"), "focus", "control")


@query(f"WITH {SAMPLES_SQL}, u AS (SELECT px, frame, dq FROM samples WHERE dq <> 0 UNION ALL SELECT px, frame, 64 FROM samples WHERE ord % 50 = 0) SELECT px, frame, bit_or(dq) AS dq, 1 AS invalid FROM u GROUP BY px, frame")
def combine_masks(spark, sf):
    s = samples(spark, sf)
    u = s.filter("dq <> 0").select("px", "frame", "dq").unionByName(s.filter("ord % 50 = 0").select("px", "frame", F.lit(64).alias("dq")))
    return u.groupBy("px", "frame").agg(F.bit_or("dq").alias("dq"), F.max(F.lit(1)).alias("invalid"))


@query("SELECT s_nationkey, count(*) AS n, count(*) FILTER (s_acctbal > 0) AS positive, count(*) FILTER (s_acctbal < 0) AS negative, count(*) FILTER (s_acctbal <> trunc(s_acctbal)) AS fractional, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS total FROM supplier GROUP BY 1")
def count_map_summary(spark, sf):
    a = F.col("s_acctbal")
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_if(a > 0).alias("positive"), F.count_if(a < 0).alias("negative"), F.count_if(a != F.when(a >= 0, F.floor(a)).otherwise(F.ceil(a))).alias("fractional"), F.sum(cents("s_acctbal")).alias("total"))


@query("SELECT event_id, CAST(event_id % 13 AS DOUBLE) AS rms, event_type AS mode FROM events")
def registration_warnings(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.array(F.concat(F.lit("rms="), (k % 13).cast("string")), F.lit("note"), F.concat(F.lit("mode="), "event_type")).alias("w"))
    return audit.parsed_warnings(e, "event_id", "w", ["rms"], ["mode"])


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'extra_failed' ELSE 'recovered' END AS change FROM orders WHERE (o_orderkey % 4 = 0) <> (o_orderkey % 5 = 0)")
def registration_triage(spark, sf):
    o, k = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), F.col("k")
    return audit.triage(o.withColumn("failed", k % 4 == 0), o.withColumn("failed", k % 5 == 0), "k")


@query("SELECT p_partkey, CAST(p_size * 40000 AS BIGINT) AS frame_bytes, CAST(3 * 40000 AS BIGINT) AS master_bytes, CAST(8 * 40000 AS BIGINT) AS batch_bytes, CAST(7 * 40000 AS BIGINT) AS output_bytes, CAST((p_size + 18) * 40000 AS BIGINT) AS peak_bytes FROM part")
def memory_plan(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *[v.cast("bigint").alias(k) for k, v in audit.memory_plan(F.col("p_size"), F.lit(100), F.lit(100), F.lit(3), F.lit(8)).items()])


@query(f"WITH {PAIRS_SQL}, f AS (SELECT frame, quantile_cont(v, 0.5) AS m, {STD} AS s FROM images GROUP BY frame), r AS (SELECT m AS rm, s AS rs FROM f WHERE frame = 0) SELECT i.frame, y, x, round((v - m) / s * rs + rm, 3) AS matched FROM images i JOIN f USING (frame), r")
def match_global_background(spark, sf):
    im = images(spark, sf)
    return rounded(localnorm.match_global(im, im.filter("frame = 0")).select("frame", "y", "x", "matched"), "matched", digits=3)


@query(f"WITH {COEF_SQL} SELECT p.frame, p.y, p.x, round(c * scale + \"offset\", 3) AS v FROM pairs p JOIN co ON co.frame = p.frame AND co.ty = p.y // 4 AND co.tx = p.x // 4")
def local_norm_piecewise(spark, sf):
    p = Q._pairs(spark, sf).withColumns({"ty": localnorm.tile_of("y", 4), "tx": localnorm.tile_of("x", 4)})
    j = p.join(localnorm.coefficients(p, ["frame", "ty", "tx"]), ["frame", "ty", "tx"])
    return j.select("frame", "y", "x", F.round(localnorm.apply_field(F.col("c"), F.col("scale"), F.col("offset"), F.lit(True)), 3).alias("v"))


FIELD = "a.{0} * (1 - ft) * (1 - gt) + b.{0} * (1 - ft) * gt + c.{0} * ft * (1 - gt) + d.{0} * ft * gt"


@query(f"WITH {COEF_SQL}, p AS (SELECT *, least(greatest((y - 1.5) / 4.0, 0), 1) AS ft, least(greatest((x - 1.5) / 4.0, 0), 1) AS gt FROM pairs) SELECT p.frame, p.y, p.x, round(p.c * ({FIELD.format('scale')}) + ({FIELD.format(chr(34) + 'offset' + chr(34))}), 2) AS v FROM p JOIN co a ON a.frame = p.frame AND a.ty = 0 AND a.tx = 0 JOIN co b ON b.frame = p.frame AND b.ty = 0 AND b.tx = 1 JOIN co c ON c.frame = p.frame AND c.ty = 1 AND c.tx = 0 JOIN co d ON d.frame = p.frame AND d.ty = 1 AND d.tx = 1")
def local_norm_continuous(spark, sf):
    p = Q._pairs(spark, sf)
    g = Q._grid(spark, sf)
    fields = [localnorm.bilinear_field(g.select("frame", "ty", "tx", F.col(c).alias("value")), p.select("frame", "y", "x"), ["frame"], 4, 8, 8).withColumnRenamed("field", c) for c in ("scale", "offset")]
    j = p.join(fields[0], ["frame", "y", "x"]).join(fields[1], ["frame", "y", "x"])
    return j.select("frame", "y", "x", F.round(localnorm.apply_field(F.col("c"), F.col("scale"), F.col("offset"), F.lit(True)), 2).alias("v"))


@query("WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT s_suppkey FROM n WHERE n <= 7 OR i IN (SELECT CAST(floor(k * (n - 1) / 6.0) AS INTEGER) FROM range(7) t(k))")
def evenly_spaced(spark, sf):
    return quality.evenly_spaced(table(spark, sf, "supplier"), 7, ["s_suppkey"]).select("s_suppkey")


@query(f"WITH {CAT_SQL}, o AS (SELECT frame, round_even(m.x - r.x, 0) AS dx, round_even(m.y - r.y, 0) AS dy FROM cat m, rc r) SELECT DISTINCT frame, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy FROM o")
def offset_candidates(spark, sf):
    c, r = Q._catalogues(spark, sf)
    j = c.alias("m").join(r.alias("r"), "frame")
    return j.select("frame", F.rint(F.col("m.x") - F.col("r.x")).cast("int").alias("dx"), F.rint(F.col("m.y") - F.col("r.y")).cast("int").alias("dy")).distinct()


@query(f"WITH {PAIRS_SQL}, s AS (SELECT frame, count(*) AS valid, sqrt(CAST(sum((c - r) * (c - r)) AS DOUBLE) / count(*)) AS rms, CAST(sum(abs(c - r)) AS DOUBLE) / count(*) AS mean_abs FROM pairs GROUP BY frame) SELECT frame, valid, round(rms, 4) AS rms, round(mean_abs, 4) AS mean_abs FROM s")
def alignment_metrics(spark, sf):
    d = Q._pairs(spark, sf).withColumn("d", F.col("c") - F.col("r"))
    n = F.count("d")
    return d.groupBy("frame").agg(n.alias("valid"), F.round(F.sqrt(compare.ratio(F.sum(F.col("d") * F.col("d")), n)), 4).alias("rms"), F.round(compare.ratio(F.sum(F.abs("d")), n), 4).alias("mean_abs"))


@query(f"WITH {IMAGES_SQL} SELECT t.frame, t.y, t.x, coalesce(CAST(s.v AS DOUBLE), 0.0) AS v, CASE WHEN s.v IS NULL THEN 0 ELSE 1 END AS coverage, CASE WHEN s.v IS NULL THEN 64 ELSE 0 END AS dq FROM images t LEFT JOIN images s ON s.frame = t.frame AND t.x - 0.25 BETWEEN 0 AND 7 AND t.y + 0.5 BETWEEN 0 AND 7 AND s.x = CAST(round_even(t.x - 0.25, 0) AS INTEGER) AND s.y = CAST(round_even(t.y + 0.5, 0) AS INTEGER)")
def nearest_warp(spark, sf):
    return warp.warp(images(spark, sf), ["frame"], Q.MOVE, 8, 8, "nearest")


@query()
def lanczos_clamped_warp(spark, sf):
    return rounded(warp.warp(images(spark, sf), ["frame"], Q.MOVE, 8, 8, "lanczos3", clamp=0.3), "v", digits=4)


@query(f"WITH {IMAGES_SQL}, i AS (SELECT frame, CAST(v AS DOUBLE) / 1000000 AS d, CAST(CAST(v AS DOUBLE) / 1000000 AS FLOAT) AS f FROM images) SELECT frame, count(*) AS n, max(abs(CAST(f AS DOUBLE) - d)) AS max_abs FROM i GROUP BY frame")
def precision_error(spark, sf):
    d = F.col("v").cast("double") / 1000000
    return images(spark, sf).groupBy("frame").agg(F.count("*").alias("n"), F.max(F.abs(d.cast("float").cast("double") - d)).alias("max_abs"))


@query(f"WITH {Q.MAX_SQL} SELECT m.frame, m.y, m.x FROM mx m WHERE EXISTS (SELECT 1 FROM (SELECT frame, y, x FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY v DESC, y, x) AS k FROM mx) WHERE k = 1) s WHERE s.frame = m.frame AND (s.y - m.y) * (s.y - m.y) + (s.x - m.x) * (s.x - m.x) <= 9)")
def star_protection(spark, sf):
    """Candidates within three pixels of a frame's brightest star."""
    m = Q._maxima(spark, sf)
    best = stars.top_per_cell(m, ["frame"], 8, 1).select("frame", F.col("y").alias("sy"), F.col("x").alias("sx"))
    near = (F.col("sy") - F.col("y")) * (F.col("sy") - F.col("y")) + (F.col("sx") - F.col("x")) * (F.col("sx") - F.col("x")) <= 9
    return m.join(best, "frame").filter(near).select("frame", "y", "x").distinct()


@query()
def subpixel_registration(spark, sf):
    """A solution for each frame by similarity, and its gate."""
    c = Q._maxima(spark, sf).select("frame", "x", "y", F.col("v").alias("flux"))
    s = register.register(c, c.filter("frame = 0"), "similarity", 1.5, 4)
    g = register.gate(s.withColumns({"a": F.col("matrix")[0][0], "b": F.col("matrix")[1][0]}), 4, 1.5)
    return g.select("frame", "inliers", "accepted", F.array_join("reasons", ",").alias("reasons"))

