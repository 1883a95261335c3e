"""Run contracts as queries: agreement of counts, regressions, verification of what was applied, histories, sub-pixel searches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siderea.model import Rejection
from siderea.operators import compare, ledger, stack, whole
from siderea.plans import queries as Q
from siderea.plans.queries import IMAGES_SQL, ORACLE, PAIRS_SQL, SAMPLES_SQL, query, rounded
from siderea.sources.tables import cents, samples, table, whole_images


def count_deltas(a: DataFrame, b: DataFrame, px: list[str]) -> DataFrame:
    """One row: how two stacks' coverage and rejection counts differ, pixel by pixel."""
    cols = ("coverage", "n_low", "n_high")
    j = a.select(*px, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(*px, *[F.col(c).alias(f"b_{c}") for c in cols]), px)
    diff = {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in cols}
    any_diff = stack.any_of([d != 0 for d in diff.values()])
    return j.agg(F.count("*").alias("pixels"), F.count_if(any_diff).alias("mismatched"), *[F.sum(d).cast("bigint").alias(f"signed_{c}") for c, d in diff.items()], *[F.sum(F.abs(d)).cast("bigint").alias(f"absolute_{c}") for c, d in diff.items()])


DELTA = ", ".join(f"CAST(sum(b.{c} - a.{c}) AS BIGINT) AS signed_{c}, CAST(sum(abs(b.{c} - a.{c})) AS BIGINT) AS absolute_{c}" for c in ("coverage", "n_low", "n_high"))


@query(f"WITH a AS ({ORACLE['reject_sigma']}), b AS ({ORACLE['reject_mad']}) SELECT count(*) AS pixels, count(*) FILTER (a.coverage <> b.coverage OR a.n_low <> b.n_low OR a.n_high <> b.n_high) AS mismatched, {DELTA} FROM a JOIN b USING (px)")
def rejection_sample_audit(spark, sf):
    s = samples(spark, sf)
    return count_deltas(stack.stack(s, ["px"], rejection=Rejection("sigma", Q.K, Q.K)), stack.stack(s, ["px"], rejection=Rejection("mad", 2.0, 2.0)), ["px"])


@query(f"WITH {SAMPLES_SQL}, f AS (SELECT filt, frame, count(*) AS n, count(*) FILTER (dq <> 0) AS bad FROM samples GROUP BY 1, 2) SELECT filt, count(*) AS frames, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(bad) AS BIGINT) AS invalid, count(*) FILTER (bad = n) AS masked_frames, true AS passed, '' AS failed FROM f GROUP BY filt")
def dq_lifecycle(spark, sf):
    """Per filter: frames, samples and invalid samples as seen by frame and by sample agree."""
    s = samples(spark, sf)
    f = s.groupBy("filt", "frame").agg(F.count("*").alias("n"), F.count_if(F.col("dq") != 0).alias("bad"))
    by_frame = f.groupBy("filt").agg(F.count("*").alias("frames"), F.sum("n").alias("samples"), F.sum("bad").alias("invalid"), F.count_if(F.col("bad") == F.col("n")).alias("masked_frames"))
    by_sample = s.groupBy("filt").agg(F.count("*").alias("all"), F.count_if(F.col("dq") != 0).alias("bad"), F.count_if(F.col("dq") == 0).alias("good"))
    tests = {"samples": F.col("samples") == F.col("all"), "invalid": F.col("invalid") == F.col("bad"), "closure": F.col("good") + F.col("bad") == F.col("all"), "frames": F.col("masked_frames") <= F.col("frames")}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in tests.items()]))
    return by_frame.join(by_sample, "filt").select("filt", "frames", "samples", "invalid", "masked_frames", (F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("failed"))


@query(f"WITH {PAIRS_SQL}, m AS (SELECT filt, CAST(round(CAST(sum(c - r) AS DOUBLE) / count(*)) AS BIGINT) AS shift FROM pairs GROUP BY filt), t AS (SELECT frame, y // 4 AS ty, x // 4 AS tx, CAST(sum(abs(c - r)) AS DOUBLE) / count(*) AS before, CAST(sum(abs(c - shift - r)) AS DOUBLE) / count(*) AS after FROM pairs JOIN m USING (filt) GROUP BY frame, y // 4, x // 4) SELECT frame, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, round(before, 4) AS before, round(after, 4) AS after, after < before AS improved FROM t")
def apply_verification(spark, sf):
    """Each tile's mean absolute difference before and after the filter's mean shift was taken out."""
    p = Q._pairs(spark, sf)
    m = p.groupBy("filt").agg(F.round(compare.ratio(F.sum(F.col("c") - F.col("r")), F.count("*"))).cast("bigint").alias("shift"))
    d = p.join(m, "filt").withColumns({"ty": F.expr("cast(y div 4 as int)"), "tx": F.expr("cast(x div 4 as int)")})
    mean = lambda e: compare.ratio(F.sum(F.abs(e)), F.count("*"))
    t = d.groupBy("frame", "ty", "tx").agg(mean(F.col("c") - F.col("r")).alias("before"), mean(F.col("c") - F.col("shift") - F.col("r")).alias("after"))
    return rounded(t.withColumn("improved", F.col("after") < F.col("before")), "before", "after", digits=4)


@query("WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a, string_split(text, '. ') AS b FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, a, b, unnest(range(len(a))) AS i FROM d) SELECT doc_id, CAST(i AS INTEGER) AS i, sha256(a[i + 1]) AS target, coalesce(length(b[i + 1]), -1) AS output_length, i < len(b) AS accepted FROM u")
def history_rows(spark, sf):
    """Targets and outputs of a nested history joined by position: every target, with the output of its place if there is one."""
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.split("text", "\n").alias("a"), F.split("text", r"\. ").alias("b"))
    u = d.select("doc_id", "b", F.posexplode("a").alias("i", "t"))
    out = F.get("b", F.col("i"))
    return u.select("doc_id", "i", F.sha2("t", 256).alias("target"), F.coalesce(F.length(out), F.lit(-1)).cast("bigint").alias("output_length"), out.isNotNull().alias("accepted"))


@query("WITH e AS (SELECT * FROM (VALUES ('scan'), ('plan'), ('calibrate'), ('quality')) t(stage)), a AS (SELECT o_orderkey AS run, CASE o_orderkey % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'plan' ELSE 'quality' END AS stage, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT DISTINCT run FROM a) SELECT run, e.stage, coalesce(n, 0) AS n, n IS NOT NULL AS complete FROM r CROSS JOIN e LEFT JOIN a USING (run, stage)")
def stage_ledger(spark, sf):
    """What each run left of the expected stages."""
    k = F.col("o_orderkey")
    a = table(spark, sf, "orders").groupBy(k.alias("run"), F.when(k % 3 == 0, "scan").when(k % 3 == 1, "plan").otherwise("quality").alias("stage")).agg(F.count("*").alias("n"))
    expected = a.select("run").distinct().select("run", F.explode(F.array(*map(F.lit, ("scan", "plan", "calibrate", "quality")))).alias("stage"))
    return expected.join(a, ["run", "stage"], "left").select("run", "stage", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("complete"))


@query("WITH s AS (SELECT o_custkey AS variant, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS total, count(*) AS frames FROM orders GROUP BY 1) SELECT 'total' AS metric, (SELECT variant FROM s ORDER BY total, variant LIMIT 1) AS best, (SELECT min(total) FROM s) AS value UNION ALL SELECT 'frames', (SELECT variant FROM s ORDER BY frames, variant LIMIT 1), (SELECT min(frames) FROM s)")
def sweep_analysis(spark, sf):
    """For each metric the variant where it is least."""
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("variant")).agg(F.sum(cents("o_totalprice")).alias("total"), F.count("*").alias("frames"))
    long = s.unpivot("variant", ["total", "frames"], "metric", "value")
    return long.groupBy("metric").agg(F.min(F.struct("value", "variant")).alias("m")).select("metric", F.col("m.variant").alias("best"), F.col("m.value").alias("value"))


@query("WITH a AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'A') AS b, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY 1) SELECT k, round(c / nullif(CAST(b AS DOUBLE), 0), 6) AS ratio, CASE WHEN b = 0 THEN 'no_baseline' WHEN c / CAST(b AS DOUBLE) > 1.15 THEN 'failed' ELSE 'passed' END AS gate FROM a")
def regression_gate(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "A").alias("b"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    r = compare.ratio(F.col("c"), F.col("b"))
    return a.select("k", F.round(r, 6).alias("ratio"), F.when(F.col("b") == 0, "no_baseline").when(r > 1.15, "failed").otherwise("passed").alias("gate"))


@query("SELECT DISTINCT l_orderkey AS k, l_linenumber AS j FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 2 = 0")
def masked_frames(spark, sf):
    """Active rows less those that are masked."""
    a = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j")).distinct()
    m = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("j"))
    return a.join(m, ["k", "j"], "left_anti")


def subpixel_search(moving: DataFrame, reference: DataFrame, by: list[str], radius: int, step: float) -> DataFrame:
    """The fractional shift on a grid whose bilinearly sampled overlap correlates best with the reference."""
    side, plane = 2 * radius + 1, whole.plane(reference)
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]

    def score(it):
        ry0, rx0, rh, rw = whole.extent(plane)
        r, here, r_ok = whole.canvas(plane, ry0, rx0, rh, rw)
        at = np.flatnonzero(here)
        ry, rx, r, r_ok = at // max(rw, 1) + ry0, at % max(rw, 1) + rx0, whole.exact(r.ravel()[at]), r_ok.ravel()[at].astype(np.int64)
        for b in it:
            y0, x0, h, w = whole.extent(b.column("pixels"))
            v, there, ok = whole.canvas(b.column("pixels"), y0, x0, h, w)
            pairs, corr = np.zeros((len(v), len(steps)), np.int64), np.full((len(v), len(steps)), np.nan)
            for k, (i, j) in enumerate(steps):
                sy, sx = ry - i * step, rx - j * step
                ky, kx = np.floor(sy), np.floor(sx)
                taps = []
                for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1)):
                    g, y, x = (1 - np.abs(sy - (ky + dy))) * (1 - np.abs(sx - (kx + dx))), ky + dy - y0, kx + dx - x0
                    g = np.where((y >= 0) & (x >= 0) & (y < h) & (x < w), g, 0)
                    taps.append((g, np.where(g > 0, y * w + x, 0).astype(np.int64)))
                use = sum(g for g, _ in taps) > 0.999999  # others can't be whole in any image
                taps, kr, kok = [(g[use], q[use]) for g, q in taps], r[use], r_ok[use]
                if not use.any():
                    continue
                for s in whole.parts(len(v), len(kr)):
                    a, t, o = v[s], there[s], ok[s]
                    full = sum(g * t[:, q] for g, q in taps) > 0.999999
                    c_ok = np.logical_or.reduce([(g > 0) & o[:, q] for g, q in taps]) & full
                    c = sum(g * a[:, q] for g, q in taps)
                    down = np.trunc(c)
                    c = np.where(c_ok, down + np.where(np.abs(c - down) >= 0.5, np.sign(c), 0), 0).astype(np.int64)
                    n, c = full.sum(axis=1), whole.exact(c)
                    m = full.astype(r.dtype)
                    p = whole.pearson(n, c.sum(axis=1), m @ kr, (c * c).sum(axis=1), m @ (kr * kr), c @ kr)
                    pairs[s, k], corr[s, k] = n, np.where(c_ok.astype(np.int64) @ kok > 0, p, np.nan)
            yield whole.added(b.select(by), "scores", whole.scores(pairs, corr))

    found = whole.gather(moving.dropna(subset=by), by)
    k = whole.best(found.mapInArrow(score, whole.fields(found, by) + whole.SCORES), by)
    return k.select(*by, ((F.col("k") % side - radius) * step).alias("dx"), ((F.expr(f"k div {side}") - radius) * step).alias("dy"), "ncc")


@query(f"WITH {IMAGES_SQL}, g AS (SELECT f.frame, y, x, v AS r, i, j, x - j * 0.5 AS sx, y - i * 0.5 AS sy FROM (SELECT DISTINCT frame FROM images) f, (SELECT y, x, v FROM images WHERE frame = 0) r, range(-1, 2) a(i), range(-1, 2) b(j)), t AS (SELECT g.*, CAST(floor(sy) AS INTEGER) + p AS ky, CAST(floor(sx) AS INTEGER) + q AS kx, (1 - abs(sy - (floor(sy) + p))) * (1 - abs(sx - (floor(sx) + q))) AS w FROM g, range(0, 2) c(p), range(0, 2) d(q)), s AS (SELECT t.frame, i, j, t.y, t.x, any_value(r) AS r, CAST(round(sum(w * v)) AS BIGINT) AS c FROM t JOIN images m ON m.frame = t.frame AND m.y = ky AND m.x = kx WHERE w > 0 GROUP BY t.frame, i, j, t.y, t.x HAVING sum(w) > 0.999999), q AS (SELECT frame, i, j, {Q.FIT} FROM s GROUP BY frame, i, j), n AS (SELECT frame, i, j, round((n * sxy - sx * sy) / (sqrt(greatest(n * sxx - sx * sx, 0)) * sqrt(greatest(n * syy - sy * sy, 0))), 9) AS ncc FROM q) SELECT frame, CAST(j * 0.5 AS DOUBLE) AS dx, CAST(i * 0.5 AS DOUBLE) AS dy, round(ncc, 6) AS ncc FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ncc DESC NULLS LAST, i, j) AS k FROM n) WHERE k = 1")
def subpixel_ncc(spark, sf):
    im = whole_images(spark, sf)
    return rounded(subpixel_search(im, im.filter("frame = 0"), ["frame"], 1, 0.5), "ncc")


@query("SELECT CAST((n = 0) AS INTEGER) + CAST((n <> k) AS INTEGER) + CAST((n < 1000000000) AS INTEGER) AS checks_failed, n > 0 AND n = k AND n >= 1000000000 AS passed FROM (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS k FROM orders)")
def acceptance(spark, sf):
    row = table(spark, sf, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("k"))
    c = ledger.checks(row, {"rows": F.col("n") > 0, "unique": F.col("n") == F.col("k"), "at_least": F.col("n") >= 10**9})
    return c.select(F.size("failed_checks").alias("checks_failed"), "passed")
