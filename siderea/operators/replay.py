"""Replaying a stack: what each frame did to each tile, what its maps say, and what other weights would have made of it.

A replay shuffles on the pixel, as a stack does; what follows are partial aggregates by tile and frame.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderea.operators import whole
from siderea.operators.compare import ratio
from siderea.operators.stack import dealt, usable_weight


def two_pass(samples: DataFrame, px: list[str], method: str, low: float, high: float) -> DataFrame:
    """samples (px, v, w) gain ok, keep, low and high. Bounds lie around mean and population deviation; winsorized_sigma takes them again
    from the values clipped to the first ones. There is no guard."""
    w, v = Window.partitionBy(*px), F.col("v").cast("double")
    d = samples.withColumn("ok", v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (usable_weight(F.col("w")) > 0))
    if method == "none":
        return d.withColumns({"keep": F.col("ok"), "low": F.lit(False), "high": F.lit(False)})
    if method not in ("sigma_clip", "winsorized_sigma"):
        raise ValueError(f"no such rejection: {method}")

    def bounded(d: DataFrame, c: Column) -> DataFrame:
        mean, std = F.avg(c).over(w), F.stddev_pop(c).over(w)
        return d.withColumns({"_from": mean - low * std, "_to": mean + high * std})

    d = bounded(dealt(d, px).withColumn("_x", F.when(F.col("ok"), v)), F.col("_x"))
    if method == "winsorized_sigma":
        d = d.withColumn("_clipped", F.when(F.col("ok"), F.greatest(F.least("_x", "_to"), "_from")))
        d = bounded(d, F.col("_clipped")).drop("_clipped")
    d = d.withColumns({"low": F.coalesce(F.col("_x") < F.col("_from"), F.lit(False)), "high": F.coalesce(F.col("_x") > F.col("_to"), F.lit(False))})
    return d.withColumn("keep", F.col("ok") & ~F.col("low") & ~F.col("high")).drop("_x", "_from", "_to")


def frame_contribution(d: DataFrame, px: list[str], tile: list[str], frame: str) -> DataFrame:
    """d as two_pass leaves it, with tile and frame: by tile and frame the samples kept and rejected, the mean weighted difference to the
    master, and the frame's share in the tile's master, averaged over all pixels of the tile."""
    w, keep, g = Window.partitionBy(*px), F.col("keep"), usable_weight(F.col("w"))
    total = F.sum(F.when(keep, g).otherwise(0)).over(w).cast("double")
    master = F.coalesce(F.try_divide(F.sum(F.when(keep, F.col("v") * g)).over(w).cast("double"), total), F.lit(0.0))
    d = d.withColumns({"_g": g.cast("double"), "_total": total, "_master": master})
    delta = F.when(keep, (F.col("v") - F.col("_master")) * F.col("_g"))
    d = d.withColumns({"_delta": delta, "_share": F.try_divide(delta, F.col("_total"))})
    by = d.groupBy(*tile, frame).agg(
        F.count_if("ok").alias("valid"), F.count_if("keep").alias("accepted"), F.count_if("low").alias("low"), F.count_if("high").alias("high"),
        F.avg("_delta").alias("weighted_delta"), F.coalesce(F.sum("_share"), F.lit(0.0)).alias("_sum"),
    )
    # pixels are counted apart: a mark on a pixel's first sample would sort all samples again, and a window by tile would hold a tile's frames in one task
    pixels = d.select(*tile, *px).distinct().groupBy(*[F.col(c).alias(f"_{c}") for c in tile]).agg(F.count("*").alias("_px"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in tile])
    return by.join(pixels, same).withColumn("contribution", ratio(F.col("_sum"), F.col("_px"))).drop("_sum", "_px", *[f"_{c}" for c in tile])


def families(frames: DataFrame, by: list[str], order: list[str], before: int = 5, after: int = 5) -> DataFrame:
    """frames (by, order, weight, focus) gain family: focus; control for frames with a weight among those just before the first and just
    after the last of the focus; null."""
    w = Window.partitionBy(*by)
    at = F.row_number().over(w.orderBy(*order))
    d = frames.withColumn("_at", at)
    d = d.withColumns({"_from": F.min(F.when(F.col("focus"), F.col("_at"))).over(w), "_to": F.max(F.when(F.col("focus"), F.col("_at"))).over(w)})
    near = (F.col("_at").between(F.col("_from") - before, F.col("_from") - 1)) | (F.col("_at").between(F.col("_to") + 1, F.col("_to") + after))
    family = F.when(F.col("focus"), "focus").when(near & F.coalesce(F.col("weight") != 0, F.lit(False)), "control")
    return d.withColumn("family", family).drop("_at", "_from", "_to")


def contrast(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """rows (by, family, values): frames in each family, means of each value, and focus less control."""
    mean = lambda c, f: F.avg(F.when(F.col("family") == f, F.col(c).cast("double")))
    out = rows.groupBy(*by).agg(
        F.count_if(F.col("family") == "focus").alias("focus_frames"), F.count_if(F.col("family") == "control").alias("control_frames"),
        *[mean(c, f).alias(f"{c}_{f}") for c in values for f in ("focus", "control")],
    )
    return out.withColumns({f"{c}_delta": F.col(f"{c}_focus") - F.col(f"{c}_control") for c in values})


def map_attribution(pixels: DataFrame, tile: list[str], edge_bit: int = 64) -> DataFrame:
    """pixels (tile, coverage, n_low, n_high, dq): shares of rejected and kept samples by tile, and what to look at; names are fixed values."""
    rejected, before = F.col("n_low") + F.col("n_high"), F.col("coverage") + F.col("n_low") + F.col("n_high")
    t = pixels.groupBy(*tile).agg(
        F.count("*").alias("pixels"), F.sum(rejected).alias("_r"), F.sum(before).alias("_b"), F.sum("coverage").alias("_c"),
        F.count_if(F.col("dq").bitwiseAND(edge_bit) != 0).alias("edge_pixels"), F.min("coverage").alias("least"), F.max("coverage").alias("most"),
    )
    t = t.withColumns({"rejected_fraction": F.when(F.col("_b") != 0, ratio(F.col("_r"), F.col("_b"))), "kept_fraction": F.when(F.col("_b") != 0, ratio(F.col("_c"), F.col("_b")))})
    status = (
        F.when(F.col("rejected_fraction") >= 0.05, "rejection_heavy_tile").when(F.col("edge_pixels") > F.col("pixels") * 0.25, "warp_edge_heavy_tile")
        .when(F.col("most") - F.col("least") >= 2, "coverage_variable_tile").otherwise("map_summary_not_explanatory")
    )
    return t.withColumn("status", status).drop("_r", "_b", "_c")


def tile_pack(pairs: DataFrame, tiles: DataFrame, by: list[str], pad: int, height: int, width: int) -> DataFrame:
    """Statistics of c, r and c - r over each tile (by, tile, y0, y1, x0, x1), padded within the image. Tiles meet pixels by pixel."""
    ys = F.sequence(F.greatest(F.lit(0), F.col("y0") - pad), F.least(F.lit(height), F.col("y1") + pad) - 1)
    xs = F.sequence(F.greatest(F.lit(0), F.col("x0") - pad), F.least(F.lit(width), F.col("x1") + pad) - 1)
    inside = tiles.select(*by, "tile", F.explode(ys).alias("y"), xs.alias("xs")).select(*by, "tile", "y", F.explode("xs").alias("x"))
    d = pairs.join(inside, [*by, "y", "x"]).select(*by, "tile", F.explode(F.array(*[F.struct(F.lit(n).alias("plane"), e.cast("double").alias("v")) for n, e in (("candidate", F.col("c")), ("reference", F.col("r")), ("difference", F.col("c") - F.col("r")))])).alias("p"))
    v = F.when(~F.isnan("p.v") & (F.abs("p.v") < float("inf")), F.col("p.v"))
    p = F.percentile(v, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = d.groupBy(*by, "tile", F.col("p.plane").alias("plane")).agg(F.count(v).alias("n"), F.min(v).alias("least"), p.alias("_p"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"))
    return out.withColumns({f"p{n}": F.col("_p")[i] for i, n in enumerate((50, 90, 99))}).drop("_p")


def residual_sources(tiles: DataFrame, min_coverage: float = 0.95, excess: float = 0.01) -> DataFrame:
    """tiles (coverage, frames, high_map, low_map, focus_high, control_high) gain the share of frames that cover them and two flags."""
    share = F.when(F.col("frames") > 0, ratio(F.col("coverage"), F.col("frames")))
    d = tiles.withColumns({"coverage_fraction": share, "high_minus_low": F.col("high_map") - F.col("low_map"), "high_delta": F.col("focus_high") - F.col("control_high")})
    return d.withColumns({"coverage_low": F.coalesce(F.col("coverage_fraction") < min_coverage, F.lit(False)), "high_excess": F.coalesce(F.col("high_delta") > excess, F.lit(False))})


def residual_verdict(tiles: DataFrame, by: list[str]) -> DataFrame:
    """residual_sources' rows with before and reduction (of the best family, null without): the share explained and what follows."""
    s = tiles.groupBy(*by).agg(F.count("*").alias("tiles"), F.count_if("coverage_low").alias("coverage_low"), F.count_if("high_excess").alias("high_excess"), F.sum("before").alias("_b"), F.sum("reduction").alias("_r"))
    s = s.withColumn("explained", F.when(F.col("_b") > 0, ratio(F.col("_r"), F.col("_b"))))
    many = F.col("high_excess") >= F.greatest(F.lit(1), F.expr("tiles div 2"))
    name = (
        F.when(F.col("coverage_low") > 0, "inspect_coverage_or_valid_masks").when(many & (F.col("explained").isNull() | (F.col("explained") < 0.05)), "prioritize_rejection_registration_diagnostics")
        .when(F.col("explained") >= 0.05, "bounded_frame_family_apply_candidate").otherwise("continue_residual_source_search")
    )
    return s.withColumn("recommendation", name).drop("_b", "_r")


def policy_sweep(decisions: DataFrame, by: list[str]) -> DataFrame:
    """decisions (by, path, accepted, score): how many were accepted, the best (accepted first, then by score, then by path), what follows."""
    best = F.min_by("path", F.struct(~F.col("accepted"), -F.coalesce("score", F.lit(0.0)), F.col("path")))
    s = decisions.groupBy(*by).agg(F.count("*").alias("decisions"), F.count_if("accepted").alias("accepted"), best.alias("top"))
    any_ = F.col("accepted") > 0
    return s.withColumns({"status": F.when(any_, "accepted_candidate_available").otherwise("no_accepted_candidate"), "recommendation": F.when(any_, "run_broader_measured_sweep").otherwise("hold_tile_local_policy")})


def apply_policy(samples: DataFrame, policy: DataFrame, px: list[str], tile: str) -> DataFrame:
    """Masters before and after: samples (px, tile, v, w, target) of target frames weigh multiplier times as much in the tiles of policy
    (tile, multiplier), one row a tile."""
    d = samples.join(policy.select(tile, "multiplier"), tile, "left")
    g = usable_weight(F.col("w")).cast("double")
    after = g * F.when(F.col("target"), F.coalesce("multiplier", F.lit(1.0))).otherwise(1.0)
    d = d.filter("v is not null").withColumns({"_b": g, "_a": after})
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col("v") * F.col(c)), F.sum(c)), F.lit(0.0))
    out = d.groupBy(*px, tile).agg(mean("_b").alias("before"), mean("_a").alias("after"), F.sum("_a").alias("weight_after"))
    return out.withColumn("change", F.col("after") - F.col("before"))


def matrix_delta(a: list[Column], b: list[Column]) -> dict[str, Column]:
    """Two matrices of two rows (m00 m01 m02 m10 m11 m12): how far b's shift lies from a's, and the norm of all differences."""
    d = [y - x for x, y in zip(a, b, strict=True)]
    square = lambda cs: sum((c * c for c in cs[1:]), cs[0] * cs[0])
    return {"dx": d[2], "dy": d[5], "shift": F.sqrt(square([d[2], d[5]])), "norm": F.sqrt(square(d))}


def input_delta(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs (c, r, cc, rc): differences of values where both are there, and of coverage (cc, rc) everywhere."""
    d = F.col("c").cast("double") - F.col("r").cast("double")
    d = F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)
    k = F.coalesce(F.col("cc"), F.lit(0)) - F.coalesce(F.col("rc"), F.lit(0))
    return pairs.groupBy(*by).agg(
        F.count(d).alias("pixels"), F.sqrt(F.avg(d * d)).alias("rms"), F.avg(F.abs(d)).alias("mean_abs"), F.percentile(F.abs(d), F.lit(0.99)).alias("p99_abs"), F.max(F.abs(d)).alias("max_abs"),
        F.avg(d).alias("signed_mean"), F.sum(k).alias("coverage_delta"), F.sum(F.abs(k)).alias("coverage_abs_delta"), F.count_if(k != 0).alias("coverage_pixels"),
    )


def precision(pixels: DataFrame, by: list[str], flat_floor: float = 1e-6) -> DataFrame:
    """pixels (by, light, bias, dark, flat, scale), whole numbers but for scale and flat: a calibration in single against double precision."""

    def calibrated(kind: str) -> Column:
        light, bias, dark, flat, scale = (F.col(c).cast(kind) for c in ("light", "bias", "dark", "flat", "scale"))
        net = ((light - (dark * scale).cast(kind)).cast(kind) - bias).cast(kind)
        return (net / F.greatest(flat, F.lit(flat_floor).cast(kind))).cast(kind).cast("double")

    d = pixels.withColumns({"_s": calibrated("float"), "_d": calibrated("double")}).withColumn("_e", F.col("_s") - F.col("_d"))
    rmse, size = F.sqrt(F.avg(F.col("_e") * F.col("_e"))), F.sqrt(F.avg(F.col("_d") * F.col("_d")))
    out = d.groupBy(*by).agg(F.count("_e").alias("pixels"), F.max(F.abs("_e")).alias("max_abs"), F.avg(F.abs("_e")).alias("mean_abs"), rmse.alias("rmse"), size.alias("reference_rms"))
    return out.withColumn("relative_rmse", F.when(F.col("reference_rms") > 0, F.col("rmse") / F.col("reference_rms")).otherwise(0.0))


def _grid(at: Column, radius: float, step: float) -> Column:
    n = int((radius + step * 0.5 - -radius) / step + 1e-9) + 1
    return F.array(*[at - radius + i * step for i in range(n)])


def _scored(rows: DataFrame, gx: Column, gy: Column, stride: int, width: int, height: int) -> DataFrame:
    """rows (MATRIX, pixels, _reference) gain _best: the best offset (dx, dy), by least rms, then highest correlation, then first in order; null
    where no candidate meets a pixel. Each candidate reads four pixels of its frame for a pixel of the reference."""

    def score(it):
        for b in it:
            m = [b.column(c).to_numpy(zero_copy_only=False)[:, None, None] for c in MATRIX]
            gx, gy = (np.stack(b.column(c).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, 0)) for c in ("_gx", "_gy"))
            dx, dy = np.repeat(gx, gy.shape[1], axis=1), np.tile(gy, (1, gx.shape[1]))
            y0, x0, h, w = whole.extent(b.column("_reference"))
            r, here, r_ok = whole.canvas(b.column("_reference"), y0, x0, h, w)
            on = np.flatnonzero(here.any(axis=0))
            ry, rx = on // max(w, 1) + y0, on % max(w, 1) + x0
            sampled = (ry % stride == 0) & (rx % stride == 0)
            on, ry, rx = on[sampled], ry[sampled], rx[sampled]
            r, here, r_ok = (a[:, on] for a in (r.astype(float), here, r_ok))
            v, there, ok = whole.canvas(b.column("pixels"), 0, 0, height, width)
            # a pixel that isn't there weighs nothing; the last place of an image stands for those outside
            v, there, ok = (np.pad(a, ((0, 0), (0, 1))) for a in (v.astype(float), there, ok))
            gaps = not (there[:, :-1].all() and ok[:, :-1].all())
            n, rms, ncc = np.zeros(dx.shape, np.int64), np.full(dx.shape, np.nan), np.full(dx.shape, np.nan)
            for s in whole.parts(len(v), dx.shape[1] * len(on)):
                m00, m01, m02, m10, m11, m12 = (a[s] for a in m)
                with np.errstate(divide="ignore", invalid="ignore"):
                    u, t = rx - m02 - dx[s, :, None], ry - m12 - dy[s, :, None]
                    det = m00 * m11 - m01 * m10
                    sx, sy = (m11 * u - m01 * t) / det, (m00 * t - m10 * u) / det
                    inside = (np.abs(det) > 1e-12) & here[s, None, :] & (sx >= 0) & (sx <= width - 1) & (sy >= 0) & (sy <= height - 1)
                sx, sy = np.where(inside, sx, 0), np.where(inside, sy, 0)
                kx, ky = np.floor(sx), np.floor(sy)
                fx, fy = sx - kx, sy - ky
                base = (np.arange(len(u)) * v.shape[1])[:, None, None]
                c, any_, any_ok = np.zeros(sx.shape), inside if not gaps else np.zeros(sx.shape, bool), inside if not gaps else np.zeros(sx.shape, bool)
                for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
                    g = (1 - np.abs(fy - i)) * (1 - np.abs(fx - j))
                    at = base + (np.minimum(ky + i, height - 1) * width + np.minimum(kx + j, width - 1)).astype(np.int64)
                    c += np.where(g > 0, g * v[s].reshape(-1)[at], 0)
                    if gaps:
                        any_, any_ok = any_ | (inside & (g > 0) & there[s].reshape(-1)[at]), any_ok | (inside & (g > 0) & ok[s].reshape(-1)[at])
                both = any_ok & r_ok[s, None, :]
                n[s] = any_.sum(axis=2)
                q, rr = both.sum(axis=2), np.broadcast_to(r[s, None, :], c.shape)
                with np.errstate(divide="ignore", invalid="ignore"):
                    rms[s] = np.sqrt((np.where(both, c - rr, 0) ** 2).sum(axis=2) / q)
                    dc, dr = (np.where(both, a - np.where(both, a, 0).sum(axis=2, keepdims=True) / q[:, :, None], 0) for a in (c, rr))
                    p = (dc * dr).sum(axis=2) / np.sqrt((dc * dc).sum(axis=2) * (dr * dr).sum(axis=2))
                    level = np.logical_or.reduce([np.where(both, a, -np.inf).max(axis=2) == np.where(both, a, np.inf).min(axis=2) for a in (c, rr)]) if len(on) else True
                ncc[s] = np.where(level, np.nan, p)
            kept = n > 0
            number = lambda a: pa.array(a[kept], mask=np.isnan(a[kept]))
            ends = pa.array(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32))
            yield whole.added(b, "_scores", pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(dx[kept]), pa.array(dy[kept]), pa.array(n[kept]), number(rms), number(ncc)], names=["dx", "dy", "pixels", "rms", "ncc"])))

    rows = rows.withColumns({"_gx": gx, "_gy": gy})
    scored = rows.mapInArrow(score, whole.fields(rows, rows.columns) + "_scores array<struct<dx: double, dy: double, pixels: bigint, rms: double, ncc: double>>")

    def order(s: Column) -> Column:
        rms, ncc = F.round(s["rms"], 3), F.round(s["ncc"], 6)
        return F.struct(rms.isNull().alias("a"), rms.alias("rms"), ncc.isNull().alias("b"), (-ncc).alias("c"), s["dx"].alias("dx"), s["dy"].alias("dy"), s["pixels"].alias("pixels"), ncc.alias("ncc"))

    return scored.withColumn("_best", F.array_min(F.transform("_scores", order))).drop("_scores", "_gx", "_gy")


#: Columns of a matrix from a frame to its reference.
MATRIX = ("m00", "m01", "m02", "m10", "m11", "m12")


def refine(images: DataFrame, reference: DataFrame, matrices: DataFrame, by: list[str], ref: list[str], width: int, height: int, radius: float = 1.0, coarse: float = 0.25, fine_radius: float = 0.25, fine: float = 0.0625, coarse_stride: int = 4, final_stride: int = 1) -> DataFrame:
    """Corrections of the shifts of matrices (by, ref, MATRIX), several seeds to a frame if `by` names them: a coarse grid on sampled pixels,
    then a fine one around its best. images (those of by that they have, y, x, v) against reference (ref, y, x, v); rms rounded to 3 digits, so that equals are equal."""
    own = [c for c in by if c in images.columns]
    m = matrices.select(*by, *ref, *[F.col(c).cast("double").alias(c) for c in MATRIX])
    at = whole.gather(reference, ref).select(*ref, F.col("pixels").alias("_reference"))
    rows = whole.gather(images, own).join(m, own).join(F.broadcast(at), ref).drop(*[c for c in ref if c not in by])  # one image for each key of ref
    zero = F.lit(0.0)
    rows = _scored(rows, _grid(zero, radius, coarse), _grid(zero, radius, coarse), coarse_stride, width, height)
    if fine_radius > 0:
        rows = rows.filter("_best is not null").select(*by, *MATRIX, "pixels", "_reference", F.col("_best.dx").alias("_x"), F.col("_best.dy").alias("_y"))
        rows = _scored(rows, _grid(F.col("_x"), fine_radius, fine), _grid(F.col("_y"), fine_radius, fine), final_stride, width, height)
    return rows.filter("_best is not null").select(*by, *[F.col(f"_best.{c}").alias(c) for c in ("dx", "dy", "pixels", "rms", "ncc")])


def to_source_pixels(matrix: list[Column], scale: Column) -> list[Column]:
    """A matrix found on images shrunk by scale: only its shift grows."""
    return [m * scale if i in (2, 5) else m for i, m in enumerate(matrix)]
