"""Registration: correlation searches, similarity from moments, voting, mutual neighbours, gates.

Catalogues hold some hundred stars per frame; searches join stars or pixels of one frame pair by its key.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderea.operators import tiles, whole


def ncc_search(images: DataFrame, reference: DataFrame, by: list[str], reach: int) -> DataFrame:
    """The whole shift (dx, dy) within reach whose overlap correlates best with reference (y, x, v); first by dy, dx of equals."""
    plane, side = whole.plane(reference), 2 * reach + 1

    def score(it):
        for b in it:
            y0, x0, h, w = whole.extent(b.column("pixels"))
            c, c_there, c_ok = whole.canvas(b.column("pixels"), y0, x0, h, w)
            # a column for each shift: what of the reference lies under each pixel
            under = [whole.canvas(plane, y0 + dy, x0 + dx, h, w) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
            r, r_there, r_ok = (np.concatenate([u[i] if len(u[i]) else np.zeros((1, h * w), u[i].dtype) for u in under]).T for i in range(3))
            c, kind = whole.exact(c), np.int64 if c.dtype.kind == r.dtype.kind == "i" else np.float64
            whole.exact(r.T)
            c, r = c.astype(kind), r.astype(kind)
            n = c_there.astype(np.int64) @ r_there.astype(np.int64)
            both = c_ok.astype(np.int64) @ r_ok.astype(np.int64)
            p = whole.pearson(n, c @ r_there.astype(kind), c_there.astype(kind) @ r, (c * c) @ r_there.astype(kind), c_there.astype(kind) @ (r * r), c @ r)
            yield whole.added(b.select(by), "scores", whole.scores(n, np.where(both > 0, p, np.nan)))

    found = whole.gather(images, by)
    k = whole.best(found.mapInArrow(score, whole.fields(found, by) + whole.SCORES), by)
    return k.select(*by, (F.col("k") % side - reach).alias("dx"), (F.expr(f"k div {side}").cast("int") - reach).alias("dy"), "ncc")


def similarity(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs (mx, my, rx, ry): a, b, tx, ty of the similarity with least squares, in closed form from exact sums (whole numbers)."""
    s = lambda e: F.sum(e).cast("double")
    mx, my, rx, ry = (F.col(c) for c in ("mx", "my", "rx", "ry"))
    m = pairs.groupBy(*by).agg(F.count("*").cast("double").alias("n"), s(mx).alias("sx"), s(my).alias("sy"), s(rx).alias("ux"), s(ry).alias("uy"), s(mx * mx + my * my).alias("q"), s(mx * rx + my * ry).alias("p"), s(mx * ry - my * rx).alias("c"), s(rx * rx + ry * ry).alias("t"))
    den = F.col("n") * F.col("q") - F.col("sx") * F.col("sx") - F.col("sy") * F.col("sy")
    m = m.withColumn("den", F.when((F.col("n") >= 2) & (den > 0), den))
    m = m.withColumns({"a": (F.col("n") * F.col("p") - F.col("sx") * F.col("ux") - F.col("sy") * F.col("uy")) / F.col("den"), "b": (F.col("n") * F.col("c") - F.col("sx") * F.col("uy") + F.col("sy") * F.col("ux")) / F.col("den")})
    a, b = F.coalesce("a", F.lit(1.0)), F.coalesce("b", F.lit(0.0))
    tx = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("ux") - (a * F.col("sx") - b * F.col("sy"))) / F.col("n"))
    ty = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("uy") - (b * F.col("sx") + a * F.col("sy"))) / F.col("n"))
    # what the pairs are off by: the spread of the targets less what the fit takes of it, all times n
    left = F.col("n") * F.col("t") - F.col("ux") * F.col("ux") - F.col("uy") * F.col("uy") - (F.col("a") * F.col("a") + F.col("b") * F.col("b")) * F.col("den")
    rms = F.when(F.col("a").isNotNull(), F.sqrt(F.greatest(left, F.lit(0.0))) / F.col("n"))
    return m.select(*by, F.col("n").cast("bigint").alias("pairs"), rms.alias("rms"), a.alias("a"), b.alias("b"), tx.alias("tx"), ty.alias("ty"), F.sqrt(a * a + b * b).alias("scale"), F.atan2(b, a).alias("rotation"), F.when(F.col("a").isNull(), "failed").otherwise("ok").alias("status"))


def votes(moving: DataFrame, ref: DataFrame, by: list[str], tolerance: float, reach: float) -> DataFrame:
    """Every offset between a star of moving (by, id, x, y) and one of ref (by, id, x, y), within reach, votes for those within
    tolerance of it; the offset with most votes wins, first by ids. Offsets meet by cell of the tolerance and its neighbours."""
    m, r = moving.select(*by, F.col("id").alias("mi"), F.col("x").alias("mx"), F.col("y").alias("my")), ref.select(*by, F.col("id").alias("ri"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    o = m.join(r, by).select(*by, "mi", "ri", (F.col("rx") - F.col("mx")).alias("dx"), (F.col("ry") - F.col("my")).alias("dy")).filter((F.abs("dx") <= reach) & (F.abs("dy") <= reach))
    side = max(tolerance, 1e-9)
    o = o.withColumns({"cx": F.floor(F.col("dx") / side), "cy": F.floor(F.col("dy") / side)})
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = o.select(*by, F.col("dx").alias("ex"), F.col("dy").alias("ey"), "cx", "cy")
    near = o.withColumn("s", F.explode(around)).select(*by, "mi", "ri", "dx", "dy", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    hit = near.join(other, [*by, "cx", "cy"]).filter((F.col("dx") - F.col("ex")) * (F.col("dx") - F.col("ex")) + (F.col("dy") - F.col("ey")) * (F.col("dy") - F.col("ey")) <= tolerance * tolerance)
    n = hit.groupBy(*by, "mi", "ri", "dx", "dy").agg(F.count("*").alias("votes"))
    w = Window.partitionBy(*by).orderBy(F.desc("votes"), "ri", "mi")
    return n.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(*by, "dx", "dy", "votes")


def mutual_neighbours(moving: DataFrame, ref: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Pairs that are each other's nearest within tolerance (squared distances; first id of equals)."""
    m, r = moving.select(*by, F.col("id").alias("mi"), F.col("x").alias("mx"), F.col("y").alias("my")), ref.select(*by, F.col("id").alias("ri"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    d = m.join(r, by).withColumn("d2", (F.col("mx") - F.col("rx")) * (F.col("mx") - F.col("rx")) + (F.col("my") - F.col("ry")) * (F.col("my") - F.col("ry")))
    a = F.row_number().over(Window.partitionBy(*by, "mi").orderBy("d2", "ri"))
    b = F.row_number().over(Window.partitionBy(*by, "ri").orderBy("d2", "mi"))
    return d.withColumns({"_a": a, "_b": b}).filter((F.col("_a") == 1) & (F.col("_b") == 1) & (F.col("d2") <= tolerance * tolerance)).drop("_a", "_b")


def refined_shift(moving: DataFrame, ref: DataFrame, shifts: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Each group's shift (dx, dy) becomes the mean offset of the pairs that are mutual neighbours under it; rms is their spread about it,
    null without pairs, when the shift stays. Places are whole numbers, so the sums are exact."""
    m = moving.join(shifts.select(*by, "dx", "dy"), by).select(*by, "id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    # offsets beyond the shift
    ex, ey = (F.col("rx") - F.col("mx")), (F.col("ry") - F.col("my"))
    n = F.count("*").cast("double")
    s = mutual_neighbours(m, ref, by, tolerance).groupBy(*by).agg(n.alias("n"), F.sum(ex).cast("double").alias("sx"), F.sum(ey).cast("double").alias("sy"), F.sum(ex * ex + ey * ey).cast("double").alias("ss"))
    mx, my = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    out = shifts.select(*by, "dx", "dy").join(s, by, "left")
    return out.select(*by, (F.col("dx") + F.coalesce(mx, F.lit(0.0))).alias("dx"), (F.col("dy") + F.coalesce(my, F.lit(0.0))).alias("dy"), F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("inliers"), F.when(F.col("n") > 0, F.sqrt(F.greatest(F.col("ss") / F.col("n") - mx * mx - my * my, F.lit(0.0)))).alias("rms"))


def nearest_inliers(moving: DataFrame, ref: DataFrame, solutions: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """solutions (by, a, b, tx, ty): moving stars that fall within tolerance of a star of ref (x, y; one catalogue for all groups), and
    the rms of their nearest distances; several may fall on one star. Stars meet by cell of the tolerance and its neighbours."""
    side = max(tolerance, 1e-9)
    cell = lambda c: F.floor(F.col(c) / side).cast("bigint")
    x, y = F.col("a") * F.col("x") - F.col("b") * F.col("y") + F.col("tx"), F.col("b") * F.col("x") + F.col("a") * F.col("y") + F.col("ty")
    m = moving.join(solutions.select(*by, "a", "b", "tx", "ty"), by).select(*by, "id", x.alias("px"), y.alias("py"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    m = m.withColumns({"_i": cell("px"), "_j": cell("py")})
    r = ref.select(F.col("x").alias("rx"), F.col("y").alias("ry")).distinct().withColumns({"_ci": cell("rx"), "_cj": cell("ry")}).withColumn("s", F.explode(around))
    r = r.select("rx", "ry", (F.col("_ci") + F.col("s.i")).alias("_i"), (F.col("_cj") + F.col("s.j")).alias("_j"))
    d2 = (F.col("px") - F.col("rx")) ** 2 + (F.col("py") - F.col("ry")) ** 2
    near = m.join(r, ["_i", "_j"]).withColumn("d2", d2).filter(F.col("d2") <= tolerance * tolerance).groupBy(*by, "id").agg(F.min("d2").alias("d2"))
    found = near.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg("d2")).alias("rms"))
    return solutions.select(*by).join(found, by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("inliers"), "rms")


def solution_reasons(m: Column, model: Column, status: Column, inliers: Column, rms: Column, min_inliers: int, max_rms: float, needs_stars: Column) -> Column:
    """Why a solution (m: nine numbers by rows) isn't accepted, in order; none if it is."""
    at = lambda i: F.get(m, F.lit(i)).cast("double")
    shaped = F.coalesce(F.size(m) == 9, F.lit(False))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = shaped & ~F.exists(m, lambda x: bad(x.cast("double")))
    affine = whole & model.isin("translation", "similarity", "affine")
    det = at(0) * at(4) - at(1) * at(3)
    tests = [
        (F.coalesce(~status.isin("ok", "reference"), F.lit(True)), F.concat(F.lit("status:"), F.coalesce(status, F.lit("none")))), (~shaped, F.lit("shape")), (shaped & ~whole, F.lit("non_finite")),
        (whole & (F.abs(at(8)) <= 1e-12), F.lit("homogeneous_scale")), (affine & ((F.abs(at(6)) > 1e-6) | (F.abs(at(7)) > 1e-6) | (F.abs(at(8) - 1) > 1.1e-5)), F.lit("projective_row")),
        (affine & (F.abs(det) <= 1e-10), F.lit("singular")), ((status == "ok") & needs_stars & (inliers < min_inliers), F.lit("inliers")), ((status == "ok") & (bad(rms) | (rms > max_rms)), F.lit("rms")),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for test, name in tests]))


def matrix_metrics(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Of [[a, b], [c, d]]: scales, rotation in degrees, determinant."""
    return {"scale_x": F.sqrt(a * a + c * c), "scale_y": F.sqrt(b * b + d * d), "rotation_deg": F.degrees(F.atan2(c, a)), "det": a * d - b * c}


def gate(solutions: DataFrame, min_inliers: int, max_rms: float) -> DataFrame:
    """solutions (a, b, tx, ty, inliers, rms, status) gain reasons and accepted."""
    det = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    bad = [F.when(F.col("status") != "ok", "status"), F.when(det < 1e-12, "singular"), F.when(F.col("inliers") < min_inliers, "inliers"), F.when(F.col("rms").isNull() | (F.col("rms") > max_rms), "rms")]
    d = solutions.withColumn("reasons", F.array_compact(F.array(*bad)))
    return d.withColumn("accepted", F.size("reasons") == 0)


# What follows fits one frame pair at a time, in numpy.


def fit_affine(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    a = np.hstack([m, np.ones((len(m), 1))])
    out = np.eye(3)
    out[:2] = np.linalg.lstsq(a, r, rcond=None)[0].T
    return out


def fit_similarity(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    z, w = m[:, 0] + 1j * m[:, 1], r[:, 0] + 1j * r[:, 1]
    zc = z - z.mean()
    den = (np.abs(zc) ** 2).sum()
    q = (zc.conj() * (w - w.mean())).sum() / den if den > 0 else 1.0 + 0j
    t = w.mean() - q * z.mean()
    return np.array([[q.real, -q.imag, t.real], [q.imag, q.real, t.imag], [0, 0, 1.0]])


def fit_translation(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.eye(3)
    out[:2, 2] = np.median(r - m, axis=0)
    return out


def fit_homography(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    rows = []
    for (x, y), (u, v) in zip(m, r, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else np.eye(3)


FITS = {"translation": (fit_translation, 1), "similarity": (fit_similarity, 2), "affine": (fit_affine, 3), "homography": (fit_homography, 4)}


def moved(points: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    p = np.hstack([points, np.ones((len(points), 1))]) @ matrix.T
    return p[:, :2] / np.where(np.abs(p[:, 2:]) > 1e-12, p[:, 2:], np.nan)


def greedy_pairs(ref: np.ndarray, mov: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """One to one, nearest first."""
    d = np.hypot(ref[:, None, 0] - mov[None, :, 0], ref[:, None, 1] - mov[None, :, 1])
    taken_r, taken_m, out = set(), set(), []
    for k in np.argsort(d, axis=None, kind="stable"):
        i, j = divmod(int(k), d.shape[1])
        if not d[i, j] <= tolerance:
            break
        if i not in taken_r and j not in taken_m:
            taken_r.add(i)
            taken_m.add(j)
            out.append((i, j))
    return out


def sides(p: np.ndarray) -> np.ndarray:
    """Lengths of a triangle's sides, each opposite to the vertex of its place."""
    return np.hypot(*(p[[1, 2, 0]] - p[[2, 0, 1]]).T)


def area(p: np.ndarray) -> float:
    (ux, uy), (vx, vy) = p[1] - p[0], p[2] - p[0]
    return abs(float(ux * vy - uy * vx)) / 2


def triangles(points: np.ndarray, most_points: int = 30, most: int = 600, least_area: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Corners (n, 3) and shapes (n, 2: shorter sides over the longest) of the triangles among the first points, the largest areas first."""
    n = min(len(points), most_points)
    t = np.array(list(itertools.combinations(range(n), 3)), np.int64).reshape(-1, 3)
    p = points[t]
    u, v = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    size = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) / 2
    keep = np.argsort(-size, kind="stable")
    keep = keep[size[keep] >= least_area][:most]
    s = np.sort(np.stack([np.hypot(*(p[keep, i] - p[keep, j]).T) for i, j in ((0, 1), (1, 2), (2, 0))], axis=1), axis=1)
    return t[keep], s[:, :2] / s[:, 2:]


def near_triangles(points: np.ndarray, most_points: int = 80, neighbours: int = 5, most: int = 1200, least_area: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """The same of each point with its nearest (itself among them); shapes are longest over middle and middle over shortest side, and corners stand
    opposite to the shortest, the middle and the longest side."""
    points = points[:most_points]
    if len(points) < 3:
        return np.zeros((0, 3), np.int64), np.zeros((0, 2))
    far = np.hypot(points[:, None, 0] - points[None, :, 0], points[:, None, 1] - points[None, :, 1])
    near = np.argsort(far, axis=1, kind="stable")[:, : max(3, neighbours)]
    found = []
    for t in dict.fromkeys(tuple(sorted(c)) for row in near.tolist() for c in itertools.combinations(row, 3)):
        p = points[list(t)]
        if (size := area(p)) >= least_area:
            s = sides(p)
            o = np.argsort(s, kind="stable")
            found.append((-size, [t[i] for i in o], (s[o[2]] / s[o[1]], s[o[1]] / s[o[0]])))
    found.sort(key=lambda x: x[0])
    return np.array([t for _, t, _ in found[:most]], np.int64).reshape(-1, 3), np.array([s for *_, s in found[:most]]).reshape(-1, 2)


def most_pairs(ref: np.ndarray, mov: np.ndarray, matrices: np.ndarray, tolerance: float) -> np.ndarray:
    """For each matrix how many pairs within tolerance there can be: the fewer of the stars on either side that have any."""
    out = np.zeros(len(matrices), np.int64)
    for at in range(0, len(matrices), 64):
        m = matrices[at : at + 64]
        p = np.einsum("hij,mj->hmi", m, np.hstack([mov, np.ones((len(mov), 1))]))
        with np.errstate(divide="ignore", invalid="ignore"):
            q = p[:, :, :2] / np.where(np.abs(p[:, :, 2:]) > 1e-12, p[:, :, 2:], np.nan)
        close = np.hypot(q[:, :, None, 0] - ref[None, None, :, 0], q[:, :, None, 1] - ref[None, None, :, 1]) <= tolerance
        out[at : at + 64] = np.minimum(close.any(axis=2).sum(axis=1), close.any(axis=1).sum(axis=1))
    return out


def scored(ref: np.ndarray, mov: np.ndarray, matrix: np.ndarray, tolerance: float) -> tuple[list[tuple[int, int]], float]:
    pairs = greedy_pairs(ref, moved(mov, matrix), tolerance)
    if not pairs:
        return pairs, math.inf
    off = moved(mov[[j for _, j in pairs]], matrix) - ref[[i for i, _ in pairs]]
    return pairs, float(np.sqrt((off**2).sum(axis=1).mean()))


def best_of(ref: np.ndarray, mov: np.ndarray, hypotheses: list[np.ndarray], model: str, tolerance: float, refits: int) -> tuple[np.ndarray, int, float]:
    """The hypothesis with most one-to-one pairs, then least rms, the first of equals; then fitted anew to its pairs, as long as that is no worse."""
    fit, least = FITS[model]
    best: tuple[np.ndarray, list[tuple[int, int]], float] = (np.eye(3), [], math.inf)
    if hypotheses:
        bound = most_pairs(ref, mov, np.array(hypotheses), tolerance)
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < max(len(best[1]), 1):
                break
            pairs, rms = scored(ref, mov, hypotheses[k], tolerance)
            if (len(pairs), -rms) > (len(best[1]), -best[2]):
                best = (hypotheses[k], pairs, rms)
    for _ in range(refits):
        if len(best[1]) < least:
            break
        h = fit(mov[[j for _, j in best[1]]], ref[[i for i, _ in best[1]]])
        pairs, rms = scored(ref, mov, h, tolerance)
        if (len(pairs), -rms) < (len(best[1]), -best[2]):
            break
        best = (h, pairs, rms)
    return best[0], len(best[1]), best[2]


@functools.lru_cache(maxsize=4)
def _triangles(reference: bytes) -> tuple[np.ndarray, np.ndarray]:
    """triangles of a reference that many frames are held against."""
    return triangles(np.frombuffer(reference, float).reshape(-1, 2))


def solve(ref: np.ndarray, mov: np.ndarray, model: str = "similarity", tolerance: float = 3.0, descriptor: float = 0.025, most: int = 600) -> tuple[np.ndarray, int, float]:
    """Hypotheses: whole offsets between the 35 brightest of either side, and for other models fits to triangles of like shape, corners in
    all six orders, `most` at most."""
    fit, least = FITS[model]
    offsets = (ref[:35, None] - mov[None, :35]).reshape(-1, 2)
    hypotheses = list(np.tile(np.eye(3), (len(offsets), 1, 1)))
    for h, off in zip(hypotheses, offsets, strict=True):
        h[:2, 2] = off
    if model != "translation":
        by_corners, count = (fit if least <= 3 else fit_similarity), 0
        (tr, sr), (tm, sm) = _triangles(np.ascontiguousarray(ref, float).tobytes()), triangles(mov)
        for corners, shape in zip(tm, sm, strict=True):
            if count >= most:
                break
            for k in np.flatnonzero(np.hypot(*(sr - shape).T) <= descriptor).tolist():
                hypotheses += [by_corners(mov[corners], ref[tr[k][list(o)]]) for o in itertools.permutations(range(3))]
                count += 6
                if count >= most:
                    break
    return best_of(ref, mov, hypotheses, model, tolerance, 2)


def solve_asterisms(ref: np.ndarray, mov: np.ndarray, model: str = "similarity", tolerance: float = 3.0, radius: float = 0.1, most: int = 1500) -> tuple[np.ndarray, int, float]:
    """Hypotheses from triangles of near stars whose shapes lie within radius, the `most` nearest shapes, each with its first two corners either
    way round; three refits."""
    fit = FITS[model][0]
    (tr, sr), (tm, sm) = near_triangles(ref), near_triangles(mov)
    if not len(tr) or not len(tm):
        return np.eye(3), 0, math.inf
    far = np.hypot(sm[:, None, 0] - sr[None, :, 0], sm[:, None, 1] - sr[None, :, 1])
    order = np.argsort(far, axis=None, kind="stable")[:most]
    hypotheses = []
    for k in order[far.flat[order] <= radius].tolist():
        m, r = tm[k // len(tr)], tr[k % len(tr)]
        hypotheses += [fit(mov[m], ref[r]), fit(mov[m], ref[r[[1, 0, 2]]])]
    return best_of(ref, mov, hypotheses, model, tolerance, 3)


SOLVERS = {"triangles": solve, "asterisms": solve_asterisms}


def register(stars: DataFrame, reference: DataFrame, model: str = "similarity", tolerance: float = 3.0, min_inliers: int = 6, solver: str = "triangles") -> DataFrame:
    """stars (frame, x, y, flux) against reference (x, y, flux), which is one frame's catalogue: a matrix for each frame."""
    ref = reference.orderBy(F.desc("flux"), "y", "x").limit(80).select("x", "y").toPandas().to_numpy(float)  # one frame's brightest

    def run(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        x, y, flux = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "flux"))
        found = []
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
            s = slice(first, end)
            mov = np.stack([x[s], y[s]], axis=1)[np.lexsort((x[s], y[s], -flux[s]))[:80]]
            h, n, rms = SOLVERS[solver](ref, mov, model, tolerance) if len(ref) else (np.eye(3), 0, math.inf)
            found.append((h.tolist(), n, rms if n else None, "ok" if n >= min_inliers else "failed"))
        kinds = (pa.list_(pa.list_(pa.float64())), pa.int32(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([b.column("frame").take(pa.array(starts)).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]], names=["frame", "matrix", "inliers", "rms", "status"])

    return tiles.whole_groups(stars.select("frame", "x", "y", "flux"), ["frame"], 80, run, "frame long, matrix array<array<double>>, inliers int, rms double, status string")


def phase_correlation(images: DataFrame, reference: DataFrame, height: int, width: int) -> DataFrame:
    """The shift at the peak of the normalised cross-power spectrum, signed. The reference image comes to the driver as Arrow."""
    ref, got = np.zeros((height, width)), reference.select("y", "x", "v").toArrow()
    ref[got["y"].to_numpy(), got["x"].to_numpy()] = got["v"].to_numpy()

    def one(p: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((height, width))
        a[p["y"], p["x"]] = p["v"]
        c = np.fft.fft2(ref - ref.mean()) * np.conj(np.fft.fft2(a - a.mean()))
        peak = np.real(np.fft.ifft2(c / np.maximum(np.abs(c), 1e-12)))
        y, x = np.unravel_index(int(np.argmax(np.round(peak, 9))), peak.shape)
        return pd.DataFrame({"frame": [p["frame"].iloc[0]], "dx": [int(x - width if x > width // 2 else x)], "dy": [int(y - height if y > height // 2 else y)]})

    return images.select("frame", "y", "x", "v").groupBy("frame").applyInPandas(one, "frame long, dx int, dy int")
