"""Searches over whole images: no candidate travels, and images with gaps and nulls give what a plain loop gives."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siderea.operators import register, replay
from siderea.plans import queries as Q
from siderea.plans import contracts, verify  # noqa: F401


def exchanged(df):
    """What each shuffle of the plan is dealt by."""
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def odd(spark):
    """Three images of 5 x 6 with gaps and nulls, and a reference."""
    rnd = np.random.default_rng(5)
    rows = [(f, y, x, None if rnd.random() < 0.1 else int(rnd.integers(-500, 500))) for f in range(3) for y in range(5) for x in range(6) if rnd.random() < 0.9]
    ref = [(y, x, int(rnd.integers(-500, 500))) for y in range(5) for x in range(6) if rnd.random() < 0.9]
    return rows, ref, spark.createDataFrame(rows, "frame long, y int, x int, v long"), spark.createDataFrame(ref, "y int, x int, v long")


def sampled(image, sy, sx, height=99, width=99):
    """(weight, value) of the pixels that are there; value is None if none has one."""
    taps = [(min(math.floor(sy) + a, height - 1), min(math.floor(sx) + b, width - 1), (1 - abs(sy - math.floor(sy) - a)) * (1 - abs(sx - math.floor(sx) - b))) for a in (0, 1) for b in (0, 1)]
    taps = [(g, image[y, x]) for y, x, g in taps if g > 0 and (y, x) in image]
    some = [g * v for g, v in taps if v is not None]
    return sum(g for g, _ in taps), (sum(some) if some else None), bool(taps)


def plain_best(pairs):
    """The first key of the highest correlation to nine digits; pairs by key, in order."""
    best = None
    for key, p in pairs.items():
        c, r = (np.array([q[i] for q in p], float) for i in (0, 1))
        n = len(p)
        below = math.sqrt(max(n * (c * c).sum() - c.sum() ** 2, 0)) * math.sqrt(max(n * (r * r).sum() - r.sum() ** 2, 0))
        ncc = round((n * (c * r).sum() - c.sum() * r.sum()) / below, 9) if below else -math.inf
        if best is None or ncc > best[1]:
            best = (key, ncc)
    return best


def test_refinement_sends_no_candidates(spark, sf):
    assert not any("dx" in keys or "rx" in keys for keys in exchanged(Q.QUERIES["matrix_refinement"](spark, sf)))


def test_refinement_with_gaps(odd, spark):
    rows, ref, images, reference = odd
    m = spark.createDataFrame([(f, s, 1, 1.0, 0.1, 0.5 * s, -0.1, 1.0, 0.25) for f in range(3) for s in (0, 1)], "frame long, seed int, filt int, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double")
    got = {(r.frame, r.seed): r for r in replay.refine(images, reference.withColumn("filt", F.lit(1)), m, ["frame", "seed"], ["filt"], 6, 5, 1.0, 0.5, 0.25, 0.25, 2, 1).collect()}
    for f in range(3):
        im = {(y, x): v for k, y, x, v in rows if k == f}
        for s in (0, 1):

            def best(offsets, stride, s=s, im=im):
                out = []
                for dx, dy in offsets:
                    n, pairs = 0, []
                    for y, x, r in ref:
                        u, w = x - 0.5 * s - dx, y - 0.25 - dy
                        sx, sy = (u - 0.1 * w) / 1.01, (w + 0.1 * u) / 1.01
                        if y % stride or x % stride or not (0 <= sx <= 5 and 0 <= sy <= 4):
                            continue
                        _, c, met = sampled(im, sy, sx, 5, 6)
                        n += met
                        pairs += [(c, r)] if c is not None else []
                    if n:
                        out.append((round(math.sqrt(sum((c - r) ** 2 for c, r in pairs) / len(pairs)), 3) if pairs else math.inf, dx, dy, n))
                return min(out)

            one = best([(i * 0.5, j * 0.5) for i in range(-2, 3) for j in range(-2, 3)], 2)
            two = best([(one[1] + i * 0.25, one[2] + j * 0.25) for i in (-1, 0, 1) for j in (-1, 0, 1)], 1)
            r = got[f, s]
            assert (r.dx, r.dy, r.pixels) == two[1:] and r.rms == pytest.approx(two[0], abs=2e-3)


def test_subpixel_search_sends_nothing(spark, sf):
    assert exchanged(Q.QUERIES["subpixel_ncc"](spark, sf)) == []


def test_subpixel_search_with_gaps(odd):
    rows, ref, images, reference = odd
    got = {r.frame: r for r in contracts.subpixel_search(images.filter("v is not null"), reference, ["frame"], 1, 0.5).collect()}
    for f in range(3):
        im, pairs = {(y, x): v for k, y, x, v in rows if k == f and v is not None}, {}
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                for y, x, r in ref:
                    w, c, _ = sampled(im, y - i * 0.5, x - j * 0.5)
                    if w > 0.999999:
                        pairs.setdefault((j * 0.5, i * 0.5), []).append((math.copysign(math.floor(abs(c) + 0.5), c), r))
        key, ncc = plain_best(pairs)
        assert (got[f].dx, got[f].dy) == key and got[f].ncc == pytest.approx(ncc, abs=1e-8)


def test_shift_search_sends_nothing(spark, sf):
    assert exchanged(Q.QUERIES["ncc_shift_search"](spark, sf)) == []


def test_shift_search_with_gaps(odd):
    rows, ref, images, reference = odd
    at = {(y, x): v for y, x, v in ref}
    got = {r.frame: r for r in register.ncc_search(images.filter("v is not null"), reference, ["frame"], 2).collect()}
    for f in range(3):
        pairs = {(dx, dy): [(v, at[y + dy, x + dx]) for k, y, x, v in rows if k == f and v is not None and (y + dy, x + dx) in at] for dy in range(-2, 3) for dx in range(-2, 3)}
        key, ncc = plain_best({k: p for k, p in pairs.items() if p})
        assert (got[f].dx, got[f].dy) == key and got[f].ncc == pytest.approx(ncc, abs=1e-8)
