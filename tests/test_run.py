"""Files to master, with known shifts; tiles against pixels."""

import numpy as np
import pytest

from siderea.model import Rejection
from siderea.operators import tiles
from siderea.plans import run
from siderea.sources import fits, synthetic, xisf


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("frames")
    for i, kind, dx, dy in synthetic.truth(6):
        a = synthetic.image(kind, i, dx, dy, 96, 80, 42).astype(np.float32)
        keys = {"IMAGETYP": kind, "FILTER": "H", "GAIN": 100, "EXPTIME": {"bias": 0.0, "flat": 1.0}.get(kind, 60.0)}
        if i % 4 == 1:
            (out / f"{i:03d}_{kind}.xisf").write_bytes(xisf.encode(a, keys))
        else:
            (out / f"{i:03d}_{kind}.fits").write_bytes(fits.encode(a, keys))
    (out / "999_light.fits").write_bytes(fits.encode(np.full((80, 96), 1200, np.float32), {"IMAGETYP": "light", "FILTER": "H", "GAIN": 100, "EXPTIME": 60.0}))
    return out


def test_from_files_to_master(spark, folder, tmp_path):
    got = run.process(spark, str(folder), tile=32, model="translation")
    status = {r.path.rsplit("/", 1)[1]: r.status for r in got["ledger"].collect()}
    assert status["999_light.fits"] in ("registration_rejected", "registration_missing") and sum(s == "integrated" for s in status.values()) == 6
    truth = {f"F{i + 1:06d}": (dx, dy) for i, kind, dx, dy in synthetic.truth(6) if kind == "light"}
    moved = {r.frame: (r.matrix[0][2], r.matrix[1][2]) for r in got["solutions"].filter("status = 'ok'").collect()}
    ref = next(f for f, m in moved.items() if np.hypot(*m) < 1e-9)
    for f, m in moved.items():
        assert np.allclose(m, np.array(truth[ref]) - truth[f], atol=0.2)
    a = np.zeros((80, 96))
    for r in tiles.to_pixels(got["master"], ["filter"], "master").collect():
        a[r.y, r.x] = r.master
    dx, dy = truth[ref]
    sky = np.random.default_rng(42)
    stars = zip(sky.uniform(0, 96, 20), sky.uniform(0, 80, 20), sky.uniform(800, 6000, 20), strict=True)
    y, x = np.mgrid[0:80, 0:96]
    want = 200 + sum(f * np.exp(-((x - sx - dx) ** 2 + (y - sy - dy) ** 2) / (2 * 1.4**2)) for sx, sy, f in stars)
    inner = (slice(6, -6), slice(6, -6))
    flat = (1 - 0.2 * (((x - 48) / 96) ** 2 + ((y - 40) / 80) ** 2)).mean()
    assert np.median(np.abs(a[inner] / flat - want[inner])) < 12
    written = run.write_master(got["master"], f"file://{tmp_path}/out")
    assert written["filter"].tolist() == ["H"]


@pytest.mark.parametrize("method", ["sigma", "winsorized_sigma", "mad", "minmax"])
def test_rejection_of_a_cube(method):
    cube = np.array([1, 1, 1, 1, 100.0])[:, None] * np.ones((1, 4))
    cube[0, 1] = np.nan
    low, high = tiles.rejected(cube, Rejection(method, 3, 1 if method != "mad" else 3, min_samples=2))
    want = {"sigma": 1, "winsorized_sigma": 1, "mad": 0, "minmax": 0}[method]  # mad: no scale; minmax: all ones are minima, more than half would go
    assert high[4].tolist() == [bool(want)] * 4 and not low.any()


def test_empty_places_and_halo(spark):
    rows = [(1, y, x, float(y * 10 + x)) for y in range(7) for x in range(9)]
    t = tiles.from_pixels(spark.createDataFrame(rows, "f int, y int, x int, v double"), ["f"], 4)
    seen = {}

    def look(a, y0, x0):
        y, x = np.nonzero(np.isfinite(a))
        return {"y": [y0], "x": [x0], "n": [len(y)], "s": [float(np.nansum(a))]}

    for r in tiles.stencil(t, ["f"], 4, 2, look, "y int, x int, n int, s double").collect():
        seen[r.y, r.x] = (r.n, r.s)
    a = np.arange(7)[:, None] * 10 + np.arange(9)
    for ty in (0, 4):
        for tx in (0, 4, 8):
            part = a[max(0, ty - 2) : min(7, ty + 4) + 2, max(0, tx - 2) : min(9, tx + 4) + 2]
            assert seen[ty - 2, tx - 2] == (part.size, float(part.sum()))
    far = spark.createDataFrame([(1, [1.0, 0.0, 500.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "f int, matrix array<double>")
    w = tiles.warp(t, ["f"], far, 4, 7, 9)
    assert w.count() == 6 and tiles.to_pixels(w, ["f"], "data").filter("data is not null").count() == 0


def test_many_groups_come_at_once(spark, sf):
    """Neither a stencil nor a warp starts pandas for each tile."""
    for name in ("tile_local_max", "tile_warp"):
        plan = run.Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_warp_in_small_batches(spark):
    """Groups that are cut by batches give what whole ones do."""
    rows = [(f, y, x, float(f * 100 + y * 10 + x)) for f in range(5) for y in range(7) for x in range(9)]
    t = tiles.from_pixels(spark.createDataFrame(rows, "f int, y int, x int, v double"), ["f"], 4)
    m = spark.createDataFrame([(f, [1.0, 0.0, 0.5 * f, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0]) for f in range(5)], "f int, matrix array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = {(r.f, r.y, r.x): r.data for r in tiles.to_pixels(tiles.warp(t, ["f"], m, 4, 7, 9), ["f"], "data").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == 5 * 63
    for (f, y, x), v in got.items():
        sy, sx = y - 1, x - 0.5 * f
        assert v == pytest.approx(f * 100 + sy * 10 + sx) if sy >= 0 and sx >= 0 else v is None
