import numpy as np
import pytest

from siderea.functions import metadata as meta
from siderea.operators import register, stars
from siderea.sources import artifacts, fits, synthetic, xisf


def test_fits_spec_and_tiles(tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    a[1, 2] = np.nan
    p = tmp_path / "x.fits"
    p.write_bytes(fits.encode(a, {"IMAGETYP": "Light Frame", "O'K": "it's"}))
    assert p.stat().st_size % 2880 == 0
    with open(p, "rb") as f:
        h, at = fits.read_header(f)
        s = fits.spec(h, at)
        np.testing.assert_array_equal(fits.read_tile(f, s, 0, 3, 1, 4), a[:, 1:])
        np.testing.assert_array_equal(fits.read_tile(f, s, 0, 3, 0, 4, 2), a[::2, ::2])
    assert h["O'K"] == "it's" and (s["width"], s["height"]) == (4, 3)
    for bad in ({"NAXIS": 3}, {"BITPIX": 7}, {"SIMPLE": False}, {"NAXIS1": None}):
        with pytest.raises(fits.BadFile):
            fits.spec({**h, **bad}, at)


def test_integers_with_blank(tmp_path):
    raw = np.array([[1, -32768]], ">i2")
    head = b"".join(fits.card(k, v) for k, v in {"SIMPLE": True, "BITPIX": 16, "NAXIS": 2, "NAXIS1": 2, "NAXIS2": 1, "BZERO": 32768, "BSCALE": 1, "BLANK": -32768}.items()) + b"END".ljust(80)
    p = tmp_path / "i.fits"
    p.write_bytes(head.ljust(2880) + raw.tobytes().ljust(2880, b"\0"))
    with open(p, "rb") as f:
        t = fits.read_tile(f, fits.spec(*fits.read_header(f)), 0, 1, 0, 2)
    assert t[0, 0] == 32769 and np.isnan(t[0, 1])


def test_xisf(tmp_path):
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    p = tmp_path / "x.xisf"
    p.write_bytes(xisf.encode(a, {"FILTER": "'Ha'", "EXPTIME": "60"}))
    with open(p, "rb") as f:
        h, s = xisf.read_xisf_header(f)
        np.testing.assert_array_equal(fits.read_tile(f, xisf.tile_spec(s), 0, 2, 0, 3), a)
    assert h["FILTER"] == "Ha"
    for bad in ({"channels": 3}, {"compressed": True}, {"format": "Complex32"}, {"place": ["url", "x", "1"]}, {"place": ["attachment", "4096", "3"]}):
        with pytest.raises(ValueError):
            xisf.tile_spec({**s, **bad})


def test_scan(spark, tmp_path):
    a = np.zeros((2, 2), np.float32)
    (tmp_path / "b.fits").write_bytes(fits.encode(a, {"IMAGETYP": "dark", "EXPTIME": 60.0, "XBINNING": 2}))
    (tmp_path / "a.fits").write_bytes(b"nothing")
    (tmp_path / "c.xisf").write_bytes(xisf.encode(a, {"IMAGETYP": "'Flat'", "GAIN": "1.5"}))
    (tmp_path / "source_dq").mkdir()
    (tmp_path / "source_dq" / "d.fits").write_bytes(fits.encode(a))
    rows = {r.path.rsplit("/", 1)[1]: r for r in fits.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.fits", "b.fits", "c.xisf"}
    assert rows["a.fits"].frame_id is None and rows["a.fits"].warnings
    assert (rows["b.fits"].frame_id, rows["b.fits"].frame_type, rows["b.fits"].exposure_s, rows["b.fits"].binning_x) == ("F000001", "dark", 60.0, 2)
    assert (rows["c.xisf"].frame_id, rows["c.xisf"].frame_type, rows["c.xisf"].gain) == ("F000002", "flat", 1.5)


def test_artifacts(tmp_path):
    p = f"{tmp_path}/d/x.json"
    artifacts.write_json(p, {"b": 1, "a": [None]})
    assert artifacts.read_json(p) == {"a": [None], "b": 1}
    assert open(p).read().index('"a"') < open(p).read().index('"b"')


def test_metadata(spark):
    df = spark.createDataFrame([("x/y/z/Master_Bias.fit", "nan", "7.9"), (None, "1e3", None)], "p string, a string, b string")
    r = df.select(meta.frame_type(df.p).alias("t"), meta.as_float(df.a).alias("f"), meta.as_int(df.b).alias("i"), meta.path_keys(df.p).alias("k")).collect()
    assert (r[0].t, r[0].i, r[1].t, r[1].f, r[1].i) == ("bias", 7, "unknown", 1000.0, None)
    assert {"x/y/z/Master_Bias.fit", "Master_Bias.fit", "Master_Bias", "z/Master_Bias.fit", "y/z/Master_Bias.fit"} == set(r[0].k)


def test_synthetic_shifts_are_found(spark):
    df = synthetic.generate(spark, 6, 48, 48).filter("kind = 'light'")
    ref = df.filter("frame = 0")
    found = {r.frame: (r.dx, r.dy) for r in register.phase_correlation(df, ref, 48, 48).collect()}
    first = ref.select("dx", "dy").first()
    truth = {r.frame: (first.dx - r.dx, first.dy - r.dy) for r in df.select("frame", "dx", "dy").distinct().collect()}
    assert found == truth


def test_similarity_is_solved():
    rnd = np.random.default_rng(3)
    ref = rnd.uniform(0, 200, (25, 2))
    m = np.array([[0.99, -0.05, 4.0], [0.05, 0.99, -3.0], [0, 0, 1]])
    mov = register.moved(ref, np.linalg.inv(m))
    for model in ("similarity", "affine", "homography"):
        h, n, rms = register.solve(ref, mov, model)
        assert n == 25 and rms < 1e-6, model
    h, n, _ = register.solve(ref, ref - [3.0, 1.0], "translation")
    np.testing.assert_allclose(h[:2, 2], [3, 1], atol=1e-9)


def test_render(spark):
    s = spark.createDataFrame([(5.0, 4.0, 100.0)], "sx double, sy double, flux double")
    v = {(r.y, r.x): r.v for r in stars.render(10, 9, s).collect()}
    assert len(v) == 90 and max(v, key=v.get) == (4, 5)
