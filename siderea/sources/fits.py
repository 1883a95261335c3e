"""FITS and XISF images (mono, uncompressed): headers, tiles, a Spark data source and a writer. No FITS library is needed.

spark.dataSource.register(FitsSource); spark.read.format("fits").load(folder) gives one row per tile; options: tile (pixels a side),
stride (every n-th row and column), columns of no interest cost nothing but their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siderea.functions import metadata as meta
from siderea.sources.shared import filesystem

BLOCK = 2880
TASK_BYTES = 64 << 20
# Sample types by BITPIX.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
SUFFIXES = (".fit", ".fits", ".fts", ".xisf")
SIDECARS = re.compile(r"(^|/)source[_-]dq(/|$)", re.I)


class BadFile(ValueError):
    pass


_QUOTED = re.compile(r"\s*'((?:[^']|'')*)'?")


def card_value(text: str):
    """Of what follows '= ' in a card: str, bool, int, float or None."""
    if quoted := _QUOTED.match(text):
        return quoted[1].replace("''", "'").rstrip()
    bare = text.partition("/")[0].strip()
    if bare in ("T", "F"):
        return bare == "T"
    try:
        return int(bare)
    except ValueError:
        try:
            return float(bare.replace("D", "E"))
        except ValueError:
            return bare or None


def read_header(stream) -> tuple[dict, int]:
    """Header and the place where data begin; reads no further."""
    header, at = {}, 0
    while True:
        block = stream.read(BLOCK)
        if len(block) < BLOCK:
            raise BadFile("the header has no END")
        at += BLOCK
        for i in range(0, BLOCK, 80):
            card = bytes(block[i : i + 80]).decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return header, at
            if card[8:10] == "= " and key not in header:
                header[key] = card_value(card[10:])


def spec(header: dict, at: int) -> dict:
    """What is needed to read tiles; refuses what isn't a plain two-dimensional image."""
    if header.get("SIMPLE") is not True:
        raise BadFile("not a simple FITS file")
    if header.get("NAXIS") != 2:
        raise BadFile(f"only two axes are supported, not {header.get('NAXIS')}")
    if header.get("BITPIX") not in TYPES:
        raise BadFile(f"BITPIX {header.get('BITPIX')} is unknown")
    if header.get("ZCMPTYPE") or header.get("GROUPS"):
        raise BadFile("compressed images and groups are not supported")
    w, h = header.get("NAXIS1"), header.get("NAXIS2")
    if not (isinstance(w, int) and isinstance(h, int) and w > 0 and h > 0):
        raise BadFile("the image has no size")
    return {"width": w, "height": h, "dtype": TYPES[header["BITPIX"]], "at": at, "scale": float(header.get("BSCALE", 1) or 1), "zero": float(header.get("BZERO", 0) or 0), "blank": header.get("BLANK")}


def read_tile(stream, s: dict, y0: int, y1: int, x0: int, x1: int, stride: int = 1) -> np.ndarray:
    """float32; BLANK becomes NaN before scale and zero apply."""
    t = np.dtype(s["dtype"])
    rows = []
    for y in range(y0, y1, stride):
        stream.seek(s["at"] + (y * s["width"] + x0) * t.itemsize)
        rows.append(np.frombuffer(stream.read((x1 - x0) * t.itemsize), t)[::stride])
    raw = np.stack(rows)
    out = raw.astype(np.float64)
    if s["blank"] is not None and t.kind in "iu":
        out[raw == s["blank"]] = np.nan
    return (out * s["scale"] + s["zero"]).astype(np.float32)


def card(key: str, value) -> bytes:
    if isinstance(value, bool):
        v = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, float)):
        v = f"{value!r:>20}"
    else:
        v = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{key:<8}= {v}"[:80].ljust(80).encode("ascii", "replace")


def encode(data: np.ndarray, header: dict | None = None) -> bytes:
    """A whole file, 32-bit floats."""
    h, w = data.shape
    cards = [card(k, v) for k, v in {"SIMPLE": True, "BITPIX": -32, "NAXIS": 2, "NAXIS1": w, "NAXIS2": h, **(header or {})}.items()] + [b"END".ljust(80)]
    head = b"".join(cards)
    body = np.ascontiguousarray(data, ">f4").tobytes()
    return head + b" " * (-len(head) % BLOCK) + body + b"\0" * (-len(body) % BLOCK)


def image_paths(folder: str) -> list[str]:
    """All image files under folder, in order of path; sidecar folders are left out."""
    fs, at = filesystem(folder)
    found = [i.path for i in fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True)) if i.type == pafs.FileType.File]
    return sorted(p for p in found if p.lower().endswith(SUFFIXES) and not SIDECARS.search(p[len(at) :].rsplit("/", 1)[0] + "/"))


class _Bands(InputPartition):
    """Bands of rows (path, first, end) that one task reads."""

    def __init__(self, bands: list[tuple[str, int, int]]):
        self.bands = bands


def image_spec(path: str, stream) -> dict:
    """Of a FITS or XISF file."""
    from siderea.sources.xisf import read_xisf_header, tile_spec

    return tile_spec(read_xisf_header(stream)[1]) if path.lower().endswith(".xisf") else spec(*read_header(stream))


class FitsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.tile, self.stride = options["path"], int(options.get("tile", 512)), int(options.get("stride", 1))

    def partitions(self) -> list[_Bands]:
        """Headers are read in threads; a task gets bands of up to TASK_BYTES."""
        fs, _ = filesystem(self.folder)

        def bands(path: str) -> list[tuple[int, str, int, int]]:
            with fs.open_input_file(path) as f:
                s = image_spec(path, f)
            row = s["width"] * np.dtype(s["dtype"]).itemsize
            return [(row * (min(s["height"], y + self.tile) - y), path, y, min(s["height"], y + self.tile)) for y in range(0, s["height"], self.tile)]

        with ThreadPoolExecutor(16) as pool:
            found = [x for b in pool.map(bands, image_paths(self.folder)) for x in b]
        out, size, most = [_Bands([])], 0, max(1, -(-len(found) // 16))
        for n, *band in found:
            if out[-1].bands and (size + n > TASK_BYTES or len(out[-1].bands) >= most):
                out.append(_Bands([]))
                size = 0
            out[-1].bands.append(tuple(band))
            size += n
        return out

    def read(self, part: _Bands) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.folder)
        for path, y0, y1 in part.bands:
            with fs.open_input_file(path) as f:
                s = image_spec(path, f)
                for x0 in range(0, s["width"], self.tile):
                    t = read_tile(f, s, y0, y1, x0, min(s["width"], x0 + self.tile), self.stride)
                    data = pa.ListArray.from_arrays(pa.array([0, t.size], pa.int32()), pa.array(t.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([v], pa.int32()) for v in (y0, x0, t.shape[0], t.shape[1])), data], ["path", "y0", "x0", "h", "w", "data"])


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return "path string, y0 int, x0 int, h int, w int, data array<float>"

    def reader(self, schema) -> FitsReader:
        return FitsReader(dict(self.options))


def pixels(tiles: DataFrame, stride: int = 1) -> DataFrame:
    """Tiles to one row per pixel; what isn't finite is null and has the NO_DATA bit."""
    p = tiles.select("path", "y0", "x0", "w", F.posexplode("data").alias("i", "v"))
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    return p.select("path", (F.col("y0") + F.expr("i div w").cast("int") * stride).alias("y"), (F.col("x0") + (F.col("i") % F.col("w")) * stride).alias("x"), F.when(~bad, F.col("v")).alias("v"), F.when(bad, 1).otherwise(0).alias("dq"))


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """images (frame, y, x, v): a file per frame under folder, written under a temporary name and moved; returns (frame, path)."""
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)

    def one(p: pd.DataFrame) -> pd.DataFrame:
        a = np.full((int(p["y"].max()) + 1, int(p["x"].max()) + 1), np.nan, np.float32)
        a[p["y"], p["x"]] = p["v"]
        name = f"{at}/{int(p['frame'].iloc[0]):012d}.fits"
        f, _ = filesystem(folder)
        with f.open_output_stream(name + ".part") as out:
            out.write(encode(a, {"FRAMEID": int(p["frame"].iloc[0])}))
        f.move(name + ".part", name)
        return pd.DataFrame({"frame": [p["frame"].iloc[0]], "path": [name]})

    return images.select("frame", "y", "x", "v").groupBy("frame").applyInPandas(one, "frame long, path string")


# Header keys by field, in order of preference.
FIELDS = {
    "frame_type": ["IMAGETYP", "FRAME", "OBSTYPE"],
    "filter": ["FILTER", "FILTERID"],
    "exposure_s": ["EXPTIME", "EXPOSURE", "EXP-TIME"],
    "gain": ["GAIN", "EGAIN"],
    "offset": ["OFFSET", "BLKLEVEL"],
    "temperature_c": ["CCD-TEMP", "SET-TEMP", "CCD_TEMP"],
    "binning_x": ["XBINNING", "BINX", "XBIN"],
    "binning_y": ["YBINNING", "BINY", "YBIN"],
    "width": ["NAXIS1"],
    "height": ["NAXIS2"],
    "camera": ["INSTRUME", "CAMERA"],
    "date_obs": ["DATE-OBS", "DATE"],
    "object_name": ["OBJECT"],
    "ra": ["RA", "OBJCTRA"],
    "dec": ["DEC", "OBJCTDEC"],
}
FLOATS, INTS = ("exposure_s", "gain", "offset", "temperature_c"), ("binning_x", "binning_y", "width", "height")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest: path, frame_id (F000001 on, by path, files that fail take none), the fields of FIELDS, header, warnings."""
    from siderea.sources.xisf import read_xisf_header

    def heads(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = filesystem(folder)
        for p in it:
            rows = []
            for path in p["path"]:
                try:
                    with fs.open_input_file(path) as f:
                        h = read_xisf_header(f)[0] if path.lower().endswith(".xisf") else read_header(f)[0]
                    rows.append((path, {k.upper(): None if v is None else str(v) for k, v in h.items()}, None))
                except Exception as e:  # one bad file is a warning, not the end of the scan
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "header", "failure"])

    paths = image_paths(folder)
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    h = listed.repartition(max(1, min(len(paths), 200)), "path").mapInPandas(heads, "path string, header map<string,string>, failure string")
    cols = {}
    for field, names in FIELDS.items():
        v = meta.first_header_value(F.col("header"), names)
        cols[field] = meta.frame_type(v) if field == "frame_type" else meta.as_float(v) if field in FLOATS else meta.as_int(v) if field in INTS else v
    d = h.withColumns(cols)
    warnings = F.array_compact(F.array(F.col("failure"), F.when(F.col("failure").isNull() & (F.col("width").isNull() | F.col("height").isNull()), "missing image shape metadata"), F.when(F.col("failure").isNull() & (F.col("frame_type") == "unknown"), "unknown frame type")))


    n = F.sum(F.when(F.col("failure").isNull(), 1).otherwise(0)).over(Window.orderBy("path"))
    return d.withColumns({"frame_id": F.when(F.col("failure").isNull(), F.format_string("F%06d", n)), "warnings": warnings}).drop("failure")
