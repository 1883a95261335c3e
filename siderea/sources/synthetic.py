"""A deterministic set of bias, dark, flat and light frames with known shifts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def truth(frames: int, shift: bool = True) -> list[tuple[int, str, int, int]]:
    """(frame, type, dx, dy): lights first, then a quarter as many of each calibration type, three at least."""
    cal = max(3, frames // 4)
    out = [(i, "light", i % 5 - 2 if shift else 0, i // 5 % 5 - 2 if shift else 0) for i in range(frames)]
    for k, kind in enumerate(("bias", "dark", "flat")):
        out += [(frames + k * cal + i, kind, 0, 0) for i in range(cal)]
    return out


def image(kind: str, frame: int, dx: int, dy: int, width: int, height: int, seed: int) -> np.ndarray:
    rnd, y, x = np.random.default_rng(seed + frame), *np.mgrid[0:height, 0:width].astype(float)
    flat = 1 - 0.2 * (((x - width / 2) / width) ** 2 + ((y - height / 2) / height) ** 2)
    if kind == "bias":
        return 1000 + rnd.normal(0, 3, x.shape)
    if kind == "dark":
        return 1024 + rnd.normal(0, 4, x.shape)
    if kind == "flat":
        return 25000 * flat + rnd.normal(0, 20, x.shape)
    sky = np.random.default_rng(seed)
    stars = zip(sky.uniform(0, width, 20), sky.uniform(0, height, 20), sky.uniform(800, 6000, 20), strict=True)
    light = 200 + sum(f * np.exp(-((x - sx - dx) ** 2 + (y - sy - dy) ** 2) / (2 * 1.4**2)) for sx, sy, f in stars)
    return 1024 + light * flat + rnd.normal(0, 8, x.shape)


def generate(spark: SparkSession, frames: int = 20, width: int = 64, height: int = 64, shift: bool = True, seed: int = 42) -> DataFrame:
    """images (frame, kind, dx, dy, y, x, v), each frame from its own seed."""

    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = (a.ravel() for a in np.mgrid[0:height, 0:width])
        for p in it:
            for r in p.itertuples():
                v = np.round(image(r.kind, r.frame, r.dx, r.dy, width, height, seed)).astype(np.int64).ravel()
                yield pd.DataFrame({"frame": r.frame, "kind": r.kind, "dx": r.dx, "dy": r.dy, "y": y.astype(np.int32), "x": x.astype(np.int32), "v": v})

    rows = truth(frames, shift)
    t = spark.createDataFrame(rows, "frame long, kind string, dx int, dy int").repartition(max(1, min(len(rows), 64)), "frame")
    return t.mapInPandas(make, "frame long, kind string, dx int, dy int, y int, x int, v long")
