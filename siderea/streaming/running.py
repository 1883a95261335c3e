"""Frames that arrive one by one: running means per group, with a watermark. The reference works in batches only; this is an extension.

The mean is mergeable, so state holds a sum and a count per group and window. Rejection isn't: it needs all samples of a pixel.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_mean(stream: DataFrame, ts: str, keys: list[str], value: Column, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """value is a whole number; windows close when the watermark has passed them."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *keys)
    return w.agg(F.sum(value).alias("total"), F.count(value).alias("n")).select(F.col("w.start").alias("start"), *keys, F.try_divide(F.col("total").cast("double"), F.col("n").cast("double")).alias("mean"), "n")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What the stream gives for all that has arrived by now, from a table in the driver's memory: for small results and tests."""
    name = f"drained_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
