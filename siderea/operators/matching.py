"""Grouping of calibration frames and matching of lights to groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siderea.functions.metadata import group_id

SENSOR = ["gain", "off", "bin", "shape"]


def group_frames(frames: DataFrame, sensor: list[str] = SENSOR) -> DataFrame:
    """Frames of a known type by type, filter (flats and lights), exposure (darks and lights) and sensor; ids in order."""
    t = F.col("frame_type")
    keyed = frames.filter(t != "unknown").withColumns({"g_filter": F.when(t.isin("flat", "light"), F.col("filter")), "g_exposure": F.when(t.isin("dark", "light"), F.col("exposure"))})
    key = ["frame_type", "g_filter", "g_exposure", *sensor]
    out = keyed.groupBy(*key).agg(F.sort_array(F.collect_list("frame_id")).alias("frames"), F.count("*").alias("n_frames"))
    return out.withColumn("group_id", group_id(*[F.col(k) for k in key]))


def _first(lights: DataFrame, groups: DataFrame, keys: list[tuple[str, str]], order: list, name: str) -> DataFrame:
    """Each light's first group by order among those whose keys are equal, null being equal to null."""
    cond = [lights[a].eqNullSafe(groups[b]) for a, b in keys]
    both = lights.join(groups, cond, "left")
    w = Window.partitionBy(lights["frame_id"]).orderBy(*order)
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(lights["frame_id"], groups["group_id"].alias(name))


def _groups(groups: DataFrame, kind: str, sensor: list[str]) -> DataFrame:
    return groups.filter(F.col("frame_type") == kind).select("group_id", F.col("g_filter").alias("gf"), F.col("g_exposure").alias("ge"), *[F.col(s).alias(f"g_{s}") for s in sensor])


def find_bias(lights: DataFrame, groups: DataFrame, sensor: list[str] = SENSOR) -> DataFrame:
    g = _groups(groups, "bias", sensor)
    return _first(lights, g, [(s, f"g_{s}") for s in sensor], [g["group_id"]], "bias_group")


def find_dark(lights: DataFrame, groups: DataFrame, sensor: list[str] = SENSOR) -> DataFrame:
    """A group of exactly the light's exposure if there is one, else the first of the sensor: not the nearest exposure."""
    g = _groups(groups, "dark", sensor)
    return _first(lights, g, [(s, f"g_{s}") for s in sensor], [lights["exposure"].eqNullSafe(g["ge"]).desc(), g["group_id"]], "dark_group")


def find_flat(lights: DataFrame, groups: DataFrame, sensor: list[str] = SENSOR) -> DataFrame:
    g = _groups(groups, "flat", sensor)
    return _first(lights, g, [("filter", "gf"), *((s, f"g_{s}") for s in sensor)], [g["group_id"]], "flat_group")


def light_plan(lights: DataFrame, groups: DataFrame, sensor: list[str] = SENSOR) -> DataFrame:
    """Each light with its groups, its status and what is missing. Dark and flat are needed, bias isn't."""
    out = lights
    for found in (find_bias(lights, groups, sensor), find_dark(lights, groups, sensor), find_flat(lights, groups, sensor)):
        out = out.join(found, "frame_id", "left")
    ready = F.col("dark_group").isNotNull() & F.col("flat_group").isNotNull()
    missing = F.array_compact(F.array(*[F.when(F.col(f"{k}_group").isNull(), F.lit(f"missing {k}")) for k in ("bias", "dark", "flat")]))
    return out.withColumns({"status": F.when(ready, "ready").otherwise("blocked"), "warnings": missing})


def subset(frames: DataFrame, lights: DataFrame, per_group: int, sensor: list[str] = SENSOR) -> DataFrame:
    """Chosen lights and, of each type of calibration frame, the first `per_group` whose sensor one of the lights shares, renumbered."""
    cal = frames.filter(F.col("frame_type").isin("bias", "dark", "flat"))
    sensors = lights.select(*sensor).distinct()
    near = cal.join(sensors, [cal[s].eqNullSafe(sensors[s]) for s in sensor], "left_semi")
    w = Window.partitionBy("frame_type", *sensor).orderBy("frame_id")
    chosen = near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_group).drop("_r")
    all_rows = chosen.select("frame_id", "frame_type").unionByName(lights.select("frame_id", "frame_type")).distinct()
    return all_rows.withColumn("new_id", F.format_string("F%06d", F.row_number().over(Window.orderBy("frame_type", "frame_id"))))


def compatible(frames: DataFrame, lights: DataFrame, sensor: list[str] = SENSOR, tolerance: float = 1e-6) -> DataFrame:
    """Calibration frames that some light can use: the sensor of a light, and for darks the exposure of a light within tolerance, for flats
    the filter of a light. Exposures meet by cell of the tolerance and its neighbours."""
    kind, e = F.col("frame_type"), F.col("exposure").cast("double")
    cell = lambda x: F.floor(x / tolerance).cast("bigint")
    cal = frames.filter(kind.isin("bias", "dark", "flat"))
    sensors = lights.select(*sensor).distinct()
    near = cal.join(sensors, [cal[s].eqNullSafe(sensors[s]) for s in sensor], "left_semi")
    no = F.lit(None).cast("double")
    flats = lights.filter("filter <> ''").select(F.lit("flat").alias("_t"), F.col("filter").cast("string").alias("_k"), no.alias("_e"))
    darks = lights.filter(e.isNotNull()).select(e.alias("_e")).distinct().select(F.lit("dark").alias("_t"), F.explode(F.array(*[(cell(F.col("_e")) + i).cast("string") for i in (-1, 0, 1)])).alias("_k"), "_e")
    wanted = flats.distinct().unionByName(darks)
    keyed = near.withColumn("_c", F.when(kind == "flat", F.col("filter").cast("string")).when(kind == "dark", cell(e).cast("string")))
    hit = keyed.filter("frame_type <> 'bias'").join(wanted, (kind == F.col("_t")) & (F.col("_c") == F.col("_k")) & ((kind == "flat") | (F.abs(e - F.col("_e")) <= tolerance)), "left_semi")
    return keyed.filter("frame_type = 'bias'").unionByName(hit).drop("_c")


def bind_sidecars(frames: DataFrame, sidecars: DataFrame, keys) -> DataFrame:
    """Sidecars (sidecar_id, frame_id, path, mask_path) to light frames (frame_id, path, frame_type): by id if it is a frame's, else by
    any shared path key, in lower case. Without a mask path they are skipped; else bound, ambiguous or unmatched.

    A key stands for the least and the largest id of its frames, so a key that many frames share costs no more than another: a sidecar
    is bound if all of its keys' ends are one frame.
    """
    f = frames.filter("frame_type = 'light'")
    by_key = f.select("frame_id", F.explode(keys(F.lower("path"))).alias("k")).groupBy("k").agg(F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"))
    usable = sidecars.filter("mask_path <> ''")
    ids = f.select(F.col("frame_id").cast("string").alias("frame_id"), F.lit(True).alias("_known")).distinct()
    named = usable.select("sidecar_id", F.col("frame_id").cast("string").alias("frame_id"), "path").join(ids, "frame_id", "left")
    by_path = named.filter("_known is null").select("sidecar_id", F.explode(keys(F.lower("path"))).alias("k")).join(by_key, "k").groupBy("sidecar_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by_id = named.filter("_known").select("sidecar_id", F.col("frame_id").alias("lo"), F.col("frame_id").alias("hi"))
    hit = by_id.unionByName(by_path.withColumns({"lo": F.col("lo").cast("string"), "hi": F.col("hi").cast("string")}))
    out = sidecars.select("sidecar_id", "mask_path").join(hit, "sidecar_id", "left")
    skipped = F.coalesce(F.col("mask_path"), F.lit("")) == ""
    status = F.when(skipped, "skipped").when(F.col("lo").isNull(), "unmatched").when(F.col("lo") != F.col("hi"), "ambiguous").otherwise("bound")
    return out.select("sidecar_id", F.when(status == "bound", F.col("lo")).alias("frame_id"), status.alias("status"))


def frame_counts(frames: DataFrame, skipped: int = 0) -> DataFrame:
    """How many frames have each type, filter, exposure, gain, temperature and shape, and how many there are: (key, value, n), one scan
    and one shuffle. What is missing reads None, a missing filter none."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    named = {
        "frame_type": text("frame_type"), "filter": F.coalesce(F.when(F.col("filter") != "", F.col("filter")), F.lit("none")), "exposure_s": text("exposure_s"), "gain": text("gain"),
        "temperature_c": text("temperature_c"), "shape": F.concat(text("width"), F.lit("x"), text("height")),
    }
    keys = list(named)
    sets = [[], *[[k] for k in keys]]
    g = frames.select(*[c.alias(k) for k, c in named.items()]).groupingSets(sets, *keys).agg(F.count("*").alias("n"), *[F.grouping(k).alias(f"_{k}") for k in keys])
    key, value = F.lit("count"), F.lit(None).cast("string")
    for k in keys:
        key, value = F.when(F.col(f"_{k}") == 0, k).otherwise(key), F.when(F.col(f"_{k}") == 0, F.col(k)).otherwise(value)
    out = g.select(key.alias("key"), value.alias("value"), "n")
    return out.unionByName(frames.sparkSession.range(1).select(F.lit("skipped_count").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(skipped).cast("bigint").alias("n")))
