"""Header scalars: lenient casts, preference lists, frame types, path keys, group ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a frame type, in order of preference.
FRAME_WORDS = (("bias", ("bias", "zero")), ("dark", ("dark",)), ("flat", ("flat",)), ("light", ("light", "object", "science")))


def frame_type(value: Column) -> Column:
    text = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "_-", "  ")
    out = F.lit("unknown")
    for kind, words in reversed(FRAME_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, kind).otherwise(out)
    return out


def as_float(value: Column) -> Column:
    return value.try_cast("double")


def as_int(value: Column) -> Column:
    d = value.try_cast("double")
    return F.when(~F.isnan(d), (F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d))).try_cast("int"))


def first_header_value(header: Column, names: list[str]) -> Column:
    """Of a map with upper-case keys: the value of the first key that is there, null values included."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.map_contains_key(header, n), F.element_at(header, n)).otherwise(out)
    return out


def path_keys(path: Column) -> Column:
    """The path, its name, its stem and its last two, three and four parts."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    tail = lambda n: F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), "/"))
    return F.array_distinct(F.array_compact(F.array(path, name, F.regexp_replace(name, r"\.[^.]*$", ""), tail(2), tail(3), tail(4))))


def group_id(*parts: Column) -> Column:
    """G and ten digits of the SHA-1 of the parts, joined by bars; null reads None."""
    return F.concat(F.lit("G"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]).cast("binary")), 1, 10))


def safe_name(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "_")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "").try_cast("int")


def warning_value(warning: Column, key: str) -> Column:
    """The value of key=value."""
    v = F.regexp_extract(warning, rf"^{key}=(.*)$", 1)
    return F.when(warning.startswith(f"{key}="), v)


def scalar_kind(value: Column) -> Column:
    """Of a text, what it reads as: null, empty, boolean, integer, float or text."""
    t = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    return (
        F.when(value.isNull(), "null").when(t == "", "empty").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?$"), "float").otherwise("text")
    )


def compact_decode_reason(bitpix: Column, bscale: Column, bzero: Column, blank: Column, shape_ok: Column) -> Column:
    """Why pixels can't be read as unsigned 16-bit numbers at once; empty if they can. Reasons are fixed values; null headers are defaults."""
    scale, zero = F.coalesce(bscale, F.lit(1.0)).cast("double"), F.coalesce(bzero, F.lit(0.0)).cast("double")
    return (
        F.when(~shape_ok, "shape_mismatch").when(bitpix != 16, F.concat(F.lit("bitpix_not_16:"), bitpix.cast("string"))).when(scale != 1.0, F.concat(F.lit("bscale_not_1:"), F.regexp_replace(F.round(scale, 6).cast("string"), r"\.0$", "")))
        .when(zero != 32768.0, F.concat(F.lit("bzero_not_32768:"), F.regexp_replace(F.round(zero, 6).cast("string"), r"\.0$", ""))).when(blank.isNotNull(), "blank_present").otherwise("")
    )
