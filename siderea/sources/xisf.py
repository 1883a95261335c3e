"""XISF images: XML header and an uncompressed mono attachment."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import numpy as np

# Sample formats.
FORMATS = {"UInt8": "<u1", "UInt16": "<u2", "UInt32": "<u4", "Int16": "<i2", "Int32": "<i4", "Float32": "<f4", "Float64": "<f8"}
SIGNATURE = b"XISF0100"


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def read_xisf_header(stream) -> tuple[dict, dict]:
    """FITS keywords and properties (upper case; keywords first), and what is needed to read tiles."""
    head = stream.read(16)
    if bytes(head[:8]) != SIGNATURE:
        raise ValueError("not an XISF file")
    root = ET.fromstring(bytes(stream.read(int.from_bytes(head[8:12], "little"))).rstrip(b"\0").decode())
    image = next((e for e in root.iter() if _local(e) == "Image"), None)
    if image is None:
        raise ValueError("the file holds no image")
    fields: dict = {}
    for e in image.iter():
        if _local(e) == "FITSKeyword" and e.get("name"):
            fields.setdefault(e.get("name").upper(), (e.get("value") or "").strip().strip("'").strip())
    for e in root.iter():
        if _local(e) == "Property" and e.get("id"):
            fields.setdefault(e.get("id").rsplit(":", 1)[-1].upper(), e.get("value") if e.get("value") is not None else (e.text or ""))
    size = (image.get("geometry") or "").split(":")
    if len(size) != 3:
        raise ValueError("the geometry isn't width:height:channels")
    w, h, c = map(int, size)
    fields.setdefault("NAXIS1", w)
    fields.setdefault("NAXIS2", h)
    if image.get("imageType"):
        fields.setdefault("IMAGETYP", image.get("imageType"))
    place = (image.get("location") or "").split(":")
    return fields, {"width": w, "height": h, "channels": c, "format": image.get("sampleFormat"), "compressed": bool(image.get("compression")), "place": place}


def tile_spec(s: dict) -> dict:
    if s["channels"] != 1 or s["compressed"]:
        raise ValueError("only uncompressed mono images are supported")
    if s["format"] not in FORMATS:
        raise ValueError(f"sample format {s['format']} is unknown")
    if len(s["place"]) != 3 or s["place"][0] != "attachment":
        raise ValueError("the image isn't attached")
    at, n = int(s["place"][1]), int(s["place"][2])
    if n < s["width"] * s["height"] * np.dtype(FORMATS[s["format"]]).itemsize:
        raise ValueError("the attachment is too short")
    return {"width": s["width"], "height": s["height"], "dtype": FORMATS[s["format"]], "at": at, "scale": 1.0, "zero": 0.0, "blank": None}


def encode(data: np.ndarray, keywords: dict | None = None) -> bytes:
    """A whole file, 32-bit floats."""
    h, w = data.shape
    body, at = np.ascontiguousarray(data, "<f4").tobytes(), 4096
    keys = "".join(f'<FITSKeyword name="{k}" value="{v}" comment=""/>' for k, v in (keywords or {}).items())
    xml = f'<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0"><Image geometry="{w}:{h}:1" sampleFormat="Float32" location="attachment:{at}:{len(body)}">{keys}</Image></xisf>'.encode()
    if 16 + len(xml) > at:
        raise ValueError("too many keywords")
    return (SIGNATURE + len(xml).to_bytes(4, "little") + b"\0" * 4 + xml).ljust(at, b"\0") + body
