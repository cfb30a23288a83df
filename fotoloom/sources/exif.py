"""Tags of image files, read from their first bytes: size from the format's header, the rest from Exif.

A small reader for JPEG, PNG and TIFF-based files; whatever it can't read is simply absent. Rows that come from
another tool can be used instead: the engine only needs a map of tag texts.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag numbers of the Exif standard.
IMAGE_TAGS = {0x0110: "Model", 0x0100: "ImageWidth", 0x0101: "ImageHeight"}
EXIF_TAGS = {0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight"}
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825
FORMATS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 7: "B", 9: "i", 10: "ii"}


def _directory(data: bytes, at: int, order: str) -> dict[int, object]:
    """The entries of a TIFF directory: texts, numbers, or tuples of them."""
    out: dict[int, object] = {}
    if at + 2 > len(data):
        return out
    (n,) = struct.unpack_from(order + "H", data, at)
    for i in range(n):
        entry = at + 2 + 12 * i
        if entry + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        code = FORMATS.get(kind)
        if code is None or count > 10_000:
            continue
        size = struct.calcsize(order + code) * count
        where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        if where + size > len(data):
            continue
        if kind == 2:
            out[tag] = data[where : where + count].split(b"\0")[0].decode("utf-8", "replace").strip()
        else:
            values = struct.unpack_from(order + code * count, data, where)
            if len(code) == 2:
                values = tuple(a / b if b else 0.0 for a, b in zip(values[::2], values[1::2]))
            out[tag] = values[0] if len(values) == 1 else values
    return out


def _degrees(parts: object, side: object) -> str | None:
    if not isinstance(parts, tuple) or len(parts) != 3:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return repr(-value if side in ("S", "W") else value)


def tiff_tags(data: bytes) -> dict[str, str]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return {}
    first = _directory(data, struct.unpack_from(order + "I", data, 4)[0], order)
    out = {name: str(first[t]) for t, name in IMAGE_TAGS.items() if t in first}
    if isinstance(first.get(EXIF_POINTER), int):
        more = _directory(data, first[EXIF_POINTER], order)
        out |= {name: str(more[t]) for t, name in EXIF_TAGS.items() if t in more}
    if isinstance(first.get(GPS_POINTER), int):
        gps = _directory(data, first[GPS_POINTER], order)
        for name, side, value in (("GPSLatitude", 1, 2), ("GPSLongitude", 3, 4)):
            text = _degrees(gps.get(value), gps.get(side))
            if text is not None:
                out[name] = text
    return out


def read_tags(data: bytes | None) -> dict[str, str]:
    """All known tags of a file's bytes."""
    if not data:
        return {}
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            w, h = struct.unpack_from(">II", data, 16)
            out, at = {"ImageWidth": str(w), "ImageHeight": str(h)}, 8
            while at + 8 <= len(data):
                size, kind = struct.unpack_from(">I4s", data, at)
                if kind == b"eXIf":
                    out = tiff_tags(data[at + 8 : at + 8 + size]) | out
                at += 12 + size
            return out
        if data[:2] == b"\xff\xd8":
            out, at = {}, 2
            while at + 4 <= len(data) and data[at] == 0xFF:
                marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
                if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    out |= tiff_tags(data[at + 10 : at + 2 + size])
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack_from(">HH", data, at + 5)
                    out |= {"ImageWidth": str(w), "ImageHeight": str(h)}
                if marker == 0xDA:
                    break
                at += 2 + size
            return out
        return tiff_tags(data)
    except struct.error:
        return {}


def tags_of(content: Column) -> Column:
    """A map of tag texts from a file's bytes."""

    @F.pandas_udf("map<string,string>")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: read_tags(bytes(b) if b is not None else None))

    return read(content)
