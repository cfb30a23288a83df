"""Path templates, compiled once on the driver into one column expression.

Dates come from the image (``I.``), the file (``F.``) or the image if it has one (``D.``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import has_location
from ..functions.paths import basename, extension, stem

# The date placeholders and the formats that give them.
DATE_FORMATS = {
    "YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "DD": "dd", "D": "d", "DDDD": "EEEE", "DDD": "EEE",
    "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "a": None, "A": "a", "WW": None,
}
OTHER_KEYS = "NAME NAME.L NAME.U EXT RND GEO CAM TYPE HAS.GEO HAS.CAM HAS.DATE".split()
KEYS = [f"{p}.{k}" for p in "IFD" for k in DATE_FORMATS] + OTHER_KEYS


def parse(template: str) -> list[tuple[bool, str]]:
    """(is a known placeholder, text) parts; unknown placeholders are text."""
    out, at = [], 0
    for m in re.finditer(r"\{([^{}]*)\}", template):
        if m[1] in KEYS:
            out += [(False, template[at : m.start()]), (True, m[1])]
            at = m.end()
    return [p for p in [*out, (False, template[at:])] if p[1] or p[0]]


def _date(which: str, key: str) -> Column:
    image, file = F.col("image_date"), F.col("created_at")
    d = {"I": image, "F": file, "D": F.coalesce(image, file)}[which]
    if key == "WW":
        text = F.lpad(F.weekofyear(d).cast("string"), 2, "0")
    elif key == "a":
        text = F.lower(F.date_format(d, "a"))
    else:
        text = F.date_format(d, DATE_FORMATS[key])
    return F.coalesce(text, F.lit(""))


def two_decimals(x: Column) -> Column:
    """Rounded half up as decimals, so that every engine prints the same digits."""
    return x.cast("decimal(20,6)").cast("decimal(20,2)").cast("string")


def random_suffix(path: Column, seed: str) -> Column:
    """Eight hex digits that depend on the path and the seed alone."""
    return F.substring(F.md5(F.concat(path, F.lit(f"|{seed}"))), 1, 8)


def value(key: str, seed: str) -> Column:
    path = F.col("file_path")
    if key[:2] in ("I.", "F.", "D.") and key[2:] in DATE_FORMATS:
        return _date(key[0], key[2:])
    located, camera = has_location(F.col("gps_latitude"), F.col("gps_longitude")), F.coalesce(F.col("camera_model"), F.lit(""))
    return {
        "NAME": lambda: stem(path),
        "NAME.L": lambda: F.lower(stem(path)),
        "NAME.U": lambda: F.upper(stem(path)),
        "EXT": lambda: dotted_extension(path),
        "RND": lambda: random_suffix(path, seed),
        "GEO": lambda: F.when(located, F.concat_ws("_", two_decimals(F.col("gps_latitude")), two_decimals(F.col("gps_longitude")))).otherwise(""),
        "CAM": lambda: camera,
        "TYPE": lambda: F.when(F.col("duration") > 0, "Video").otherwise("Image"),
        "HAS.GEO": lambda: F.when(located, "GeoTagged").otherwise("NoGeo"),
        "HAS.CAM": lambda: F.when(camera != "", "WithCamera").otherwise("NoCamera"),
        "HAS.DATE": lambda: F.when(F.col("image_date").isNotNull(), "Dated").otherwise("NoDate"),
    }[key]()


def dotted_extension(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, r'[<>:"|?*]', "_")


def compile_template(template: str, target_dir: str, seed: str = "0") -> Column:
    """The target path of a row, before conflicts are settled."""
    parts = [(_clean(value(t, seed)) if t != "EXT" else value(t, seed)) if known else F.lit(t) for known, t in parse(template)]
    filled = F.concat(*parts) if parts else F.lit("")
    tidy = F.regexp_replace(F.regexp_replace(filled, r"[/\\]+", "/"), "^/|/$", "")
    tidy = F.when(tidy == "", "NoDate").otherwise(tidy)
    path, ext = F.col("file_path"), dotted_extension(F.col("file_path"))
    if "{NAME" in template or "{EXT}" in template:  # the last part names the file
        name = basename(tidy)
        folder = F.regexp_extract(tidy, "^(.*)/[^/]*$", 1)
        name = F.when(F.endswith(F.lower(name), F.lower(ext)), name).otherwise(F.concat(name, ext))
    else:
        name, folder = basename(path), tidy
    name = F.regexp_replace(name, r'[<>:"|?*/\\]', "_")
    root = F.lit(target_dir.rstrip("/"))
    return F.when(folder == "", F.concat_ws("/", root, name)).otherwise(F.concat_ws("/", root, folder, name))


def settle_conflicts(planned: DataFrame, seed: str = "0") -> DataFrame:
    """The first path (in order) of a target keeps it, the others get a suffix before the extension."""
    n = F.row_number().over(Window.partitionBy("target").orderBy("file_path"))
    ext = dotted_extension(F.col("target"))
    head = F.expr("left(target, length(target) - length(_ext))")
    renamed = F.concat(head, F.lit("_"), random_suffix(F.col("file_path"), f"{seed}|conflict"), F.col("_ext"))
    out = planned.withColumn("_n", n).withColumn("_ext", ext)
    return out.withColumn("target", F.when(F.col("_n") > 1, renamed).otherwise(F.col("target"))).drop("_n", "_ext")
