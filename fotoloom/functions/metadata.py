"""EXIF tags to metadata, and the score that ranks files of a set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exif_date(s: Column) -> Column:
    """A timestamp from the first ``YYYY:MM:DD`` of a tag, or from any ISO text; null if neither."""
    return F.regexp_replace(s, r"^(.*?)(\d{4}):(\d{2}):(\d{2})", "$1$2-$3-$4").try_cast("timestamp")


def exif_metadata(tags: Column) -> Column:
    """A struct of the metadata columns from a map of tag texts."""
    get = lambda name: tags[name]
    either = lambda a, b: F.coalesce(F.nullif(get(a).try_cast("int"), F.lit(0)), F.nullif(get(b).try_cast("int"), F.lit(0)), F.lit(0))
    return F.struct(
        either("ImageWidth", "ExifImageWidth").alias("width"),
        either("ImageHeight", "ExifImageHeight").alias("height"),
        get("GPSLatitude").try_cast("double").alias("gps_latitude"),
        get("GPSLongitude").try_cast("double").alias("gps_longitude"),
        get("Model").alias("camera_model"),
        F.coalesce(*[exif_date(get(t)) for t in ("DateTimeOriginal", "CreateDate", "MediaCreateDate")]).alias("image_date"),
    )


def partial_md5(content: Column, max_chunk: int) -> Column:
    """MD5 of the bytes, or of their head and tail where they are longer than ``max_chunk``."""
    k = max(1, max_chunk // 2)
    size = F.length(content)
    ends = F.concat(F.substring(content, 1, k), F.substring(content, -k, k))
    return F.md5(F.when((size > max_chunk) & (size >= 2 * k), ends).otherwise(content))


def has_location(lat: Column, lon: Column) -> Column:
    """Zero counts as missing."""
    return (F.coalesce(lat, F.lit(0.0)) != 0) & (F.coalesce(lon, F.lit(0.0)) != 0)


def quality(width: Column, height: Column) -> Column:
    return F.coalesce(width, F.lit(0)).cast("long") * F.coalesce(height, F.lit(0))


# The weights of the score.
VIDEO_POINTS, DURATION_POINTS, DATE_POINTS, LOCATION_POINTS, CAMERA_POINTS, SIZE_POINTS = 10000, 100, 2000, 300, 200, 5


def score() -> Column:
    """The score of a row with the columns of ``schema.SCORED``."""
    duration, size = F.coalesce(F.col("duration"), F.lit(0.0)), F.coalesce(F.col("size"), F.lit(0))
    points = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    area = quality(F.col("width"), F.col("height"))
    return (
        points(duration > 0, VIDEO_POINTS)
        + F.ln(F.greatest(F.lit(1.0), duration + 1)) * DURATION_POINTS
        + points(F.col("image_date").isNotNull(), DATE_POINTS)
        + points(has_location(F.col("gps_latitude"), F.col("gps_longitude")), LOCATION_POINTS)
        + points(F.coalesce(F.col("camera_model"), F.lit("")) != "", CAMERA_POINTS)
        + F.when((F.col("width") > 0) & (F.col("height") > 0), F.sqrt(area.cast("double"))).otherwise(0.0)
        + F.ln(size.cast("double") + 1) * SIZE_POINTS
    )
