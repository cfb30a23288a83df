"""The catalog: one row per file, upserts by path and keyed look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import from_hex, to_hex
from ..functions.phash import lsh_keys


def to_rows(infos: DataFrame) -> DataFrame:
    """Catalog rows of file infos; only the first frame's hash is stored."""
    phash = F.when(F.size("frames") > 0, to_hex(F.get(F.col("frames"), F.lit(0))["hash"]))
    keys = lsh_keys(F.col("phash"))
    flat = infos.withColumn("phash", phash)
    names = {"width": "image_width", "height": "image_height", "duration": "media_duration"}
    plain = ["file_path", "size", "created_at", "modified_at", "width", "height", "gps_latitude", "gps_longitude", "camera_model", "image_date", "duration"]
    return flat.select(to_hex(F.col("content_hash")).alias("content_hash"), *[F.col(c).alias(names.get(c, c)) for c in plain], "phash", *[keys[i].alias(f"lsh_key{i + 1}") for i in range(4)])


def to_infos(rows: DataFrame) -> DataFrame:
    """File infos of catalog rows: missing sizes are 0, missing times the epoch, a missing hash no frame."""
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0).cast(t))
    epoch = F.timestamp_millis(F.lit(0))
    dated = F.when(F.unix_millis("image_date") != 0, F.col("image_date"))
    frame = F.array(F.struct(from_hex(F.col("phash")).alias("hash"), F.lit(0.0).alias("timestamp")))
    return rows.select(
        "file_path", from_hex(F.col("content_hash")).alias("content_hash"), zero("size", "bigint").alias("size"),
        F.coalesce("created_at", epoch).alias("created_at"), F.coalesce("modified_at", epoch).alias("modified_at"),
        zero("image_width", "int").alias("width"), zero("image_height", "int").alias("height"), "gps_latitude", "gps_longitude", "camera_model",
        dated.alias("image_date"), zero("media_duration", "double").alias("duration"), F.when(F.col("phash").isNull(), F.slice(frame, 1, 0)).otherwise(frame).alias("frames"),
    )


def upsert(current: DataFrame, changes: DataFrame, key: str = "file_path", version: str = "modified_at") -> DataFrame:
    """The catalog after ``changes``: one row a key, a change's row in place of the current one.

    Of several changes to a key the last by ``version`` counts. Current rows of keys without a change are kept by
    an anti join, so that they are neither sorted nor compared column by column.
    """
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")
    return current.join(last.select(key), key, "left_anti").select(*current.columns).unionByName(last.select(*current.columns))


def by_path(catalog: DataFrame, path: str) -> DataFrame:
    return catalog.where(F.col("file_path") == path)


def by_paths(catalog: DataFrame, paths: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of the given paths, by a semi join; with ``columns`` only those are read."""
    some = catalog.select(*columns) if columns else catalog
    return some.join(paths.select("file_path").distinct(), "file_path", "left_semi")


def by_phash(catalog: DataFrame, phash: str) -> DataFrame:
    return catalog.where(F.col("phash") == phash)


def exact_phash_groups(catalog: DataFrame) -> DataFrame:
    """(phash, n, first_path) of hashes that more than one file has."""
    return catalog.where("phash IS NOT NULL").groupBy("phash").agg(F.count("*").alias("n"), F.min("file_path").alias("first_path")).where("n > 1")
