"""Deterministic stand-ins for a media library, made from the synthetic tables.

Each view is defined twice: as a DataFrame and as SQL (``WITH`` clauses) over the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phash import hash_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex16(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda b: F.lower(F.lpad(F.hex(b), 2, "0"))), "")


def m_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, bytes): the 64 components of a vector taken as an 8 x 8 block of coefficients."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND size(embedding) = 64")
    return e.select("vec_id", hash_bytes(F.transform("embedding", lambda x: x.cast("double"))).alias("bytes"))


def m_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with hashes: originals, copies that differ in a bit, exact copies; and their metadata."""
    h = m_hash(spark, sf_dir)
    bit = (F.col("vec_id") % 64).cast("int")
    flip = F.transform("bytes", lambda b, j: F.when(j == F.floor(bit / 8), b.bitwiseXOR(F.pow(F.lit(2), bit % 8).cast("int"))).otherwise(b))
    parts = [
        h.select(F.lit("v/").alias("kind"), "vec_id", "bytes", F.lit(0).alias("variant")),
        h.where("vec_id % 3 = 0").select(F.lit("n/").alias("kind"), "vec_id", flip.alias("bytes"), F.lit(1).alias("variant")),
        h.where("vec_id % 5 = 0").select(F.lit("e/").alias("kind"), "vec_id", "bytes", F.lit(2).alias("variant")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    k = F.col("k")
    rows = every.withColumn("k", F.col("vec_id") * 3 + F.col("variant"))
    ext = F.when(k % 6 == 0, ".mp4").when(k % 6 == 1, ".JPG").otherwise(".png")
    duration = F.when(k % 6 == 0, 10.5 + (k % 50)).otherwise(0.0)
    return rows.select(
        F.concat("kind", F.lit("IMG_"), F.col("vec_id").cast("string"), ext).alias("file_path"),
        _hex16(F.col("bytes")).alias("phash"),
        F.conv(_hex16(F.col("bytes")), 16, -10).cast("long").alias("bits"),
        *[(F.get("bytes", F.lit(2 * i)) * 256 + F.get("bytes", F.lit(2 * i + 1))).cast("int").alias(f"b{i + 1}") for i in range(4)],
        (1000 + k * 7919 % 5000000).alias("size"),
        (640 + k * 37 % 3000).cast("int").alias("width"),
        (480 + k * 53 % 2000).cast("int").alias("height"),
        F.when(k % 3 == 0, None).when(k % 11 == 0, 0.0).otherwise((k % 18000) / 100.0 - 90).alias("gps_latitude"),
        F.when(k % 3 == 0, None).otherwise((k % 36000) / 100.0 - 180).alias("gps_longitude"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, "").otherwise(F.concat(F.lit("Cam"), (k % 9).cast("string"))).alias("camera_model"),
        F.when(k % 7 == 0, None).otherwise(F.timestamp_seconds(1500000000 + k * 86461)).alias("image_date"),
        F.timestamp_seconds(1600000000 + k * 3607).alias("created_at"),
        duration.cast("double").alias("duration"),
        (duration > 0).alias("is_video"),
    )


M_NEAR_SQL = """
h AS (
  SELECT vec_id, list_transform(range(0, 8), lambda j: list_sum(list_transform(range(0, 8), lambda i: CASE WHEN d[8 * j + i + 1] > cut THEN (1 << i)::INTEGER ELSE 0 END))::INTEGER) AS bytes
  FROM (SELECT vec_id, d, list_sort(list_transform(d[2:64], lambda x: abs(x)))[32] AS cut
        FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64))
), every AS (
  SELECT 'v/' AS kind, vec_id, bytes, 0 AS variant FROM h
  UNION ALL SELECT 'n/', vec_id, list_transform(bytes, lambda b, j: CASE WHEN j - 1 = (vec_id % 64) // 8 THEN xor(b, (1 << ((vec_id % 64) % 8))::INTEGER) ELSE b END), 1 FROM h WHERE vec_id % 3 = 0
  UNION ALL SELECT 'e/', vec_id, bytes, 2 FROM h WHERE vec_id % 5 = 0
), near_ AS (
  SELECT *, vec_id * 3 + variant AS k, CASE WHEN (vec_id * 3 + variant) % 6 = 0 THEN 10.5::DOUBLE + ((vec_id * 3 + variant) % 50) ELSE 0.0::DOUBLE END AS duration FROM every
), m_near AS (
  SELECT kind || 'IMG_' || vec_id || CASE k % 6 WHEN 0 THEN '.mp4' WHEN 1 THEN '.JPG' ELSE '.png' END AS file_path,
         array_to_string(list_transform(bytes, lambda b: format('{:02x}', b)), '') AS phash,
         bytes[1] * 256 + bytes[2] AS b1, bytes[3] * 256 + bytes[4] AS b2, bytes[5] * 256 + bytes[6] AS b3, bytes[7] * 256 + bytes[8] AS b4,
         1000 + k * 7919 % 5000000 AS size, (640 + k * 37 % 3000)::INTEGER AS width, (480 + k * 53 % 2000)::INTEGER AS height,
         CASE WHEN k % 3 = 0 THEN NULL WHEN k % 11 = 0 THEN 0.0::DOUBLE ELSE (k % 18000) / 100.0::DOUBLE - 90 END AS gps_latitude,
         CASE WHEN k % 3 = 0 THEN NULL ELSE (k % 36000) / 100.0::DOUBLE - 180 END AS gps_longitude,
         CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Cam' || (k % 9) END AS camera_model,
         CASE WHEN k % 7 = 0 THEN NULL ELSE make_timestamp((1500000000 + k * 86461) * 1000000) END AS image_date,
         make_timestamp((1600000000 + k * 3607) * 1000000) AS created_at, duration, duration > 0 AS is_video
  FROM near_
)"""

#: The differing bits of two rows p and q of m_near.
DISTANCE_SQL = " + ".join(f"bit_count(xor(p.b{i}, q.b{i}))" for i in range(1, 5))

SCORE_SQL = (
    "(CASE WHEN duration > 0 THEN 10000 ELSE 0 END + 100 * ln(greatest(1, duration + 1)) + CASE WHEN image_date IS NOT NULL THEN 2000 ELSE 0 END"
    " + CASE WHEN coalesce(gps_latitude, 0) <> 0 AND coalesce(gps_longitude, 0) <> 0 THEN 300 ELSE 0 END + CASE WHEN coalesce(camera_model, '') <> '' THEN 200 ELSE 0 END"
    " + CASE WHEN width > 0 AND height > 0 THEN sqrt(width::BIGINT * height) ELSE 0 END + 5 * ln(size + 1))"
)


def m_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: text is content; eight kinds of names; empty texts are unreadable."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "png", "gif", "MP4", "mkv", "txt", "CR2", "mov")]), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat(F.lit("lib/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("lang"), F.lit("."), F.col("doc_id").cast("string"), F.lit("."), ext)
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    error = F.when(F.length(content) % 97 == 0, "FileSystemError: unreadable")
    return d.select("doc_id", path.alias("file_path"), content.alias("content"), F.length(content).cast("long").alias("size"), error.alias("error"))


M_FILES_SQL = """
m_files AS (
  SELECT doc_id, 'lib/' || coalesce(source, 'none') || '/' || lang || '.' || doc_id || '.' || (['jpg', 'png', 'gif', 'MP4', 'mkv', 'txt', 'CR2', 'mov'])[doc_id % 8 + 1] AS file_path,
         coalesce(text, '') AS text, octet_length(encode(coalesce(text, '')))::BIGINT AS size,
         CASE WHEN octet_length(encode(coalesce(text, ''))) % 97 = 0 THEN 'FileSystemError: unreadable' END AS error
  FROM documents
)"""


def m_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, duration, ts, scene, hash): a user's events as the frames of a video, hashes of 16 bits."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    seconds = lambda c: (F.unix_micros(c.cast("timestamp")) / F.lit(1000000.0)) / 3600.0  # noqa: E731  an hour is a second of film
    code = F.conv(F.substring(F.md5(F.concat("event_type", (F.col("event_id") % 16).cast("string"))), 1, 4), 16, 10).cast("long")
    return e.join(first, "user_id").select(
        F.concat(F.lit("film/"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("file_path"),
        (seconds(F.col("t1")) - seconds(F.col("t0"))).alias("duration"), (seconds(F.col("ts")) - seconds(F.col("t0"))).alias("ts"),
        ((F.col("event_id") * 7 % 100) / 1000.0).alias("scene"), F.when(F.col("event_id") % 23 == 0, None).otherwise(code).alias("hash"),
    )


M_FRAMES_SQL = """
spans AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1 FROM events GROUP BY user_id),
m_frames AS (
  SELECT 'film/' || user_id || '.mp4' AS file_path,
         (epoch_us(t1) / 1000000.0::DOUBLE) / 3600.0::DOUBLE - (epoch_us(t0) / 1000000.0::DOUBLE) / 3600.0::DOUBLE AS duration,
         (epoch_us(ts) / 1000000.0::DOUBLE) / 3600.0::DOUBLE - (epoch_us(t0) / 1000000.0::DOUBLE) / 3600.0::DOUBLE AS ts,
         (event_id * 7 % 100) / 1000.0::DOUBLE AS scene,
         CASE WHEN event_id % 23 = 0 THEN NULL ELSE ('0x' || substr(md5(event_type || (event_id % 16)), 1, 4))::BIGINT END AS hash
  FROM events JOIN spans USING (user_id)
)"""
