"""Media: rasters and frames as columns, from whatever decoder is at hand.

The engine takes ``gray`` rasters (row-major, resolution x resolution) and frame tables. Decoders are optional:
``gray_rasters`` uses Spark's image source, ``frame_times`` reads a frame filter's log.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FrameConfig
from ..functions.phash import dct_udf, hash_hex
from ..operators.frames import kept_frames, reduced_frames


def gray_rasters(spark: SparkSession, paths: list[str], cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """(file_path, gray) by Spark's image source: luma, then the mean of each cell of the grid. What can't be decoded has no row."""
    side = cfg.resolution

    @F.pandas_udf("array<double>")
    def shrink(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for h, w, c, d in zip(height, width, channels, data):
            if d is None or h <= 0 or w <= 0:
                out.append(None)
                continue
            x = np.frombuffer(d, np.uint8).reshape(h, w, c).astype(np.float64)
            x = x[:, :, 0] if c == 1 else x[:, :, :3] @ np.asarray([0.114, 0.587, 0.299])  # BGR
            rows = np.add.reduceat(x, np.minimum(np.arange(side) * h // side, h - 1), axis=0)
            cells = np.add.reduceat(rows, np.minimum(np.arange(side) * w // side, w - 1), axis=1)
            n = np.diff(np.append(np.arange(side) * h // side, h)).clip(1)[:, None] * np.diff(np.append(np.arange(side) * w // side, w)).clip(1)[None, :]
            out.append((cells / n).ravel())
        return pd.Series(out, dtype=object)

    images = spark.read.format("image").option("dropInvalid", "true").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").load(paths)
    i = F.col("image")
    return images.select(F.regexp_replace(i["origin"], "^file:/+", "/").alias("file_path"), shrink(i["height"], i["width"], i["nChannels"], i["data"]).alias("gray"))


def image_hashes(rasters: DataFrame, resolution: int) -> DataFrame:
    """Adds ``phash`` (16 hex digits) for rasters of any resolution."""
    blocks = rasters.withColumn("_dct", dct_udf(resolution)(F.col("gray")))
    return blocks.withColumn("phash", hash_hex(F.col("_dct"))).drop("_dct")


def frame_time(line: Column) -> Column:
    """The time that a frame filter's log line gives."""
    return F.regexp_extract(line, r"pts_time:([0-9.]+)", 1).try_cast("double")


def video_frames(frames: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """(file_path, duration, frames) from rows (file_path, duration, ts, scene, hash), after policy and reduction.

    A duration of 0 or less gives no frames and duration 0.
    """
    grouped = frames.groupBy("file_path").agg(F.first("duration").alias("duration"), F.array_sort(F.collect_list(F.struct("ts", "scene", "hash"))).alias("frames"))
    kept = kept_frames(F.col("frames"), F.col("duration"), cfg)
    out = grouped.withColumn("frames", kept)
    return out.select("file_path", F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0)).alias("duration"), reduced_frames(F.col("frames"), F.col("duration"), cfg).alias("frames"))
