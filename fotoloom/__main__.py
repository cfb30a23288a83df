"""``python -m fotoloom SOURCE... DESTINATION``: discover, hash, deduplicate and transfer a library.

Images are decoded by Spark's own image source and their tags by ``sources.exif``. Frames of videos come from a
Parquet table (``--frames``: file_path, duration, ts, scene, hash), since no decoder is part of Spark.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig, FrameConfig, SimilarityConfig, StatsConfig, TransferConfig
from .functions.bits import to_hex
from .functions.metadata import exif_metadata
from .operators import memo
from .plans.pipeline import Media
from .plans.report import report_rows, write_report
from .sources import media
from .sources.discovery import discover, format_stats, read_ends
from .staging import stage


def parser() -> argparse.ArgumentParser:
    d = EngineConfig()
    p = argparse.ArgumentParser(prog="fotoloom", description=__doc__)
    p.add_argument("source", nargs="+", help="directories or files")
    p.add_argument("destination")
    p.add_argument("-e", "--error", help="directory for files that couldn't be processed")
    p.add_argument("-d", "--duplicate", help="directory for duplicates")
    p.add_argument("--debug", help="directory for the report on duplicate sets")
    p.add_argument("-c", "--concurrency", type=int, help="local threads, where no master is set")
    p.add_argument("-m", "--move", action="store_true", help="move instead of copying")
    p.add_argument("-r", "--resolution", type=int, default=d.frames.resolution)
    p.add_argument("--min-frames", type=int, default=d.frames.min_frames)
    p.add_argument("--max-scene-frames", type=int, default=d.frames.max_scene_frames)
    p.add_argument("--target-fps", type=float, default=d.frames.target_fps)
    p.add_argument("-w", "--window-size", type=int, default=d.similarity.window_size, help="accepted, without effect")
    p.add_argument("-p", "--step-size", type=float, default=d.similarity.step_size)
    p.add_argument("-F", "--format", default=d.transfer.template)
    p.add_argument("--scene-change-threshold", type=float, default=d.frames.scene_change_threshold)
    p.add_argument("--image-similarity-threshold", type=float, default=d.similarity.image)
    p.add_argument("--image-video-similarity-threshold", type=float, default=d.similarity.image_video)
    p.add_argument("--video-similarity-threshold", type=float, default=d.similarity.video)
    p.add_argument("--max-chunk-size", type=int, default=d.stats.max_chunk)
    p.add_argument("--frames", help="Parquet table of video frames")
    p.add_argument("--cache", help="directory for what was read and hashed, so that a rerun looks at new and changed files only")
    p.add_argument("--plan-only", action="store_true", help="show the plan, touch no file")
    p.add_argument("--verbose", action="store_true")
    return p


def config_of(a: argparse.Namespace) -> EngineConfig:
    return EngineConfig(
        SimilarityConfig(a.image_similarity_threshold, a.image_video_similarity_threshold, a.video_similarity_threshold, a.step_size, a.window_size),
        FrameConfig(a.resolution, a.target_fps, a.min_frames, a.max_scene_frames, a.scene_change_threshold),
        StatsConfig(a.max_chunk_size),
        TransferConfig(a.destination, a.format, a.duplicate, a.error, a.move),
    )


#: Up to so many images are decoded by name; beyond, the sources are scanned whole.
MAX_NAMED = 10_000


def read_stats(spark: SparkSession, listed: DataFrame, cfg: EngineConfig, cache: str | None) -> DataFrame:
    """``read_ends`` of the listed files; with a cache only of those that are new or changed."""
    if cache is None:
        return read_ends(listed, cfg.stats.max_chunk)
    kind = "content_hash string, tags map<string,string>"
    key = memo.stats_key(F.col("file_path"), F.col("size"), F.col("modified_at"))
    wanted = listed.select("*", F.lit("stats").alias("job"), key.alias("key"), F.lit(memo.config_hash(cfg.stats)).alias("config_hash"))
    found = stage(memo.look_up(wanted, memo.load(spark, f"{cache}/stats")), "stats-found")[0]
    fresh = stage(read_ends(found.where("NOT hit").drop("value", "hit"), cfg.stats.max_chunk), "stats-read")[0]
    memo.append(fresh.where("error IS NULL").withColumn("value", F.to_json(F.struct("content_hash", "tags"))), f"{cache}/stats")
    known = found.where("hit").withColumn("_v", F.from_json("value", kind)).select("*", "_v.*").withColumn("error", F.lit(None).cast("string")).withColumn("created_at", F.col("modified_at"))
    columns = [*listed.columns, "content_hash", "tags", "error", "created_at"]
    return known.select(*columns).unionByName(fresh.select(*columns))


def read_hashes(spark: SparkSession, files: DataFrame, sources: list[str], cfg: EngineConfig, cache: str | None) -> DataFrame:
    """(file_path, phash) of images; with a cache only contents that were not hashed at this resolution before are decoded."""
    decode = lambda paths: media.image_hashes(media.gray_rasters(spark, paths, cfg.frames), cfg.frames.resolution).select("file_path", "phash")
    if cache is None:
        return decode(sources)
    wanted = files.where("type = 1 AND content_hash IS NOT NULL").select("file_path", F.lit("phash").alias("job"), F.col("content_hash").alias("key"), F.lit(memo.config_hash(cfg.frames, ("resolution",))).alias("config_hash"))
    found = stage(memo.look_up(wanted, memo.load(spark, f"{cache}/phash")), "phash-found")[0]
    known, missing = found.where("hit").select("file_path", F.col("value").alias("phash")), found.where("NOT hit").drop("value", "hit")
    named = [r.file_path for r in missing.select("file_path").limit(MAX_NAMED + 1).collect()]
    if not named:
        return known
    made = decode(named if len(named) <= MAX_NAMED else sources)
    fresh = stage(missing.join(made, "file_path").where("phash IS NOT NULL"), "phash-made")[0]
    memo.append(fresh.dropDuplicates(["key"]).withColumn("value", F.col("phash")), f"{cache}/phash")
    return known.unionByName(fresh.select("file_path", "phash"))


def gathered(spark: SparkSession, sources: list[str], cfg: EngineConfig, frames: str | None = None, cache: str | None = None) -> DataFrame:
    """One row a file: stats, metadata, first hash, duration, frames of videos if given, and the first error met: of
    reading, then of decoding."""
    read = stage(read_stats(spark, discover(spark, sources), cfg, cache), "read")[0]
    rows = read.select("*", exif_metadata(F.col("tags")).alias("_m")).select("*", "_m.*").drop("tags", "_m")
    rows = rows.join(read_hashes(spark, read, sources, cfg, cache), "file_path", "left").withColumn("duration", F.lit(0.0))
    if frames is not None:
        shown = media.video_frames(spark.read.parquet(frames), cfg.frames)
        first = F.when(F.size("frames") > 0, to_hex(F.get(F.col("frames"), F.lit(0))["hash"]))
        rows = rows.drop("duration").join(shown.select("file_path", F.col("duration").alias("_d"), "frames", first.alias("_h")), "file_path", "left")
        rows = rows.withColumn("phash", F.coalesce("phash", "_h")).withColumn("duration", F.coalesce("_d", F.lit(0.0))).drop("_d", "_h")
    failed = (F.col("type") == 1) & F.col("phash").isNull()
    return rows.withColumn("error", F.coalesce("error", F.when(failed, "ExternalToolError: the image can't be decoded")))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("fotoloom").config("spark.sql.session.timeZone", "UTC")
    if a.concurrency:
        builder = builder.master(f"local[{a.concurrency}]")
    spark = builder.getOrCreate()
    cfg = config_of(a)
    files = stage(gathered(spark, a.source, cfg, a.frames, a.cache), "gathered")[0]
    format_stats(files).show(100, truncate=False)
    done = Media(files, cfg).deduplicate()
    done.summary().show(truncate=False)
    if a.debug:
        write_report(report_rows(done.placed), a.debug)
    result = done.transfer(dry_run=a.plan_only)
    if a.plan_only or a.verbose:
        result.show(1000, truncate=False)
        return 0
    failed = result.where("error IS NOT NULL").count()
    print(f"{failed} files could not be transferred" if failed else "done")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
