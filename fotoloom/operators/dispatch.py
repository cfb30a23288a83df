"""Similarity of any two media: images by their hash, an image and a video by the best frame, videos by time warping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SimilarityConfig
from ..functions.similarity import image_similarity, image_video_similarity, pair_threshold
from ..staging import stage
from .candidates import lsh_candidates
from .components import components
from .frames import video_similarity


def media_similarity(pairs: DataFrame, files: DataFrame, cfg: SimilarityConfig) -> DataFrame:
    """(a, b, similarity, threshold) for pairs (a, b) of files (file_path, bits, is_video, duration, frames)."""
    side = lambda n: files.select(F.col("file_path").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("bits", "is_video", "duration", "frames")])
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    hashes = lambda c: F.transform(c, lambda f: f["hash"])
    video_a, video_b = F.col("is_video_a"), F.col("is_video_b")
    plain = both.where(~(video_a & video_b))
    one = F.when(video_a, image_video_similarity(F.col("bits_b"), hashes("frames_a"))).when(video_b, image_video_similarity(F.col("bits_a"), hashes("frames_b"))).otherwise(image_similarity(F.col("bits_a"), F.col("bits_b")))
    scored = plain.select("a", "b", one.alias("similarity"), pair_threshold(video_a, video_b, cfg).alias("threshold"))
    warped = video_similarity(both.where(video_a & video_b).select("a", "b", "duration_a", "duration_b", "frames_a", "frames_b"), cfg.step_size)
    return scored.unionByName(warped.select("a", "b", "similarity", F.lit(cfg.video).alias("threshold")))


def media_sets(files: DataFrame, cfg: SimilarityConfig) -> DataFrame:
    """(file_path, set_id) of files in sets of at least two, by full similarity; ``files`` as for ``media_similarity``, with phash.

    Files that show the same (images of one hash, videos of equal frames) stand for each other, so that copies never multiply
    pairs; the others are compared where they share an LSH key of their first hash.
    """
    known = files.where("phash IS NOT NULL")
    shown = F.when(F.col("is_video"), F.xxhash64(F.col("duration"), F.transform("frames", lambda f: F.struct(f["ts"], f["hash"])))).otherwise(F.col("bits"))
    named = known.select("file_path", "is_video", shown.alias("shown"))
    first = named.groupBy("is_video", "shown").agg(F.min("file_path").alias("first"))
    follows = stage(named.join(first, ["is_video", "shown"]).select("file_path", "first"), "media-same")[0]
    heads = known.join(follows.where("file_path = first").select("file_path"), "file_path", "left_semi")
    near = lsh_candidates(heads).where("a < b")
    similar = media_similarity(near, known, cfg).where("similarity >= threshold").select("a", "b")
    edges = similar.unionByName(follows.where("file_path <> first").select(F.col("first").alias("a"), F.col("file_path").alias("b")))
    return components(edges).select(F.col("id").alias("file_path"), F.col("label").alias("set_id"))
