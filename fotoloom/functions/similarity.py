"""Similarity of images, of an image and a video, and of videos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SimilarityConfig
from .bits import hamming, hamming_binary


def image_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    """1 - differing bits / bits of two integer hashes; 0 where one is missing."""
    return F.coalesce(1 - hamming(a, b) / F.lit(float(bits)), F.lit(0.0))


def image_similarity_binary(a: Column, b: Column) -> Column:
    """The same for byte strings: the length is that of the first; two empty ones are equal."""
    n = F.length(a) * 8
    return F.when(a.isNull() | b.isNull(), 0.0).when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - hamming_binary(a, b) / n))


def image_video_similarity(image: Column, frames: Column, bits: int = 64) -> Column:
    """The best similarity of the image's hash to any frame's; 0 where a side is empty."""
    return F.coalesce(F.array_max(F.transform(frames, lambda f: image_similarity(image, f, bits))), F.lit(0.0))


def _cost(a: Column, b: Column, bits: int) -> Column:
    """A missing hash costs 1, also against another missing one."""
    return F.coalesce(hamming(a, b) / F.lit(float(bits)), F.lit(1.0))


def dtw_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    """Dynamic time warping of two arrays of hashes: 1 - cost of the best path / longer length.

    Rows of the table are carried by nested folds, so that everything stays on the JVM.
    """
    n = F.size(b)
    far = F.lit(float("inf"))
    first = F.concat(F.array(F.lit(0.0)), F.array_repeat(far, n))

    def row(before: Column, x: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            best = F.least(F.get(before, j - 1), F.get(before, j), F.element_at(now, -1))
            return F.concat(now, F.array(_cost(x, F.get(b, j - 1), bits) + best))

        return F.aggregate(F.sequence(F.lit(1), n), F.array(far), cell)

    total = F.element_at(F.aggregate(a, first, row), -1)
    known = F.greatest(F.lit(0.0), 1 - total / F.greatest(F.size(a), n))
    return F.when((F.size(a) == 0) & (n == 0), 1.0).when((F.size(a) == 0) | (n == 0), 0.0).otherwise(known)


def pair_threshold(video_a: Column, video_b: Column, cfg: SimilarityConfig) -> Column:
    """The threshold for a pair by whether each is a video."""
    return F.when(video_a & video_b, cfg.video).when(video_a | video_b, cfg.image_video).otherwise(cfg.image)


def pair_max_distance(video_a: Column, video_b: Column, cfg: SimilarityConfig, bits: int = 64) -> Column:
    """The same as a bound on differing bits, which a join can filter on."""
    d = lambda t: F.lit(cfg.max_distance(t, bits))
    return F.when(video_a & video_b, d(cfg.video)).when(video_a | video_b, d(cfg.image_video)).otherwise(d(cfg.image))
