"""Scores, ranks and roles inside duplicate sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SimilarityConfig
from ..functions.metadata import quality, score

ROLES = ("unique", "representative", "duplicate", "error")


def scored(files: DataFrame) -> DataFrame:
    return files.withColumn("score", score())


def ranked(members: DataFrame) -> DataFrame:
    """``rank`` in each set by score, best first, ties by path."""
    return members.withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("score"), "file_path")))


def best_of_sets(members: DataFrame) -> DataFrame:
    """(set_id, best, best_score); only one row of each set and partition is shuffled."""
    return ranked(members).where("rank = 1").select("set_id", F.col("file_path").alias("best"), F.col("score").alias("best_score"))


def captures(members: DataFrame, cfg: SimilarityConfig) -> DataFrame:
    """(set_id, file_path): images of sets whose best file is a video that are worth keeping beside it.

    An image qualifies if its area is at least the video's and it is dated if the video is; scanned by score, it
    is skipped if it has no hash or is as similar as the image threshold to one already chosen. Of images with
    one hash only the first can be chosen, so the scan sees distinct hashes; where the threshold
    admits no differing bit that alone decides and no Python runs.
    """
    best = ranked(members).where("rank = 1").select("set_id", F.col("is_video").alias("bv"), quality(F.col("width"), F.col("height")).alias("bq"), F.col("image_date").isNotNull().alias("bd"), F.col("file_path").alias("bp"))
    fit = members.join(best.where("bv"), "set_id").where(
        ~F.col("is_video") & (F.col("file_path") != F.col("bp")) & (quality(F.col("width"), F.col("height")) >= F.col("bq")) & (~F.col("bd") | F.col("image_date").isNotNull()) & F.col("bits").isNotNull()
    )
    order = Window.partitionBy("set_id", "bits").orderBy(F.desc("score"), "file_path")
    first = fit.select("set_id", "file_path", "bits", "score", F.row_number().over(order).alias("n")).where("n = 1").drop("n")
    bound = cfg.max_distance(cfg.image)
    if bound == 0:
        return first.select("set_id", "file_path")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "file_path"], ascending=[False, True])
        bits = pdf["bits"].to_numpy().astype(np.int64).view(np.uint64)
        chosen = np.zeros(len(bits), bool)
        for i, own in enumerate(bits):
            chosen[i] = not (np.bitwise_count(bits[:i][chosen[:i]] ^ own) <= bound).any()
        return pdf.loc[chosen, ["set_id", "file_path"]]

    return first.groupBy("set_id").applyInPandas(scan, "set_id string, file_path string")


def roles(files: DataFrame, sets: DataFrame, cfg: SimilarityConfig, errors: DataFrame | None = None) -> DataFrame:
    """(file_path, set_id, role, rank, score): every file once.

    In a set the best file and, beside a video, its captures are representatives, the rest duplicates; files
    in no set are unique. A set with a file in ``errors`` keeps its members, as 'error'.
    """
    members = scored(files).join(sets, "file_path")
    order = ranked(members)
    chosen = captures(members, cfg).select("set_id", "file_path", F.lit(True).alias("chosen"))
    placed = order.join(chosen, ["set_id", "file_path"], "left")
    role = F.when((F.col("rank") == 1) | F.col("chosen"), "representative").otherwise("duplicate")
    if errors is not None:
        bad = sets.join(errors.select("file_path"), "file_path", "left_semi").select("set_id", F.lit(True).alias("bad")).distinct()
        placed = placed.join(bad, "set_id", "left")
        role = F.when(F.col("bad"), "error").otherwise(role)
    inside = placed.select("file_path", "set_id", role.alias("role"), "rank", "score")
    alone = scored(files).join(sets, "file_path", "left_anti").select("file_path", F.lit(None).cast("string").alias("set_id"), F.lit("unique").alias("role"), F.lit(None).cast("int").alias("rank"), "score")
    return inside.unionByName(alone)


def summary(placed: DataFrame) -> DataFrame:
    """One row of totals."""
    count = lambda r: F.count_if(F.col("role") == r)
    return placed.agg(F.count("*").alias("n_files"), count("unique").alias("n_unique"), F.count_distinct("set_id").alias("n_sets"), count("representative").alias("n_representatives"), count("duplicate").alias("n_duplicates"), count("error").alias("n_errors"))
