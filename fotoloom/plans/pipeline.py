"""The whole run as lazy steps: discover, enrich, deduplicate, plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.bits import hex_to_long
from ..operators.cluster import duplicate_sets, star_sets
from ..operators.dispatch import media_sets
from ..operators.select import roles, summary
from ..sources.discovery import discover, file_stats
from ..staging import stage
from .transfer import carry_out, transfer_plan


@dataclass(frozen=True)
class Media:
    """Files with the columns of ``schema.SCORED``, ``file_path``, ``created_at``, ``phash`` and maybe ``error``.

    With a column ``frames`` (arrays of ts and hash, null or empty for images) sets are made by full similarity; without one, by first hashes.
    """

    files: DataFrame
    config: EngineConfig = EngineConfig()

    @classmethod
    def discover(cls, spark: SparkSession, paths: list[str], config: EngineConfig = EngineConfig()) -> Media:
        return cls(file_stats(discover(spark, paths, with_content=True), config.stats.max_chunk).drop("content"), config)

    def enrich(self, metadata: DataFrame, hashes: DataFrame) -> Media:
        """Joins metadata and hashes by path; a file that lacks either gets an error (an earlier one of its own counts first) and goes on."""
        joined = self.files.join(metadata.withColumn("_described", F.lit(True)), "file_path", "left").join(hashes.withColumn("_hashed", F.lit(True)), "file_path", "left")
        lacks = F.when(F.col("_described").isNull(), "ExternalToolError: no metadata").when(F.col("_hashed").isNull(), "HashingError: no hash")
        own = F.col("error") if "error" in self.files.columns else F.lit(None).cast("string")
        return Media(joined.withColumn("error", F.coalesce(own, lacks)).drop("_described", "_hashed"), self.config)

    @property
    def valid(self) -> DataFrame:
        good = self.files.where("error IS NULL") if "error" in self.files.columns else self.files
        return good.withColumn("bits", hex_to_long(F.col("phash"))).withColumn("is_video", F.coalesce(F.col("duration"), F.lit(0.0)) > 0)

    @property
    def errors(self) -> DataFrame:
        return self.files.where("error IS NOT NULL") if "error" in self.files.columns else self.files.limit(0)

    def deduplicate(self) -> Deduplicated:
        cfg = self.config.similarity
        if cfg.cluster_mode == "greedy_star":
            sets = star_sets(self.valid, cfg).select("file_path", "set_id")
        elif "frames" in self.files.columns:
            sets = media_sets(self.valid, cfg)
        else:
            sets = duplicate_sets(self.valid, cfg)
        placed, _ = stage(roles(self.valid, stage(sets, "sets")[0], cfg), "roles")
        return Deduplicated(self, placed)


@dataclass(frozen=True)
class Deduplicated:
    media: Media
    placed: DataFrame

    def summary(self) -> DataFrame:
        return summary(self.placed)

    def plan(self) -> DataFrame:
        return transfer_plan(self.media.valid, self.placed, self.media.config.transfer, self.media.errors)

    def transfer(self, dry_run: bool = True) -> DataFrame:
        return carry_out(self.plan(), dry_run)
