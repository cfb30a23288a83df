"""Content-addressed memo: results keyed by job, input key and configuration."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def config_hash(cfg, only: tuple[str, ...] | None = None) -> str:
    """A stable hash of a configuration; ``only`` names the fields that matter (images: the resolution)."""
    import hashlib

    values = asdict(cfg) if is_dataclass(cfg) else dict(cfg)
    if only is not None:
        values = {k: values[k] for k in only}
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()


def stats_key(path: Column, size: Column, modified: Column) -> Column:
    """Stats are keyed by path, size and time, so that an edited file is read again."""
    return F.concat_ws("|", path, size.cast("string"), F.unix_micros(modified).cast("string"))


def look_up(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` (job, key, config_hash, ...) with ``value`` and ``hit``; the newest entry of a key counts."""
    last = cache.groupBy("job", "key").agg(F.max_by(F.struct("config_hash", "value"), "seq").alias("_e"))
    out = wanted.join(last, ["job", "key"], "left")
    hit = F.coalesce(F.col("_e.config_hash") == F.col("config_hash"), F.lit(False))
    return out.withColumn("hit", hit).withColumn("value", F.when(hit, F.col("_e.value"))).drop("_e")


def memoize(wanted: DataFrame, cache: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """(all results, new entries to append): ``compute`` maps the misses to rows with ``value``."""
    found = look_up(wanted, cache)
    fresh = compute(found.where(~F.col("hit")).drop("value", "hit"))
    return found.where("hit").select("job", "key", "config_hash", "value").unionByName(fresh.select("job", "key", "config_hash", "value")), fresh


def load(spark: SparkSession, path: str) -> DataFrame:
    """The entries (job, key, config_hash, value, seq) kept below ``path``; none if nothing is there yet."""
    kind = "job string, key string, config_hash string, value string, seq long"
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    return spark.read.schema(kind).parquet(path) if there else spark.createDataFrame([], kind)


def append(fresh: DataFrame, path: str) -> None:
    """Keep new entries; a later one of a key counts before an earlier."""
    rows = fresh.select("job", "key", "config_hash", "value", F.unix_micros(F.current_timestamp()).alias("seq"))
    rows.write.mode("append").parquet(path)
