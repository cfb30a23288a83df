"""Files that arrive as a stream: deduplicated by content, upserted by micro-batch.

Each batch writes a new version of the catalog beside the old one, named by the batch's number,
so that a batch that is run again after a failure writes the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.metadata import partial_md5
from ..sources.catalog import upsert


def arriving(files: DataFrame, max_chunk: int, delay: str = "1 hour") -> DataFrame:
    """A stream of (file_path, content, modified_at) without repeats of a content inside the delay."""
    hashed = files.withColumn("content_hash", partial_md5(F.col("content"), max_chunk)).drop("content")
    return hashed.withWatermark("modified_at", delay).dropDuplicatesWithinWatermark(["content_hash"])


def format_counts(files: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts by format and window of a stream with (modified_at, ext)."""
    return files.withWatermark("modified_at", delay).groupBy(F.window("modified_at", window), "ext").agg(F.count("*").alias("n"))


def gather_stream(rows: DataFrame, catalog_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Upsert a stream of catalog rows into versions ``catalog_dir/v=<batch>``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, catalog_dir, number)
        new = upsert(old, batch) if old is not None else upsert(batch.limit(0), batch)
        new.write.mode("overwrite").parquet(f"{catalog_dir}/v={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def current(spark: SparkSession, catalog_dir: str, below: int | None = None) -> DataFrame | None:
    """The newest complete version, or the newest below a number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(catalog_dir)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    versions = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{catalog_dir}/{n}/_SUCCESS"))]
    versions = [v for v in versions if below is None or v < below]
    return spark.read.parquet(f"{catalog_dir}/v={max(versions)}") if versions else None
