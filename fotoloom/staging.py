"""Tables that are read more than once, written to the folder driver and executors share.

The folder is the session's ``spark.checkpoint.dir``; one of our own is used only where
the session names none (tests). A staged table cuts the lineage and outlives lost executors.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_root(spark: SparkSession) -> str:
    """The shared folder. Without the setting, a folder of this machine will do only where this machine is all there is."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return root


def new_path(spark: SparkSession, label: str) -> str:
    """A place below the shared folder that nothing else uses."""
    return f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables nobody reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables, and let Spark's cleaner see which shuffles are dead, so that executors can drop their files."""
    drop(spark, *paths)
    gc.collect()
    spark._jvm.System.gc()


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` (cheap to read) was counted and has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
