"""Discovery: directory trees as a DataFrame of files, and their counts by format."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import partial_md5
from ..functions.paths import ALL_PATTERN, IMAGE, VIDEO, extension, file_type
from .exif import read_tags


def discover(spark: SparkSession, paths: list[str], with_content: bool = False) -> DataFrame:
    """(file_path, size, modified_at[, content]) of supported files below the paths (files or directories).

    Content is read only if asked for; then a file that can't be read fails the job. ``read_ends`` reads no more than it needs and
    turns such files into errors.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = reader.option("pathGlobFilter", ALL_PATTERN).load(paths)
    path = F.regexp_replace("path", "^file:/+", "/")
    columns = [path.alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")]
    return supported(found.select(*columns, *(["content"] if with_content else [])))


def supported(files: DataFrame) -> DataFrame:
    """Only files of supported types, with lower-cased ``ext`` and ``type`` (0 video, 1 image)."""
    return files.withColumn("ext", F.lower(extension(F.col("file_path")))).withColumn("type", file_type(F.col("file_path"))).where("type IS NOT NULL")


def file_stats(files: DataFrame, max_chunk: int) -> DataFrame:
    """Adds the content hash; creation time is not known to Spark's reader and falls back to modification."""
    return files.withColumn("content_hash", partial_md5(F.col("content"), max_chunk)).withColumn("created_at", F.col("modified_at"))


def _ends(path: str, max_chunk: int) -> tuple[str, bytes]:
    """The hash that ``partial_md5`` gives, and the head of the file, reading head and tail only of long files."""
    k, size = max(1, max_chunk // 2), os.path.getsize(path)
    with open(path, "rb") as f:
        if size <= max_chunk or size < 2 * k:
            data = f.read()
            return hashlib.md5(data).hexdigest(), data
        head = f.read(k)
        f.seek(-k, os.SEEK_END)
        return hashlib.md5(head + f.read(k)).hexdigest(), head


def read_ends(files: DataFrame, max_chunk: int) -> DataFrame:
    """Adds content_hash, tags, created_at and error to (file_path, modified_at, ...) of a file system that all executors share.

    A file that can't be read has an error and nothing else. Of long files only the ends are read, and tags from the head.
    """
    added = [("content_hash", "string"), ("tags", "map<string,string>"), ("error", "string")]
    kept = files.drop(*(n for n, _ in added), "created_at")

    def run(batches):
        for batch in batches:
            hashes, tags, errors = [], [], []
            for path in batch.column("file_path").to_pylist():
                try:
                    digest, head = _ends(path, max_chunk)
                    hashes.append(digest)
                    tags.append(list(read_tags(head).items()))
                    errors.append(None)
                except OSError as e:
                    hashes.append(None)
                    tags.append(None)
                    errors.append(f"FileSystemError: {e}")
            yield pa.record_batch([*batch.columns, pa.array(hashes, pa.string()), pa.array(tags, pa.map_(pa.string(), pa.string())), pa.array(errors, pa.string())], names=[*batch.schema.names, *(n for n, _ in added)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + ", ".join(f"{n} {t}" for n, t in added)
    return kept.mapInArrow(run, schema).withColumn("created_at", F.col("modified_at"))


def format_stats(files: DataFrame) -> DataFrame:
    """(type, ext, n, n_errors) for each format, videos first and frequent formats first, and the total (null)."""
    errors = F.count_if(F.col("error").isNotNull()) if "error" in files.columns else F.lit(0).cast("long")
    per = files.groupBy("type", "ext").agg(F.count("*").alias("n"), errors.alias("n_errors"))
    total = per.agg(F.lit(None).cast("int").alias("type"), F.lit(None).cast("string").alias("ext"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_errors"), F.lit(0)).alias("n_errors"))
    return per.unionByName(total).orderBy(F.asc_nulls_last("type"), F.desc("n"), "ext")


__all__ = ["IMAGE", "VIDEO", "discover", "file_stats", "format_stats", "supported"]
