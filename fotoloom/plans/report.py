"""The report on duplicate sets: pages of a thousand sets, made of rows, and an index."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .template import two_decimals

SETS_PER_PAGE = 1000


def numbered_sets(placed: DataFrame) -> DataFrame:
    """(set_id, set_no, page): sets numbered from 0 in the order of set_id.

    A global order without a global sort task: range partitions are counted, and the counts
    (one row each) give every partition its first number. They are staged, so that a partition keeps
    its number when it is read again.
    """
    sets = placed.where("set_id IS NOT NULL").select("set_id").distinct().repartitionByRange("set_id").sortWithinPartitions("set_id")
    tagged = stage(sets.withColumn("_p", F.spark_partition_id()), "report-sets")[0]
    counts = tagged.groupBy("_p").count()
    before = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inside = tagged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("set_id")) - 1)
    out = inside.join(F.broadcast(before), "_p").withColumn("set_no", F.col("_first") + F.col("_n"))
    return out.select("set_id", "set_no", F.floor(F.col("set_no") / SETS_PER_PAGE).alias("page"))


def report_rows(placed: DataFrame) -> DataFrame:
    """(page, set_no, set_id, place, file_path, role, score): members of sets by score."""
    members = placed.where("set_id IS NOT NULL").join(numbered_sets(placed), "set_id")
    place = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("score"), "file_path"))
    return members.select("page", "set_no", "set_id", place.alias("place"), "file_path", "role", "score")


def page_totals(rows: DataFrame) -> DataFrame:
    """(page, n_sets, n_representatives, n_duplicates)."""
    return rows.groupBy("page").agg(F.count_distinct("set_id").alias("n_sets"), F.count_if(F.col("role") == "representative").alias("n_representatives"), F.count_if(F.col("role") == "duplicate").alias("n_duplicates"))


def size_text(size: Column) -> Column:
    return F.concat(two_decimals(size.cast("double") / (1024 * 1024)), F.lit(" MB"))


def duration_text(seconds: Column) -> Column:
    """``h:m:ss`` without padding; leading parts of 0 are left out."""
    h, m, s = F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, F.floor(seconds % 60)
    lead = lambda x: F.when(x != 0, F.concat(x.cast("string"), F.lit(":"))).otherwise("")
    return F.concat(lead(h), lead(m), s.cast("string"), F.lit("s"))


def write_report(rows: DataFrame, folder: str) -> None:
    """``folder/page=<k>/part-*``: one HTML file a page, written by Spark; nothing is deleted first."""
    line = F.format_string('<figure class="%s"><a href="%s">%s</a><figcaption>%.2f</figcaption></figure>', "role", "file_path", "file_path", "score")
    sets = rows.withColumn("line", line).groupBy("page", "set_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    text = F.concat(F.lit("<section><h2>Duplicate set "), (F.col("set_no") + 1).cast("string"), F.lit("</h2>\n"), "body", F.lit("\n</section>"))
    head = rows.select("page").distinct().select("page", F.lit(-1).alias("set_no"), F.lit("<!DOCTYPE html><meta charset=\"utf-8\"><title>" + html.escape("Duplicate sets") + "</title>").alias("value"))
    body = sets.select("page", "set_no", text.alias("value")).unionByName(head)
    body.repartition("page").sortWithinPartitions("page", "set_no").select("page", "value").write.mode("append").partitionBy("page").text(folder)
