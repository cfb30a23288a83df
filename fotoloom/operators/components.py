"""Connected components of an edge table, by joins only.

Every vertex carries the smallest label seen; each round takes the smallest label among
neighbours and then the label of that label (pointer jumping), so that chains shrink
by powers. Rounds are written to the shared folder. Nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop, stage


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every vertex of (a, b): label is the smallest id of its component."""
    spark = edges.sparkSession
    both, p_edges = stage(edges.select("a", "b").union(edges.select("b", "a")).toDF("id", "other").where("id <> other").distinct(), "edges")
    labels, path = stage(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("root"))
        new, new_path = stage(step.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("root", "label")).alias("label")), "labels")
        done = new.where("was <> label").isEmpty()
        drop(spark, path)
        labels, path = new.select("id", "label"), new_path
        if done:
            drop(spark, p_edges)
            return labels


def merge_sets(members: DataFrame) -> DataFrame:
    """(set_id, member) with overlapping sets united; set_id becomes the smallest member."""
    named = members.where("member IS NOT NULL").groupBy("set_id").agg(F.min("member").alias("a"))
    edges = members.join(named, "set_id").select("a", F.col("member").alias("b"))
    single = members.select("member").distinct()
    labels = components(edges)
    out = single.join(labels.select(F.col("id").alias("member"), "label"), "member", "left")
    return out.select(F.coalesce("label", "member").alias("set_id"), "member")
