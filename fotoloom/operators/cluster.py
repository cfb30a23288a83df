"""Clusters of similar files: components, greedy stars, density."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SimilarityConfig
from ..staging import stage
from .candidates import near_hash_pairs
from .components import components


def similar_hashes(files: DataFrame, cfg: SimilarityConfig) -> DataFrame:
    """(p, q, distance): distinct hashes of which some files of fitting types are similar.

    ``files`` has (file_path, bits, is_video). Files of equal hashes are similar by any threshold
    and need no pair; so only hashes are joined, each once.
    """
    kinds = files.where("bits IS NOT NULL").groupBy("bits").agg(F.bool_or("is_video").alias("video"), F.bool_or(~F.col("is_video")).alias("image"))
    bounds = [cfg.max_distance(t) for t in (cfg.image, cfg.image_video, cfg.video)]
    pairs = near_hash_pairs(kinds, max(bounds), cfg.candidates)
    p = kinds.select(F.col("bits").alias("p"), F.col("video").alias("pv"), F.col("image").alias("pi"))
    q = kinds.select(F.col("bits").alias("q"), F.col("video").alias("qv"), F.col("image").alias("qi"))
    d = F.col("distance")
    fits = ((d <= bounds[0]) & F.col("pi") & F.col("qi")) | ((d <= bounds[1]) & ((F.col("pi") & F.col("qv")) | (F.col("pv") & F.col("qi")))) | ((d <= bounds[2]) & F.col("pv") & F.col("qv"))
    return pairs.join(p, "p").join(q, "q").where(fits).select("p", "q", "distance")


def duplicate_sets(files: DataFrame, cfg: SimilarityConfig) -> DataFrame:
    """(file_path, set_id): files in sets of at least two; set_id is the smallest path of the set.

    Components over hashes, then over the files of each: the number of files with one hash
    never matters.
    """
    hashed = files.where("bits IS NOT NULL").select("file_path", "bits", "is_video")
    labels = components(similar_hashes(hashed, cfg).select(F.col("p").alias("a"), F.col("q").alias("b")))
    placed = hashed.join(labels.select(F.col("id").alias("bits"), "label"), "bits", "left").withColumn("label", F.coalesce("label", "bits"))
    sets = placed.groupBy("label").agg(F.min("file_path").alias("set_id"), F.count("*").alias("n")).where("n > 1")
    return placed.join(sets, "label").select("file_path", "set_id")


def similar_pairs(files: DataFrame, cfg: SimilarityConfig) -> DataFrame:
    """(a, b, distance), a < b: pairs of files by the candidate rule and the types' thresholds."""
    bounds = [cfg.max_distance(t) for t in (cfg.image, cfg.image_video, cfg.video)]
    near = near_hash_pairs(files, max(bounds), cfg.candidates)
    equal = files.where("bits IS NOT NULL").select(F.col("bits").alias("p"), F.col("bits").alias("q"), F.lit(0).alias("distance")).distinct()
    side = lambda n, h: files.select(F.col("file_path").alias(n), F.col("bits").alias(h), F.col("is_video").alias(n + "v"))
    every = near.union(near.select("q", "p", "distance")).union(equal).join(side("a", "p"), "p").join(side("b", "q"), "q").where("a < b")
    bound = F.when(F.col("av") & F.col("bv"), bounds[2]).when(F.col("av") | F.col("bv"), bounds[1]).otherwise(bounds[0])
    return every.where(F.col("distance") <= bound).select("a", "b", "distance")


def shown_groups(files: DataFrame) -> DataFrame:
    """(bits, is_video, head, size): files of one hash and type have the same neighbours, each other among them; ``head`` is the smallest path."""
    return files.where("bits IS NOT NULL").groupBy("bits", "is_video").agg(F.min("file_path").alias("head"), F.count("*").alias("size"))


def group_pairs(files: DataFrame, cfg: SimilarityConfig) -> tuple[DataFrame, DataFrame]:
    """The groups and the pairs (a, b) of heads that are similar: as many as there are different hashes, however many files have one."""
    groups = stage(shown_groups(files), "shown")[0]
    heads = groups.select(F.col("head").alias("file_path"), "bits", "is_video")
    return groups, stage(similar_pairs(heads, cfg).select("a", "b"), "head-pairs")[0]


def _members(files: DataFrame, groups: DataFrame) -> DataFrame:
    return files.where("bits IS NOT NULL").select("file_path", "bits", "is_video").join(groups, ["bits", "is_video"]).select("file_path", "head", "size")


def greedy_stars(pairs: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """(set_id, file_path) by the order-dependent rule: in the order of paths, a file not yet in a set
    takes all its neighbours not yet in one. Stars never leave their component, so components are
    independent; each must fit one task.

    ``several`` (file_path): heads that stand for more than one file, and so make a set even without a neighbour.
    """
    labels = components(pairs.select("a", "b"))
    edges = pairs.select("a", "b")
    if several is not None:
        edges = edges.unionByName(several.select(F.col("file_path").alias("a"), F.col("file_path").alias("b")))
    rows = edges.join(labels.select(F.col("id").alias("a"), "label"), "a", "left").select(F.coalesce("label", "a").alias("label"), "a", "b")

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set[str]] = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        taken, out = set(), []
        for f in sorted(near):
            free = [x for x in near[f] if x not in taken]  # with f itself, if it stands for several
            if f not in taken and free:
                taken.update(free, [f])
                out += [(f, m) for m in sorted({f, *free})]
        return pd.DataFrame(out, columns=["set_id", "file_path"])

    return rows.groupBy("label").applyInPandas(stars, "set_id string, file_path string")


def star_sets(files: DataFrame, cfg: SimilarityConfig) -> DataFrame:
    """(set_id, file_path): greedy stars of files. A star takes all files of a group or none, and the first free file in the
    order of paths is always a head; so stars of heads are stars of files."""
    groups, pairs = group_pairs(files, cfg)
    stars = greedy_stars(pairs, groups.where("size > 1").select(F.col("head").alias("file_path")))
    return _members(files, groups).join(stars.withColumnRenamed("file_path", "head"), "head").select("set_id", "file_path")


def dbscan(pairs: DataFrame, min_points: int = 2, sizes: DataFrame | None = None) -> DataFrame:
    """(file_path, cluster_id, is_core) from symmetric neighbour pairs (a < b); noise is not returned.

    A file is a core if it and its neighbours are at least ``min_points``. Cores that are neighbours share a
    cluster; other files join the cluster of their smallest core neighbour. With two points
    this is connected components. ``sizes`` (file_path, size): how many files a head stands for, itself included.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    if sizes is None:
        cores = both.groupBy("a").count().where(F.col("count") + 1 >= min_points).select("a")
    else:
        around = both.join(sizes.select(F.col("file_path").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others"))
        own = sizes.select(F.col("file_path").alias("a"), "size").join(around, "a", "left")
        cores = stage(own.where(F.col("size") + F.coalesce("others", F.lit(0)) >= min_points).select("a"), "cores")[0]
    near_cores = both.join(cores, "a", "left_semi")
    core_edges = near_cores.join(cores.withColumnRenamed("a", "b"), "b", "left_semi")
    labels = components(core_edges)
    core = cores.join(labels.select(F.col("id").alias("a"), "label"), "a", "left").select("a", F.coalesce("label", "a").alias("label"))
    border = near_cores.join(cores.withColumnRenamed("a", "b"), "b", "left_anti")
    edge = border.groupBy("b").agg(F.min("a").alias("a")).join(core, "a").select(F.col("b").alias("file_path"), F.col("label").alias("cluster_id"), F.lit(False).alias("is_core"))
    return core.select(F.col("a").alias("file_path"), F.col("label").alias("cluster_id"), F.lit(True).alias("is_core")).union(edge)


def density_clusters(files: DataFrame, cfg: SimilarityConfig, min_points: int = 2) -> DataFrame:
    """(file_path, cluster_id, is_core): ``dbscan`` of files, on heads that count for all files of their group."""
    groups, pairs = group_pairs(files, cfg)
    found = dbscan(pairs, min_points, groups.select(F.col("head").alias("file_path"), "size"))
    return _members(files, groups).join(found.withColumnRenamed("file_path", "head"), "head").select("file_path", "cluster_id", "is_core")
