"""Neighbour search on 64-bit hashes.

``lsh_candidates`` is the published candidate rule (any of four 16-bit keys of one row occurs among
the keys of the other). For pairs within a distance the join uses wider keys: split in ``d + 2``
blocks, two hashes that differ in at most ``d`` bits agree on at least two blocks, so joining on pairs of
blocks is complete and its keys are about ``128 / (d + 2)`` bits wide, where 16-bit keys would
put every 65536-th row of any table in one bucket. The LSH rule is then a residual filter.
Hashes are made distinct first, so that copies never multiply pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import hamming
from ..functions.phash import lsh_keys

MAX_BROADCAST_QUERIES = 100_000


def lsh_candidates(files: DataFrame, id_col: str = "file_path", phash_col: str = "phash") -> DataFrame:
    """(a, b), a <> b: rows of which any LSH keys agree, across key positions."""
    keys = F.array_distinct(lsh_keys(F.col(phash_col)))
    left = files.select(F.col(id_col).alias("a"), F.explode(keys).alias("key"))
    right = files.select(F.col(id_col).alias("b"), F.explode(keys).alias("key"))
    return left.join(right, "key").where("a <> b").select("a", "b").distinct()


def _blocks(d: int, bits: int) -> list[tuple[int, int]]:
    """(shift, width) of ``d + 2`` blocks that make up ``bits``."""
    n = min(d + 2, bits)
    cut = [bits * i // n for i in range(n + 1)]
    return [(cut[i], cut[i + 1] - cut[i]) for i in range(n)]


def block_keys(bits: Column, d: int, width: int = 64) -> Column:
    """Join keys such that hashes within distance ``d`` share at least one."""

    def part(shift: int, size: int) -> Column:
        return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1))

    blocks = [part(*b) for b in _blocks(d, width)]
    pairs = list(combinations(range(len(blocks)), 2))
    return F.array(*[F.xxhash64(F.lit(n), blocks[i], blocks[j]) for n, (i, j) in enumerate(pairs)])


def near_hash_pairs(hashes: DataFrame, max_distance: int, mode: str = "pigeonhole") -> DataFrame:
    """(p, q, distance), p < q, of distinct 64-bit ``bits`` within the distance.

    mode: 'pigeonhole' (complete), 'all_pairs' (the same by a theta join, for tests), 'lsh4' (only pairs
    that share an LSH key at any position).
    """
    distinct = hashes.select("bits").where("bits IS NOT NULL").distinct()
    if mode == "all_pairs":
        pairs = distinct.select(F.col("bits").alias("p")).join(distinct.select(F.col("bits").alias("q")), F.col("p") < F.col("q"))
    else:
        keyed = distinct.select("bits", F.explode(F.array_distinct(block_keys(F.col("bits"), max_distance))).alias("key"))
        left, right = keyed.select("key", F.col("bits").alias("p")), keyed.select("key", F.col("bits").alias("q"))
        pairs = left.join(right, "key").where("p < q").drop("key")
    close = pairs.withColumn("distance", hamming(F.col("p"), F.col("q"))).where(F.col("distance") <= max_distance)
    if mode == "lsh4":
        as_hex = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
        close = close.where(F.arrays_overlap(lsh_keys(as_hex(F.col("p"))), lsh_keys(as_hex(F.col("q")))))
    return close.distinct()


#: Beyond this distance block keys are so short that most rows share one with most others.
MAX_KEYED_DISTANCE = 6
#: Up to this one, keys of 16 bits are probed with all masks of up to a quarter of the distance.
MAX_PROBED_DISTANCE = 15


def _masks(radius: int, width: int = 16) -> list[int]:
    """All numbers of ``width`` bits of which at most ``radius`` are set."""
    return [sum(1 << i for i in chosen) for k in range(radius + 1) for chosen in combinations(range(width), k)]


def _quarters(bits: Column) -> Column:
    """The four 16-bit blocks of a hash, each with its number before it."""
    return F.array(*[F.shiftrightunsigned(bits, 16 * i).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(i << 16)) for i in range(4)])


def range_search(queries: DataFrame, files: DataFrame, max_distance: int) -> DataFrame:
    """(query_id, file_path, distance) of all files within the distance of each query, itself included.

    Both sides have (file_path, bits). A distance of 0 finds equal hashes. Small distances are joined on block keys. For larger
    ones two hashes within distance d differ in at most d / 4 bits of one of four 16-bit blocks, so the queries, a stated set, are
    sent out once for each such change of each block, and a file four times.
    """
    q, f = queries.select(F.col("file_path").alias("query_id"), F.col("bits").alias("q")), files.select("file_path", F.col("bits").alias("p"))
    if MAX_KEYED_DISTANCE < max_distance <= MAX_PROBED_DISTANCE:
        probes = q.withColumn("block", F.explode(_quarters(F.col("q")))).withColumn("mask", F.explode(F.lit(_masks(max_distance // 4))))
        left = probes.select("query_id", "q", F.col("block").bitwiseXOR(F.col("mask")).alias("key"))
        right = f.withColumn("key", F.explode(_quarters(F.col("p"))))
    else:
        keys = lambda c: F.explode(F.array_distinct(block_keys(F.col(c), max_distance))).alias("key")
        left, right = q.select("query_id", "q", keys("q")), f.select("file_path", "p", keys("p"))
    found = left.join(right, "key").withColumn("distance", hamming(F.col("q"), F.col("p")))
    return found.where(F.col("distance") <= max_distance).select("query_id", "file_path", "distance").distinct()


def in_blocks(rows: DataFrame, queries: DataFrame, key: str, condition: Column) -> DataFrame:
    """``rows`` joined with a stated query set by any condition, in blocks of about ``MAX_BROADCAST_QUERIES`` at most.

    The queries are counted; each block, a hash range of ``key``, is small enough to broadcast.
    """
    blocks = max(1, -(-queries.count() // MAX_BROADCAST_QUERIES))
    out = None
    for b in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        part = rows.join(F.broadcast(some), condition)
        out = part if out is None else out.unionByName(part)
    return out


def knn(queries: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, file_path, distance): the k nearest other files of a stated set of queries, ties by path.

    Work is queries x files by nature; it runs as one pass over the files against the broadcast
    queries if their count is within ``MAX_BROADCAST_QUERIES``, else in blocks of that many. A
    row-number limit keeps at most k rows a query and partition before the shuffle.
    """
    q = queries.select(F.col("file_path").alias("query_id"), F.col("bits").alias("q"))
    f = files.select("file_path", F.col("bits").alias("p"))
    order = Window.partitionBy("query_id").orderBy("distance", "file_path")
    every = in_blocks(f, q, "query_id", F.col("query_id") != F.col("file_path"))
    ranked = every.select("query_id", "file_path", hamming(F.col("q"), F.col("p")).alias("distance")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "file_path", "distance")


def valid_neighbors(pairs: DataFrame, files: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Keep the (query_id, file_path, distance) whose types' bound holds; a file with an error is nobody's neighbour and has none.

    ``files`` has (file_path, is_video, bound_image, bound_mixed, bound_video).
    """
    q = files.select(F.col("file_path").alias("query_id"), F.col("is_video").alias("qv"))
    f = files.select("file_path", F.col("is_video").alias("fv"), "bound_image", "bound_mixed", "bound_video")
    bound = F.when(F.col("qv") & F.col("fv"), F.col("bound_video")).when(F.col("qv") | F.col("fv"), F.col("bound_mixed")).otherwise(F.col("bound_image"))
    out = pairs.join(q, "query_id").join(f, "file_path").where((F.col("distance") <= bound) & (F.col("query_id") != F.col("file_path")))
    if errors is not None:
        bad = errors.select("file_path")
        out = out.join(bad, "file_path", "left_anti").join(bad.withColumnRenamed("file_path", "query_id"), "query_id", "left_anti")
    return out.select("query_id", "file_path", "distance")
