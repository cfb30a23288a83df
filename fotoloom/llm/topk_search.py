"""Exact top-k search by inner product: ball trees with branch and bound.

Vectors are made integer (``floor(scale * x)``) and split into shards by a hash. A task builds the
ball tree of a shard once, then walks it for one block of queries after another. A node is left out for a
query when the upper bound ``q . centre + |q| * radius`` of every product in its ball is
below the query's k-th best score so far; the leaves that remain are visited in the
order of their bounds, best first.

The k-th score is shared: shards are searched in waves, a query's home shard first (spread over all shards), then
a few more, then the rest, and the k-th score found so far is the starting bound of the next wave. A
node that may hold an equal score is never left out, so ties go to smaller ids exactly.

Bounds are doubles with a slack above their rounding; scores are whole numbers: doubles below 2^53, 64-bit integers
below 2^62, integers of any size beyond, all through the same tree.

Defined results: vectors that are null or hold a null or non-finite component take no
part, nor do those of no component; products are taken between vectors of the same length only; a component beyond 64 bits stops at their ends, and so does a
score (its rank is that of the true one); repeated ids are
candidates each for itself, and a query never meets rows of its own id; repeated query
rows give repeated ranks of one query only once (one row per distinct id and vector); a
null id takes no part; an empty table gives an empty result. Other columns are not read.

Scale: vectors are shuffled once a wave, queries once for each shard, so what a task holds is bounded by ``shard_rows`` and
``block_rows``. The result of a shard is k rows a query. Work is what a stated query set against all rows needs, less what the
bounds cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage


@dataclass(frozen=True)
class SearchConfig:
    k: int = 10
    scale: int = 1024
    shard_rows: int = 16_384
    block_rows: int = 2_048
    leaf_rows: int = 128
    #: shards that a query has been sent to when each wave but the last ends
    waves: tuple[int, ...] = (1, 8)


def integer_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, vector, dim): the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    valid = embeddings.where(F.col("vec_id").isNotNull() & (F.size(e) > 0) & fine)
    return valid.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"), F.size(e).alias("dim"))


class BallTree:
    """Nodes in arrays; children of an inner node are its ``left`` and ``left + 1``."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.order = np.arange(len(points))
        self.centre, self.radius, self.left, self.span = [], [], [], []
        todo = [(0, len(points))]
        self._node(points, *todo[0])
        at = 0
        while at < len(self.span):
            lo, hi = self.span[at]
            if hi - lo > leaf_rows:
                own = points[self.order[lo:hi]]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, axis], mid)]
                self.left[at] = len(self.span)
                self._node(points, lo, lo + mid)
                self._node(points, lo + mid, hi)
            at += 1
        self.centre, self.radius = np.asarray(self.centre), np.asarray(self.radius)

    def _node(self, points: np.ndarray, lo: int, hi: int) -> None:
        own = points[self.order[lo:hi]]
        centre = own.mean(axis=0)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
        self.left.append(-1)
        self.span.append((lo, hi))


def _products(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The kind of number that holds the products exactly."""
    most = int(np.abs(vectors.astype(np.float64)).max(initial=0)) * int(np.abs(queries.astype(np.float64)).max(initial=0)) * max(vectors.shape[1], 1)
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows' k best (id, score), best first; of equal scores smaller ids."""
    if scores.dtype == object:
        top = np.asarray([sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k] for i, s in zip(ids, scores)], np.int64).reshape(len(ids), -1)
    else:
        top = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, top, axis=1), np.take_along_axis(scores, top, axis=1)


class Shard:
    """The vectors of a shard and their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int):
        self.ids, self.vectors = ids, vectors
        points = vectors.astype(np.float64)
        self.tree = BallTree(points, leaf_rows)
        self.longest = float(np.sqrt((points**2).sum(axis=1).max(initial=0.0)))

    def search(self, q_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's k best, ties to smaller ids.

        ``bound``: a score that k rows elsewhere are known to reach, or -inf; rows below it may be left out.
        """
        tree, kind = self.tree, _products(queries, self.vectors)
        probes = queries.astype(np.float64)
        length = np.sqrt((probes**2).sum(axis=1))
        # rounding in a bound or a score is far below this slack
        slack = 1.0 + 1e-9 * length * self.longest
        upper = probes @ tree.centre.T + length[:, None] * tree.radius[None, :] + slack[:, None]
        exact_q, exact_v = queries.astype(kind), self.vectors.astype(kind)
        never = -np.inf if kind is np.float64 else -(1 << 62) if kind is np.int64 else -(1 << 200)
        best_s = np.full((len(queries), k), never, dtype=kind)
        best_i = np.full((len(queries), k), np.iinfo(np.int64).max)
        kth = bound.astype(np.float64) - slack
        # branch: nodes reached by a query are those whose ancestors all pass its starting bound
        alive = np.zeros(upper.shape, dtype=bool)
        alive[:, 0] = upper[:, 0] >= kth
        for node, left in enumerate(tree.left):
            if left >= 0:
                for child in (left, left + 1):
                    alive[:, child] = alive[:, node] & (upper[:, child] >= kth)
        leaves = np.asarray([i for i, left in enumerate(tree.left) if left < 0])
        reach = np.where(alive[:, leaves], upper[:, leaves], -np.inf)
        ranked = np.argsort(-reach, axis=1, kind="stable")
        every = np.arange(len(queries))
        for turn in range(len(leaves)):
            leaf = ranked[:, turn]
            hope = reach[every, leaf]
            if not np.isfinite(hope).any():
                break
            going = np.flatnonzero((hope >= kth) & np.isfinite(hope))
            for one in np.unique(leaf[going]):
                lo, hi = tree.span[leaves[one]]
                rows = tree.order[lo:hi]
                who = going[leaf[going] == one]
                score = exact_q[who] @ exact_v[rows].T
                score[self.ids[rows][None, :] == q_ids[who][:, None]] = never
                some = (score.astype(np.float64) >= kth[who][:, None]).any(axis=1)
                who, score = who[some], score[some]
                if not len(who):
                    continue
                i = np.concatenate([best_i[who], np.broadcast_to(self.ids[rows], score.shape)], axis=1)
                best_i[who], best_s[who] = _best(i, np.concatenate([best_s[who], score], axis=1), k)
                kth[who] = np.maximum(kth[who], best_s[who, -1].astype(np.float64) - slack[who])
        row, col = np.nonzero(best_s > never)
        found = best_s[row, col]
        if kind is object:
            found = np.asarray([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in found], np.int64)
        return row, best_i[row, col], found.astype(np.int64)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _search(rows: DataFrame, cfg: SearchConfig) -> DataFrame:
    """(query_id, vec_id, score) for rows (dim, shard, role, id, vector, bound): a shard's vectors (role 0), then its queries."""

    def run(batches):
        now, parts, shard = None, [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(c)) for c in ("dim", "shard", "role")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if lo == hi:
                    continue
                dim, number, role = key[lo].tolist()
                ids, vectors = np.asarray(batch.column("id").slice(lo, hi - lo)), _matrix(batch.column("vector").slice(lo, hi - lo))
                if now != (dim, number):
                    now, parts, shard = (dim, number), [], None
                if role == 0:
                    parts.append((ids, vectors))
                    continue
                if shard is None and parts:
                    shard, parts = Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), cfg.leaf_rows), []
                if shard is None:
                    continue
                bound = batch.column("bound").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                for at in range(0, len(ids), cfg.block_rows):
                    some = slice(at, at + cfg.block_rows)
                    row, found, score = shard.search(ids[some], vectors[some], bound[some], cfg.k)
                    yield pa.record_batch([pa.array(ids[some][row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    dealt = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "role")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, is_query: Column, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``embeddings`` where ``is_query`` holds."""
    vectors = stage(integer_vectors(embeddings, cfg.scale), "topk-vectors")[0]
    n_shards = max(1, -(-vectors.count() // cfg.shard_rows))
    shard = F.pmod(F.xxhash64("vec_id", "vector", F.lit(2)), F.lit(n_shards)).cast("int")
    never = F.lit(float("-inf"))
    columns = ["dim", "shard", "role", "id", "vector", "bound"]
    points = vectors.select("dim", shard.alias("shard"), F.lit(0).alias("role"), F.col("vec_id").alias("id"), "vector", never.alias("bound"))
    picked = vectors.where(is_query).select(F.col("vec_id").alias("id"), "vector", "dim").dropDuplicates(["id", "vector"])
    home = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_shards))
    # a query's best rows so far; at most k rows a query and shard come here
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k)
    found, bounds, done = None, None, 0
    for upto in sorted({min(w, n_shards) for w in cfg.waves} | {n_shards}):
        sent = picked.withColumn("bound", never)
        if bounds is not None:
            sent = picked.join(bounds, picked["id"] == bounds["query_id"], "left").withColumn("bound", F.coalesce("bound", never)).drop("query_id")
        places = F.transform(F.sequence(F.lit(done), F.lit(upto - 1)), lambda i: F.pmod(home + i, F.lit(n_shards)).cast("int"))
        queries = sent.withColumn("role", F.lit(1)).withColumn("shard", F.explode(places)).select(*columns)
        wave = _search(points.unionByName(queries), cfg)
        found = best(wave if found is None else found.drop("rank").unionByName(wave))
        done = upto
        if done < n_shards:
            found = stage(found, "topk-wave")[0]
            bounds = found.where(F.col("rank") == cfg.k).select("query_id", F.col("score").cast("double").alias("bound"))
    return found.select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
