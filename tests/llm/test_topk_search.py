import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotoloom.llm.topk_search import BallTree, SearchConfig, Shard, top_k


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {(i, tuple(v)) for i, v in ok if i % 10 == 0}:
        found = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in ok if i != q[0] and len(v) == len(q[1]))
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("cfg", [SearchConfig(k=4), SearchConfig(k=4, shard_rows=40, block_rows=5, leaf_rows=8), SearchConfig(k=4, shard_rows=9, block_rows=3, leaf_rows=2, waves=(1, 3, 9))])
def test_against_brute_force(spark, cfg):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(300, None), (310, [float("nan")] * 8), (311, [float("inf")] + [0.0] * 7), (320, [None] + [0.0] * 7), (330, [1.0, 2.0]), (331, [1.0, 2.0]), (None, [0.1] * 8), (340, [0.0] * 8), (350, []), (360, rows[0][1]), (360, rows[0][1])]
    df = spark.createDataFrame([(a, b, 5, 6) for a, b in rows], "vec_id long, embedding array<double>, rank int, Shard int")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 10 == 0, cfg).collect())
    assert got == brute(rows, cfg.k)
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0, cfg).collect() == []


def test_pruning_keeps_equal_scores():
    rng = np.random.default_rng(0)
    v = rng.integers(-5, 6, (500, 3))
    q = rng.integers(-5, 6, (20, 3))
    ids, q_ids = np.arange(500) * 7, np.arange(20) + 10_000
    row, got, score = Shard(ids, v, 16).search(q_ids, q, np.full(20, -np.inf), 10)
    for i in range(20):
        s = v @ q[i]
        want = sorted(range(500), key=lambda j: (-s[j], ids[j]))[:10]
        assert got[row == i].tolist() == ids[want].tolist() and score[row == i].tolist() == s[want].tolist()


@pytest.mark.parametrize("size", [1 << 25, 1 << 28, 1 << 45])
def test_large_products_go_through_the_tree(size):
    rng = np.random.default_rng(4)
    v = rng.integers(-size, size, (300, 5))
    v[100:200] = v[:100]
    v[150:160, 0] += 1  # sums that doubles can't tell apart
    q, ids, q_ids = rng.integers(-size, size, (12, 5)), np.arange(300)[::-1] * 3, np.arange(12) * 3
    shard = Shard(ids, v, 8)
    row, got, score = shard.search(q_ids, q, np.full(12, -np.inf), 7)
    assert len(shard.tree.span) > 50
    for i in range(12):
        s = [sum(int(a) * int(b) for a, b in zip(q[i], x)) for x in v]
        want = sorted((j for j in range(300) if ids[j] != q_ids[i]), key=lambda j: (-s[j], ids[j]))[:7]
        assert got[row == i].tolist() == ids[want].tolist()
        assert score[row == i].tolist() == [min(max(s[j], -(1 << 63)), (1 << 63) - 1) for j in want]


def test_ball_tree_holds_every_point():
    pts = np.random.default_rng(2).normal(size=(300, 4))
    t = BallTree(pts, 10)
    assert sorted(t.order.tolist()) == list(range(300))
    for c, r, (lo, hi) in zip(t.centre, t.radius, t.span):
        assert (np.sqrt(((pts[t.order[lo:hi]] - c) ** 2).sum(axis=1)) <= r + 1e-9).all()
