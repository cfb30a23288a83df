"""Neighbour search, clusters, roles, frames, memo."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotoloom.config import FrameConfig, SimilarityConfig
from fotoloom.functions import similarity
from fotoloom.operators import candidates, cluster, components, frames, memo, select


def hashes(seed, n=120):
    r = random.Random(seed)
    out = []
    for i in range(n):
        h = r.getrandbits(64) if i % 3 == 0 or not out else out[r.randrange(len(out))]
        for _ in range(r.randrange(7)):
            h ^= 1 << r.randrange(64)
        out.append(h)
    return [h - (1 << 64) if h >= 1 << 63 else h for h in out]


def dist(a, b):
    return ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count()


@pytest.mark.parametrize("d", [0, 1, 3, 4, 8])
def test_block_join_is_complete(spark, d):
    hs = hashes(d)
    df = spark.createDataFrame([(h,) for h in hs], "bits long")
    want = {(a, b, dist(a, b)) for a in set(hs) for b in set(hs) if a < b and dist(a, b) <= d}
    for mode in ("pigeonhole", "all_pairs"):
        assert {tuple(r) for r in candidates.near_hash_pairs(df, d, mode).collect()} == want
    near = {tuple(r) for r in candidates.near_hash_pairs(df, d, "lsh4").collect()}
    assert near <= want and (d > 3 or near == want)  # four keys are complete up to three bits


def test_lsh_candidates(spark):
    rows = [("a", "ffff1111aaaaaaaa"), ("b", "ffffffffffffffff"), ("c", "1122334455667788"), ("d", None), ("e", "00000000ffff0000")]
    got = {tuple(r) for r in candidates.lsh_candidates(spark.createDataFrame(rows, "file_path string, phash string")).collect()}
    assert got == {(x, y) for x in "abe" for y in "abe" if x != y}


def test_searches(spark):
    hs = hashes(7, 60)
    df = spark.createDataFrame([(f"f{i:02}", h) for i, h in enumerate(hs)], "file_path string, bits long")
    q = df.where("file_path < 'f05'")
    got = {tuple(r) for r in candidates.range_search(q, df, 5).collect()}
    assert got == {(f"f{i:02}", f"f{j:02}", dist(hs[i], hs[j])) for i in range(5) for j in range(60) if dist(hs[i], hs[j]) <= 5}
    near = {(r.query_id, r["rank"]): (r.distance, r.file_path) for r in candidates.knn(q, df, 3).collect()}
    for i in range(5):
        best = sorted((dist(hs[i], hs[j]), f"f{j:02}") for j in range(60) if j != i)[:3]
        assert [near[(f"f{i:02}", k)] for k in (1, 2, 3)] == best


def union(edges, items):
    g = {x: x for x in items}

    def root(x):
        while g[x] != x:
            x = g[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        g[y] = x
    return {x: root(x) for x in items}


def test_merge_sets(spark):
    sets = [("1", "A"), ("1", "B"), ("1", "C"), ("2", "C"), ("2", "D"), ("2", "E"), ("3", "B"), ("3", "H"), ("4", "F"), ("4", "G"), ("5", "X"), ("5", "Y"), ("6", "Z"), ("7", "Z")]
    df = spark.createDataFrame(sets, "set_id string, member string")
    out = {}
    for r in components.merge_sets(df).collect():
        out.setdefault(r.set_id, set()).add(r.member)
    assert sorted(map(sorted, out.values())) == [list("ABCDEH"), list("FG"), list("XY"), ["Z"]]


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    items = {x for e in edges if e[0] != e[1] for x in e}
    got = {x.id: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union(edges, items)


def files(spark, seed=5):
    hs = hashes(seed, 80)
    rows = [(f"p/{i:03}", None if i % 17 == 0 else h, i % 4 == 0, 1000 + i * 37 % 500, 100 + i % 7, 100, None, None, None, None, float(i % 4 == 0)) for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "file_path string, bits long, is_video boolean, size long, width int, height int, gps_latitude double, gps_longitude double, camera_model string, image_date timestamp, duration double")
    return df, rows


@pytest.mark.parametrize("mode", ["pigeonhole", "lsh4"])
def test_duplicate_sets_and_roles(spark, mode):
    cfg = SimilarityConfig(image=0.97, candidates=mode)
    df, rows = files(spark)
    key = lambda h: {(h >> s) & 0xFFFF for s in (0, 16, 32, 48)}
    known = [r for r in rows if r[1] is not None]
    edges = []
    for x in known:
        for y in known:
            if x[0] < y[0]:
                bound = cfg.max_distance(cfg.video if x[2] and y[2] else cfg.image_video if x[2] or y[2] else cfg.image)
                if x[1] == y[1] or (dist(x[1], y[1]) <= bound and (mode != "lsh4" or key(x[1]) & key(y[1]))):
                    edges.append((x[0], y[0]))
    want = union(edges, {x for e in edges for x in e})
    sets = cluster.duplicate_sets(df, cfg)
    assert {r.file_path: r.set_id for r in sets.collect()} == want
    placed = select.roles(df, sets, cfg).collect()
    assert sorted(r.file_path for r in placed) == [r[0] for r in rows]  # every file once
    assert {r.file_path for r in placed if r.role == "unique"} == {r[0] for r in rows} - set(want)
    for s in set(want.values()):
        members = sorted((r for r in placed if r.set_id == s), key=lambda r: r["rank"])
        assert members[0].role == "representative" and all(a.score >= b.score for a, b in zip(members, members[1:]))
    bad = spark.createDataFrame([(edges[0][0],)], "file_path string")
    failed = [r for r in select.roles(df, sets, cfg, bad).collect() if r.set_id == want[edges[0][0]]]
    assert failed and {r.role for r in failed} == {"error"}
    total = select.summary(select.roles(df, sets, cfg)).first()
    assert total.n_files == len(rows) == total.n_unique + total.n_representatives + total.n_duplicates and total.n_sets == len(set(want.values()))


def test_exact_duplicates(spark):
    rows = [("exact1", 0x1111, False, 1000), ("exact2", 0x1111, False, 2000), ("unique1", 0x2222 << 40, False, 1000), ("no_phash.jpg", None, False, 10)]
    df = spark.createDataFrame(rows, "file_path string, bits long, is_video boolean, size long")
    df = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("gps_latitude", "double"), ("gps_longitude", "double"), ("camera_model", "string"), ("image_date", "timestamp"), ("duration", "double"))])
    got = {r.file_path: r.role for r in select.roles(df, cluster.duplicate_sets(df, SimilarityConfig()), SimilarityConfig()).collect()}
    assert got == {"exact1": "duplicate", "exact2": "representative", "unique1": "unique", "no_phash.jpg": "unique"}


def test_captures(spark):
    rows = [("video", 0x0, True, 1920, 1080, True, 99.0), ("img1", 0xAABBCCDD, False, 2000, 1500, True, 9.0), ("img2", 0xAABBCCDE, False, 1950, 1080, True, 8.0), ("img3", 0x1, False, 640, 480, True, 7.0), ("img4", 0x2, False, 2000, 1500, False, 6.0), ("img5", None, False, 2000, 1500, True, 5.0), ("img6", 0xABCDEF00, False, 1920, 1080, True, 4.0)]
    df = spark.createDataFrame([("s", *r) for r in rows], "set_id string, file_path string, bits long, is_video boolean, width int, height int, dated boolean, score double")
    df = df.withColumn("image_date", F.when(F.col("dated"), F.timestamp_seconds(F.lit(1))))
    pick = lambda t: {r.file_path for r in select.captures(df, SimilarityConfig(image=t)).collect()}
    assert pick(0.9) == {"img1", "img6"}  # 64-bit distances here
    assert pick(0.99) == {"img1", "img2", "img6"}


def test_greedy_and_density(spark):
    r = random.Random(9)
    for _ in range(3):
        edges = sorted({tuple(sorted((f"n{a}", f"n{b}"))) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(16)) if a != b})
        df = spark.createDataFrame(edges, "a string, b string")
        near, taken, want = {}, set(), []
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for f in sorted(near):
            free = sorted(x for x in near[f] if x not in taken)
            if f not in taken and free:
                want += [(f, m) for m in [f, *free]]
                taken.update([f, *free])
        assert sorted((x.set_id, x.file_path) for x in cluster.greedy_stars(df).collect()) == sorted(want)
        two = {x.file_path: x.cluster_id for x in cluster.dbscan(df, 2).collect()}
        assert two == union(edges, set(near))
        cores = {f for f in near if len(near[f]) + 1 >= 4}
        four = {x.file_path: (x.cluster_id, x.is_core) for x in cluster.dbscan(df, 4).collect()}
        comp = union([e for e in edges if e[0] in cores and e[1] in cores], cores)
        assert {f for f, (_, c) in four.items() if c} == cores
        assert all(four[f] == (comp[f], True) if f in cores else four[f] == (comp[min(near[f] & cores)], False) for f in four)
        assert set(four) == {f for f in near if f in cores or near[f] & cores}


def test_groups_stand_for_their_files(spark):
    """Stars and density clusters of files against the same rules on all pairs, with large groups of one hash."""
    r = random.Random(4)
    base = [r.getrandbits(62) for _ in range(5)]
    hashes_ = [b ^ (1 << i) if i else b for b in base for i in range(3)]
    rows = [(f"f{i:03}", r.choice(hashes_[:3] if i % 2 else hashes_), r.random() < 0.4) for i in range(70)] + [("z1", None, False), ("z0", 5, False)]
    df = spark.createDataFrame(rows, "file_path string, bits long, is_video boolean")
    cfg = SimilarityConfig(image=0.99, image_video=0.98, video=0.95, candidates="all_pairs")
    pairs = cluster.similar_pairs(df, cfg)
    assert sorted(map(tuple, cluster.star_sets(df, cfg).collect())) == sorted(map(tuple, cluster.greedy_stars(pairs).collect()))
    for points in (2, 6, 20):
        assert sorted(map(tuple, cluster.density_clusters(df, cfg, points).collect())) == sorted(map(tuple, cluster.dbscan(pairs, points).collect()))


def test_frames_in_range(spark):
    df = spark.createDataFrame([([(float(i), i) for i in range(5)],)], "f array<struct<ts:double,hash:bigint>>")
    got = df.select(frames.frames_in_range(F.col("f"), F.lit(1.0), F.lit(3.0))).first()[0]
    assert [x.ts for x in got] == [1.0, 2.0, 3.0]


def test_frame_policy(spark):
    cfg = FrameConfig(target_fps=2, min_frames=2, scene_change_threshold=0.5, max_scene_frames=3)
    rows = [(i * 0.25, 0.9 if i in (1, 3, 4) else 0.1, i) for i in range(13)]
    df = spark.createDataFrame([(3.0, rows), (0.0, rows), (3.0, [])], "d double, f array<struct<ts:double,scene:double,hash:bigint>>")
    got = [r[0] for r in df.select(F.transform(frames.kept_frames(F.col("f"), F.col("d"), cfg), lambda x: x["ts"])).collect()]
    kept = []
    for ts, scene, _ in rows:
        if not kept or (scene > 0.5 and ts - kept[-1] >= 0.5) or ts - kept[-1] >= 1.5:
            kept.append(ts)
    assert got == [kept, [], []]
    few = df.select(F.size(frames.reduced_frames(F.col("f"), F.col("d"), cfg))).collect()
    assert [r[0] for r in few] == [6, 3, 0]


def test_video_similarity(spark):
    f = lambda hs: [(float(i), h) for i, h in enumerate(hs)]
    rows = [("same", "x", 3.0, 3.0, f([1, 2, 3]), f([1, 2, 3])), ("inside", "x", 2.0, 5.0, f([7, 8, 9]), f([0, 0, 7, 8, 9, 0])), ("none", "x", 1.0, 1.0, [], []), ("half", "x", 1.0, 1.0, f([1]), []), ("zero", "x", 0.0, 3.0, f([1]), f([1, 2]))]
    df = spark.createDataFrame(rows, "a string, b string, duration_a double, duration_b double, frames_a array<struct<ts:double,hash:bigint>>, frames_b array<struct<ts:double,hash:bigint>>")
    got = {r.a: r.similarity for r in frames.video_similarity(df, 1.0, 16).collect()}
    assert got == {"same": 1.0, "inside": 1.0, "none": 1.0, "half": 0.0, "zero": 0.0}


def test_warping_against_cells(spark):
    """Windows of random tables cell by cell, and whole videos against the column form."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        cost = rng.integers(0, 17, (rng.integers(1, 12), rng.integers(1, 9)))
        lo = rng.integers(0, len(cost), 6)
        hi = np.asarray([rng.integers(a + 1, len(cost) + 1) for a in lo])
        for a, b, got in zip(lo, hi, frames.warped_windows(cost, lo, hi)):
            d = np.full((b - a + 1, cost.shape[1] + 1), 10**6)
            d[0, 0] = 0
            for i in range(1, b - a + 1):
                for j in range(1, cost.shape[1] + 1):
                    d[i, j] = cost[a + i - 1, j - 1] + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
            assert got == d[-1, -1]
    video = lambda n: [(float(i), None if rng.random() < 0.1 else int(rng.integers(0, 1 << 16))) for i in range(n)]
    rows = [(i, 0, 5.0, 5.0, video(6), video(6)) for i in range(20)]
    df = spark.createDataFrame(rows, "a long, b long, duration_a double, duration_b double, frames_a array<struct<ts:double,hash:bigint>>, frames_b array<struct<ts:double,hash:bigint>>")
    known = F.transform(F.filter("frames_b", lambda f: f["hash"].isNotNull()), lambda f: f["hash"])
    want = {r.a: r.s for r in df.select("a", similarity.dtw_similarity(known, F.transform("frames_a", lambda f: f["hash"]), 16).alias("s")).collect()}
    assert {r.a: r.similarity for r in frames.video_similarity(df, 1.0, 16).collect()} == pytest.approx(want)


def test_memo(spark):
    one = memo.config_hash(FrameConfig())
    assert one == memo.config_hash(FrameConfig()) != memo.config_hash(FrameConfig(resolution=32))
    assert memo.config_hash(FrameConfig(target_fps=9), ("resolution",)) == memo.config_hash(FrameConfig(), ("resolution",))
    wanted = spark.createDataFrame([("j", "a", "1"), ("j", "b", "1"), ("j", "c", "1")], "job string, key string, config_hash string")
    cache = spark.createDataFrame([("j", "a", "1", "A", 1), ("j", "b", "1", "B", 1), ("j", "b", "2", "B2", 2)], "job string, key string, config_hash string, value string, seq int")
    every, fresh = memo.memoize(wanted, cache, lambda df: df.withColumn("value", F.upper("key")))
    assert {(r.key, r.value) for r in every.collect()} == {("a", "A"), ("b", "B"), ("c", "C")}
    assert {r.key for r in fresh.collect()} == {"b", "c"}
