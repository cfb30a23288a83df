import collections

from pyspark.sql import functions as F

from fotoloom.llm.mixing import MixConfig, _copies, draw_name, mix, mix_plan, sizes, with_plan


def water(sizes, cfg):
    """The contract's iteration: share by weight, stop those above, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: cfg.weights[i % len(cfg.weights)] for i, s in enumerate(order)}
    left, out, open_ = cfg.budget * sum(sizes.values()), {}, set(order)
    while open_:
        lam = left / sum(w[s] for s in open_)
        above = {s for s in open_ if w[s] * lam > cfg.cap * sizes[s]}
        if not above:
            return out | {s: w[s] * lam for s in open_}
        for s in above:
            out[s] = cfg.cap * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def rows():
    out = [(i, "w " * (1 + i % 7), "abcdeé"[i % 6] if i % 11 else None) for i in range(400)]
    return out + [(1000, None, "a"), (1001, "", "z"), (None, "x y", "b"), (3, "w w w w", "d"), (3, "w w w w", "d")]


def copies_of(docs, cfg):
    out, plan = with_plan(docs, mix_plan(sizes(docs), cfg))
    return out.select("doc_id", "text", "source", _copies(draw_name(F.col("doc_id"), F.col("text")), F.col(f"{plan}.rate"), F.col(f"{plan}.trial"), cfg).alias("n")).collect()


def test_targets_and_copies(spark):
    cfg = MixConfig()
    df = spark.createDataFrame([(*r, 7, 8, "t", "p", 0) for r in rows()], "doc_id long, text string, source string, copies int, Rate int, target string, plan string, trial int").repartition(3)
    total = collections.Counter()
    for _, t, s in rows():
        total[s] += len((t or "").split())
    want = water(total, cfg)
    plan = {r.source: r for r in mix_plan(sizes(df), cfg).collect()}
    assert set(plan) == set(total)
    for s, r in plan.items():
        assert r.source_size == total[s] and abs(r.target - want[s]) < 1e-9 * max(1, want[s])
    got = copies_of(df, cfg)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.n * len((r.text or "").split())
        assert 0 <= r.n <= 2
    assert all(abs(taken[s] - want[s]) <= 8 for s in total)  # a document or so
    mixed = mix(df, cfg)
    assert mixed.columns == df.columns
    found = mixed.collect()
    assert {(r.copies, r.Rate, r.target, r.plan, r.trial) for r in found} == {(7, 8, "t", "p", 0)}
    assert collections.Counter((r.doc_id, r.text) for r in found) == sum((collections.Counter({(r.doc_id, r.text): r.n}) for r in got), collections.Counter())
    assert sorted(map(str, copies_of(df.repartition(7), cfg))) == sorted(map(str, got))
    assert mix(df.limit(0), cfg).collect() == []


def test_null_ids_are_drawn_one_by_one(spark):
    df = spark.createDataFrame([(None, f"word {i}", "ab"[i % 2]) for i in range(400)] + [(5, "w " * 300_000, "a")], "doc_id long, text string, source string")
    got = copies_of(df, MixConfig())
    assert len({r.n for r in got if r.doc_id is None and r.source == "a"}) == 2 and all(r.n <= 2 for r in got)
