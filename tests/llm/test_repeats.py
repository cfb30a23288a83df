"""Suffix-array and substring dedup against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from fotoloom.llm import repeats, substring_dedup, suffix_dedup
from fotoloom.llm.repeats import RepeatConfig


def brute(rows, window, split, join, across_only):
    """rows: (doc_id, text) -> {row: (n, removed, spans, kept)}"""
    docs = [(-(1 << 63) if d is None else d, split(t or "")) for d, t in rows]
    first = {}
    for i, (d, u) in enumerate(docs):
        for s in range(len(u) - window + 1):
            first.setdefault(tuple(u[s : s + window]), []).append((d, i, s))
    out = []
    for i, (d, u) in enumerate(docs):
        gone = [False] * len(u)
        for s in range(len(u) - window + 1):
            same = first[tuple(u[s : s + window])]
            if any(x < d or (not across_only and docs[j][1] == u and x == d and q < s) for x, j, q in same):
                gone[s : s + window] = [True] * window
        spans = sum(1 for k in range(len(u)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = join([x for x, g in zip(u, gone) if not g])
        out.append((rows[i][0], len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, unit, sep, long):
    r = random.Random(seed)
    alphabet = ["th", "er", "on", "and ", "é", "of", "\n"] if not sep else ["the", "of", "and", "été", "on", "in"]
    make = lambda n: sep.join(r.choice(alphabet) for _ in range(n))
    passages = [make(r.randint(long // 2, 2 * long)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [make(r.randint(0, long)) for _ in range(2)]
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3)
            parts.insert(r.randint(0, len(parts)), p[a:])
        rows.append((i * 3 % 61, sep.join(parts)))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (100, rows[0][1]), (None, rows[1][1]), (102, None), (103, ""), (104, "a" * 250), (105, "a " * 130), (7, rows[5][1]), (106, "x")]
    return rows


@pytest.mark.parametrize("seed,shard_runs", [(1, 2048), (2, 3)])
def test_suffix_dedup(spark, seed, shard_runs):
    rows = corpus(seed, "b", "", 60)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, runs int").repartition(3)
    cfg = RepeatConfig(window=100, gram=24, across_only=False, shard_runs=shard_runs)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, cfg).collect()), key=str)
    assert got == brute(rows, 100, lambda t: list(t.encode()), bytes, False)
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("seed,shard_runs", [(3, 512), (4, 3)])
def test_substring_dedup(spark, seed, shard_runs):
    rows = corpus(seed, "w", " ", 60)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, did int").repartition(3)
    cfg = RepeatConfig(window=50, gram=16, across_only=True, shard_runs=shard_runs)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df, cfg).collect()), key=str)
    want = brute(rows, 50, lambda t: t.encode().split(), b" ".join, True)
    assert got == sorted(((a, b, c, e) for a, b, c, _, e in want), key=str)
    assert sum(r[2] for r in got) > 500


def test_many_texts_of_one_id(spark):
    """Thousands of texts under the null id and one repeated id are told apart."""
    r = random.Random(5)
    make = lambda n: " ".join(r.choice(["the", "of", "and", "été", "on", "in"]) for _ in range(n))
    shared = make(60)
    rows = [(d, f"{make(r.randint(1, 4))} {shared if i % 50 == 0 else make(55)} {make(r.randint(1, 4))}") for d in (None, 9) for i in range(2500)]
    rows += [(4, make(70)), (12, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup(df).collect()), key=str)
    assert got == brute(rows, 100, lambda t: list(t.encode()), bytes, False)
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.dedup(df).collect()), key=str)
    want = brute(rows, 50, lambda t: t.encode().split(), b" ".join, True)
    assert got == sorted(((a, b, c, e) for a, b, c, _, e in want), key=str)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(df).collect() == [] and substring_dedup.dedup(df).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 2 + seed, 700).astype(np.uint8)
    text[300:450] = text[20:170]
    text[460:690] = 0
    order = suffix_dedup.suffix_array(text, 100)
    raw = text.tobytes()
    cut = [raw[i : i + 100] for i in order]
    assert cut == sorted(cut)
    shared = suffix_dedup.common_prefixes(text, order, 100, 64)[order]
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :][:100], raw[order[k] :][:100]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == n


def test_merging_by_binary_search():
    r = random.Random(2)
    lists = [np.asarray(sorted(bytes(r.choices(b"ab\0", k=4)) for _ in range(r.randint(0, 40))), "S4") for _ in range(7)]
    merged = repeats.merge_sorted(lists)
    assert merged.tolist() == sorted({x for own in lists for x in own.tolist()})
    assert len(repeats.merge_sorted([lists[0][:0]])) == 0


def test_a_very_frequent_anchor(spark):
    """One phrase in thousands of different surroundings: one anchor, many parts, many batches of one key."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    phrase = "the very same phrase of words"
    around = [(" ".join(word() for _ in range(6)), " ".join(word() for _ in range(6))) for _ in range(40)]
    rows = [(i, f"{r.choice(around)[0]} {phrase} {r.choice(around)[1]}" if i % 3 else f"{word()} {word()} {word()} {word()} {word()} {phrase} {word()} {word()} {word()}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cfg = RepeatConfig(window=60, gram=24, across_only=False, shard_runs=16)
    found = repeats.find_repeats(df, repeats.ByteUnits(), cfg, lambda shard: suffix_dedup.repeated_windows(shard, 60), lambda units, at: units[at : at + 60])
    got = {x.did: sum(b - a for a, b in repeats.covered(x.runs, 60)) for x in found.collect()}
    want = {d: gone for d, _, gone, _, _ in brute(rows, 60, lambda t: list(t.encode()), bytes, False) if gone}
    assert got == want and len(want) > 500


def test_long_text_is_cut_in_stretches(spark, monkeypatch):
    """Texts beyond one stretch are cut where windows overlap, and removed as if they were whole."""
    r = random.Random(4)
    text = "".join(r.choice("abcdefghij ") for _ in range(30_000))
    rows = [(1, text), (2, "x" * 50 + text[9_900:10_300] + "y" * 50), (3, text[:5_000] + text[20_000:]), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(repeats, "STRETCH", 1 << 13)
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup(df).collect()), key=str)
    assert got == brute(rows, 100, lambda t: list(t.encode()), bytes, False)


def test_runs_of_an_array():
    units = np.random.default_rng(0).integers(0, 1 << 60, 400).astype(np.uint64)
    cfg = RepeatConfig(window=50, gram=16, across_only=True)
    lo, hi, a, key = repeats.anchor_runs(units, np.asarray([400]), cfg)
    assert lo[0] == 0 and hi[-1] == 350 and (lo[1:] == hi[:-1] + 1).all()
    assert ((a >= hi) & (a + 16 <= lo + 50)).all()
