"""The pipeline's stages against brute force on the smallest tables."""

import collections
import hashlib
import os

import numpy as np
import pytest

import corpus_pipeline
from fotoloom.llm.mixing import MixConfig
from fotoloom.llm.language_id import predict, train_language_model
from fotoloom.llm.token_output import DEFAULT_RANKS, Encoder, OutputConfig, read_ranks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def words(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_language_stage_without_labels(spark):
    rows = [(1, "the cat", None), (2, None, None), (3, "12 !", None), (4, "ñ", None), (5, "中", None), (6, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = corpus_pipeline.language(spark, docs, SF)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 4, 5]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    made = [docs]
    for _, step in corpus_pipeline.STAGES[:-1]:
        made.append(step(spark, made[-1], SF).cache())
        assert made[-1].columns == columns
    read, lang, near, clean, mix = [df.collect() for df in made]
    names, scores = predict(train_language_model(docs), [(r.text or "").encode() for r in read])
    sure = {r.doc_id for r, name, score in zip(read, names, scores) if name != "und" and score >= 0.5}
    assert {r.doc_id for r in lang} == sure and len(sure) > 0.95 * len(read)
    # one of each component
    sets = {r.doc_id: shingles(r.text) for r in lang}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in near) == sorted(d for d in ids if root(d) == d)
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in near if any(i and 100 * len(i & shingles(r.text)) >= 75 * len(i) for i in items)}
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in near if r.doc_id not in leaked)
    sizes = collections.Counter()
    for r in clean:
        sizes[r.source] += len((r.text or "").encode().split())
    taken = collections.Counter()
    copies = collections.Counter(r.doc_id for r in mix)
    for r in clean:
        taken[r.source] += copies[r.doc_id] * len((r.text or "").encode().split())
    cap = MixConfig().cap
    assert max(copies.values()) <= cap and set(copies) <= {r.doc_id for r in clean}
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())
    out = corpus_pipeline.STAGES[-1][1](spark, made[-1], SF).collect()
    encoder, cfg = Encoder(read_ranks(DEFAULT_RANKS)), OutputConfig()
    want = collections.Counter()
    for r in mix:
        ids = np.frombuffer(encoder.encode(r.text or ""), "<u2").tolist() + [cfg.end_of_text]
        for k in range(0, len(ids), cfg.seq_len):
            some = ids[k : k + cfg.seq_len]
            record = np.asarray(some + [cfg.end_of_text] * (cfg.seq_len - len(some)), "<u2")
            want[(r.doc_id, k // cfg.seq_len, len(some), hashlib.md5(record.tobytes()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.seq_no, r.n_tokens, r.digest) for r in out) == want
    assert sorted(r.slot for r in out) == list(range(len(out)))


def test_odd_tables(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, and no rows at all, through all stages."""
    prose = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL").limit(40).collect()]
    rows = [(i, t, lang, f"s{i % 3}", 1) for i, (t, lang) in enumerate(prose)]
    rows += [(None, prose[3][0] + " and more words than before", None, None, None), (None, None, None, None, None), (50, "", "en", "s1", 0), (51, "  \n", None, None, 2), (52, "123 456", None, "s2", 3)]
    rows += [rows[5], rows[5], (None, "one text without an id, twice", "en", None, None), (None, "one text without an id, twice", "en", None, None), (60, " ".join(t for t, _ in prose) * 20, "en", "s0", 4)]
    extra = "rate int, target int, copies int, shard int, token int, cid int, label int, a int, b int, prediction int, leaked int, plan int, rk int, _rk int, slot int"
    df = spark.createDataFrame([(*r, *range(15)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for table in (df, df.limit(0)):
        docs = table
        for name, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, SF).cache()
            assert docs.columns == df.columns, name
            assert {tuple(r)[5:] for r in docs.collect()} <= {tuple(range(15))}
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert sorted(r.slot for r in out) == list(range(len(out))) and bool(out) == (table is df)
        if table is df:
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(t and any(c.isalpha() for c in t) for _, t in kept)
            assert all(kept.count(k) <= 2 for k in kept)
