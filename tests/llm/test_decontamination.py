import random

from pyspark.sql import functions as F

from fotoloom.llm import decontamination
from fotoloom.llm.decontamination import candidate_pairs, contained_items, decontaminate, item_index


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def test_against_brute_force(spark):
    r = random.Random(0)
    vocab = [f"W{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 5, 8, 20, 60])))) for i in range(12)] + [(50, None), (51, ""), (3, "W1 W2 W3 W4 W5 W6")]
    docs = []
    for i in range(80):
        w = [r.choice(vocab) for _ in range(r.choice([2, 40, 900]))]
        if i % 2:
            part = r.choice(items[:12])[1].split()
            part = part[: max(3, int(len(part) * r.choice([0.6, 0.8, 0.9, 1.0])))]
            at = r.randint(0, len(w))
            w[at:at] = part
        docs.append((i, " ".join(w).lower() if i % 3 else "\n".join(w)))
    docs += [(200, None), (201, ""), (None, items[4][1]), (None, "clean null id text of some words"), (7, docs[7][1]), (202, items[0][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    d_sets, i_sets = {}, {}
    for d, t in docs:
        d_sets.setdefault(d, set()).update(shingles(t))
    for i, t in items:
        i_sets.setdefault(i, set()).update(shingles(t))
    want = {(d, i, len(y), len(x & y)) for d, x in d_sets.items() for i, y in i_sets.items() if y and 100 * len(x & y) >= 75 * len(y)}
    got = contained_items(df, bench).collect()
    assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got} == want and len(got) == len(want) > 10
    left = decontaminate(df, bench)
    assert left.columns == df.columns
    clean = [(d, t) for d, t in docs if not any(y and 100 * len(shingles(t) & y) >= 75 * len(y) for y in i_sets.values())]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(clean, key=str)
    assert contained_items(df.limit(0), bench).collect() == [] and contained_items(df, bench.limit(0)).collect() == []


def test_signatures_find_the_pairs(spark, monkeypatch):
    r = random.Random(1)
    word = lambda: f"t{r.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 5, 7, 12, 30, 200))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = item_index(bench)
    rows = index.collect()
    quota = {i: sum(x.in_signature for x in rows if x.item_id == i) for i, _ in items}
    size = {i: sum(x.item_id == i for x in rows) for i, _ in items}
    # enough that a contained item meets one, and no more than its size's partition asks for
    assert all(quota[i] > 0.25 * n - 1e-9 for i, n in size.items()) and quota[5] < 0.35 * size[5] and quota[4] < 0.35 * size[4]
    docs = spark.createDataFrame([(i, f"{word()} {t} {word()}" if len(t.split()) >= 5 else t) for i, t in items], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in contained_items(docs, bench).collect()} == {(i, i) for i, _ in items}
    # a document that holds many of an item's shingles, but none of its signature, is never looked at
    signature = {x.shingle for x in rows if x.item_id == 5 and x.in_signature}
    w = items[5][1].split()
    rest = [" ".join(w[k : k + 5]) for k in range(len(w) - 4) if " ".join(w[k : k + 5]) not in signature]
    unsigned = spark.createDataFrame([(1, " | ".join(rest))], "key long, text string")
    assert candidate_pairs(unsigned, index).collect() == []
    # nothing but the signatures finds pairs
    real = decontamination.item_index
    monkeypatch.setattr(decontamination, "item_index", lambda *a: real(*a).withColumn("in_signature", F.lit(False)))
    assert contained_items(docs, bench).collect() == []


def test_null_ids_are_documents_of_their_own(spark):
    item = " ".join(f"q{i}" for i in range(20))
    w = item.split()
    docs = [(None, " ".join(w[:11])), (None, " ".join(w[9:])), (None, item.upper()), (1, " ".join(w[:11])), (1, " ".join(w[9:])), (2, "long " * 200_000 + item)]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, leaked string")
    bench = spark.createDataFrame([(7, item), (7, item), (None, None)], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_shared) for r in contained_items(df, bench).collect()), key=str)
    assert got == sorted([(None, 16), (1, 14), (2, 16)], key=str)
    assert sorted((r.text for r in decontaminate(df, bench).collect()), key=str) == sorted([docs[0][1], docs[1][1], docs[3][1], docs[4][1]])
