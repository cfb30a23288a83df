import random

import pytest

from fotoloom.operators.components import components
from fotoloom.llm.jaccard_join import JoinConfig, drop_near_duplicates, near_duplicate_components, need, unfinished_pairs


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    line = [r.choice(vocab) for _ in range(25)]
    rows, base = [], [r.choice(vocab) for _ in range(120)]
    for i in range(60):  # a large group of near copies, some of them only linked through others
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    for i in range(60, 130):
        w = [r.choice(vocab) for _ in range(r.choice([1, 3, 5, 9, 40, 90]))] + line * (i % 2)
        rows.append((i, " ".join(w)))
        if i % 5 == 0:
            w[r.randrange(len(w))] = "Changed"
            rows.append((i + 1000, " ".join(w)))
    rows += [(2000, None), (2001, "  "), (None, rows[70][1]), (None, "all alone here"), (2002, "Same Set here ok"), (2003, "same set HERE ok"), (5, rows[90][1]), (90, rows[90][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,cfg", [(1, JoinConfig()), (2, JoinConfig(short_list=2, partners_of_salt=3, list_rows=4, block_rows=7))])
def test_components_against_brute_force(spark, seed, cfg):
    rows = corpus(seed)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, cid int").repartition(3)
    got = near_duplicate_components(df, cfg).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_groups_of_one_prefix(spark):
    """Many sets share their prefix and size; some link to their group's first member, some only to others, some to none."""
    r = random.Random(8)
    word = lambda: f"v{r.randrange(10**6)}"
    rows, common = [], [[word() for _ in range(30)] for _ in range(4)]
    for k in range(5):
        base = [word() for _ in range(60)]
        for i in range(30):
            w = list(base)
            w[r.randrange(60)] = f"edit{r.randrange(3)}"
            rows.append((1000 * k + i, " ".join(w + (r.choice(common) if i % 2 else []))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cfg in (JoinConfig(short_list=3), JoinConfig(list_rows=4, block_rows=5)):
        got = near_duplicate_components(df, cfg).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_words_are_told_apart(spark):
    # words of the Thue-Morse sequence and its complement: sums of powers can't tell them apart
    morse = lambda n, flip: "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))
    rows = [(10 * n + flip, morse(n, flip)) for n in (64, 1024, 2048, 4096) for flip in (0, 1)]
    rows += [(7, "long " * 50_000), (8, "long " * 60_000), (9, "x" * 1_000_000 + " tail of a text"), (6, "x" * 1_000_000 + " tail of a text")]
    got = near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_one_stays_of_null_ids(spark):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (None, "one two three four five SIX"), (None, "something else that is quite alone here"), (None, None), (None, None), (3, ""), (4, "one two three four five six")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rk string")
    kept = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(df).collect()), key=str)
    assert kept == sorted([rows[3], rows[4], rows[5], rows[6], rows[7]], key=str)


def test_one_stays(spark):
    rows = [r for r in corpus(3) if r[0] is not None and r[0] not in (5, 90)]
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, c in brute(rows) if d == c)


def test_empty(spark):
    assert near_duplicate_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.id, r.label) for r in components(edges).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100), (101, 100)}


MEMBERS = "token long, cid long, n long, pos int, comp long"


def fitting(rows):
    by, out = {}, set()
    for token, cid, n, pos, comp in rows:
        by.setdefault(token, []).append((cid, n, pos, comp))
    for m in by.values():
        for i, (c, n, p, k) in enumerate(m):
            out |= {(min(c, d), max(c, d)) for d, o, q, e in m[:i] if k != e and need(n, o) <= min(n - p, o - q)}
    return out


@pytest.mark.parametrize("block_rows", [3, 20, 1000])
def test_second_round_misses_no_pair(spark, block_rows):
    r = random.Random(block_rows)
    rows = []
    for token, size in ((1, 150), (2, 80), (3, 21), (4, 2)):
        for cid in r.sample(range(-300, 300), size):
            n = r.choice([r.randint(1, 12), r.randint(13, 60), r.randint(61, 400), 100])
            rows.append((token, cid, n, r.randint(0, n // 4), r.choice([cid, 7, 7, -8])))
    # sizes and places at the very edge of what fits
    rows += [(5, i, n, p, i) for i, (n, p) in enumerate([(75, 0), (100, 25), (76, 1), (99, 24), (56, 8), (56, 7), (3, 0), (4, 1), (1, 0), (2, 0)])]
    got = [tuple(x) for x in unfinished_pairs(spark.createDataFrame(rows, MEMBERS).repartition(3), JoinConfig(block_rows=block_rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == fitting(rows)


def shuffled(plan):
    """The rows that the shuffles of an executed plan have written."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled(plan.executedPlan())
    if "QueryStage" in name:
        return shuffled(plan.plan())
    found = plan.metrics().get("shuffleRecordsWritten")
    children = plan.children()
    return (found.get().value() if name == "Exchange" and found.isDefined() else 0) + sum(shuffled(children.apply(i)) for i in range(children.size()))


def test_second_round_grows_with_its_pairs(spark):
    """A crowd in one component and loners in its list, few of which fit: rows are not sent to every block of the list."""
    sent = []
    for k in (1, 4):
        crowd = [(1, i, 100, 10, 0) for i in range(400 * k)]
        loners = [(1, 10_000 + i, 101, 15, 10_000 + i) for i in range(400 * k)]
        few = [(1, 20_000 + i, 100 + i, 12, 20_000 + i) for i in range(2)]
        df = unfinished_pairs(spark.createDataFrame(crowd + loners + few, MEMBERS), JoinConfig(block_rows=16))
        pairs = {tuple(x) for x in df.collect()}
        assert pairs == fitting(crowd + few) and 0 < len(pairs) <= 2 * len(crowd) + 1
        sent.append(shuffled(df._jdf.queryExecution().executedPlan()))
    assert sent[0] <= 4 * 800 and sent[1] <= 5 * sent[0]
