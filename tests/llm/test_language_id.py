import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from fotoloom.llm.language_id import MARGIN, OUTSIDE, STRETCH, ByteGru, LanguageConfig, LanguageModel, classify, held_out, op7_language_id, predict, stretches, train_language_model


def naive_sums(net, text):
    """The position probabilities of a text, summed: one position, direction and unit after another in plain Python."""
    w, h = {k: v.astype(float).tolist() for k, v in net.w.items()}, net.h
    squash = lambda a: a / (1 + abs(a))

    def step(d, state, byte):
        dot = lambda g, j: sum(state[i] * w["u"][g][d][i][j] for i in range(h))
        given = lambda g, j: w["x"][g][d][byte][j] + w["b"][g][d][j]
        z = [(1 + squash(dot(0, j) + given(0, j))) / 2 for j in range(h)]
        r = [(1 + squash(dot(1, j) + given(1, j))) / 2 for j in range(h)]
        c = [squash(r[j] * dot(2, j) + given(2, j)) for j in range(h)]
        return [s + z[j] * (c[j] - s) for j, s in enumerate(state)]

    total = [0.0] * net.n
    for begin in range(0, len(text), STRETCH):
        end = min(begin + STRETCH, len(text))
        ahead, behind, state = {}, {}, [0.0] * h
        for i in range(max(0, begin - MARGIN), end):
            state = ahead[i] = step(0, state, text[i])
        state = [0.0] * h
        for i in range(min(len(text), end + MARGIN) - 1, begin - 1, -1):
            state = behind[i] = step(1, state, text[i])
        for i in range(begin, end):
            logits = [sum(ahead[i][j] * w["o"][0][j][k] + behind[i][j] * w["o"][1][j][k] for j in range(h)) + w["c"][k] for k in range(net.n)]
            e = [math.exp(x - max(logits)) for x in logits]
            total = [t + x / sum(e) for t, x in zip(total, e)]
    return total


def test_forward_pass_matches_a_naive_one():
    net = ByteGru(3, 4, 2)
    texts = [b"a", b"le chat dort " * 50, b"x" * STRETCH, b"y z" * 100, bytes(range(256)) * 2 + b"end"]
    got = net.text_sums(texts)
    for text, row in zip(texts, got):
        assert np.allclose(row, naive_sums(net, text), rtol=1e-3, atol=1e-3) and abs(row.sum() - len(text)) < 1e-2


def test_state_crosses_words_and_stretches():
    net = ByteGru(2, 4, 3)
    first = lambda text: net.text_sums([text])[0]
    # the probabilities of a text are not the sum of those of its words
    assert not np.allclose(first(b"abc def"), first(b"abc") + first(b" ") + first(b"def"), atol=1e-4)
    symbols, document = stretches([b"q" * (STRETCH + 5), b"rr"])
    assert document.tolist() == [0, 0, 1] and symbols.shape == (3, STRETCH + 2 * MARGIN)
    assert (symbols[1, :MARGIN] == ord("q")).all() and (symbols[0, :MARGIN] == OUTSIDE).all() and (symbols[2, MARGIN + 2 :] == OUTSIDE).all()


def test_gradients_match_differences():
    net = ByteGru(3, 4, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    symbols = np.full((4, 6), OUTSIDE)
    for row, text in zip(symbols, (b"the ca", b"ein", b"a b", b"lequel")):
        row[: len(text)] = np.frombuffer(text, np.uint8)
    labels = np.asarray([0, 1, 0, 2])
    _, g = net.gradients(symbols, labels)
    rng = np.random.default_rng(0)
    for k, w in net.w.items():
        for _ in range(8):
            i = [int(rng.integers(0, s)) for s in w.shape]
            if k == "x":
                i[2] = int(symbols[rng.integers(0, 4), 0])
            i, old = tuple(i), w[tuple(i)]
            w[i] = old + 1e-4
            up, _ = net.gradients(symbols, labels)
            w[i] = old - 1e-4
            down, _ = net.gradients(symbols, labels)
            w[i] = old
            assert abs((up - down) / 2e-4 - g[k][i]) < 1e-5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    got = op7_language_id(spark, sf).join(truth, "doc_id").where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert got[1] > 100 and got[0] > 0.97


def test_edges(spark):
    rows = [(i, ("the cat is here now " if i % 2 else "el gato que come pan ") * 5, "en" if i % 2 else "es", "x") for i in range(60)]
    rows += [(100, None, None, "x"), (101, "", "en", "x"), (102, "1234 !!", "en", "x"), (None, "the cat is here", None, "x"), (103, "el gato que come pan " * 4000, None, "x"), (1, rows[1][1], "en", "x"), (104, "ñ", None, "x")]
    # a very long text is read to its end: most of it is Spanish
    rows.append((105, "the cat is here now " * 200 + "el gato que come pan " * 5000, None, "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Prediction string").withColumn("score", F.lit("kept"))
    model = train_language_model(df, LanguageConfig(steps=80))
    out, name = classify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "Prediction", "score", "_prediction"] and name == "_prediction"
    found = out.collect()
    assert len(found) == len(rows) and all(r.score == "kept" for r in found)
    got = {(r.doc_id, r.text): r["_prediction"] for r in found}
    assert all(got[(i, None if i == 100 else "" if i == 101 else "1234 !!")].lang_pred == "und" for i in (100, 101, 102))
    assert got[(None, "the cat is here")].lang_pred == "en" and got[(104, "ñ")].lang_pred in ("en", "es")
    assert got[(103, "el gato que come pan " * 4000)].lang_pred == "es" and next(v for (i, _), v in got.items() if i == 105).lang_pred == "es"
    assert all(0 <= r.score <= 1 for r in got.values())
    for r in df.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
    nothing = train_language_model(df.withColumn("lang", F.lit(None).cast("string")))
    assert nothing == LanguageModel((), None) and {r[0] for r in classify(df, nothing)[0].select("_prediction.lang_pred").collect()} == {"und"}
    assert classify(df.limit(0), model)[0].collect() == []
    # what a text gets doesn't depend on its neighbours
    assert predict(model, ["el gato".encode()])[0] == predict(model, [b"the cat is here now " * 40, "el gato".encode(), None])[0][1:2]


def test_training_reads_whole_texts(spark):
    # only what follows the first 20,000 bytes tells the languages apart
    rows = [(i, "0123 456 " * 2200 + ("the cat is here now " if i % 2 else "el gato que come pan ") * 2000, "en" if i % 2 else "es") for i in range(20)]
    model = train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), LanguageConfig(steps=80))
    assert predict(model, [b"the cat is here now " * 9, b"el gato que come pan " * 9])[0] == ["en", "es"]


def test_more_than_64_languages(spark):
    # language k has 12 + k rows, each of letters of its own
    rows = [(200 * k + i, chr(0x4E00 + 64 * k) * 20, f"l{k:02}") for k in range(70) for i in range(12 + k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_language_model(df, LanguageConfig(steps=300))
    assert model.labels == tuple(f"l{k:02}" for k in range(70)) and model.net.n == 70
    out, name = classify(df, model)
    wrong = {r.lang for r in out.where(f"lang != {name}.lang_pred").select("lang").distinct().collect()}
    assert len(wrong) < 7


def test_a_repeated_id_crowds_out_no_language(spark):
    cfg = LanguageConfig(per_language=20, steps=60)
    rows = [(i, "the cat is here", "zz") for i in range(40)] + [(7, "el gato que come", "aa") for _ in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~held_out(F.col("doc_id")) | (F.col("lang") == "zz"))
    model = train_language_model(df, cfg)
    assert "zz" in model.labels and predict(model, [b"the cat is here"])[0] == ["zz"]
