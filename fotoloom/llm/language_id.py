"""Language ID: a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in both directions, spaces and all; at every byte
position the two states together give a probability for each language, and a document's
probabilities are the mean over all its positions. It is trained here in numpy by
backpropagation through time with Adam.

Stretches. A text is labelled in stretches of ``STRETCH`` bytes, so that many run in step. A stretch
is read together with ``MARGIN`` bytes on either side of it: the state that reaches its first
position has seen the bytes (and words) before it, the state that reaches its last one those after
it. Places outside the text leave the state as it is. What a position gets depends on the
text alone, not on the batch it comes in.

Training sample (a documented bound): of the distinct rows with a language, a text and
``crc32(doc_id) % 5 != 0``, those of smallest hash, about ``per_language`` for each language
and twice that at most; of each, ``windows`` windows of ``window`` bytes whose places are drawn
evenly from its whole text. Counts per language cover all rows. Predictions read whole
texts and nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
everything when there is nothing to learn from; a null doc_id hashes as the empty
string; repeated rows are predicted each for itself; of equal probabilities the
language first by code point wins; an empty table gives an empty result. ``classify`` keeps all
columns and adds one of its own, whose name no column has.

Scale: training cost is fixed; prediction is one map, without a shuffle. The weights (a
few ten thousand numbers) travel with the function. Every language with a row outside the
held-out fold is learned; fewer stretches run in step where languages are many.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_chunks, free_name

STRETCH = 256
MARGIN = 32
#: The symbol of a place outside the text.
OUTSIDE = 256
#: Numbers of one language that a batch of stretches may hold for each of its positions.
LANES = 512
WIDE = 16
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageConfig:
    per_language: int = 400
    windows: int = 16
    window: int = 64
    hidden: int = 12
    steps: int = 160
    batch: int = 128
    rate: float = 0.02
    seed: int = 5


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, document) of all stretches: a row holds a stretch's margin, its bytes and the other margin."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // STRETCH)
    room = counts * STRETCH + 2 * MARGIN
    begins = np.cumsum(room) - room + MARGIN
    flat = np.full(int(room.sum()), OUTSIDE, np.int16)
    for t, at in zip(texts, begins.tolist()):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    document = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(document)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = begins[document] + nth * STRETCH - MARGIN
    return flat[first[:, None] + np.arange(STRETCH + 2 * MARGIN)[None, :]], document


def squash(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """``x / (1 + |x|)`` in place, with slope ``(1 - |y|)**2``: the network's sigmoid (numpy's tanh takes ten times as long)."""
    np.abs(x, out=room)
    room += 1
    return np.divide(x, room, out=x)


def _slope(y: np.ndarray) -> np.ndarray:
    return (1 - np.abs(y)) ** 2


class ByteGru:
    """Weights and the forward and backward passes. Both directions run in one loop: index 0 reads forwards, 1 backwards.

    ``x`` holds the input weights of each symbol, ``u`` those of the state, ``b`` the bias, each for
    (update, reset, candidate) and both directions. Gates are ``(1 + squash(a)) / 2``.
    """

    def __init__(self, n_labels: int, hidden: int, seed: int):
        rng, h = np.random.default_rng(seed), hidden
        self.h, self.n = h, n_labels
        normal = lambda *shape: rng.standard_normal(shape)
        self.w = {"x": 0.4 * normal(3, 2, 256, h), "u": 0.8 * h**-0.5 * normal(3, 2, h, h), "b": np.zeros((3, 2, h)), "o": 0.3 * normal(2, h, n_labels), "c": np.zeros(n_labels)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def states(self, symbols: np.ndarray, trace: list | None = None) -> np.ndarray:
        """(time, direction, row, hidden) for (time, direction, row) symbols, each direction in the order it reads."""
        h, w = self.h, self.w
        t_all, _, n = symbols.shape
        # input weights with bias by symbol; outside the update gate is shut
        outside = np.zeros((3, 2, 1, h), w["x"].dtype)
        outside[0] = -1e30
        table = np.concatenate([w["x"] + w["b"][:, :, None, :], outside], axis=2).reshape(3, 2 * (OUTSIDE + 1), h)
        places = (symbols + np.asarray([0, OUTSIDE + 1])[:, None]).reshape(t_all, 2 * n)
        state, room = np.zeros((2, n, h), table.dtype), np.empty((3, 2, n, h), table.dtype)
        out = np.empty((t_all, 2, n, h), table.dtype)
        for t in range(t_all):
            a = np.matmul(state, w["u"])  # update, reset, candidate
            given = table.take(places[t], axis=1).reshape(3, 2, n, h)
            a[:2] += given[:2]
            squash(a[:2], room[:2])
            a[:2] += 1
            a[:2] *= 0.5
            u_c = a[2].copy() if trace is not None else None
            a[2] *= a[1]
            a[2] += given[2]
            squash(a[2], room[2])
            if trace is not None:
                trace.append((state, a[0], a[1], u_c, a[2]))
            new = np.subtract(a[2], state, out=out[t])
            new *= a[0]
            new += state
            state = new
        return out

    def _softmax(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        logits = forward @ self.w["o"][0] + backward @ self.w["o"][1] + self.w["c"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the places of (row, time) windows and its gradients, through time in both directions."""
        w, h = self.w, self.h
        n, t_all = symbols.shape
        both = np.stack([symbols.T, symbols.T[::-1]], axis=1).astype(np.int64)
        trace: list = []
        out = self.states(both, trace)
        ahead, behind = out[:, 0], out[::-1, 1]
        p = self._softmax(ahead, behind)
        keep = (symbols.T < OUTSIDE).astype(p.dtype)
        total = max(1.0, float(keep.sum()))
        right = np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (t_all, n, 1)), axis=2)[..., 0]
        loss = float(-(np.log(right + 1e-9) * keep).sum() / total)
        d_logits = p
        d_logits[:, np.arange(n), labels] -= 1
        d_logits *= (keep / total)[:, :, None]
        g = {"o": np.stack([np.tensordot(s, d_logits, axes=((0, 1), (0, 1))) for s in (ahead, behind)]), "c": d_logits.sum(axis=(0, 1))}
        d_states = np.stack([d_logits @ w["o"][0].T, (d_logits @ w["o"][1].T)[::-1]], axis=1)
        later, g["u"] = np.zeros((2, n, h), p.dtype), np.zeros_like(w["u"])
        inputs, back = np.empty((t_all, 3, 2, n, h), p.dtype), w["u"].transpose(0, 1, 3, 2)
        for t in range(t_all - 1, -1, -1):
            before, z, r, u_c, cand = trace[t]
            later = later + d_states[t]
            d = inputs[t]  # of the three sums that enter the squashes
            d[2] = later * z * _slope(cand)
            d[1] = d[2] * u_c * (0.5 * _slope(2 * r - 1))
            d[0] = later * (cand - before) * (0.5 * _slope(2 * z - 1))
            through = d.copy()
            through[2] *= r
            g["u"] += before.transpose(0, 2, 1) @ through
            later = later * (1 - z) + (through @ back).sum(axis=0)
        g["x"] = np.zeros((3, 2, OUTSIDE + 1, h), p.dtype)
        for k in (0, 1):
            flat = both[:, k].ravel()
            order = np.argsort(flat, kind="stable")
            kinds, at = np.unique(flat[order], return_index=True)
            for j in range(3):
                g["x"][j, k, kinds] = np.add.reduceat(inputs[:, j, k].reshape(-1, h)[order], at, axis=0)
        g["x"] = g["x"][:, :, :OUTSIDE]
        g["b"] = g["x"].sum(axis=2)
        return loss, g

    def train(self, windows: list[np.ndarray], cfg: LanguageConfig) -> None:
        """``windows``: for each label a matrix of (window, byte) symbols; all labels weigh the same."""
        rng = np.random.default_rng(cfg.seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for step in range(1, cfg.steps + 1):
            labels = np.sort(rng.integers(0, len(windows), cfg.batch))
            rows = np.concatenate([windows[k][rng.integers(0, len(windows[k]), n)] for k, n in enumerate(np.bincount(labels, minlength=len(windows))) if n])
            _, g = self.gradients(rows, labels)
            rate = cfg.rate * (1 - 0.9 * step / cfg.steps)
            for k, x in g.items():
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def text_sums(self, texts: list[bytes]) -> np.ndarray:
        """Position probabilities summed over each text: (text, label)."""
        sums = np.zeros((len(texts), self.n))
        symbols, document = stretches(texts)
        size = max(1, LANES * WIDE // max(WIDE, self.n))
        for at in range(0, len(document), size):
            some = symbols[at : at + size].astype(np.int64)
            n = len(some)
            read = np.stack([some[:, : MARGIN + STRETCH].T, some[:, : MARGIN - 1 : -1].T], axis=1)
            out = self.states(read)
            p = self._softmax(out[MARGIN:, 0], out[: MARGIN - 1 : -1, 1])
            p *= (some[:, MARGIN : MARGIN + STRETCH].T < OUTSIDE)[:, :, None]
            np.add.at(sums, document[at : at + n], p.sum(axis=0))
        return sums


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    net: ByteGru | None


def _window_rows(cfg: LanguageConfig):
    """Cut each sampled text's windows, at places drawn by a hash of the text."""

    def run(batches):
        for batch in byte_chunks(batches, 8 << 20):
            langs, cut = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                n = len(text) - cfg.window
                count = min(cfg.windows, -(-len(text) // cfg.window))
                at = np.random.default_rng(zlib.crc32(text)).integers(0, max(n, 0) + 1, count).tolist() if n > 0 else [0] * count
                cut += [text[a : a + cfg.window] for a in at]
                langs += [lang] * count
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(cut, pa.binary())], names=["lang", "window"])

    return run


def train_language_model(docs: DataFrame, cfg: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Fit on the bounded sample that the module's docstring describes."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "doc_id", "text")
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return LanguageModel((), None)
    # a hash range that is expected to hold per_language rows of each language
    shares = [(r["lang"], min(1.0, cfg.per_language / r["count"])) for r in counts]
    share = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    place = (F.xxhash64("doc_id", "text", F.lit(cfg.seed)).bitwiseAND(F.lit((1 << 32) - 1))).cast("double") / float(1 << 32)
    near = known.join(F.broadcast(share), "lang").where(place < F.col("share")).select("lang", "doc_id", F.col("text").cast("binary").alias("text")).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id", "text"))
    rows = near.withColumn("nth", nth).where(F.col("nth") <= 2 * cfg.per_language).select("lang", "text")
    cut = rows.mapInArrow(_window_rows(cfg), "lang string, window binary").collect()
    by_lang: dict[str, list[bytes]] = {}
    for lang, window in sorted(((r["lang"], bytes(r["window"])) for r in cut), key=lambda x: (x[0].encode(), x[1])):
        by_lang.setdefault(lang, []).append(window)
    if not by_lang:
        return LanguageModel((), None)
    windows = []
    for some in by_lang.values():
        rows_ = np.full((len(some), cfg.window), OUTSIDE, np.int16)
        for row, t in zip(rows_, some):
            row[: len(t)] = np.frombuffer(t, np.uint8)
        windows.append(rows_)
    net = ByteGru(len(by_lang), cfg.hidden, cfg.seed)
    net.train(windows, cfg)
    return LanguageModel(tuple(by_lang), net)


def predict(model: LanguageModel, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    at = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.net is not None else []
    if at:
        sums = model.net.text_sums([texts[i] for i in at])
        means = sums / sums.sum(axis=1, keepdims=True)  # each position's probabilities sum to 1
        for i, best, score in zip(at, means.argmax(axis=1).tolist(), means.max(axis=1).tolist()):
            names[i], scores[i] = model.labels[best], round(min(1.0, score), 6)
    return names, scores


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def classify(docs: DataFrame, model: LanguageModel) -> tuple[DataFrame, str]:
    """``docs`` with a column struct<lang_pred, score>, and that column's name. All other columns pass through untouched."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(docs.columns, "prediction")

    def run(batches):
        for batch in byte_chunks(batches, 1 << 20):
            langs, scores = predict(shared.value, batch.column("bytes").to_pylist())
            yield pa.record_batch([batch.column("doc"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc", "lang_pred", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").cast("binary").alias("bytes"))
    kind = packed.schema["doc"].dataType.simpleString()
    out = packed.mapInArrow(run, f"doc {kind}, lang_pred string, score double")
    return out.select("doc.*", F.struct("lang_pred", "score").alias(name)), name


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the network rejects: those it gives no language with at least ``min_score``.

    Half is a majority: no other language, nor all others together, can be as likely. Where no row has a
    language to learn from nothing can be told, and only texts without a letter go.
    """
    model = train_language_model(docs)
    if model.net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out, name = classify(docs, model)
    return out.where((F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.score") >= min_score)).drop(name)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out, name = classify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), train_language_model(docs))
    return out.select("doc_id", "held_out", f"{name}.lang_pred", f"{name}.score")
