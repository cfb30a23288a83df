"""Finding windows that repeat across a corpus without sending the corpus around.

A window is ``window`` consecutive units (bytes or words) of one document. Its anchor is
the ``gram`` of units of smallest hash inside it, the first of equal ones; equal windows
have equal anchors at equal places. A document's windows thus fall into runs of one
anchor each, on average one run for every ``(window - gram + 2) / 2`` units, and only runs that
share an anchor can hold equal windows. That is all the shuffle has to carry:

1. ``anchor_rows``: each run as (anchor hash, 128-bit digest of the run's units, document, place).
   Runs that repeat inside a batch are settled on the spot, so that a run copied into a
   third of all documents leaves each batch once.
2. ``settle_by_anchor``: rows partitioned and sorted by anchor are streamed. A run equal to an
   earlier one is settled: all its windows repeat. Of equal runs the first stands for all from here on; what it shares with
   runs that have its anchor but are not equal (the ends of repeats) has to be looked at. Two runs that differ would be taken for equal
   with a chance of 2^-128: for the 10^13 runs of 100 TB, 10^26 pairs at most, that is 3 in 10^13.
3. ``fetch_contexts``: the units of those runs are cut from the texts. They form shards: whole
   anchors, or, for an anchor with more than ``shard_runs`` runs, numbered parts of one.
   The operator compares the windows inside a shard by its own method.
4. ``merge_parts``: where an anchor has several parts, the sorted distinct windows of each part are cut into
   buckets, and a bucket's lists are merged one into the other by binary search.
5. ``collect_removals``: settled runs and windows, one list for each document.

Order of documents: by doc_id, null first. A document is a doc_id and ``tie``, the 64-bit
hash of its text. Rows that repeat a doc_id and text are one document; rows that share a doc_id but not the text precede neither each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_chunks, release, stage

NULL_ID = -(1 << 63)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64(0xFFFFFF)
#: Units of a very long text that are looked at in one go; places inside have to fit ``_PLACE``.
STRETCH = 1 << 23


@dataclass(frozen=True)
class RepeatConfig:
    window: int
    gram: int
    #: Only windows of documents with smaller ids count, not earlier ones of the same document.
    across_only: bool
    shard_runs: int = 2048
    chunk_bytes: int = 4 << 20


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * _M1 + (b ^ (b >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def load8(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each position, as one number; zeros follow the end."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(-(-n // 8) * 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (n + 8) // 8 * 8].view(np.uint64)
        out[k::8] = part[: len(out[k::8])]
    return out[:n]


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` units that start at each position (bytes: gram is a multiple of 8)."""
    if units.dtype == np.uint8:
        level, size = load8(units), 8
        level = mix(level, level)
    else:
        level, size = units, 1
    one, have = (level, size), None
    left = gram // size
    # binary decomposition of the gram over doubled spans
    while left:
        if left & 1:
            if have is None:
                have = one
            else:
                m = min(len(have[0]), len(one[0]) - have[1])
                have = (mix(have[0][: max(m, 0)], one[0][have[1] : have[1] + max(m, 0)]), have[1] + one[1])
        left >>= 1
        if left:
            v, s = one
            m = max(len(v) - s, 0)
            one = (mix(v[:m], v[s : s + m]), 2 * s)
    n = max(len(units) - gram + 1, 0)
    return have[0][:n]


def anchor_runs(units: np.ndarray, ends: np.ndarray, cfg: RepeatConfig):
    """(first window, last window, anchor, anchor hash) of the runs of concatenated documents.

    ``ends``: where each document ends in ``units``.
    """
    none = np.empty(0, np.int64)
    w, span = cfg.window, cfg.window - cfg.gram + 1
    if len(units) < w:
        return none, none, none, np.empty(0, np.uint64)
    h = gram_hashes(units, cfg.gram)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    at = (low & _PLACE).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(ends - starts - w + 1, 0)
    some = counts > 0
    starts, counts = starts[some], counts[some]
    if not len(starts):
        return none, none, none, np.empty(0, np.uint64)
    breaks = np.cumsum(counts) - counts
    index = np.arange(int(counts.sum())) + np.repeat(starts - breaks, counts)
    anchors = at[index]
    fresh = np.empty(len(index), bool)
    fresh[0] = True
    fresh[1:] = anchors[1:] != anchors[:-1]
    fresh[breaks] = True
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(index)) - 1
    return index[first], index[last], anchors[first], h[anchors[first]]


def document_ranks(did: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Dense ranks of documents, in the order of ids."""
    order = np.lexsort((tie, did))
    d, t = did[order], tie[order]
    rank = np.zeros(len(did), np.int64)
    if len(did):
        rank[order] = np.cumsum(np.concatenate([[False], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
    return rank


def repeats_earlier(kind: np.ndarray, doc: np.ndarray, did: np.ndarray, lo: np.ndarray, across_only: bool) -> np.ndarray:
    """For things of equal ``kind`` (small numbers): a mask of those that repeat an earlier one.

    ``doc``: ranks of the documents, rising with ``did``. One sort by (kind, doc); the earliest place inside
    a document is a minimum over its stretch.
    """
    n = len(kind)
    gone = np.zeros(n, bool)
    if n < 2:
        return gone
    both = kind * (int(doc.max()) + 1) + doc
    order = np.argsort(both)
    k, b, d = kind[order], both[order], did[order]
    index = np.arange(n)
    new_kind = np.concatenate([[True], k[1:] != k[:-1]])
    mask = d > d[np.maximum.accumulate(np.where(new_kind, index, 0))]
    if not across_only:
        begins = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        p = lo[order]
        first = np.minimum.reduceat(p, begins)
        mask |= p > np.repeat(first, np.diff(np.append(begins, n)))
    gone[order] = mask
    return gone


def _kinds(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the distinct rows of the columns."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), bool)
    for c in columns:
        own = c[order]
        fresh[1:] |= own[1:] != own[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _pack(lo, a, n):
    return (lo << 16) | (a << 8) | n


class ByteUnits:
    """Units are bytes."""

    def of(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8)

    def cut(self, text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        return [text[a:b] for a, b in spans]


class WordUnits:
    """Units are words, as 64-bit hashes of their bytes."""

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def cut(self, text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[a:b]) for a, b in spans]


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64("text").alias("tie"),
    )


_ROW = "key long, run long, more long, did long, tie long, pos long"
_NAMES = ["key", "run", "more", "did", "tie", "pos"]


def _batch(*columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(c).view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=_NAMES)


def anchor_rows(docs: DataFrame, units, cfg: RepeatConfig) -> DataFrame:
    """Runs as (key, run, more, did, tie, pos), digests in two halves; those settled inside a batch have run = 0 and any key."""

    stretch = STRETCH

    def scan(batches):
        for batch in byte_chunks(batches, cfg.chunk_bytes):
            did, tie = batch.column("did").to_numpy(), batch.column("tie").to_numpy()
            texts = [units.of(t) for t in batch.column("text").to_pylist()]
            for a in range(0, len(texts), 4096):
                some = texts[a : a + 4096]
                ends = np.cumsum([len(t) for t in some])
                if int(ends[-1]) < 2 * stretch:
                    yield from runs(np.concatenate(some), ends, did[a : a + 4096], tie[a : a + 4096])
                else:  # a very long text by itself, in overlapping stretches
                    for i, t in enumerate(some):
                        step = stretch - cfg.window
                        for at in range(0, max(len(t) - cfg.window + 1, 1), step):
                            part = t[at : at + step + cfg.window - 1]
                            yield from runs(part, np.asarray([len(part)]), did[a + i : a + i + 1], tie[a + i : a + i + 1], at)

    def runs(flat, ends, did, tie, offset=0):
        lo, hi, anchor, key = anchor_runs(flat, ends, cfg)
        if not len(lo):
            return
        doc = np.searchsorted(ends, lo, side="right")
        raw, size = memoryview(np.ascontiguousarray(flat).view(np.uint8)), flat.itemsize
        digest = xxhash.xxh3_128_digest
        halves = np.frombuffer(b"".join(digest(raw[a * size : b * size]) for a, b in zip(lo.tolist(), (hi + cfg.window).tolist())), np.uint64).reshape(-1, 2)
        run, more = halves[:, 0] | np.uint64(1), np.ascontiguousarray(halves[:, 1])
        starts = np.concatenate([[0], ends[:-1]])
        pos = _pack(lo - starts[doc] + offset, anchor - lo, hi - lo + 1)
        kind = _kinds(run, more)
        settled = repeats_earlier(kind, document_ranks(did, tie)[doc], did[doc], lo - starts[doc], cfg.across_only)
        run[settled] = 0
        key[settled] = mix(pos[settled].astype(np.uint64), did[doc][settled].astype(np.uint64))  # anywhere, evenly
        yield _batch(key, run, more, did[doc], tie[doc], pos)

    return _identified(docs).mapInArrow(scan, _ROW)


def settle_by_anchor(rows: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """Settled runs as (did, tie, pos, key null) and runs to compare as (did, tie, pos, key, part, n_parts)."""
    schema = "did long, tie long, pos long, key long, part int, n_parts int"

    def out(did, tie, pos, key=None, part=None, n_parts=1):
        n = len(did)
        keys = pa.nulls(n, pa.int64()) if key is None else pa.array(key)
        parts = pa.nulls(n, pa.int32()) if part is None else pa.array(part.astype(np.int32))
        counts = pa.nulls(n, pa.int32()) if part is None else pa.array(np.broadcast_to(np.asarray(n_parts, np.int32), n))
        return pa.record_batch([pa.array(did), pa.array(tie), pa.array(pos), keys, parts, counts], names=["did", "tie", "pos", "key", "part", "n_parts"])

    def compare(key, run, more, did, tie, pos):
        """Rows left over, sorted by key: emit those of keys with at least two different runs."""
        if len(key) < 2:
            return
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(begins, len(key)))
        group = np.repeat(np.arange(len(begins)), sizes)
        kind = _kinds(group, run, more)
        some = (np.maximum.reduceat(kind, begins) > np.minimum.reduceat(kind, begins))[group]
        if some.any():
            ordinal = np.arange(len(key)) - begins[group]
            yield out(did[some], tie[some], pos[some], key[some], (ordinal // cfg.shard_runs)[some], (-(-sizes // cfg.shard_runs))[group][some])

    def stream(batches):
        none = tuple(np.empty(0, np.int64) for _ in _NAMES)
        hold, wait, waiting = none, [], 0  # what is left of the key not yet ended; its rows that came later

        def settle(columns):
            """Settle whole rows; returns what is left and the batch of what is settled."""
            key, run, more, did, tie, pos = columns
            gone = repeats_earlier(_kinds(key, run, more), document_ranks(did, tie), did, pos >> 16, cfg.across_only)
            return tuple(c[~gone] for c in columns), out(did[gone], tie[gone], pos[gone])

        for batch in batches:
            rows_ = tuple(batch.column(c).to_numpy() for c in _NAMES)
            done = rows_[1] == 0
            if done.any():
                yield out(*(c[done] for c in rows_[3:]))
                rows_ = tuple(c[~done] for c in rows_)
            if not len(rows_[0]):
                continue
            wait.append(rows_)
            waiting += len(rows_[0])
            # a key that goes on and on is settled whenever its rows have doubled
            if rows_[0][0] == rows_[0][-1] and (not len(hold[0]) or hold[0][0] == rows_[0][0]) and waiting < max(1 << 16, len(hold[0])):
                continue
            rows_ = tuple(np.concatenate(parts) for parts in zip(hold, *wait))
            wait, waiting = [], 0
            key = rows_[0]
            # single rows are the rule: look at groups only, and at the last key, which may go on
            same = key[1:] == key[:-1]
            many = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (key == key[-1])
            left, settled = settle(tuple(c[many] for c in rows_))
            yield settled
            going = left[0] == key[-1]
            hold = tuple(c[going] for c in left)
            yield from compare(*(c[~going] for c in left))
        if wait:
            left, settled = settle(tuple(np.concatenate(parts) for parts in zip(hold, *wait)))
            yield settled
            hold = left
        yield from compare(*hold)

    return rows.repartition("key").sortWithinPartitions("key", "did", "tie", "pos").mapInArrow(stream, schema)


CONTEXT = "units binary, key long, part int, n_parts int, did long, tie long, lo long, a int, n int"


def fetch_contexts(docs: DataFrame, settled: DataFrame, units, cfg: RepeatConfig) -> DataFrame:
    """The units of the runs to compare, in partitions of whole (key, part), sorted."""
    wanted = settled.where("key IS NOT NULL")
    lists = wanted.groupBy("did", "tie").agg(F.collect_set(F.struct("pos", "key", "part", "n_parts")).alias("runs"))
    joined = _identified(docs).join(lists, ["did", "tie"])

    def cut(batches):
        for batch in byte_chunks(batches, cfg.chunk_bytes):
            cols = {c: [] for c in ("units", "key", "part", "n_parts", "did", "tie", "lo", "a", "n")}
            for text, did, tie, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "did", "tie", "runs"))):
                places = [(r["pos"] >> 16, (r["pos"] >> 8) & 0xFF, r["pos"] & 0xFF) for r in runs]
                cols["units"] += units.cut(text, [(lo, lo + n + cfg.window - 1) for lo, _, n in places])
                for (lo, a, n), r in zip(places, runs):
                    for c, v in (("key", r["key"]), ("part", r["part"]), ("n_parts", r["n_parts"]), ("did", did), ("tie", tie), ("lo", lo), ("a", a), ("n", n)):
                        cols[c].append(v)
            kinds = {"units": pa.binary(), "key": pa.int64(), "did": pa.int64(), "tie": pa.int64(), "lo": pa.int64()}
            yield pa.record_batch([pa.array(v, kinds.get(c, pa.int32())) for c, v in cols.items()], names=list(cols))

    contexts = joined.select("text", "did", "tie", "runs").mapInArrow(cut, CONTEXT)
    return contexts.repartition("key", "part").sortWithinPartitions("key", "part", "did", "tie", "lo")


#: What the comparison of a shard returns: removed windows (window null), and for anchors of
#: several parts the distinct windows that are left, in the order of the shard's array, with the bucket they are merged in.
COMPARED = "did long, tie long, lo long, n int, key long, bucket int, part int, window binary"


@dataclass
class Shard:
    """Contexts of whole anchors, or parts of one."""

    units: list[bytes]
    key: np.ndarray
    part: np.ndarray
    n_parts: np.ndarray
    did: np.ndarray
    tie: np.ndarray
    lo: np.ndarray
    a: np.ndarray
    n: np.ndarray


def compare_shards(contexts: DataFrame, compare: Callable[[Shard], tuple[np.ndarray, np.ndarray]], window_of: Callable[[bytes, int], bytes], cfg: RepeatConfig, shard_bytes: int = 1 << 20) -> DataFrame:
    """Run ``compare`` on shards of about ``shard_bytes``; it returns the (context, offset) of removed windows."""

    def close(rows):
        cols = {c: [r[i] for r in rows] for i, c in enumerate(("units", "key", "part", "n_parts", "did", "tie", "lo", "a", "n"))}
        shard = Shard(cols["units"], *(np.asarray(cols[c], np.int64) for c in ("key", "part", "n_parts", "did", "tie", "lo", "a", "n")))
        context, offset = compare(shard)
        # neighbouring removed windows become one row
        order = np.lexsort((offset, context))
        context, offset = context[order], offset[order]
        if len(context):
            fresh = np.concatenate([[True], (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)])
            first = np.flatnonzero(fresh)
            length = np.diff(np.append(first, len(context)))
            c = context[first]
            yield emit(shard.did[c], shard.tie[c], shard.lo[c] + offset[first], length)
        split = np.flatnonzero(shard.n_parts > 1)
        if len(split):
            c = np.repeat(split, shard.n[split])
            o = np.arange(len(c)) - np.repeat(np.cumsum(shard.n[split]) - shard.n[split], shard.n[split])
            gone = np.isin(c * 256 + o, context * 256 + offset)
            c, o = c[~gone], o[~gone]
            for at in range(0, len(c), 20_000):
                cc, oo = c[at : at + 20_000], o[at : at + 20_000]
                windows = [window_of(shard.units[x], y) for x, y in zip(cc.tolist(), oo.tolist())]
                # as many buckets as parts, so that a bucket is about as large as a part
                bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, windows), np.uint64, len(windows)) % shard.n_parts[cc].astype(np.uint64)
                yield emit(shard.did[cc], shard.tie[cc], shard.lo[cc] + oo, np.ones(len(cc), np.int64), (shard.key[cc], bucket, shard.part[cc], windows))

    def emit(did, tie, lo, n, placed=None):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        more = [pa.nulls(len(did), k) for k in kinds] if placed is None else [pa.array(v, k) if k == pa.binary() else pa.array(v.astype(k.to_pandas_dtype())) for v, k in zip(placed, kinds)]
        return pa.record_batch([pa.array(did), pa.array(tie), pa.array(lo), pa.array(n.astype(np.int32)), *more], names=["did", "tie", "lo", "n", "key", "bucket", "part", "window"])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("units", "key", "part", "n_parts", "did", "tie", "lo", "a", "n")]
            for r in zip(*columns):
                if (r[1], r[2]) != last and size >= shard_bytes:
                    yield from close(rows)
                    rows, size = [], 0
                last = (r[1], r[2])
                rows.append(r)
                size += len(r[0])
        if rows:
            yield from close(rows)

    return contexts.mapInArrow(run, COMPARED)


def merge_sorted(lists: list[np.ndarray]) -> np.ndarray:
    """One sorted array of the distinct elements of sorted arrays: each is merged in where binary search puts its elements."""
    merged = lists[0][:0]
    for own in lists:
        own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        at = np.searchsorted(merged, own)
        known = np.zeros(len(own), bool)
        inside = at < len(merged)
        known[inside] = merged[at[inside]] == own[inside]
        merged = np.insert(merged, at[~known], own[~known])
    return merged


def merge_parts(compared: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """Windows of anchors with several parts that repeat one of another part, as (did, tie, lo, n)."""
    windows = compared.where("window IS NOT NULL")

    def close(rows):
        part, window, did, tie, lo = (np.concatenate(c) if i != 1 else [w for some in c for w in some] for i, c in enumerate(zip(*rows)))
        window = np.asarray(window, dtype=f"S{max(map(len, window))}")  # all are of one length, so padding makes no two equal
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        merged = merge_sorted([window[a:b] for a, b in zip(edges[:-1], edges[1:])])
        gone = np.flatnonzero(repeats_earlier(np.searchsorted(merged, window), document_ranks(did, tie), did, lo, cfg.across_only))
        return pa.record_batch([pa.array(did[gone]), pa.array(tie[gone]), pa.array(lo[gone]), pa.array(np.ones(len(gone), np.int32))], names=["did", "tie", "lo", "n"])

    def stream(batches):
        rows, now = [], None
        for batch in batches:
            key, bucket = batch.column("key").to_numpy(), batch.column("bucket").to_numpy()
            cuts = (np.flatnonzero((key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if a == b:
                    continue
                if now != (key[a], bucket[a]) and rows:
                    yield close(rows)
                    rows = []
                now = (key[a], bucket[a])
                some = batch.slice(a, b - a)
                rows.append([some.column("part").to_numpy(), some.column("window").to_pylist(), *(some.column(c).to_numpy() for c in ("did", "tie", "lo"))])
        if rows:
            yield close(rows)

    names = ["key", "bucket", "part", "window"]
    dealt = windows.select(*names, "did", "tie", "lo").repartition("key", "bucket").sortWithinPartitions(*names)
    return dealt.mapInArrow(stream, "did long, tie long, lo long, n int")


def find_repeats(docs: DataFrame, units, cfg: RepeatConfig, compare, window_of) -> DataFrame:
    """(did, tie, runs array<struct<lo, n>>): for each document with any, its runs of repeated windows."""
    spark = docs.sparkSession
    settled, p1 = stage(settle_by_anchor(anchor_rows(docs, units, cfg), cfg), "settled")
    release(spark)
    compared, p2 = stage(compare_shards(fetch_contexts(docs, settled, units, cfg), compare, window_of, cfg), "compared")
    release(spark)
    whole = settled.where("key IS NULL").select("did", "tie", F.shiftright("pos", 16).alias("lo"), F.col("pos").bitwiseAND(F.lit(0xFF)).cast("int").alias("n"))
    parts = compared.where("window IS NULL").select("did", "tie", "lo", "n")
    every = whole.unionByName(parts).unionByName(merge_parts(compared, cfg))
    found, _ = stage(every.groupBy("did", "tie").agg(F.collect_list(F.struct("lo", "n")).alias("runs")), "repeats")
    release(spark, p1, p2)
    return found


def with_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(text, doc_id, runs) for every row of ``docs``; runs is null where nothing repeats."""
    keyed = _identified(docs.select("text", "doc_id")).join(found, ["did", "tie"], "left")
    return keyed.select("text", F.when(F.col("did") != NULL_ID, F.col("did")).alias("doc_id"), "runs")


def covered(runs: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Maximal covered stretches (start, end) of runs of windows."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["lo"] + r["n"] - 1 + window) for r in runs or ()):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out
