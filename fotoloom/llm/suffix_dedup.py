"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

The corpus is cut into shards by content: the stretches of text whose windows share an
anchor (see ``repeats``) lie in one shard, so that equal windows meet without comparing all
shards with all. Each shard gets a suffix array by Larsson-Sadakane refinement in numpy
(sort by the first 8 bytes, then double the sorted depth, touching unsorted groups only)
and longest common prefixes by Kasai's algorithm. Neighbours in the array that share 100
bytes or more are copies of one window; all but the earliest are removed. An anchor too
frequent for one shard is spread over several, whose sorted distinct windows (the windows themselves, in the
order of the suffix arrays) are merged by binary search.

What is not as plain suffix arrays would have it: of runs of windows that are equal as a whole only the earliest enters a shard; the
others are settled by a 128-bit digest of their bytes before text is sent around (see ``repeats`` for its error). README gives the figures.

Defined results: a null text counts as empty; texts shorter than the window are kept whole;
matches never cross documents; a null doc_id comes first in the order; rows that repeat a
doc_id and text are one document with one result for each row; rows that share a doc_id but
not the text precede neither each other. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import ByteUnits, RepeatConfig, Shard, covered, document_ranks, find_repeats, load8, repeats_earlier, with_repeats
from .shared import byte_chunks

WINDOW = 100


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes' first ``depth`` bytes at least."""
    n = len(text)
    first8 = load8(text).byteswap()
    order = np.argsort(first8)
    s = first8[order]
    index = np.arange(n, dtype=np.int64)
    head = np.ones(n, bool)
    head[1:] = s[1:] != s[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.maximum.accumulate(np.where(head, index, 0))
    rank[order] = start
    h = 8
    while h < depth:
        # slots of groups that are not single
        single = head & np.append(head[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        at = order[slots]
        following = rank[np.minimum(at + h, n)]
        group = start[slots]
        by = np.argsort(group * (n + 1) + following + 1)
        order[slots] = at[by]
        g, f = group[by], following[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (f[1:] != f[:-1])
        head[slots] = fresh
        start = np.maximum.accumulate(np.where(head, index, 0))
        rank[order[slots]] = start[slots]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int, lanes_of: int = 256) -> np.ndarray:
    """Kasai: the common prefix of each suffix with the one before it in ``order``, at most ``cap``.

    Stretches of ``lanes_of`` positions advance in step, each by Kasai's rule: what position i
    shares with its predecessor, less one, position i + 1 shares too. The rule holds only below
    the cap, since the array's order is not settled beyond it.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = np.concatenate([load8(text), np.zeros(cap + 8, np.uint64)])
    shared = np.zeros(n, np.int64)
    lane = np.arange(0, n, lanes_of)
    known = np.zeros(len(lane), np.int64)
    one, three = np.uint64(1), np.uint64(3)
    for step in range(min(lanes_of, n)):
        i = lane + step
        if i[-1] >= n:
            lane, known = lane[:-1], known[:-1]
            i = lane + step
        j = before[i]
        length = np.where(known >= cap, 0, np.maximum(known - 1, 0))
        length[j < 0] = 0
        going = np.flatnonzero(j >= 0)
        while len(going):
            x = words[i[going] + length[going]] ^ words[j[going] + length[going]]
            same = x == 0
            some = (np.bitwise_count((x & (~x + one)) - one).astype(np.uint64) >> three).astype(np.int64)
            length[going] += np.where(same, 8, some)
            going = going[same & (length[going] < cap)]
        # zeros stand beyond the end of the text: nothing is shared there
        length = np.minimum(np.minimum(length, cap), np.where(j >= 0, n - np.maximum(i, j), 0))
        shared[i] = known = length
    return shared


def repeated_windows(shard: Shard, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the windows that repeat an earlier one of the shard."""
    text = np.frombuffer(b"".join(shard.units), np.uint8)
    sizes = np.fromiter(map(len, shard.units), np.int64, len(shard.units))
    begins = np.cumsum(sizes) - sizes
    order = suffix_array(text, window)
    shared = common_prefixes(text, order, window)[order]
    context = np.repeat(np.arange(len(sizes)), sizes)[order]
    offset = order - begins[context]
    own = offset < shard.n[context]  # windows that end inside their context
    kind = np.cumsum(shared < window)
    context, offset, kind = context[own], offset[own], kind[own]
    ranks = document_ranks(shard.did, shard.tie)
    gone = repeats_earlier(kind, ranks[context], shard.did[context], shard.lo[context] + offset, False)
    return context[gone], offset[gone]


def _window(units: bytes, offset: int) -> bytes:
    return units[offset : offset + WINDOW]


CONFIG = RepeatConfig(window=WINDOW, gram=24, across_only=False)


def dedup(docs: DataFrame, cfg: RepeatConfig = CONFIG) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``."""
    found = find_repeats(docs, ByteUnits(), cfg, repeated_windows, _window)

    def cut(batches):
        for batch in byte_chunks(batches, 8 << 20):
            rows = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                spans, at, kept = covered(runs, cfg.window), 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    return with_repeats(docs, found).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


OP1_SQL = r"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT doc_id, i, md5_number(x[2 * i - 1:2 * i + 198]) AS h
  FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 - 98)) AS i FROM texts)
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 99 AS b
  FROM (SELECT doc_id, i, sum(CASE WHEN i - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone))
  GROUP BY doc_id, g
), cuts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM spans
), sums AS (
  SELECT c.doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans,
         string_agg(t.x[2 * kept_from + 1:2 * (a - 1)], '' ORDER BY a) || any_value(t.x)[2 * max(b) + 1:] AS kept
  FROM cuts c JOIN texts t ON c.doc_id = t.doc_id GROUP BY c.doc_id
)
SELECT t.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM texts t LEFT JOIN sums s ON t.doc_id = s.doc_id
"""
