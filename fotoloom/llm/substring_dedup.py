"""Substring dedup: seed and extend.

Documents are joined on winnowed anchors (grams of 16 words, see ``repeats``). Runs of windows that
share an anchor are extended from it both ways, word by word, against the runs of smaller
documents; a maximal repeat of at least 50 words covers the windows inside it, and every
word of such a window is removed. An anchor with more runs than a shard holds is spread
over several, whose windows are then merged by digest.

Defined results: a null text has no word; texts of fewer than 50 words are kept whole; the
kept words are joined by one space; a null doc_id is smaller than all others; rows that
share a doc_id never remove each other's words. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .repeats import RepeatConfig, Shard, WordUnits, covered, find_repeats, with_repeats
from .shared import byte_chunks

WINDOW = 50
CONFIG = RepeatConfig(window=WINDOW, gram=16, across_only=True, shard_runs=512)


def _extend(words: list[np.ndarray], anchor: np.ndarray, did: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of windows of rows of one anchor that lie in a repeat of a smaller document's row."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    left, right = int(anchor.max()), int((size - anchor).max())
    # rows aligned at the anchor; cells outside a row differ from everything
    grid = np.zeros((len(words), left + right), np.uint64)
    inside = np.zeros(grid.shape, bool)
    for i, w in enumerate(words):
        at = left - anchor[i]
        grid[i, at : at + size[i]] = w
        inside[i, at : at + size[i]] = True
    repeated = np.zeros((len(words), int(n.max())), bool)
    order = np.argsort(did, kind="stable")
    begin = np.searchsorted(did[order], did[order], side="right")
    for k, x in enumerate(order):
        later = order[begin[k] :]
        if not len(later):
            break
        same = (grid[later] == grid[x]) & inside[later] & inside[x]
        to_left = np.where(same[:, :left][:, ::-1].all(axis=1), left, np.argmin(same[:, :left][:, ::-1], axis=1)) if left else np.zeros(len(later), np.int64)
        to_right = np.where(same[:, left:].all(axis=1), right, np.argmin(same[:, left:], axis=1))
        long = np.flatnonzero(to_left + to_right >= window)
        for y, a, b in zip(later[long], to_left[long], to_right[long]):
            first, last = anchor[y] - a, anchor[y] + b - window
            repeated[y, max(first, 0) : last + 1] = True
    repeated &= np.arange(repeated.shape[1])[None, :] < n[:, None]
    return np.nonzero(repeated)


def repeated_windows(shard: Shard, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    units = WordUnits()
    words = [units.of(u) for u in shard.units]
    context, offset = [], []
    begins = np.flatnonzero(np.concatenate([[True], (shard.key[1:] != shard.key[:-1]) | (shard.part[1:] != shard.part[:-1])]))
    for lo, hi in zip(begins, np.append(begins[1:], len(words))):
        if hi - lo > 1:
            row, off = _extend(words[lo:hi], shard.a[lo:hi], shard.did[lo:hi], shard.n[lo:hi], window)
            context.append(row + lo)
            offset.append(off)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *context]), np.concatenate([none, *offset])


def _digest(units: bytes, offset: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(units.split()[offset : offset + WINDOW]))


def dedup(docs: DataFrame, cfg: RepeatConfig = CONFIG) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row of ``docs``."""
    found = find_repeats(docs, WordUnits(), cfg, repeated_windows, _digest)

    def cut(batches):
        for batch in byte_chunks(batches, 8 << 20):
            rows = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words, at, kept = text.split(), 0, []
                for a, b in covered(runs, cfg.window):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                left = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return with_repeats(docs, found).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)
), gone AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM windows) WHERE first_doc < doc_id
), marks AS (
  SELECT doc_id, i, max(g) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_start
  FROM (SELECT w.doc_id, w.i, CASE WHEN g.i IS NOT NULL THEN g.i END AS g
        FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i FROM words) w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i)
), kept AS (
  SELECT m.doc_id, count(*) AS n, string_agg(words.w[m.i], ' ' ORDER BY m.i) AS t
  FROM marks m JOIN words ON m.doc_id = words.doc_id WHERE m.last_start IS NULL OR m.i - m.last_start >= 50 GROUP BY m.doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""
