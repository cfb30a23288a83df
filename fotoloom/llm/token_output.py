"""Token-ID / binary output: training-order materialisation.

Every document is tokenized (byte-level BPE), ended by an end-of-text id and cut into
sequences of ``seq_len`` ids, the last one padded with that id. Sequences are numbered
0..N-1 in the order of (doc_id, hash of the text), an order that depends on the data
alone. A keyed Feistel permutation of the smallest even number of bits that holds N,
with cycle-walking, gives each sequence its global slot in 0..N-1: training order
without a global sort by a random key. Slot ``s`` belongs to shard ``s // per_shard``
at byte ``(s % per_shard) * stride``; shards are range partitions of the slots, each
written as one file of fixed-stride records, so that a reader finds any slot by
arithmetic and resumes where it stopped (``read_shards(..., first_slot)`` opens no file before that slot's).

Shard files are written by Spark's own text writer with the record's bytes as the line
(Spark doesn't re-encode them) and a one-byte line end, hence atomically, to any store
Spark can write: ``stride = 2 * seq_len + 1``. An index beside them says which document's which sequence each slot holds.

Defined results: null and empty texts give one sequence that holds only the end-of-text
id and padding; rows that repeat a doc_id and text give equal sequences with slots of
their own; a null doc_id sorts first; an empty table gives no sequence and no shard. Only doc_id and
text are read.

Scale: texts are shuffled once (range partitions by doc_id), tokens once (to their
shard), in ``rounds`` of as many shards each, so that only a part of the corpus lies in shuffle files at any time.
Per-partition totals, one row for each partition, are the only thing the driver
reads. The sorted token table is staged, so that numbers stay fixed if executors are lost.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_chunks, new_path, release, setting, stage

RANKS_SETTING, DEFAULT_RANKS = "spark.fotoloom.tokenizer.ranks", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenization pattern published with this vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
@dataclass(frozen=True)
class OutputConfig:
    seq_len: int = 512
    per_shard: int = 8192
    key: int = 20240229
    end_of_text: int = 50256
    rounds: int = 8

    @property
    def stride(self) -> int:
        return 2 * self.seq_len + 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Texts to ids as little-endian 16-bit numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("fotoloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), dtype="<u2").tobytes()


#: The encoder of this worker, by the path its ranks were read from. It keeps nothing of the texts.
_encoders: dict[str, Encoder] = {}


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1, applied to ``index``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF) for r in range(rounds)]

    def scramble(x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & mask

    out = np.asarray(index, dtype=np.uint64).copy()
    walking = np.ones(len(out), dtype=bool)
    while walking.any():  # cycle-walking: values outside 0..n-1 are permuted again
        left, right = out[walking] >> shift, out[walking] & mask
        for k in keys:
            left, right = right, left ^ scramble(right, k)
        out[walking] = (left << shift) | right
        walking = out >= np.uint64(n)
    return out.astype(np.int64)


@dataclass(frozen=True)
class Numbered:
    """Staged tokens (part, first, n_seq, n_ids, doc_id, ids) of whole documents in order, and where each part's numbers start."""

    table: DataFrame
    path: str
    parts: np.ndarray
    starts: np.ndarray
    cfg: OutputConfig

    @property
    def n_all(self) -> int:
        return int(self.starts[-1])

    @property
    def n_shards(self) -> int:
        return -(-self.n_all // self.cfg.per_shard)

    def place(self, first_slot: int, end_slot: int, with_tokens: bool) -> DataFrame:
        """(slot, doc_id, seq_no, n_tokens[, tokens]) of the sequences whose slot lies in the given range."""
        cfg, parts, starts, n_all = self.cfg, self.parts, self.starts, self.n_all
        width = 2 * cfg.seq_len
        pad = np.asarray([cfg.end_of_text] * cfg.seq_len, dtype="<u2").tobytes()

        def run(batches):
            for batch in byte_chunks(batches, 4 << 20):
                base = starts[np.searchsorted(parts, batch.column("part").to_numpy(zero_copy_only=False))] + batch.column("first").to_numpy()
                n_seq = batch.column("n_seq").to_numpy()
                row = np.repeat(np.arange(batch.num_rows), n_seq)
                seq_no = np.arange(len(row)) - np.repeat(np.cumsum(n_seq) - n_seq, n_seq)
                slot = feistel(base[row] + seq_no, n_all, cfg.key)
                here = (slot >= first_slot) & (slot < end_slot)
                row, seq_no, slot = row[here], seq_no[here], slot[here]
                n_tokens = np.minimum(batch.column("n_ids").to_numpy()[row] - seq_no * cfg.seq_len, cfg.seq_len)
                columns = [pa.array(slot), batch.column("doc_id").take(pa.array(row)), pa.array(seq_no.astype(np.int32)), pa.array(n_tokens.astype(np.int32))]
                names = ["slot", "doc_id", "seq_no", "n_tokens"]
                if with_tokens:
                    ids = batch.column("ids")
                    cut = [ids[r].as_buffer()[s * width : (s + 1) * width].to_pybytes() for r, s in zip(row.tolist(), seq_no.tolist())]
                    columns.append(pa.array([x + pad[len(x) :] for x in cut], pa.binary()))
                    names.append("tokens")
                yield pa.record_batch(columns, names=names)

        read = [*(["ids"] if with_tokens else []), "part", "first", "n_seq", "n_ids", "doc_id"]
        return self.table.select(*read).mapInArrow(run, "slot long, doc_id long, seq_no int, n_tokens int" + ", tokens binary" * with_tokens)


def number_sequences(docs: DataFrame, cfg: OutputConfig, ranks_path: str) -> Numbered:
    """Tokenize all documents and count their sequences, in an order that depends on the data alone."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def tokenize(batches):
        if ranks_path not in _encoders:
            _encoders.clear()
            _encoders[ranks_path] = Encoder(ranks.value)
        encoder = _encoders[ranks_path]
        end, done = np.asarray([cfg.end_of_text], dtype="<u2").tobytes(), 0
        for batch in byte_chunks(batches, 4 << 20):
            ids = [encoder.encode((t or b"").decode("utf-8", "replace")) + end for t in batch.column("text").to_pylist()]
            n_ids = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            n_seq = -(-n_ids // cfg.seq_len)
            first = done + np.cumsum(n_seq) - n_seq
            done += int(n_seq.sum())
            yield pa.record_batch([batch.column("part"), pa.array(first), pa.array(n_seq), pa.array(n_ids), batch.column("doc_id"), pa.array(ids, pa.binary())], names=["part", "first", "n_seq", "n_ids", "doc_id", "ids"])

    texts = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    texts = texts.withColumn("tie", F.xxhash64("text"))
    texts = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("part", F.spark_partition_id())
    table, path = stage(texts.mapInArrow(tokenize, "part int, first long, n_seq long, n_ids long, doc_id long, ids binary"), "tokens", "zstd")
    release(spark)
    totals = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.sum("n_seq").alias("n")).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in totals])]).astype(np.int64)
    return Numbered(table, path, np.asarray([p for p, _ in totals], dtype=np.int64), starts, cfg)


def write_shards(docs: DataFrame, path: str, cfg: OutputConfig = OutputConfig(), ranks_path: str | None = None) -> None:
    """Write ``path/shards/shard=<k>/part-*``, one file of fixed-stride records to a shard, and ``path/index``."""
    spark = docs.sparkSession
    numbered = number_sequences(docs, cfg, ranks_path or setting(RANKS_SETTING, DEFAULT_RANKS))
    numbered.place(0, numbered.n_all, False).write.mode("overwrite").parquet(f"{path}/index")
    rounds = max(1, min(cfg.rounds, numbered.n_shards))
    edges = [numbered.n_shards * r // rounds for r in range(rounds + 1)]
    for r in range(rounds):
        lo, hi = edges[r], edges[r + 1]
        placed = numbered.place(lo * cfg.per_shard, hi * cfg.per_shard, True).withColumn("shard", F.floor(F.col("slot") / cfg.per_shard))
        # contiguous shards go to one partition: slots are a permutation, so all are of one size
        n_parts = min(max(hi - lo, 1), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
        target = F.floor((F.col("shard") - lo) * n_parts / max(hi - lo, 1)).cast("int")
        lines = placed.repartitionById(n_parts, target).sortWithinPartitions("shard", "slot").select("shard", F.col("tokens").cast("string").alias("value"))
        lines.write.mode("overwrite" if r == 0 else "append").partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(f"{path}/shards")
        release(spark)
    release(spark, numbered.path)


def read_shards(spark: SparkSession, path: str, cfg: OutputConfig = OutputConfig(), first_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, tokens) of all slots from ``first_slot`` on, each shard's in order. Shards before it are not opened."""

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                records = np.frombuffer(content.as_buffer(), record_dtype(cfg))
                skip = max(0, first_slot - shard * cfg.per_shard)
                for at in range(skip, len(records), 4096):
                    some = records[at : at + 4096]
                    i = np.arange(at, at + len(some))
                    yield pa.record_batch(
                        [pa.array(shard * cfg.per_shard + i), pa.array(np.full(len(i), shard)), pa.array(i * cfg.stride), pa.array([x.tobytes() for x in some["ids"]], pa.binary())],
                        names=["slot", "shard", "byte_offset", "tokens"],
                    )

    kind = "slot long, shard long, byte_offset long, tokens binary"
    files = spark.read.format("binaryFile").load(f"{path}/shards")
    if "shard" not in files.columns:  # no shard was written
        return spark.createDataFrame([], kind)
    files = files.where(F.col("shard") >= first_slot // cfg.per_shard)
    return files.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(run, kind)


def materialise(docs: DataFrame, cfg: OutputConfig = OutputConfig(), ranks_path: str | None = None, path: str | None = None) -> DataFrame:
    """Write the shards (below the shared folder if no path is given) and return what they hold, read back from the files:
    (slot, shard, byte_offset, doc_id, seq_no, n_tokens, digest), where the digest is that of the record's ids."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-shards")
    write_shards(docs, path, cfg, ranks_path)
    index = spark.read.schema("slot long, doc_id long, seq_no int, n_tokens int").parquet(f"{path}/index")
    records = read_shards(spark, path, cfg).select("slot", "shard", "byte_offset", F.md5("tokens").alias("digest"))
    return records.join(index, "slot").select("slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "digest")


def record_dtype(cfg: OutputConfig) -> np.dtype:
    """The layout of a record, for ``numpy.memmap``."""
    return np.dtype([("ids", "<u2", (cfg.seq_len,)), ("end", "u1")])


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
