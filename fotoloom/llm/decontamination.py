"""Benchmark decontamination (native).

Containment search by size-partitioned MinHash signatures. A benchmark item is its
set of distinct five-word shingles (A-Z lower-cased; an item of fewer words is one
shingle, as is a document of fewer words). Items are partitioned by size, a power of
two to a partition. An item's signature holds its shingles of smallest hash; the
partition fixes how many: ``floor((1 - t) * largest size) + 1``. If an item's
containment in a document is at least ``t``, then at most ``(1 - t) * size`` of its
shingles are missing there, so at least one signature shingle is present: the search
misses nothing, however long the document is. (Plain MinHash bands against a whole
long document see a Jaccard similarity near 0 and would miss most short items; that is
why the signature side is asymmetric.)

1. Candidates: the 64-bit hashes of all documents' shingles meet the signatures, a quarter of the items'
   shingles, and nothing else. What meets none is done.
2. Verification: of the documents that met one, the shingles are written out and compared as text with all shingles of just the
   items they met; the exact count decides.

The exception is an item of under five words: a longer document has no shingle of fewer words, so such an item is found only in
documents of exactly its words (this is what the SQL defines).

Defined results: null or empty texts have no shingle and are never matched; repeated
rows of one doc_id (or item_id) count as one document (item) with the union of their
shingles; rows of a null doc_id are told apart by their text; ties cannot arise; an empty table on either side
gives an empty result. ``decontaminate`` keeps all columns, whatever their names.

Scale: documents are read twice and never shuffled, unless over a million meet a signature; the signatures and the
benchmark's shingles are broadcast only if they were counted and are within ``MAX_BROADCAST_SHINGLES``
rows, else joined by shuffle. Only (document, item) pairs and the shingles of documents that met a signature are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, ascii_lower, bounded_broadcast, free_name, stage

SHINGLE = 5
THRESHOLD_PERCENT = 75
MAX_BROADCAST_SHINGLES = 500_000


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """The distinct ``n``-word shingles of ``text`` as strings; empty for no words."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def cut(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, F.array_distinct(many)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    # transform over a one-element array names the words once instead of recomputing them
    return F.element_at(F.transform(F.array(words), cut), 1)


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of the shingles of ``text``, repeats and all: equal shingles have equal hashes."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def cut(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(words), cut), 1)


def item_index(benchmark: DataFrame, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(shingle, hash, item_id, n_item_shingles, in_signature), staged."""
    rows = benchmark.select("item_id", F.explode(shingles(F.col("text"))).alias("shingle")).distinct()
    by_item = Window.partitionBy("item_id")
    sized = rows.withColumn("n_item_shingles", F.count("*").over(by_item)).withColumn("hash", F.xxhash64(F.split("shingle", " ")))
    partition = F.floor(F.log2("n_item_shingles"))
    largest = F.pow(F.lit(2.0), partition + 1) - 1
    quota = F.floor(largest * (100 - threshold_percent) / 100) + 1
    rank = F.row_number().over(by_item.orderBy("hash", "shingle"))
    index = sized.withColumn("in_signature", rank <= quota)
    return stage(index.select("shingle", "hash", "item_id", "n_item_shingles", "in_signature"), "benchmark-index")[0]


def candidate_pairs(keyed: DataFrame, index: DataFrame) -> DataFrame:
    """The (key, item_id) of documents that hold at least one shingle of an item's signature."""
    signatures = index.where("in_signature").select(F.col("hash").alias("sig"), "item_id")
    probe = keyed.select("key", F.explode(shingle_hashes(F.col("text"))).alias("hash"))
    return probe.join(bounded_broadcast(signatures, MAX_BROADCAST_SHINGLES), F.col("hash") == F.col("sig")).select("key", "item_id").distinct()


def _contained(keyed: DataFrame, benchmark: DataFrame, threshold_percent: int) -> DataFrame:
    """(key, item_id, n_item_shingles, n_shared) for (key, text): pairs with containment at or over the threshold."""
    index = item_index(benchmark, threshold_percent)
    pairs = stage(candidate_pairs(keyed, index), "decontamination-candidates")[0]
    some = bounded_broadcast(pairs.select(F.col("key").alias("some")).distinct(), 1_000_000)
    held = keyed.join(some, F.col("key") == F.col("some"), "left_semi").select("key", F.explode(shingles(F.col("text"))).alias("shingle"))
    wanted = bounded_broadcast(index.select("shingle", "item_id", "n_item_shingles"), MAX_BROADCAST_SHINGLES)
    shared = held.join(wanted, "shingle").groupBy("key", "item_id").agg(F.max("n_item_shingles").alias("n_item_shingles"), F.count_distinct("shingle").alias("n_shared"))
    found = shared.join(pairs, ["key", "item_id"], "left_semi")
    return found.where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * threshold_percent)


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row for each (document, item) with containment at or over the threshold."""
    nameless = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    found = _contained(docs.select(F.struct("doc_id", nameless.alias("tie")).alias("key"), "text"), benchmark, threshold_percent)
    return found.select("key.doc_id", "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item."""
    # rows are told apart by id and text, so that a null or repeated id takes no clean row with it
    key = F.struct(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("tie"))
    leaked = _contained(docs.select(key.alias("key"), "text"), benchmark, threshold_percent).select("key").distinct()
    name = free_name(docs.columns, "leaked")
    leaked = stage(leaked.select(F.struct(F.coalesce("key.id", F.lit("-")).alias("id"), "key.tie").alias(name)), "leaked")[0]
    own = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("id"), F.xxhash64("text").alias("tie"))
    return docs.join(bounded_broadcast(leaked, 1_000_000), own == F.col(name), "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM texts
), shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM words
), items AS (
  SELECT id AS item_id, shingle, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'i'
)
SELECT d.id AS doc_id, i.item_id, i.n AS n_item_shingles, count(*) AS n_shared, count(*) / i.n AS containment
FROM shingles d JOIN items i USING (shingle)
WHERE d.kind = 'd'
GROUP BY d.id, i.item_id, i.n
HAVING count(*) * 100 >= i.n * 75
"""
