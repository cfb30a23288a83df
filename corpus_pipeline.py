"""The corpus pipeline: five stages over ``documents``, each written and read again.

1. language: documents go that the trained network gives no language with a score of half or more.
2. near_duplicates: one document of each group of near copies stays.
3. decontaminate: documents that contain a benchmark item go.
4. mix: documents are repeated to their source's target.
5. tokens: the mixed corpus as fixed-stride token sequences in training order, written to shard files; the rows say where.

Defined results, besides those of the operators: the first four stages return the columns they got, extra ones and
clashing names included, and drop or repeat whole rows. Null, empty and letterless texts end at the first stage, so
the later ones meet none; of rows repeated whole, one stays at the second; a null doc_id is kept like any other,
and documents without an id are told apart by their text; a null source is mixed as a source of its own; an empty table stays empty
and gives no shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fotoloom.llm.decontamination import decontaminate
from fotoloom.llm.jaccard_join import drop_near_duplicates
from fotoloom.llm.language_id import keep_identified
from fotoloom.llm.mixing import mix
from fotoloom.llm.shared import stage
from fotoloom.llm.token_output import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return materialise(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
    ("tokens", tokens),
]

#: A trained network and a tokenizer have no SQL; tests/llm/test_pipeline.py holds the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")[0]
    return STAGES[-1][1](spark, docs, sf_dir)
