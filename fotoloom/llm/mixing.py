"""Mixing sources to target weights (native).

Tokens are summed per source, each source gets a repetition rate (its target over
its size), and every document is emitted ``floor(rate)`` times plus one more time
with probability ``rate - floor(rate)``, decided by a seeded hash of its id.

Targets. ``budget`` times all words are shared by weight. A source that would get
more than ``cap`` times its size stops there and the excess goes to the others by
weight, until none is above. The fixed point is ``min(cap_i, w_i * lam)``: with the
sources in order of ``cap_i / w_i`` and all before ``i`` stopped, ``lam_i`` is what
is left over the weights that are left; ``lam_i`` rises while sources still stop and
falls afterwards, so ``lam`` is its maximum. That needs no iteration.

The draw. A Bernoulli draw over few or very uneven documents can miss its target by
far. ``trials`` seeds are tried for each source in one aggregation, and the seed
whose total is nearest to the target is used; each draw is still a hash compared
with the fraction, and reruns agree.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; a document of null doc_id is drawn by its text; rows that repeat a doc_id
(or a text under null) share its decision; a source of size 0 has target 0 and is not taken; an empty table
gives an empty result. All columns are carried through ``mix``, whatever their names: what the plan adds is one
struct, under a name that no column has.

Scale: documents are never shuffled. The only shuffles carry one row per source (and
trial) per task. The plan has one row per source; it is broadcast after its row count
is checked, else joined by shuffle. Sources are ranked by windows in one task: rows there are sources, never documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, bounded_broadcast, free_name, stage

#: Beyond this many sources the plan is joined by shuffle.
MAX_BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class MixConfig:
    budget: float = 1.5
    cap: float = 2.0
    weights: tuple[int, ...] = (5, 2, 1)
    seed: str = "mix"
    trials: int = 32


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw_name(doc_id: Column, text: Column) -> Column:
    """What a document is drawn by: its id, or a digest of its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _uniform(name: Column, trial: Column, seed: str) -> Column:
    """52 hash bits as a double in [0, 1)."""
    drawn = F.concat(F.lit(f"{seed}:"), trial.cast("string"), F.lit(":"), name)
    return F.conv(F.substring(F.md5(drawn), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _copies(name: Column, rate: Column, trial: Column, cfg: MixConfig) -> Column:
    """``floor(rate)`` copies, and one more with the fraction as its probability."""
    extra = F.when(_uniform(name, trial, cfg.seed) < rate - F.floor(rate), 1).otherwise(0)
    return (F.floor(rate) + extra).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, name, source, size) for every row of ``docs``, staged: texts are read once."""
    text = F.col("text")
    return stage(docs.select("doc_id", draw_name(F.col("doc_id"), text).alias("name"), "source", words_in(text).alias("size")), "mix-sizes")[0]


def source_targets(sized: DataFrame, cfg: MixConfig) -> DataFrame:
    """(source, source_size, target, rate), one row per source of (source, size)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on: these windows run over sources, never documents.
    ranked = per.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weights = F.array(*[F.lit(int(w)) for w in cfg.weights])
    ranked = ranked.withColumn("_w", F.get(weights, F.col("_rank") % len(cfg.weights)).cast("double")).withColumn("_cap", F.lit(float(cfg.cap)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(cfg.budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    lam = left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    out = ranked.withColumn("_lam_i", lam).withColumn("_lam", F.max("_lam_i").over(everything))
    target = F.least("_cap", F.col("_w") * F.col("_lam"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return out.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def mix_plan(sized: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(source, source_size, target, rate, trial) from ``sizes()``: what ``mix`` does with each source."""
    targets, _ = stage(source_targets(sized, cfg), "mix-targets")
    small = bounded_broadcast(targets.withColumnRenamed("source", "_source"), MAX_BROADCAST_SOURCES)
    drawn = sized.join(small, F.col("source").eqNullSafe(F.col("_source")))
    drawn = drawn.select("source", "size", "name", "target", "rate", F.explode(F.sequence(F.lit(0), F.lit(cfg.trials - 1))).alias("trial"))
    taken = F.col("size") * _copies(F.col("name"), F.col("rate"), F.col("trial"), cfg)
    totals = drawn.groupBy("source", "trial").agg(F.sum(taken).alias("_taken"), F.first("target").alias("_target"))
    best = totals.groupBy("source").agg(F.min_by("trial", F.struct(F.abs(F.col("_taken") - F.col("_target")), F.col("trial"))).alias("trial"))
    best = best.withColumnRenamed("source", "_source")
    return stage(targets.join(best, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "mix-plan")[0]


def with_plan(docs: DataFrame, plan: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the plan of its source as a struct, and that column's name."""
    name = free_name(docs.columns, "plan")
    small = bounded_broadcast(plan.select(F.struct(*plan.columns).alias(name)), MAX_BROADCAST_SOURCES)
    return docs.join(small, F.col("source").eqNullSafe(F.col(f"{name}.source"))), name


def mix(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as its source's rate says."""
    out, plan = with_plan(docs, mix_plan(sizes(docs), cfg))
    copies = _copies(draw_name(F.col("doc_id"), F.col("text")), F.col(f"{plan}.rate"), F.col(f"{plan}.trial"), cfg)
    nth = free_name(out.columns, "copy")
    # an empty sequence gives no row
    return out.withColumn(nth, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).drop(plan, nth)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    cfg = MixConfig()
    sized = sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out, plan = with_plan(sized, mix_plan(sized, cfg))
    taken = F.col("size") * _copies(F.col("name"), F.col(f"{plan}.rate"), F.col(f"{plan}.trial"), cfg)
    return out.select("doc_id", "size", f"{plan}.source_size", f"{plan}.target", taken.alias("taken"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM per
), weighed AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS cap FROM ranked
), lams AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lam_i
  FROM weighed WINDOW b AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap, w * max(lam_i) OVER ()) AS target FROM lams
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets
), draws AS (
  SELECT s.doc_id, s.size, r.source, r.source_size, r.target, k.trial,
         CAST(floor(r.rate) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5('mix:' || k.trial || ':' || s.name), 1, 13)) AS UBIGINT)::DOUBLE
              / 4503599627370496.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range(32)) AS trial) k
), totals AS (
  SELECT source, trial, abs(sum(size * copies) - any_value(target)) AS miss FROM draws GROUP BY source, trial
), best AS (
  SELECT source, trial FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss, trial) AS i FROM totals) WHERE i = 1
)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST(d.size * d.copies AS BIGINT) AS taken
FROM draws d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.trial = b.trial
"""
