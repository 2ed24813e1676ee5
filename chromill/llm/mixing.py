"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, cut, lookup, replacing, size_words, unit_hash, unused

#: Weights are dealt to the sources in order and repeat.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
CAP = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, shares: float = 1.0) -> DataFrame:
    """From (source, size): one row per source with source_size, target and rate.

    Sources are ordered by code point, null last, and take the weights in turn. All sizes times shares
    are dealt out by weight; a target stops at cap times its source's size and the excess is dealt again
    among the others until none is above. Each such round is one aggregate over the sources, of which
    only the two sums reach the driver. An empty table has no sources; a source of size 0 has target and
    rate 0.

    The order's ranks come from a range partition and its counts, so no task holds all sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(per.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").count()
    before = before.withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranged.join(F.broadcast(before), "part").withColumn("weight", F.get(dealt, (rank % len(weights)).cast("int")))
    ranked = cut(ranked.select("source", "source_size", "weight"))

    limit = F.col("source_size") * cap
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total = (total or 0) * shares
    level = total / weight if weight else 0.0
    while True:
        above = F.col("weight") * level > limit
        held, rest = ranked.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if not rest or (raised := (total - (held or 0)) / rest) <= level:
            break
        level = raised
    share = F.col("weight") * level
    target = F.when(share > limit, limit.cast("double")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return ranked.withColumn("target", target).withColumn("rate", rate)


def _planned(docs: DataFrame, size: Column | None, weights: Sequence[int], cap: int, seed: str, plan: str) -> DataFrame:
    """docs and a struct named plan of size, source_size, target, rate and copies; all names of docs stay."""
    key = unused("mix_source_key", docs)
    held = unused("mix_size", docs)
    sized = docs.withColumn(held, size_words(F.col("text")) if size is None else size)
    targets = cut(source_targets(sized.select("source", F.col(held).alias("size")), weights, cap).select(F.col("source").alias(key), F.struct("source_size", "target", "rate").alias(plan)))
    joined = lookup(sized, targets, F.col("source").eqNullSafe(F.col(key)), "inner")
    draw = unit_hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rate = F.col(f"{plan}.rate")
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")
    return joined.select(*columns(docs), F.struct(F.col(held).alias("size"), f"{plan}.source_size", f"{plan}.target", f"{plan}.rate", copies.alias("copies")).alias(plan))


def plan_copies(docs: DataFrame, size: Column | None = None, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target, rate and copies: how often the mix takes each document.

    A document of a source with rate r is taken floor(r) times, and once more if a number hashed from
    seed and doc_id is below r's fraction, so reruns and retried tasks agree. Repeated rows share their
    draw. A null text has size 0, a null source is a source of its own, a null doc_id hashes as ''.
    Columns of docs with one of the added names are replaced; all others are kept.
    """
    kept = replacing(docs, "size", "source_size", "target", "rate", "copies")
    plan = unused("mix_plan", docs)
    return _planned(docs, size, weights, cap, seed, plan).select(*columns(kept), f"{plan}.*")


def mix(docs: DataFrame, size: Column | None = None, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as plan_copies says, with docs' columns as they are, whatever their names."""
    plan, number = unused("mix_plan", docs), unused("mix_copy_no", docs)
    planned = _planned(docs, size, weights, cap, seed, plan).where(F.col(f"{plan}.copies") > 0)
    return planned.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(f"{plan}.copies").cast("int")))).select(*columns(docs))
