"""Catalogue of the cluster combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import combos as c
from . import derived as d


def q_frequency_plan(spark, sf_dir):
    """F10, I6"""
    return c.frequencies(d.csize(spark, sf_dir)).select("cluster_id", "size", F.col("rank").cast("long").alias("rank"), "frequency")


def q_combo_enumeration(spark, sf_dir):
    """The 30 sets of four clusters nearest to the mean total."""
    return c.enumerate_combinations(d.csize(spark, sf_dir))


def _combos(spark, sf_dir):
    """A fixed partition: combination i holds clusters i, i+5, i+10, i+15 modulo 21."""
    sizes = d.csize(spark, sf_dir)
    slots = spark.range(1, 31).select(F.col("id").alias("combination_id"), F.posexplode(F.array(*[((F.col("id") + 5 * j) % 21).cast("int") for j in range(4)])).alias("slot", "cluster_id"))
    return slots.join(F.broadcast(sizes), "cluster_id")  # one row a cluster


def q_combo_stats(spark, sf_dir):
    """E13, I32"""
    totals = _combos(spark, sf_dir).groupBy("combination_id").agg(F.sum("size").alias("total_size"))
    s = c.combination_stats(totals)
    return s.select("n", *[F.round(x, 6).alias(x) for x in ("mean_size", "std_size", "variance")], "min_size", "max_size", "size_range")


def q_combo_frequency(spark, sf_dir):
    """E14, H8"""
    arrays = _combos(spark, sf_dir).groupBy("combination_id").agg(F.collect_list("cluster_id").alias("clusters"))
    return c.cluster_frequency(arrays)


def q_combo_swap_gain(spark, sf_dir):
    """The ten best swaps of the fixed partition."""
    gains = c.swap_gains(_combos(spark, sf_dir))
    return gains.orderBy("change", "a_combination_id", "a_slot", "b_combination_id", "b_slot").limit(10)


def r_combinations(spark, sf_dir):
    """Shuffled, climbed and flattened."""
    return c.flatten(c.build(spark, d.csize(spark, sf_dir)))


def r_combination_document(spark, sf_dir):
    """B5"""
    return c.document(c.build(spark, d.csize(spark, sf_dir)))


QUERIES = [q_frequency_plan, q_combo_enumeration, q_combo_stats, q_combo_frequency, q_combo_swap_gain, r_combinations, r_combination_document]

_SLOTS = f"{d.CSIZE}, slots as (select i as combination_id, j as slot, cast((i + 5 * j) % 21 as integer) as cluster_id from range(1, 31) a(i), range(4) b(j)), rich as (select combination_id, slot, cluster_id, size, sum(size) over (partition by combination_id) as total from slots join csize using (cluster_id))"
SQL = {
    "q_frequency_plan": f"with {d.CSIZE}, r as (select cluster_id, size, row_number() over (order by size desc, cluster_id) as rank, count(*) over () as k from csize) select cluster_id, size, rank, 120 // k + case when rank > k - 120 % k then 1 else 0 end as frequency from r",
    "q_combo_enumeration": f"with {d.CSIZE} select a.cluster_id as cluster_1, b.cluster_id as cluster_2, c.cluster_id as cluster_3, d.cluster_id as cluster_4, a.size + b.size + c.size + d.size as total_size from csize a join csize b on a.cluster_id < b.cluster_id join csize c on b.cluster_id < c.cluster_id join csize d on c.cluster_id < d.cluster_id order by round(abs(total_size - 4 * (select avg(size) from csize)), 6), 1, 2, 3, 4 limit 30",
    "q_combo_stats": f"with {_SLOTS}, t as (select combination_id, sum(size) as total from rich group by 1) select count(*) as n, round(avg(total), 6) as mean_size, round(stddev_pop(total), 6) as std_size, round(var_pop(total), 6) as variance, cast(min(total) as bigint) as min_size, cast(max(total) as bigint) as max_size, cast(max(total) - min(total) as bigint) as size_range from t",
    "q_combo_frequency": f"with {_SLOTS} select cluster_id, count(*) as frequency from rich group by 1",
    "q_combo_swap_gain": f"""with {_SLOTS} select a.combination_id as a_combination_id, cast(a.slot as integer) as a_slot, b.combination_id as b_combination_id, cast(b.slot as integer) as b_slot,
      cast((a.total + b.size - a.size) * (a.total + b.size - a.size) - a.total * a.total + (b.total - b.size + a.size) * (b.total - b.size + a.size) - b.total * b.total as bigint) as change
      from rich a join rich b on a.combination_id < b.combination_id order by change, 1, 2, 3, 4 limit 10""",
}
