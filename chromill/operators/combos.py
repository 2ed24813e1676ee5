"""Balanced combinations of clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMBINATIONS, COLOURS_EACH = 30, 4


def frequencies(sizes: DataFrame, combinations: int = COMBINATIONS, each: int = COLOURS_EACH) -> DataFrame:
    """(cluster_id, size, rank, frequency): slots dealt evenly, the smallest clusters taking what is over."""
    slots = combinations * each
    k = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "cluster_id"))
    ranked = sizes.select("cluster_id", "size", rank.alias("rank"), k.alias("k"))
    base = F.floor(F.lit(slots) / F.col("k"))
    return ranked.select("cluster_id", "size", "rank", (base + F.when(F.col("rank") > F.col("k") - F.lit(slots) % F.col("k"), 1).otherwise(0)).cast("long").alias("frequency"))


def enumerate_combinations(sizes: DataFrame, top: int = COMBINATIONS) -> DataFrame:
    """The top sets of four distinct clusters whose total lies nearest to four times the mean size, by theta self-joins.

    Clusters are few by design (their number is the model's k), which bounds the joins.
    """
    s = [sizes.select(F.col("cluster_id").alias(f"cluster_{i}"), F.col("size").alias(f"size_{i}")) for i in range(1, 5)]
    joined = s[0]
    for i in range(1, 4):
        joined = joined.join(F.broadcast(s[i]), F.col(f"cluster_{i}") < F.col(f"cluster_{i + 1}"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    total = F.col("size_1") + F.col("size_2") + F.col("size_3") + F.col("size_4")
    ids = [f"cluster_{i}" for i in range(1, 5)]
    ranked = joined.withColumn("total_size", total).join(F.broadcast(mean)).withColumn("gap", F.abs(F.col("total_size") - F.col("mean") * 4))
    return ranked.orderBy(F.round("gap", 6), *ids).limit(top).select(*ids, "total_size")


def combination_stats(totals: DataFrame) -> DataFrame:
    """Population statistics of total_size; of one combination the variance is 0."""
    t = F.col("total_size")
    return totals.agg(F.count("*").alias("n"), F.avg(t).alias("mean_size"), F.stddev_pop(t).alias("std_size"), F.var_pop(t).alias("variance"), F.min(t).alias("min_size"), F.max(t).alias("max_size"), (F.max(t) - F.min(t)).alias("size_range"))


def cluster_frequency(combos: DataFrame) -> DataFrame:
    """How often each cluster occurs over all combinations' clusters array."""
    return combos.select(F.explode("clusters").alias("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("frequency"))


def swap_gains(slots: DataFrame) -> DataFrame:
    """Of (combination_id, slot, cluster_id, size): each swap of slots of two combinations and the change of the sum of squared totals."""
    total = slots.groupBy("combination_id").agg(F.sum("size").alias("total"))
    rich = slots.join(total, "combination_id")
    a = rich.select(*[F.col(c).alias(f"a_{c}") for c in ("combination_id", "slot", "size", "total")])
    b = F.broadcast(rich.select(*[F.col(c).alias(f"b_{c}") for c in ("combination_id", "slot", "size", "total")]))  # 120 slots
    d = F.col("b_size") - F.col("a_size")
    change = (F.col("a_total") + d) * (F.col("a_total") + d) - F.col("a_total") * F.col("a_total") + (F.col("b_total") - d) * (F.col("b_total") - d) - F.col("b_total") * F.col("b_total")
    return a.join(b, F.col("a_combination_id") < F.col("b_combination_id")).select("a_combination_id", "a_slot", "b_combination_id", "b_slot", change.alias("change"))


def random_partition(plan: list[tuple[int, int, int]], combinations: int = COMBINATIONS, each: int = COLOURS_EACH, tries: int = 100, seed: int = 42) -> list[list[int]]:
    """Cluster ids in combinations, the best of several shuffles of the slots by variance of totals; plan holds (id, size, frequency)."""
    size = {i: s for i, s, _ in plan}
    pool = np.array([i for i, _, f in plan for _ in range(f)])
    draw, best, least = np.random.default_rng(seed), None, np.inf
    for _ in range(tries):
        dealt = draw.permutation(pool).reshape(combinations, each)
        spread = np.vectorize(size.get)(dealt).sum(axis=1).var()
        if spread < least:
            best, least = dealt, spread
    return [list(map(int, row)) for row in best]


def hill_climb(combos: list[list[int]], size: dict[int, int], limit: int = 1000) -> list[list[int]]:
    """Swaps slots of two combinations while that lowers the variance of totals; a swap costs two squares, as the mean stays."""
    combos = [list(c) for c in combos]
    totals = [sum(size[x] for x in c) for c in combos]
    for _ in range(limit):
        done = True
        for i in range(len(combos)):
            for j in range(i + 1, len(combos)):
                for a in range(len(combos[i])):
                    for b in range(len(combos[j])):
                        d = size[combos[j][b]] - size[combos[i][a]]
                        if d and (totals[i] + d) ** 2 + (totals[j] - d) ** 2 < totals[i] ** 2 + totals[j] ** 2:
                            combos[i][a], combos[j][b] = combos[j][b], combos[i][a]
                            totals[i], totals[j], done = totals[i] + d, totals[j] - d, False
        if done:
            break
    return combos


def build(spark: SparkSession, sizes: DataFrame, combinations: int = COMBINATIONS, each: int = COLOURS_EACH, tries: int = 100, seed: int = 42) -> DataFrame:
    """(combination_id, clusters, total_size, colors): a shuffle of the frequency plan, then the hill climb.

    The plan has one row a cluster and the search runs on its few slots, on the driver.
    """
    plan = sorted((r["cluster_id"], r["size"], r["frequency"]) for r in frequencies(sizes, combinations, each).collect())
    size = {i: s for i, s, _ in plan}
    found = hill_climb(random_partition(plan, combinations, each, tries, seed), size)
    rows = [(n, c, sum(size[x] for x in c), [f"C{x}" for x in c]) for n, c in enumerate(found, 1)]
    return spark.createDataFrame(rows, "combination_id int, clusters array<int>, total_size long, colors array<string>")


def flatten(combos: DataFrame, each: int = COLOURS_EACH) -> DataFrame:
    """Arrays of clusters and colours as numbered columns."""
    return combos.select("combination_id", *[F.col("clusters")[i].alias(f"cluster_{i + 1}") for i in range(each)], "total_size", *[F.col("colors")[i].alias(f"color_{i + 1}") for i in range(each)])


def document(combos: DataFrame) -> DataFrame:
    """One row: the combinations as a JSON document with their statistics."""
    stats = combination_stats(combos).select(F.struct("mean_size", "std_size", "variance", "min_size", "max_size").alias("statistics"), F.col("n").alias("total_combinations"))
    listed = combos.agg(F.array_sort(F.collect_list(F.struct("combination_id", "clusters", "total_size", "colors"))).alias("combinations"))
    meta = F.struct("total_combinations", F.size(F.col("combinations")[0]["clusters"]).alias("colors_per_combination"), "statistics")
    return stats.join(F.broadcast(listed)).select(F.to_json(F.struct(meta.alias("metadata"), "combinations"), {"pretty": "true"}).alias("value"))


def report(combos: DataFrame) -> str:
    """The combinations and their statistics as text lines."""
    s = combination_stats(combos).first()
    lines = [f"Combinations: {s['n']}", f"Mean size: {s['mean_size']:.2f}", f"Std: {s['std_size']:.2f}", f"Range: {s['min_size']}-{s['max_size']}", ""]
    return "\n".join(lines + [f"{r['combination_id']:2d}: {', '.join(r['colors'])} (total {r['total_size']})" for r in combos.orderBy("combination_id").collect()])
