"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sever


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    to = sever(_least(both).withColumn("m", F.least("u", "m")))
    return both.where("v > u").join(to, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    to = sever(_least(down))
    moved = down.join(to, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(to.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (u, v), two longs; a component is its smallest node.

    Minima are combined before the shuffle, so a node with very many links costs one row a task; they are
    cut before the join, so that adaptive execution can divide the nodes that are skewed. Each
    round is written to the checkpoint folder with its lineage and its estimated size cut. Repeated links and loops do no harm.
    """
    stars = sever(links.where("u != v").select("u", "v").distinct())
    mark = None
    while True:
        stars = sever(_small_star(_large_star(stars)))
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
