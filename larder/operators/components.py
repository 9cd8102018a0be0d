"""Connected components by alternating large-star and small-star steps, for nodes of any type that has an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import shared_folder


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; component is the least node reachable. Links may repeat or lead
    to themselves; those with a null end are left out.

    Every half step is checkpointed. A hub's links meet its minimum in a join of two exchanges, which adaptive
    execution can split, and minima come from partial aggregates: no node's links are gathered.
    """
    shared_folder(edges.sparkSession)
    both_ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = both_ends.distinct().checkpoint()
    now, mark = links.where("u <> v"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        least = now.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        met = now.join(least, "u")
        now = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        old, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == old:
            break
    reached = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    return nodes.join(reached, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
