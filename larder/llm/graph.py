"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import shared_folder


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum, to tell whether a step changed anything."""
    digest = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(digest)).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Node ids are longs; links may repeat, be self links or hold nulls (both are ignored).
    Each half step checkpoints its edges and its minima, so a hub's edges meet its minimum
    in a join of two exchanges, which adaptive execution can split, and minima come from
    partial aggregates; no node's links are ever gathered.
    """
    shared_folder(edges.sparkSession)
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"), (x != y).alias("ok")).where("ok").select("u", "v").distinct().checkpoint()
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        # large star: every larger neighbour of u moves to the least node near u
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        least = now.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        # small star: the smaller neighbours of u, and u itself, move to the least of them
        met = now.join(least, "u")
        now = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        old, mark = mark, _mark(now)
        if mark == old:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
