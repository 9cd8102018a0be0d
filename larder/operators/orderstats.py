"""Exact order statistics of groups of any size: no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import staged


def order_statistics(df: DataFrame, key: str, value: str, at: dict[str, Column]) -> DataFrame:
    """(key, n, one column for each of `at`): the value at a 0-based place in the sorted values of a key. Places are
    expressions of F.col("n"), the key's number of values; a place between two whole numbers lies as far between their values. Null values take
    no part, a null key is a key, and a place outside of a key's values is null.

    Equal values are counted first. The counts are sorted by (key, value) over range partitions, and a partition's
    sums by key tell the partitions behind it how many values come before theirs: so a key with a third of all rows is
    spread over as many partitions as its distinct values need, and what is gathered by key is a number a partition.
    """
    for name in at:
        if name in (key, "n"):
            raise ValueError(f"{name} is taken")
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    # written with the partition's number, as a partition computed again need not get the same range
    sorted_ = staged(counted.repartitionByRange("k", "v").select("k", "v", "c", F.spark_partition_id().alias("part")), "order-counts")
    sums = sorted_.groupBy("k", "part").agg(F.sum("c").alias("c"))
    ahead = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = {name: place.cast("double") for name, place in at.items()}
    ends = sums.select("k", "part", F.col("c").alias("held"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"), F.sum("c").over(Window.partitionBy("k")).alias("n"))
    ends = ends.withColumn("wanted", F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in placed.values()]))))
    # only partitions that hold a wanted place are counted through
    some = ends.where(F.exists("wanted", lambda w: (w >= F.col("ahead")) & (w < F.col("ahead") + F.col("held"))))
    rows = sorted_.withColumnRenamed("k", "k0").withColumnRenamed("part", "part0").join(some, F.col("k0").eqNullSafe(F.col("k")) & (F.col("part0") == F.col("part")))
    before = Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    from_ = F.col("ahead") + F.coalesce(F.sum("c").over(before), F.lit(0))
    found = rows.select("k", "n", "v", "c", "wanted", from_.alias("from_")).where(F.exists("wanted", lambda w: (w >= F.col("from_")) & (w < F.col("from_") + F.col("c"))))
    holds = lambda p: (p >= F.col("from_")) & (p < F.col("from_") + F.col("c"))
    value_at = lambda p: F.max(F.when(holds(p), F.col("v")))
    share = lambda p: F.max(p - F.floor(p))
    between = lambda p: F.when(share(p) == 0, value_at(F.floor(p)).cast("double")).otherwise((1 - share(p)) * value_at(F.floor(p)) + share(p) * value_at(F.ceil(p)))
    picked = found.groupBy(F.col("k").alias("k1")).agg(*[between(p).alias(name) for name, p in placed.items()])
    totals = ends.groupBy(F.col("k").alias(key)).agg(F.max("n").alias("n"))
    return totals.join(picked, F.col(key).eqNullSafe(F.col("k1")), "left").drop("k1")


def median() -> Column:
    return (F.col("n") - 1) / 2


def low_place(share: float) -> Column:
    """int(n * share), the last place at most."""
    return F.least(F.col("n") - 1, F.floor(F.col("n") * share))
