"""Order statistics against sorting, with a hot key, ties and nulls."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larder.operators.orderstats import low_place, median, order_statistics


def test_equal_to_sorting_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.randrange(4000))) for _ in range(6000)] + [("tie", 3.0)] * 500 + [(f"k{i % 40}", rng.random()) for i in range(777)] + [(None, 1.0), (None, 2.0), ("none", None), ("one", 5.0), ("k1", None)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(7)
    got = {r.key: r for r in order_statistics(df, "key", "value", {"mid": median(), "p95": low_place(0.95), "first": F.lit(0), "far": F.lit(10**9)}).collect()}
    values: dict = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    assert got.keys() == values.keys()
    for k, v in values.items():
        v.sort()
        n = len(v)
        assert (got[k].n, got[k].mid, got[k].p95, got[k].first, got[k].far) == (n, (v[(n - 1) // 2] + v[n // 2]) / 2, v[min(n - 1, int(n * 0.95))], v[0], None)


def test_no_task_holds_the_hot_key(spark):
    """Its values lie in several range partitions."""
    df = spark.range(20_000).select(F.lit("hot").alias("key"), F.col("id").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = df.groupBy("key", "value").count().repartitionByRange("key", "value").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 15_000
        (row,) = order_statistics(df, "key", "value", {"mid": median()}).collect()
        assert (row.n, row.mid) == (20_000, 9999.5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_taken_names(spark):
    df = spark.createDataFrame([], "key string, value double")
    assert order_statistics(df, "key", "value", {"mid": median()}).count() == 0
    with pytest.raises(ValueError, match="taken"):
        order_statistics(df, "key", "value", {"n": median()})
