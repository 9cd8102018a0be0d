"""The versioned bucket table: replacements, writers that die, batches that run twice, growth."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from larder.sources import bucket_table
from larder.sources.bucket_table import BucketTable
from larder.streaming import streams


@pytest.fixture
def table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucket_table, "ROWS_PER_BUCKET", 10)
    return BucketTable(spark, str(tmp_path / "t"), ["k"])


def rows(spark, ks, v, times=2):
    return spark.createDataFrame([(k, f"{v}{i}") for k in ks for i in range(times)], "k long, v string")


def content(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_replacing_rewrites_touched_buckets_alone(spark, table):
    table.replace(rows(spark, range(50), "a"), "k")
    old = table.manifest()
    assert old["buckets"] == 10
    table.replace(rows(spark, [3, 99], "b", 1), "k")
    new = table.manifest()
    changed = [b for b in new["writes"] if old["writes"].get(b) != new["writes"][b]]
    assert 1 <= len(changed) <= 2
    want = sorted([(k, f"a{i}") for k in range(50) if k != 3 for i in range(2)] + [(3, "b0"), (99, "b0")])
    assert content(table) == want and sum(new["rows"].values()) == len(want)
    assert content(table, 0) == sorted((k, f"a{i}") for k in range(50) for i in range(2))


@pytest.mark.parametrize("where", ["_counted", "_publish"])
def test_a_writer_that_dies_leaves_the_old_rows(spark, table, monkeypatch, where):
    table.replace(rows(spark, range(20), "a"), "k")
    before = content(table)
    with monkeypatch.context() as m:
        m.setattr(BucketTable, where, lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.replace(rows(spark, range(20), "b"), "k")
    assert content(table) == before and table.version() == 0
    table.replace(rows(spark, [1], "c"), "k")
    assert (1, "c0") in content(table) and len(content(table)) == len(before)


def test_of_two_writers_of_one_version_the_later_fails(spark, table):
    table.replace(rows(spark, range(5), "a"), "k")
    manifest = table.manifest()
    with pytest.raises(Exception, match="(?i)exist"):
        table._publish(0, manifest)
    assert table.version() == 0 and len(content(table)) == 10


def test_a_batch_that_runs_twice_is_applied_once(spark, table):
    add = lambda old, new: old.unionByName(new)
    for tag in (0, 1, 1, 0):
        table.write(rows(spark, [1], f"t{tag}-", 1), add, tag)
    assert content(table) == [(1, "t0-0"), (1, "t1-0")] and table.version() == 1


def test_a_grown_table_is_dealt_anew(spark, table):
    table.replace(rows(spark, range(3), "a"), "k")
    assert table.manifest()["buckets"] == 1
    table.replace(rows(spark, range(3, 60), "b"), "k")
    table.replace(rows(spark, [0], "c"), "k")
    assert table.manifest()["buckets"] == 12 and len(content(table)) == 120 and (0, "c1") in content(table)


def test_rows_may_go_and_vacuum_keeps_what_is_named_or_young(spark, table):
    table.replace(rows(spark, range(20), "a"), "k")
    for _ in range(3):
        table.write(rows(spark, range(20), "x"), lambda old, new: new)
    assert table.vacuum(keep=2) == 0  # all of them are young
    assert table.vacuum(keep=2, older_than_s=-60) == 2
    assert len(content(table)) == 40 and len(content(table, 2)) == 40
    table.write(rows(spark, range(20), "x"), lambda old, new: new.limit(0))
    assert content(table) == [] and table.manifest()["writes"] == {}


def test_bytes_grow_with_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucket_table, "ROWS_PER_BUCKET", 50)
    table = BucketTable(spark, str(tmp_path / "t"), ["k"])
    table.replace(spark.range(5_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")), "k")

    def size(write):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{tmp_path}/t/data/{write}") for f in fs if f.endswith(".parquet"))

    whole = size(next(iter(table.manifest()["writes"].values())))
    old = set(table.manifest()["writes"].values())
    table.replace(spark.createDataFrame([(1, "x")], "k long, v string"), "k")
    (new,) = set(table.manifest()["writes"].values()) - old
    assert size(new) < whole / 30


def test_upserts_restart_with_nothing_new(spark, tmp_path):
    captures = spark.createDataFrame([(1, 1, "web", "a", "u"), (2, 1, "web", "a", "u")], "capture_id int, user_id int, platform string, platform_item_id string, original_url string").withColumn("captured_at", F.lit("2026-01-01").cast("timestamp"))
    captures.write.parquet(str(tmp_path / "in"))
    run = lambda: sorted(map(tuple, streams.upsert_items(streams.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out")).collect()))
    first = run()
    assert run() == first and first[0][5] == 2
    captures.withColumn("capture_id", F.lit(3)).limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run()[0][5] == 3
