from concurrent.futures import ThreadPoolExecutor

import pytest

from larder.llm import shards

SCHEMA = "doc_id long, text string, group string, tier int"


def rows(a, n):
    return [(i if i % 7 else None, None if i % 5 == 0 else f"text {i} " * 40, "g", 1) for i in range(a, a + n)]


def test_appends_compaction_and_versions(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.compact() == 0
    everything = []
    for k in range(9):
        part = rows(k * 100, 100)
        everything += part
        store.append(spark.createDataFrame(part, SCHEMA).coalesce(1))
    assert store.version() == 9 and store.manifest().count() == 9
    target = 4 * max(r.bytes for r in store.manifest().collect())
    version = store.compact(target=target)
    assert version == 10
    after = store.manifest().collect()
    assert len(after) < 9 and {r.level for r in after} >= {1} and sum(r.rows for r in after) == 900
    read = store.read()
    assert read.columns == ["doc_id", "text", "group", "tier", "__shard"]
    assert sorted((tuple(r)[:4] for r in read.collect()), key=str) == sorted(everything, key=str)
    # the version before is still readable, until its files go
    assert store.read(9).count() == 900
    assert store.vacuum() == 9 - sum(r.level == 0 for r in after)
    assert store.read().count() == 900


def test_big_shards_and_small_crowds_stay(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    for k in range(3):
        store.append(spark.createDataFrame(rows(k, 10), SCHEMA).coalesce(1))
    assert store.compact(target=1 << 20) == 3  # three runs of a tier wait for a fourth
    store.append(spark.createDataFrame(rows(9, 10), SCHEMA).coalesce(1))
    assert store.compact(target=10) == 4  # all are larger than the target


def test_empty_arrivals(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    assert store.append(spark.createDataFrame([], SCHEMA)) == 1
    assert store.manifest().count() == 0 and store.compact() == 1
    with pytest.raises(ValueError, match="empty"):
        store.read()


def test_one_of_two_writers_wins(spark, tmp_path):
    a, b = (shards.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    a.append(spark.createDataFrame(rows(0, 10), SCHEMA))
    with pytest.raises(shards.Conflict):
        b._commit(b.manifest(), 1)
    assert a.version() == 1 and a.manifest().count() >= 1


def test_writers_that_saw_the_same_version(spark, tmp_path):
    """Neither looks before it publishes: the step itself lets one through."""
    stores = [shards.ShardStore(spark, str(tmp_path / "s")) for _ in range(6)]
    stores[0].append(spark.createDataFrame(rows(0, 10), SCHEMA).coalesce(1))

    def write(store):
        try:
            return store._commit(store.manifest(1), 2)
        except shards.Conflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(write, stores))
    assert sorted(won, key=str) == [2] + [None] * 5
    assert stores[1].version() == 2 and stores[1].read().count() == 10
    # a lost commit leaves nothing behind
    kept = [p.name for p in (tmp_path / "s" / "manifests").iterdir() if p.name.startswith(".rows") or p.name.startswith(".said")]
    assert len(kept) == 2


def test_columns_of_any_name_and_empty_stores(spark, tmp_path):
    schema = "doc_id long, `__shard` string, `__group` int, `a.b` string, text string"
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    for k in range(5):
        store.append(spark.createDataFrame([(k, "own", 7, "dot", "long " * 100_000), (None, None, None, None, None)], schema).coalesce(1))
    assert store.compact(target=1 << 30) == 6
    read = store.read()
    assert read.columns == ["doc_id", "__shard", "__group", "a.b", "text", "__shard_"]
    assert sorted((tuple(r)[:4] for r in read.collect()), key=str) == sorted([(k, "own", 7, "dot") for k in range(5)] + [(None,) * 4] * 5, key=str)
    empty = shards.ShardStore(spark, str(tmp_path / "e"))
    empty.append(spark.createDataFrame([], schema))
    assert empty.read(schema=read.drop("__shard_").schema).collect() == []


def test_the_query_keeps_every_row(spark, tmp_path):
    from larder.llm.queries import op9_tiered_compaction

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op9_tiered_compaction(spark, "/root/testdata/sf0.01")
    assert sorted((r.doc_id, r.n_chars) for r in out.collect()) == sorted((r.doc_id, len(r.text)) for r in docs.collect())
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert op9_tiered_compaction(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("step", ["_shards", "_commit"])
def test_vacuum_leaves_the_files_of_a_write_under_way(spark, tmp_path, monkeypatch, step):
    """Another writer vacuums just before each step of an append and of a merge: nothing that is published is lost."""
    folder, real = str(tmp_path / "s"), getattr(shards.ShardStore, step)
    rows = spark.range(40).selectExpr("id AS doc_id", "'t' AS text")

    def with_vacuum(self, *args):
        shards.ShardStore(spark, folder).vacuum()
        return real(self, *args)

    monkeypatch.setattr(shards.ShardStore, step, with_vacuum)
    store = shards.ShardStore(spark, folder)
    for k in range(3):
        store.append(rows.where(f"doc_id % 3 = {k}"))
    store.compact(fanin=2)
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(40))
    assert store.vacuum() > 0 or step == "_commit"
    assert store.read().count() == 40


def test_vacuum_takes_what_a_dead_writer_left(spark, tmp_path, monkeypatch):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.range(5).selectExpr("id AS doc_id", "'t' AS text"))
    with monkeypatch.context() as m:
        m.setattr(shards.ShardStore, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        m.setattr(shards.ShardStore, "_end", lambda *a: None)
        with pytest.raises(RuntimeError):
            store.append(spark.range(5).selectExpr("id AS doc_id", "'u' AS text"))
    assert store.vacuum() == 0 and store.vacuum(abandoned_s=-60) > 0
    assert store.read().count() == 5
