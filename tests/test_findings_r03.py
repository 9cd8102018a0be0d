"""What the findings of round 3 named, on small inputs of their kind."""

import random

import duckdb
import numpy as np
import pytest

from larder.operators import embed, textindex
from larder.plans import frames
from larder.session import staged
from larder.sources import library_io


def _vectors(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    return con


def test_unit_vectors_keep_the_sign_of_zero(spark, tmp_path):
    con = _vectors(spark, tmp_path, [(1, [1.0, -1e-8, 1e-8, -0.0, 0.0], 0), (2, [-3.0, 4.0, -1e-7], 0), (3, None, 0)])
    got = {r.vec_id: repr(r.unit) for r in frames.e4_l2_normalize(spark, str(tmp_path)).collect()}
    assert got == {k: repr(v) for k, v in con.execute(frames.plan.sql["e4_l2_normalize"]).fetchall()}
    assert got[1] == "[1.0, -0.0, 0.0, -0.0, 0.0]"


def test_an_index_is_built_and_read_without_shuffling_it(spark):
    words = " ".join(f"w{i % 90} x{i % 7}" for i in range(500))
    segments = spark.range(400).selectExpr("id AS segment_id", "id div 5 AS memory_id", "'u' AS user_id", f"'{words}' AS content")
    segments = segments.unionByName(spark.createDataFrame([(-1, 0, "u", ""), (-2, 0, "u", None), (-3, 0, "u", "b a B")], "segment_id long, memory_id long, user_id string, content string"))
    index = textindex.build_index(segments)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in index.where("segment_id < 0").collect()) == [(-3, "a", [1], 1, 1, 1), (-3, "b", [0, 2], 2, 0, 2)]
    stored = staged(index, "index")
    queries = spark.createDataFrame([(1, "u", "w1 x3")], "query_id long, user_id string, q string")
    read = textindex._asked(stored, textindex.query_terms(queries), ["positions"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert textindex.fts_match(queries, stored, owners=segments.select("segment_id", "user_id")).count() == 400


def test_ranks_of_many_terms_and_hits_equal_a_plain_search(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh xyz uvw".split() + list("abcdef")) for _ in range(n)) for n in (30, 90, 300)]
    segments = spark.createDataFrame([(i, 0, "u", t) for i, t in enumerate(texts)], "segment_id long, memory_id long, user_id string, content string")
    asked = {7: "a", 8: "a b", 9: "a b c d e f", 10: "uvw xyz a f"}
    queries = spark.createDataFrame([(k, "u", q) for k, q in asked.items()], "query_id long, user_id string, q string")
    index = textindex.build_index(segments)
    got = {(r.query_id, r.segment_id): r["rank"] for r in textindex.fts_rank(textindex.fts_match(queries, index), queries, index).collect()}
    want = {}
    for k, q in asked.items():
        terms = set(q.split())
        for i, t in enumerate(texts):
            h = [(p, w) for p, w in enumerate(t.split()) if w in terms]
            last, begun, total = {}, -1, 0.0
            for e, (_, w) in enumerate(h):
                last[w] = e
                if len(last) == len(terms) and (b := min(last.values())) > begun:
                    begun, total = b, total + 0.1 / (1 + (h[e][0] - h[b][0]) - (e - b))
            if len(last) == len(terms):
                want[k, i] = round(total, 9)
    assert len(want) >= 8 and got == want


@pytest.mark.parametrize("piece, places", [(1 << 17, 1 << 20), (7, 64)])
def test_counts_of_grams_equal_plain_ones(monkeypatch, piece, places):
    """Characters beyond the basic plane, more characters than are numbered, pieces of a text, places that grams share."""
    monkeypatch.setattr(embed, "PIECE", piece)
    monkeypatch.setattr(embed, "KNOWN_GRAMS", places)
    rng = random.Random(3)
    texts = ["", "a", "ab", "İß Σς 😀 x", "\x00\x00a", "".join(map(chr, range(300, 6000))), "ab c" * 300]
    texts += ["".join(chr(rng.choice((rng.randint(1, 0xD7FF), rng.randint(97, 110)))) for _ in range(rng.randint(0, 900))) for _ in range(20)]
    counted = embed._Buckets(256)
    for t in texts + texts:
        assert (counted.counts(t) == np.bincount([counted.of(g) for g in embed._grams(t)], minlength=256)).all()


def test_a_provider_sees_few_rows_at_once(spark):
    df = spark.range(3000).coalesce(1).selectExpr("id", "timestamp_micros(id) AS at", "'the ' || id AS t")
    told = embed.apply_provider(df, lambda: lambda f: [[len(f), a.year] for a in f["at"]], ["at"], "m", "array<bigint>", 2)
    rows = told.collect()
    assert len(rows) == 3000 and max(r.m[0] for r in rows) <= embed.SLICE and {r.m[1] for r in rows} == {1970}
    assert [(r.id, r.t) for r in rows] == [(i, f"the {i}") for i in range(3000)] and rows[5].at.microsecond == 5


def test_media_tasks_and_folders_stay_small(spark, tmp_path, monkeypatch):
    """One partition of many files is dealt to many tasks, and the files to many folders; files are read many to a task."""
    monkeypatch.setattr(library_io, "TASK_FILES", 50)
    media = spark.range(0, 600, 1, 1).selectExpr("id", "cast('text ' || id % 500 as binary) AS content", "'bin' AS extension")
    stored = library_io.store_media(media, "id", "content", "extension", str(tmp_path))
    assert stored.count() == 600 and len([f for f in stored.inputFiles()]) >= 8
    folders = list(tmp_path.iterdir())
    assert all(f.is_dir() and len(f.name) == 2 for f in folders) and sum(len(list(f.iterdir())) for f in folders) == 500
    read = library_io.media_inventory(spark, str(tmp_path))
    assert read.where("intact").count() == 500 and read.rdd.getNumPartitions() <= 4
