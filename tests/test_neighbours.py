"""Neighbour searches over grids of small cells, and the index on queries that it was not calibrated on."""

from __future__ import annotations

import numpy as np
import pytest

from larder.operators import embed


def nearest(x, users, q, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u[q], 6) + 0.0
    return sorted((i for i in range(len(x)) if users[q] is not None and users[i] == users[q]), key=lambda i: (d[i], i))[:k]


def frame(spark, x, users):
    return spark.createDataFrame([(i, u, [float(c) for c in v]) for i, (u, v) in enumerate(zip(users, x))], "segment_id int, user_id string, embedding array<double>").repartition(4)


@pytest.mark.parametrize("rows, queries", [(20, 4), (20, 10_000), (10_000, 4), (10_000, 10_000)])
def test_hot_and_small_scopes_over_many_cells(spark, monkeypatch, rows, queries):
    """One scope of a third of all rows has a grid of its own, the rest share cells; equal vectors tie by key."""
    monkeypatch.setattr(embed, "ROW_BLOCK", rows)
    monkeypatch.setattr(embed, "QUERY_BLOCK", queries)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(80, 5)), 3, axis=0)
    users = [None if i % 37 == 0 else "hot" if i % 3 == 0 else f"u{i % 11}" for i in range(240)]
    corpus = frame(spark, x, users)
    asked = corpus.where("segment_id % 5 = 0").withColumnRenamed("segment_id", "query_id")
    got: dict = {}
    for r in embed.knn(asked, corpus, 6, scope="user_id").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.segment_id)
    assert got == {q: n for q in range(0, 240, 5) if (n := nearest(x, users, q, 6))}
    whole: dict = {}
    for r in embed.knn(asked, corpus, 6).orderBy("query_id", "rank").collect():
        whole.setdefault(r.query_id, []).append(r.segment_id)
    assert whole == {q: nearest(x, [1] * 240, q, 6) for q in range(0, 240, 5)}


def test_the_driver_holds_no_query(spark, monkeypatch):
    real = type(spark.range(1)).collect

    def at_most_one(self):
        rows = real(self)
        assert len(rows) <= 1, "rows in the driver"
        return rows

    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: pytest.fail("rows in the driver"))
    monkeypatch.setattr(type(spark.range(1)), "collect", at_most_one)
    corpus = frame(spark, np.eye(4), ["a"] * 4)
    assert embed.knn(corpus.withColumnRenamed("segment_id", "query_id"), corpus, 2, scope="user_id").count() == 8


@pytest.mark.parametrize("dim", [16, 10])
def test_the_index_finds_nine_in_ten_for_other_queries(spark, dim):
    """No clusters in the data, a dimension that is no multiple of a part, queries that are no rows of the index."""
    rng = np.random.default_rng(6)
    x, asked = rng.normal(size=(3000, dim)), rng.normal(size=(60, dim))
    corpus = frame(spark, x, ["a"] * 3000)
    queries = frame(spark, asked, ["a"] * 60).withColumnRenamed("segment_id", "query_id")
    index = embed.build_vector_index(corpus)
    probes, rerank = embed.calibrated(index, queries, 10, 0.95, 100)
    assert rerank <= 600
    exact = {(r.query_id, r.segment_id): r.distance for r in embed.knn(queries, corpus, 10).collect()}
    found = {(r.query_id, r.segment_id): r.distance for r in embed.search_index(index, queries, 10, probes, rerank).collect()}
    assert len(found) == 600 and len(exact.keys() & found.keys()) >= 540
    assert all(abs(exact[p] - found[p]) < 2e-6 for p in exact.keys() & found.keys())
