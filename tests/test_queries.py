"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

from larder import registry
from larder.plans.base import TABLES

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    run = duck.execute(SQL[name])
    names = [c[0] for c in run.description]
    assert sorted(names) == columns
    want = Counter(repr([plain(r[names.index(c)]) for c in columns]) for r in run.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_hybrid_search_is_whole(spark, monkeypatch):
    """50 rows a branch, whole item texts, and hits by tag."""
    import inspect

    from larder.operators import search
    from larder.plans import retrieval

    asked, real = {}, search.hybrid_search

    def kept(*args, **named):
        bound = inspect.signature(real).bind(*args, **named)
        bound.apply_defaults()
        asked.update(bound.arguments)
        return real(*args, **named)

    monkeypatch.setattr(retrieval.search, "hybrid_search", kept)
    hits = QUERIES["s11_hybrid_search"](spark, DATA)
    assert hits.where("contains(evidence, 'TAG=Tag: ')").count() > 0
    texts = {r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert asked["n"] == 50 and texts <= {r.q for r in asked["queries"].select("q").distinct().collect()}
