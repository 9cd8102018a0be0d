"""Queries over the reference's operators, gathered from the modules that bind them."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("intake", "dedup", "extract", "cards", "taxonomy", "frames", "retrieval", "library", "usage", "streams")


def _plans():
    return [import_module(f"larder.plans.{m}").plan for m in MODULES]


def queries() -> dict:
    return {name: f for p in _plans() for name, f in p.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for p in _plans() for name, sql in p.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid search."""
    return queries()["s11_hybrid_search"](spark, sf_dir)
