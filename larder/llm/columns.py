"""A user's columns in one struct, so that no name of theirs meets one of ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """own (all columns of docs in one struct) and `more`, columns made of them."""
    return docs.select(F.struct(*map(named, docs.columns)).alias("own"), *more)


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns that packed() took, as they were."""
    return rows.select("own.*")


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column has it (names that differ by case only are one)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name
