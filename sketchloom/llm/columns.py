"""Columns of callers, kept out of the way of an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def held(columns: list[str]) -> Column:
    """The named columns in one struct ``_held``, where they cannot clash with any other."""
    return (F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.lit(None).cast("string")).alias("_held")


def released(columns: list[str], results: list[str]) -> list[Column]:
    """The columns of ``_held`` and then the results; a result replaces a column of its name."""
    taken = {r.lower() for r in results}
    return [*(F.col("_held").getField(c).alias(c) for c in columns if c.lower() not in taken), *(F.col(r) for r in results)]


def schema_with(df: DataFrame, columns: list[str], results: str) -> StructType:
    """The schema of some columns of ``df`` followed by ``results`` (DDL)."""
    return StructType([*df.select(*columns).schema, *StructType.fromDDL(results)])
