"""Schema changes as functions of a table, each a new snapshot."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.expr import col


def add_column(table: DataFrame, name: str, kind: str, default: Any = None) -> DataFrame:
    return table.withColumn(name, col(default).cast(kind))


def drop_column(table: DataFrame, name: str) -> DataFrame:
    return table.drop(name)


def rename_column(table: DataFrame, old: str, new: str) -> DataFrame:
    return table.withColumnRenamed(old, new)


def alter_column_type(table: DataFrame, name: str, kind: str) -> DataFrame:
    return table.withColumn(name, F.col(name).cast(kind))


def add_not_null(table: DataFrame, name: str) -> DataFrame:
    """Fails when a NULL is met."""
    return table.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is null"))).otherwise(F.col(name)))


def fill_default(table: DataFrame, name: str, default: Any) -> DataFrame:
    return table.withColumn(name, F.coalesce(F.col(name), col(default)))


def migrate(table: DataFrame, *steps) -> DataFrame:
    """Steps ``(function, *arguments)`` in order."""
    for f, *args in steps:
        table = f(table, *args)
    return table
