"""Recursive queries: UNION ALL through Spark's WITH RECURSIVE, UNION by a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def recursive_all(spark: SparkSession, name: str, columns: list[str], base: str, step: str, final: str | None = None, levels: int = 100) -> DataFrame:
    """``WITH RECURSIVE name(columns) AS (base UNION ALL step)``; the step's end is its own."""
    limit = f" MAX RECURSION LEVEL {levels}" if levels != 100 else ""
    return spark.sql(f"WITH RECURSIVE {name}({', '.join(columns)}){limit} AS ({base} UNION ALL {step}) {final or f'SELECT * FROM {name}'}")


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 1000) -> DataFrame:
    """Rows reached from ``base`` by repeating ``step`` on the new ones, each once.

    Every round is written to the shared folder and read again, so that plans don't grow and lost
    executors don't matter; a round writes its new rows alone. Rounds end when nothing new comes,
    which also ends cycles.
    """
    spark = base.sparkSession
    folder = scratch(spark, "fixpoint")
    fresh = base.distinct()
    for k in range(limit):
        fresh.write.parquet(f"{folder}/round={k}")
        fresh = spark.read.schema(base.schema).parquet(f"{folder}/round={k}")
        seen = spark.read.schema(base.schema).parquet(*(f"{folder}/round={i}" for i in range(k + 1)))
        if fresh.isEmpty():
            return seen
        old = seen.toDF(*(f"__{c}" for c in base.columns))
        new = step(fresh).toDF(*base.columns).distinct()
        new = new.select(*(F.col(f.name).cast(f.dataType) for f in base.schema))
        fresh = new.join(old, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in base.columns], "left_anti")
    raise RecursionError(f"no end after {limit} rounds")


def ancestors(table: DataFrame, start: DataFrame, key: str, parent: str) -> DataFrame:
    """Chains upward: ``key, parent, level`` from each start row."""
    first = table.join(start, key, "left_semi").select(F.col(key).alias("node"), F.col(parent).alias("above"), F.lit(0).alias("level"))
    edges = table.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    return fixpoint(first, lambda f: f.join(edges, f["above"] == F.col("k")).select(F.col("k"), F.col("p"), F.col("level") + 1))
