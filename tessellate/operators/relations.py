"""Related rows nested into their parents: one plan with arrays of structs, not a query a relation."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.expr import col


@dataclass
class Load:
    """Children of a parent: rows of ``child`` whose ``key`` is the parent's ``parent_key``.

    ``order`` sorts the children, ``per_parent`` keeps the first of them, ``then`` nests further
    loads below. ``many`` false: the single row the parent refers to, as a struct.
    """

    name: str
    child: DataFrame
    key: str
    parent_key: str
    order: list[Any] = field(default_factory=list)
    per_parent: int | None = None
    where: Any = None
    many: bool = True
    loads: list[Load] = field(default_factory=list)

    def then(self, *loads: Load) -> Load:
        self.loads.extend(loads)
        return self


def top_per_group(df: DataFrame, keys: list[str], order: list[Any], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*map(col, order))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def nested(parent: DataFrame, *loads: Load) -> DataFrame:
    """``parent`` with a column for each load: an array of structs (empty if none) or a struct (or NULL)."""
    out = parent
    for load in loads:
        child = load.child if load.where is None else load.child.where(col(load.where))
        if load.per_parent is not None:
            child = top_per_group(child, [load.key], load.order, load.per_parent)
        child = nested(child, *load.loads) if load.loads else child
        fields = F.struct(*(F.col(f"`{c}`") for c in child.columns))
        if not load.many:
            rows = child.select(F.col(load.key).alias("__k"), fields.alias("__row"))
            out = out.join(rows, F.col(load.parent_key) == F.col("__k"), "left").drop("__k").withColumnRenamed("__row", load.name)
            continue
        if load.order:
            w = Window.partitionBy(load.key).orderBy(*map(col, load.order))
            rows = child.withColumn("__rn", F.row_number().over(w)).groupBy(F.col(load.key).alias("__k")).agg(F.array_sort(F.collect_list(F.struct("__rn", fields.alias("r")))).alias("__rows"))
            rows = rows.withColumn("__rows", F.transform("__rows", lambda x: x["r"]))
        else:
            rows = child.groupBy(F.col(load.key).alias("__k")).agg(F.collect_list(fields).alias("__rows"))
        joined = out.join(rows, F.col(load.parent_key) == F.col("__k"), "left")
        out = joined.withColumn(load.name, F.coalesce("__rows", F.array())).drop("__k", "__rows")
    return out


def hydrate(df: DataFrame, groups: dict[str, list[str]], keys: dict[str, str]) -> DataFrame:
    """Columns of joined sources as a struct each; an outer side without a key is NULL."""
    return df.select(*(F.when(F.col(keys[g]).isNotNull(), F.struct(*columns)).alias(g) for g, columns in groups.items()))


def many_to_many(left: DataFrame, through: DataFrame, right: DataFrame, *, left_key: str, left_ref: str, right_key: str, right_ref: str, name: str) -> DataFrame:
    """``left`` with the array of its ``right`` rows, by way of a junction table."""
    pairs = through.join(right, F.col(right_ref) == F.col(right_key)).select(F.col(left_ref).alias("__k"), F.struct(*right.columns).alias("__r"))
    rows = pairs.groupBy("__k").agg(F.array_sort(F.collect_list("__r")).alias(name))
    return left.join(rows, F.col(left_key) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, F.array()))


def link(through: DataFrame, rows: list[tuple]) -> DataFrame:
    """Pairs added to a junction table; those that are there stay single."""
    return through.union(through.sparkSession.createDataFrame(rows, through.schema)).distinct()


def unlink(through: DataFrame, column: str, value: Any, other: str | None = None, values: list | None = None) -> DataFrame:
    """Pairs of one side removed: all, or those with the given other side."""
    test = F.col(column) == value
    return through.where(~(test if values is None else test & F.col(other).isin(values)))


def to_dict(df: DataFrame, name: str = "json") -> DataFrame:
    """Rows as JSON objects."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def from_dict(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.select(F.from_json(column, schema).alias("r")).select("r.*")


def tagged_union(**branches: DataFrame) -> DataFrame:
    """Branches of one shape in one result, each row with its branch's name."""
    out = None
    for name, df in branches.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
