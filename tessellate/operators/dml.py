"""Changes of tables as functions from DataFrame to DataFrame.

Plain files know no UPDATE, so a change gives the table after it; ``Change`` also has the affected
rows (RETURNING) and their number. Writing the result is the caller's, as a new snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.expr import col
from ..plans.schema import Model


@dataclass(frozen=True)
class Change:
    table: DataFrame
    affected: DataFrame

    def returning(self, *items: Any) -> DataFrame:
        return self.affected.select(*map(col, items)) if items else self.affected

    def rowcount(self) -> int:
        return self.affected.count()


def rows_frame(table: DataFrame, rows: list, fields: list[str] | None = None, model: type[Model] | None = None) -> DataFrame:
    """Dict or tuple rows in the table's columns: declared defaults, else NULL, fill what's missing."""
    defaults = {f.column_name: f for f in model._fields.values()} if model else {}
    full = []
    for r in rows:
        given = dict(r) if isinstance(r, dict) else dict(zip(fields or table.columns, r))
        if unknown := set(given) - set(table.columns):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        out = []
        for c in table.columns:
            v = given[c] if c in given else defaults[c].default_value() if c in defaults else None
            v = v() if callable(v) else v
            out.append(defaults[c].convert(v) if c in defaults else v)
        full.append(tuple(out))
    from pyspark.sql import types as T

    return table.sparkSession.createDataFrame(full, T.StructType([T.StructField(f.name, f.dataType, True) for f in table.schema]))


def insert_many(table: DataFrame, rows: list, fields: list[str] | None = None, model: type[Model] | None = None) -> Change:
    new = rows_frame(table, rows, fields, model)
    return Change(table.union(new), new)


def insert(table: DataFrame, model: type[Model] | None = None, **values: Any) -> Change:
    """One row; without values the defaults alone."""
    return insert_many(table, [values], model=model)


def insert_from(table: DataFrame, query: Any, fields: list[str] | None = None) -> Change:
    """INSERT ... SELECT: columns by position; others of the table are NULL."""
    source = query if isinstance(query, DataFrame) else query.df()
    names = fields or table.columns
    source = source.toDF(*names)
    new = source.select(*(F.col(c).cast(table.schema[c].dataType) if c in names else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns))
    return Change(table.union(new), new)


def insert_where(table: DataFrame, values: dict, condition: DataFrame) -> Change:
    """One row if ``condition`` has any."""
    new = rows_frame(table, [values]).join(condition.limit(1).select(F.lit(1).alias("__one")), how="cross").drop("__one")
    return Change(table.union(new), new)


def bulk_create(table: DataFrame, rows: list, key: str, batch: int | None = None) -> Change:
    """Rows with new keys, from the largest on."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    numbered = [{**r, key: top + k} for k, r in enumerate(rows, 1)]
    return insert_many(table, numbered)


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{a}.`{k}`") == F.col(f"{b}.`{k}`"))
    return out


def replace(table: DataFrame, new: DataFrame, keys: list[str]) -> Change:
    """REPLACE: rows of a conflicting key go, the new ones come."""
    kept = table.alias("o").join(new.alias("n"), _same("o", "n", keys), "left_anti")
    return Change(kept.unionByName(new), new)


def ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> Change:
    """ON CONFLICT IGNORE: new rows of a key that's there don't come."""
    fresh = new.alias("n").join(table.alias("o"), _same("o", "n", keys), "left_anti")
    return Change(table.unionByName(fresh), fresh)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], *, preserve: list[str] = (), update: dict[str, Any] | None = None, where: Any = None, conflict_where: Any = None) -> Change:
    """ON CONFLICT DO UPDATE. Expressions refer to ``old.x`` and, as EXCLUDED, ``new.x``.

    ``preserve`` takes these columns from the new row, ``update`` sets expressions, ``where`` limits
    which conflicts update (others stay as they are), ``conflict_where`` which old rows conflict.
    """
    old, fresh = table.withColumn("__old", F.lit(True)).alias("old"), new.withColumn("__new", F.lit(True)).alias("new")
    on = _same("old", "new", keys)
    if conflict_where is not None:
        on = on & col(conflict_where)
    both = old.join(fresh, on, "full")
    hit = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    if where is not None:
        hit = hit & F.coalesce(col(where), F.lit(False))
    out = []
    for c in table.columns:
        value = F.col(f"old.`{c}`")
        if c in preserve:
            value = F.when(hit, F.col(f"new.`{c}`")).otherwise(value)
        elif update and c in update:
            value = F.when(hit, col(update[c])).otherwise(value)
        out.append(F.when(F.col("__old").isNull(), F.col(f"new.`{c}`")).otherwise(value).alias(c))
    result = both.select(*out, (hit | F.col("__old").isNull()).alias("__changed"))
    return Change(result.drop("__changed"), result.where("__changed").drop("__changed"))


def update(table: DataFrame, values: dict[str, Any], where: Any = None) -> Change:
    """All expressions see the row as it was."""
    hit = F.lit(True) if where is None else F.coalesce(col(where), F.lit(False))
    marked = table.withColumn("__hit", hit)
    kinds = {f.name: f.dataType for f in table.schema}
    out = marked.select(*(F.when(F.col("__hit"), col(values[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns), "__hit")
    return Change(out.drop("__hit"), out.where("__hit").drop("__hit"))


def update_from(table: DataFrame, source: DataFrame, on: Any, values: dict[str, Any], name: str = "target", other: str = "source") -> Change:
    """UPDATE ... FROM: rows with a match (one each) are set from it."""
    joined = table.alias(name).join(source.withColumn("__hit", F.lit(True)).alias(other), col(on), "left")
    kinds = {f.name: f.dataType for f in table.schema}
    hit = F.col("__hit").isNotNull()
    out = joined.select(*((F.when(hit, col(values[c]).cast(kinds[c])).otherwise(F.col(f"{name}.`{c}`")) if c in values else F.col(f"{name}.`{c}`")).alias(c) for c in table.columns), hit.alias("__was"))
    return Change(out.drop("__was"), out.where("__was").drop("__was"))


def bulk_update(table: DataFrame, rows: list[dict], key: str, fields: list[str]) -> Change:
    """Each row's fields set by key."""
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    new = table.sparkSession.createDataFrame([(r[key], *(r[f] for f in fields)) for r in rows], ", ".join(f"`{c}` {kinds[c]}" for c in (key, *fields)))
    return update_from(table, new, F.col(f"target.`{key}`") == F.col(f"source.`{key}`"), {f: F.col(f"source.`{f}`") for f in fields})


def delete(table: DataFrame, where: Any = None) -> Change:
    """A row whose condition is NULL stays."""
    hit = F.lit(True) if where is None else F.coalesce(col(where), F.lit(False))
    return Change(table.where(~hit), table.where(hit))


def delete_in(table: DataFrame, column: str, query: DataFrame) -> Change:
    """Rows whose column is among a query's values."""
    keys = query.toDF("__k").distinct()
    return Change(table.join(keys, F.col(column) == F.col("__k"), "left_anti"), table.join(keys, F.col(column) == F.col("__k"), "left_semi"))


def delete_recursive(tables: dict[str, DataFrame], model: type[Model], where: Any) -> dict[str, DataFrame]:
    """Rows of a model and of all that refer to them, level by level; NULL references stay."""
    from ..plans.schema import dependents

    gone = {model._table: delete(tables[model._table], where).affected}
    out = {**tables, model._table: delete(tables[model._table], where).table}
    for m, f in dependents(model):
        if m._table not in tables or f.target._table not in gone:
            continue
        lost = gone[f.target._table].select(F.col(f.rel_field.column_name).alias("__k")).distinct()
        on = F.col(f.column_name) == F.col("__k")
        now = tables[m._table].join(lost, on, "left_semi")
        gone[m._table] = now if m._table not in gone else gone[m._table].unionByName(now).distinct()
        out[m._table] = out[m._table].join(lost, on, "left_anti")
    return out


def limited(table: DataFrame, order: list[Any], n: int, change, key: str | None = None, **options) -> Change:
    """UPDATE or DELETE of the first ``n`` rows in order only.

    With a unique ``key`` the first rows are a top-n of each task, merged; without one the whole
    table is numbered in one task.
    """
    if key:
        top = table.orderBy(*map(col, order)).limit(n).select(F.col(key).alias("__k"))
        marked = table.join(top.withColumn("__hit", F.lit(True)), F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k").withColumnRenamed("__hit", "__first")
        out = change(marked, where=F.col("__first").isNotNull(), **options)
        return Change(out.table.drop("__first"), out.affected.drop("__first"))
    ranked = table.withColumn("__rn", F.row_number().over(Window.orderBy(*map(col, order))))
    out = change(ranked, where=F.col("__rn") <= n, **options)
    return Change(out.table.drop("__rn"), out.affected.drop("__rn"))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """A change log: ``key, action, changes``, the changed columns' old and new values as JSON."""
    a, b = before.withColumn("__a", F.lit(True)).alias("a"), after.withColumn("__b", F.lit(True)).alias("b")
    both = a.join(b, F.col(f"a.`{key}`") == F.col(f"b.`{key}`"), "full")
    action = F.when(F.col("__a").isNull(), "INSERT").when(F.col("__b").isNull(), "DELETE").otherwise("UPDATE")
    diffs = []
    for c in before.columns:
        old, new = F.col(f"a.`{c}`").cast("string"), F.col(f"b.`{c}`").cast("string")
        diffs.append(F.when(~old.eqNullSafe(new), F.struct(F.lit(c).alias("k"), F.array(old, new).alias("v"))))
    listed = F.filter(F.array(*diffs), lambda d: d.isNotNull())
    out = both.select(F.coalesce(f"a.`{key}`", f"b.`{key}`").alias(key), action.alias("action"), listed.alias("d"))
    return out.where(F.size("d") > 0).select(key, "action", F.to_json(F.map_from_entries("d")).alias("changes"))


def violations(table: DataFrame, *, unique: list[list[str]] = (), checks: dict[str, Any] | None = None, references: dict[str, tuple[DataFrame, str]] | None = None, not_null: list[str] = ()) -> DataFrame:
    """``rule, n`` for each broken rule: uniqueness, CHECK (NULL passes), foreign keys, NOT NULL."""
    parts = []
    for keys in unique:
        dup = table.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(dup.agg(F.count("*").alias("n")).select(F.lit(f"unique {','.join(keys)}").alias("rule"), "n"))
    for name, test in (checks or {}).items():
        parts.append(table.where(~col(test)).agg(F.count("*").alias("n")).select(F.lit(f"check {name}").alias("rule"), "n"))
    for c, (other, k) in (references or {}).items():
        lost = table.where(F.col(c).isNotNull()).join(other.select(F.col(k).alias("__k")), F.col(c) == F.col("__k"), "left_anti")
        parts.append(lost.agg(F.count("*").alias("n")).select(F.lit(f"foreign key {c}").alias("rule"), "n"))
    for c in not_null:
        parts.append(table.where(F.col(c).isNull()).agg(F.count("*").alias("n")).select(F.lit(f"not null {c}").alias("rule"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


class KeyValue:
    """A mapping over a two-column DataFrame; each change gives a new snapshot inside."""

    def __init__(self, spark, rows: dict | None = None, value: str = "string"):
        self.df = spark.createDataFrame(list((rows or {}).items()), f"key string, value {value}")

    def __getitem__(self, key):
        if isinstance(key, (str, list)):
            found = self.df.where(F.col("key").isin(key if isinstance(key, list) else [key])).collect()
            if isinstance(key, list):
                return {r.key: r.value for r in found}
            if not found:
                raise KeyError(key)
            return found[0].value
        return [r.value for r in self.df.where(col(key)).orderBy("key").collect()]

    def __setitem__(self, key, value):
        if isinstance(key, str):
            self.update(**{key: value})
        else:
            self.df = update(self.df, {"value": value}, key).table

    def update(self, **items):
        new = self.df.sparkSession.createDataFrame(list(items.items()), self.df.schema)
        self.df = replace(self.df, new, ["key"]).table

    def get(self, key, default=None):
        try:
            return self[key]
        except KeyError:
            return default

    def pop(self, key):
        value = self[key]
        self.df = delete(self.df, F.col("key") == key).table
        return value

    def __delitem__(self, key):
        self.df = delete(self.df, F.col("key") == key if isinstance(key, str) else key).table

    def __contains__(self, key):
        return not self.df.where(F.col("key") == key).isEmpty()

    def __len__(self):
        return self.df.count()

    def keys(self):
        return [r.key for r in self.df.orderBy("key").collect()]
