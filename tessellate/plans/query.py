"""Immutable queries that compile to DataFrames.

Every method returns a changed copy. ``df()`` builds the DataFrame; nothing runs before an action.
Clauses take effect in SQL's order whatever order they are called in.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import Distinct, Expr, Order, col, frame
from .schema import FieldRef, Model, ModelAlias, base, join_condition
from .windows import spread

OPERATORS = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
    "in": lambda a, b: a.in_(b), "is": lambda a, b: a.is_(b), "like": lambda a, b: a.like(b), "ilike": lambda a, b: a.ilike(b), "regexp": lambda a, b: a.regexp(b),
    "contains": lambda a, b: a.contains(b), "startswith": lambda a, b: a.startswith(b), "endswith": lambda a, b: a.endswith(b),
}


@dataclass(frozen=True)
class DQ:
    """Conditions of ``filter`` as an object: combined with ``&``, ``|`` and ``~``."""

    conditions: tuple = ()
    kind: str = "and"
    negated: bool = False

    def __init__(self, kind: str = "and", negated: bool = False, parts: tuple = (), **conditions):
        object.__setattr__(self, "conditions", tuple(parts) + tuple(conditions.items()))
        object.__setattr__(self, "kind", kind)
        object.__setattr__(self, "negated", negated)

    def __and__(self, other):
        return DQ("and", parts=(self, other))

    def __or__(self, other):
        return DQ("or", parts=(self, other))

    def __invert__(self):
        return DQ(self.kind, not self.negated, self.conditions)


@dataclass(frozen=True)
class Join:
    source: Any
    how: str
    on: Any
    left: Any
    near: Any = None


def listed(items) -> list:
    """Projection items: models and aliases stand for all their fields."""
    out = []
    for x in items:
        if isinstance(x, ModelAlias) or isinstance(x, type) and issubclass(x, Model):
            out.extend(x.columns())
        else:
            out.append(x)
    return out


def item_name(x: Any, k: int) -> str:
    return getattr(x, "name", None) or f"col{k}"


@dataclass(frozen=True)
class Query:
    db: Any
    items: tuple = ()
    source: Any = None
    joins: tuple = ()
    at: Any = None
    conditions: tuple = ()
    groups: tuple = ()
    havings: tuple = ()
    order: tuple = ()
    limit_: int | None = None
    offset_: int | None = None
    distinct_: Any = False
    alias_: str | None = None
    extra: tuple = ()
    default: bool = False
    sampled: Any = field(default=None)
    spread_: tuple = ()

    def _with(self, **changes) -> Query:
        return replace(self, **changes)

    def operand(self) -> Query:
        """As a value: the default projection of a model stands for its primary key."""
        if self.default and self.source is not None:
            return self.columns(FieldRef(base(self.source).primary_key(), self.source))
        return self

    # projection
    def columns(self, *items) -> Query:
        return self._with(items=tuple(listed(items)), default=False)

    select = columns

    def select_extend(self, *items) -> Query:
        return self._with(items=self.items + tuple(listed(items)))

    # sources
    def from_(self, *sources) -> Query:
        first, *others = sources
        return self._with(source=first, at=first, joins=tuple(Join(s, "cross", None, first) for s in others))

    def join(self, source, how: str = "inner", on: Any = None, src: Any = None, near: tuple | None = None) -> Query:
        """``near=(x, y, d)``: and the new source's ``x`` lies between ``y - d`` and ``y + d`` of what is joined already."""
        if near and (how.lower() != "inner" or not near[2] > 0):
            raise ValueError("near takes an inner join and a distance above zero")
        left = src if src is not None else self.at if self.at is not None else self.source
        return self._with(joins=(*self.joins, Join(source, how.lower(), on, left, near)), at=source)

    def join_from(self, left, source, how: str = "inner", on: Any = None) -> Query:
        return self.join(source, how, on, left)

    def left_outer_join(self, source, on: Any = None) -> Query:
        return self.join(source, "left", on)

    def ensure_join(self, left, right, how: str = "inner", on: Any = None) -> Query:
        if any(j.source is right for j in self.joins) or self.source is right:
            return self
        return self.join_from(left, right, how, on)

    def switch(self, source=None) -> Query:
        return self._with(at=self.source if source is None else source)

    # rows
    def where(self, *conditions) -> Query:
        return self._with(conditions=self.conditions + tuple(conditions))

    def orwhere(self, *conditions) -> Query:
        both = [c for c in (self._all(self.conditions), self._all(conditions)) if c is not None]
        out = both[0]
        for c in both[1:]:
            out = out | c
        return self._with(conditions=(out,))

    @staticmethod
    def _all(conditions) -> Column | None:
        out = None
        for c in conditions:
            out = col(c) if out is None else out & col(c)
        return out

    def filter(self, *objects, **conditions) -> Query:
        """Conditions by path: ``filter(customer__nation__n_name='X', o_totalprice__gte=3)`` adds the joins."""
        query, tests = self, []
        for o in [*objects, *([DQ(**conditions)] if conditions else [])]:
            query, test = query._dq(o)
            tests.append(test)
        return query.where(*tests)

    def _dq(self, dq: DQ) -> tuple[Query, Expr]:
        query, out = self, None
        for part in dq.conditions:
            if isinstance(part, DQ):
                query, test = query._dq(part)
            else:
                query, test = query._path(*part)
            out = test if out is None else (out & test if dq.kind == "and" else out | test)
        return query, ~out if dq.negated else out

    def _path(self, path: str, value) -> tuple[Query, Expr]:
        parts, query, at = path.split("__"), self, self.source
        op = OPERATORS[parts.pop()] if parts[-1] in OPERATORS and len(parts) > 1 else OPERATORS["eq"]
        for k, name in enumerate(parts):
            model = base(at)
            f = model._fields.get(name)
            if f is not None and k == len(parts) - 1:
                return query, op(FieldRef(f, at), value)
            if f is not None:
                query, at = query.ensure_join(at, f.target, "inner", FieldRef(f, at) == FieldRef(f.rel_field, f.target)), f.target
                continue
            from .schema import REGISTRY

            back = next((g for m in REGISTRY.values() for g in m.foreign_keys() if g.backref == name and g.target is model), None)
            if back is None:
                raise ValueError(f"{model._table} has no {name}")
            query, at = query.ensure_join(at, back.model, "inner", FieldRef(back, back.model) == FieldRef(back.rel_field, at)), back.model
        raise ValueError(f"{path} ends at a model")

    def group_by(self, *groups) -> Query:
        return self._with(groups=tuple(listed(groups)))

    def group_by_extend(self, *groups) -> Query:
        return self._with(groups=self.groups + tuple(listed(groups)))

    def having(self, *conditions) -> Query:
        return self._with(havings=self.havings + tuple(conditions))

    def order_by(self, *order) -> Query:
        return self._with(order=tuple(order))

    def order_by_extend(self, *order) -> Query:
        return self._with(order=self.order + tuple(order))

    def distinct(self, *on) -> Query:
        """All columns; ``distinct(col, ...)`` keeps each key's first row in order; ``distinct(False)`` turns it off."""
        return self._with(distinct_=(True if not on else on[0] if isinstance(on[0], bool) else on))

    def limit(self, n: int | None) -> Query:
        return self._with(limit_=n)

    def offset(self, n: int | None) -> Query:
        return self._with(offset_=n)

    def paginate(self, page: int, size: int = 20) -> Query:
        return self._with(limit_=size, offset_=(max(page, 1) - 1) * size)

    def spread(self, *keys) -> Query:
        """For windows over large tables: the rows of each key together, in tasks that stay small."""
        return self._with(spread_=keys)

    def alias(self, name: str) -> Query:
        return self._with(alias_=name)

    @property
    def c(self) -> Columns:
        """Columns of this query as a source."""
        return Columns(self.alias_ or "")

    def select_from(self, *items) -> Query:
        """A query over this one."""
        return Query(self.db, tuple(listed(items)), self.alias_ and self or self.alias("t"))

    # set operations: the tree of calls decides, not a precedence
    def union(self, other) -> Compound:
        return Compound(self.db, "union", self, other)

    def union_all(self, other) -> Compound:
        return Compound(self.db, "union_all", self, other)

    def intersect(self, other) -> Compound:
        return Compound(self.db, "intersect", self, other)

    def except_(self, other) -> Compound:
        return Compound(self.db, "except", self, other)

    __or__, __add__, __and__, __sub__ = union, union_all, intersect, except_

    def cte(self, name: str, columns: list[str] | None = None, materialized: bool | None = None) -> Query:
        """A named query. Materialised: kept after its first use, spilling to disk."""
        q = self
        df = q.df()
        if columns:
            df = df.toDF(*columns)
        if materialized:
            df = df.persist()
        return Query(self.db, (), df, alias_=name)

    # compilation
    def _frame(self, source) -> DataFrame:
        if isinstance(source, Query):
            name = source.alias_
            df = source._with(alias_=None).df()
            return df.alias(name) if name else df
        if isinstance(source, Compound):
            return source.df().alias(source.alias_) if source.alias_ else source.df()
        if isinstance(source, DataFrame):
            return source
        return self.db.table(source._table).alias(source._alias)

    def _joined(self) -> DataFrame:
        if self.source is None:
            return self.db.spark.range(1).select()
        df = self._frame(self.source)
        for j in self.joins:
            right = self._frame(j.source)
            kind = {"left_outer": "left", "right_outer": "right", "full_outer": "full", "semi": "left_semi", "anti": "left_anti"}.get(j.how, j.how)
            if kind in ("lateral", "left_lateral"):
                df = df.lateralJoin(right, None if j.on is None else col(j.on), "left" if kind == "left_lateral" else "inner")
            elif kind == "natural":
                shared = [c for c in df.columns if c in right.columns]
                df = df.join(right, shared, "inner")
            elif kind == "cross":
                if j.on is not None:
                    raise ValueError("a cross join takes no condition")
                df = df.crossJoin(right)
            elif isinstance(j.on, (list, tuple)) and all(isinstance(x, str) for x in j.on):
                df = df.join(right, list(j.on), kind)
            else:
                named = j.on if isinstance(j.on, str) else None
                on = join_condition(j.left, j.source, named) if j.on is None or named else j.on
                df = near_join(df, right, col(on), *j.near) if j.near else df.join(right, col(on), kind)
        return df

    def df(self) -> DataFrame:
        df = self._joined()
        if (test := self._all(self.conditions)) is not None:
            df = df.filter(test)
        if self.spread_:
            df = spread(df, *self.spread_)
        items = list(self.items)
        if not items and self.groups:
            items = list(self.groups)
        if not items:
            items = [Expr(F.col(f"`{c}`"), c) for c in df.columns] if len(set(df.columns)) == len(df.columns) else []
        if not items:
            # several sources without a projection: everything, clashing names numbered
            names = unique_names(df.columns)
            df = df.toDF(*names)
            items = [Expr(F.col(f"`{c}`"), c) for c in names]
        names = unique_names([item_name(x, k) for k, x in enumerate(items)])
        out = [col(x).alias(f"__c{k}") for k, x in enumerate(items)]
        hidden, order, descending = [], [], []
        for o in self.order:
            if isinstance(o, str):
                desc = o.startswith("-")
                k = names.index(o.lstrip("-+"))
                order.append((F.col(f"__c{k}").desc() if desc else F.col(f"__c{k}").asc()))
            else:
                o = o if isinstance(o, Order) else Order(o)
                name = f"__o{len(hidden)}"
                hidden.append((col(o.expr).alias(name), o.on(F.col(name)), name))
                descending.append(o.descending)
                order.append(hidden[-1][1])
        extra = [h[0] for h in hidden]
        if (having := self._all(self.havings)) is not None:
            extra.append(having.alias("__having"))
        keys = []
        if isinstance(self.distinct_, tuple):
            keys = [col(x).alias(f"__k{i}") for i, x in enumerate(self.distinct_)]
        if self.groups:
            grouped = self._grouped(df)
            df = grouped.agg(*out, *extra, *keys).select(*(F.col(f"__c{k}") for k in range(len(out))), *(F.col(h[2]) for h in hidden), *([F.col("__having")] if self.havings else []), *(F.col(f"__k{i}") for i in range(len(keys))))
        else:
            df = df.select(*out, *extra, *keys)
        if self.havings:
            df = df.filter("__having").drop("__having")
        visible = [f"__c{k}" for k in range(len(out))]
        if self.distinct_ is True:
            if hidden:  # of equal rows the first in each term of the order stands
                low = [(F.max if desc else F.min)(name).alias(name) for (_, _, name), desc in zip(hidden, descending)]
                df = df.groupBy(*visible).agg(*low)
            else:
                df = df.dropDuplicates(visible)
        elif keys:
            w = Window.partitionBy(*(F.col(f"__k{i}") for i in range(len(keys)))).orderBy(*(order or [F.lit(1)]))
            df = df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
        if order:
            df = df.orderBy(*order)
        if self.offset_:
            df = df.offset(self.offset_)
        if self.limit_ is not None:
            df = df.limit(self.limit_)
        return df.select(*(F.col(c).alias(n) for c, n in zip(visible, names)))

    def _grouped(self, df: DataFrame):
        from ..functions.aggregates import Rollup

        if len(self.groups) == 1 and isinstance(self.groups[0], Rollup):
            return df.rollup(*map(col, self.groups[0].items))
        return df.groupBy(*map(col, self.groups))

    # results
    def count(self, clear_limit: bool = False) -> int:
        q = self._with(order=()) if self.limit_ is None and self.offset_ is None else self
        return (q._with(limit_=None, offset_=None) if clear_limit else q).df().count()

    def exists(self) -> bool:
        return not self._with(order=(), offset_=None, limit_=1).df().isEmpty()

    def first(self, n: int = 1):
        rows = self.limit(n).df().take(n)
        return rows if n > 1 else (rows[0] if rows else None)

    def peek(self, n: int = 1):
        """As ``first``, without a limit in the plan."""
        rows = self.df().take(n)
        return rows if n > 1 else (rows[0] if rows else None)

    def get(self):
        row = self.first()
        if row is None:
            raise DoesNotExist("no row matches")
        return row

    def get_or_none(self):
        return self.first()

    def scalar(self):
        row = self.first()
        return None if row is None else row[0]

    def scalars(self):
        return (r[0] for r in self.iterator())

    def iterator(self):
        """Rows one by one, a partition at a time on the driver."""
        return self.df().toLocalIterator(prefetchPartitions=True)

    def dicts(self):
        return (r.asDict(recursive=True) for r in self.iterator())

    def tuples(self):
        return (tuple(r) for r in self.iterator())

    namedtuples = iterator

    def objects(self, make):
        return (make(**r.asDict()) for r in self.iterator())

    def __iter__(self):
        return self.iterator()

    def __getitem__(self, key):
        if isinstance(key, slice):
            start = key.start or 0
            if start < 0 or (key.stop or 0) < 0 or key.step not in (None, 1):
                raise ValueError("slices count from the start, one by one")
            ends = [max(n - start, 0) for n in (key.stop, self.limit_) if n is not None]
            return self._with(offset_=(self.offset_ or 0) + start, limit_=min(ends, default=None))
        if key < 0:
            raise ValueError("indexes count from the start")
        rows = [] if self.limit_ is not None and key >= self.limit_ else self._with(offset_=(self.offset_ or 0) + key, limit_=1).df().take(1)
        if not rows:
            raise IndexError(key)
        return rows[0]

    async def aexecute(self) -> list:
        """All rows, from a thread that the event loop doesn't wait in."""
        import asyncio

        return await asyncio.to_thread(lambda: self.df().collect())

    def for_update(self, *args, **options):
        raise NotSupported("row locks")

    def create_table(self, name: str) -> DataFrame:
        """CREATE TABLE AS: the result saved in the catalog."""
        self.df().write.mode("errorifexists").saveAsTable(name)
        return self.db.spark.table(name)

    def create_view(self, name: str) -> None:
        self.df().createOrReplaceTempView(name)

    def sql(self) -> str:
        """The compiled plan, as text."""
        return self.df()._jdf.queryExecution().optimizedPlan().toString()

    __str__ = sql
    __hash__ = object.__hash__


def near_join(left: DataFrame, right: DataFrame, on: Column, x: Any, y: Any, distance: float) -> DataFrame:
    """An inner join where ``x`` of the right lies between ``y - distance`` and ``y + distance`` of the left.

    Cells of twice the distance are a key beside those of ``on``: a row of the left goes to the two, at
    most three, cells its range touches, so that only neighbours are compared. Cells are dealt out by a
    shuffle, for a broadcast join would run in the tasks that read the right, however few they are.
    """
    x, low, high = col(x), col(y) - distance, col(y) + distance

    def cell(c: Column) -> Column:  # grows with its argument; NaN and what is beyond all cells share the outer ones
        return F.floor(F.least(F.greatest(c.cast("double") / (2.0 * distance), F.lit(-(2.0**52))), F.lit(2.0**52)))

    left = left.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    right = right.withColumn("__in", cell(x)).hint("merge")
    return left.join(right, on & (F.col("__cell") == F.col("__in")) & x.between(low, high), "inner").drop("__cell", "__in")


class DoesNotExist(LookupError):
    pass


class NotSupported(NotImplementedError):
    """What needs a database server: locks, transactions, triggers."""


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


class Columns:
    """``source.c.name``."""

    def __init__(self, alias: str):
        self._alias = alias

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__"):
            raise AttributeError(name)
        return Expr(F.col(f"`{self._alias}`.`{name}`" if self._alias else f"`{name}`"), name)


@dataclass(frozen=True)
class Compound(Query):
    """Two queries and a set operation; ordering and limits apply to the whole."""

    def __init__(self, db, op, left, right, **state):
        Query.__init__(self, db, **state)
        object.__setattr__(self, "op", op)
        object.__setattr__(self, "left", left)
        object.__setattr__(self, "right", right)

    def _with(self, **changes):
        state = {k: getattr(self, k) for k in self.__dataclass_fields__ if k != "db"}
        return Compound(self.db, self.op, self.left, self.right, **state | changes)

    def _joined(self) -> DataFrame:
        a, b = frame(self.left), frame(self.right)
        return {"union": lambda: a.union(b).distinct(), "union_all": lambda: a.union(b), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[self.op]()

    __hash__ = object.__hash__


class Table:
    """A table by name; ``t.c.x`` or, with declared columns, ``t.x``."""

    def __init__(self, name: str, columns: list[str] | None = None, alias: str | None = None, path: str | None = None):
        self._table, self._declared, self._alias = name, columns, alias or name
        if path:
            self._table = f"{path}.{name}"

    @property
    def c(self) -> Columns:
        if self._declared is not None:
            raise AttributeError("this table's columns are declared")
        return Columns(self._alias)

    def __getattr__(self, name):
        if name.startswith("_") or self._declared is None or name not in self._declared:
            raise AttributeError(name)
        return Expr(F.col(f"`{self._alias}`.`{name}`"), name)

    def alias(self, name: str) -> Table:
        return Table(self._table, self._declared, name)


__all__ = ["Query", "Compound", "DQ", "Table", "Columns", "DoesNotExist", "NotSupported", "Distinct"]
