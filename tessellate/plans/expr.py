"""Expressions: a thin layer over Spark columns that fixes the engine's semantics.

Wherever a plain column method already means the right thing it is used as it is. What differs:
comparison with ``None``, empty lists, case-insensitive search that escapes its wildcards,
NULL-yielding division, subqueries as operands, and operators for text (``%`` LIKE, ``**`` ILIKE).
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame(value: Any) -> DataFrame | None:
    """The DataFrame of a query or DataFrame operand, else None."""
    if isinstance(value, DataFrame):
        return value
    value = value.operand() if hasattr(value, "operand") else value
    make = getattr(value, "df", None)
    return make() if callable(make) else None


def col(value: Any) -> Column:
    """A column from an expression, a column, a query of one value, or a literal."""
    if isinstance(value, (Expr, Order)):
        return value.column
    if isinstance(value, Column):
        return value
    if (df := frame(value)) is not None:
        return df.scalar()
    if isinstance(value, (list, tuple, set)):
        return F.array(*map(col, value))
    return F.lit(value)


def escaped(text: str) -> str:
    """``text`` with the wildcards of LIKE taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


class Order:
    """A sort term: an expression, its direction and the place of its nulls (by default: ascending first)."""

    def __init__(self, expr: Any, descending: bool = False, nulls: str | None = None):
        self.expr, self.descending, self.nulls = expr, descending, nulls and nulls.lower()

    def on(self, column: Column) -> Column:
        name = ("desc" if self.descending else "asc") + (f"_nulls_{self.nulls}" if self.nulls else "")
        return getattr(column, name)()

    @property
    def column(self) -> Column:
        return self.on(col(self.expr))


class Expr:
    """A column with the engine's operators; ``name`` is what a projection calls it."""

    __slots__ = ("column", "name", "kind")
    __hash__ = object.__hash__

    def __init__(self, column: Column, name: str | None = None, kind: Any = None):
        self.column, self.name, self.kind = column, name, kind

    def of(self, value: Any) -> Column:
        """An operand, converted to this expression's declared type if it's a plain value."""
        if self.kind is not None and not isinstance(value, (Expr, Column)) and frame(value) is None:
            return self.kind.literal(value)
        return col(value)

    # comparison
    def __eq__(self, other):  # type: ignore[override]
        return Expr(self.column.isNull() if other is None else self.column == self.of(other))

    def __ne__(self, other):  # type: ignore[override]
        return Expr(self.column.isNotNull() if other is None else self.column != self.of(other))

    def __lt__(self, other):
        return Expr(self.column < self.of(other))

    def __le__(self, other):
        return Expr(self.column <= self.of(other))

    def __gt__(self, other):
        return Expr(self.column > self.of(other))

    def __ge__(self, other):
        return Expr(self.column >= self.of(other))

    def is_(self, other):
        """IS: null-safe equality."""
        return Expr(self.column.eqNullSafe(self.of(other)))

    __rshift__ = is_

    def is_not(self, other):
        return Expr(~self.column.eqNullSafe(self.of(other)))

    def is_null(self, yes: bool = True):
        return Expr(self.column.isNull() if yes else self.column.isNotNull())

    def between(self, low, high):
        return Expr(self.column.between(self.of(low), self.of(high)))

    def __getitem__(self, key):
        if isinstance(key, slice):
            if key.start is None or key.stop is None:
                raise ValueError("a range needs both ends")
            return self.between(key.start, key.stop)
        return self == key

    def in_(self, values):
        """IN a list (empty: never), a query or a DataFrame of one column."""
        if (df := frame(values)) is not None:
            return Expr(self.column.isin(df))
        values = list(values)
        return Expr(self.column.isin([self.of(v) for v in values]) if values else F.lit(False))

    __lshift__ = in_

    def not_in(self, values):
        """NOT IN: always for an empty list; a NULL among the values makes it never true."""
        if frame(values) is None and not (values := list(values)):
            return Expr(F.lit(True))
        return Expr(~self.in_(values).column)

    # logic
    def __and__(self, other):
        return Expr(self.column & col(other))

    def __or__(self, other):
        return Expr(self.column | col(other))

    def __rand__(self, other):
        return Expr(col(other) & self.column)

    def __ror__(self, other):
        return Expr(col(other) | self.column)

    def __invert__(self):
        return Expr(~self.column)

    # arithmetic
    def __add__(self, other):
        return Expr(F.concat(self.column, col(other)) if isinstance(other, str) else self.column + col(other))

    def __radd__(self, other):
        return Expr(F.concat(col(other), self.column) if isinstance(other, str) else col(other) + self.column)

    def __sub__(self, other):
        return Expr(self.column - col(other))

    def __rsub__(self, other):
        return Expr(col(other) - self.column)

    def __mul__(self, other):
        return Expr(self.column * col(other))

    __rmul__ = __mul__

    def __truediv__(self, other):
        """Fractional division; by zero it gives NULL."""
        return Expr(F.try_divide(self.column, col(other)))

    def __rtruediv__(self, other):
        return Expr(F.try_divide(col(other), self.column))

    def idiv(self, other):
        """Whole part of a quotient."""
        return Expr(F.try_divide(self.column - F.try_mod(self.column, col(other)), col(other)).cast("long"))

    def mod(self, other):
        return Expr(F.try_mod(self.column, col(other)))

    def bin_and(self, other):
        return Expr(self.column.bitwiseAND(col(other)))

    def bin_or(self, other):
        return Expr(self.column.bitwiseOR(col(other)))

    def __xor__(self, other):
        return Expr(self.column.bitwiseXOR(col(other)))

    def op(self, operator: str, other):
        """Any binary operator or function of SQL by its name."""
        known = {"%": self.mod, "&": self.bin_and, "|": self.bin_or, "#": self.__xor__, "||": self.concat, "<=>": self.is_}
        return known[operator](other) if operator in known else Expr(F.call_function(operator, self.column, col(other)))

    # text
    def like(self, pattern):
        return Expr(self.column.like(pattern) if isinstance(pattern, str) else F.like(self.column, col(pattern)))

    __mod__ = like

    def ilike(self, pattern):
        return Expr(self.column.ilike(pattern) if isinstance(pattern, str) else F.ilike(self.column, col(pattern)))

    __pow__ = ilike

    def _search(self, before: str, text, after: str):
        if isinstance(text, str):
            return Expr(self.column.ilike(before + escaped(text) + after))
        return Expr(F.ilike(self.column, F.concat(F.lit(before), col(text), F.lit(after))))

    def contains(self, text):
        """Case-insensitive; wildcards of a literal are taken literally."""
        return self._search("%", text, "%")

    def startswith(self, text):
        return self._search("", text, "%")

    def endswith(self, text):
        return self._search("%", text, "")

    def regexp(self, pattern: str):
        """Unanchored search; NULL input gives false."""
        return Expr(F.coalesce(self.column.rlike(pattern), F.lit(False)))

    def iregexp(self, pattern: str):
        return self.regexp("(?i)" + pattern)

    def concat(self, other):
        return Expr(F.concat(self.column, col(other)))

    # shape
    def cast(self, kind: str, lenient: bool = False):
        return Expr(self.column.try_cast(kind) if lenient else self.column.cast(kind), self.name)

    def collate(self, name: str):
        return Expr(F.collate(self.column, {"NOCASE": "UTF8_LCASE", "BINARY": "UTF8_BINARY"}.get(name.upper(), name)), self.name)

    def alias(self, name: str | None):
        return Expr(self.column, name, self.kind)

    def asc(self, nulls: str | None = None):
        return Order(self, False, nulls)

    def desc(self, nulls: str | None = None):
        return Order(self, True, nulls)

    __pos__ = asc
    __neg__ = desc

    def distinct(self):
        return Distinct(self.column)

    def over(self, window=None, **spec):
        from .windows import window as build

        return Expr(self.column.over(window if window is not None else build(**spec)), self.name)

    def outer(self):
        """The same column of the enclosing query, inside a correlated subquery."""
        return Expr(self.column.outer(), self.name, self.kind)

    # parts of dates
    def _part(self, f):
        return Expr(f(self.column))

    @property
    def year(self):
        return self._part(F.year)

    @property
    def month(self):
        return self._part(F.month)

    @property
    def day(self):
        return self._part(F.dayofmonth)

    @property
    def hour(self):
        return self._part(F.hour)

    @property
    def minute(self):
        return self._part(F.minute)

    @property
    def second(self):
        return self._part(F.second)

    def truncate(self, part: str):
        from ..functions.dates import truncate

        return Expr(truncate(self.column, part))

    def __repr__(self):
        return f"Expr({self.name or self.column})"


class Distinct(Expr):
    """The operand of an aggregate over distinct values."""


class Functions:
    """``fn.anything(...)``: engine functions first, else Spark's function of that name."""

    def __getattr__(self, name: str):
        from ..functions import catalogue

        known = catalogue.FUNCTIONS.get(name.lower())

        def call(*args, distinct: bool = False):
            distinct = distinct or any(isinstance(a, Distinct) for a in args)
            if distinct and name.lower() in catalogue.DISTINCT:
                return Aggregate(catalogue.DISTINCT[name.lower()](*map(col, args)))
            if known:
                return Aggregate(known(*(a if known in catalogue.RAW else col(a) for a in args)))
            return Aggregate(F.call_function(name.lower(), *map(col, args)))

        def filtered(*args, distinct: bool = False):
            out = call(*args, distinct=distinct)
            out.again = lambda p: call(*(F.when(col(p), col(a)) for a in (args or (1,))), distinct=distinct)
            return out

        return filtered


class Aggregate(Expr):
    """A function call; ``filter`` keeps the rows of a predicate, also under OVER."""

    __slots__ = ("again",)

    def filter(self, *predicates):
        p = col(predicates[0])
        for other in predicates[1:]:
            p = p & col(other)
        return self.again(p)


fn = Functions()


def value(x: Any) -> Expr:
    return Expr(col(x))


def sql(text: str) -> Expr:
    """A piece of SQL."""
    return Expr(F.expr(text))


def case(subject: Any, branches: Iterable[tuple], default: Any = None) -> Expr:
    """Searched CASE (subject None) or simple CASE, whose NULL subject matches nothing."""
    out = None
    for condition, result in branches:
        test = col(condition) if subject is None else col(subject) == col(condition)
        out = F.when(test, col(result)) if out is None else out.when(test, col(result))
    if out is None:
        return value(default)
    return Expr(out if default is None else out.otherwise(col(default)))


class Row(Expr):
    """A row value: compared field by field, or tested against a query of as many columns."""

    def __init__(self, *items):
        self.items = [col(i) for i in items]
        super().__init__(F.struct(*(c.alias(f"f{k}") for k, c in enumerate(self.items))))

    __slots__ = ("items",)
    __hash__ = object.__hash__

    def of(self, other) -> Column:
        return Row(*other).column if isinstance(other, (tuple, list)) else col(other)

    def in_(self, values):
        if (df := frame(values)) is not None:
            return Expr(self.column.isin(df))
        return super().in_(values)


def exists(query) -> Expr:
    return Expr(frame(query).exists())


def any_of(left, op: str, query) -> Expr:
    """``left op ANY (query)`` for an ordering or equality, by the query's extreme."""
    df = frame(query)
    c = F.col(f"`{df.columns[0]}`")
    if op == "=":
        return Expr(col(left).isin(df))
    extreme = df.select((F.min if op in (">", ">=") else F.max)(c)).scalar()
    return Expr({">": col(left).__gt__, ">=": col(left).__ge__, "<": col(left).__lt__, "<=": col(left).__le__}[op](extreme))


def all_of(left, op: str, query) -> Expr:
    """``left op ALL (query)``: true over an empty query."""
    df = frame(query)
    c = F.col(f"`{df.columns[0]}`")
    extreme = df.select((F.max if op in (">", ">=") else F.min)(c)).scalar()
    test = {">": col(left).__gt__, ">=": col(left).__ge__, "<": col(left).__lt__, "<=": col(left).__le__}[op](extreme)
    return Expr(test | extreme.isNull())
