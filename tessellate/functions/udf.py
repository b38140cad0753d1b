"""User functions: scalar, aggregate, window and table functions and collations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..plans.expr import col


class Functions:
    """A session's registered functions, by name and group."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known, self.groups = spark, {}, {}

    def _add(self, name: str, function: Any, group: str) -> None:
        self.known[name] = function
        self.groups.setdefault(group, set()).add(name)

    def scalar(self, name: str, returns: str, deterministic: bool = True, group: str = "user") -> Callable:
        """Register a function of plain values; it runs over Arrow batches."""

        def register(f):
            def run(*columns: pd.Series) -> pd.Series:
                return pd.Series([f(*row) for row in zip(*columns)], dtype=object)

            from pyspark.sql.pandas.functions import PandasUDFType

            u = F.pandas_udf(run, returns, PandasUDFType.SCALAR)
            if not deterministic:
                u = u.asNondeterministic()
            self.spark.udf.register(name, u)
            self._add(name, u, group)
            return f

        return register

    def aggregate(self, name: str, returns: str, group: str = "user") -> Callable:
        """Register a class with ``step(*values)`` and ``finalize()``; rows come in no defined order."""

        def register(cls):
            def run(*columns: pd.Series) -> Any:
                state = cls()
                for row in zip(*columns):
                    state.step(*row)
                return state.finalize()

            from pyspark.sql.pandas.functions import PandasUDFType

            u = F.pandas_udf(run, returns, PandasUDFType.GROUPED_AGG)
            self.spark.udf.register(name, u)
            self._add(name, u, group)
            return cls

        return register

    def window(self, name: str, returns: str, group: str = "user") -> Callable:
        """Register a class with ``step`` and ``value`` (``inverse`` isn't needed): each frame is fed whole."""

        def register(cls):
            class Adapter(cls):
                def finalize(self):
                    return self.value() if hasattr(self, "value") else super().finalize()

            self.aggregate(name, returns, group)(Adapter)
            return cls

        return register

    def table(self, name: str, returns: str, group: str = "user") -> Callable:
        """Register a class with ``eval`` that yields rows."""

        def register(cls):
            u = udtf(cls, returnType=returns)
            self.spark.udtf.register(name, u)
            self._add(name, u, group)
            return u

        return register

    def collation(self, name: str, returns: str = "string", group: str = "user") -> Callable:
        """Register a sort key; ``sort_key(name, x)`` then orders by it."""
        return self.scalar(name, returns, True, group)

    def sort_key(self, name: str, x: Any) -> Column:
        return self.known[name](col(x))

    def unregister(self, name: str) -> bool:
        if self.known.pop(name, None) is None:
            return False
        for names in self.groups.values():
            names.discard(name)
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        return True

    def __getattr__(self, name: str) -> Callable[..., Column]:
        if name in self.__dict__.get("known", {}):
            return lambda *args: self.known[name](*map(col, args))
        raise AttributeError(name)


def register_library(functions: Functions) -> None:
    """The Python part of the function library, for use in SQL text."""
    from .text import changed_length, osa

    functions.scalar("damerau_levenshtein_dist", "int", group="string")(lambda a, b: None if a is None or b is None else osa(a, b))
    functions.scalar("str_dist", "int", group="string")(lambda a, b: None if a is None or b is None else changed_length(a, b))
