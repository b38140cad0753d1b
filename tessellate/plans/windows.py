"""Window specifications, with the frames Spark lacks rewritten."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import col

CURRENT = 0


@dataclass(frozen=True)
class Preceding:
    n: Any = None


@dataclass(frozen=True)
class Following:
    n: Any = None


def preceding(n=None):
    return Preceding(n)


def following(n=None):
    return Following(n)


def bound(b, first: bool):
    if b is None:
        return Window.unboundedPreceding if first else Window.unboundedFollowing
    if isinstance(b, Preceding):
        return Window.unboundedPreceding if b.n is None else -b.n
    if isinstance(b, Following):
        return Window.unboundedFollowing if b.n is None else b.n
    return b


def listed(x) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


@dataclass(frozen=True)
class Spec:
    """A window: partition and order, and a frame ``rows``, ``range`` or ``groups`` with bounds.

    A start alone runs to the current row. Without bounds an ordered window is RANGE up to the
    current row and an unordered one the whole partition. ``extends`` fills in what isn't given.
    """

    partition_by: Any = None
    order_by: Any = None
    start: Any = None
    end: Any = None
    frame: str | None = None
    exclude: str | None = None
    extends: Spec | None = None

    def resolved(self) -> Spec:
        if self.extends is None:
            return self
        base = self.extends.resolved()
        return replace(self, partition_by=self.partition_by or base.partition_by, order_by=self.order_by or base.order_by, extends=None)

    def order(self) -> list[Column]:
        return [col(o) for o in listed(self.order_by)]

    def keys(self) -> list[Column]:
        return [col(p) for p in listed(self.partition_by)]

    def build(self):
        s = self.resolved()
        if s.end is not None and s.start is None:
            raise ValueError("a frame's end needs a start")
        w = Window.partitionBy(*s.keys())
        if s.order_by is not None:
            w = w.orderBy(*s.order())
        if s.start is None and s.frame is None:
            return w
        end = CURRENT if s.end is None and s.start is not None else s.end
        low, high = bound(s.start, True), bound(end, False)
        if (s.frame or "rows").lower() == "groups":
            raise ValueError("GROUPS frames take a query: use over_groups")
        return (w.rangeBetween if (s.frame or "rows").lower() == "range" else w.rowsBetween)(low, high)


def spec(partition_by=None, order_by=None, start=None, end=None, frame=None, exclude=None, extends=None) -> Spec:
    return Spec(partition_by, order_by, start, end, frame, exclude, extends)


def window(**given):
    """A Spark window specification."""
    return spec(**given).build()


#: Bytes of the files read for each task of a spread window.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame, *keys) -> DataFrame:
    """Rows of equal keys together, in tasks whose number grows with the tables read.

    A window sorts what its task holds; with a fixed number of shuffle partitions that grows with the
    input. Where Spark doesn't know a table's size, its own number of partitions stands.
    """
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(found.apply(k).stats().sizeInBytes()) for k in range(found.size()))
    if size >= 2**60:
        return df.repartition(*map(col, keys))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES)), *map(col, keys))


def over_groups(df: DataFrame, functions: dict[str, Any], *, partition_by, order_by, start, end=CURRENT) -> DataFrame:
    """Aggregates over GROUPS frames: peer groups are numbered, and a RANGE over the numbers is the frame."""
    keys, order = [col(p) for p in listed(partition_by)], [col(o) for o in listed(order_by)]
    ranked = (spread(df, *keys) if keys else df).withColumn("__peer", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy("__peer").rangeBetween(bound(start, True), bound(end, False))
    return ranked.withColumns({name: col(f).over(w) for name, f in functions.items()}).drop("__peer")


def excluding(kind: str, function: str, value, *, partition_by, order_by, start=None, end=None) -> Column:
    """SUM, COUNT or AVG over a ROWS frame with EXCLUDE CURRENT ROW, GROUP or TIES.

    The frame's sum and count, less those of the excluded rows. Peers are excluded only where they
    lie in the frame, so that GROUP and TIES are offered on unbounded and on RANGE-like frames.
    Every frame takes the same order, so that a task sorts its rows once.
    """
    keys, order = [col(p) for p in listed(partition_by)], [col(o) for o in listed(order_by)]
    v = col(value)
    whole = Window.partitionBy(*keys)
    bounded = start is not None or end is not None
    w = whole.orderBy(*order).rowsBetween(bound(start, True), bound(end, False)) if bounded or order else whole
    peers = whole.orderBy(*order).rangeBetween(0, 0)
    if kind.lower() in ("group", "ties") and bounded:
        raise ValueError("EXCLUDE GROUP and TIES take an unbounded frame")
    own, one = F.coalesce(v, v * 0), F.when(v.isNotNull(), 1).otherwise(0)
    zero = F.lit(0)
    total = F.coalesce(F.sum(v).over(w), zero)
    count = F.count(v).over(w)
    low, high = (bound(start, True), bound(end, False)) if bounded else (-1, 1)
    inside = low <= 0 <= high
    if kind.lower() == "current row":
        gone, gone_n = (F.coalesce(own, zero), one) if inside else (zero, zero)
    else:
        gone, gone_n = F.coalesce(F.sum(v).over(peers), zero), F.count(v).over(peers)
        if kind.lower() == "ties":
            gone, gone_n = gone - F.coalesce(own, zero), gone_n - one
    total, count = total - gone, count - gone_n
    return {"count": count, "sum": F.when(count > 0, total), "avg": F.try_divide(total, F.when(count > 0, count))}[function.lower()]
