"""Aggregates that Spark lacks or defines otherwise, as expressions over built-in ones."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import Expr, Order, col


class Rollup:
    """``group_by(Rollup(a, b))``: subtotals of every prefix."""

    def __init__(self, *items: Any):
        self.items = items


def median(x: Any) -> Column:
    """The upper median: the k-th smallest with k = n // 2, not a mean of two."""
    values = F.array_sort(F.collect_list(col(x)))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def mode(x: Any) -> Column:
    """The most frequent value; of ties the smallest."""
    return F.mode(col(x), True)


def sum_key(x: Any) -> Column:
    """What to sort or rank sums of doubles by: exact values, so that the order rows come in changes nothing and equal sums tie.

    Each value is cut into digits of 30 bits, which are added as whole numbers (of up to 2^33 rows); carries make
    the sums comparable digit by digit. Only values of 2^60 or more and what lies below 2^-90 are added as doubles.
    """
    v = col(x).cast("double")
    rest, sums = F.when(F.abs(v) < 2.0**60, v), []
    for unit in (2.0**30, 1.0, 2.0**-30, 2.0**-60, 2.0**-90):
        digit = (rest / unit).cast("long")
        rest = rest - digit * unit
        sums.append(F.coalesce(F.sum(digit), F.lit(0)))
    digits, carry = [], F.lit(0)
    for total in reversed(sums[1:]):
        digits.insert(0, (total + carry).bitwiseAND(2**30 - 1))
        carry = F.shiftright(total + carry, 30)
    key = F.struct(F.coalesce(F.sum(F.when(F.abs(v) >= 2.0**60, v)), F.lit(0.0)), sums[0] + carry, *digits, F.coalesce(F.sum(rest), F.lit(0.0)))
    return F.when(F.count(v) > 0, key)


def value_range(x: Any) -> Column:
    return F.max(col(x)) - F.min(col(x))


def minrange(x: Any) -> Column:
    """The least gap between neighbours in order; one value: 0, none: NULL."""
    values = F.array_sort(F.collect_list(col(x)))
    gaps = F.transform(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda v, i: v - F.get(values, i))
    return F.when(F.size(values) == 1, F.min(col(x)) - F.min(col(x))).otherwise(F.array_min(gaps))


def avgrange(x: Any) -> Column:
    """The mean gap between neighbours; one value: 0, none: NULL."""
    n = F.count(col(x))
    return F.when(n == 1, F.lit(0.0)).otherwise(F.try_divide((F.max(col(x)) - F.min(col(x))).cast("double"), n - 1))


def stddev(x: Any) -> Column:
    """Of a sample; of one value or none 0."""
    return F.coalesce(F.nanvl(F.stddev_samp(col(x)), F.lit(0.0)), F.lit(0.0))


def seconds(x: Any) -> Column:
    return F.unix_micros(col(x).cast("timestamp")) / F.lit(1e6)


def mintdiff(x: Any) -> Column:
    """The least gap between times, in seconds; NULL for fewer than two."""
    values = F.array_sort(F.collect_list(seconds(x)))
    gaps = F.transform(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda v, i: v - F.get(values, i))
    return F.array_min(gaps)


def avgtdiff(x: Any) -> Column:
    return avgrange(seconds(x))


def duration(x: Any) -> Column:
    return F.max(seconds(x)) - F.min(seconds(x))


def weighted_avg(x: Any, w: Any) -> Column:
    return F.try_divide(F.sum(col(x) * col(w)), F.sum(col(w)))


def ordered_list(x: Any, *order: Any) -> Column:
    """Values of a group in the order given: ``array_agg(x ORDER BY ...)``, NULL values kept."""
    terms = [o if isinstance(o, Order) else Order(o) for o in order]
    fields = [col(t.expr).alias(f"o{k}") for k, t in enumerate(terms)]
    rows = F.collect_list(F.struct(*fields, col(x).alias("v")))

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for k, t in reversed(list(enumerate(terms))):
            x, y = a[f"o{k}"], b[f"o{k}"]
            first = (t.nulls or ("last" if t.descending else "first")) == "first"
            less, more = (1, -1) if t.descending else (-1, 1)
            out = (
                F.when(x.isNull() & y.isNull(), out).when(x.isNull(), -1 if first else 1).when(y.isNull(), 1 if first else -1)
                .when(x < y, less).when(x > y, more).otherwise(out)
            )
        return out

    return F.transform(F.array_sort(rows, compare), lambda r: r["v"])


def string_agg(x: Any, separator: str = ",", *order: Any) -> Column:
    """Concatenation of a group's values in order; NULL values are left out."""
    if not order:
        return F.array_join(F.array_sort(F.collect_list(col(x).cast("string"))), separator)
    return F.array_join(ordered_list(Expr(col(x).cast("string")), *order), separator)


def array_agg(x: Any) -> Column:
    """Values of a group, NULL ones included."""
    return F.transform(F.collect_list(F.struct(col(x).alias("v"))), lambda r: r["v"])


def json_group_array(x: Any) -> Column:
    return F.to_json(array_agg(x))


def json_group_object(k: Any, v: Any) -> Column:
    return F.to_json(F.map_from_entries(F.collect_list(F.struct(col(k), col(v)))))
