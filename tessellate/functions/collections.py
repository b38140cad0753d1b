"""Arrays and maps."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import col


def item(a: Any, i: int) -> Column:
    """Zero-based; from the end if negative; NULL outside."""
    return F.get(col(a), i) if i >= 0 else F.try_element_at(col(a), F.lit(i))


def part(a: Any, start: int, stop: int) -> Column:
    """Zero-based, the stop excluded."""
    return F.slice(col(a), start + 1, max(stop - start, 0))


def contains(a: Any, *items: Any) -> Column:
    """All of the items stand in the array."""
    return F.size(F.array_except(F.array(*map(col, items)), col(a))) == 0


def contained_by(a: Any, *items: Any) -> Column:
    return F.size(F.array_except(col(a), F.array(*map(col, items)))) == 0


def contains_any(a: Any, *items: Any) -> Column:
    return F.coalesce(F.arrays_overlap(col(a), F.array(*map(col, items))), F.lit(False))


def upper(a: Any) -> Column:
    return F.when(F.size(col(a)) > 0, F.size(col(a)))


def each(a: Any, convert) -> Column:
    return F.transform(col(a), convert)


# maps


def key(m: Any, k: str) -> Column:
    return F.try_element_at(col(m), F.lit(k))


def keys(m: Any) -> Column:
    return F.map_keys(col(m))


def values(m: Any) -> Column:
    return F.map_values(col(m))


def items(m: Any) -> Column:
    return F.transform(F.map_entries(col(m)), lambda e: F.array(e["key"], e["value"]))


def subset(m: Any, *ks: str) -> Column:
    return F.map_filter(col(m), lambda k, v: k.isin(*ks))


def exists(m: Any, k: str) -> Column:
    return F.map_contains_key(col(m), k)


def defined(m: Any, k: str) -> Column:
    """The key is there and its value isn't NULL."""
    return F.coalesce(key(m, k).isNotNull(), F.lit(False))


def has_all(m: Any, *ks: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, ks)), F.map_keys(col(m)))) == 0


def has_any(m: Any, *ks: str) -> Column:
    return F.arrays_overlap(F.map_keys(col(m)), F.array(*map(F.lit, ks)))


def contains_map(m: Any, other: dict[str, str]) -> Column:
    out = F.lit(True)
    for k, v in other.items():
        out = out & F.coalesce(key(m, k) == v, F.lit(False))
    return out


def merged(m: Any, other: dict[str, str]) -> Column:
    """The other's values win."""
    keep = F.map_filter(col(m), lambda k, v: ~k.isin(*other)) if other else col(m)
    return F.map_concat(keep, F.create_map(*(F.lit(x) for kv in other.items() for x in kv))) if other else keep


def without(m: Any, *ks: str) -> Column:
    return F.map_filter(col(m), lambda k, v: ~k.isin(*ks))
