"""Parts, truncation, epochs and intervals of dates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import Expr, col

PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


def extract(part: str, value: Any) -> Expr:
    """A part as an integer, seconds whole."""
    part = part.lower()
    return Expr(PARTS[part](col(value)) if part in PARTS else F.extract(F.lit(part), col(value)))


def truncate(value: Any, part: str) -> Column:
    """The beginning of the year, month, day, hour, minute or second."""
    if part.lower() not in PARTS:
        raise ValueError(f"can't truncate to {part}")
    return F.date_trunc(part, col(value)).cast("timestamp_ntz")


def to_timestamp(value: Any) -> Expr:
    """Whole seconds since the epoch."""
    return Expr(F.unix_seconds(col(value).cast("timestamp")))


def from_timestamp(value: Any, resolution: int = 1) -> Expr:
    """The time of a number of ticks, ``resolution`` to the second."""
    return Expr(F.timestamp_micros((col(value) * (1_000_000 // resolution)).cast("long")).cast("timestamp_ntz"))


def epoch_part(part: str, value: Any, resolution: int = 1) -> Expr:
    """A part of a time kept as ticks."""
    return extract(part, from_timestamp(value, resolution))


def interval(text: str) -> Expr:
    """``'30 minutes'`` and the like."""
    return Expr(F.expr(f"INTERVAL {text}" if not text.upper().startswith("INTERVAL") else text))


def add_interval(value: Any, n: Any, unit: str) -> Expr:
    """``value + n units``, n any expression."""
    unit = unit.lower().rstrip("s") + "s"
    if unit in ("years", "months"):
        months = col(n) * (12 if unit == "years" else 1)
        return Expr(col(value) + F.make_ym_interval(F.lit(0), months.cast("int")))
    return Expr(col(value) + F.make_dt_interval(**{unit.replace("minutes", "mins").replace("seconds", "secs"): col(n)}))


STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS"}


def strftime(pattern: str, value: Any) -> Expr:
    if pattern == "%s":
        return Expr(to_timestamp(value).column.cast("string"))
    for k, v in STRFTIME.items():
        pattern = pattern.replace(k, v)
    return Expr(F.date_format(col(value), pattern))
