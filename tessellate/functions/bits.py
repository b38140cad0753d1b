"""Unbounded bitmaps in binary columns: bit n is bit n % 8 of byte n // 8."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import col


def _change(x: Any, n: int, f) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            data = bytearray(v or b"")
            if len(data) <= n // 8:
                data.extend(b"\0" * (n // 8 + 1 - len(data)))
            data[n // 8] = f(data[n // 8], 1 << n % 8)
            return bytes(data)

        return s.map(one, na_action=None)

    return run(col(x))


def set_bit(x: Any, n: int) -> Column:
    return _change(x, n, lambda byte, bit: byte | bit)


def clear_bit(x: Any, n: int) -> Column:
    return _change(x, n, lambda byte, bit: byte & ~bit & 255)


def toggle_bit(x: Any, n: int) -> Column:
    return _change(x, n, lambda byte, bit: byte ^ bit)


def is_set(x: Any, n: int) -> Column:
    """Whether the bit is set; beyond the end it isn't."""
    byte = F.conv(F.hex(F.substring(col(x), n // 8 + 1, 1)), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(1 << n % 8) != 0, F.lit(False))


def _both(a: Any, b: Any, f) -> Column:
    """The shorter one counts as followed by zeros."""

    @F.pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            if p is None or q is None:
                return None
            n = max(len(p), len(q))
            return f(np.frombuffer(bytes(p).ljust(n, b"\0"), np.uint8), np.frombuffer(bytes(q).ljust(n, b"\0"), np.uint8)).tobytes()

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype=object)

    return run(col(a), col(b))


def and_(a: Any, b: Any) -> Column:
    return _both(a, b, np.bitwise_and)


def or_(a: Any, b: Any) -> Column:
    return _both(a, b, np.bitwise_or)


def xor(a: Any, b: Any) -> Column:
    return _both(a, b, np.bitwise_xor)
