"""The scalar function library: text, numbers and durations, as built-in expressions where possible."""

from __future__ import annotations

import difflib
import os
import re
import zlib
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import col


def if_then_else(condition: Any, yes: Any, no: Any, kind: str = "boolean") -> Column:
    """By truth: 0, the empty string and NULL are false."""
    c = col(condition)
    truth = {"boolean": c, "number": c != 0, "string": c != ""}[kind]
    return F.when(truth, col(yes)).otherwise(col(no))


def strip_tz(x: Any) -> Column:
    """A blank for T; the rest from ``+``, or from a dash if the first dash comes after place 13."""
    s = F.replace(col(x), F.lit("T"), F.lit(" "))
    plus, dash = F.instr(s, "+"), F.instr(s, "-")
    return F.when(plus > 0, F.substring(s, F.lit(1), plus - 1)).when(dash > 14, F.substring(s, F.lit(1), dash - 1)).otherwise(s)


UNITS = (("year", 365 * 86400), ("month", 30 * 86400), ("week", 7 * 86400), ("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1))


def human_delta(seconds: Any, glue: str = ", ", largest: str = "year") -> Column:
    """``2 hours, 5 minutes, 30 seconds``; nothing: ``0 seconds``. What is longer is counted in the ``largest`` unit."""
    rest, parts = F.abs(col(seconds).cast("long")), []
    for name, size in UNITS[[name for name, _ in UNITS].index(largest) :]:
        n = F.call_function("div", rest, F.lit(size))
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))))
        rest = rest % size
    text = F.concat_ws(glue, *parts)
    return F.when(col(seconds).isNotNull(), F.when(text == "", F.lit("0 seconds")).otherwise(text))


def file_ext(path: Any) -> Column:
    """The last dot of a name and what follows; a leading dot is part of the name."""
    return F.regexp_extract(F.regexp_extract(col(path), r"([^/]*)$", 1), r"^\.*[^.].*?(\.[^.]*)$", 1)


def hostname(url: Any) -> Column:
    """The authority of a URL, '' without a scheme; port and user stay."""
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def sqrt(x: Any) -> Column:
    return F.when(col(x) >= 0, F.sqrt(col(x)))


def tonumber(x: Any) -> Column:
    """A double where the whole text is a number, else NULL."""
    s = col(x).cast("string")
    return F.when(s.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(s).try_cast("double"))


def substr_count(x: Any, part: str) -> Column:
    """Occurrences that don't overlap; 0 for NULL or nothing to look for."""
    if not part:
        return F.lit(0)
    s = F.coalesce(col(x), F.lit(""))
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def strip_chars(x: Any, chars: str) -> Column:
    return F.btrim(col(x), F.lit(chars))


def levenshtein_dist(a: Any, b: Any) -> Column:
    return F.levenshtein(col(a), col(b))


def osa(a: str, b: str) -> int:
    """Edits with swaps of neighbours, each place edited once."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, before[j - 1] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def changed_length(a: str, b: str) -> int:
    """The lengths of the differing blocks of two texts, the longer side of each."""
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return sum(max(i2 - i1, j2 - j1) for kind, i1, i2, j1, j2 in blocks if kind != "equal")


def _pairwise(function, kind):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)], dtype=object)

    return run


def damerau_levenshtein_dist(a: Any, b: Any) -> Column:
    return _pairwise(osa, "int")(col(a), col(b))


def str_dist(a: Any, b: Any) -> Column:
    return _pairwise(changed_length, "int")(col(a), col(b))


def gzip(x: Any, level: int = 9) -> Column:
    """zlib-compressed bytes."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else zlib.compress(v.encode() if isinstance(v, str) else bytes(v), level))

    return run(col(x))


def gunzip(x: Any) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else zlib.decompress(bytes(v)))

    return run(col(x))


def random_range(low: float, high: float, seed: int = 0) -> Column:
    return F.floor(F.rand(seed) * (high - low) + low)


def gauss(mean: float, deviation: float, seed: int = 0) -> Column:
    return F.randn(seed) * deviation + mean


def title_case(x: Any) -> Column:
    return F.initcap(col(x))


class Settings:
    """Toggles and settings of a session: on the driver only, as executors share no state."""

    def __init__(self):
        self.values: dict[str, Any] = {}
        self.toggles: dict[str, bool] = {}

    def toggle(self, key: str, on: bool | None = None) -> bool:
        self.toggles[key] = (not self.toggles.get(key, False)) if on is None else on
        return self.toggles[key]

    def setting(self, key: str, *value: Any) -> Any:
        if value:
            self.values[key] = value[0]
        return self.values.get(key)

    def clear(self) -> None:
        self.values.clear()
        self.toggles.clear()


def splitext(path: str) -> str:
    """What ``file_ext`` gives, in Python: for tests."""
    return os.path.splitext(path)[1]


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())
