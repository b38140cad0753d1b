"""JSON kept as text: paths, typed access, key tests, containment and changes.

Reading goes through variants, in the JVM. What rewrites a document has no built-in and runs in
Arrow batches. JSON null and a missing key are told apart where that matters.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..plans.expr import Expr, col


def path_text(parts: tuple) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f'["{p}"]' for p in parts)


class Json:
    """``j['a']['b'][0]``: a place in a document; a negative index counts from the end."""

    def __init__(self, value: Any, parts: tuple = ()):
        self.value, self.parts = col(value), parts

    def __getitem__(self, key: str | int) -> Json:
        return Json(self.value, (*self.parts, key))

    def path(self, *keys: str | int) -> Json:
        return Json(self.value, self.parts + keys)

    def variant(self) -> Column:
        """The place as a variant; NULL if it's missing or the text isn't JSON."""
        v, run = F.try_parse_json(self.value), []
        for p in self.parts:
            if isinstance(p, int) and p < 0:
                v = F.try_element_at(F.try_variant_get(v, path_text(tuple(run)), "array<variant>"), F.lit(p))
                run = []
            else:
                run.append(p)
        return F.try_variant_get(v, path_text(tuple(run)), "variant") if run else v

    def get(self, kind: str) -> Expr:
        return Expr(F.try_variant_get(self.variant(), "$", kind))

    def as_text(self) -> Expr:
        """Text of a scalar, JSON of anything else; JSON null is NULL."""
        return self.get("string")

    def as_int(self) -> Expr:
        return self.get("bigint")

    def as_float(self) -> Expr:
        return self.get("double")

    def as_bool(self) -> Expr:
        return self.get("boolean")

    def json(self) -> Expr:
        return Expr(F.to_json(self.variant()))

    def type(self) -> Expr:
        """object, array, string, integer, number, boolean or null."""
        s = F.schema_of_variant(self.variant())
        out = (
            F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BIGINT", "integer")
            .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.isNotNull(), "number")
        )
        return Expr(out)

    def _typed(self, value: Any) -> Column:
        if isinstance(value, bool):
            return self.as_bool().column
        if isinstance(value, (int, float)):
            return self.as_float().column
        return self.as_text().column

    def __eq__(self, value):  # type: ignore[override]
        if value is None:  # SQL NULL, a missing key and JSON null alike
            v = self.variant()
            return Expr(v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False)))
        if isinstance(value, (dict, list)):
            return Expr(matches(self.json(), value, "equal"))
        return Expr(self._typed(value) == F.lit(value))

    def __ne__(self, value):  # type: ignore[override]
        return ~(self == value)

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, value):
        return Expr(self._typed(value) < F.lit(value))

    def __le__(self, value):
        return Expr(self._typed(value) <= F.lit(value))

    def __gt__(self, value):
        return Expr(self._typed(value) > F.lit(value))

    def __ge__(self, value):
        return Expr(self._typed(value) >= F.lit(value))

    def between(self, low, high):
        return Expr(self._typed(low).between(low, high))

    def in_(self, values: list):
        out = Expr(F.lit(False))
        for v in values:
            out = out | (self == v)
        return out

    def not_in(self, values: list):
        return ~self.in_(values)

    def like(self, p):
        return self.as_text().like(p)

    def ilike(self, p):
        return self.as_text().ilike(p)

    def regexp(self, p):
        return self.as_text().regexp(p)

    def startswith(self, p):
        return self.as_text().startswith(p)

    def endswith(self, p):
        return self.as_text().endswith(p)

    # SQL/JSON paths: members, indexes and [*]
    def path_query(self, path: str) -> Expr:
        return Expr(F.get_json_object(F.to_json(self.variant()), path))

    def path_exists(self, path: str) -> Expr:
        """Something is there, JSON null included."""
        found = self.path_query(path).column
        plain = F.try_variant_get(self.variant(), path, "variant") if "*" not in path else F.lit(None)
        return Expr(F.coalesce(found.isNotNull() | plain.isNotNull(), F.lit(False)))

    def path_query_array(self, path: str) -> Expr:
        """All matches as a JSON array."""
        found = self.path_query(path).column
        return Expr(F.when(found.startswith("[") if "*" in path else F.lit(False), found).when(found.isNotNull(), F.concat(F.lit("["), found, F.lit("]"))).otherwise(F.lit("[]")))

    def path_query_first(self, path: str) -> Expr:
        return Expr(F.get_json_object(self.path_query_array(path).column, "$[0]"))

    # keys
    def keys(self) -> Column:
        return F.json_object_keys(F.to_json(self.variant()))

    def has_key(self, key: str) -> Expr:
        """The key is there, even with JSON null."""
        return Expr(F.coalesce(F.array_contains(self.keys(), key), F.lit(False)))

    def has_keys(self, *keys: str) -> Expr:
        return Expr(F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), self.keys())) == 0, F.lit(False)))

    def has_any_keys(self, *keys: str) -> Expr:
        return Expr(F.coalesce(F.arrays_overlap(self.keys(), F.array(*map(F.lit, keys))), F.lit(False)))

    def length(self) -> Expr:
        """Of an array; of anything else 0; NULL where there is nothing."""
        v = self.variant()
        return Expr(F.when(v.isNotNull(), F.coalesce(F.json_array_length(F.to_json(v)), F.lit(0))))

    # containment
    def contains(self, needle: Any) -> Expr:
        return Expr(matches(self.json(), needle, "contains"))

    def contained_by(self, whole: Any) -> Expr:
        return Expr(matches(self.json(), whole, "contained"))

    # changes, each giving the whole document
    def _change(self, f: Callable, *args: Any) -> Expr:
        return Expr(changed(self.value, f, self.parts, *args))

    def set(self, value: Any) -> Expr:
        """Create or overwrite, parents too."""
        return self._change(put, value, True, True)

    def insert(self, value: Any) -> Expr:
        """Only where nothing is; a stored null is something."""
        return self._change(put, value, True, False)

    def replace(self, value: Any) -> Expr:
        return self._change(put, value, False, True)

    def append(self, value: Any) -> Expr:
        """To the array at the place; made if missing; anything else stays."""
        return self._change(appended, value)

    def remove(self) -> Expr:
        return self._change(removed)

    def update(self, patch: Any) -> Expr:
        """RFC 7396: objects merge deeply, nulls remove, anything else replaces."""
        return self._change(patched, patch)

    def concat(self, other: Any) -> Expr:
        """Shallow: arrays join, objects merge."""
        return self._change(joined, other)


MISSING = object()


def find(doc: Any, parts: tuple) -> Any:
    for p in parts:
        if isinstance(p, int) and isinstance(doc, list) and -len(doc) <= p < len(doc) or isinstance(p, str) and isinstance(doc, dict) and p in doc:
            doc = doc[p]
        else:
            return MISSING
    return doc


def put(doc: Any, parts: tuple, value: Any, create: bool, overwrite: bool) -> Any:
    if not parts:
        return value if overwrite else doc
    there = find(doc, parts) is not MISSING
    if not (overwrite if there else create):
        return doc
    at = doc
    for p, nxt in zip(parts[:-1], parts[1:]):
        below = find(at, (p,))
        if below is MISSING:
            below = [] if isinstance(nxt, int) else {}
            if not place(at, p, below):
                return doc
        at = below
    place(at, parts[-1], value)
    return doc


def place(at: Any, p: str | int, value: Any) -> bool:
    if isinstance(p, str) and isinstance(at, dict):
        at[p] = value
    elif isinstance(p, int) and isinstance(at, list) and -len(at) <= p < len(at):
        at[p] = value
    elif isinstance(p, int) and isinstance(at, list) and p == len(at):
        at.append(value)
    else:
        return False
    return True


def appended(doc: Any, parts: tuple, value: Any) -> Any:
    at = find(doc, parts)
    if at is MISSING:
        return put(doc, parts, [value], True, False)
    if isinstance(at, list):
        at.append(value)
    return doc


def removed(doc: Any, parts: tuple) -> Any:
    if not parts:
        return None
    if find(doc, parts) is not MISSING:
        del find(doc, parts[:-1])[parts[-1]]
    return doc


def merge(a: Any, b: Any) -> Any:
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge(out.get(k), v)
    return out


def patched(doc: Any, parts: tuple, patch: Any) -> Any:
    at = find(doc, parts)
    return put(doc, parts, merge(None if at is MISSING else at, patch), True, True)


def joined(doc: Any, parts: tuple, other: Any) -> Any:
    at = find(doc, parts)
    if isinstance(at, dict) and isinstance(other, dict):
        return put(doc, parts, {**at, **other}, True, True)
    listed = lambda x: x if isinstance(x, list) else [x]
    return put(doc, parts, listed(at) + listed(other), True, True) if at is not MISSING else doc


def same(a: Any, b: Any) -> bool:
    """Equality of scalars in which true isn't 1."""
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def holds(a: Any, b: Any, top: bool = True) -> bool:
    """b's structure stands in a, level by level; at the top an array holds a scalar of its own."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and holds(a[k], v, False) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(holds(x, y, False) for x in a) for y in b)
    if isinstance(a, list) and not isinstance(b, dict):
        return top and any(same(x, b) for x in a if not isinstance(x, (dict, list)))
    return not isinstance(a, (dict, list)) and not isinstance(b, (dict, list)) and same(a, b)


def holds_positional(a: Any, b: Any) -> bool:
    """The older rule: lists compare place by place."""
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and holds_positional(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and len(a) >= len(b) and all(holds_positional(x, y) for x, y in zip(a, b))
    return b in a if isinstance(a, (dict, list)) else a == b


def deep_equal(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(deep_equal(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(deep_equal, a, b))
    return not isinstance(a, (dict, list)) and not isinstance(b, (dict, list)) and same(a, b)


RULES = {"contains": holds, "contained": lambda a, b: holds(b, a), "equal": deep_equal, "positional": holds_positional}


def matches(value: Any, other: Any, rule: str) -> Column:
    """A test of a document against a literal (or JSON column), in Arrow batches; NULL stays NULL."""
    test = RULES[rule]

    @F.pandas_udf("boolean")
    def run(docs: pd.Series, others: pd.Series) -> pd.Series:
        def one(a, b):
            try:
                return None if a is None or b is None else test(json.loads(a), json.loads(b))
            except ValueError:
                return None

        return pd.Series([one(a, b) for a, b in zip(docs, others)], dtype=object)

    return run(col(value), col(other) if isinstance(other, (Expr, Column)) else F.lit(json.dumps(other)))


def json_contains(value: Any, other: Any) -> Column:
    return matches(value, other, "positional")


def changed(value: Any, f: Callable, parts: tuple, *args: Any) -> Column:
    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                doc = json.loads(text)
            except ValueError:
                return None
            return json.dumps(f(doc, parts, *json.loads(json.dumps(args))), separators=(",", ":"), ensure_ascii=False)

        return docs.map(one)

    return run(col(value))


def children(df, value: str):
    """A row for each child of a document: ``key`` (objects) or ``pos``, and its JSON ``value``."""
    df.createOrReplaceTempView("__json_children")
    columns = ", ".join(f"d.`{c}`" for c in df.columns)
    return df.sparkSession.sql(f"SELECT {columns}, e.pos AS pos, e.key AS key, to_json(e.value) AS value FROM __json_children d, LATERAL variant_explode(try_parse_json(d.`{value}`)) AS e")


@udtf(returnType="fullkey string, key string, value string, type string, depth int")
class JsonTree:
    """Every place of a document, the root first."""

    def eval(self, text: str):
        if text is None:
            return
        kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}

        def walk(doc, path, key, depth):
            yield path, key, json.dumps(doc, separators=(",", ":"), ensure_ascii=False), kinds[type(doc)], depth
            below = doc.items() if isinstance(doc, dict) else enumerate(doc) if isinstance(doc, list) else ()
            for k, v in below:
                yield from walk(v, f"{path}[{k}]" if isinstance(doc, list) else f"{path}.{k}", str(k), depth + 1)

        yield from walk(json.loads(text), "$", None, 0)
