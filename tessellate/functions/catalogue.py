"""Function names as queries write them, and what they mean here."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..plans.expr import col
from . import aggregates as A
from . import collections as C
from . import dates, json_ops, text
from .search import tokens


def _count(*args):
    return F.count(args[0]) if args else F.count("*")


def _place(x, path: str):
    """A path of SQLite's or MySQL's kind, ``$.a.b[0]`` or ``$."a b"``, as a place."""
    if not path.startswith("$"):
        raise ValueError(f"not a path: {path}")
    parts = re.findall(r'\."((?:[^"\\]|\\.)*)"|\.([^.\[\]"]+)|\[(-?\d+)\]', path[1:])
    return json_ops.Json(x, tuple(int(i) if i else quoted or plain for quoted, plain, i in parts))


def _changed(how: str, x, pairs: tuple):
    """One change for each path and value, from left to right."""
    for path, new in zip(pairs[::2], pairs[1::2]):
        x = getattr(_place(x, path), how)(new)
    return col(x)


def _removed(x, paths: tuple):
    for path in paths:
        x = _place(x, path).remove()
    return col(x)


def _has_path(x, how: str, paths: tuple):
    found = [_place(x, p).variant().isNotNull() for p in paths]
    return F.greatest(*found) if how == "one" and len(found) > 1 else F.least(*found) if len(found) > 1 else found[0]


FUNCTIONS = {
    "count": _count, "sum": F.sum, "sum_key": A.sum_key, "avg": F.avg,
    "min": lambda *a: F.min(a[0]) if len(a) == 1 else F.least(*a), "max": lambda *a: F.max(a[0]) if len(a) == 1 else F.greatest(*a),
    "group_concat": A.string_agg, "string_agg": A.string_agg, "array_agg": A.array_agg, "json_group_array": A.json_group_array, "json_group_object": A.json_group_object,
    "median": A.median, "mode": A.mode, "range": A.value_range, "minrange": A.minrange, "avgrange": A.avgrange, "stddev": A.stddev,
    "mintdiff": A.mintdiff, "avgtdiff": A.avgtdiff, "duration": A.duration, "weighted_avg": A.weighted_avg,
    "rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist,
    "ntile": lambda n: F.ntile(n), "lag": lambda x, *a: F.lag(col(x), *a), "lead": lambda x, *a: F.lead(col(x), *a), "nth_value": lambda x, *a: F.nth_value(col(x), *a),
    "first_value": F.first, "last_value": F.last,
    "lower": F.lower, "upper": F.upper, "length": F.length, "substr": lambda s, a, n=None: F.substr(s, a, n) if n is not None else F.substr(s, a),
    "strpos": lambda s, p: F.position(p, s), "lpad": lambda s, n, p: F.lpad(col(s), n, p),
    "translate": lambda s, a, b: F.translate(col(s), a, b), "concat": F.concat, "rstrip": F.rtrim, "title_case": F.initcap, "md5": F.md5, "trim": F.trim, "rtrim": F.rtrim,
    "abs": F.abs, "round": lambda x, n=0: F.round(col(x), n), "log": F.log, "sqrt": text.sqrt, "random": lambda: F.rand(), "rand": lambda: F.rand(),
    "coalesce": F.coalesce, "nullif": F.nullif, "ifnull": F.ifnull, "if_then_else": text.if_then_else,
    "now": F.now, "date_part": lambda p, x: dates.extract(p, x).column, "date_trunc": lambda p, x: dates.truncate(x, p), "extract": lambda p, x: dates.extract(p, x).column,
    "strftime": lambda p, x: dates.strftime(p, x).column, "date_format": lambda x, p: F.date_format(col(x), p), "unix_timestamp": lambda x: dates.to_timestamp(x).column,
    "to_timestamp": lambda x: dates.from_timestamp(x).column, "from_unixtime": lambda x: dates.from_timestamp(x).column,
    "json": F.parse_json, "jsonb": F.parse_json, "json_extract": lambda x, p: F.get_json_object(col(x), p), "json_array_length": F.json_array_length,
    "json_contains": lambda a, b: json_ops.matches(a, b, "contains"),
    "json_set": lambda x, *a: _changed("set", x, a), "jsonb_set": lambda x, *a: _changed("set", x, a), "json_insert": lambda x, *a: _changed("insert", x, a), "jsonb_insert": lambda x, *a: _changed("insert", x, a),
    "json_replace": lambda x, *a: _changed("replace", x, a), "jsonb_replace": lambda x, *a: _changed("replace", x, a), "json_array_append": lambda x, *a: _changed("append", x, a),
    "json_remove": lambda x, *p: _removed(x, p), "jsonb_remove": lambda x, *p: _removed(x, p),
    "json_patch": lambda x, y: json_ops.Json(x).update(y).column, "jsonb_patch": lambda x, y: json_ops.Json(x).update(y).column, "json_merge_patch": lambda x, y: json_ops.Json(x).update(y).column,
    "json_type": lambda x, p="$": _place(x, p).type().column, "jsonb_typeof": lambda x: json_ops.Json(x).type().column, "json_length": lambda x, p="$": _place(x, p).length().column, "jsonb_array_length": lambda x: json_ops.Json(x).length().column,
    "json_contains_path": lambda x, how, *p: _has_path(x, how, p), "json_overlaps": lambda x, keys: json_ops.Json(x).has_any_keys(*keys).column, "json_unquote": lambda x: json_ops.Json(x).as_text().column, "json_compact": lambda x: json_ops.Json(x).json().column,
    "jsonb_extract": lambda x, p: _place(x, p).json().column, "json_extract_path": lambda x, *k: json_ops.Json(x, k).json().column, "jsonb_extract_path": lambda x, *k: json_ops.Json(x, k).json().column,
    "jsonb_path_query": lambda x, p: json_ops.Json(x).path_query(p).column, "jsonb_path_query_array": lambda x, p: json_ops.Json(x).path_query_array(p).column, "jsonb_path_query_first": lambda x, p: json_ops.Json(x).path_query_first(p).column,
    "datetime": lambda x: dates.from_timestamp(x).column, "zeroblob": lambda n: F.unhex(F.repeat(F.lit("00"), col(n))), "value": lambda x: col(x), "values": lambda x: col(x),
    "array_upper": C.upper, "akeys": C.keys, "avals": C.values, "hstore_to_matrix": C.items, "slice": lambda m, *k: C.subset(m, *k), "exist": lambda m, k: C.exists(m, k),
    "defined": lambda m, k: C.defined(m, k), "delete": lambda m, *k: C.without(m, *k), "to_tsvector": tokens,
    "hostname": text.hostname, "strip_tz": text.strip_tz, "human_delta": text.human_delta, "tonumber": text.tonumber, "file_ext": text.file_ext,
    "substr_count": lambda x, p: text.substr_count(x, p), "strip_chars": lambda x, p: text.strip_chars(x, p), "levenshtein_dist": text.levenshtein_dist,
    "damerau_levenshtein_dist": text.damerau_levenshtein_dist, "str_dist": text.str_dist, "gzip": text.gzip, "gunzip": text.gunzip,
}

#: Those whose arguments may be plain Python values.
RAW = {FUNCTIONS[n] for n in ("ntile", "lag", "lead", "nth_value", "lpad", "translate", "round", "date_part", "date_trunc", "extract", "strftime", "date_format", "json_extract", "slice", "exist", "defined", "delete", "substr_count", "strip_chars", "human_delta",
    "json_set", "jsonb_set", "json_insert", "jsonb_insert", "json_replace", "jsonb_replace", "json_array_append", "json_remove", "jsonb_remove", "json_patch", "jsonb_patch", "json_merge_patch", "json_type", "jsonb_typeof", "json_length",
    "json_contains_path", "json_overlaps", "jsonb_extract", "json_extract_path", "jsonb_extract_path", "jsonb_path_query", "jsonb_path_query_array", "jsonb_path_query_first")}
DISTINCT = {"count": F.count_distinct, "sum": F.sum_distinct, "avg": lambda x: F.try_divide(F.sum_distinct(x), F.count_distinct(x)), "array_agg": F.collect_set, "group_concat": lambda x: F.array_join(F.array_sort(F.collect_set(x.cast("string"))), ","), "string_agg": lambda x: F.array_join(F.array_sort(F.collect_set(x.cast("string"))), ",")}
