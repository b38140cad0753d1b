import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessellate.functions import aggregates as A
from tessellate.functions import collections as C
from tessellate.functions import dates, search, text
from tessellate.functions.json_ops import Json, JsonTree, json_contains, matches
from tessellate.functions.udf import Functions, register_library
from tessellate.plans.expr import col, value


def one(spark, c, data=None):
    df = spark.range(1) if data is None else data
    return df.select(col(c).alias("x")).first().x


def many(spark, f, values, kind):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", col(f(F.col("v"))).alias("x")).orderBy("k").collect()]


def agg(spark, f, values, kind="int"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}").agg(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("values,want", [([17, 3, 1] + [7] * 4 + [6] * 3 + [12] * 2, 7), ([3, 3, 9, 1, 2, 2], 3), ([8] * 2 + [1, 2, 4] * 2 + [5], 4), ([], None)])
def test_median(spark, values, want):
    assert agg(spark, A.median, values) == want


def test_mode_and_ranges(spark):
    assert agg(spark, A.mode, [4] * 4 + [1] * 3 + [3] * 2 + [5, 6, 9]) == 4
    assert (agg(spark, A.minrange, [1, 4, 8, 13, 19]), agg(spark, A.avgrange, [1, 4, 8, 13, 19]), agg(spark, A.value_range, [1, 4, 8, 13, 19])) == (3, 4.5, 18)
    assert agg(spark, A.value_range, [19, 4, 5, 20, 5, 8]) == 16
    assert (agg(spark, A.minrange, [7]), agg(spark, A.avgrange, [7]), agg(spark, A.minrange, []), agg(spark, A.avgrange, [])) == (0, 0.0, None, None)
    assert (agg(spark, A.stddev, [3]), agg(spark, A.stddev, [])) == (0.0, 0.0)


def test_time_gaps(spark):
    at = lambda *s: [dt.datetime(2020, 1, 1) + dt.timedelta(seconds=x) for x in s]
    times = at(52, 41, 33, *(22, 18, 15), 10, 2)
    assert agg(spark, A.mintdiff, times, "timestamp_ntz") == 3 and round(agg(spark, A.avgtdiff, times, "timestamp_ntz"), 1) == 7.1
    assert agg(spark, A.mintdiff, times + at(22), "timestamp_ntz") == 0 and agg(spark, A.duration, times, "timestamp_ntz") == 50
    assert (agg(spark, A.mintdiff, at(1), "timestamp_ntz"), agg(spark, A.avgtdiff, at(1), "timestamp_ntz"), agg(spark, A.avgtdiff, [], "timestamp_ntz")) == (None, 0.0, None)


def test_human_delta(spark):
    want = {300000: "3 days, 11 hours, 20 minutes", 7530: "2 hours, 5 minutes, 30 seconds", 3600: "1 hour", 300: "5 minutes", 30: "30 seconds", 1: "1 second", 0: "0 seconds", None: None}
    assert many(spark, text.human_delta, list(want), "int") == list(want.values())


def test_text_library(spark):
    assert many(spark, text.hostname, ["http://a.b:80/x?y", "https://u@h/", "none", None, ""], "string") == ["a.b:80", "u@h", "", "", ""]
    assert many(spark, text.tonumber, ["123", "1.23", "1e4", "-10", "x", "13d", None], "string") == [123.0, 1.23, 10000.0, -10.0, None, None, None]
    assert many(spark, lambda v: text.substr_count(v, "aa"), ["aaaaa", "", None, "baab"], "string") == [2, 0, 0, 1]
    assert many(spark, lambda v: text.strip_chars(v, "xy"), ["xyaxyx", "a"], "string") == ["a", "a"]
    assert many(spark, text.strip_tz, ["2020-01-02T03:04+02:00", "2020-01-02T03:04-02:00", "20200102 030405-01"], "string") == ["2020-01-02 03:04", "2020-01-02 03:04-02:00", "20200102 030405"]
    paths = ["a/b.tar.gz", "x", ".bashrc", "a.b/c", "d.", "..x.y", None]
    assert many(spark, text.file_ext, paths, "string")[:-1] == [text.splitext(p) for p in paths[:-1]]
    assert many(spark, text.sqrt, [4.0, -1.0], "double") == [2.0, None]
    assert many(spark, lambda v: text.gunzip(text.gzip(v)), ["héllo", None], "string") == ["héllo".encode(), None]
    assert one(spark, text.if_then_else(F.lit(0), 1, 2, "number")) == 2
    assert (text.osa("abc", "ba"), text.osa("ab", "ba"), text.changed_length("abc", "ba"), text.changed_length("abcde", "eba")) == (2, 1, 3, 6)
    s = text.Settings()
    assert s.toggle("x") and not s.toggle("x") and s.setting("k", 3) == 3


def test_none_lists_and_search(spark):
    df = spark.createDataFrame([(1, "a_c%"), (2, "ABC"), (3, None)], "k int, s string")
    s = value(F.col("s"))
    got = lambda e: [r.k for r in df.where(col(e)).orderBy("k").collect()]
    assert got(s == None) == [3] and got(s != None) == [1, 2]  # noqa: E711
    assert got(s.in_([])) == [] and got(s.not_in([])) == [1, 2, 3]
    assert got(s.contains("_C")) == [1] and got(s.startswith("AB")) == [2] and got(s.endswith("%")) == [1]
    assert got(s.contains(F.lit("b"))) == [2] and got(s.regexp("B")) == [2] and got(~s.regexp("B")) == [1, 3]
    assert got(s % "A%") == [2] and got(s**"a%") == [1, 2]
    assert one(spark, value(1) / 0) is None and one(spark, value(7).idiv(2)) == 3 and one(spark, value(7) / 2) == 3.5
    assert one(spark, value("a") + "b") == "ab"


def test_dates(spark):
    t = F.lit("2024-03-05 06:07:08.9").cast("timestamp_ntz")
    assert [one(spark, dates.extract(p, t)) for p in ("year", "month", "day", "hour", "minute", "second")] == [2024, 3, 5, 6, 7, 8]
    assert one(spark, dates.truncate(t, "hour")) == dt.datetime(2024, 3, 5, 6)
    with pytest.raises(ValueError):
        dates.truncate(t, "week")
    assert one(spark, dates.from_timestamp(F.lit(1_700_000_000_123), 1000)) == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert one(spark, dates.to_timestamp(t)) == int(dt.datetime(2024, 3, 5, 6, 7, 8, tzinfo=dt.UTC).timestamp())
    assert one(spark, dates.add_interval(t, F.lit(2), "days")) == dt.datetime(2024, 3, 7, 6, 7, 8, 900000)
    assert one(spark, dates.add_interval(t, F.lit(1), "year")) == dt.datetime(2025, 3, 5, 6, 7, 8, 900000)
    assert one(spark, dates.strftime("%Y/%m", t)) == "2024/03"


DOC = '{"name": "Al", "age": 7, "active": true, "tags": ["x", "y"], "profile": {"city": "B", "z": null}, "matrix": [[1, 2], [3, 4]], "a.b": 5}'


def test_json_paths(spark):
    j = Json(F.lit(DOC))
    assert one(spark, j["name"].as_text()) == "Al" and one(spark, j["age"].as_int()) == 7 and one(spark, j["tags"][-1].as_text()) == "y"
    assert one(spark, j["matrix"][1][0].as_int()) == 3 and one(spark, j["matrix"][-1][-2].as_int()) == 3 and one(spark, j["a.b"].as_int()) == 5
    assert one(spark, j.path("profile", "city") == "B") and one(spark, j["profile"]["z"] == None) and one(spark, j["nope"] == None)  # noqa: E711
    assert one(spark, j["profile"].has_key("z")) and not one(spark, j["profile"].has_keys("z", "q")) and one(spark, j.has_any_keys("q", "age"))
    assert (one(spark, j["tags"].length()), one(spark, j["name"].length()), one(spark, j["nope"].length())) == (2, 0, None)
    kinds = {"name": "string", "age": "integer", "active": "boolean", "tags": "array", "profile": "object"}
    assert {k: one(spark, j[k].type()) for k in kinds} == kinds
    assert one(spark, Json(F.lit("not json"))["a"].as_text()) is None


def test_json_containment(spark):
    j = Json(F.lit(DOC))
    assert one(spark, j.contains({"age": 7, "tags": ["y"]})) and not one(spark, j.contains({"active": 1})) and one(spark, j["tags"].contains("x"))
    assert one(spark, j["tags"].contained_by(["y", "x", "z"])) and one(spark, j["tags"] == ["x", "y"]) and not one(spark, j["matrix"].contains([1]))
    assert one(spark, json_contains(F.lit('{"a": [1, 2]}'), {"a": [1]})) and not one(spark, json_contains(F.lit('{"a": [1, 2]}'), {"a": [2]}))
    assert one(spark, matches(F.lit(None).cast("string"), {}, "contains")) is None


def test_json_changes(spark):
    j = Json(F.lit('{"a":{"b":1},"l":[1],"n":null}'))
    got = lambda e: one(spark, e)
    assert got(j["a"]["c"].set(2)) == '{"a":{"b":1,"c":2},"l":[1],"n":null}'
    assert got(j["x"]["y"].set(2)) == '{"a":{"b":1},"l":[1],"n":null,"x":{"y":2}}'
    assert got(j["n"].insert(2)) == '{"a":{"b":1},"l":[1],"n":null}' and got(j["q"].replace(1)) == '{"a":{"b":1},"l":[1],"n":null}'
    assert got(j["l"].append({"z": 1})) == '{"a":{"b":1},"l":[1,{"z":1}],"n":null}' and got(j["a"]["b"].append(3)) == '{"a":{"b":1},"l":[1],"n":null}'
    assert got(j["a"].remove()) == '{"l":[1],"n":null}' and got(j["l"][0].remove()) == '{"a":{"b":1},"l":[],"n":null}'
    assert got(j.update({"a": {"b": None, "c": 1}, "l": 3})) == '{"a":{"c":1},"l":3,"n":null}'
    assert got(j["l"].concat([2])) == '{"a":{"b":1},"l":[1,2],"n":null}'


def test_json_tree(spark):
    spark.udtf.register("json_tree", JsonTree)
    got = spark.sql("""SELECT fullkey, type FROM json_tree('{"a": [1, {"b": null}]}')""").collect()
    assert [(r.fullkey, r.type) for r in got] == [("$", "object"), ("$.a", "array"), ("$.a[0]", "integer"), ("$.a[1]", "object"), ("$.a[1].b", "null")]


def test_maps_and_arrays(spark):
    m = F.create_map(F.lit("k"), F.lit("v"), F.lit("n"), F.lit(None).cast("string"))
    assert one(spark, C.key(m, "k")) == "v" and one(spark, C.exists(m, "n")) and not one(spark, C.defined(m, "n"))
    assert one(spark, C.contains_map(m, {"k": "v"})) and not one(spark, C.contains_map(m, {"n": "v"})) and one(spark, C.merged(m, {"k": "w"}))["k"] == "w"
    assert one(spark, C.subset(m, "k")) == {"k": "v"} and one(spark, C.without(m, "k")) == {"n": None} and one(spark, C.items(m)) == [["k", "v"], ["n", None]]
    a = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert (one(spark, C.item(a, 0)), one(spark, C.item(a, -1)), one(spark, C.item(a, 9)), one(spark, C.part(a, 1, 3))) == (1, 3, None, [2, 3])
    assert one(spark, C.contains(a, 1, 3)) and not one(spark, C.contains(a, 4)) and one(spark, C.contained_by(a, 1, 2, 3, 4)) and one(spark, C.upper(a)) == 3


CORPUS = [
    "Rivers run to the sea, and rivers keep their names until then.", "The harbour master counts boats at dawn: three boats, two rivers, one old light.", "Be careful on the ice; riverside paths freeze first.",
    "Rivers and roads carry the same grain to the same mill.", "Rivers feed many things: meadows, mills and things nobody has counted.",
]


def test_search_scores(spark):
    docs = spark.createDataFrame([(k, t, t.split()[0], None) for k, t in enumerate(CORPUS)], "id int, t string, u string, n string")
    for kind in ("rank", "bm25", "bm25f", "lucene"):
        got = search.search(docs, ["t"], "things rivers", kind).collect()
        assert [r.id for r in got] == [4]
    index = search.Index(docs, ["t", "u"], "rivers")
    assert index.stats["df_t_0"] == 4 and index.stats["df_u_0"] == 3 and search.weights_of([2], ["t", "u"]) == [2.0, 0.0]
    off = index.docs.select(index.bm25([0, 0]).alias("x"), index.lucene({"u": 1}).alias("y")).collect()
    assert {r.x for r in off} == {0.0} and sum(r.y != 0 for r in off) == 3
    found = lambda q: [r.id for r in docs.where(search.web_query(q, ["t", "u"])).orderBy("id").collect()]
    assert found('"old light"') == [1] and found("rivers -things") == [0, 1, 3] and found("boats OR ice") == [1, 2] and found("u:be") == [2] and found("riversi*") == [2] and found("") == []
    assert found("NOT rivers") == [2] and found("(dawn OR sea) rivers") == [0, 1]
    assert one(spark, search.highlight(F.lit("Rivers, riverside"), "rivers")) == "<b>Rivers</b>, riverside"
    assert one(spark, search.snippet(F.lit("a b c d e f g h"), "f", 4)) == "...c d e f..."
    assert search.validate_query('"a b" c*') and not search.validate_query("a;b")
    assert {r.term: (r.doc, r.cnt) for r in search.vocabulary(docs, "t").collect()}["rivers"] == (4, 5)


def test_user_functions(spark):
    f = Functions(spark)
    f.scalar("twice", "int")(lambda x: None if x is None else 2 * x)

    @f.aggregate("spread", "int")
    class Spread:
        def __init__(self):
            self.seen = []

        def step(self, x):
            self.seen.append(x)

        def finalize(self):
            return max(self.seen) - min(self.seen)

    @f.table("series", "n int")
    class Series:
        def eval(self, a: int, b: int):
            for k in range(a, b):
                yield (k,)

    register_library(f)
    df = spark.createDataFrame([(1, 2), (1, 9), (2, 5)], "g int, x int")
    assert [r[0] for r in df.select(f.twice(F.col("x"))).collect()] == [4, 18, 10]
    assert {r.g: r.s for r in df.groupBy("g").agg(f.spread(F.col("x")).alias("s")).collect()} == {1: 7, 2: 0}
    assert [r.n for r in spark.sql("SELECT n FROM series(1, 4)").collect()] == [1, 2, 3]
    assert spark.sql("SELECT str_dist('abc', 'ba') d, damerau_levenshtein_dist('ab', 'ba') o").first() == (3, 1)
    assert f.unregister("twice") and not f.unregister("twice") and "string" in f.groups


def test_bitmaps(spark):
    from tessellate.functions import bits

    x = F.lit(b"\x01").cast("binary")
    assert one(spark, bits.set_bit(x, 9)) == b"\x01\x02" and one(spark, bits.clear_bit(x, 0)) == b"\x00" and one(spark, bits.toggle_bit(x, 1)) == b"\x03"
    assert one(spark, bits.is_set(x, 0)) and not one(spark, bits.is_set(x, 1)) and not one(spark, bits.is_set(x, 99))
    y = F.lit(b"\x03\x01").cast("binary")
    assert (one(spark, bits.and_(x, y)), one(spark, bits.or_(x, y)), one(spark, bits.xor(x, y))) == (b"\x01\x00", b"\x03\x01", b"\x02\x01")


def test_json_path_queries(spark):
    j = Json(F.lit(DOC))
    assert one(spark, j.path_query("$.tags[*]")) == '["x","y"]' and one(spark, j.path_exists("$.profile.city")) and not one(spark, j.path_exists("$.q"))
    assert one(spark, j.path_query_first("$.tags[*]")) == "x" and one(spark, j.path_query_array("$.q")) == "[]"
