import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tessellate.models import Customer, Lineitem, Nation, Orders, Region
from tessellate.operators import dml, migrate, relations
from tessellate.operators.recursive import ancestors, fixpoint
from tessellate.plans import schema as S
from tessellate.plans.expr import case, fn, value
from tessellate.plans.query import DoesNotExist
from tessellate.plans.windows import Spec, following, over_groups, preceding, spec
from tessellate.session import Database
from tessellate.sources import files
from tessellate.streaming import windowed


@pytest.fixture(scope="module")
def db(spark):
    return Database(spark, "/root/testdata/sf0.001")


SAMPLE = [(1, 1, 10.0), (2, 1, 20.0), (3, 2, 1.0), (4, 2, 3.0), (5, 3, 100.0)]


def sample(spark, more=()):
    return spark.createDataFrame([*SAMPLE, *more], "id int, counter int, value double")


def windowed_values(df, c):
    return [r.x for r in df.select("id", c.column.alias("x")).orderBy("id").collect()]


def test_window_fixtures(spark):
    df = sample(spark)
    v, c, i = value(F.col("value")), F.col("counter"), F.col("id")
    assert windowed_values(df, fn.avg(v).over(partition_by=[c])) == [15, 15, 2, 2, 100]
    assert windowed_values(df, fn.sum(v).over(order_by=[v])) == [14, 34, 1, 4, 134]
    assert windowed_values(df, fn.sum(v).over(order_by=[i], start=preceding(2))) == [10, 30, 31, 24, 104]
    assert windowed_values(df, fn.sum(v).over(order_by=[i], start=0, end=following())) == [134, 124, 104, 103, 100]
    assert windowed_values(df, fn.sum(v).filter(c != 2).over(order_by=[i], start=preceding())) == [10, 30, 30, 30, 130]
    with pytest.raises(ValueError):
        Spec(end=0, order_by=[i]).build()
    base = spec(partition_by=[c])
    assert windowed_values(df, fn.sum(v).over(spec(extends=base, order_by=[i]).build())) == [10, 30, 1, 4, 100]


def test_frames_of_peers(spark):
    df = sample(spark, [(6, 1, 20.0), (7, 2, 1.0)])
    v = value(F.col("value"))
    order = [F.col("counter"), F.col("value")]
    got = df.select("id", "counter", "value", fn.sum(v).over(order_by=order, start=preceding(), frame="range").column.alias("range"), fn.sum(v).over(order_by=[*order, F.col("id")], start=preceding()).column.alias("rows"))
    got = sorted((r.counter, r.value, r.range, r.rows) for r in got.collect())
    assert [r[2] for r in got] == [10, 50, 50, 52, 52, 55, 155] and [r[3] for r in got] == [10, 30, 50, 51, 52, 55, 155]
    groups = over_groups(df, {"g": F.sum("value")}, partition_by=None, order_by=order, start=preceding(1))
    assert [r.g for r in sorted(groups.collect(), key=lambda r: (r.counter, r.value))] == [10, 50, 50, 42, 42, 5, 103]


def test_clauses_and_results(db):
    q = db.select(Orders.o_orderkey, Orders.o_totalprice).order_by(Orders.o_totalprice.desc())
    assert q.count() == 1500 and q.limit(7).count() == 7 and q.limit(7).count(clear_limit=True) == 1500 and q.exists()
    top = q.first()
    assert q.peek() == top and q[0] == top and q.scalar() == top[0] and [r for r in q[1:3]][0] == q[1] and len(q.first(3)) == 3
    assert q.where(Orders.o_orderkey == None).get_or_none() is None  # noqa: E711
    with pytest.raises(DoesNotExist):
        q.where(Orders.o_orderkey < 0).get()
    assert next(q.dicts()) == {"o_orderkey": top[0], "o_totalprice": top[1]} and next(q.tuples()) == tuple(top) and next(q.objects(lambda **d: d["o_orderkey"])) == top[0]
    assert q.distinct().distinct(False).distinct_ is False
    a, b = q.where(Orders.o_orderkey << [1, 2]), q.where(Orders.o_orderkey == 1).orwhere(Orders.o_orderkey == 2)
    assert a.count() == b.count() == 2
    both = db.select(Customer, Nation.n_name).join(Nation).limit(1).df()
    assert both.columns == ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name"]
    assert db.noop(Orders).count() == 0 and "Aggregate" in db.select(fn.count()).from_(Orders).sql()
    assert db.select(value(1).alias("x"), value(2).alias("x")).df().columns == ["x", "x_2"]
    assert db.select(Nation.n_name).select_extend(Nation.region).df().columns == ["n_name", "n_regionkey"]
    assert db.select(case(Region.r_regionkey, [(0, "zero")]).alias("z")).from_(Region).count() == 5


def test_joins_by_foreign_key(db):
    q = db.select(Region.r_name, fn.count().alias("n")).from_(Region).join(Nation).join(Customer).group_by(Region.r_name)
    assert sum(r.n for r in q) == 150
    assert q.switch(Region).at is Region and q.ensure_join(Region, Nation) is q
    with pytest.raises(ValueError):
        db.select(Region.r_name).join(Customer).df()
    with pytest.raises(ValueError):
        db.select(Region.r_name).join(Nation, "cross", Nation.region == 1).df()
    path = db.select(Region.r_name).filter(nations__customers__c_acctbal__gt=9900).df()
    assert path.count() == db.select(Customer.c_custkey).where(Customer.c_acctbal > 9900).count()


def test_schema():
    assert S.sorted_models([Lineitem, Orders, Customer, Nation, Region])[:4] == [Region, Nation, Customer, Orders]
    assert [m for m, _ in S.dependents(Customer)] == [Orders, Lineitem]
    assert S.DecimalField(auto_round=True).convert("1.234567") == decimal.Decimal("1.23457") and S.DecimalField().convert(0) == 0
    assert S.FixedCharField(3).convert("  abcd ") == "abc" and S.IPField().convert("1.2.3.4") == 0x01020304
    assert S.TimestampField(3).convert(dt.datetime(1970, 1, 1, 0, 0, 1)) == 1000 and S.IntegerField().convert("x") == "x"
    assert S.DateField().convert("2024-01-02 03:04:05") == dt.date(2024, 1, 2) and S.DateTimeField().convert("no") == "no"
    assert S.TimeField().convert(dt.time(0, 1)) == 60_000_000 and S.UUIDField().convert("a-b") == "ab" and S.BlobField().convert("é") == "é".encode()
    diff = S.schema_diff(Region, Region.schema().add("extra", S.T.IntegerType()))
    assert diff == {"missing": [], "unknown": ["extra"], "changed": []}
    again = S.reflect("region2", Region.schema(), "r_regionkey")
    assert again.primary_key().name == "r_regionkey" and again.schema() == Region.schema()


def test_database(db, spark):
    other = Database(spark, tables={"t": spark.range(3)})
    db.attach(other, "aux")
    assert db.table("aux.t").count() == 3 and db.detach("aux") and not db.detach("aux")
    assert Database.connect("parquet:///root/testdata/sf0.001", spark).table("region").count() == 5
    assert [c[0] for c in db.get_columns("region")] == ["r_regionkey", "r_name"] and db.generate_model("region").columns()[0].name == "r_regionkey"
    with pytest.raises(ValueError):
        Database.connect("ftp://x", spark)


def test_recursion(spark):
    tree = spark.createDataFrame([("root", None), ("p1", "root"), ("p2", "root"), ("p3", "root"), ("c11", "p1"), ("c12", "p1"), ("c31", "p3")], "name string, parent string")
    below = fixpoint(tree.where("name = 'root'").select("name"), lambda f: tree.join(f.toDF("up"), F.col("parent") == F.col("up")).select("name"))
    assert {r.name for r in below.collect()} == {r.name for r in tree.collect()}
    up = ancestors(tree, spark.createDataFrame([("c31",)], "name string"), "name", "parent")
    assert sorted((r.level, r.node) for r in up.collect()) == [(0, "c31"), (1, "p3"), (2, "root")]


def test_changes(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "k int, s string, n int")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(dml.insert_many(t, [{"k": 4}, {"k": 5, "s": "e"}]).affected) == [(4, None, None), (5, "e", None)]
    with pytest.raises(ValueError):
        dml.insert(t, nope=1)
    assert dml.bulk_create(t, [{"s": "x"}, {"s": "y"}], "k").affected.agg(F.max("k")).first()[0] == 5
    assert rows(dml.update(t, {"n": F.col("n") + 1, "s": F.col("n").cast("string")}, F.col("s") == "a").table) == [(1, "1", 2), (2, "b", 2), (3, None, 3)]
    assert dml.delete(t, F.col("s") != "a").rowcount() == 1  # NULL stays
    new = spark.createDataFrame([(1, "z", 10), (9, "y", 11)], t.schema)
    assert rows(dml.replace(t, new, ["k"]).table)[0] == (1, "z", 10)
    assert rows(dml.ignore(t, new, ["k"]).affected) == [(9, "y", 11)]
    up = dml.upsert(t, new, ["k"], preserve=["s"], update={"n": F.col("old.n") + F.col("new.n")})
    assert rows(up.table) == [(1, "z", 11), (2, "b", 2), (3, None, 3), (9, "y", 11)] and up.rowcount() == 2
    assert rows(dml.bulk_update(t, [{"k": 2, "s": "q"}], "k", ["s"]).affected) == [(2, "q", 2)]
    assert rows(dml.limited(t, [F.col("k").desc()], 1, dml.delete).affected)[0][0] == 3
    assert dml.insert_where(t, {"k": 7}, t.where("k > 100")).rowcount() == 0 and dml.insert_where(t, {"k": 7}, t).rowcount() == 1
    assert rows(dml.violations(t, unique=[["k"]], checks={"n": F.col("n") < 3}, references={"k": (t.where("k < 3"), "k")}, not_null=["s"])) == [("check n", 1), ("foreign key k", 1), ("not null s", 1)]
    log = {r.k: (r.action, r.changes) for r in dml.changes(t, up.table, "k").collect()}
    assert log[9][0] == "INSERT" and log[1] == ("UPDATE", '{"s":["a","z"],"n":["1","11"]}')
    kv = dml.KeyValue(spark, {"a": "1"})
    kv["b"] = "2"
    kv.update(a="3", c="4")
    assert kv["a"] == "3" and len(kv) == 3 and "c" in kv and kv.pop("c") == "4" and kv.get("c", 0) == 0 and kv.keys() == ["a", "b"]
    gone = dml.delete_recursive({"region": spark.createDataFrame([(1, "r"), (2, "s")], "r_regionkey int, r_name string"), "nation": spark.createDataFrame([(1, "n", 1), (2, "m", 2)], "n_nationkey int, n_name string, n_regionkey int")}, Region, F.col("r_regionkey") == 1)
    assert rows(gone["nation"]) == [(2, "m", 2)]
    moved = migrate.migrate(t, (migrate.add_column, "x", "int", 5), (migrate.rename_column, "s", "t"), (migrate.alter_column_type, "n", "bigint"), (migrate.fill_default, "t", "?"), (migrate.add_not_null, "t"), (migrate.drop_column, "k"))
    assert moved.dtypes == [("t", "string"), ("n", "bigint"), ("x", "int")] and moved.where("t = '?'").count() == 1


def test_relations(spark):
    users = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "id int, name string")
    tweets = spark.createDataFrame([(k, 1 + k % 2, f"t{k}") for k in range(8)], "tid int, uid int, content string")
    marks = spark.createDataFrame([(0, 5), (0, 6), (7, 7)], "tid int, m int")
    load = relations.Load("tweets", tweets, "uid", "id", order=[F.col("tid").desc()], per_parent=2).then(relations.Load("marks", marks, "tid", "tid"))
    got = {r.id: r.tweets for r in relations.nested(users, load).collect()}
    assert [t.tid for t in got[1]] == [6, 4] and [t.tid for t in got[2]] == [7, 5] and got[3] == [] and [m.m for m in got[2][0].marks] == [7]
    groups = spark.createDataFrame([(1, "g1"), (2, "g2")], "gid int, g string")
    through = relations.link(spark.createDataFrame([(1, 1)], "user_id int, group_id int"), [(1, 2), (1, 1)])
    m2m = relations.many_to_many(users, through, groups, left_key="id", left_ref="user_id", right_key="gid", right_ref="group_id", name="groups")
    assert {r.id: [g.g for g in r.groups] for r in m2m.collect()} == {1: ["g1", "g2"], 2: [], 3: []}
    assert relations.unlink(through, "user_id", 1, "group_id", [2]).count() == 1
    assert relations.from_dict(relations.to_dict(users), "json", "id int, name string").count() == 3


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', decimal.Decimal("1.50"), dt.datetime(2024, 1, 2, 3, 4, 5), b"\x01"), (2, "", None, None, None)], "k int, s string, d decimal(10,2), t timestamp_ntz, b binary")
    files.write_csv(df, f"{tmp_path}/c")
    back = files.read_csv(spark, f"{tmp_path}/c", df.select("k", "s", "d", "t").schema)
    assert sorted(map(tuple, back.select("k", "s", "d", "t").collect())) == sorted(map(tuple, df.select("k", "s", "d", "t").collect()))
    assert back.where("k = 1").first().b == "01"
    with pytest.raises(ValueError):
        files.read_csv(spark, f"{tmp_path}/c", df.select("k").schema, strict=True)
    files.write_tsv(df.select("k", "s"), f"{tmp_path}/t")
    assert files.read_tsv(spark, f"{tmp_path}/t", df.select("k", "s").schema).count() == 2
    files.write_json(df, f"{tmp_path}/j", iso=True, base64=True)
    one = files.read_json(spark, f"{tmp_path}/j", lines=True).where("k = 1").first()
    assert (one.t, one.b, one.d) == ("2024-01-02T03:04:05.000000", "AQ==", "1.50")
    assert files.json_array(df.select("k")) == '[{"k":1},{"k":2}]'
    t = files.DynamicTable(spark)
    t.insert(a=1)
    t.insert_many([{"a": 2, "b": "x"}])
    t.update(["a"], a=1, b="y", c=2.5)
    assert t.columns == ["a", "b", "c"] and t.find_one(a=1).c == 2.5 and t.find(b=None).count() == 0
    t.delete(a=2)
    assert t.all().count() == 1


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "a", 1.0) for h in (0, 1, 7, 8, 30 % 24)], "ts timestamp_ntz, kind string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = windowed.stream_parquet(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    windowed.run_once(windowed.bucketed(stream, "ts", "6 hours", ["kind"], "value", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/check")
    table = {r.bucket: r.n for r in windowed.bucketed(events, "ts", "6 hours", ["kind"], "value").collect()}
    got = {r.bucket: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got and got.items() <= table.items()


def test_operands_locks_and_async(db):
    import asyncio

    from tessellate.plans.query import NotSupported

    rich = db.select(Customer).where(Customer.c_acctbal > 9000)
    assert rich.df().columns[0] == "c_custkey" and len(rich.df().columns) == 5
    n = db.select(Orders.o_orderkey).where(Orders.customer.in_(rich)).count()
    assert n == db.select(Orders.o_orderkey).join(Customer).where(Customer.c_acctbal > 9000).count()
    for call in (rich.for_update, db.atomic):
        with pytest.raises(NotSupported):
            call()
    assert len(asyncio.run(db.select(Region).aexecute())) == 5
