"""Registered queries against their SQL on tables that go beyond the smallest ones."""

import re
from fractions import Fraction
from functools import reduce
from operator import add

import duckdb
import pytest
from pyspark.sql import functions as F

from tessellate.functions import aggregates as A
from tessellate.functions import text
from tessellate.models import Customer, Supplier
from tessellate.plans import windows
from tessellate.registry import ORACLE, QUERIES
from tessellate.session import Database

from test_expr import many


@pytest.fixture
def agree(spark, tmp_path):
    """Writes tables, and compares a query's rows with its SQL's."""

    def run(name, sql=None, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        df = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql or ORACLE[name]})").fetchall()
        got = [tuple(r) for r in df.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        return got

    return run


def test_human_delta_of_weeks_and_more(spark, agree):
    keys = [0, 59, 86399, 86400, 604799, 604800, 2592000, 31536000, 9_000_000_061, -5, -90061, None]
    agree("human_delta", orders=spark.createDataFrame([(k,) for k in keys], "o_orderkey long"))
    days = [604800, 31536000 + 1, None]
    assert many(spark, lambda v: text.human_delta(v, largest="day"), days, "long") == ["7 days", "365 days, 1 second", None]
    assert many(spark, lambda v: text.human_delta(v), days, "long") == ["1 week", "1 year, 1 second", None]
    assert many(spark, lambda v: text.human_delta(v, largest="second"), [2**53 + 1], "long") == ["9007199254740993 seconds"]


def exact_ranks(rows):
    sums = {k: None for k, _ in rows}
    for k, v in rows:
        sums[k] = sums[k] if v is None else Fraction(v) + (sums[k] or 0)
    known = [v for v in sums.values() if v is not None]
    return sorted(((k, 1 + (len(known) if v is None else sum(w > v for w in known))) for k, v in sums.items()), key=str)


def test_rank_of_totals_that_tie(spark, tmp_path):
    """Customers with the same prices in other orders: sums of doubles differ in their last bits."""
    prices, rows = [0.1, 0.2, 0.3, 123456.78, 0.7, 499993.18, 1e-7], []
    for k in range(12):
        turned = prices[k % 7 :] + prices[: k % 7]
        rows += [(k, p) for p in (turned if k % 2 else turned[::-1])]
    assert len({reduce(add, (p for c, p in rows if c == k)) for k in range(12)}) > 1
    rows += [(12, 0.1), (12, 0.2), (13, 0.3), (14, None), (15, 700000.0), (None, 0.3), (16, -5.5), (16, 1e17), (17, 1e17), (17, -5.25), (18, 1e-20), (19, -1e-20), (20, 2.0**80), (20, -3.0), (20, -(2.0**80))]
    rows += [(21, 3.0), (21, -1e-20), (22, -3.0), (23, 0.0)]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in QUERIES["window_over_agg"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == exact_ranks(rows)


def test_sum_key_of_what_no_digit_holds(spark):
    inf, nan = float("inf"), float("nan")
    groups = {0: [nan, 1.0], 1: [inf], 2: [1e300, 1.0], 3: [2.0**103], 4: [1.0], 5: [-1e300], 6: [-inf], 7: [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double").groupBy("k").agg(A.sum_key(F.col("v")).alias("s"))
    assert [r.k for r in df.orderBy(F.col("s").desc()).collect()] == list(groups)


def test_theta_join_compares_neighbours_only(spark, agree):
    """Balances at the edges of cells and beyond them; the nation alone was the key of the join."""
    inf, nan = float("inf"), float("nan")
    balances = [0.0, -0.0, 1.0, -1.0, 2.0, 3.0, 0.9999999999, 1.0000000001, -999.85, 9999.8, 1e15, 1e15 + 1, 9e15, 1e16 + 2, 1e17, -1e17, 1e300, -1e300, inf, -inf, nan, None]
    balances += [k * 0.37 for k in range(200)]
    customers = spark.createDataFrame([(k, n, b) for k, (n, b) in enumerate((n, b) for n in (1, 2, None) for b in balances)], "c_custkey long, c_nationkey int, c_acctbal double")
    suppliers = spark.createDataFrame([(k, n, b) for k, (n, b) in enumerate((n, b) for n in (2, 3, None) for b in reversed(balances))], "s_suppkey long, s_nationkey int, s_acctbal double")
    assert len(agree("theta_join", customer=customers, supplier=suppliers)) > 1000


def test_near_join(spark, tmp_path):
    spark.range(3000).selectExpr("id AS c_custkey", "1 AS c_nationkey", "id * 0.1 AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3000).selectExpr("id AS s_suppkey", "1 AS s_nationkey", "id * 0.1 AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    df = QUERIES["theta_join"](spark, str(tmp_path))
    got = df.agg(F.count("*"), F.max(F.abs(df.s_suppkey - df.c_custkey))).first()
    assert got[1] == 10 and 3000 * 19 < got[0] <= 3000 * 21
    assert "__cell" in df._jdf.queryExecution().executedPlan().toString()
    db = Database(spark, str(tmp_path))
    with pytest.raises(ValueError):
        db.select(Supplier.s_suppkey).join(Customer, "left", Supplier.nation == Customer.nation, near=(Customer.c_acctbal, Supplier.s_acctbal, 1))
    with pytest.raises(ValueError):
        db.select(Supplier.s_suppkey).join(Customer, on=Supplier.nation == Customer.nation, near=(Customer.c_acctbal, Supplier.s_acctbal, 0))
    narrow = db.select(Supplier.s_suppkey, Customer.c_custkey).join(Customer, on=Supplier.nation == Customer.nation, near=(Customer.c_acctbal, Supplier.s_acctbal, 0.01))
    assert narrow.count() == 3000


LINES = "l_orderkey long, l_linenumber int, l_suppkey long, l_discount double, l_quantity double, l_returnflag string"


def lines(n):
    return [(k % (n // 9), k, k % 7, k % 11 / 100, None if k % 5 == 0 else float(k % 50), (None, "A", "N", "R")[k * 7 % 13 % 4]) for k in range(n)]


def test_exclude_frames_sorts_once_in_tasks_that_stay_small(spark, agree, tmp_path, monkeypatch):
    tasks = []
    for n in (900, 9000):
        df = spark.createDataFrame(lines(n), LINES)
        agree("exclude_frames", lineitem=df)
        size = sum(f.stat().st_size for f in (tmp_path / "lineitem.parquet").glob("*.parquet"))
        monkeypatch.setattr(windows, "SPREAD_BYTES", 2048)
        plan = QUERIES["exclude_frames"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        tasks.append(int(re.search(r"hashpartitioning\(l_orderkey#\d+L, (\d+)\)", plan)[1]))
        assert plan.count("Exchange ") == plan.count("Sort [") == 1 and tasks[-1] >= size / 2048
    assert tasks[1] > tasks[0]


def test_spread_of_tables_of_unknown_size(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(30)], "k int, v int")
    got = windows.spread(df, F.col("k"))
    assert got.count() == 30 and "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
