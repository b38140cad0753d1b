"""The tables of a data folder as models."""

from __future__ import annotations

from .plans.schema import BigIntegerField, CharField, DateTimeField, DoubleField, ForeignKeyField, IntegerField, JSONField, Model, TextField


class Region(Model):
    table = "region"
    r_regionkey = IntegerField(primary_key=True)
    r_name = CharField()


class Nation(Model):
    table = "nation"
    n_nationkey = IntegerField(primary_key=True)
    n_name = CharField()
    region = ForeignKeyField(Region, backref="nations", column_name="n_regionkey")


class Customer(Model):
    table = "customer"
    c_custkey = BigIntegerField(primary_key=True)
    c_name = CharField()
    nation = ForeignKeyField(Nation, backref="customers", column_name="c_nationkey")
    c_acctbal = DoubleField()
    c_mktsegment = CharField()


class Supplier(Model):
    table = "supplier"
    s_suppkey = BigIntegerField(primary_key=True)
    s_name = CharField()
    nation = ForeignKeyField(Nation, backref="suppliers", column_name="s_nationkey")
    s_acctbal = DoubleField()


class Part(Model):
    table = "part"
    p_partkey = BigIntegerField(primary_key=True)
    p_name = CharField()
    p_brand = CharField()
    p_type = CharField()
    p_size = IntegerField()
    p_retailprice = DoubleField()


class Orders(Model):
    table = "orders"
    o_orderkey = BigIntegerField(primary_key=True)
    customer = ForeignKeyField(Customer, backref="orders", column_name="o_custkey")
    o_orderstatus = CharField()
    o_totalprice = DoubleField()
    o_orderdate = DateTimeField()
    o_orderpriority = CharField()


class Lineitem(Model):
    table = "lineitem"
    order = ForeignKeyField(Orders, backref="lines", column_name="l_orderkey")
    part = ForeignKeyField(Part, backref="lines", column_name="l_partkey")
    supplier = ForeignKeyField(Supplier, backref="lines", column_name="l_suppkey")
    l_linenumber = IntegerField()
    l_quantity = DoubleField()
    l_extendedprice = DoubleField()
    l_discount = DoubleField()
    l_tax = DoubleField()
    l_returnflag = CharField()
    l_linestatus = CharField()
    l_shipdate = DateTimeField()


class Events(Model):
    table = "events"
    event_id = BigIntegerField(primary_key=True)
    ts = DateTimeField()
    user_id = BigIntegerField()
    event_type = CharField()
    value = DoubleField()
    props = JSONField()


class Documents(Model):
    table = "documents"
    doc_id = BigIntegerField(primary_key=True)
    text = TextField()
    lang = CharField()
    source = CharField()
    n_chars = BigIntegerField()
