"""A data root, its tables and the queries over them."""

from __future__ import annotations

from typing import Any
from urllib.parse import parse_qsl, urlparse

from pyspark.sql import DataFrame, SparkSession

from .plans.query import NotSupported, Query, Table, listed
from .plans.schema import FieldRef, Model, ModelAlias, reflect

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


class Database:
    """Tables under a folder, in a catalog, or registered by hand; other roots may be attached."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.root, self.tables = spark, root and root.rstrip("/"), dict(tables or {})
        self.attached: dict[str, Database] = {}

    @classmethod
    def connect(cls, url: str, spark: SparkSession | None = None) -> Database:
        """``parquet:///folder?key=value`` or ``catalog:///name``; the rest of the URL is configuration."""
        parts = urlparse(url)
        if parts.scheme not in ("parquet", "catalog"):
            raise ValueError(f"no such source: {parts.scheme}")
        builder = SparkSession.builder
        for k, v in {**CONF, **dict(parse_qsl(parts.query))}.items():
            builder = builder.config(k, v)
        spark = spark or builder.getOrCreate()
        for k, v in parse_qsl(parts.query):
            spark.conf.set(k, v)
        if parts.scheme == "catalog":
            spark.catalog.setCurrentDatabase(parts.path.strip("/") or "default")
            return cls(spark)
        return cls(spark, parts.path)

    def table(self, name: str) -> DataFrame:
        space, _, rest = name.partition(".")
        if rest and space in self.attached:
            return self.attached[space].table(rest)
        if name in self.tables:
            return self.tables[name]
        return self.spark.read.parquet(f"{self.root}/{name}.parquet") if self.root else self.spark.table(name)

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def attach(self, other: Database, name: str) -> None:
        self.attached[name] = other

    def detach(self, name: str) -> bool:
        return self.attached.pop(name, None) is not None

    def views(self, *names: str) -> None:
        """Register tables as temporary views, for queries in SQL."""
        for name in names:
            self.table(name).createOrReplaceTempView(name)

    def get_views(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)

    def get_columns(self, name: str) -> list[tuple[str, str, bool]]:
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.table(name).schema]

    def generate_model(self, name: str, primary_key: str | None = None) -> type[Model]:
        return reflect(name, self.table(name).schema, primary_key)

    def select(self, *items: Any) -> Query:
        """A query over the source of its first field; no item of a model stands for all of them."""
        flat = listed(items)
        sources = [x for x in items if isinstance(x, (ModelAlias, Table)) or isinstance(x, type) and issubclass(x, Model)]
        sources += [x.source for x in flat if isinstance(x, FieldRef)]
        query = Query(self, tuple(x for x in flat if not isinstance(x, Table)), default=len(items) == 1 and len(flat) > 1)
        return query.from_(sources[0]) if sources else query

    def values(self, rows: list[tuple], columns: list[str] | str, alias: str = "v") -> Query:
        """An inline relation."""
        return Query(self, (), self.spark.createDataFrame(rows, columns).alias(alias), alias_=alias)

    def raw(self, text: str, *args: Any, **named: Any) -> DataFrame:
        """SQL with parameters ``?`` or ``:name``."""
        return self.spark.sql(text, args=list(args) or named or None)

    def create_table(self, model: type[Model], name: str | None = None) -> DataFrame:
        """An empty table of a model's columns, in the catalog."""
        self.spark.createDataFrame([], model.schema()).write.saveAsTable(name or model._table)
        return self.spark.table(name or model._table)

    def drop_table(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def truncate_table(self, name: str) -> None:
        self.spark.sql(f"TRUNCATE TABLE {name}")

    def atomic(self):
        raise NotSupported("transactions: DataFrames are snapshots already")

    transaction = savepoint = atomic

    def noop(self, source: Any) -> DataFrame:
        """No row of a source."""
        return self.table(source._table).limit(0)
