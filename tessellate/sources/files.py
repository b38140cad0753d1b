"""CSV, TSV and JSON in and out, and tables whose columns follow their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True, sep: str = ",", strict: bool = False, multi_line: bool = True) -> DataFrame:
    """With a schema its types are declared; empty fields are NULL except in text. Strict: unknown columns
    are an error, and so are values that aren't of their type, which else are NULL. Without
    ``multi_line`` no field may hold a line's end, and a large file is read by many tasks."""
    options = {"header": header, "sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line, "emptyValue": "", "nullValue": "\x00"}
    df = spark.read.options(**options).csv(path)
    if schema is None:
        return df if header else df.toDF(*(f"field_{k + 1}" for k in range(len(df.columns))))
    if not header:
        df = df.toDF(*(f.name for f in schema))
    known = {f.name: f.dataType for f in schema}
    if unknown := [c for c in df.columns if c not in known]:
        if strict:
            raise ValueError(f"unknown columns: {unknown}")
    out = []
    for c in df.columns:
        kind = known.get(c, T.StringType())
        text = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        typed = F.nullif(text, F.lit(""))
        out.append((text if isinstance(kind, T.StringType) else typed.cast(kind) if strict else typed.try_cast(kind)).alias(c))
    return df.select(*out)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True, strict: bool = False, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, schema, header, "\t", strict, multi_line)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """A list of objects, or an object a line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def exportable(df: DataFrame, iso: bool = False, base64: bool = False) -> DataFrame:
    """Columns as text-friendly values: times by blank or T, bytes as hex or base64, nested ones as JSON."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.base64(c) if base64 else F.lower(F.hex(c))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" if iso else "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.DecimalType, T.DateType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", iso: bool = False, base64: bool = False) -> None:
    exportable(df, iso, base64).write.mode("overwrite").options(header=header, sep=sep, quote='"', escape='"', emptyValue="").csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    write_csv(df, path, header, "\t")


def write_json(df: DataFrame, path: str, iso: bool = False, base64: bool = False) -> None:
    """An object a line: the form that many tasks can write."""
    simple = [f.name for f in df.schema if isinstance(f.dataType, (T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.DateType))]
    shaped = exportable(df.select(*simple), iso, base64) if simple else None
    if shaped is not None:
        changed = {c: _one(df.schema[c], iso, base64) for c in simple}
        df = df.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in df.columns))
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _one(f: T.StructField, iso: bool, base64: bool):
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.BinaryType):
        return F.base64(c) if base64 else F.lower(F.hex(c))
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" if iso else "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def json_array(df: DataFrame) -> str:
    """One JSON array of a small result."""
    return "[" + ",".join(r[0] for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()) + "]"


class DynamicTable:
    """A table whose columns appear with its rows; types are inferred from values."""

    def __init__(self, spark: SparkSession, df: DataFrame | None = None):
        self.spark, self.df = spark, df

    def insert(self, **values) -> None:
        self.insert_many([values])

    def insert_many(self, rows: list[dict]) -> None:
        names = list(dict.fromkeys(k for r in rows for k in r))
        known = {f.name: f.dataType for f in self.df.schema} if self.df is not None else {}
        sample = {n: next((r[n] for r in rows if r.get(n) is not None), None) for n in names}
        kinds = [T.StructField(n, known.get(n) or (T.StringType() if sample[n] is None else self.spark.createDataFrame([(sample[n],)], [n]).schema[0].dataType), True) for n in names]
        new = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], T.StructType(kinds))
        self.df = new if self.df is None else self.df.unionByName(new, allowMissingColumns=True)

    @property
    def columns(self) -> list[str]:
        return [] if self.df is None else self.df.columns

    def _match(self, query: dict):
        df = self.df
        for k, v in query.items():
            df = df.where(F.col(k).isNull() if v is None else F.col(k) == v)
        return df

    def find(self, **query) -> DataFrame:
        return self._match(query)

    def find_one(self, **query):
        return self._match(query).limit(1).first()

    def all(self) -> DataFrame:
        return self.df

    def update(self, columns: list[str] | None = None, **values) -> None:
        from ..operators.dml import update

        test = F.lit(True)
        for k in columns or []:
            test = test & (F.col(k) == values[k])
        for k, v in values.items():
            if k not in self.columns:
                self.df = self.df.withColumn(k, F.lit(None).cast(self.spark.createDataFrame([(v,)], [k]).schema[0].dataType))
        self.df = update(self.df, {k: v for k, v in values.items() if k not in (columns or [])}, test).table

    def delete(self, **query) -> None:
        from ..operators.dml import delete

        test = F.lit(True)
        for k, v in query.items():
            test = test & (F.col(k) == v)
        self.df = delete(self.df, test).table
