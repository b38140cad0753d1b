"""Field types, models and the graph of foreign keys."""

from __future__ import annotations

import datetime as dt
import decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import Expr


class Field:
    """A model's column: its Spark type, key and default, and conversion of plain values."""

    spark_type: T.DataType = T.StringType()

    def __init__(self, *, null: bool = False, default: Any = None, primary_key: bool = False, unique: bool = False, column_name: str | None = None, choices: Any = None):
        self.null, self.default, self.primary_key, self.unique = null, default, primary_key, unique
        self.column_name, self.choices = column_name, choices
        self.name = ""
        self.model: type[Model] | None = None

    def bind(self, model, name: str) -> None:
        self.model, self.name = model, name
        self.column_name = self.column_name or name

    def convert(self, value: Any) -> Any:
        return value

    def literal(self, value: Any) -> Column:
        return F.lit(self.convert(value)).cast(self.spark_type)

    def default_value(self) -> Any:
        return self.default() if callable(self.default) else self.default


class AnyField(Field):
    """Untyped values, kept as variants."""

    spark_type = T.VariantType()

    def literal(self, value):
        return F.lit(value)


class IntegerField(Field):
    spark_type: T.DataType = T.IntegerType()

    def convert(self, value):
        try:
            return value if value is None else int(value)
        except (TypeError, ValueError):
            return value

    def literal(self, value):
        v = self.convert(value)
        return F.lit(v).cast(self.spark_type) if isinstance(v, int) else F.lit(v)


class BigIntegerField(IntegerField):
    spark_type = T.LongType()


class SmallIntegerField(IntegerField):
    spark_type = T.ShortType()


class AutoField(BigIntegerField):
    def __init__(self, **options):
        super().__init__(**options | {"primary_key": True})


class DoubleField(Field):
    spark_type = T.DoubleType()

    def convert(self, value):
        return value if value is None else float(value)


FloatField = DoubleField


class DecimalField(Field):
    def __init__(self, max_digits: int = 10, decimal_places: int = 5, auto_round: bool = False, **options):
        super().__init__(**options)
        self.spark_type, self.places, self.auto_round = T.DecimalType(max_digits, decimal_places), decimal_places, auto_round

    def convert(self, value):
        if not value:
            return value if value is None else decimal.Decimal(0)
        value = decimal.Decimal(str(value))
        return value.quantize(decimal.Decimal(1).scaleb(-self.places)) if self.auto_round else value


class CharField(Field):
    def __init__(self, max_length: int = 255, **options):
        super().__init__(**options)
        self.max_length = max_length

    def convert(self, value):
        return value if value is None else str(value)


class FixedCharField(CharField):
    def convert(self, value):
        return value if value is None else str(value).strip()[: self.max_length].strip()


class TextField(Field):
    def convert(self, value):
        return value if value is None else str(value)


class BlobField(Field):
    spark_type = T.BinaryType()

    def convert(self, value):
        return value.encode() if isinstance(value, str) else value


class BooleanField(Field):
    spark_type = T.BooleanType()

    def convert(self, value):
        return value if value is None else bool(value)


class DateTimeField(Field):
    spark_type = T.TimestampNTZType()
    formats = ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d")

    def convert(self, value):
        if isinstance(value, str):
            for f in self.formats:
                try:
                    return self.shape(dt.datetime.strptime(value, f))
                except ValueError:
                    continue
        return self.shape(value) if isinstance(value, dt.datetime) else value

    def shape(self, value):
        return value

    def literal(self, value):
        v = self.convert(value)
        # through text, so that a naive time stays naive
        return F.lit(v.isoformat(" ") if isinstance(v, (dt.datetime, dt.date)) else v).cast(self.spark_type)


class DateField(DateTimeField):
    spark_type = T.DateType()

    def shape(self, value):
        return value.date() if isinstance(value, dt.datetime) else value


class TimeField(Field):
    """Time of day in microseconds."""

    spark_type = T.LongType()

    def convert(self, value):
        if isinstance(value, dt.timedelta):
            return value // dt.timedelta(microseconds=1)
        if isinstance(value, dt.time):
            return ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond
        return value


class TimestampField(Field):
    """Integer ticks since the epoch; ``resolution`` ticks a second (2 to 6: that power of ten)."""

    spark_type = T.LongType()

    def __init__(self, resolution: int = 1, **options):
        super().__init__(**options)
        self.resolution = 10**resolution if 2 <= resolution <= 6 else max(1, resolution)

    def convert(self, value):
        if isinstance(value, dt.datetime):
            epoch = value.replace(tzinfo=value.tzinfo or dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
            return epoch // dt.timedelta(microseconds=1) * self.resolution // 1_000_000
        return value


class UUIDField(TextField):
    def convert(self, value):
        return value if value is None else getattr(value, "hex", str(value).replace("-", ""))


class IPField(BigIntegerField):
    """IPv4 as a big-endian unsigned number."""

    def convert(self, value):
        if isinstance(value, str):
            a, b, c, d = map(int, value.split("."))
            return a << 24 | b << 16 | c << 8 | d
        return value


class BitField(BigIntegerField):
    """Flags in a long: ``flag(v)`` is a predicate; set and clear give the changed number."""


class JSONField(Field):
    """Any JSON value, kept as text."""


class ArrayField(Field):
    def __init__(self, element: Field | None = None, dimensions: int = 1, **options):
        super().__init__(**options)
        kind: T.DataType = (element or IntegerField()).spark_type
        for _ in range(dimensions):
            kind = T.ArrayType(kind)
        self.spark_type = kind


class MapField(Field):
    spark_type = T.MapType(T.StringType(), T.StringType())


class ForeignKeyField(Field):
    def __init__(self, target: Any, *, backref: str | None = None, to_field: str | None = None, **options):
        super().__init__(**options)
        self.target, self.backref, self.to_field = target, backref, to_field

    def bind(self, model, name):
        if self.target == "self":
            self.target = model
        super().bind(model, name)
        self.rel_field = self.target._fields[self.to_field] if self.to_field else self.target.primary_key()
        self.spark_type = self.rel_field.spark_type

    def convert(self, value):
        return self.rel_field.convert(value)


class ModelMeta(type):
    def __new__(mcs, name, bases, attrs):
        fields = {k: v for base in bases for k, v in getattr(base, "_fields", {}).items()}
        own = {k: v for k, v in attrs.items() if isinstance(v, Field)}
        cls = super().__new__(mcs, name, bases, {k: v for k, v in attrs.items() if k not in own})
        cls._fields = {**fields, **own}
        cls._table = attrs.get("table", name.lower())
        cls._alias = cls._table
        for k, f in own.items():
            f.bind(cls, k)
        if own:
            REGISTRY[cls._table] = cls
        return cls

    def __getattr__(cls, name):
        fields = type.__getattribute__(cls, "_fields")
        if name in fields:
            return FieldRef(fields[name], cls)
        raise AttributeError(name)


REGISTRY: dict[str, type[Model]] = {}


class FieldRef(Expr):
    """A field of a model or of one of its aliases."""

    __slots__ = ("field", "source")
    __hash__ = object.__hash__

    def __init__(self, field: Field, source):
        super().__init__(F.col(f"`{source._alias}`.`{field.column_name}`"), field.column_name, field)
        self.field, self.source = field, source

    def alias(self, name: str | None) -> FieldRef:
        out = FieldRef(self.field, self.source)
        out.name = name
        return out

    def flag(self, bit: int) -> Expr:
        return Expr(self.column.bitwiseAND(F.lit(bit).cast("long")) != 0)

    def set(self, bit: int) -> Expr:
        return Expr(self.column.bitwiseOR(F.lit(bit).cast("long")))

    def clear(self, bit: int) -> Expr:
        return Expr(self.column.bitwiseAND(F.bitwise_not(F.lit(bit).cast("long"))))


class Model(metaclass=ModelMeta):
    """A table with declared fields; attributes are column expressions."""

    _fields: dict[str, Field] = {}
    _table = ""
    _alias = ""

    @classmethod
    def primary_key(cls) -> Field:
        return next(f for f in cls._fields.values() if f.primary_key)

    @classmethod
    def keys(cls) -> list[Field]:
        return [f for f in cls._fields.values() if f.primary_key]

    @classmethod
    def foreign_keys(cls) -> list[ForeignKeyField]:
        return [f for f in cls._fields.values() if isinstance(f, ForeignKeyField)]

    @classmethod
    def columns(cls) -> list[FieldRef]:
        return [FieldRef(f, cls) for f in cls._fields.values()]

    @classmethod
    def schema(cls) -> T.StructType:
        return T.StructType([T.StructField(f.column_name, f.spark_type, True) for f in cls._fields.values()])

    @classmethod
    def alias(cls, name: str) -> ModelAlias:
        return ModelAlias(cls, name)


class ModelAlias:
    """A second reference to a model."""

    def __init__(self, model: type[Model], name: str):
        self._model, self._alias, self._table, self._fields = model, name, model._table, model._fields

    def __getattr__(self, name):
        if name in self._fields:
            return FieldRef(self._fields[name], self)
        return getattr(self._model, name)

    def columns(self) -> list[FieldRef]:
        return [FieldRef(f, self) for f in self._fields.values()]


def base(source) -> type[Model]:
    return getattr(source, "_model", source)


def join_condition(left, right, on=None) -> Expr:
    """The predicate along the one foreign key between two sources; ``on`` names it if there are several."""
    found = []
    for a, b in ((left, right), (right, left)):
        for f in base(a).foreign_keys():
            if f.target is base(b) and (on is None or f.name == on):
                found.append(FieldRef(f, a) == FieldRef(f.rel_field, b))
        if base(left) is base(right):
            break
    if len(found) != 1:
        raise ValueError(f"{len(found)} foreign keys between {left._alias} and {right._alias}")
    return found[0]


def sorted_models(models) -> list[type[Model]]:
    """Every model after the ones it refers to."""
    out: list[type[Model]] = []

    def visit(m):
        if m not in out:
            for f in m.foreign_keys():
                if f.target is not m and f.target in models and f.target not in out:
                    visit(f.target)
            if m not in out:
                out.append(m)

    for m in models:
        visit(m)
    return out


def dependents(model: type[Model]) -> list[tuple[type[Model], ForeignKeyField]]:
    """Models that refer to ``model``, directly or through others, nearest first."""
    out, queue, seen = [], [model], {model}
    while queue:
        target = queue.pop(0)
        for m in REGISTRY.values():
            for f in m.foreign_keys():
                if f.target is target:
                    out.append((m, f))
                    if m not in seen:
                        seen.add(m)
                        queue.append(m)
    return out


def schema_diff(model: type[Model], actual: T.StructType) -> dict[str, list]:
    """Columns missing from a table, unknown to the model, or of another type."""
    want, have = {f.name: f.dataType for f in model.schema()}, {f.name: f.dataType for f in actual}
    return {
        "missing": sorted(set(want) - set(have)),
        "unknown": sorted(set(have) - set(want)),
        "changed": sorted(k for k in set(want) & set(have) if want[k] != have[k]),
    }


def reflect(name: str, actual: T.StructType, primary_key: str | None = None) -> type[Model]:
    """A model made from a table's schema."""
    kinds = {T.IntegerType: IntegerField, T.LongType: BigIntegerField, T.ShortType: SmallIntegerField, T.DoubleType: DoubleField, T.BooleanType: BooleanField, T.BinaryType: BlobField, T.DateType: DateField, T.TimestampNTZType: DateTimeField, T.TimestampType: DateTimeField}
    fields: dict[str, Any] = {}
    for f in actual:
        fields[f.name] = kinds.get(type(f.dataType), TextField)(primary_key=f.name == primary_key)
        fields[f.name].spark_type = f.dataType
    return ModelMeta(name, (Model,), {"table": name, **fields})
