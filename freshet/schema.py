"""Records, keys and column types: from Python classes to Spark schemas and to the types of target stores."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import ipaddress
import types
import typing
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclasses.dataclass(frozen=True)
class VectorSchema:
    """Number of dimensions and element type of a vector column."""

    size: int
    dtype: str = "float32"


@dataclasses.dataclass(frozen=True)
class SparkType:
    """An annotation that sets a column's Spark type by its DDL name."""

    ddl: str


_LEAVES: dict[type, T.DataType] = {
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    decimal.Decimal: T.DecimalType(38, 18),
    str: T.StringType(),
    bytes: T.BinaryType(),
    uuid.UUID: T.StringType(),
    dt.datetime: T.TimestampType(),
    dt.date: T.DateType(),
    dt.time: T.StringType(),
    dt.timedelta: T.DayTimeIntervalType(),
    **{c: T.StringType() for c in (ipaddress.IPv4Address, ipaddress.IPv6Address, ipaddress.IPv4Network, ipaddress.IPv6Network)},
}
_NUMPY = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double"}


def _fields(cls: type) -> list[tuple[str, object]] | None:
    hints = lambda: typing.get_type_hints(cls, include_extras=True)
    if dataclasses.is_dataclass(cls):
        return [(f.name, hints()[f.name]) for f in dataclasses.fields(cls)]
    if isinstance(cls, type) and issubclass(cls, tuple) and hasattr(cls, "_fields"):
        return [(n, hints()[n]) for n in cls._fields]
    if hasattr(cls, "model_fields"):
        return [(n, hints()[n]) for n in cls.model_fields]
    return None


def spark_type(hint: object) -> tuple[T.DataType, bool, dict]:
    """(type, nullable, metadata) of an annotation. Unions of several types and Any are kept as JSON in a string."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin is typing.Annotated:
        for extra in args[1:]:
            if isinstance(extra, SparkType):
                return T._parse_datatype_string(extra.ddl), False, {}
            if isinstance(extra, VectorSchema):
                inner = T.DoubleType() if extra.dtype == "float64" else T.FloatType()
                return T.ArrayType(inner, False), False, {"dim": extra.size, "dtype": extra.dtype}
        return spark_type(args[0])
    if origin in (typing.Union, types.UnionType):
        some = [a for a in args if a is not type(None)]
        if len(some) == 1:
            kind, _, meta = spark_type(some[0])
            return kind, len(some) < len(args), meta
        return T.StringType(), len(some) < len(args), {"json": True}
    if hint in _LEAVES:
        return _LEAVES[hint], False, {}
    if getattr(hint, "__module__", "") == "numpy" and getattr(hint, "__name__", "") in _NUMPY:
        return T._parse_datatype_string(_NUMPY[hint.__name__]), False, {}
    if origin in (list, tuple, set, frozenset) or hint in (list, tuple, set, frozenset):
        inner, null, _ = spark_type(args[0]) if args else (T.StringType(), True, {})
        return T.ArrayType(inner, null), False, {}
    if origin is dict:
        key, _, _ = spark_type(args[0])
        value, null, _ = spark_type(args[1])
        return T.MapType(key, value, null), False, {}
    if _fields(hint) is not None:
        return record_schema(hint), False, {}
    return T.StringType(), True, {"json": True}


def record_schema(cls: type, primary_key: tuple[str, ...] = ()) -> T.StructType:
    """The Spark schema of a record class (dataclass, NamedTuple or pydantic model); key columns are marked in the metadata."""
    found = _fields(cls)
    if found is None:
        raise TypeError(f"{cls} is no record class")
    missing = set(primary_key) - {n for n, _ in found}
    if missing:
        raise ValueError(f"primary key has unknown columns: {sorted(missing)}")
    out = []
    for name, hint in found:
        kind, null, meta = spark_type(hint)
        out.append(T.StructField(name, kind, null and name not in primary_key, meta | ({"primary_key": primary_key.index(name)} if name in primary_key else {})))
    return T.StructType(out)


def primary_key(schema: T.StructType) -> list[str]:
    marked = [(f.metadata["primary_key"], f.name) for f in schema.fields if "primary_key" in f.metadata]
    return [n for _, n in sorted(marked)]


#: Column types of target stores by Spark type: fixed values.
STORE_TYPES = {
    "postgres": {"boolean": "boolean", "tinyint": "smallint", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision", "decimal": "numeric", "string": "text", "binary": "bytea", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp", "interval": "interval", "json": "jsonb"},
    "sqlite": {"boolean": "INTEGER", "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL", "decimal": "TEXT", "string": "TEXT", "binary": "BLOB", "date": "TEXT", "timestamp": "TEXT", "timestamp_ntz": "TEXT", "interval": "REAL", "json": "TEXT"},
    "snowflake": {"boolean": "BOOLEAN", "tinyint": "NUMBER", "smallint": "NUMBER", "int": "NUMBER", "bigint": "NUMBER", "float": "FLOAT", "double": "FLOAT", "decimal": "NUMBER", "string": "VARCHAR", "binary": "BINARY", "date": "DATE", "timestamp": "TIMESTAMP_TZ", "timestamp_ntz": "TIMESTAMP_TZ", "interval": "NUMBER", "json": "VARIANT"},
    "bigquery": {"boolean": "BOOL", "tinyint": "INT64", "smallint": "INT64", "int": "INT64", "bigint": "INT64", "float": "FLOAT64", "double": "FLOAT64", "decimal": "NUMERIC", "string": "STRING", "binary": "BYTES", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "interval": "FLOAT64", "json": "JSON"},
    "doris": {"boolean": "BOOLEAN", "tinyint": "BIGINT", "smallint": "BIGINT", "int": "BIGINT", "bigint": "BIGINT", "float": "DOUBLE", "double": "DOUBLE", "decimal": "TEXT", "string": "TEXT", "binary": "STRING", "date": "DATE", "timestamp": "DATETIME(6)", "timestamp_ntz": "DATETIME(6)", "interval": "DOUBLE", "json": "JSON"},
}


def store_type(field: T.StructField, store: str) -> str:
    """A column's type in a target store; lists, maps and records are JSON there, vectors of postgres are vector(n)."""
    kinds = STORE_TYPES[store]
    if "dim" in field.metadata and store == "postgres":
        return f"{'halfvec' if field.metadata['dtype'] == 'float16' else 'vector'}({field.metadata['dim']})"
    if "dim" in field.metadata and store == "sqlite":
        return f"float[{field.metadata['dim']}]"
    name = field.dataType.simpleString().split("(")[0].split("<")[0]
    if name.startswith("interval"):
        name = "interval"
    return kinds["json"] if name in ("array", "map", "struct", "variant") or field.metadata.get("json") else kinds[name]


def evolve(old: T.StructType, new: T.StructType) -> dict[str, list[str] | bool]:
    """What changes between two schemas: added, dropped and altered columns; `recreate` if the primary key changes."""
    a, b = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}
    shape = lambda f: (f.dataType.simpleString(), f.nullable, f.metadata.get("dim"))
    keys = lambda s: [(n, s[n].dataType.simpleString()) for n in primary_key(s)]
    return {"added": sorted(b.keys() - a.keys()), "dropped": sorted(a.keys() - b.keys()), "altered": sorted(n for n in a.keys() & b.keys() if shape(a[n]) != shape(b[n])), "recreate": keys(old) != keys(new)}


def finite(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose floats are all finite, the others): NaN and infinities must not reach a target."""
    bad: Column = F.lit(False)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.FloatType | T.DoubleType):
            bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType | T.DoubleType):
            bad = bad | F.coalesce(F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return df.where(~bad), df.where(bad)


def require_identifier(name: str) -> str:
    """`name`, if letters, digits and underscores make it up and no digit begins it."""
    import re

    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name
