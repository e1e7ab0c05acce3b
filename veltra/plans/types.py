"""SQL types to Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from veltra.dialect import tree as t
from veltra.errors import PlannerError

SQL_TYPES: dict[str, T.DataType] = {
    "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "SMALLINT": T.ShortType(), "TINYINT": T.ByteType(),
    "BOOLEAN": T.BooleanType(), "DOUBLE": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(), "DOUBLE PRECISION UNSIGNED": T.DoubleType(),
    "FLOAT": T.FloatType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(),
    "VARCHAR": T.StringType(), "CHAR": T.StringType(), "UUID": T.StringType(), "STRING": T.StringType(),
}
#: Cast targets that the surveyed planner knows.
STRICT_CASTS = frozenset({"INT", "BOOLEAN", "DOUBLE", "VARCHAR"})


def spark_type(kind: t.DataType) -> T.DataType:
    if kind.name not in SQL_TYPES:
        raise PlannerError(f"unsupported data type {kind.name}")
    return SQL_TYPES[kind.name]


def cast_type(kind: t.DataType, strict: bool) -> T.DataType:
    if strict and kind.name not in STRICT_CASTS:
        raise PlannerError(f"unsupported cast target {kind.name}")
    return spark_type(kind)


def literal_type(literal: t.Literal) -> T.DataType | None:
    """None for NULL, which fits any column."""
    return {"integer": T.IntegerType(), "long": T.LongType(), "decimal": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "null": None}[literal.kind]


WIDER = {T.IntegerType: (T.LongType, T.FloatType, T.DoubleType, T.ShortType, T.ByteType), T.LongType: (T.FloatType, T.DoubleType, T.IntegerType), T.DoubleType: (T.FloatType,), T.StringType: (T.DateType, T.TimestampNTZType)}


def fits(literal: t.Literal, column: T.DataType, strict: bool) -> bool:
    own = literal_type(literal)
    if own is None or type(own) is type(column):
        return True
    return not strict and type(column) in WIDER.get(type(own), ())
