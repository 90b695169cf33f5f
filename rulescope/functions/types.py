"""The smallest type that holds the values of two: a lattice of Spark types.

Whole numbers widen to larger ones, with fractions to DOUBLE, decimals to
decimals of more digits, dates to timestamps, flags to the numbers 0 and 1;
nested types widen part by part.  Text is above everything.  Every cast to a
common type succeeds under ANSI rules.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Decimal digits of the whole types, in the same order.
_DIGITS = (3, 5, 10, 20)
_MAX_DIGITS = 38


def _rank(t: T.DataType) -> int:
    return _WHOLE.index(type(t))


def _as_decimal(t: T.DataType) -> T.DecimalType:
    return t if isinstance(t, T.DecimalType) else T.DecimalType(_DIGITS[_rank(t)], 0)


def _number(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=_rank)
    fractions = (T.FloatType, T.DoubleType)
    if isinstance(a, fractions) or isinstance(b, fractions):
        return T.DoubleType()
    a, b = _as_decimal(a), _as_decimal(b)
    scale = max(a.scale, b.scale)
    digits = max(a.precision - a.scale, b.precision - b.scale) + scale
    return T.DecimalType(digits, scale) if digits <= _MAX_DIGITS else T.DoubleType()


def _struct(a: T.StructType, b: T.StructType) -> T.DataType:
    if a.names != b.names:
        return T.StringType()
    fields = zip(a.fields, b.fields, strict=True)
    return T.StructType([T.StructField(x.name, common_type(x.dataType, y.dataType), x.nullable or y.nullable) for x, y in fields])


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that both ``a`` and ``b`` can be cast to without loss
    of meaning (whole numbers and decimals become DOUBLE next to fractions or
    beyond 38 digits)."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.BooleanType) and isinstance(b, T.NumericType):
        return b
    if isinstance(b, T.BooleanType) and isinstance(a, T.NumericType):
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return _number(a, b)
    times = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, times) and isinstance(b, times):
        return max(a, b, key=lambda t: times.index(type(t)))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, common_type(a.valueType, b.valueType), a.valueContainsNull or b.valueContainsNull)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return _struct(a, b)
    return T.StringType()


def common_types(schemas: Iterable[T.StructType]) -> dict[str, T.DataType]:
    """Common type of every column, by lower-cased name (Spark's own rule)."""
    found: dict[str, list[T.DataType]] = {}
    for schema in schemas:
        for field in schema.fields:
            found.setdefault(field.name.lower(), []).append(field.dataType)
    return {name: reduce(common_type, types) for name, types in found.items()}
