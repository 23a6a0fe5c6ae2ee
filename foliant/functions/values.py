"""Literals and equality under document semantics."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def comparable(value: Any, kind: T.DataType) -> bool:
    """Whether a Python value has the type family of a column; nothing is ever coerced across families."""
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float, Decimal)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))
    if isinstance(value, (dt.datetime, dt.date)):
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    if isinstance(value, (bytes, bytearray)):
        return isinstance(kind, T.BinaryType)
    if isinstance(value, dict):
        return isinstance(kind, (T.StructType, T.MapType))
    return isinstance(value, (list, tuple)) and isinstance(kind, T.ArrayType)


def literal(value: Any, kind: T.DataType) -> Column:
    """A typed literal; lists and dicts are built field by field."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array(*[literal(x, kind.elementType) for x in value]).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[literal(value.get(f.name), f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return F.create_map(*[x for k, v in value.items() for x in (literal(k, kind.keyType), literal(v, kind.valueType))]).cast(kind)
    return F.lit(value) if isinstance(kind, T.NumericType) else F.lit(value).cast(kind)


def equals(column: Column, value: Any, kind: T.DataType) -> Column:
    """Whole equality, type-strict: objects by all fields, arrays by all elements. NULL or false where unequal."""
    if value is None:
        return column.isNull()
    if isinstance(value, re.Pattern):
        return matches(column, value.pattern, flags_of(value)) if isinstance(kind, T.StringType) else F.lit(False)
    if not comparable(value, kind):
        return F.lit(False)
    if isinstance(kind, T.StructType):
        if set(value) - set(kind.names):
            return F.lit(False)
        out = column.isNotNull()
        for f in kind.fields:
            own = column.getField(f.name)
            part = F.coalesce(equals(own, value[f.name], f.dataType), F.lit(False)) if f.name in value else own.isNull()
            out = out & part
        return out
    if isinstance(kind, T.ArrayType):
        if any(x is not None and not comparable(x, kind.elementType) for x in value):
            return F.lit(False)
        return column == literal(list(value), kind)
    return column == literal(value, kind)


def flags_of(pattern: re.Pattern) -> str:
    return "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & f)


def matches(column: Column, pattern: str, options: str = "") -> Column:
    """Partial regular-expression match; ^literal without options is a prefix test, which reaches the scan."""
    if bad := set(options) - set("imsx"):
        raise ValueError(f"unsupported regular expression options: {''.join(sorted(bad))}")
    if not options and re.fullmatch(r"\^[A-Za-z0-9 _-]+", pattern):
        return column.startswith(pattern[1:])
    return column.rlike(f"(?{options}){pattern}" if options else pattern)


def same(a: Column, b: Column) -> Column:
    """Deep equality of two values of one type, null equal to null."""
    return a.eqNullSafe(b)


def compact(column: Column, kind: T.ArrayType) -> Column:
    """An array without its empty values: null, false, 0, NaN and the empty string."""

    def full(e: Column) -> Column:
        if isinstance(kind.elementType, T.BooleanType):
            return F.coalesce(e, F.lit(False))
        if isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            return e.isNotNull() & ~F.isnan(e) & (e != 0)
        if isinstance(kind.elementType, T.NumericType):
            return e.isNotNull() & (e != 0)
        return e.isNotNull() & (e != "") if isinstance(kind.elementType, T.StringType) else e.isNotNull()

    return F.filter(column, full)
