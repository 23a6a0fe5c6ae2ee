"""Modifiers: update documents compiled to column rewrites."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.paths import get, parse
from foliant.functions.values import comparable, equals, literal
from foliant.operators.selector import compile_on, field_pred, is_expression
from foliant.functions.paths import Leaf

OPERATORS = ("$set", "$unset", "$setOnInsert", "$inc", "$mul", "$min", "$max", "$rename", "$currentDate", "$push", "$addToSet", "$pull", "$pullAll", "$pop")


def kind_of(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for s in parse(path) or ["\0"]:
        if isinstance(kind, T.StructType) and s in kind.names:
            kind = kind[s].dataType
        elif isinstance(kind, T.ArrayType) and (s.isdigit() or s == "$[]"):
            kind = kind.elementType
        else:
            return None
    return kind


def rewrite(column: Column, kind: T.DataType, steps: list[str], change: Callable[[Column, T.DataType], Column]) -> Column:
    """``column`` with the value at ``steps`` changed; absent parents are created."""
    if not steps:
        return change(column, kind)
    s, rest = steps[0], steps[1:]
    if isinstance(kind, T.StructType):
        return F.struct(*[(rewrite(column.getField(f.name), f.dataType, rest, change) if f.name == s else column.getField(f.name)).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType) and s == "$[]":
        return F.transform(column, lambda e: rewrite(e, kind.elementType, rest, change))
    if isinstance(kind, T.ArrayType) and s.isdigit():
        i = int(s)
        filled = F.concat(F.coalesce(column, F.array().cast(kind)), F.array_repeat(F.lit(None).cast(kind.elementType), F.greatest(F.lit(0), F.lit(i + 1) - F.coalesce(F.size(column), F.lit(0)))))
        return F.transform(filled, lambda e, k: F.when(k == i, rewrite(e, kind.elementType, rest, change)).otherwise(e))
    raise ValueError(f"no field {s}")


def _numeric(v: Any) -> Any:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise TypeError("a number is needed")
    return v


def _element_test(condition: Any, kind: T.DataType) -> Callable[[Column], Column]:
    def test(e: Column) -> Column:
        if is_expression(condition):
            return field_pred(T.StructType(), "", condition, Leaf(kind, lambda p: p(e), False, e)).pos()
        if isinstance(condition, dict) and isinstance(kind, T.StructType):
            return compile_on(kind, e, condition).pos()
        return equals(e, condition, kind)

    return test


def _push(c: Column, kind: T.ArrayType, v: Any) -> Column:
    spec = v if isinstance(v, dict) and "$each" in v else {"$each": [v]}
    own, new = F.coalesce(c, F.array().cast(kind)), literal(spec["$each"], kind)
    at = spec.get("$position")
    if at is None:
        out = F.concat(own, new)
    else:
        k = F.least(F.lit(at), F.size(own)) if at >= 0 else F.greatest(F.size(own) + at, F.lit(0))
        out = F.concat(F.slice(own, F.lit(1), k), new, F.slice(own, k + 1, F.greatest(F.size(own) - k, F.lit(0))))
    if (sort := spec.get("$sort")) is not None:
        keys = list(sort.items()) if isinstance(sort, dict) else [(None, sort)]

        def order(a: Column, b: Column) -> Column:
            result = F.lit(0)
            for name, way in reversed(keys):
                x, y = (a, b) if name is None else (a.getField(name), b.getField(name))
                result = F.when(x < y, F.lit(-way)).when(x > y, F.lit(way)).when(x.isNull() & y.isNotNull(), F.lit(-way)).when(x.isNotNull() & y.isNull(), F.lit(way)).otherwise(result)
            return result.cast("int")

        out = F.array_sort(out, order)
    if (n := spec.get("$slice")) is not None:
        out = F.slice(out, F.lit(1), F.lit(n)) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n, F.lit(0)) + 1, F.lit(-n))
    return out


def _add_to_set(c: Column, kind: T.ArrayType, v: Any) -> Column:
    out = F.coalesce(c, F.array().cast(kind))
    for x in v["$each"] if isinstance(v, dict) and "$each" in v else [v]:
        item = literal(x, kind.elementType)
        there = F.exists(out, lambda e: e.isNull()) if x is None else F.coalesce(F.array_contains(out, item), F.lit(False))
        out = F.when(there, out).otherwise(F.array_append(out, item))
    return out


def widened(kind: T.DataType, v: Any, product: bool = False) -> T.DataType:
    """The type that holds a column's numbers and a number computed with ``v``; no digit of ``v`` is lost."""
    if isinstance(v, bool) or not isinstance(kind, T.NumericType) or isinstance(kind, T.DoubleType):
        return kind
    if isinstance(kind, T.IntegralType):
        if isinstance(v, int):
            return kind if product or abs(v) < 1 << {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(kind)] else T.LongType()
        return kind if float(v).is_integer() and not product else T.DoubleType()
    if isinstance(v, int):
        return kind
    if isinstance(kind, T.FloatType):
        return T.DoubleType()
    digits = -Decimal(str(v)).as_tuple().exponent
    return T.DoubleType() if product or digits > kind.scale else kind


def _change(op: str, v: Any, now: dt.datetime) -> Callable[[Column, T.DataType], Column]:
    def run(c: Column, kind: T.DataType) -> Column:
        if op in ("$set", "$setOnInsert"):
            if v is not None and not comparable(v, kind):
                raise TypeError(f"{v!r} does not fit {kind.simpleString()}")
            return literal(v, kind).cast(widened(kind, v))
        if op == "$unset":
            return F.lit(None).cast(kind)
        if op == "$inc":
            wide = widened(kind, _numeric(v))
            return (F.coalesce(c, F.lit(0)).cast(wide) + F.lit(v).cast(wide)).cast(wide)
        if op == "$mul":
            wide = widened(kind, _numeric(v), product=isinstance(v, float) and not v.is_integer())
            return (F.coalesce(c, F.lit(0)).cast(wide) * F.lit(v).cast(wide)).cast(wide)
        if op in ("$min", "$max"):
            wide = widened(kind, v)
            if v is not None and not comparable(v, kind):
                raise TypeError(f"{v!r} does not fit {kind.simpleString()}")
            return (F.least if op == "$min" else F.greatest)(c.cast(wide), literal(v, wide).cast(wide))
        if op == "$currentDate":
            return F.lit(now).cast(kind)
        if not isinstance(kind, T.ArrayType):
            raise TypeError(f"{op} needs an array")
        if op == "$push":
            return _push(c, kind, v)
        if op == "$addToSet":
            return _add_to_set(c, kind, v)
        if op == "$pull":
            test = _element_test(v, kind.elementType)
            return F.filter(c, lambda e: ~F.coalesce(test(e), F.lit(False)))
        if op == "$pullAll":
            return F.filter(c, lambda e: ~F.coalesce(F.array_contains(literal(v, kind), e), F.lit(False)))
        return F.when(F.size(c) > 0, F.slice(c, F.lit(1) if v >= 0 else F.lit(2), F.size(c) - 1)).otherwise(c)  # $pop

    return run


def touched(modifier: dict[str, Any]) -> list[str]:
    """Top-level columns that a modifier changes."""
    out: dict[str, None] = {}
    for op, spec in modifier.items():
        for path, v in spec.items():
            out[path.split(".")[0]] = None
            if op == "$rename":
                out[v.split(".")[0]] = None
    return list(out)


def check(modifier: dict[str, Any]) -> None:
    if not isinstance(modifier, dict):
        raise TypeError("a modifier is a dict")
    seen: set[str] = set()
    for op, spec in modifier.items():
        if op not in OPERATORS:
            raise ValueError(f"unknown modifier {op}")
        for path in spec:
            if ".$." in f".{path}.":
                raise ValueError("a bare $ in a path is not supported; $[] stands for all elements")
            for other in seen:
                if other == path or other.startswith(f"{path}.") or path.startswith(f"{other}."):
                    raise ValueError(f"two operators touch {path}")
            seen.add(path)


def columns(modifier: dict[str, Any], schema: T.StructType, now: dt.datetime | None = None) -> dict[str, Column]:
    """New values of the columns that a modifier touches. Unknown columns must be added to the schema first."""
    check(modifier)
    now = now or dt.datetime.now(dt.timezone.utc)
    out = {n: F.col(f"`{n}`") for n in schema.names}
    changed: dict[str, None] = {}

    def apply(path: str, change: Callable[[Column, T.DataType], Column]) -> None:
        steps = parse(path)
        if steps is None or steps[0] not in out:
            raise ValueError(f"no field {path}")
        out[steps[0]] = rewrite(out[steps[0]], schema[steps[0]].dataType, steps[1:], change)
        changed[steps[0]] = None

    for op, spec in modifier.items():
        if op == "$setOnInsert":
            continue
        for path, v in spec.items():
            if op == "$rename":
                value = get(schema, path)  # of the row as it was
                if value is None or kind_of(schema, v) is None:
                    raise ValueError(f"no field {path} or {v}")
                apply(v, lambda c, k, value=value: value.cast(k))
                apply(path, lambda c, k: F.lit(None).cast(k))
            else:
                apply(path, _change(op, v, now))
    return {n: out[n] for n in changed}
