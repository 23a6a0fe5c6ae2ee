"""Selectors over documents held as VARIANT, where null, missing and every type stay apart.

An array matches a condition if any of its elements does, or, for equality, if it is equal as a whole. Nothing is
coerced: a condition on another type than a value's own doesn't hold for it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.values import flags_of

Test = Callable[[Column], Column]


def at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, "$." + path if path else "$", "variant")


def tag(v: Column) -> Column:
    return F.schema_of_variant(v)


def number(v: Column) -> Column:
    t = tag(v)
    return (t == "BIGINT") | (t == "DOUBLE") | t.startswith("DECIMAL")


def sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def elements(v: Column) -> Column:
    """The elements of an array value; NULL for any other."""
    return F.try_variant_get(F.when(tag(v).startswith("ARRAY"), v), "$", "array<variant>")


def any_of(v: Column, test: Test) -> Column:
    return sure(test(v)) | sure(F.exists(elements(v), lambda e: sure(test(e))))


def equal(value: Any) -> Test:
    """Type-strict equality; None matches null and missing."""

    def test(v: Column) -> Column:
        if value is None:
            return v.isNull() | F.is_variant_null(v)
        if isinstance(value, re.Pattern):
            return regex(value.pattern, flags_of(value))(v)
        if isinstance(value, bool):
            return (tag(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value)
        if isinstance(value, (int, float)):
            return number(v) & (F.try_variant_get(v, "$", "double") == float(value))
        if isinstance(value, str):
            return (tag(v) == "STRING") & (F.try_variant_get(v, "$", "string") == value)
        return F.to_json(v) == json.dumps(value, separators=(",", ":"), ensure_ascii=False)

    return test


def order(op: str, x: Any) -> Test:
    kind = "string" if isinstance(x, str) else "double"
    method = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}[op]
    return lambda v: (tag(v) == "STRING" if kind == "string" else number(v)) & getattr(F.try_variant_get(v, "$", kind), method)(F.lit(x).cast(kind))


def regex(pattern: str, options: str = "") -> Test:
    if bad := set(options) - set("imsx"):
        raise ValueError(f"unsupported regular expression options: {''.join(sorted(bad))}")
    return lambda v: (tag(v) == "STRING") & F.try_variant_get(v, "$", "string").rlike(f"(?{options}){pattern}" if options else pattern)


def remainder(divisor: int, rest: int) -> Test:
    return lambda v: number(v) & (F.try_variant_get(v, "$", "double") % divisor == rest)


def matching(condition: dict[str, Any]) -> Test:
    """A condition on an array's element: operators on itself, or a selector on its fields."""
    plain = all(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in condition)
    return lambda e: field(e, condition) if plain else compile_on(e, condition)


def field(v: Column, condition: dict[str, Any]) -> Column:
    """All operators of a condition on one value."""
    parts = []
    for op, x in condition.items():
        if op == "$exists":
            parts.append(v.isNotNull() if x else v.isNull())
        elif op in ("$eq", "$ne"):
            hit = any_of(v, equal(x))
            parts.append(hit if op == "$eq" else ~hit)
        elif op in ("$in", "$nin"):
            hit = reduce(lambda a, b: a | b, [any_of(v, equal(y)) for y in x], F.lit(False))
            parts.append(hit if op == "$in" else ~hit)
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            parts.append(any_of(v, order(op, x)))
        elif op == "$not":
            parts.append(~(field(v, x) if isinstance(x, dict) else any_of(v, equal(x))))
        elif op == "$regex":
            own = (x.pattern, flags_of(x)) if isinstance(x, re.Pattern) else (x, "")
            parts.append(any_of(v, regex(own[0], condition.get("$options", own[1]))))
        elif op == "$options":
            if "$regex" not in condition:
                raise ValueError("$options needs $regex")
        elif op == "$mod":
            parts.append(any_of(v, remainder(int(x[0]), int(x[1]))))
        elif op == "$size":
            parts.append(sure(F.size(elements(v)) == x))
        elif op == "$all":
            parts.append(reduce(lambda a, b: a & b, [field(v, y) if isinstance(y, dict) and any(k.startswith("$") for k in y) else any_of(v, equal(y)) for y in x]) if x else F.lit(False))
        elif op == "$elemMatch":
            parts.append(sure(F.exists(elements(v), matching(x))))
        elif op == "$type":
            parts.append(sure(tag(v).startswith({"string": "STRING", "bool": "BOOLEAN", "array": "ARRAY", "object": "OBJECT", "null": "VOID"}[x]) if x != "number" else number(v)))
        else:
            raise ValueError(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compile_on(doc: Column, selector: dict[str, Any] | None) -> Column:
    parts = []
    for key, v in (selector or {}).items():
        if key in ("$and", "$or", "$nor"):
            inner = [compile_on(doc, s) for s in v]
            joined = reduce(lambda a, b: a & b, inner) if key == "$and" else reduce(lambda a, b: a | b, inner)
            parts.append(~joined if key == "$nor" else joined)
        elif isinstance(v, dict) and v and all(k.startswith("$") for k in v):
            parts.append(field(at(doc, key), v))
        else:
            parts.append(any_of(at(doc, key), equal(v)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compile_dynamic(selector: dict[str, Any] | None, doc: str = "doc") -> Column:
    return compile_on(F.col(doc), selector)
