"""Dotted paths into typed rows.

A path such as ``user.profile.age``, ``items.n`` or ``arr.0`` is resolved against a schema. Steps through an array of
structs fan out: the path then stands for any element. Numeric steps index an array. Unknown paths resolve to None,
which selectors read as "missing everywhere".
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predicate = Callable[[Column], Column]


def parse(path: str) -> list[str] | None:
    """Steps of a dot or bracket path; None if it is malformed."""
    text = re.sub(r"\[(?:'([^']*)'|\"([^\"]*)\"|(\d+))\]", lambda m: "." + (m[1] or m[2] or m[3]), path)
    steps = text.split(".")
    return None if not text or any(s == "" or s != "$[]" and ("[" in s or "]" in s) for s in steps) else steps


@dataclass(frozen=True)
class Leaf:
    """A resolved path: its type, and ``any_of``, which lifts a predicate on values to one on the row."""

    kind: T.DataType
    any_of: Callable[[Predicate], Column]
    fans_out: bool
    column: Column | None  # None if the path fans out


def _walk(column: Column, kind: T.DataType, steps: list[str]) -> Leaf | None:
    for i, step in enumerate(steps):
        if isinstance(kind, T.StructType):
            if step not in kind.names:
                return None
            column, kind = column.getField(step), kind[step].dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            column, kind = F.try_element_at(column, F.lit(step)), kind.valueType
        elif isinstance(kind, T.ArrayType) and step.isdigit():
            column, kind = F.get(column, F.lit(int(step))), kind.elementType
        elif isinstance(kind, T.ArrayType):
            rest, array = steps[i:], column
            inner = _walk(F.lit(None).cast(kind.elementType), kind.elementType, rest)
            if inner is None:
                return None
            element = kind.elementType

            def any_of(p: Predicate) -> Column:
                return F.coalesce(F.exists(array, lambda e: F.coalesce(_walk(e, element, rest).any_of(p), F.lit(False))), F.lit(False))

            return Leaf(inner.kind, any_of, True, None)
        else:
            return None
    return Leaf(kind, lambda p: p(column), False, column)


def resolve(schema: T.StructType, path: str) -> Leaf | None:
    steps = parse(path)
    if steps is None:
        return None
    if path in schema.names:  # a column whose own name has dots
        steps = [path]
    if steps[0] not in schema.names:
        return None
    return _walk(F.col(f"`{steps[0]}`"), schema[steps[0]].dataType, steps[1:])


def get(schema: T.StructType, path: str) -> Column | None:
    """The value at a path, without fan-out."""
    leaf = resolve(schema, path)
    return None if leaf is None else leaf.column
