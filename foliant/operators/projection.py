"""Field projection: inclusion, exclusion and nested paths."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.paths import parse


def _tree(paths: list[str]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for p in paths:
        steps, at = parse(p), out
        if steps is None:
            continue
        for s in steps[:-1]:
            at = at.setdefault(s, {}) if at is not None else None
            if at is None:
                break
        if at is not None:
            at[steps[-1]] = None  # the whole value
    return out


def _keep(column: Column, kind: T.DataType, tree: dict[str, Any] | None) -> Column:
    if tree is None or not isinstance(kind, T.StructType):
        return column
    parts = [_keep(column.getField(n), kind[n].dataType, tree[n]).alias(n) for n in kind.names if n in tree]
    return F.when(column.isNotNull(), F.struct(*parts)) if parts else F.when(column.isNotNull(), F.struct())


def project(df: DataFrame, fields: dict[str, int] | None, key: str = "id") -> DataFrame:
    """``fields`` of {path: 1} keeps, of {path: 0} drops; a mixture keeps. The key stays unless it is 0."""
    if not fields:
        return df
    rest = {p: v for p, v in fields.items() if p != key}
    hide = key in fields and not fields[key]
    if any(rest.values()) or fields.get(key):
        tree = _tree([p for p, v in rest.items() if v])
        names = [n for n in df.columns if n in tree or n == key and not hide]
        return df.select(*[_keep(F.col(f"`{n}`"), df.schema[n].dataType, tree.get(n)).alias(n) for n in names])
    out = df.drop(key) if hide else df
    for p in rest:
        steps = parse(p)
        if steps is None or steps[0] not in out.columns:
            continue
        if len(steps) == 1:
            out = out.drop(p)
        elif isinstance(out.schema[steps[0]].dataType, T.StructType) and _known(out.schema, steps):
            out = out.withColumn(steps[0], F.col(f"`{steps[0]}`").dropFields(".".join(f"`{s}`" for s in steps[1:])))
    return out


def _known(schema: T.StructType, steps: list[str]) -> bool:
    kind: T.DataType = schema
    for s in steps:
        if not isinstance(kind, T.StructType) or s not in kind.names:
            return False
        kind = kind[s].dataType
    return True
