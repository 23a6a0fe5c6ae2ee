"""Selectors: predicate documents compiled to one boolean Column.

Every predicate has a positive and a negative form. Negation is pushed to the leaves, whose negative forms say what
happens to missing values, so that plain comparisons stay visible to the scan (pushed filters) and no NULL logic leaks
out. ``coalesce`` appears only around array lambdas.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.paths import Leaf, resolve
from foliant.functions.values import comparable, equals, flags_of, literal, matches

TRUE, FALSE = (lambda: F.lit(True)), (lambda: F.lit(False))
OPERATORS = frozenset(
    "$eq $ne $gt $gte $lt $lte $in $nin $exists $not $all $size $elemMatch $mod $regex $options $bitsAllSet $bitsAllClear $bitsAnySet $bitsAnyClear $expr $where $jsonSchema".split()
)


class Pred:
    """A predicate and its negation; rows where ``pos`` is NULL count as not matching."""

    def __init__(self, pos: Callable[[], Column], neg: Callable[[], Column]) -> None:
        self.pos, self.neg = pos, neg

    def negated(self) -> Pred:
        return Pred(self.neg, self.pos)


def constant(value: bool) -> Pred:
    return Pred(TRUE, FALSE) if value else Pred(FALSE, TRUE)


def every(parts: list[Pred]) -> Pred:
    if not parts:
        return constant(True)
    return Pred(lambda: reduce(lambda a, b: a & b, [p.pos() for p in parts]), lambda: reduce(lambda a, b: a | b, [p.neg() for p in parts]))


def some(parts: list[Pred]) -> Pred:
    return every([p.negated() for p in parts]).negated()


def opaque(column: Column) -> Pred:
    """A predicate of unknown form: its negation also holds where it is NULL."""
    return Pred(lambda: column, lambda: ~F.coalesce(column, F.lit(False)))


def is_expression(value: Any) -> bool:
    return isinstance(value, dict) and bool(value) and all(isinstance(k, str) and k.startswith("$") for k in value)


def value_pred(leaf: Leaf, test: Callable[[Column, T.DataType], Column], whole: Callable[[Column, T.DataType], Column] | None = None) -> Pred:
    """Holds if the value, or any element of an array value, passes ``test``, or the value as a whole passes ``whole``."""
    if isinstance(leaf.kind, T.ArrayType):
        kind = leaf.kind

        def on(c: Column) -> Column:
            hit = F.coalesce(F.exists(c, lambda e: F.coalesce(test(e, kind.elementType), F.lit(False))), F.lit(False))
            return hit | F.coalesce(whole(c, kind), F.lit(False)) if whole else hit

        return opaque(leaf.any_of(on))
    if leaf.fans_out:
        return opaque(leaf.any_of(lambda c: test(c, leaf.kind)))
    column = test(leaf.column, leaf.kind)
    return Pred(lambda: column, lambda: ~column | leaf.column.isNull())


def equal_pred(leaf: Leaf | None, value: Any) -> Pred:
    if value is None:
        return absent(leaf)
    if leaf is None:
        return constant(False)
    if isinstance(leaf.kind, T.ArrayType):
        return value_pred(leaf, lambda c, k: equals(c, value, k), lambda c, k: equals(c, value, k))
    if not isinstance(value, re.Pattern) and not comparable(value, leaf.kind):
        return constant(False)
    if not leaf.fans_out and isinstance(leaf.kind, T.StructType):
        return opaque(equals(leaf.column, value, leaf.kind))
    if not leaf.fans_out and not isinstance(value, re.Pattern):
        c, v = leaf.column, literal(value, leaf.kind)
        return Pred(lambda: c == v, lambda: (c != v) | c.isNull())
    return value_pred(leaf, lambda c, k: equals(c, value, k))


def absent(leaf: Leaf | None) -> Pred:
    if leaf is None:
        return constant(True)
    if leaf.fans_out:
        return opaque(leaf.any_of(lambda c: c.isNull()))
    return Pred(lambda: leaf.column.isNull(), lambda: leaf.column.isNotNull())


def in_pred(leaf: Leaf | None, values: list[Any]) -> Pred:
    rest = [v for v in values if v is not None]
    parts = [absent(leaf)] if len(rest) < len(values) else []
    if leaf is None:
        return some(parts) if parts else constant(False)
    plain = [v for v in rest if not isinstance(v, (re.Pattern, dict, list)) and comparable(v, leaf.kind)]
    if plain and not leaf.fans_out and not isinstance(leaf.kind, T.ArrayType):
        c, v = leaf.column, [literal(x, leaf.kind) for x in plain]
        parts.append(Pred(lambda: c.isin(*v), lambda: ~c.isin(*v) | c.isNull()))
        rest = [v for v in rest if isinstance(v, (re.Pattern, dict, list))]
    parts += [equal_pred(leaf, v) for v in rest]
    return some(parts) if parts else constant(False)


def order_pred(leaf: Leaf | None, op: str, value: Any) -> Pred:
    if leaf is None or value is None:
        return constant(value is None and op in ("$gte", "$lte")) if leaf is None else absent(leaf) if op in ("$gte", "$lte") else constant(False)
    if isinstance(value, float) and value != value:  # nothing is ordered against NaN
        return constant(False)
    ops = {"$gt": ("__gt__", "__le__"), "$gte": ("__ge__", "__lt__"), "$lt": ("__lt__", "__ge__"), "$lte": ("__le__", "__gt__")}[op]
    if leaf.fans_out or isinstance(leaf.kind, T.ArrayType):
        return value_pred(leaf, lambda c, k: ordered(getattr(c, ops[0])(literal(value, k)), c, k, op) if comparable(value, k) else F.lit(False))
    if not comparable(value, leaf.kind):
        return constant(False)
    c, v = leaf.column, literal(value, leaf.kind)
    if isinstance(leaf.kind, T.FractionalType) and op in ("$gt", "$gte") and not isinstance(leaf.kind, T.DecimalType):
        return Pred(lambda: getattr(c, ops[0])(v) & ~F.isnan(c), lambda: getattr(c, ops[1])(v) | c.isNull() | F.isnan(c))
    return Pred(lambda: getattr(c, ops[0])(v), lambda: getattr(c, ops[1])(v) | c.isNull())


def ordered(test: Column, c: Column, kind: T.DataType, op: str) -> Column:
    """A comparison that NaN, which Spark holds for the greatest number, never passes."""
    return test & ~F.isnan(c) if op in ("$gt", "$gte") and isinstance(kind, (T.FloatType, T.DoubleType)) else test


def mask_of(value: Any) -> int:
    return sum(1 << b for b in set(value)) if isinstance(value, (list, tuple)) else int(value)


def bits_test(op: str, mask: int) -> Callable[[Column, T.DataType], Column]:
    def test(c: Column, kind: T.DataType) -> Column:
        if not isinstance(kind, T.IntegralType):
            return F.lit(False)
        own, all_ = c.cast("long").bitwiseAND(F.lit(mask).cast("long")), F.lit(mask).cast("long")
        return {"$bitsAllSet": own == all_, "$bitsAllClear": own == 0, "$bitsAnySet": own != 0, "$bitsAnyClear": own != all_}[op]

    return test


def field_pred(schema: T.StructType, path: str, expression: dict[str, Any], leaf: Leaf | None = None) -> Pred:
    """All operators of a field expression."""
    leaf = leaf or resolve(schema, path)
    parts: list[Pred] = []
    for op, v in expression.items():
        if op == "$eq":
            parts.append(equal_pred(leaf, v))
        elif op == "$ne":
            parts.append(equal_pred(leaf, v).negated())
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            parts.append(order_pred(leaf, op, v))
        elif op == "$in":
            parts.append(in_pred(leaf, list(v)))
        elif op == "$nin":
            parts.append(in_pred(leaf, list(v)).negated())
        elif op == "$exists":
            parts.append(absent(leaf).negated() if v else absent(leaf))
        elif op == "$not":
            inner = field_pred(schema, path, v, leaf) if is_expression(v) else equal_pred(leaf, v)
            parts.append(inner.negated())
        elif op == "$all":
            parts.append(every([field_pred(schema, path, x, leaf) if is_expression(x) else equal_pred(leaf, x) for x in v]) if v else constant(False))
        elif op == "$size":
            fits = leaf is not None and isinstance(leaf.kind, T.ArrayType)
            parts.append(opaque(leaf.any_of(lambda c, v=v: F.size(c) == v)) if fits else constant(False))
        elif op == "$elemMatch":
            parts.append(element_pred(leaf, v))
        elif op == "$mod":
            d, r = int(v[0]), int(v[1])
            test = lambda c, k, d=d, r=r: c % F.lit(d) == F.lit(r) if isinstance(k, T.NumericType) else F.lit(False)
            parts.append(value_pred(leaf, test) if leaf else constant(False))
        elif op == "$regex":
            pattern, options = (v.pattern, flags_of(v)) if isinstance(v, re.Pattern) else (v, "")
            options = expression.get("$options", options)
            test = lambda c, k, p=pattern, o=options: matches(c, p, o) if isinstance(k, T.StringType) else F.lit(False)
            parts.append(value_pred(leaf, test) if leaf else constant(False))
        elif op == "$options":
            if "$regex" not in expression:
                raise ValueError("$options needs $regex")
        elif op.startswith("$bits"):
            parts.append(value_pred(leaf, bits_test(op, mask_of(v))) if leaf else constant(False))
        elif op == "$expr":
            parts.append(opaque(expr_column(schema, v)))
        elif op == "$where":
            parts.append(where_pred(v, leaf.column if leaf else None, leaf.kind if leaf else None))
        elif op == "$jsonSchema":
            parts.append(schema_pred(leaf.kind if leaf else None, leaf.column if leaf else None, v))
        else:
            raise ValueError(f"unknown operator {op}")
    return every(parts)


def element_pred(leaf: Leaf | None, condition: dict[str, Any]) -> Pred:
    """One element of an array satisfies all conditions together."""
    if leaf is None or not isinstance(leaf.kind, T.ArrayType):
        return constant(False)
    kind = leaf.kind.elementType

    def on(e: Column) -> Column:
        if is_expression(condition) and not set(condition) & {"$and", "$or", "$nor"}:
            return field_pred(T.StructType(), "", condition, Leaf(kind, lambda p: p(e), False, e)).pos()
        return compile_on(kind, e, condition).pos() if isinstance(kind, T.StructType) else F.lit(False)

    return opaque(leaf.any_of(lambda c: F.coalesce(F.exists(c, lambda e: F.coalesce(on(e), F.lit(False))), F.lit(False))))


def compile_on(kind: T.StructType, value: Column, selector: dict[str, Any]) -> Pred:
    """A selector on a struct value instead of the row."""
    from foliant.functions.paths import _walk, parse

    parts = []
    for key, v in selector.items():
        if key in ("$and", "$or", "$nor"):
            inner = [compile_on(kind, value, s) for s in v]
            parts.append(every(inner) if key == "$and" else some(inner) if key == "$or" else some(inner).negated())
        else:
            steps = parse(key)
            leaf = _walk(value, kind, steps) if steps else None
            parts.append(field_pred(kind, key, v, leaf) if is_expression(v) and leaf else equal_pred(leaf, v) if not is_expression(v) else field_pred(T.StructType(), key, v))
    return every(parts)


def expr_column(schema: T.StructType, e: Any) -> Column:
    """Aggregation-style expressions over columns ("$name") and literals."""
    if isinstance(e, str) and e.startswith("$"):
        leaf = resolve(schema, e[1:])
        return F.lit(None) if leaf is None or leaf.column is None else leaf.column
    if not isinstance(e, dict):
        return F.lit(e)
    ((op, args),) = e.items()
    if op == "$literal":
        return F.lit(args)
    own = [] if isinstance(args, dict) and op == "$cond" else args if isinstance(args, list) else [args]
    a = [F.lit(None) if isinstance(x, list) else expr_column(schema, x) for x in own]
    two = {
        "$eq": lambda x, y: x.eqNullSafe(y), "$ne": lambda x, y: ~x.eqNullSafe(y), "$gt": lambda x, y: x > y, "$gte": lambda x, y: x >= y, "$lt": lambda x, y: x < y, "$lte": lambda x, y: x <= y,
        "$subtract": lambda x, y: x - y, "$divide": lambda x, y: F.try_divide(x, y), "$mod": lambda x, y: F.when(y != 0, x % F.nullif(y, F.lit(0))),
    }
    if op in two:
        return two[op](*a)
    many = {"$and": lambda x, y: x & y, "$or": lambda x, y: x | y, "$add": lambda x, y: x + y, "$multiply": lambda x, y: x * y}
    if op in many:
        return reduce(many[op], a)
    if op == "$not":
        return ~F.coalesce(a[0], F.lit(False))
    if op == "$in":  # a list of literals, or an array column
        if isinstance(args[1], list):
            return reduce(lambda x, y: x | y, [a[0].eqNullSafe(expr_column(schema, x)) for x in args[1]], F.lit(False))
        return F.coalesce(F.array_contains(a[1], a[0]), F.lit(False))
    if op == "$cond":
        test, then, other = [expr_column(schema, args[k]) for k in ("if", "then", "else")] if isinstance(args, dict) else a
        return F.when(F.coalesce(test, F.lit(False)), then).otherwise(other)
    one = {"$size": F.size, "$abs": F.abs, "$floor": F.floor, "$ceil": F.ceil, "$toLower": F.lower, "$toUpper": F.upper, "$strLenCP": F.length}
    if op in one:
        return one[op](a[0])
    if op == "$concat":  # null if any part is
        return F.concat(*a)
    if op == "$ifNull":
        return F.coalesce(*a)
    raise ValueError(f"unknown expression {op}")


def where_pred(test: Any, value: Column | None, kind: T.DataType | None = None) -> Pred:
    """An opt-in Python predicate, run in Arrow batches; text is refused."""
    if not callable(test):
        raise ValueError("$where takes a Python callable; text is not evaluated")
    import pandas as pd

    def batch(x):  # a Series, or a DataFrame where the value is an object
        values = x.to_dict("records") if isinstance(x, pd.DataFrame) else [None if v is None or v is pd.NA or isinstance(v, float) and v != v else v for v in x]
        return pd.Series([bool(test(v)) for v in values], dtype="boolean")

    batch.__annotations__ = {"x": pd.Series, "return": pd.Series}
    if value is not None and isinstance(kind, T.StructType):
        batch.__annotations__ = {"x": pd.DataFrame, "return": pd.Series}
    run = F.pandas_udf(batch, "boolean")
    return opaque(run(value if value is not None else F.lit(None)))


KINDS = {"object": T.StructType, "array": T.ArrayType, "string": T.StringType, "boolean": T.BooleanType, "number": T.NumericType, "integer": T.IntegralType}
#: Keywords that say nothing about what is valid.
COMMENTS = frozenset("title description default examples $schema $id $comment bsonType".split())
RULES = frozenset(
    "type enum const required properties additionalProperties items minItems maxItems uniqueItems contains minLength maxLength pattern minimum maximum "
    "exclusiveMinimum exclusiveMaximum multipleOf allOf anyOf oneOf not".split()
)


def schema_pred(kind: T.DataType | None, value: Column | None, spec: dict[str, Any]) -> Pred:
    """A JSON schema; keywords outside ``RULES`` are an error. A rule for another type than the value's says nothing."""
    if unknown := sorted(set(spec) - RULES - COMMENTS):
        raise ValueError(f"unsupported schema keywords: {', '.join(unknown)}")
    if kind is None or value is None:
        return constant(True)
    parts: list[Pred] = []
    test = lambda column: parts.append(opaque(column))
    if "type" in spec:
        wanted = spec["type"] if isinstance(spec["type"], list) else [spec["type"]]
        fits = any(w != "null" and isinstance(kind, KINDS[w]) for w in wanted)
        parts.append(constant(fits) if "null" in wanted else every([constant(fits), Pred(lambda: value.isNotNull(), lambda: value.isNull())]))
    if "enum" in spec:
        parts.append(some([opaque(equals(value, x, kind)) for x in spec["enum"]]))
    if "const" in spec:
        test(equals(value, spec["const"], kind))
    for key, join in (("allOf", every), ("anyOf", some)):
        if key in spec:
            parts.append(join([schema_pred(kind, value, x) for x in spec[key]]))
    if "oneOf" in spec:
        hits = [F.coalesce(schema_pred(kind, value, x).pos(), F.lit(False)).cast("int") for x in spec["oneOf"]]
        test(reduce(lambda x, y: x + y, hits) == 1)
    if "not" in spec:
        parts.append(schema_pred(kind, value, spec["not"]).negated())
    if isinstance(kind, T.StructType):
        for name in spec.get("required", []):
            test(value.getField(name).isNotNull()) if name in kind.names else parts.append(constant(False))
        for name, inner in spec.get("properties", {}).items():
            if name in kind.names:
                own = value.getField(name)
                parts.append(some([opaque(own.isNull()), schema_pred(kind[name].dataType, own, inner)]))
        if (more := spec.get("additionalProperties", True)) is not True:
            for name in set(kind.names) - set(spec.get("properties", {})):
                own = value.getField(name)
                parts.append(opaque(own.isNull()) if more is False else some([opaque(own.isNull()), schema_pred(kind[name].dataType, own, more)]))
    if isinstance(kind, T.ArrayType):
        size, element = F.size(value), kind.elementType
        for key, way in (("minItems", "__ge__"), ("maxItems", "__le__")):
            if key in spec:
                test(getattr(size, way)(spec[key]))
        if spec.get("uniqueItems"):
            test(F.size(F.array_distinct(value)) == size)
        if "items" in spec:
            test(F.forall(value, lambda e: F.coalesce(schema_pred(element, e, spec["items"]).pos(), F.lit(False))))
        if "contains" in spec:
            test(F.exists(value, lambda e: F.coalesce(schema_pred(element, e, spec["contains"]).pos(), F.lit(False))))
    if isinstance(kind, T.StringType):
        for key, way in (("minLength", "__ge__"), ("maxLength", "__le__")):
            if key in spec:
                test(getattr(F.length(value), way)(spec[key]))
        if "pattern" in spec:
            test(matches(value, spec["pattern"]))
    if isinstance(kind, T.NumericType):
        for key, way in (("minimum", "__ge__"), ("maximum", "__le__"), ("exclusiveMinimum", "__gt__"), ("exclusiveMaximum", "__lt__")):
            if key in spec:
                test(getattr(value, way)(F.lit(spec[key])))
        if "multipleOf" in spec:
            test(value % F.lit(spec["multipleOf"]) == 0)
    return every(parts)


def compile_pred(selector: dict[str, Any] | None, schema: T.StructType) -> Pred:
    if selector is None:
        return constant(True)
    if not isinstance(selector, dict):
        raise TypeError("a selector is a dict or None")
    parts: list[Pred] = []
    for key, v in selector.items():
        if key in ("$and", "$or", "$nor"):
            inner = [compile_pred(s, schema) for s in v]
            parts.append(every(inner) if key == "$and" else some(inner) if key == "$or" else some(inner).negated())
        elif key == "$expr":
            parts.append(opaque(expr_column(schema, v)))
        elif key == "$where":
            parts.append(where_pred(v, F.struct(*[F.col(f"`{n}`") for n in schema.names]), schema))
        elif key == "$jsonSchema":
            parts.append(schema_pred(schema, F.struct(*[F.col(f"`{n}`") for n in schema.names]), v))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif is_expression(v):
            parts.append(field_pred(schema, key, v))
        else:
            parts.append(equal_pred(resolve(schema, key), v))
    return every(parts)


def compile_selector(selector: dict[str, Any] | None, schema: T.StructType) -> Column | None:
    """The filter of a selector; None if it selects everything."""
    return None if not selector else compile_pred(selector, schema).pos()
