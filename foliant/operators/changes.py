"""Keyed diff, changelog replay, snapshots and three-way synchronisation over DataFrames.

All of it is joins and partial aggregations by the key; no key's history is ever collected. A changelog has columns id,
time, seq, type ('insert', 'update', 'remove'), the document's fields, and ``present``, the names of the fields that a
change sets (so that a field set to null differs from one left alone).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fields_of(df: DataFrame, key: str) -> list[str]:
    return [c for c in df.columns if c != key]


def changed_paths(a: Column, b: Column, kind: T.DataType, path: str) -> Column:
    """Dotted paths at which two values differ, as an array of strings."""
    none = F.array().cast("array<string>")
    here = F.when(~a.eqNullSafe(b), F.array(F.lit(path))).otherwise(none)
    if isinstance(kind, T.StructType):
        inner = F.concat(*[changed_paths(a.getField(f.name), b.getField(f.name), f.dataType, f"{path}.{f.name}") for f in kind.fields]) if kind.fields else none
        return F.when(a.isNull() | b.isNull(), here).otherwise(inner)
    if isinstance(kind, T.ArrayType):
        zipped = F.zip_with(F.coalesce(a, F.array().cast(kind)), F.coalesce(b, F.array().cast(kind)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        element = kind.elementType
        at = lambda p, i: F.transform(p, lambda s: F.concat(F.lit(f"{path}."), i.cast("string"), s))
        inner = F.flatten(F.transform(zipped, lambda e, i: at(changed_paths(e["x"], e["y"], element, ""), i)))
        return F.when(a.isNull() | b.isNull(), here).otherwise(inner)
    return here


def diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """kind ('added', 'removed', 'modified'), the key, old, new (structs of fields) and the modified fields' paths.

    One full outer join by the key; unchanged rows are dropped by null-safe equality.
    """
    names = fields_of(new, key)
    old = old.select(key, *[F.col(f"`{c}`").cast(new.schema[c].dataType).alias(c) if c in old.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in names])
    pack = lambda df, name: df.select(F.col(key).alias(f"__{name}"), F.struct(*[F.col(f"`{c}`") for c in names]).alias(name))
    both = pack(old, "old").join(pack(new, "new"), F.col("__old") == F.col("__new"), "full_outer")
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    paths = F.concat(*[changed_paths(F.col("old").getField(c), F.col("new").getField(c), new.schema[c].dataType, c) for c in names]) if names else F.array().cast("array<string>")
    return both.select(kind.alias("kind"), F.coalesce("__old", "__new").alias(key), "old", "new", F.when(kind == "modified", paths).alias("modified_fields")).where(F.col("kind").isNotNull())


def replay(base: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """``base`` after the changes of ``log``, in order of (time, seq) per key.

    insert merges its fields over what is there, update sets fields and creates the document if absent, remove deletes.
    A field's value is that of the last change that sets it after the last removal, so one aggregation per key, with
    partial sums on the map side, is enough however long a key's history is.
    """
    names = fields_of(base, key)
    at = F.struct("time", "seq")
    sets = lambda c: F.when((F.col("type") != "remove") & F.array_contains("present", c), F.struct(at.alias("at"), F.col(f"`{c}`").cast(base.schema[c].dataType).alias("v")))
    ends = log.groupBy(F.col(key).alias("__key")).agg(
        F.max(F.when(F.col("type") == "remove", at)).alias("__gone"), F.max(F.when(F.col("type") != "remove", at)).alias("__live"),
        *[F.max_by(sets(c), F.when((F.col("type") != "remove") & F.array_contains("present", c), at)).alias(f"__{c}") for c in names],
    )
    both = base.join(ends, F.col(key) == F.col("__key"), "full_outer")
    alive = F.col("__key").isNull() | F.col("__gone").isNull() | (F.col("__live") > F.col("__gone"))
    known = F.col(key).isNotNull() & F.col("__gone").isNull()

    def value(c: str) -> Column:
        last = F.col(f"__{c}")
        fresh = last.isNotNull() & (F.col("__gone").isNull() | (last["at"] > F.col("__gone")))
        return F.when(fresh, last["v"]).when(known | F.col("__key").isNull(), F.col(f"`{c}`")).alias(c)

    return both.where(F.coalesce(alive, F.lit(False))).select(F.coalesce(F.col(key), F.col("__key")).alias(key), *[value(c) for c in names])


def upsert(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows replace those of equal key in ``base``, or are added."""
    return base.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def snapshot(last: DataFrame, added: DataFrame | None = None, modified: DataFrame | None = None, removed: DataFrame | None = None, items: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The state after a load: ``items`` itself, or ``last`` with a delta; removals of unknown keys are ignored."""
    if items is not None:
        return items
    rank = {"last": 0, "added": 1, "modified": 2, "removed": 3}
    parts = [df.withColumn("__rank", F.lit(rank[n])) for n, df in (("last", last), ("added", added), ("modified", modified), ("removed", removed)) if df is not None]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in every.columns if c not in (key, "__rank")]
    last_of = every.groupBy(key).agg(F.max_by(F.struct("__rank", *[F.col(f"`{c}`") for c in names]), "__rank").alias("__r"))
    return last_of.where(F.col("__r.__rank") < 3).select(key, *[F.col("__r").getField(c).alias(c) for c in names])


@dataclass
class Load:
    """What a pull returns: all items, or a delta."""

    items: DataFrame | None = None
    added: DataFrame | None = None
    modified: DataFrame | None = None
    removed: DataFrame | None = None

    def on(self, last: DataFrame, key: str = "id") -> DataFrame:
        return snapshot(last, self.added, self.modified, self.removed, self.items, key)


@dataclass
class Synced:
    state: DataFrame  # the new snapshot
    changes: DataFrame  # diff to apply to the collection
    pushed: DataFrame | None


def sync(last: DataFrame, log: DataFrame, load: Load, push: Callable[[DataFrame], None], pull: Callable[[], Load], key: str = "id") -> Synced:
    """Three-way synchronisation: local changes are replayed on the newest remote state, so the last operation wins."""
    new, base, pushed = load.on(last, key), last, None
    if not log.isEmpty():
        local = replay(last, log, key)
        if not diff(last, local, key).isEmpty():
            mine = diff(new, replay(new, log, key), key)
            if not mine.isEmpty():
                push(mine)
                pushed, load = mine, pull()
                new = load.on(new, key)
            base = local
    return Synced(new, diff(base, new, key), pushed)


def reconcile(collection: DataFrame, state: DataFrame, key: str = "id") -> DataFrame:
    """What brings a collection exactly to a snapshot: upserts, and removal of items that it lacks."""
    return diff(collection, state, key)


def merge_live(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Items of several selectors' results by key; later ones override field by field where they have a value."""
    tagged = [p.withColumn("__q", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    names = [c for c in every.columns if c not in (key, "__q")]
    return every.groupBy(key).agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col("__q"))).alias(c) for c in names])


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by partial aggregation."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*by, *[F.col("__r").getField(c).alias(c) for c in rest])


def lookup(items: DataFrame, related: DataFrame, foreign: str, key: str, into: str, order: list[str] | None = None, unique: bool = False) -> DataFrame:
    """Attach to each item the first related row, as a struct or null: a left join that Catalyst may broadcast.

    unique: ``related`` has a key once at most, so that no first row need be found.
    """
    side = related if unique else first_of(related, [key], [F.col(c) for c in (order or [c for c in related.columns if c != key][:1] or [key])]) if len(related.columns) > 1 else related.distinct()
    packed = side.select(F.col(key).alias("__k"), F.struct(*[F.col(f"`{c}`") for c in related.columns]).alias(into))
    return items.join(packed, items[foreign] == F.col("__k"), "left").drop("__k")
