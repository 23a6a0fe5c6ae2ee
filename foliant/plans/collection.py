"""Collections: immutable versions of a DataFrame with document-style reads and writes.

A collection keeps insertion order in ``_seq``. Each write makes a new version by a declarative plan; nothing is run
until a result is asked for, except for what a write's return value needs (counts and key conflicts). After ``CUT``
versions the lineage is cut by writing the version to the shared scratch folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.paths import get
from foliant.functions.values import comparable, literal
from foliant.operators import modifier as modifiers
from foliant.operators.projection import project
from foliant.operators.selector import compile_selector
from foliant.streaming.observe import CountObserver, Effect, Observer

SEQ = "_seq"
CUT = 10


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared spark.checkpoint.dir; where that is unset, a temporary one of a local session."""
    top = spark.conf.get("spark.checkpoint.dir", None) or getattr(scratch, "own", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = scratch.own = tempfile.mkdtemp(prefix="foliant-")
    return f"{top}/versions/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    return cut_lineage_to(df, scratch(df.sparkSession))


def cut_lineage_to(df: DataFrame, path: str, options: dict[str, str] | None = None) -> DataFrame:
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_columns(schema: T.StructType, sort: dict[str, int] | None) -> list[Column]:
    """Sort keys in their own order, 1 ascending and anything else descending, missing values last."""
    out = []
    for path, way in (sort or {}).items():
        c = get(schema, path)
        if c is not None:
            out.append(c.asc_nulls_last() if way == 1 else c.desc_nulls_last())
    return out


class IndexProvider(Protocol):
    """An index of a collection: a smaller or better laid out source for the selectors that it serves."""

    def query(self, selector: dict) -> DataFrame | None:
        """Rows that include all matches, with every column of the collection; None if the index is of no use."""

    def rebuild(self, df: DataFrame) -> None:
        """The collection's items are now ``df``."""


class Dependency(Protocol):
    def depend(self) -> None:
        """Whatever is being computed now depends on this."""

    def notify(self) -> None:
        """It has changed: compute it again."""


class Reactivity(Protocol):
    """What connects live queries to a framework that computes things anew when their inputs change."""

    def create(self) -> Dependency: ...

    def is_in_scope(self) -> bool:
        """Whether something is being computed now that could depend on a query."""

    def on_dispose(self, f: Callable[[], Any], dependency: Dependency) -> None:
        """Call ``f`` when nothing depends on it any more."""


class Cursor:
    """A lazy result: filter, sort, skip, limit, transform_all, fields, transform, in that order."""

    def __init__(self, source: Callable[[], DataFrame], selector: dict | None, sort=None, skip=None, limit=None, fields=None, transform=None, transform_all=None, key="id") -> None:
        if selector is not None and not isinstance(selector, dict):
            raise TypeError("a selector is a dict or None")
        if (skip or 0) < 0 or (limit or 0) < 0:
            raise ValueError("skip and limit are not negative")
        self.source, self.selector, self.sort, self.skip, self.limit, self.fields = source, selector, sort, skip, limit, fields
        self.transform, self.transform_all, self.key = transform, transform_all, key

    def _filtered(self) -> DataFrame:
        df = self.source()
        own = T.StructType([f for f in df.schema.fields if f.name != SEQ])
        where = compile_selector(self.selector, own)
        return df if where is None else df.where(where)

    def _window(self) -> DataFrame:
        df = self._filtered()
        keys = order_columns(df.schema, self.sort)
        ties = [F.col(SEQ)] if SEQ in df.columns else []
        if keys or ties and (self.skip or self.limit):
            df = df.orderBy(*keys, *ties)
        if self.skip:
            df = df.offset(self.skip)
        return df.limit(self.limit) if self.limit else df

    def to_df(self) -> DataFrame:
        df = self._window()
        if self.transform_all:
            df = self.transform_all(df, self.fields)
        return project(df.drop(SEQ), self.fields, self.key)

    def fetch(self) -> list[Any]:
        return list(self)

    def __iter__(self) -> Iterator[Any]:
        rows = self.to_df().toLocalIterator()
        return map(self.transform, rows) if self.transform else rows

    def map(self, f: Callable[[Any], Any]) -> list[Any]:
        return [f(x) for x in self]

    def for_each(self, f: Callable[[Any], Any]) -> None:
        for x in self:
            f(x)

    def count(self) -> int:
        df = self._filtered()
        if self.skip:
            df = df.offset(self.skip)
        return (df.limit(self.limit) if self.limit else df).count()

    def is_empty(self) -> bool:
        df = self._filtered()
        return (df.offset(self.skip) if self.skip else df).isEmpty()

    def transformed(self, schema: T.StructType | str, batch_rows: int = 2_000) -> DataFrame:
        """The result with ``transform`` applied to each row (as a dict) on the executors; it returns a dict of ``schema``."""
        import pandas as pd

        df, change = self.to_df(), self.transform or (lambda row: row)
        names = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for a in range(0, len(part), batch_rows):
                    rows = part.iloc[a : a + batch_rows].astype(object)
                    out = [change(r) for r in rows.where(rows.notna(), None).to_dict("records")]
                    yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names)

        return df.mapInPandas(run, schema)

    def observe(self, callbacks: dict[str, Callable[..., Any]], skip_initial: bool = False, fields: list[str] | None = None) -> Observer:
        """Events between this cursor's results; see ``Observer``."""
        order = [*order_columns(self._shown().schema, self.sort), F.col(self.key)]
        return Observer(self._shown, callbacks, order, self.key, skip_initial, fields, small=True if self.limit else None)

    def _shown(self) -> DataFrame:
        return project(self._window().drop(SEQ), self.fields, self.key)

    def observe_count(self, callback: Callable[[int], Any], skip_initial: bool = False) -> CountObserver:
        """Calls back with the number of results, at once and whenever it is another."""
        return CountObserver(self.count, callback, skip_initial)

    def effect(self, f: Callable[[list[Any]], Any]) -> Effect:
        """Runs ``f`` on the items, and again whenever the items, their order or a field that it has read are others."""
        order = order_columns(self._shown().schema, self.sort)
        return Effect(self._shown, f, order, self.key)


class Collection:
    registry: dict[str, "Collection"] = {}
    creation_hooks: list[Callable[["Collection"], None]] = []
    dispose_hooks: list[Callable[["Collection"], None]] = []
    debug_default = False
    tracking_default = False

    @staticmethod
    def get_collections() -> list["Collection"]:
        return list(Collection.registry.values())

    @staticmethod
    def on_creation(f: Callable[["Collection"], None]) -> None:
        Collection.creation_hooks.append(f)

    @staticmethod
    def on_dispose(f: Callable[["Collection"], None]) -> None:
        Collection.dispose_hooks.append(f)

    @staticmethod
    def enable_debug_mode() -> None:
        """All collections, those to come included, emit ``_debug`` events with the plan of each find."""
        Collection.debug_default = True
        for c in Collection.registry.values():
            c.debug = True

    @staticmethod
    def set_field_tracking_default(enable: bool) -> None:
        Collection.tracking_default = enable
        for c in Collection.registry.values():
            c.tracking = enable

    def set_debug_mode(self, enable: bool) -> None:
        self.debug = enable

    def set_field_tracking(self, enable: bool) -> None:
        """Effects follow only the fields that they have read; without it, all fields."""
        self.tracking = enable

    def __init__(self, df: DataFrame, name: str = "", key: str = "id", order: list[str] | None = None, key_generator: Callable[[], Any] | None = None, transform=None, transform_all=None, rules: dict[str, Column] | None = None, indexes: list[IndexProvider] | None = None, reactivity: Reactivity | None = None) -> None:
        """reactivity: connects finds to a framework of reactive computations, unless they say ``reactive=False``. rules: name -> boolean Column that every written row must satisfy. order: columns of the insertion order."""
        self.spark, self.key, self.name = df.sparkSession, key, name
        self.key_generator = key_generator or (lambda: uuid.uuid4().hex)
        self.transform, self.transform_all, self.rules = transform, transform_all, rules or {}
        self.handlers: dict[str, list[Callable[..., Any]]] = defaultdict(list)
        self.observers: list[Observer] = []
        self.disposed, self.batching, self.version, self.pending = False, False, 0, []
        self.reactivity = reactivity
        self.debug, self.tracking = Collection.debug_default, Collection.tracking_default
        self.order = order or [key]
        self.df = self._ordered(df)
        self.indexes = indexes or []
        self._rebuild()
        if name:
            Collection.registry[name] = self
        for hook in Collection.creation_hooks:
            hook(self)

    def _ordered(self, df: DataFrame) -> DataFrame:
        """``df`` with its insertion order: version, number within a write, then the order columns; none is global."""
        zero = F.lit(0).cast("long")
        return df if SEQ in df.columns else df.withColumn(SEQ, F.struct(zero.alias("version"), zero.alias("nth"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(self.order)]))

    # -- reading

    def _open(self) -> None:
        if self.disposed:
            raise RuntimeError("Collection is disposed")

    def find(self, selector: dict | None = None, **options: Any) -> Cursor:
        self._open()
        reactive = options.pop("reactive", True) and self.reactivity is not None and self.reactivity.is_in_scope()
        options.setdefault("transform", self.transform)
        options.setdefault("transform_all", self.transform_all)
        self.emit("find", selector, options)
        out = Cursor(lambda: self._source(selector), selector, key=self.key, **options)
        if self.debug:
            self.emit("_debug.find", selector, options, out.to_df()._jdf.queryExecution().simpleString())
        if reactive:
            dependency = self.reactivity.create()
            watch = self._live(Effect(out._shown, lambda items: None, order_columns(out._shown().schema, out.sort), self.key, changed=dependency.notify))
            self.reactivity.on_dispose(watch.cleanup, dependency)
            dependency.depend()
        return out

    def find_one(self, selector: dict | None = None, **options: Any) -> Any:
        self.emit("findOne", selector, options)
        return next(iter(self.find(selector, **{**options, "limit": 1})), None)

    def _source(self, selector: dict | None) -> DataFrame:
        """The first index that serves the selector, or all items; the whole selector is applied to either."""
        found = (ix.query(selector) for ix in self.indexes) if isinstance(selector, dict) and selector else ()
        return next((df for df in found if df is not None), self.df)

    def _rebuild(self) -> None:
        for ix in self.indexes:
            ix.rebuild(self.df)

    # -- events

    def on(self, event: str, f: Callable[..., Any]) -> None:
        self._open()
        self.handlers[event].append(f)

    def once(self, event: str, f: Callable[..., Any]) -> None:
        """``f`` is called at the next such event only."""

        def first(*args: Any) -> None:
            if first in self.handlers[event]:
                self.handlers[event].remove(first)
                f(*args)

        self.on(event, first)

    def off(self, event: str, f: Callable[..., Any]) -> None:
        self._open()
        if f in self.handlers[event]:
            self.handlers[event].remove(f)

    def emit(self, event: str, *args: Any) -> None:
        self._open()
        for f in list(self.handlers[event]):
            f(*args)

    def _live(self, observer: Any) -> Any:
        self.observers.append(observer)
        return observer

    def observe(self, selector: dict | None, callbacks: dict[str, Callable[..., Any]], skip_initial: bool = False, **options: Any) -> Observer:
        return self._live(self.find(selector, **options).observe(callbacks, skip_initial))

    def observe_count(self, selector: dict | None, callback: Callable[[int], Any], skip_initial: bool = False, **options: Any) -> CountObserver:
        return self._live(self.find(selector, **options).observe_count(callback, skip_initial))

    def effect(self, selector: dict | None, f: Callable[[list[Any]], Any], **options: Any) -> Effect:
        out = self.find(selector, **options).effect(f)
        out.tracking = self.tracking
        return self._live(out)

    # -- writing

    def _commit(self, df: DataFrame, event: str, *args: Any, written: Callable[[], DataFrame] | None = None) -> None:
        """written: the write as changelog rows (type, present, key, fields), made only if someone listens to ``written``."""
        self.version += 1
        rows = written() if written and self.handlers["written"] else None
        self.df = cut_lineage(df) if self.version % CUT == 0 else df
        if not self.batching:
            self._rebuild()
        self.emit(event, *args)
        if rows is not None:
            self.emit("written", rows)
        if not self.batching:
            self._requery()

    def _requery(self) -> None:
        self.observers = [o for o in self.observers if o.active]
        for o in self.observers:
            o.requery()

    def _log(self, rows: DataFrame, kind: str, fields: list[str]) -> DataFrame:
        """Rows as a changelog of one kind; ``fields`` are those that it sets."""
        present = F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>")
        return rows.drop(SEQ).withColumns({"type": F.lit(kind), "present": present})

    @contextmanager
    def batch(self) -> Iterator["Collection"]:
        """Indexes and observers follow once, at the end; a failure takes the batch back."""
        self._open()
        before, self.batching = self.df, True
        try:
            yield self
        except BaseException:
            self.df = before
            raise
        finally:
            self.batching = False
            self._rebuild()
        self._requery()

    def _match(self, selector: dict | None) -> Column:
        own = T.StructType([f for f in self.df.schema.fields if f.name != SEQ])
        where = compile_selector(selector, own)
        return F.lit(True) if where is None else F.coalesce(where, F.lit(False))

    def _first(self, hit: Column) -> Column | None:
        """A predicate for the earliest matching row."""
        row = self.df.where(hit).agg(F.min(F.struct(SEQ, self.key)).alias("r")).first()["r"]
        return None if row is None else F.col(self.key) == F.lit(row[self.key])

    def _check(self, rows: DataFrame) -> None:
        self.emit("validate", rows)
        for name, rule in self.rules.items():
            if not rows.where(~F.coalesce(rule, F.lit(False))).isEmpty():
                raise ValueError(f"validation failed: {name}")

    def _widened(self, names: dict[str, T.DataType]) -> DataFrame:
        return self.df.withColumns({n: F.lit(None).cast(k) for n, k in names.items() if n not in self.df.columns})

    def _rows(self, items: list[dict[str, Any]]) -> DataFrame:
        kinds = {f.name: f.dataType for f in self.df.schema.fields if f.name != SEQ}
        extra = [n for item in items for n in item if n not in kinds]
        if extra:
            sample = self.spark.createDataFrame([Row(**{n: next((i[n] for i in items if i.get(n) is not None), None) for n in dict.fromkeys(extra)})])
            kinds |= {f.name: f.dataType for f in sample.schema.fields}
        for item in items:
            for n, v in item.items():
                if v is not None and not comparable(v, kinds[n]):
                    raise TypeError(f"{n}: {v!r} does not fit {kinds[n].simpleString()}")
        schema = T.StructType([T.StructField(n, k, True) for n, k in kinds.items()])
        return self.spark.createDataFrame([tuple(_plain(item.get(n), k) for n, k in kinds.items()) for item in items], schema)

    def _seq_for(self, rows: DataFrame) -> DataFrame:
        inner = self.df.schema[SEQ].dataType
        nth = F.monotonically_increasing_id()  # rows are a driver-made list: one reading, one order
        return rows.withColumn(SEQ, F.struct(F.lit(self.version + 1).cast("long").alias("version"), nth.alias("nth"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in inner.fields[2:]]))

    def insert(self, item: dict[str, Any]) -> Any:
        return self.insert_many([item])[0]

    def insert_many(self, items: list[dict[str, Any]]) -> list[Any]:
        """Keys of the new items; all of them or none are inserted."""
        self._open()
        if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
            raise TypeError("items are dicts")
        if not items:
            return []
        items = [{self.key: self.key_generator(), **i} for i in items]
        keys = [i[self.key] for i in items]
        if len(set(keys)) < len(keys) or not self.df.where(F.col(self.key).isin(keys)).isEmpty():
            raise ValueError("an item with this id exists")
        rows = self._rows(items)
        self._check(rows)
        fields = [c for c in rows.columns if c != self.key]
        self._commit(self.df.unionByName(self._seq_for(rows), allowMissingColumns=True), "added", items, written=lambda: self._log(rows, "insert", fields))
        return keys

    def _update(self, selector: dict | None, change: dict[str, Any], many: bool, upsert: bool) -> int:
        self._open()
        if not isinstance(change, dict):
            raise TypeError("a modifier is a dict")
        if not any(k.startswith("$") for k in change):
            return self._replace(selector, change, many, upsert, "updateMany" if many else "updateOne")
        modifiers.check(change)
        hit = self._match(selector)
        n = self.df.where(hit).count()
        if not n:
            self.emit("updateMany" if many else "updateOne", selector, change, 0)
            return self._upsert(change) if upsert else 0
        if not many:
            hit, n = self._first(hit), 1
        own = {k: v for k, v in change.items() if k != "$setOnInsert"}
        wide = self._widened(self._new_kinds(own))
        schema = T.StructType([f for f in wide.schema.fields if f.name != SEQ])
        new = modifiers.columns(own, schema)
        df = wide.withColumns({c: F.when(hit, v).otherwise(F.col(f"`{c}`")) for c, v in new.items()})
        if self.key in new and df.groupBy(self.key).count().where("count > 1").isEmpty() is False:
            raise ValueError("an item with this id exists")
        if self.rules or self.handlers["validate"]:
            self._check(wide.where(hit).withColumns(new).drop(SEQ))
        self._commit(df, "changed", selector, change, n, written=lambda: self._rewritten(wide.where(hit), new))
        self.emit("updateMany" if many else "updateOne", selector, change, n)
        return n

    def _rewritten(self, old: DataFrame, new: dict[str, Column]) -> DataFrame:
        """Changelog rows of rows whose columns ``new`` were written; a new key is a removal and an insertion."""
        after = old.withColumns(new)
        if self.key not in new:
            return self._log(after, "update", list(new))
        return self._log(old, "remove", []).unionByName(self._log(after, "insert", [c for c in after.columns if c not in (self.key, SEQ)]), allowMissingColumns=True)

    def _new_kinds(self, change: dict[str, Any]) -> dict[str, T.DataType]:
        out: dict[str, T.DataType] = {}
        for op, spec in change.items():
            for path, v in spec.items():
                if op == "$rename":
                    if v not in self.df.columns and path in self.df.columns:
                        out[v] = self.df.schema[path].dataType
                elif path not in self.df.columns and "." not in path:
                    if isinstance(v, dict) and "$each" in v:
                        v = v["$each"]
                    elif op in ("$push", "$addToSet"):
                        v = [v]
                    if op == "$currentDate":
                        out[path] = T.TimestampType()
                    elif v is not None and op not in ("$unset", "$pull", "$pullAll", "$pop"):
                        out[path] = self.spark.createDataFrame([Row(v=v)]).schema["v"].dataType
        return out

    def _upsert(self, change: dict[str, Any]) -> int:
        """A document made from the modifier alone: $setOnInsert, then $set, then the other operators on it."""
        first = {**change.get("$setOnInsert", {}), **change.get("$set", {})}
        rest = {k: v for k, v in change.items() if k not in ("$set", "$setOnInsert")}
        item = {self.key: self.key_generator(), **{k: v for k, v in first.items() if "." not in k}}
        if not self.df.where(F.col(self.key) == F.lit(item[self.key])).isEmpty():
            raise ValueError("an item with this id exists")
        rows = self._rows([item])
        kinds = self._new_kinds(rest)
        wide = rows.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items() if n not in rows.columns})
        rows = wide.withColumns(modifiers.columns({**rest, **({"$set": d} if (d := {k: v for k, v in first.items() if "." in k}) else {})}, wide.schema)) if rest or any("." in k for k in first) else wide
        self._check(rows)
        fields = [c for c in rows.columns if c != self.key]
        self._commit(self.df.unionByName(self._seq_for(rows), allowMissingColumns=True), "added", [item], written=lambda: self._log(rows, "insert", fields))
        return 1

    def update_one(self, selector: dict | None, change: dict[str, Any], upsert: bool = False) -> int:
        return self._update(selector, change, False, upsert)

    def update_many(self, selector: dict | None, change: dict[str, Any], upsert: bool = False) -> int:
        return self._update(selector, change, True, upsert)

    def replace_one(self, selector: dict | None, item: dict[str, Any], upsert: bool = False) -> int:
        return self._replace(selector, item, False, upsert, "replaceOne")

    def _replace(self, selector: dict | None, item: dict[str, Any], many: bool, upsert: bool, event: str) -> int:
        """Matches become ``item`` as a whole; each keeps its key unless the item has one."""
        self._open()
        hit = self._match(selector)
        n = self.df.where(hit).count()
        if not n:
            if upsert:
                self.insert(item)
            return int(upsert)
        if not many:
            hit, n = self._first(hit), 1
        rows = self._rows([item])
        if self.key in item and (n > 1 or not self.df.where((F.col(self.key) == F.lit(item[self.key])) & ~hit).isEmpty()):
            raise ValueError("an item with this id exists")
        self._check(rows)
        wide = self._widened({f.name: f.dataType for f in rows.schema.fields})
        new = {c: literal(item.get(c), wide.schema[c].dataType).cast(wide.schema[c].dataType) for c in wide.columns if c != SEQ and not (c == self.key and c not in item)}
        df = wide.withColumns({c: F.when(hit, v).otherwise(F.col(f"`{c}`")) for c, v in new.items()})
        self._commit(df, "changed", selector, item, n, written=lambda: self._rewritten(wide.where(hit), new))
        self.emit(event, selector, item, n)
        return n

    def remove_one(self, selector: dict) -> int:
        return self._remove(selector, False)

    def remove_many(self, selector: dict) -> int:
        return self._remove(selector, True)

    def _remove(self, selector: dict, many: bool) -> int:
        self._open()
        if not isinstance(selector, dict):
            raise TypeError("a selector is needed")
        hit = self._match(selector)
        n = self.df.where(hit).count()
        if not n:
            return 0
        if not many:
            hit, n = self._first(hit), 1
        before = self.df
        self._commit(before.where(~hit), "removed", selector, n, written=lambda: self._log(before.where(hit), "remove", []))
        self.emit("removeMany" if many else "removeOne", selector, n)
        return n

    def apply(self, changes: DataFrame) -> None:
        """Apply the rows of a diff: upsert what was added or modified, remove what was removed."""
        self._open()
        new = changes.where(F.col("kind") != "removed").select(self.key, "new.*")
        old = self.df.select(self.key, SEQ)
        own = [(F.col(f"`{c}`") if c in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for c, f in zip(self.order, self.df.schema[SEQ].dataType.fields[2:])]
        fresh = F.struct(F.lit(self.version + 1).cast("long").alias("version"), F.lit(0).cast("long").alias("nth"), *own)
        placed = new.join(old, self.key, "left").withColumn(SEQ, F.coalesce(SEQ, fresh))
        kept = self.df.join(changes.select(self.key), self.key, "left_anti")
        self._commit(kept.unionByName(placed, allowMissingColumns=True), "changed", None, None, None)

    def reset(self, df: DataFrame) -> None:
        """Replace all items; handlers, rules and observers stay."""
        self._open()
        before = self.df

        def written() -> DataFrame:
            gone = before.drop(SEQ).join(df.select(self.key), self.key, "left_anti")
            came = self._log(df.withColumn(SEQ, F.lit(0)), "insert", [c for c in df.columns if c not in (self.key, SEQ)])
            return came.unionByName(self._log(gone.withColumn(SEQ, F.lit(0)), "remove", []), allowMissingColumns=True)

        self._commit(self._ordered(df), "reset", df, written=written)

    def dispose(self) -> None:
        """Observers end, handlers hear ``dispose``; every later call is an error."""
        self._open()
        for o in self.observers:
            o.cleanup()
        self.emit("dispose")
        self.disposed = True
        self.handlers.clear()
        Collection.registry.pop(self.name, None)
        for hook in Collection.dispose_hooks:
            hook(self)


def _plain(v: Any, kind: T.DataType) -> Any:
    if isinstance(kind, T.StructType) and isinstance(v, dict):
        return tuple(_plain(v.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType) and isinstance(v, (list, tuple)):
        return [_plain(x, kind.elementType) for x in v]
    if isinstance(kind, T.DoubleType) and isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v
