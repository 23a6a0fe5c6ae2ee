"""Live queries: the events between two results of a query.

Results are compared as projected, so changes of hidden fields are silent. Positions come from the sort keys; a moved
row is one whose position and following row both differ.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A result that the optimizer holds for at most so many bytes is sorted by one task.
SMALL_BYTES = 32 << 20


def positioned(df: DataFrame, order: list[Column], key: str = "id", small: bool | None = None) -> DataFrame:
    """Add __pos (from 1) and __next (following key) in the order of the whole result.

    A ``small`` result, one with a limit or of ``SMALL_BYTES`` by the optimizer's estimate, is one window. Any other is dealt by ranges of its sort keys and sorted there;
    a row's place in its part is its place in the task's output. It is written once, so that the parts are the same for
    all that follows: the parts' sizes (a row for each) move the places up, and the first key of each part is what
    follows the last one of the part before.
    """
    if small is None:
        small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL_BYTES
    if small:
        w = Window.orderBy(*order)
        return df.withColumns({"__pos": F.row_number().over(w), "__next": F.lead(key).over(w)})
    from foliant.plans.collection import cut_lineage

    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = cut_lineage(sorted_.withColumn("__id", F.monotonically_increasing_id()))
    part, nth = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    laid = laid.withColumns({"__part": part, "__nth": nth})
    parts = sorted((r["__part"], r["n"], r["first"]) for r in laid.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min_by(key, "__nth").alias("first")).collect())  # a row for each part
    rows, base = [], 0
    for i, (p, n, _) in enumerate(parts):
        rows.append((p, base, n - 1, parts[i + 1][2] if i + 1 < len(parts) else None))
        base += n
    kind = df.schema[key].dataType.simpleString()
    above = F.broadcast(df.sparkSession.createDataFrame(rows, f"__part bigint, __base bigint, __last bigint, __after {kind}"))
    follows = Window.partitionBy("__part").orderBy("__nth")
    out = laid.withColumn("__lead", F.lead(key).over(follows)).join(above, "__part")
    return out.select(*df.columns, (F.col("__base") + F.col("__nth") + 1).alias("__pos"), F.when(F.col("__nth") == F.col("__last"), F.col("__after")).otherwise(F.col("__lead")).alias("__next"))


def events(old: DataFrame, new: DataFrame, order: list[Column] | None = None, key: str = "id", positions: bool = True, small: bool | None = None) -> DataFrame:
    """event ('added', 'changed', 'changedField', 'movedBefore', 'removed'), key, field, old, new (text), before.

    Without ``positions`` nothing is sorted: no row is found moved, and ``before`` is null. small: see :func:`positioned`.
    """
    order = order or [F.col(key)]
    kinds = {f.name: f.dataType for df in (old, new) for f in df.schema.fields if f.name != key}
    names = list(kinds)  # a column that only one of them has is null in the other
    old, new = (df.withColumns({c: F.lit(None).cast(k) if c not in df.columns else F.col(f"`{c}`").cast(k) for c, k in kinds.items() if c not in df.columns or df.schema[c].dataType != k}) for df in (old, new))
    none_ = lambda df: df.withColumns({"__pos": F.lit(0), "__next": F.lit(None).cast(df.schema[key].dataType)})
    pack = lambda df, s: (positioned(df, order, key, small) if positions else none_(df)).select(F.col(key).alias(f"__k{s}"), F.struct(*[F.col(f"`{c}`") for c in names]).alias(f"__{s}"), F.col("__pos").alias(f"__p{s}"), F.col("__next").alias(f"__n{s}"))
    both = pack(old, "o").join(pack(new, "n"), F.col("__ko") == F.col("__kn"), "full_outer")
    none = F.lit(None).cast("string")
    text = lambda c: F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))))
    event = lambda kind, before=none, field=none, a=none, b=none: F.struct(F.lit(kind).alias("event"), field.alias("field"), a.alias("old"), b.alias("new"), before.cast("string").alias("before"))
    is_new, is_gone = F.col("__ko").isNull(), F.col("__kn").isNull()
    both_there = ~is_new & ~is_gone
    changed = both_there & ~F.col("__o").eqNullSafe(F.col("__n"))
    fields = [F.when(changed & ~F.col("__o")[c].eqNullSafe(F.col("__n")[c]), event("changedField", none, F.lit(c), text(F.col("__o")[c]), text(F.col("__n")[c]))) for c in names]
    moved = both_there & (F.col("__po") != F.col("__pn")) & ~F.col("__no").eqNullSafe(F.col("__nn"))
    found = F.array_compact(F.array(F.when(is_new, event("added", F.col("__nn"))), F.when(is_gone, event("removed")), F.when(changed, event("changed")), F.when(moved, event("movedBefore", F.col("__nn"))), *fields))
    return both.select(F.coalesce("__ko", "__kn").alias(key), F.explode(found).alias("e")).select(key, "e.*")


#: Callbacks that need to know what a row stands before.
PLACED = frozenset({"movedBefore", "addedBefore"})


class Observer:
    """Calls back with the events of each new result of a query; positions are found only for callbacks that need them."""

    def __init__(self, run: Callable[[], DataFrame], callbacks: dict[str, Callable[..., Any]], order: list[Column] | None = None, key: str = "id", skip_initial: bool = False, fields: list[str] | None = None, small: bool | None = None) -> None:
        self.run, self.callbacks, self.order, self.key, self.fields, self.small = run, callbacks, order, key, fields, small
        self.last: DataFrame | None = None
        self.active = True
        if skip_initial:
            self.last = self._result()
        else:
            self.requery()

    def _result(self) -> DataFrame:
        df = self.run()
        return df.select(self.key, *[f for f in self.fields if f != self.key]) if self.fields else df

    def requery(self) -> None:
        if not self.active:
            return
        new = self._result()
        old = self.last if self.last is not None else new.limit(0)
        for e in events(old, new, self.order, self.key, not PLACED.isdisjoint(self.callbacks), self.small).toLocalIterator():
            if e["event"] in self.callbacks:
                self.callbacks[e["event"]](e)
            if e["event"] == "added" and "addedBefore" in self.callbacks:
                self.callbacks["addedBefore"](e)
        self.last = new

    def cleanup(self) -> None:
        self.active, self.last = False, None


class CountObserver:
    """Calls back with the number of results when it changes; only rows that come or go matter."""

    def __init__(self, count: Callable[[], int], callback: Callable[[int], Any], skip_initial: bool = False) -> None:
        self.count, self.callback, self.active = count, callback, True
        self.last = count()
        if not skip_initial:
            callback(self.last)

    def requery(self) -> None:
        if self.active and (now := self.count()) != self.last:
            self.last = now
            self.callback(now)

    def cleanup(self) -> None:
        self.active = False


class Tracked:
    """A row that notes which of its fields are read."""

    def __init__(self, row: Any, read: set[str]) -> None:
        object.__setattr__(self, "_row", row)
        object.__setattr__(self, "_read", read)

    def __getitem__(self, name: str) -> Any:
        self._read.add(name)
        return self._row[name]

    def __getattr__(self, name: str) -> Any:
        if name not in self._row.__fields__:
            raise AttributeError(name)
        return self[name]

    def asDict(self) -> dict[str, Any]:  # noqa: N802  as rows have it
        self._read.update(self._row.__fields__)
        return self._row.asDict(True)


class Effect:
    """Runs a function on a query's items, and again when what it depends on has changed.

    With tracking it depends on the items, their order and the fields that its last run has read, otherwise on all.
    """

    def __init__(self, run: Callable[[], DataFrame], f: Callable[[list[Tracked]], Any], order: list[Column], key: str = "id", changed: Callable[[], Any] | None = None) -> None:
        """changed: called instead of ``f``, without reading any item."""
        self.query, self.f, self.order, self.key, self.tracking, self.active = run, f, order, key, False, True
        self.changed = changed
        self.read: set[str] = set()
        self.last = run()
        if not changed:
            self._run(self.last)

    def _run(self, df: DataFrame) -> None:
        self.read: set[str] = set()
        self.last = df
        self.f([Tracked(r, self.read) for r in df.toLocalIterator()])

    def requery(self) -> None:
        if not self.active:
            return
        new = self.query()
        fields = [c for c in new.columns if c in self.read or not self.tracking or c == self.key]
        own = lambda df: df.select(*[f"`{c}`" for c in df.columns if c in fields or c == self.key])
        a, b = own(self.last), own(new)
        placed = bool(self.order) and all(c in b.columns for c in new.columns)
        if a.columns != b.columns or not events(a, b, [*self.order, F.col(self.key)] if placed else [F.col(self.key)], self.key, placed).isEmpty():
            if self.changed:
                self.last = new
                self.changed()
            else:
                self._run(new)

    def cleanup(self) -> None:
        self.active = False
