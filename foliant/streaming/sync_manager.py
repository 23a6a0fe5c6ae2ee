"""Synchronisation of collections with remotes: changelog capture, queueing, operations log, conflict rule.

A local write hands over the rows that it wrote, so capturing it costs what the write touches, not a comparison of whole
collections. After ``push_delay`` seconds without another write they are pushed in the background. With a ``folder``,
snapshots and changelogs are kept below it and taken up again by the next manager, so a lost driver loses no write.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.changes import Load, diff, reconcile, sync
from foliant.plans.collection import SEQ, Collection, cut_lineage, cut_lineage_to


@dataclass
class Operation:
    collection: str
    start: float
    end: float | None = None
    status: str = "active"
    error: str | None = None
    id: str = field(default_factory=lambda: uuid.uuid4().hex)


def as_log(changes: DataFrame, at: float, seq: int, key: str = "id") -> DataFrame:
    """A diff as changelog rows: inserts and updates carry the fields they set."""
    names = [f.name for f in changes.schema["new"].dataType.fields]
    kind = F.when(F.col("kind") == "added", "insert").when(F.col("kind") == "modified", "update").otherwise("remove")
    top = F.array_distinct(F.transform("modified_fields", lambda p: F.split_part(p, F.lit("."), F.lit(1))))
    present = F.when(F.col("kind") == "added", F.array(*map(F.lit, names))).when(F.col("kind") == "modified", top).otherwise(F.array().cast("array<string>"))
    return changes.select(key, F.lit(at).alias("time"), F.lit(seq).alias("seq"), kind.alias("type"), present.alias("present"), *[F.col("new").getField(n).alias(n) for n in names])


class SyncManager:
    def __init__(self, pull: Callable[[str, dict], Load], push: Callable[[str, DataFrame], None], on_error: Callable[[str, Exception], None] | None = None, clock: Callable[[], float] = time.time, autostart: bool = True, push_delay: float | None = 0.1, folder: str | None = None) -> None:
        """push_delay: seconds without a write after which changes are pushed; None leaves that to :meth:`push_changes`."""
        self.pull, self.push, self.on_error, self.clock = pull, push, on_error, clock
        self.collections: dict[str, Collection] = {}
        self.properties: dict[str, dict[str, Any]] = {}
        self.snapshots: dict[str, DataFrame] = {}
        self.logs: dict[str, list[tuple[float, DataFrame]]] = defaultdict(list)
        self.operations: list[Operation] = []
        self.locks: dict[str, threading.RLock] = defaultdict(threading.RLock)
        self.timers: dict[str, threading.Timer] = {}
        self.paths: dict[int, str] = {}  # of the tables below ``folder``, by the DataFrame's id
        self.started: set[str] = set()
        self.push_delay, self.folder = push_delay, folder
        self.autostart, self.disposed, self.applying, self.seq = autostart, False, set(), 0

    def add_collection(self, collection: Collection, **properties: Any) -> None:
        name = collection.name
        self.collections[name], self.properties[name] = collection, properties
        if not self._restore(name):
            self.snapshots.setdefault(name, collection.df.drop(SEQ).limit(0))
        collection.on("written", lambda rows, n=name: self.capture(n, rows))
        if self.autostart:
            self.started.add(name)

    def is_ready(self, name: str) -> bool:
        """Whether the collection is here with what is kept of it; writes before that aren't captured."""
        return name in self.collections and name in self.snapshots

    # -- what is kept

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        if not self.folder:
            return cut_lineage(df)
        path = f"{self.folder}/{name}/table-{uuid.uuid4().hex}"
        out = cut_lineage_to(df, path)
        self.paths[id(out)] = path
        return out

    def _fs(self, spark):
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _states(self, name: str) -> list[str]:
        path, fs = self._fs(self.collections[name].spark)
        return sorted(x.getPath().getParent().toString() for x in fs.globStatus(path(f"{self.folder}/{name}/state-*/_SUCCESS")) or [])

    def _save(self, name: str) -> None:
        """The state is one line that names the tables; the newest whole one counts."""
        if not self.folder:
            return
        spark = self.collections[name].spark
        snapshot = self.paths.get(id(self.snapshots[name]))
        state = {"snapshot": snapshot, "logs": [[at, self.paths[id(df)]] for at, df in self.logs[name]], "seq": self.seq}
        old = self._states(name)
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.folder}/{name}/state-{len(old) and int(old[-1].rpartition('-')[2]) + 1:010d}")
        path, fs = self._fs(spark)
        for gone in old[:-1]:
            fs.delete(path(gone), True)

    def _restore(self, name: str) -> bool:
        if not self.folder or not (old := self._states(name)):
            return False
        spark = self.collections[name].spark
        state = json.loads(spark.read.text(old[-1]).first()[0])

        def table(path: str) -> DataFrame:
            out = spark.read.parquet(path)
            self.paths[id(out)] = path
            return out

        self.snapshots[name] = table(state["snapshot"]) if state["snapshot"] else self.collections[name].df.drop(SEQ).limit(0)
        self.logs[name] = [(at, table(p)) for at, p in state["logs"]]
        self.seq = max(self.seq, state["seq"])
        return True

    def get_collection_properties(self, name: str) -> dict[str, Any]:
        return self.properties[name]

    def capture(self, name: str, rows: DataFrame) -> None:
        """Note the rows of a local write; writes that a sync makes are none."""
        if name in self.applying or self.disposed:
            return
        self.seq += 1
        at = self.clock()
        self.logs[name].append((at, self._keep(rows.withColumns({"time": F.lit(at), "seq": F.lit(self.seq)}), name)))
        self._save(name)
        if self.push_delay is not None and name in self.started:
            self._cancel(name)
            self.timers[name] = threading.Timer(self.push_delay, self._push_later, [name])
            self.timers[name].daemon = True
            self.timers[name].start()

    def _cancel(self, name: str) -> None:
        if timer := self.timers.pop(name, None):
            timer.cancel()

    def _push_later(self, name: str) -> None:
        try:
            if not self.disposed:
                self.push_changes(name)
        except Exception:  # noqa: BLE001  the operation has noted it and on_error has heard it
            pass

    def is_syncing(self, name: str | None = None) -> bool:
        return any(o.status == "active" and name in (None, o.collection) for o in self.operations)

    def start(self, name: str) -> None:
        self.started.add(name)

    def pause(self, name: str) -> None:
        self.started.discard(name)

    def sync_all(self) -> None:
        errors = []
        for name in self.collections:
            try:
                self.sync(name)
            except Exception as e:  # noqa: BLE001  all are reported together
                errors.append(e)
        if errors:
            raise ExceptionGroup("some collections failed to sync", errors)

    def push_changes(self, name: str) -> None:
        self._cancel(name)
        self.sync(name, only_with_changes=True)

    def on_remote_change(self, name: str, load: Load | None = None) -> None:
        if name in self.started:
            self.sync(name, load=load)

    def sync(self, name: str, force: bool = False, only_with_changes: bool = False, load: Load | None = None) -> None:
        if self.disposed:
            raise RuntimeError("SyncManager is disposed")
        if force:
            self._sync(name, only_with_changes, load)
        else:
            with self.locks[name]:
                self._sync(name, only_with_changes, load)

    def _sync(self, name: str, only_with_changes: bool, load: Load | None) -> None:
        if only_with_changes and not self.logs[name]:
            return
        c, at = self.collections[name], self.clock()
        last = next((o for o in reversed(self.operations) if o.collection == name and o.status == "done"), None)
        op = Operation(name, at)
        self.operations.append(op)
        facts = {"lastFinishedSyncStart": last and last.start, "lastFinishedSyncEnd": last and last.end}
        try:
            mine = [x for x in self.logs[name] if x[0] <= at]
            plain = c.df.drop(SEQ)
            log = mine[0][1] if mine else as_log(diff(plain.limit(0), plain.limit(0), c.key), at, 0, c.key)
            for _, more in mine[1:]:
                log = log.unionByName(more, allowMissingColumns=True)
            log = log.withColumns({f.name: F.lit(None).cast(f.dataType) for f in plain.schema.fields if f.name not in log.columns})
            base = self.snapshots[name]
            for f in plain.schema.fields:
                if f.name not in base.columns:
                    base = base.withColumn(f.name, F.lit(None).cast(f.dataType))
                elif base.schema[f.name].dataType != f.dataType:  # a write has widened it
                    base = base.withColumn(f.name, F.col(f"`{f.name}`").cast(f.dataType))
            out = sync(base, log, load or self.pull(name, facts), lambda d: self.push(name, d), lambda: self.pull(name, facts), c.key)
            state = self._keep(out.state, name)
            self.snapshots[name] = state
            self.logs[name] = [x for x in self.logs[name] if not any(x is y for y in mine)]
            self._save(name)
            if self.logs[name]:
                self._sync(name, False, None)
            else:
                self.applying.add(name)
                try:
                    c.apply(reconcile(c.df.drop(SEQ), state, c.key))
                finally:
                    self.applying.discard(name)
            op.end, op.status = self.clock(), "done"
            self.operations = [o for o in self.operations if o.collection != name or o.status == "active" or o.start >= at]
        except Exception as e:
            op.end, op.status, op.error = self.clock(), "error", repr(e)
            if self.on_error:
                self.on_error(name, e)
            raise

    def dispose(self) -> None:
        self.disposed = True
        for name in list(self.timers):
            self._cancel(name)
        self.collections.clear()
