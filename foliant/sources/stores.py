"""Sources and sinks of collections.

A store loads all items or a delta and saves items with the changes that led to them. File stores write each state to a
folder of its own and then replace a pointer, so that readers never see half a state; all paths go through Spark.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.changes import Load, diff, replay, snapshot


class Store(Protocol):
    def load(self) -> Load: ...

    def save(self, items: DataFrame, changes: DataFrame | None = None) -> None: ...

    def register(self, on_change: Callable[..., None]) -> None: ...

    def unregister(self) -> None: ...


class BaseStore:
    listener: Callable[..., None] | None = None

    def register(self, on_change: Callable[..., None]) -> None:
        self.listener = on_change

    def unregister(self) -> None:
        self.listener = None

    def changed(self, load: Load | None = None) -> None:
        if self.listener:
            self.listener(load)


class MemoryStore(BaseStore):
    """Holds the current DataFrame; delta mode hands out only what changed since the last load."""

    def __init__(self, df: DataFrame, delta: bool = False, key: str = "id") -> None:
        self.df, self.delta, self.key, self.seen = df, delta, key, None

    def load(self) -> Load:
        if not self.delta or self.seen is None:
            self.seen = self.df
            return Load(items=self.df)
        d = diff(self.seen, self.df, self.key)
        part = lambda kind, side: d.where(F.col("kind") == kind).select(self.key, f"{side}.*")
        self.seen = self.df
        return Load(added=part("added", "new"), modified=part("modified", "new"), removed=part("removed", "old"))

    def save(self, items: DataFrame, changes: DataFrame | None = None) -> None:
        self.df = items


def create_store(load: Callable[[], Load], save: Callable[[DataFrame, DataFrame | None], None] | None = None, register: Callable[[Callable[..., None]], None] | None = None, unregister: Callable[[], None] | None = None) -> BaseStore:
    """A store made of functions; without ``save`` it is read-only."""

    class Made(BaseStore):
        def load(self) -> Load:
            return load()

        def save(self, items: DataFrame, changes: DataFrame | None = None) -> None:
            if save is None:
                raise RuntimeError("this store cannot be written")
            save(items, changes)

        def register(self, on_change: Callable[..., None]) -> None:
            super().register(on_change)
            if register:
                register(on_change)

        def unregister(self) -> None:
            super().unregister()
            if unregister:
                unregister()

    return Made()


class VersionedStore(BaseStore):
    """Parquet or JSON states below a folder, named by a pointer that is written last."""

    def __init__(self, spark: SparkSession, folder: str, schema, form: str = "parquet") -> None:
        self.spark, self.folder, self.schema, self.form = spark, folder, schema, form
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        found = self.fs.globStatus(self.fs_path(f"{self.folder}/version=*/_SUCCESS"))
        return sorted(s.getPath().getParent().getName().partition("=")[2] for s in found or [])

    def load(self) -> Load:
        """The newest whole state; a folder without one is empty."""
        v = self.versions()
        if not v:
            return Load(items=self.spark.createDataFrame([], self.schema))
        return Load(items=self.spark.read.schema(self.schema).format(self.form).load(f"{self.folder}/version={v[-1]}"))

    def save(self, items: DataFrame, changes: DataFrame | None = None) -> None:
        n = int(self.versions()[-1].split("-")[0]) + 1 if self.versions() else 1
        items.select(*[f.name for f in self.schema.fields]).write.format(self.form).save(f"{self.folder}/version={n:010d}-{uuid.uuid4().hex}")
        self.changed()

    def vacuum(self, keep: int = 2) -> None:
        for v in self.versions()[:-keep]:
            self.fs.delete(self.fs_path(f"{self.folder}/version={v}"), True)


class BucketedStore(BaseStore):
    """A state in Parquet, dealt to buckets by a hash of the key; a change writes only the buckets that it touches.

    A manifest, one line that names each bucket's folder and the last batch that is in them, is written last, so that
    readers see whole states and a batch counts once, however often it is tried.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, key: str = "id", buckets: int = 64) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.globStatus(self.fs_path(f"{self.folder}/{pattern}")) or [])

    def manifest(self) -> dict:
        whole = [n for n in self._names("manifest=*") if self._names(f"{n}/_SUCCESS")]
        return json.loads(self.spark.read.text(f"{self.folder}/{whole[-1]}").first()[0]) if whole else {"version": 0, "batch": -1, "buckets": {}}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{f}" for f in sorted(folders)])

    def load(self) -> Load:
        return Load(items=self._read(list(self.manifest()["buckets"].values())))

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame, touched: list[int], batch: int | None) -> None:
        """Replace the touched buckets by ``rows``."""
        now, name = self.manifest(), f"data-{uuid.uuid4().hex}"
        names = [f.name for f in self.schema.fields]
        part = next(n for n in ("__bucket", "__bucket_", "__bucket__") if n not in names)
        rows.select(*names, self.bucket().alias(part)).write.partitionBy(part).parquet(f"{self.folder}/{name}")
        kept = {b: f for b, f in now["buckets"].items() if int(b) not in touched}
        kept |= {n.rpartition("=")[2]: f"{name}/{n}" for n in self._names(f"{name}/{part}=*")}
        state = {"version": now["version"] + 1, "batch": now["batch"] if batch is None else batch, "buckets": kept}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest={state['version']:010d}")
        self.changed()

    def save(self, items: DataFrame, changes: DataFrame | None = None) -> None:
        """With changes (rows of a diff), writes the buckets of their keys; without, all of them."""
        if changes is None:
            self._put(items, list(range(self.buckets)), None)
            return
        touched = [r[0] for r in changes.select(self.bucket()).distinct().collect()]
        self._put(items.where(self.bucket().isin(touched)), touched, None)

    def apply_log(self, log: DataFrame, batch: int) -> bool:
        """Replay a batch of changelog rows on the buckets that they touch; False where it is in the state already."""
        now = self.manifest()
        if batch <= now["batch"]:
            return False
        touched = [r[0] for r in log.select(self.bucket()).distinct().collect()]  # at most ``buckets``
        base = self._read([f for b, f in now["buckets"].items() if int(b) in touched])
        self._put(replay(base, log, self.key), touched, batch)
        return True

    def vacuum(self) -> None:
        """Delete the folders that the newest manifest doesn't name, and all older manifests."""
        held = {f.split("/")[0] for f in self.manifest()["buckets"].values()}
        for gone in [n for n in self._names("data-*") if n not in held] + self._names("manifest=*")[:-1]:
            self.fs.delete(self.fs_path(f"{self.folder}/{gone}"), True)


class JsonFileStore(BaseStore):
    """One JSON array in a file, with read-modify-write: upsert added and modified, ignore unknown removals.

    Rows become text on the executors; the driver only joins their files, and the new file takes the old one's place in
    one step. :meth:`watch` tells the listener of changes that others make.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: str = "id") -> None:
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.watching: threading.Event | None = None
        self.stamp = self._stamp()

    def _stamp(self) -> tuple[int, int] | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        status = fs.getFileStatus(p)
        return status.getModificationTime(), status.getLen()

    def poll(self) -> bool:
        """Whether the file is another than at the last look; then the listener is called."""
        now = self._stamp()
        if now == self.stamp:
            return False
        self.stamp = now
        self.changed()
        return True

    def watch(self, seconds: float = 1.0) -> None:
        """Poll until the store is unregistered."""
        self.unwatch()
        self.watching = stop = threading.Event()

        def run() -> None:
            while not stop.wait(seconds):
                self.poll()

        threading.Thread(target=run, daemon=True).start()

    def unwatch(self) -> None:
        if self.watching:
            self.watching.set()
            self.watching = None

    def unregister(self) -> None:
        self.unwatch()
        super().unregister()

    def load(self) -> Load:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return Load(items=self.spark.createDataFrame([], self.schema))
        return Load(items=self.spark.read.schema(self.schema).option("multiLine", True).json(self.path))

    def save(self, items: DataFrame, changes: DataFrame | None = None) -> None:
        """With changes (rows of a diff), merges them into what the file holds now; without, writes the items."""
        state = items
        if changes is not None and not changes.isEmpty():
            part = lambda kind, side: changes.where(F.col("kind") == kind).select(self.key, f"{side}.*")
            state = snapshot(self.load().items, part("added", "new"), part("modified", "new"), part("removed", "old"), key=self.key)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        target, mark = path(self.path), uuid.uuid4().hex
        fs, parts, staged = target.getFileSystem(conf), path(f"{self.path}.{mark}.parts"), path(f"{self.path}.{mark}")
        lines = state.select(F.concat(F.lit(","), F.to_json(F.struct(*[f"`{f.name}`" for f in self.schema.fields]))).alias("value"))
        lines.write.text(parts.toString())
        out, first = fs.create(staged), True
        out.write(b"[")
        for status in sorted(fs.globStatus(path(f"{parts}/part-*")) or [], key=lambda s: s.getPath().getName()):
            if status.getLen():
                own = fs.open(status.getPath())
                if first:
                    own.read()  # its comma
                first = False
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, conf, False)
                own.close()
        out.write(b"]")
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(target), over)
        fs.delete(parts, True)
        self.stamp = self._stamp()
        self.changed()


class ReplicatedStore(BaseStore):
    """Pull and push functions as a store."""

    def __init__(self, pull: Callable[[], Load], push: Callable[[DataFrame | None, DataFrame], None] | None = None) -> None:
        self.pull, self.push = pull, push

    def load(self) -> Load:
        return self.pull()

    def save(self, items: DataFrame, changes: DataFrame | None = None) -> None:
        if self.push is None:
            raise RuntimeError("this store cannot be written: it has no push")
        self.push(changes, items)


class TieredStore(BaseStore):
    """A fast store in front of a slow one.

    The first load serves the fast one while the slow one is being read; the next load has the slow one's result. A
    result of the slow one serves all loads for ``cache`` seconds.
    """

    def __init__(self, slow: BaseStore, fast: BaseStore, cache: float = 0.1, clock: Callable[[], float] = time.monotonic) -> None:
        self.slow, self.fast, self.cache, self.clock = slow, fast, cache, clock
        self.pending: Future[Load] | None = None
        self.first = True
        self.last: tuple[float, Load] | None = None

    def load(self) -> Load:
        if self.first:
            self.first = False
            pool = ThreadPoolExecutor(1)
            self.pending = pool.submit(self.slow.load)
            pool.shutdown(wait=False)
            return self.fast.load()
        if self.pending:
            pending, self.pending = self.pending, None
            out = pending.result()
        elif self.last and self.clock() - self.last[0] < self.cache:
            return self.last[1]
        else:
            out = self.slow.load()
        if out.items is not None:
            self.fast.save(out.items)
        self.last = self.clock(), out
        return out

    def save(self, items: DataFrame, changes: DataFrame | None = None) -> None:
        self.last = None
        self.fast.save(items, changes)
        self.slow.save(items, changes)

    def register(self, on_change: Callable[..., None]) -> None:
        self.slow.register(on_change)
        self.fast.register(on_change)


def apply_load(current: DataFrame, load: Load, key: str = "id") -> DataFrame:
    """A collection after a load: items replace all; of a delta, unknown modified or removed keys are an error."""
    if load.items is not None:
        return load.items
    for part in (load.modified, load.removed):
        if part is not None and not part.join(current, key, "left_anti").isEmpty():
            raise KeyError("a changed item is not in the collection")
    return load.on(current, key)
