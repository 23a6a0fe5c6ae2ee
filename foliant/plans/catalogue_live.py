"""Registered queries of stores, live queries and synchronisation, each with its DuckDB equivalent, over whole tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import changes as C
from foliant.plans.collection import Collection, scratch
from foliant.plans.persistence import Persisted
from foliant.plans.registry import query, table
from foliant.plans.telemetry import Telemetry
from foliant.sources.stores import BaseStore, BucketedStore, JsonFileStore, MemoryStore, ReplicatedStore, TieredStore, VersionedStore, apply_load, create_store
from foliant.streaming.autofetch import AutoFetch
from foliant.streaming.changelog import read_changelog, replay_stream
from foliant.streaming.sync_manager import SyncManager

#: Customers before and after: some are renamed, some removed, some added.
BEFORE = "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 10 != 0"
AFTER = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name FROM customer WHERE c_custkey % 11 != 0"


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "customer")
    before = df.where("c_custkey % 10 != 0").selectExpr("c_custkey AS id", "c_name AS name")
    return before, df.where("c_custkey % 11 != 0").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name")


def stored(name: str, make: Callable[[SparkSession, DataFrame], BaseStore], sql: str = AFTER) -> None:
    """Two states saved one after the other, the second with the changes that lead to it, and read back."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before, after = states(spark, sf_dir)
        store = make(spark, before)
        store.save(before)
        store.save(after, C.diff(before, after))
        return store.load().items


stored("store_parquet", lambda spark, df: VersionedStore(spark, scratch(spark), df.schema))
stored("store_json", lambda spark, df: VersionedStore(spark, scratch(spark), df.schema, "json"))
stored("store_buckets", lambda spark, df: BucketedStore(spark, scratch(spark), df.schema, buckets=8))
stored("store_memory", lambda spark, df: MemoryStore(df))


@query("store_json_file", AFTER)
def store_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = states(spark, sf_dir)
    store = JsonFileStore(spark, f"{scratch(spark)}/items.json", before.schema)
    store.save(before)
    store.save(before, C.diff(before, after))  # the changes are merged into what the file holds
    return store.load().items


@query("store_tiered", AFTER + " UNION ALL SELECT -1, 'fast first'")
def store_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first load has the fast store's items, the second the slow one's."""
    before, after = states(spark, sf_dir)
    store = TieredStore(slow=MemoryStore(after), fast=MemoryStore(before.limit(0)))
    first = store.load().items.isEmpty()
    return store.load().items.union(spark.createDataFrame([(-1, "fast first")] if first else [], before.schema))


@query("store_replicated", AFTER)
def store_replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = states(spark, sf_dir)
    held = {"df": before}
    store = ReplicatedStore(lambda: C.Load(items=held["df"]), lambda changes, items: held.update(df=C.snapshot(held["df"], *(changes.where(F.col("kind") == k).select("id", f"{side}.*") for k, side in (("added", "new"), ("modified", "new"), ("removed", "old"))))))
    store.save(after, C.diff(before, after))
    return store.load().items


@query("store_delta", AFTER)
def store_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta load on top of the items before it; a change of an unknown item is an error."""
    before, after = states(spark, sf_dir)
    store = MemoryStore(before, delta=True)
    store.load()
    store.save(after)
    try:
        apply_load(before, C.Load(removed=before.limit(1).withColumn("id", F.lit(-1).cast("long"))))
    except KeyError:
        return apply_load(before, store.load())
    raise AssertionError("an unknown item was removed")


@query("persisted", "SELECT id, CASE WHEN id % 7 = 0 THEN 'seven' ELSE name END AS name FROM (" + BEFORE + ") WHERE id % 5 != 0 UNION ALL SELECT -1, 'early' UNION ALL SELECT -2, 'late'")
def persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after a load, an item from before it, writes, a batch and a reset."""
    before, _ = states(spark, sf_dir)
    store = VersionedStore(spark, scratch(spark), before.schema)
    store.save(before)
    c = Collection(spark.createDataFrame([(-1, "early")], before.schema))
    p = Persisted(c, store)
    c.update_many({"id": {"$mod": [7, 0]}}, {"$set": {"name": "seven"}})
    with c.batch():
        c.remove_many({"id": {"$mod": [5, 0]}})
        c.insert({"id": -2, "name": "late"})
    p.flush()
    p.reset_data()
    assert p.is_ready and not p.is_loading
    return store.load().items.join(c.find({}).to_df(), ["id", "name"], "left_semi")


class Remote:
    """A remote that takes what is pushed and hands out its state."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def pull(self, *_: Any) -> C.Load:
        return C.Load(items=self.df)

    def push(self, _: str, d: DataFrame) -> None:
        gone = d.where("kind = 'removed'").select("id")
        self.df = C.upsert(self.df.join(gone, "id", "left_anti"), d.where("kind != 'removed'").select("id", "new.*"))


SYNCED = "SELECT id, CASE WHEN id % 4 = 0 AND id % 10 != 0 THEN 'mine' ELSE name END AS name FROM (" + AFTER + ") WHERE id % 13 != 0 OR id % 10 = 0 UNION ALL SELECT -1, 'local'"


@query("sync_manager", SYNCED)
def sync_manager(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local writes on an older state are replayed on the remote's newer one, for items that both have or that it lacks."""
    before, after = states(spark, sf_dir)
    both = before.join(after.select("id"), "id", "left_semi")
    remote = Remote(both)
    m = SyncManager(remote.pull, remote.push, push_delay=None)
    c = Collection(both.limit(0), "catalogue_sync")
    m.add_collection(c)
    m.sync("catalogue_sync")
    remote.df = after
    c.update_many({"id": {"$mod": [4, 0]}}, {"$set": {"name": "mine"}})
    c.remove_many({"id": {"$mod": [13, 0]}})
    c.insert({"id": -1, "name": "local"})
    m.push_changes("catalogue_sync")
    m.sync("catalogue_sync")
    assert m.is_ready("catalogue_sync") and not m.is_syncing()
    out = c.find({}).to_df()
    m.dispose()
    c.dispose()
    return out.join(remote.df, ["id", "name"], "left_semi")


@query("sync_restart", "SELECT id, CASE WHEN id % 4 = 0 THEN 'mine' ELSE name END AS name FROM (" + BEFORE + ") WHERE id % 13 != 0")
def sync_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that a lost driver had captured, but not pushed, are pushed by the next one."""
    before, _ = states(spark, sf_dir)
    folder, remote = scratch(spark), Remote(before)
    first = SyncManager(remote.pull, remote.push, push_delay=None, folder=folder)
    c = Collection(before.limit(0), "catalogue_restart")
    first.add_collection(c)
    first.sync("catalogue_restart")
    c.update_many({"id": {"$mod": [4, 0]}}, {"$set": {"name": "mine"}})
    c.remove_many({"id": {"$mod": [13, 0]}})
    first.dispose()
    c.dispose()
    second = SyncManager(remote.pull, remote.push, push_delay=None, folder=folder)
    again = Collection(before.limit(0), "catalogue_restart")
    second.add_collection(again)
    second.push_changes("catalogue_restart")
    out = again.find({}).to_df()
    second.dispose()
    again.dispose()
    return out.join(remote.df, ["id", "name"], "left_semi")


@query("debounced_push", "SELECT id, CASE WHEN id % 4 = 0 THEN 'mine' ELSE name END AS name FROM (" + BEFORE + ")")
def debounced_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local write reaches the remote without being asked to."""
    before, _ = states(spark, sf_dir)
    remote = Remote(before)
    m = SyncManager(remote.pull, remote.push, push_delay=0.05)
    c = Collection(before.limit(0), "catalogue_debounced")
    m.add_collection(c)
    m.sync("catalogue_debounced")
    c.update_many({"id": {"$mod": [4, 0]}}, {"$set": {"name": "mine"}})
    for _ in range(600):
        if not m.logs["catalogue_debounced"] and not m.is_syncing():
            break
        time.sleep(0.1)
    m.dispose()
    c.dispose()
    return remote.df


@query("changelog", "SELECT id, 'remove' AS type, 0 AS fields, CAST(NULL AS VARCHAR) AS name FROM (" + BEFORE + ") WHERE id % 13 = 0 UNION ALL SELECT id, 'update', 1, 'mine' FROM (" + BEFORE + ") WHERE id % 4 = 0 UNION ALL SELECT -1, 'insert', 1, 'local'")
def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that writes hand to a changelog: what they touch and nothing else."""
    c, logs = Collection(states(spark, sf_dir)[0]), []
    c.on("written", logs.append)
    c.update_many({"id": {"$mod": [4, 0]}}, {"$set": {"name": "mine"}})
    c.remove_many({"id": {"$mod": [13, 0]}})
    c.insert({"id": -1, "name": "local"})
    out = logs[0].unionByName(logs[1]).unionByName(logs[2])
    return out.select("id", "type", F.size("present").alias("fields"), F.when(F.col("type") != "remove", F.col("name")).alias("name"))


@query("changelog_stream", "SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def changelog_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changelog in files, replayed by micro-batches."""
    folder = scratch(spark)
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.lit("update").alias("type"), F.array(F.lit("kind"), F.lit("value")).alias("present"), F.col("event_type").alias("kind"), "value")
    state = log.select("id", "kind", "value").schema
    store = BucketedStore(spark, f"{folder}/state", state, buckets=16)
    ordered = log.repartitionByRange(2, "time").sortWithinPartitions("time", "seq")
    ordered.write.parquet(f"{folder}/log")
    replay_stream(read_changelog(spark, f"{folder}/log", log.schema, 10), store, f"{folder}/checkpoint").awaitTermination()
    return store.load().items


def noted(name: str, sql: str, schema: str, run: Callable[[SparkSession, str], list[tuple]]) -> None:
    """What callbacks have heard, as rows."""

    @query(name, sql)
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(run(spark, sf_dir), schema)


def observed(spark: SparkSession, sf_dir: str) -> list[tuple]:
    c, heard = Collection(states(spark, sf_dir)[0]), []
    calls = {k: (lambda e, k=k: heard.append((k, e["id"]))) for k in ("added", "changed", "removed")}
    o = c.observe({"id": {"$lt": 50}}, calls, skip_initial=True, fields={"name": 1})
    c.update_many({"id": {"$mod": [4, 0]}}, {"$set": {"name": "mine"}})
    with c.batch():
        c.remove_many({"id": {"$mod": [13, 0]}})
        c.insert({"id": -1, "name": "new"})
        if any(k != "changed" for k, _ in heard):
            heard.append(("too early", 0))
    o.cleanup()
    c.remove_many({})
    return heard


noted("observer_callbacks", "SELECT 'changed' AS event, id FROM (" + BEFORE + ") WHERE id < 50 AND id % 4 = 0 UNION ALL SELECT 'removed', id FROM (" + BEFORE + ") WHERE id < 50 AND id % 13 = 0 UNION ALL SELECT 'added', -1", "event string, id long", observed)


def counted(spark: SparkSession, sf_dir: str) -> list[tuple]:
    c, heard = Collection(states(spark, sf_dir)[0]), []
    o = c.observe_count({"id": {"$lt": 50}}, heard.append)
    c.update_many({"id": {"$lt": 50}}, {"$set": {"name": "same number"}})
    c.remove_many({"id": {"$mod": [13, 0]}})
    o.cleanup()
    c.remove_many({})
    return list(enumerate(heard))


noted("reactive_count", "SELECT 0 AS nth, count(*) AS n FROM (" + BEFORE + ") WHERE id < 50 UNION ALL SELECT 1, count(*) FROM (" + BEFORE + ") WHERE id < 50 AND id % 13 != 0", "nth int, n long", counted)


def tracked(spark: SparkSession, sf_dir: str) -> list[tuple]:
    c, heard = Collection(table(spark, sf_dir, "nation"), key="n_nationkey"), []
    c.set_field_tracking(True)
    e = c.effect({"n_nationkey": {"$lt": 5}}, lambda items: heard.append(",".join(sorted(i["n_name"] for i in items))), sort={"n_nationkey": 1})
    c.update_many({}, {"$inc": {"n_regionkey": 1}})  # a field that the effect hasn't read
    c.update_many({"n_nationkey": 3}, {"$set": {"n_name": "X"}})
    c.update_many({"n_nationkey": 9}, {"$set": {"n_name": "Y"}})  # no item of the effect
    c.remove_many({"n_nationkey": 4})
    e.cleanup()
    return list(enumerate(heard))


noted(
    "field_tracking", "SELECT 0 AS nth, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 1, string_agg(n, ',' ORDER BY n) FROM (SELECT CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END AS n FROM nation WHERE n_nationkey < 5) UNION ALL SELECT 2, string_agg(n, ',' ORDER BY n) FROM (SELECT CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END AS n FROM nation WHERE n_nationkey < 4)",
    "nth int, names string", tracked,
)


class Recomputer:
    """The least that a reactive framework is: it runs a function, and again when what that has read changes."""

    def __init__(self) -> None:
        self.now, self.made, self.ends = None, [], []

    def create(self) -> Recomputer:
        return self

    def is_in_scope(self) -> bool:
        return self.now is not None

    def on_dispose(self, f: Callable[[], Any], dependency: Any) -> None:
        self.ends.append(f)

    def depend(self) -> None:
        self.made.append(self.now)

    def notify(self) -> None:
        for end in self.ends:
            end()
        again, self.made, self.ends = list(self.made), [], []
        for f in again:
            self.compute(f)

    def compute(self, f: Callable[[], Any]) -> None:
        self.now = f
        try:
            f()
        finally:
            self.now = None


def recomputed(spark: SparkSession, sf_dir: str) -> list[tuple]:
    r, heard = Recomputer(), []
    c = Collection(table(spark, sf_dir, "nation"), key="n_nationkey", reactivity=r)
    r.compute(lambda: heard.append(c.find({"n_regionkey": 1}).count()))
    c.update_many({"n_regionkey": 2}, {"$set": {"n_name": "elsewhere"}})
    c.remove_one({"n_regionkey": 1})
    c.insert({"n_nationkey": -1, "n_regionkey": 1})
    r.compute(lambda: c.find({}, reactive=False))
    c.insert({"n_nationkey": -2, "n_regionkey": 3})
    return list(enumerate(heard))


noted("reactivity", "SELECT nth, n - (nth = 1)::INT AS n FROM (SELECT count(*) AS n FROM nation WHERE n_regionkey = 1), (VALUES (0), (1), (2)) t(nth)", "nth int, n long", recomputed)


@query("store_of_functions", AFTER)
def store_of_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = states(spark, sf_dir)
    held: dict[str, DataFrame] = {"df": before}
    store = create_store(lambda: C.Load(items=held["df"]), lambda items, changes: held.update(df=items))
    store.save(after, C.diff(before, after))
    return store.load().items


def lived(spark: SparkSession, sf_dir: str) -> list[tuple]:
    heard: list[tuple] = []
    made, gone = (lambda c: heard.append(("created", c.name))), (lambda c: heard.append(("disposed", c.name)))
    Collection.on_creation(made)
    Collection.on_dispose(gone)
    try:
        c = Collection(table(spark, sf_dir, "region"), "catalogue_life", key="r_regionkey")
        heard.append(("registered", c.name if c in Collection.get_collections() else ""))
        c.once("updateMany", lambda *a: heard.append(("once", str(a[-1]))))
        c.on("validate", lambda *_: heard.append(("validate", "")))
        c.update_many({}, {"$set": {"r_name": "A"}})
        c.update_many({}, {"$set": {"r_name": "B"}})
        c.set_debug_mode(True)
        c.once("_debug.find", lambda *a: heard.append(("debug", str("Parquet" in a[-1]))))
        c.find({"r_regionkey": 1})
        c.dispose()
        for call in (lambda: c.find({}), lambda: c.insert({}), lambda: c.observe({}, {}), lambda: c.on("x", print), lambda: c.emit("x"), c.dispose):
            try:
                call()
                heard.append(("alive", ""))
            except RuntimeError:
                pass
        heard.append(("unregistered", str(c not in Collection.get_collections())))
    finally:
        Collection.creation_hooks.remove(made)
        Collection.dispose_hooks.remove(gone)
    return heard


noted("lifecycle", "SELECT * FROM (VALUES ('created', 'catalogue_life'), ('registered', 'catalogue_life'), ('validate', ''), ('once', (SELECT count(*)::VARCHAR FROM region)), ('validate', ''), ('debug', 'True'), ('disposed', 'catalogue_life'), ('unregistered', 'True')) t(event, what)", "event string, what string", lived)


def telemetry(spark: SparkSession, sf_dir: str) -> list[tuple]:
    c, t = Collection(table(spark, sf_dir, "nation"), "catalogue_telemetry", key="n_nationkey"), Telemetry(spark)
    t.watch(c)
    for _ in range(3):
        c.find({"n_regionkey": 1})
    with t.timed("catalogue_telemetry", c.find({"n_regionkey": 2})) as cursor:
        n = cursor.count()
    out = [(r["event"], r["selector"], r["calls"]) for r in t.table().collect()] + [("rows", "", n)]
    c.dispose()
    return out


noted("telemetry", "SELECT * FROM (VALUES ('find', '{''n_regionkey'': 1}', 3), ('find', '{''n_regionkey'': 2}', 1), ('timed', '{''n_regionkey'': 2}', 1), ('rows', '', (SELECT count(*) FROM nation WHERE n_regionkey = 2))) t(event, selector, calls)", "event string, selector string, calls long", telemetry)


@query("autofetch", "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey = 3 THEN c_acctbal END AS bal FROM customer WHERE c_nationkey IN (2, 3)")
def autofetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries held by observers, one of them fetched twice, and one that is purged; their items are merged."""
    c, asked, now = table(spark, sf_dir, "customer"), [], [0.0]

    def fetch(selector: dict) -> DataFrame:
        asked.append(selector)
        rows = c.where(F.col("c_nationkey") == selector["nation"])
        return rows.selectExpr("c_custkey AS id", "c_name AS name", *(["c_acctbal AS bal"] if selector["nation"] == 3 else []))

    a = AutoFetch(fetch, 10, clock=lambda: now[0])
    held = [a.observe({"nation": n}, {}, skip_initial=True) for n in (2, 3, 3)]
    a.find({"nation": 4})
    assert len(asked) == 3 and len(a.cached) == 3
    now[0] = 11.0
    a.purge()
    held[1].cleanup()
    a.refetch()
    assert len(a.cached) == 2 and len(asked) == 5 and not a.is_loading()
    path = scratch(spark)
    a.items().select("id", "name", "bal").write.parquet(path)
    a.dispose()
    return spark.read.parquet(path)
