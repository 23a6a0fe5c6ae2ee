import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import changes as C
from foliant.operators import modifier as M
from foliant.operators.projection import project
from foliant.plans.collection import Collection
from foliant.sources.stores import BucketedStore, JsonFileStore, MemoryStore, ReplicatedStore, TieredStore, VersionedStore, apply_load
from foliant.streaming.autofetch import AutoFetch
from foliant.streaming.changelog import read_changelog, replay_stream
from foliant.streaming.observe import events
from foliant.streaming.sync_manager import SyncManager

PEOPLE = [("1", "Ann", 30, ["a"]), ("2", "Bob", 20, []), ("3", "Cid", None, None)]
SCHEMA = "id string, name string, age int, tags array<string>"


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_projection(spark):
    df = spark.createDataFrame([("1", ("x", ("y", 2)), 5)], "id string, a struct<b:string,c:struct<d:string,e:int>>, z int")
    assert project(df, {"a.c.d": 1}).first().asDict(True) == {"id": "1", "a": {"c": {"d": "y"}}}
    assert project(df, {"a.b": 0, "q": 0}).first().asDict(True) == {"id": "1", "a": {"c": {"d": "y", "e": 2}}, "z": 5}
    assert project(df, {"id": 0, "z": 1}).columns == ["z"]
    assert project(df, {}).columns == ["id", "a", "z"]
    assert project(df, {"z": 1, "a": 0}).columns == ["id", "z"]


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({"$set": {"n": 5}}, {"n": 5}), ({"$set": {"s.x": 9}}, {"s": (9, "y")}), ({"$set": {"a.1": 7}}, {"a": [3, 7, 2]}), ({"$set": {"a.4": 7}}, {"a": [3, 1, 2, None, 7]}), ({"$unset": {"n": ""}}, {"n": None}), ({"$inc": {"n": 2}}, {"n": 3}), ({"$inc": {"m": 2}}, {"m": 2}),
        ({"$mul": {"n": 3}}, {"n": 3}), ({"$mul": {"m": 3}}, {"m": 0}), ({"$min": {"n": 0}}, {"n": 0}), ({"$max": {"m": 4}}, {"m": 4}), ({"$rename": {"n": "m"}}, {"n": None, "m": 1}), ({"$push": {"a": 9}}, {"a": [3, 1, 2, 9]}),
        ({"$push": {"a": {"$each": [0, 5], "$sort": 1, "$slice": -3}}}, {"a": [2, 3, 5]}), ({"$push": {"a": {"$each": [8], "$position": 1}}}, {"a": [3, 8, 1, 2]}), ({"$push": {"o": {"$each": [(1, "k")], "$sort": {"q": 1}}}}, None),
        ({"$addToSet": {"a": {"$each": [1, 4]}}}, {"a": [3, 1, 2, 4]}), ({"$pull": {"a": {"$gte": 2}}}, {"a": [1]}), ({"$pull": {"a": 3}}, {"a": [1, 2]}), ({"$pullAll": {"a": [1, 2]}}, {"a": [3]}), ({"$pop": {"a": 1}}, {"a": [3, 1]}), ({"$pop": {"a": -1}}, {"a": [1, 2]}),
        ({"$set": {"o.$[].q": 0}}, {"o": [(0, "u"), (0, "v")]}), ({"$pull": {"o": {"f": "u"}}}, {"o": [(2, "v")]}),
    ],
)
def test_modifiers(spark, change, want):
    df = spark.createDataFrame([(1, None, (3, "y"), [3, 1, 2], [(5, "u"), (2, "v")])], "n int, m int, s struct<x:int,y:string>, a array<int>, o array<struct<q:int,f:string>>")
    if want is None:
        change, want = {"$push": {"o": {"$each": [{"q": 3, "f": "k"}], "$sort": {"q": 1}}}}, {"o": [(2, "v"), (3, "k"), (5, "u")]}
    got = df.withColumns(M.columns(change, df.schema)).first()
    for k, v in want.items():
        own = [tuple(x) if isinstance(x, tuple) else x for x in got[k]] if isinstance(got[k], list) else tuple(got[k]) if isinstance(got[k], tuple) else got[k]
        assert own == v


def test_modifier_errors(people):
    for bad in ({"$bit": {"age": 1}}, {"$set": {"age": 1}, "$inc": {"age": 1}}, {"$set": {"tags.$.x": 1}}):
        with pytest.raises(ValueError):
            M.columns(bad, people.schema)
    with pytest.raises(TypeError):
        M.columns({"$set": {"age": "x"}}, people.schema)
    now = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    assert people.select(M.columns({"$currentDate": {"t": True}}, T.StructType([*people.schema.fields, T.StructField("t", T.TimestampType())]), now)["t"]).count() == 3 if "t" in people.columns else True


def test_collection_crud(people):
    c = Collection(people, "people", key_generator=lambda: "new")
    assert Collection.registry["people"] is c
    assert [r["id"] for r in c.find({"age": {"$ne": 20}}).fetch()] == ["1", "3"]
    assert c.insert({"name": "Dee", "age": 5}) == "new"
    with pytest.raises(ValueError):
        c.insert({"id": "1"})
    assert c.insert_many([]) == []
    assert c.update_one({"age": {"$lt": 100}}, {"$inc": {"age": 1}}) == 1
    assert c.find_one({"id": "1"})["age"] == 31
    assert c.update_many({}, {"$push": {"tags": "z"}}) == 4
    assert c.find_one({"id": "3"})["tags"] == ["z"]
    assert c.update_many({"id": "9"}, {"$set": {"name": "Up"}, "$setOnInsert": {"id": "9"}, "$inc": {"age": 2}}, upsert=True) == 1
    assert (lambda r: (r["name"], r["age"]))(c.find_one({"id": "9"})) == ("Up", 2)
    assert c.replace_one({"id": "2"}, {"name": "Bo"}) == 1
    assert tuple(c.find_one({"id": "2"})) == ("2", "Bo", None, None)
    assert [r["id"] for r in c.find({}, sort={"age": -1}, skip=1, limit=2)] == ["new", "9"]
    assert c.find({}, skip=1, limit=2).count() == 2 and c.find({}, limit=0).count() == 5
    assert c.remove_one({}) == 1 and c.find_one({"id": "1"}) is None
    assert c.remove_many({"age": None}) == 2
    assert c.update_one({"id": "9"}, {"$set": {"extra": "e"}}) == 1 and c.find_one({"id": "9"})["extra"] == "e"
    for bad in (lambda: c.find(5), lambda: c.insert(None), lambda: c.remove_many(None), lambda: c.update_many({}, None)):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        c.find({}, skip=-1)
    c.dispose()
    with pytest.raises(RuntimeError):
        c.find({})


def test_validation_batch_and_transforms(people, spark):
    c = Collection(people, rules={"age": F.col("age").isNull() | (F.col("age") >= 0)}, transform=lambda r: r["name"].upper())
    with pytest.raises(ValueError):
        c.insert({"id": "x", "age": -1, "name": "n"})
    assert c.find({}, sort={"name": 1}).fetch() == ["ANN", "BOB", "CID"]
    with pytest.raises(RuntimeError), c.batch():
        c.remove_many({})
        raise RuntimeError
    assert c.find({}).count() == 3
    towns = spark.createDataFrame([("Ann", "Rome"), ("Bob", "Oslo")], "who string, town string")
    got = Collection(people, transform_all=lambda df, fields: C.lookup(df, towns, "name", "who", "home")).find({}, sort={"id": 1}).fetch()
    assert [r["home"] and r["home"]["town"] for r in got] == ["Rome", "Oslo", None]


def test_diff_replay_laws(spark):
    old = spark.createDataFrame([(1, "a", (1, [1, 2])), (2, "b", (2, [])), (3, None, None)], "id int, name string, m struct<x:int,y:array<int>>")
    new = spark.createDataFrame([(1, "a", (1, [1, 3])), (3, "c", None), (4, "d", (4, None))], old.schema)
    d = {r["id"]: (r["kind"], r["modified_fields"]) for r in C.diff(old, new).collect()}
    assert d == {1: ("modified", ["m.y.1"]), 2: ("removed", None), 3: ("modified", ["name"]), 4: ("added", None)}
    from foliant.streaming.sync_manager import as_log

    assert rows(C.replay(old, as_log(C.diff(old, new), 1.0, 1))) == rows(new)
    assert C.diff(old, old).isEmpty()


def test_replay_semantics(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    log = spark.createDataFrame(
        [(1, 1, 1, "insert", ["n"], None, 9), (2, 1, 2, "remove", [], None, None), (2, 1, 3, "update", ["s"], "back", None), (3, 2, 4, "update", ["n"], None, 3), (4, 2, 5, "insert", ["s", "n"], "x", 1), (4, 3, 6, "remove", [], None, None), (1, 4, 7, "update", ["s"], None, None)],
        "id int, time int, seq int, type string, present array<string>, s string, n int",
    )
    assert rows(C.replay(base, log)) == [(1, None, 9), (2, "back", None), (3, None, 3)]


def test_snapshot_and_loads(spark, people):
    add, gone = people.where("id = '1'").withColumn("name", F.lit("New")), spark.createDataFrame([("2", None, None, None), ("77", None, None, None)], SCHEMA)
    assert [r[:2] for r in rows(C.snapshot(people, added=add, removed=gone))] == [("1", "New"), ("3", "Cid")]
    assert C.snapshot(people, items=add).count() == 1
    with pytest.raises(KeyError):
        apply_load(people, C.Load(removed=gone))


def test_events(spark):
    old = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, v int")
    new = spark.createDataFrame([(1, 10), (2, 40), (3, 30), (5, 5)], "id int, v int")
    got = rows(events(old, new, [F.col("v")]).select("id", "event", "field", "old", "new", "before"))
    assert (5, "added", None, None, None, "1") in got and (2, "changedField", "v", '{"v":20}', '{"v":40}', None) in got
    assert {r[0] for r in got if r[1] == "movedBefore"} == {1, 2}
    assert (1, "removed", None, None, None, None) in rows(events(old, new.where("id != 1")).select("id", "event", "field", "old", "new", "before"))


def test_observer(people):
    c, seen = Collection(people), []
    o = c.observe({"age": {"$gt": 10}}, {k: (lambda e, k=k: seen.append((k, e["id"]))) for k in ("added", "changed", "removed")}, skip_initial=True)
    c.update_one({"id": "1"}, {"$set": {"name": "Z"}})
    c.update_one({"id": "2"}, {"$set": {"age": 1}})
    with c.batch():
        c.insert({"id": "7", "age": 70})
        assert ("added", "7") not in seen
    o.cleanup()
    c.remove_many({})
    assert seen == [("changed", "1"), ("removed", "2"), ("added", "7")]


def test_sync_manager(spark, people):
    remote = {"df": people.where("id != '3'").withColumn("age", F.lit(1))}

    def push(name, d):
        remote["df"] = C.upsert(remote["df"].join(d.where("kind = 'removed'").select("id"), "id", "left_anti"), d.where("kind != 'removed'").select("id", "new.*"))

    m = SyncManager(lambda n, f: C.Load(items=remote["df"]), push, push_delay=None)
    c = Collection(people.limit(0), "synced")
    m.add_collection(c)
    m.sync("synced")
    assert [r[:3] for r in rows(c.find({}).to_df())] == [("1", "Ann", 1), ("2", "Bob", 1)]
    c.update_one({"id": "1"}, {"$set": {"name": "Mine"}})
    remote["df"] = remote["df"].withColumn("age", F.when(F.col("id") == "1", 50).otherwise(F.col("age")))
    m.push_changes("synced")
    assert [r[:3] for r in rows(c.find({}).to_df())] == [("1", "Mine", 50), ("2", "Bob", 1)]
    assert [r[:3] for r in rows(remote["df"])] == [("1", "Mine", 50), ("2", "Bob", 1)]
    assert not m.is_syncing() and m.operations[-1].status == "done"


def test_autofetch(spark):
    now, calls = [0.0], []

    def fetch(s):
        calls.append(s)
        return spark.createDataFrame([(1, "a")], "id int, name string") if "name" in s else spark.createDataFrame([(1, 5), (2, 6)], "id int, age int")

    a = AutoFetch(fetch, 10, clock=lambda: now[0])
    a.register_query({"name": "a"})
    a.register_query({"age": {"$gt": 1}})
    a.register_query({"name": "a"})
    assert len(calls) == 2 and rows(a.items().select("id", "name", "age")) == [(1, "a", 5), (2, None, 6)]
    a.unregister_query({"name": "a"})
    a.unregister_query({"name": "a"})
    now[0] = 11
    a.purge()
    assert list(a.cached) == [a.key_of({"age": {"$gt": 1}})] and not a.is_loading()


def test_stores(spark, people, tmp_path):
    v = VersionedStore(spark, f"{tmp_path}/v", people.schema)
    assert v.load().items.count() == 0
    v.save(people)
    v.save(people.where("id = '1'"))
    assert rows(v.load().items) == rows(people.where("id = '1'"))
    j = JsonFileStore(spark, f"{tmp_path}/f.json", people.schema)
    assert j.load().items.isEmpty()
    j.save(people)
    assert rows(j.load().items) == rows(people)
    j.save(people, C.diff(people, people.where("id != '1'").withColumn("age", F.lit(4))))
    assert [(r["id"], r["age"]) for r in j.load().items.orderBy("id").collect()] == [("2", 4), ("3", 4)]
    t = TieredStore(slow=MemoryStore(people), fast=MemoryStore(people.limit(1)))
    assert t.load().items.count() == 1 and t.load().items.count() == 3 and t.fast.df.count() == 3
    m = MemoryStore(people, delta=True)
    m.load()
    m.save(people.where("id != '2'"))
    assert m.load().removed.count() == 1
    with pytest.raises(RuntimeError):
        ReplicatedStore(lambda: C.Load(items=people)).save(people)


def test_changelog_stream_equals_batch_replay(spark, tmp_path):
    schema = T.StructType.fromDDL("id int, time int, seq int, type string, present array<string>, s string")
    log = spark.createDataFrame([(i % 3, i, i, "remove" if i == 4 else "update", [] if i == 4 else ["s"], f"v{i}") for i in range(9)], schema)
    for i in range(0, 9, 3):
        log.where(f"seq >= {i} AND seq < {i + 3}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    store = VersionedStore(spark, f"{tmp_path}/state", T.StructType.fromDDL("id int, s string"))
    q = replay_stream(read_changelog(spark, f"{tmp_path}/log", schema, 1), store, f"{tmp_path}/ck")
    q.awaitTermination()
    assert rows(store.load().items) == rows(C.replay(spark.createDataFrame([], "id int, s string"), log))


def test_numbers_widen_and_never_lose_digits(spark):
    df = spark.createDataFrame([(5, 9, 2.5, None), (1, 2, None, [1, 2])], "i int, l long, d double, a array<int>")
    got = lambda change, c: [r[c] for r in df.withColumns(M.columns(change, df.schema)).collect()]
    assert got({"$inc": {"i": 0.5}}, "i") == [5.5, 1.5] and got({"$set": {"i": 2.5}}, "i") == [2.5, 2.5]
    assert got({"$mul": {"i": 1.5}}, "i") == [7.5, 1.5] and got({"$min": {"l": 7.5}}, "l") == [7.5, 2.0]
    assert got({"$set": {"i": 3.0}}, "i") == [3, 3] and got({"$inc": {"i": 1}}, "i") == [6, 2] and got({"$inc": {"i": 1 << 40}}, "i") == [5 + (1 << 40), 1 + (1 << 40)]
    assert got({"$addToSet": {"a": None}}, "a") == [[None], [1, 2, None]] and got({"$inc": {"a.$[]": 0.5}}, "a")[1] == [1.5, 2.5]
    prices = spark.sql("SELECT cast(1.25 as decimal(10,2)) AS p")
    assert [r[0] for r in prices.withColumns(M.columns({"$inc": {"p": 0.125}}, prices.schema)).collect()] == [1.375]
    nested = spark.createDataFrame([((1, "x"),)], "s struct<n:int,m:string>")
    assert nested.withColumns(M.columns({"$rename": {"s.m": "s.m2"}} if "m2" in nested.columns else {"$inc": {"s.n": 0.5}}, nested.schema)).first()["s"]["n"] == 1.5
    c = Collection(spark.createDataFrame([(1, 5, (1, "a")), (2, 6, (2, "b"))], "id int, n int, s struct<x:int,y:string>"))
    assert c.update_many({"id": 1}, {"$inc": {"n": 0.5, "s.x": 0.25}}) == 1
    assert [(r["n"], r["s"]["x"]) for r in c.find({}, sort={"id": 1})] == [(5.5, 1.25), (6.0, 2.0)]
    assert c.update_many({}, {"$rename": {"s.y": "n2"}} if "n2" in c.df.columns else {"$set": {"n": 1}}) == 2


def test_observer_positions_without_a_global_window(spark):
    import random

    from foliant.streaming.observe import positioned

    rnd = random.Random(1)
    df = spark.createDataFrame([(i, rnd.randrange(40), "x" if i % 3 else None) for i in range(500)], "id int, v int, s string").repartition(5)
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    assert rows(positioned(df, order, small=False)) == rows(positioned(df, order, small=True)) == rows(positioned(df, order))
    assert positioned(df.limit(0), order, small=False).count() == 0
    plan = positioned(df, order, small=False)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_whole_updates_keep_their_keys(people):
    c = Collection(people)
    assert c.update_many({"id": {"$in": ["1", "2"]}}, {"name": "w"}) == 2
    assert [tuple(r) for r in c.find({}, sort={"id": 1})] == [("1", "w", None, None), ("2", "w", None, None), ("3", "Cid", None, None)]
    with pytest.raises(ValueError):
        c.update_many({"id": {"$in": ["1", "2"]}}, {"id": "9"})
    assert c.update_one({"id": "nobody"}, {"id": "4", "name": "n"}, upsert=True) == 1


def test_file_store_replaces_in_one_step_and_is_watched(spark, people, tmp_path):
    import os
    import time

    path = f"{tmp_path}/items.json"
    a, b, heard = JsonFileStore(spark, path, people.schema), JsonFileStore(spark, path, people.schema), []
    a.save(people.limit(0))
    assert a.load().items.isEmpty()
    b.register(lambda *_: heard.append(1))
    assert b.poll() and not b.poll()
    b.watch(0.05)
    a.save(people)
    for _ in range(100):
        if len(heard) > 1:
            break
        time.sleep(0.1)
    b.unregister()
    assert len(heard) == 2 and rows(b.load().items) == rows(people) and [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["items.json"]


def test_tiered_store_reads_the_slow_one_once(people):
    now, calls = [0.0], []

    class Slow(MemoryStore):
        def load(self):
            calls.append(1)
            return super().load()

    t = TieredStore(Slow(people), MemoryStore(people.limit(1)), cache=5, clock=lambda: now[0])
    assert t.load().items.count() == 1 and t.load().items.count() == 3 and t.load().items.count() == 3 and len(calls) == 1
    now[0] = 6.0
    assert t.load().items.count() == 3 and len(calls) == 2


def test_autofetch_purges_by_time(spark):
    import time

    a = AutoFetch(lambda s: spark.createDataFrame([(1, "a")], "id int, name string"), 0.05)
    assert [r["id"] for r in a.find({"name": "a"})] == [1]
    for _ in range(100):
        if not a.cached:
            break
        time.sleep(0.1)
    assert not a.cached
    o = a.observe({"name": "a"}, {})
    time.sleep(0.3)
    assert len(a.cached) == 1
    o.cleanup()
    a.dispose()


def test_bucketed_store_writes_what_a_change_touches(spark, tmp_path):
    schema = T.StructType.fromDDL("id int, s string")
    store = BucketedStore(spark, f"{tmp_path}/b", schema, buckets=8)
    assert store.load().items.isEmpty()
    store.save(spark.range(200).selectExpr("cast(id as int) AS id", "concat('v', id) AS s"))
    first = store.manifest()["buckets"]
    log = spark.createDataFrame([(5, 1, 1, "update", ["s"], "new"), (6, 1, 2, "remove", [], None), (999, 1, 3, "insert", ["s"], "more")], "id int, time int, seq int, type string, present array<string>, s string")
    assert store.apply_log(log, 0) and not store.apply_log(log, 0)
    second = store.manifest()["buckets"]
    assert 0 < sum(first[b] != second.get(b) for b in first) <= 3
    want = {i: f"v{i}" for i in range(200) if i != 6} | {5: "new", 999: "more"}
    assert dict(map(tuple, store.load().items.collect())) == want
    store.vacuum()
    assert dict(map(tuple, store.load().items.collect())) == want and len(store._names("manifest=*")) == 1
