from foliant.operators.changes import Load
from foliant.plans.collection import Collection
from foliant.plans.persistence import Persisted
from foliant.plans.telemetry import Telemetry
from foliant.sources.stores import MemoryStore, VersionedStore

SCHEMA = "id string, name string"


def names(df):
    return sorted((r["id"], r["name"]) for r in df.collect())


def test_persisted_collection(spark, tmp_path):
    store = VersionedStore(spark, f"{tmp_path}/s", spark.createDataFrame([], SCHEMA).schema)
    store.save(spark.createDataFrame([("1", "a")], SCHEMA))
    c = Collection(spark.createDataFrame([], SCHEMA))
    p = Persisted(c, store)
    assert p.is_ready and not p.is_loading and names(c.find({}).to_df()) == [("1", "a")]
    c.insert({"id": "2", "name": "b"})
    c.update_one({"id": "1"}, {"$set": {"name": "z"}})
    assert names(store.load().items) == [("1", "z"), ("2", "b")]
    before = len(store.versions())
    with c.batch():
        c.insert({"id": "3", "name": "c"})
        c.remove_many({"id": "2"})
    p.flush()
    assert len(store.versions()) == before + 1 and names(store.load().items) == [("1", "z"), ("3", "c")]
    p.reset_data()
    assert names(c.find({}).to_df()) == [("1", "z"), ("3", "c")]


def test_writes_before_the_first_load_are_kept(spark):
    store = MemoryStore(spark.createDataFrame([("1", "a")], SCHEMA))
    c = Collection(spark.createDataFrame([("9", "early")], SCHEMA))
    Persisted(c, store)
    assert names(c.find({}).to_df()) == names(store.df) == [("1", "a"), ("9", "early")]


def test_remote_delta(spark):
    store = MemoryStore(spark.createDataFrame([("1", "a"), ("2", "b")], SCHEMA))
    c = Collection(spark.createDataFrame([], SCHEMA))
    Persisted(c, store)
    store.changed(Load(added=spark.createDataFrame([("3", "c")], SCHEMA), removed=spark.createDataFrame([("1", None)], SCHEMA)))
    assert names(c.find({}).to_df()) == [("2", "b"), ("3", "c")]


def test_telemetry(spark):
    c, t = Collection(spark.createDataFrame([("1", "a")], SCHEMA), "watched"), Telemetry(spark)
    t.watch(c)
    c.find({"id": "1"})
    c.find({"id": "1"})
    with t.timed("watched", c.find({"name": "a"})) as cursor:
        assert cursor.count() == 1
    got = {(r["event"], r["selector"]): r["calls"] for r in t.table().collect()}
    assert got["find", "{'id': '1'}"] == 2 and got["timed", "{'name': 'a'}"] == 1
