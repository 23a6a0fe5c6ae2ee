import pytest
from pyspark.sql import functions as F

from foliant.plans.collection import Collection
from foliant.sources.clustered import ClusteredIndex, constrained

ROWS = [(str(i), "red" if i % 3 else "blue", i if i % 5 else None, (i % 4,)) for i in range(60)]
SCHEMA = "id string, color string, n int, s struct<x:int>"


@pytest.mark.parametrize("selector", [{"color": "blue"}, {"color": {"$ne": "blue"}}, {"color": None}, {"$and": [{"color": {"$in": ["blue", None]}}, {"n": {"$gt": 9}}]}, {"$or": [{"color": "blue"}, {"n": 1}]}, {"n": None}, {}, {"s.x": 2}])
def test_indexed_reads_equal_plain_ones(spark, selector):
    df = spark.createDataFrame(ROWS, SCHEMA)
    indexed = Collection(df, indexes=[ClusteredIndex("color", files=3), ClusteredIndex("s.x")])
    plain, got = Collection(df).find(selector, sort={"n": -1}), indexed.find(selector, sort={"n": -1})
    assert got.fetch() == plain.fetch()


def test_index_follows_writes_and_is_used(spark):
    index = ClusteredIndex("n")
    c = Collection(spark.createDataFrame(ROWS, SCHEMA), indexes=[index])
    assert index.table is None and c.find({"n": {"$gte": 57}}).count() == 3
    assert "PushedFilters: [IsNotNull(n), GreaterThanOrEqual(n,57)]" in c.find({"n": {"$gte": 57}}).to_df()._jdf.queryExecution().toString()
    with c.batch():
        c.insert({"id": "new", "n": 99})
        c.update_many({"n": 59}, {"$set": {"n": 100}})
    assert sorted(r["id"] for r in c.find({"n": {"$gte": 57}})) == ["57", "58", "59", "new"]
    assert c.remove_many({"n": {"$gte": 57}}) == 4 and c.find({"n": {"$gte": 57}}).is_empty()
    assert ClusteredIndex("none").query({"none": 1}) is None
    with pytest.raises(ValueError):
        ClusteredIndex()
    assert constrained({"a": 1, "$and": [{"b": 1}, {"$or": [{"c": 1}]}]}) == {"a", "b"}


def test_custom_provider(spark):
    class Reds:
        def query(self, selector):
            return self.df.where(F.col("color") == "red") if selector.get("color") == "red" else None

        def rebuild(self, df):
            self.df = df

    c = Collection(spark.createDataFrame(ROWS, SCHEMA), indexes=[Reds()])
    assert c.find({"color": "red", "n": {"$lt": 5}}).count() == 3 and c.find({"color": "blue"}).count() == 20


def test_insertion_order_of_numbers(spark):
    c = Collection(spark.createDataFrame([(-2.5, "a"), (1.25, "b"), (-10.0, "c"), (1.5, "d")], "id double, name string"))
    assert [r["name"] for r in c.find({}, limit=4)] == ["c", "a", "b", "d"]
    c.insert_many([{"id": 0.5, "name": "e"}, {"id": 0.1, "name": "f"}])
    assert [r["name"] for r in c.find({}, limit=9)] == ["c", "a", "b", "d", "e", "f"]
    assert c.remove_one({}) == 1 and c.find_one({})["name"] == "a"


def test_reset_keeps_observers(spark):
    seen = []
    c = Collection(spark.createDataFrame([(1, "a")], "id int, name string"))
    c.observe({}, {"added": lambda e: seen.append(("+", e["id"])), "removed": lambda e: seen.append(("-", e["id"]))}, skip_initial=True)
    c.reset(spark.createDataFrame([(2, "b")], "id int, name string"))
    assert sorted(seen) == [("+", 2), ("-", 1)] and [r["id"] for r in c.find({})] == [2]
