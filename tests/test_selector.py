import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.operators.dynamic import compile_dynamic
from foliant.operators.selector import compile_selector

SCHEMA = "id int, name string, age int, flag boolean, tags array<string>, user struct<city:string,n:int>, items array<struct<q:int,f:string>>"
ROWS = [
    (1, "John", 30, True, ["red", "fruit"], ("Rome", 1), [(5, "a"), (9, "b")]),
    (2, None, 25, False, [], None, []),
    (3, "ann", None, None, None, (None, 3), None),
    (4, "", 0, True, ["red"], ("Oslo", None), [(5, "b")]),
    (5, "Jo\nhn", -7, False, [None, "blue"], ("Rome", 8), [(None, "a")]),
]
NAMES = ["id", "name", "age", "flag", "tags", "user", "items"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def ids(df, selector):
    where = compile_selector(selector, df.schema)
    return {r["id"] for r in (df if where is None else df.where(where)).collect()}


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ({}, {1, 2, 3, 4, 5}), (None, {1, 2, 3, 4, 5}), ({"name": "John"}, {1}), ({"name": None}, {2}), ({"name": 5}, set()), ({"age": "30"}, set()), ({"age": 0}, {4}), ({"flag": 1}, set()), ({"flag": False}, {2, 5}),
        ({"age": {"$gt": 0, "$lt": 30}}, {2}), ({"age": {"$ne": 30}}, {2, 3, 4, 5}), ({"age": {"$ne": None}}, {1, 2, 4, 5}), ({"age": {"$in": [30, None]}}, {1, 3}), ({"age": {"$nin": [30, 25]}}, {3, 4, 5}),
        ({"age": {"$not": {"$gt": 5}}}, {3, 4, 5}), ({"age": {"$exists": False}}, {3}), ({"nope": None}, {1, 2, 3, 4, 5}), ({"nope": 1}, set()), ({"nope": {"$ne": 1}}, {1, 2, 3, 4, 5}),
        ({"tags": "red"}, {1, 4}), ({"tags": ["red"]}, {4}), ({"tags": {"$ne": "red"}}, {2, 3, 5}), ({"tags": {"$all": ["red", "fruit"]}}, {1}), ({"tags": {"$size": 0}}, {2}), ({"tags": {"$in": ["blue", "fruit"]}}, {1, 5}), ({"tags": []}, {2}),
        ({"user.city": "Rome"}, {1, 5}), ({"user.n": {"$gte": 3}}, {3, 5}), ({"user": {"city": "Rome", "n": 1}}, {1}), ({"user": {"city": "Rome"}}, set()), ({"tags.0": "red"}, {1, 4}), ({"items.q": 5}, {1, 4}),
        ({"items": {"$elemMatch": {"q": 5, "f": "b"}}}, {4}), ({"items.q": 5, "items.f": "b"}, {1, 4}), ({"items": {"$not": {"$elemMatch": {"q": 5}}}}, {2, 3, 5}), ({"tags": {"$elemMatch": {"$eq": "red"}}}, {1, 4}),
        ({"age": {"$mod": [4, 1]}}, {2}), ({"age": {"$mod": [4, -3]}}, {5}), ({"name": {"$regex": "^jo", "$options": "i"}}, {1, 5}), ({"name": re.compile("nn$")}, {3}), ({"name": {"$in": [re.compile("^J"), "ann"]}}, {1, 3, 5}),
        ({"age": {"$bitsAllSet": 24}}, {2}) , ({"age": {"$bitsAllClear": [0]}}, {1, 4}), ({"age": {"$bitsAnySet": 1}}, {2, 5}), ({"age": {"$bitsAnyClear": 1}}, {1, 4}),
        ({"$or": [{"age": 30}, {"name": None}]}, {1, 2}), ({"$nor": [{"age": 30}, {"name": None}]}, {3, 4, 5}), ({"$and": [{"flag": True}, {"age": 0}]}, {4}), ({"$expr": {"$gt": ["$age", "$user.n"]}}, {1}),
        ({"$jsonSchema": {"required": ["name"], "properties": {"age": {"minimum": 0}}}}, {1, 3, 4}), ({"age": {"$where": lambda v: v is not None and v > 20}}, {1, 2}), ({"$where": lambda r: r["name"] == "ann"}, {3}),
    ],
)
def test_selector(df, selector, want):
    if "bitsAllSet" in str(selector):
        want = {i for i, r in ((r[0], r[2]) for r in ROWS) if r is not None and r & 24 == 24}
    assert ids(df, selector) == want
    assert ids(df, {"$nor": [selector]} if selector else {"$nor": [{}]}) == {1, 2, 3, 4, 5} - want


def evaluate(selector, row):
    def leaf(v, op, x):
        if op == "$eq":
            return v == x and type(v) is type(x)
        if op == "$in":
            return any(leaf(v, "$eq", y) for y in x)
        if v is None or type(v) is not type(x):
            return False
        return {"$gt": v > x, "$gte": v >= x, "$lt": v < x, "$lte": v <= x}[op]

    out = True
    for k, v in selector.items():
        if k == "$and":
            hit = all(evaluate(s, row) for s in v)
        elif k == "$or":
            hit = any(evaluate(s, row) for s in v)
        elif k == "$nor":
            hit = not any(evaluate(s, row) for s in v)
        else:
            ((op, x),) = v.items()
            hit = not evaluate({k: x}, row) if op == "$not" else not leaf(row[k], "$eq", x) if op == "$ne" else not leaf(row[k], "$in", x) if op == "$nin" else (row[k] is not None) == x if op == "$exists" else leaf(row[k], op, x)
        out = out and hit
    return out


def random_selector(rnd, depth=0):
    if depth < 3 and rnd.random() < 0.5:
        return {rnd.choice(["$and", "$or", "$nor"]): [random_selector(rnd, depth + 1) for _ in range(rnd.randint(1, 3))]}
    field = rnd.choice(["name", "age", "flag"])
    value = lambda: rnd.choice({"name": ["John", "ann", "", None], "age": [30, 25, 0, -7, None], "flag": [True, False, None]}[field] + ["x", 1])
    op = rnd.choice(["$eq", "$ne", "$in", "$nin", "$exists", "$gt", "$lte", "$not"])
    if op in ("$gt", "$lte"):
        return {field: {op: rnd.choice([3, 25, "K"])}}
    if op == "$not":
        return {field: {"$not": {"$in": [value(), value()]}}}
    return {field: {op: [value(), value()] if op in ("$in", "$nin") else rnd.random() < 0.5 if op == "$exists" else value()}}


def test_selectors_agree_with_a_plain_evaluator(df):
    rnd, rows = random.Random(4), [dict(zip(NAMES, r, strict=True)) for r in ROWS]
    cases = [random_selector(rnd) for _ in range(60)]
    got = df.select("id", *[F.coalesce(compile_selector(s, df.schema), F.lit(False)).alias(f"c{i}") for i, s in enumerate(cases)]).collect()
    for r in got:
        row = next(x for x in rows if x["id"] == r["id"])
        for i, s in enumerate(cases):
            assert r[f"c{i}"] == evaluate(s, row), (s, row)


@pytest.mark.parametrize("selector", [{"a": {"$near": 1}}, {"$xor": []}, {"name": {"$regex": "a", "$options": "g"}}, {"$where": "1"}])
def test_unknown_operators_raise(df, selector):
    selector = {k if k != "a" else "age": v for k, v in selector.items()}
    with pytest.raises(ValueError):
        compile_selector(selector, df.schema)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) name").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for selector, shape in [({"name": {"$in": ["1", "2"]}}, "In(name"), ({"name": {"$ne": "1"}}, "Or(Not(EqualTo(name,1)),IsNull(name))"), ({"$nor": [{"name": "1"}, {"id": {"$gt": 4}}]}, "LessThanOrEqual(id,4)"), ({"name": {"$regex": "^1"}}, "StringStartsWith")]:
        plan = df.where(compile_selector(selector, df.schema))._jdf.queryExecution().executedPlan().toString()
        assert shape in plan, (selector, plan)


def test_dynamic_truth_table(spark):
    docs = ['{"name":"John"}', '{"name":null}', '{"name":""}', '{"name":0}', '{"name":false}', '{"name":[]}', '{"name":{}}', "{}"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, j string").select("id", F.expr("parse_json(j)").alias("doc"))
    count = lambda s: df.where(compile_dynamic(s)).count()
    assert [count({"name": v}) for v in (None, "", 0, False, [], {})] == [2, 1, 1, 1, 1, 1]
    assert (count({"name": {"$exists": False}}), count({"name": {"$exists": True}}), count({"name": {"$ne": 0}})) == (1, 7, 7)


def test_schema_refuses_what_it_does_not_know(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("bb", [3, 3])], "s string, a array<int>")
    count = lambda spec: df.where(compile_selector({"$jsonSchema": spec}, df.schema)).count()
    with pytest.raises(ValueError):
        count({"patternProperties": {}})
    assert count({"properties": {"s": {"maxLength": 1}}}) == 1 and count({"properties": {"a": {"uniqueItems": True}}}) == 1
    assert count({"properties": {"s": {}}, "additionalProperties": False}) == 0 and count({"oneOf": [{"properties": {"s": {"const": "a"}}}, {"properties": {"s": {"pattern": "^b+$"}}}]}) == 2
    assert count({"properties": {"a": {"items": {"exclusiveMinimum": 2}}}}) == 1


def test_nan_is_above_nothing(spark):
    df = spark.createDataFrame([(1, float("nan"), [float("nan")]), (2, 3.0, [3.0]), (3, None, None)], "id int, x double, a array<double>")
    ids = lambda s: [r[0] for r in df.where(compile_selector(s, df.schema)).orderBy("id").collect()]
    assert ids({"x": {"$gt": 1}}) == ids({"x": {"$gte": 1}}) == ids({"a": {"$gt": 1}}) == [2]
    assert ids({"x": {"$lt": 9}}) == [2] and ids({"x": {"$not": {"$gt": 1}}}) == [1, 3] and ids({"x": {"$lt": float("nan")}}) == []
