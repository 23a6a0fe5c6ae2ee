"""Registered queries that write through collections, each with its DuckDB equivalent, over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.values import compact
from foliant.operators.dynamic import compile_dynamic
from foliant.plans.collection import Collection, Cursor
from foliant.plans.registry import query, table

CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def customers(spark: SparkSession, sf_dir: str, **options: Any) -> Collection:
    return Collection(table(spark, sf_dir, "customer"), key="c_custkey", **options)


def written(name: str, sql: str, write: Callable[[Collection], Any], columns: str | list[str] = CUSTOMER, **options: Any) -> None:
    """A query that reads the customers after a write."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = customers(spark, sf_dir, **options)
        write(c)
        return c.find({}).to_df().selectExpr(*(columns.split(", ") if isinstance(columns, str) else columns))


written(
    "insert", f"SELECT {CUSTOMER} FROM customer UNION ALL SELECT -1, 'one', 3, NULL, NULL UNION ALL SELECT -2, 'two', NULL, 2.5, NULL UNION ALL SELECT -9, 'made', NULL, NULL, NULL",
    lambda c: (c.insert({"c_custkey": -1, "c_name": "one", "c_nationkey": 3}), c.insert_many([{"c_custkey": -2, "c_name": "two", "c_acctbal": 2.5}]), c.insert({"c_name": "made"})), key_generator=lambda: -9,
)
written("update_one", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 7) THEN 'FIRST' ELSE c_mktsegment END AS c_mktsegment FROM customer", lambda c: c.update_one({"c_nationkey": 7}, {"$set": {"c_mktsegment": "FIRST"}}))
written(
    "update_many", "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_nationkey < 5 THEN greatest(c_nationkey + 100, 0) ELSE c_nationkey END AS c_nationkey, round(CASE WHEN c_nationkey < 5 THEN c_acctbal * 2 ELSE c_acctbal END, 4) AS c_acctbal, CASE WHEN c_nationkey < 5 THEN 'LOW' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    lambda c: c.update_many({"c_nationkey": {"$lt": 5}}, {"$set": {"c_mktsegment": "LOW"}, "$inc": {"c_nationkey": 100}, "$mul": {"c_acctbal": 2}, "$unset": {"c_name": ""}}), ["c_custkey", "c_name", "c_nationkey", "round(c_acctbal, 4) AS c_acctbal", "c_mktsegment"],
)
written("update_many_whole", "SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'whole' ELSE c_name END AS c_name, CASE WHEN c_nationkey != 7 THEN c_nationkey END AS c_nationkey, CASE WHEN c_nationkey != 7 THEN c_acctbal END AS c_acctbal, CASE WHEN c_nationkey != 7 THEN c_mktsegment END AS c_mktsegment FROM customer", lambda c: c.update_many({"c_nationkey": 7}, {"c_name": "whole"}))
written("replace_one", "SELECT CASE WHEN c_custkey = 5 THEN -5 ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey IN (5, 6) THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey NOT IN (5, 6) THEN c_nationkey END AS c_nationkey, CASE WHEN c_custkey = 6 THEN 1.5 WHEN c_custkey != 5 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey NOT IN (5, 6) THEN c_mktsegment END AS c_mktsegment FROM customer", lambda c: (c.replace_one({"c_custkey": 5}, {"c_custkey": -5, "c_name": "new"}), c.replace_one({"c_custkey": 6}, {"c_name": "new", "c_acctbal": 1.5})))
written("remove_one", f"SELECT {CUSTOMER} FROM customer WHERE c_custkey != (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')", lambda c: c.remove_one({"c_mktsegment": "BUILDING"}))
written("remove_many", f"SELECT {CUSTOMER} FROM customer WHERE NOT (c_nationkey < 5)", lambda c: c.remove_many({"c_nationkey": {"$lt": 5}}))
written("upsert_document", f"SELECT {CUSTOMER} FROM customer UNION ALL SELECT -3, 'up', 4, 0.0, NULL", lambda c: (c.update_one({"c_custkey": -77}, {"$setOnInsert": {"c_custkey": -3}, "$set": {"c_name": "up"}, "$inc": {"c_nationkey": 4}, "$mul": {"c_acctbal": 3}}, upsert=True), c.update_many({"c_custkey": 1}, {"$setOnInsert": {"c_name": "never"}}, upsert=True)))
written("widened_numbers", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 0.5 WHEN c_custkey % 4 = 1 THEN 2.5 WHEN c_custkey % 4 = 2 THEN least(c_nationkey, 7.5) ELSE c_nationkey * 1.5 END AS DOUBLE) AS c_nationkey FROM customer", lambda c: (c.update_many({"c_custkey": {"$mod": [4, 0]}}, {"$inc": {"c_nationkey": 0.5}}), c.update_many({"c_custkey": {"$mod": [4, 1]}}, {"$set": {"c_nationkey": 2.5}}), c.update_many({"c_custkey": {"$mod": [4, 2]}}, {"$min": {"c_nationkey": 7.5}}), c.update_many({"c_custkey": {"$mod": [4, 3]}}, {"$mul": {"c_nationkey": 1.5}})), "c_custkey, c_nationkey")
written("rename_field", "SELECT c_custkey, c_name AS title, CAST(NULL AS VARCHAR) AS c_name FROM customer", lambda c: c.update_many({}, {"$rename": {"c_name": "title"}}), "c_custkey, title, c_name")
written("current_date", "SELECT c_custkey, c_custkey < 10 AS touched FROM customer", lambda c: c.update_many({"c_custkey": {"$lt": 10}}, {"$currentDate": {"seen": True}}), "c_custkey, seen IS NOT NULL AND seen > timestamp'2020-01-01' AND seen <= current_timestamp() AS touched")


def batched(c: Collection) -> None:
    with c.batch():
        c.insert({"c_custkey": -1, "c_name": "in"})
        c.update_many({"c_nationkey": 1}, {"$set": {"c_name": "one"}})
        c.remove_many({"c_nationkey": 2})
    try:
        with c.batch():
            c.remove_many({})
            raise KeyError
    except KeyError:
        pass


written("batch", "SELECT -1 AS c_custkey, 'in' AS c_name UNION ALL SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 'one' ELSE c_name END FROM customer WHERE c_nationkey != 2", batched, "c_custkey, c_name")

A3 = "[CAST(c_nationkey AS BIGINT), c_custkey % 5, c_custkey % 3]"


def array_query(name: str, change: dict[str, Any], sql: str) -> None:
    """A modifier on an array of three numbers; whole arrays are compared."""

    @query(name, f"SELECT c_custkey, array_to_string({sql.format(A3)}, ',') AS a FROM customer")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "array(cast(c_nationkey as long), c_custkey % 5, c_custkey % 3) AS a")
        c = Collection(df, key="c_custkey")
        c.update_many({}, change)
        return c.find({}).to_df().select("c_custkey", F.array_join(F.transform("a", lambda e: e.cast("string")), ",").alias("a"))


array_query("push_position", {"$push": {"a": {"$each": [8, 9], "$position": 1}}}, "{0}[1:1] || [8, 9] || {0}[2:3]")
array_query("push_sort_slice", {"$push": {"a": {"$each": [0, 5], "$sort": 1, "$slice": -2}}}, "list_sort({0} || [0, 5])[4:5]")
array_query("push_sort_down", {"$push": {"a": {"$each": [3], "$sort": -1, "$slice": 3}}}, "list_reverse_sort({0} || [3])[1:3]")
array_query("add_to_set_each", {"$addToSet": {"a": {"$each": [2, 99]}}}, "{0} || CASE WHEN list_contains({0}, 2) THEN [] ELSE [2] END || [99]")
array_query("pull_condition", {"$pull": {"a": {"$gte": 3}}}, "[x for x in {0} if x < 3]")
array_query("pull_all", {"$pullAll": {"a": [1, 2]}}, "[x for x in {0} if x NOT IN (1, 2)]")
array_query("pop_first", {"$pop": {"a": -1}}, "{0}[2:3]")
array_query("set_element", {"$set": {"a.1": 77}}, "[{0}[1], 77, {0}[3]]")
array_query("set_all_elements", {"$inc": {"a.$[]": 10}}, "[x + 10 for x in {0}]")


@query("compact", f"SELECT c_custkey, array_to_string([x for x in {A3} if x != 0], ',') AS a FROM customer")
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "array(cast(c_nationkey as long), c_custkey % 5, c_custkey % 3) AS a")
    return df.select("c_custkey", F.array_join(F.transform(compact(F.col("a"), df.schema["a"].dataType), lambda e: e.cast("string")), ",").alias("a"))


def found(name: str, tab: str, selector: dict[str, Any], sql: str, prepare: Callable[[DataFrame], DataFrame] | None = None, **options: Any) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, tab)
        df = prepare(df) if prepare else df
        return Collection(df, key=df.columns[0]).find(selector, **options).to_df()


found("regex_literal", "part", {"p_name": re.compile("^r.*e", re.I)}, "SELECT * FROM part WHERE regexp_matches(p_name, '^r.*e', 'i')")
found("bits_all_clear", "events", {"user_id": {"$bitsAllClear": 5}}, "SELECT * FROM events WHERE (user_id & 5) = 0")
found("bits_any_set", "events", {"user_id": {"$bitsAnySet": [0, 2]}}, "SELECT * FROM events WHERE (user_id & 5) != 0")
found("where_callable", "supplier", {"$where": lambda r: r["s_nationkey"] % 3 == 1 and r["s_acctbal"] > 0}, "SELECT * FROM supplier WHERE s_nationkey % 3 = 1 AND s_acctbal > 0")
found("where_field", "supplier", {"s_acctbal": {"$where": lambda v: v > 1000}}, "SELECT * FROM supplier WHERE s_acctbal > 1000")
found("numeric_segment", "customer", {"a.1": 3}, "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 3", lambda df: df.selectExpr("c_custkey", "array(c_nationkey, c_custkey % 5) AS a"), fields={"c_custkey": 1})
found("nan_range", "customer", {"x": {"$gt": 0}}, "SELECT c_custkey FROM customer WHERE c_custkey % 7 != 0 AND c_acctbal > 0", lambda df: df.selectExpr("c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN double('NaN') ELSE c_acctbal END AS x"), fields={"c_custkey": 1})
found("nan_not", "customer", {"x": {"$not": {"$gt": 0}}}, "SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0 OR NOT c_acctbal > 0", lambda df: df.selectExpr("c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN double('NaN') ELSE c_acctbal END AS x"), fields={"c_custkey": 1})
found("hide_key", "customer", {}, "SELECT c_name FROM customer", fields={"c_custkey": 0, "c_name": 1})
found("mixed_fields", "customer", {}, "SELECT c_custkey, c_name FROM customer", fields={"c_name": 1, "c_acctbal": 0})
found("no_fields", "nation", {}, "SELECT * FROM nation", fields={})
found("expr_functions", "customer", {"$expr": {"$and": [{"$in": ["$c_nationkey", [1, 2, 3]]}, {"$gt": [{"$cond": [{"$lt": ["$c_acctbal", 0]}, 0, "$c_acctbal"]}, 10]}, {"$eq": [{"$concat": ["$c_mktsegment", "-x"]}, "BUILDING-x"]}]}}, "SELECT * FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_acctbal > 10 AND c_mktsegment = 'BUILDING'")
found("schema_rules", "customer", {"$jsonSchema": {"required": ["c_name"], "properties": {"c_name": {"type": "string", "pattern": "[02468]$", "minLength": 3}, "c_nationkey": {"exclusiveMinimum": 2, "not": {"multipleOf": 3}}, "c_mktsegment": {"anyOf": [{"const": "BUILDING"}, {"enum": ["MACHINERY"]}]}}}}, "SELECT * FROM customer WHERE regexp_matches(c_name, '[02468]$') AND c_nationkey > 2 AND c_nationkey % 3 != 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
found("schema_items", "customer", {"$jsonSchema": {"properties": {"a": {"minItems": 2, "uniqueItems": True, "items": {"maximum": 20}, "contains": {"minimum": 4}}}}}, "SELECT c_custkey FROM customer WHERE c_nationkey <= 20 AND c_nationkey != c_custkey % 5 AND (c_nationkey >= 4 OR c_custkey % 5 >= 4)", lambda df: df.selectExpr("c_custkey", "array(cast(c_nationkey as long), c_custkey % 5) AS a"), fields={"c_custkey": 1})


@query("count_skip_limit", "SELECT count(*) AS n FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 25 OFFSET 10)")
def count_skip_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(Collection(table(spark, sf_dir, "orders"), key="o_orderkey").find({"o_orderstatus": "F"}, skip=10, limit=25).count(),)], "n long")


@query("existence", "SELECT count(*) > 0 AS is_some, (SELECT count(*) FROM customer WHERE c_custkey < 0) = 0 AS is_none, (SELECT count(*) FROM customer) <= 1000000000 AS is_past FROM customer WHERE c_nationkey = 3")
def existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    return spark.createDataFrame([(c.find_one({"c_nationkey": 3}) is not None, c.find({"c_custkey": {"$lt": 0}}).is_empty(), c.find({}, skip=1_000_000_000).is_empty())], "is_some boolean, is_none boolean, is_past boolean")


@query("transform", "SELECT c_custkey AS id, upper(c_name) || '!' AS shout FROM customer WHERE c_nationkey = 4")
def transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row function, run on the executors."""
    return customers(spark, sf_dir, transform=lambda r: {"id": r["c_custkey"], "shout": r["c_name"].upper() + "!"}).find({"c_nationkey": 4}).transformed("id long, shout string")


@query("transform_all", "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def transform_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = customers(spark, sf_dir, transform_all=lambda df, fields: df.join(nations, "c_nationkey", "left"))
    return c.find({"c_acctbal": {"$gt": 9000}}, fields={"c_name": 1, "n_name": 1}).to_df()


@query("rules_reject", "SELECT c_custkey, c_acctbal FROM customer")
def rules_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that break a rule change nothing."""
    c = customers(spark, sf_dir, rules={"known": F.col("c_nationkey") >= 0})
    for write in (lambda: c.insert({"c_custkey": -1}), lambda: c.update_many({}, {"$set": {"c_nationkey": -1, "c_acctbal": 0.0}}), lambda: c.insert({"c_custkey": 1})):
        try:
            write()
        except ValueError:
            continue
        raise AssertionError("a rule was broken")
    return c.find({}).to_df().select("c_custkey", "c_acctbal")


class Ledger(Collection):
    """A collection with methods of its own."""

    def rich(self, least: float) -> Cursor:
        return self.find({"c_acctbal": {"$gte": least}}, fields={"c_acctbal": 1})


@query("subclass", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000")
def subclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(table(spark, sf_dir, "customer"), key="c_custkey").rich(5000).to_df()


def variant(name: str, selector: dict[str, Any], sql: str) -> None:
    """A selector over documents of no fixed type."""
    doc = "to_json(named_struct('k', cast(get_json_object(props, '$.k') as int), 'kind', event_type, 'list', array(user_id % 4, user_id % 3), 'tags', array(named_struct('n', user_id % 5, 'v', value))))"

    @query(name, f"SELECT event_id FROM (SELECT *, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "events").selectExpr("event_id", f"parse_json({doc}) AS doc")
        return df.where(compile_dynamic(selector)).select("event_id")


variant("variant_range_regex", {"k": {"$gte": 40, "$not": {"$gt": 60}}, "kind": {"$regex": "^(C|V)", "$options": "i"}}, "k >= 40 AND NOT k > 60 AND regexp_matches(event_type, '^(c|v)')")
variant("variant_mod_in", {"k": {"$mod": [7, 3]}, "kind": {"$in": ["click", "error"]}}, "k % 7 = 3 AND event_type IN ('click', 'error')")
variant("variant_arrays", {"list": {"$size": 2, "$all": [1, 2]}}, "(user_id % 4 = 1 AND user_id % 3 = 2) OR (user_id % 4 = 2 AND user_id % 3 = 1)")
variant("variant_elem_match", {"tags": {"$elemMatch": {"n": {"$gt": 2}, "v": {"$lt": 10}}}}, "user_id % 5 > 2 AND value < 10")
variant("variant_missing", {"none": None, "$nor": [{"k": {"$exists": False}}, {"list": 3}]}, "k IS NOT NULL AND user_id % 4 != 3 AND user_id % 3 != 3")
