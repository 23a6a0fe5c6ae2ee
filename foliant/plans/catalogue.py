"""Registered queries of the document engine, each with its DuckDB equivalent, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import changes as C
from foliant.operators import modifier as M
from foliant.operators.projection import project
from foliant.operators.selector import compile_selector
from foliant.plans import catalogue_live, catalogue_writes  # noqa: F401  they register their queries
from foliant.plans.collection import Collection, Cursor
from foliant.plans.registry import ORACLES, QUERIES, query, table  # noqa: F401
from foliant.sources.clustered import ClusteredIndex
from foliant.streaming.observe import events

def find(name: str, tab: str, selector: dict[str, Any], sql: str, prepare: Callable[[DataFrame], DataFrame] | None = None, **options: Any) -> None:
    """A query that is one find over a table."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, tab)
        df = prepare(df) if prepare else df
        return Cursor(lambda: df, selector, key=df.columns[0], **options).to_df()


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"
SLIM = {"fields": {c: 1 for c in LINE.split(", ")}}
find("eq_range_and", "lineitem", {"l_returnflag": "R", "l_quantity": {"$gt": 40}}, f"SELECT {LINE} FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40", **SLIM)
find("and_or", "lineitem", {"$and": [{"$or": [{"l_returnflag": "A"}, {"l_tax": {"$gte": 0.07}}]}, {"l_discount": {"$lt": 0.02}}]}, f"SELECT {LINE} FROM lineitem WHERE (l_returnflag = 'A' OR l_tax >= 0.07) AND l_discount < 0.02", **SLIM)
find("nor", "lineitem", {"$nor": [{"l_returnflag": "A"}, {"l_quantity": {"$gt": 30}}]}, f"SELECT {LINE} FROM lineitem WHERE NOT (l_returnflag = 'A' OR l_quantity > 30)", **SLIM)
find("not", "lineitem", {"l_quantity": {"$not": {"$gt": 10}}}, f"SELECT {LINE} FROM lineitem WHERE NOT l_quantity > 10", **SLIM)
find("in_list", "orders", {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")


def nulled(df: DataFrame) -> DataFrame:
    return df.withColumn("flag", F.nullif("l_returnflag", F.lit("N"))).select(*LINE.split(", "), "flag")


NULLED = f"(SELECT {LINE}, nullif(l_returnflag, 'N') AS flag FROM lineitem)"
find("ne_missing", "lineitem", {"flag": {"$ne": "A"}}, f"SELECT * FROM {NULLED} WHERE flag IS DISTINCT FROM 'A'", nulled)
find("nin_missing", "lineitem", {"flag": {"$nin": ["A", "X"]}}, f"SELECT * FROM {NULLED} WHERE flag IS NULL OR flag NOT IN ('A', 'X')", nulled)
find("in_null", "lineitem", {"flag": {"$in": ["A", None]}}, f"SELECT * FROM {NULLED} WHERE flag IS NULL OR flag = 'A'", nulled)
find("exists", "lineitem", {"flag": {"$exists": True}}, f"SELECT * FROM {NULLED} WHERE flag IS NOT NULL", nulled)
find("null_literal", "lineitem", {"flag": None}, f"SELECT * FROM {NULLED} WHERE flag IS NULL", nulled)
find("type_strict", "customer", {"$or": [{"c_custkey": "1"}, {"c_nationkey": {"$in": [3, "4"]}}]}, "SELECT * FROM customer WHERE c_nationkey = 3")
find("mod", "events", {"user_id": {"$mod": [7, 3]}}, "SELECT * FROM events WHERE user_id % 7 = 3")
find("regex_i", "part", {"p_name": {"$regex": "^RED", "$options": "i"}}, "SELECT * FROM part WHERE regexp_matches(p_name, '^RED', 'i')")
find("bits_all_set", "events", {"user_id": {"$bitsAllSet": 5}}, "SELECT * FROM events WHERE (user_id & 5) = 5")
find("bits_any_clear", "events", {"user_id": {"$bitsAnyClear": [0, 2]}}, "SELECT * FROM events WHERE (user_id & 5) != 5")
find("expr", "lineitem", {"$expr": {"$gt": [{"$multiply": ["$l_quantity", "$l_discount"]}, 4]}}, f"SELECT {LINE} FROM lineitem WHERE l_quantity * l_discount > 4", **SLIM)


def order_docs(df: DataFrame) -> DataFrame:
    """Orders as documents: items as an array of structs, flags as an array."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"))
    return df.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(item).alias("items"), F.collect_list("l_returnflag").alias("flags"))


def find_orders(name: str, selector: dict[str, Any], sql: str) -> None:
    @query(name, f"SELECT l_orderkey AS id FROM lineitem GROUP BY l_orderkey HAVING {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = order_docs(table(spark, sf_dir, "lineitem"))
        return Cursor(lambda: df, selector, fields={"id": 1}).to_df()


find_orders("array_eq_any", {"flags": "R"}, "bool_or(l_returnflag = 'R')")
find_orders("array_ne", {"flags": {"$ne": "R"}}, "NOT bool_or(l_returnflag = 'R')")
find_orders("all", {"flags": {"$all": ["R", "N"]}}, "bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'N')")
find_orders("size", {"items": {"$size": 3}}, "count(*) = 3")
find_orders("elem_match", {"items": {"$elemMatch": {"q": {"$gt": 45}, "f": "R"}}}, "bool_or(l_quantity > 45 AND l_returnflag = 'R')")
find_orders("elem_match_neg", {"items": {"$not": {"$elemMatch": {"q": {"$lt": 40}}}}}, "NOT bool_or(l_quantity < 40)")
find_orders("dotted_fan_out", {"items.q": {"$gte": 50}}, "bool_or(l_quantity >= 50)")


@query("dotted_struct", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def dotted_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.struct("c_mktsegment", F.struct("c_acctbal").alias("money")).alias("profile"))
    return Cursor(lambda: df, {"profile.c_mktsegment": "BUILDING", "profile.money.c_acctbal": {"$gt": 5000}}, fields={"profile": 0}, key="c_custkey").to_df()


@query("json_path", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) >= 90")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.struct(F.get_json_object("props", "$.k").try_cast("int").alias("k")).alias("p"))
    where = compile_selector({"p.k": {"$gte": 90}}, df.schema)
    return df.where(where).select("event_id", "p.k")


find("fields_include", "orders", {"o_totalprice": {"$gt": 100000}}, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000", fields={"o_totalprice": 1})
find("fields_exclude", "supplier", {}, "SELECT s_suppkey, s_name, s_acctbal FROM supplier", fields={"s_nationkey": 0})
find("sort_skip_limit", "orders", {"o_orderstatus": "F"}, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10", sort={"o_totalprice": -1, "o_orderkey": 1}, skip=10, limit=25, fields={"o_totalprice": 1})
find("find_one", "customer", {"c_custkey": 77}, "SELECT * FROM customer WHERE c_custkey = 77", limit=1)


@query("index_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (7, 70, 700) AND o_totalprice > 1000")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Collection(table(spark, sf_dir, "orders"), key="o_orderkey", indexes=[ClusteredIndex("o_custkey", key="o_orderkey")])
    return orders.find({"o_custkey": {"$in": [7, 70, 700]}, "o_totalprice": {"$gt": 1000}}, fields={"o_custkey": 1, "o_totalprice": 1}).to_df()


@query("count", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(Cursor(lambda: df, {"l_returnflag": {"$in": ["A", "R"]}}).count(),)], "n long")


@query("lookup_left", "SELECT c_custkey, c_name, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.lookup(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", "nation", unique=True)
    return out.select("c_custkey", "c_name", "nation.n_name", "nation.n_regionkey")


@query("lookup_orders", "SELECT l_orderkey, count(*) AS n, min(o_orderdate) AS placed FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def lookup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    out = C.lookup(lines, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "l_orderkey", "o_orderkey", "order", unique=True)
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("order.o_orderdate").alias("placed"))


@query("semi_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def semi_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    keys = c.where(compile_selector({"c_nationkey": 7}, c.schema)).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


@query("anti_nin", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def anti_nin(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(keys, "c_custkey", "left_anti").select("c_custkey")


@query("first_by_key", "SELECT c_nationkey, arg_min(c_custkey, c_custkey) AS c_custkey, arg_min(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey")
def first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_of(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], [F.col("c_custkey")])


def updated(df: DataFrame, selector: dict[str, Any], change: dict[str, Any]) -> DataFrame:
    """A table after an updateMany, as one conditional projection."""
    hit = F.coalesce(compile_selector(selector, df.schema), F.lit(False)) if selector else F.lit(True)
    new = M.columns(change, df.schema)
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


@query("set_inc", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'X' ELSE c_mktsegment END AS c_mktsegment, round(CASE WHEN c_nationkey = 3 THEN c_acctbal + 10.5 ELSE c_acctbal END, 4) AS c_acctbal FROM customer")
def set_inc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = updated(table(spark, sf_dir, "customer"), {"c_nationkey": 3}, {"$set": {"c_mktsegment": "X"}, "$inc": {"c_acctbal": 10.5}})
    return out.select("c_custkey", "c_mktsegment", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("min_max", "SELECT c_custkey, least(c_acctbal, 5000.0) AS c_acctbal, greatest(c_nationkey, 10) AS c_nationkey FROM customer")
def min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(table(spark, sf_dir, "customer"), {}, {"$min": {"c_acctbal": 5000.0}, "$max": {"c_nationkey": 10}}).select("c_custkey", "c_acctbal", "c_nationkey")


@query("mul_unset_rename", "SELECT p_partkey, p_size * 2 AS p_size, CAST(NULL AS VARCHAR) AS p_brand, p_brand AS p_type FROM part")
def mul_unset_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = updated(table(spark, sf_dir, "part"), {}, {"$mul": {"p_size": 2}, "$rename": {"p_brand": "p_type"}})
    return out.select("p_partkey", "p_size", "p_brand", "p_type")


LIST = "string_agg({}, ',' ORDER BY l_linenumber, l_quantity, l_returnflag)"


def flag_docs(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Orders with the flags of their lines, in the lines' order, under each name."""
    line = F.struct("l_linenumber", "l_quantity", "l_returnflag")
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("all"))
    return df.select("id", *[F.col("all.l_returnflag").alias(n) for n in names])


@query("push_pull_addtoset", f"SELECT l_orderkey AS id, {LIST.format('l_returnflag')} || ',Z' AS pushed, coalesce({LIST.format('l_returnflag')} FILTER (l_returnflag != 'A'), '') AS pulled, {LIST.format('l_returnflag')} || CASE WHEN bool_or(l_returnflag = 'R') THEN '' ELSE ',R' END AS added FROM lineitem GROUP BY l_orderkey")
def push_pull_addtoset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = updated(flag_docs(spark, sf_dir, "pushed", "pulled", "added"), {}, {"$push": {"pushed": "Z"}, "$pull": {"pulled": "A"}, "$addToSet": {"added": "R"}})
    return out.select("id", *[F.array_join(c, ",").alias(c) for c in ("pushed", "pulled", "added")])


@query("pop_pullall", f"SELECT l_orderkey AS id, regexp_replace({LIST.format('l_returnflag')}, ',?[A-Z]$', '') AS popped, regexp_replace({LIST.format('l_returnflag')}, '^[A-Z],?', '') AS first, coalesce({LIST.format('l_returnflag')} FILTER (l_returnflag NOT IN ('A', 'N')), '') AS pulled FROM lineitem GROUP BY l_orderkey")
def pop_pullall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = updated(flag_docs(spark, sf_dir, "popped", "first", "pulled"), {}, {"$pop": {"popped": 1, "first": -1}, "$pullAll": {"pulled": ["A", "N"]}})
    return out.select("id", *[F.array_join(c, ",").alias(c) for c in ("popped", "first", "pulled")])


@query("nested_array_set", "SELECT l_orderkey AS id, CAST(count(*) AS DOUBLE) AS total, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def nested_array_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = updated(order_docs(table(spark, sf_dir, "lineitem")), {}, {"$set": {"items.$[].q": 1.0}})
    return out.select("id", F.aggregate("items", F.lit(0.0), lambda a, e: a + e["q"]).alias("total"), F.array_join(F.array_sort("items.f"), ",").alias("flags"))


@query("upsert", "SELECT c_custkey, 'new' AS c_name FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 != 0 UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 10 = 0")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    tenth = df.where("c_custkey % 10 = 0").select("c_custkey")
    rows = tenth.union(tenth.select(-F.col("c_custkey"))).withColumn("c_name", F.lit("new"))
    return C.upsert(df, rows, "c_custkey")


OLD = "(SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 10 != 0)"
NEW = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '!' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal FROM customer WHERE c_custkey % 11 != 0)"


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "customer")
    old = df.where("c_custkey % 10 != 0").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS bal")
    new = df.where("c_custkey % 11 != 0").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '!' ELSE c_name END AS name", "CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal")
    return old, new


DIFF = f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'modified' END AS kind, concat_ws(',', CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL AND o.name IS DISTINCT FROM n.name THEN 'name' END, CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL AND o.bal IS DISTINCT FROM n.bal THEN 'bal' END) AS fields FROM {OLD} o FULL JOIN {NEW} n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.name IS DISTINCT FROM n.name OR o.bal IS DISTINCT FROM n.bal"


@query("diff", DIFF)
def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.diff(*versions(spark, sf_dir))
    return d.select("id", "kind", F.concat_ws(",", F.coalesce("modified_fields", F.array().cast("array<string>"))).alias("fields"))


@query("snapshot_delta", "SELECT id, name FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS name FROM customer WHERE c_custkey % 5 != 0) UNION ALL SELECT -c_custkey, 'added' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey != 0")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    added = base.where("id % 2 = 0").selectExpr("-id AS id", "'added' AS name")
    modified = base.where("id % 3 = 0").selectExpr("id", "'changed' AS name")
    return C.snapshot(base, added, modified, base.where("id % 5 = 0"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a changelog by user: purchases insert, errors remove, others update the value alone."""
    kind = F.when(F.col("event_type") == "purchase", "insert").when(F.col("event_type") == "error", "remove").otherwise("update")
    present = F.when(kind == "insert", F.array(F.lit("kind"), F.lit("value"))).otherwise(F.array(F.lit("value")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), kind.alias("type"), present.alias("present"), F.col("event_type").alias("kind"), "value")


REPLAY = """WITH gone AS (SELECT user_id, max((ts, event_id)) FILTER (event_type = 'error') AS g FROM events GROUP BY user_id),
live AS (SELECT e.* FROM events e JOIN gone USING (user_id) WHERE event_type != 'error' AND (g IS NULL OR (ts, event_id) > g))
SELECT user_id AS id, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' END AS kind, arg_max(value, (ts, event_id)) AS value FROM live GROUP BY user_id"""


@query("fold_replay", REPLAY)
def fold_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return C.replay(log.select("id", "kind", "value").limit(0), log)


@query("last_write_wins", "SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumns({"type": F.lit("update"), "present": F.array(F.lit("kind"), F.lit("value"))})
    return C.replay(log.select("id", "kind", "value").limit(0), log)


REPLAY_BASE = """WITH gone AS (SELECT user_id, max((ts, event_id)) FILTER (event_type = 'error') AS g FROM events GROUP BY user_id),
live AS (SELECT e.* FROM events e JOIN gone USING (user_id) WHERE event_type != 'error' AND (g IS NULL OR (ts, event_id) > g)),
last AS (SELECT user_id, bool_or(event_type = 'purchase') AS bought, arg_max(value, (ts, event_id)) AS value FROM live GROUP BY user_id),
base AS (SELECT c_custkey AS id, 'base' AS kind, c_acctbal AS value FROM customer)
SELECT coalesce(b.id, g.user_id) AS id, CASE WHEN l.bought THEN 'purchase' WHEN g.g IS NULL THEN b.kind END AS kind, CASE WHEN l.user_id IS NOT NULL THEN l.value ELSE b.value END AS value
FROM base b FULL JOIN gone g ON b.id = g.user_id LEFT JOIN last l ON l.user_id = g.user_id WHERE g.user_id IS NULL OR g.g IS NULL OR l.user_id IS NOT NULL"""


@query("replay_on_base", REPLAY_BASE)
def replay_on_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changelog over documents that are there: inserts merge, updates set a field, removals delete."""
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "'base' AS kind", "c_acctbal AS value")
    return C.replay(base, event_log(spark, sf_dir))


@query("sync_three_way", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'mine' WHEN c_custkey % 3 = 0 THEN 'theirs' ELSE c_name END AS name FROM customer WHERE c_custkey % 5 != 0")
def sync_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local and remote edits of one snapshot; the remote takes what is pushed and hands it out again."""
    last = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    remote = {"df": last.where("id % 5 != 0").selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'theirs' ELSE name END AS name")}
    log = last.where("id % 4 = 0 AND id % 5 != 0").selectExpr("id", "1 AS time", "id AS seq", "'update' AS type", "array('name') AS present", "'mine' AS name")

    def push(d: DataFrame) -> None:
        rows = d.where("kind != 'removed'").select("id", "new.*")
        remote["df"] = C.upsert(remote["df"], rows)

    return C.sync(last, log, C.Load(items=remote["df"]), push, lambda: C.Load(items=remote["df"])).state


EVENTS = f"""WITH o AS (SELECT *, lead(id) OVER (ORDER BY name, id) AS nx, row_number() OVER (ORDER BY name, id) AS p FROM {OLD}),
n AS (SELECT *, lead(id) OVER (ORDER BY name, id) AS nx, row_number() OVER (ORDER BY name, id) AS p FROM {NEW})
SELECT n.id AS id, 'added' AS event, CAST(n.nx AS VARCHAR) AS before FROM n LEFT JOIN o ON o.id = n.id WHERE o.id IS NULL
UNION ALL SELECT o.id, 'removed', NULL FROM o LEFT JOIN n ON o.id = n.id WHERE n.id IS NULL
UNION ALL SELECT n.id, 'changed', NULL FROM n JOIN o ON o.id = n.id WHERE o.name IS DISTINCT FROM n.name OR o.bal IS DISTINCT FROM n.bal
UNION ALL SELECT n.id, 'movedBefore', CAST(n.nx AS VARCHAR) FROM n JOIN o ON o.id = n.id WHERE o.p != n.p AND o.nx IS DISTINCT FROM n.nx
UNION ALL SELECT n.id, 'changedField', 'name' FROM n JOIN o ON o.id = n.id WHERE o.name IS DISTINCT FROM n.name
UNION ALL SELECT n.id, 'changedField', 'bal' FROM n JOIN o ON o.id = n.id WHERE o.bal IS DISTINCT FROM n.bal"""


@query("observer_events", EVENTS)
def observer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(*versions(spark, sf_dir), [F.col("name"), F.col("id")]).select("id", "event", F.coalesce("field", "before").alias("before"))


@query("autofetch_merge", "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS nation FROM customer")
def autofetch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    first = c.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS seg")
    second = c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "'even' AS seg", "c_nationkey AS nation")
    return C.merge_live([first, second]).select("id", "name", "seg", "nation")


@query("validate_reject", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal >= 0 AND c_nationkey < 20)")
def validate_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    rule = {"$jsonSchema": {"type": "object", "required": ["c_custkey"], "properties": {"c_acctbal": {"type": "number", "minimum": 0}, "c_nationkey": {"maximum": 19}}}}
    return df.where(compile_selector({"$nor": [rule]}, df.schema)).select("c_custkey")


@query("nested_projection", "SELECT c_custkey AS id, c_name FROM customer")
def nested_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.struct("c_name", "c_acctbal").alias("p"), "c_nationkey")
    return project(df, {"p.c_name": 1}).select("id", "p.*")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["eq_range_and"](spark, sf_dir)
