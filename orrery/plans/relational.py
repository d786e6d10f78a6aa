"""Selections, keys, collection algebra and association."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import association, collections
from ..operators.relational import TYPES, Column, ForeignKey, Join, OrderBy, Selection, Table, orphans
from ..registry import query, table
from ..sources.databases import database


def tables(spark, d, *names):
    return {n: table(spark, d, n) for n in names}


@query("sel_where_order", """
SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount), 4) AS revenue
FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber""")
def sel_where_order(spark, d):
    s = Selection(
        "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "round(l_extendedprice * (1 - l_discount), 4) AS revenue"],
        where="l_quantity > 45 AND l_returnflag = 'R'", order_by=[OrderBy("l_orderkey"), OrderBy("l_linenumber")],
    )
    return s.over(tables(spark, d, "lineitem"))


@query("sel_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY l_returnflag DESC, l_linestatus")
def sel_distinct(spark, d):
    s = Selection("lineitem", ["l_returnflag", "l_linestatus"], distinct=True, order_by=[OrderBy("l_returnflag", False), OrderBy("l_linestatus")])
    return s.over(tables(spark, d, "lineitem"))


@query("sel_inner_join", """
SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000""")
def sel_inner_join(spark, d):
    s = Selection("orders", ["o_orderkey", "c_name", "c_mktsegment", "o_totalprice"], [Join("customer", "o_custkey", "c_custkey")], "orders.o_totalprice > 300000")
    return s.over(tables(spark, d, "orders", "customer"))


@query("sel_left_join", "SELECT n_nationkey, n_name, s_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
def sel_left_join(spark, d):
    s = Selection("nation", ["n_nationkey", "n_name", "s_name"], [Join("supplier", "n_nationkey", "s_nationkey", "left")])
    return s.over(tables(spark, d, "nation", "supplier"))


@query("sel_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < n_regionkey")
def sel_cross_join(spark, d):
    s = Selection("region", ["r_name", "n_name"], [Join("nation", how="cross")], "r_regionkey < n_regionkey")
    return s.over(tables(spark, d, "region", "nation"))


@query("fk_orphans", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def fk_orphans(spark, d):
    return orphans(table(spark, d, "customer"), table(spark, d, "orders"), ("c_custkey",), ("o_custkey",)).select("c_custkey", "c_name")


@query("key_violations", """
SELECT 'required o_orderdate' AS rule, count(*) AS violations FROM orders WHERE o_orderdate IS NULL
UNION ALL SELECT 'unique o_totalprice', count(*) FROM (SELECT 1 FROM orders GROUP BY o_totalprice HAVING count(*) > 1)
UNION ALL SELECT 'primary key o_orderkey', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'foreign key o_custkey', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def key_violations(spark, d):
    spec = Table(
        "orders", [Column("o_orderkey", "integer"), Column("o_custkey", "integer"), Column("o_orderdate", "text", required=True), Column("o_totalprice", "real", unique=True)],
        ("o_orderkey",), [ForeignKey("customer", ("o_custkey",), ("c_custkey",))],
    )
    return spec.violations(table(spark, d, "orders"), tables(spark, d, "customer"))


@query("asof_nearest", """
WITH l AS (SELECT event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'error'),
r AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'signup'),
m AS (SELECT l.event_id, r.id, abs(r.t - l.t) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t - l.t), r.id) AS k
      FROM l JOIN r ON abs(r.t - l.t) <= 300)
SELECT l.event_id, m.id AS match_id, round(m.gap, 4) AS gap FROM l LEFT JOIN m ON m.event_id = l.event_id AND m.k = 1""")
def asof_nearest(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    left = e.where("event_type = 'error'").select("event_id", "t")
    right = e.where("event_type = 'signup'").select(F.col("event_id").alias("id"), "t")
    return association.nearest(left, right, 300.0).select("event_id", F.col("match.id").alias("match_id"), F.round("gap", 4).alias("gap"))


@query("asof_nearest_by_user", """
WITH l AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'view'),
m AS (SELECT l.event_id, r.id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t - l.t), r.id) AS k
      FROM l JOIN r ON l.user_id = r.user_id AND abs(r.t - l.t) <= 7200)
SELECT l.event_id, m.id AS match_id FROM l LEFT JOIN m ON m.event_id = l.event_id AND m.k = 1""")
def asof_nearest_by_user(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), "user_id", "t")
    return association.nearest(left, right, 7200.0, by=["user_id"]).select("event_id", F.col("match.id").alias("match_id"))


@query("every_nth", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events) WHERE k % 7 = 0")
def every_nth(spark, d):
    return collections.every_nth(table(spark, d, "events"), 7, ["ts", "event_id"]).select("event_id", "event_type")


@query("ordinals", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS ord FROM part")
def ordinals(spark, d):
    return collections.with_ordinal(table(spark, d, "part"), [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "ord")


@query("remove_positions", """
SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS k FROM customer) WHERE k NOT IN (SELECT n_nationkey FROM nation)""")
def remove_positions(spark, d):
    gone = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"))
    return collections.without_positions(table(spark, d, "customer"), gone, ["c_acctbal", "c_custkey"]).select("c_custkey")


def _two_sets(spark, d):
    o = table(spark, d, "orders")
    return tuple(o.where(f"o_orderstatus = '{s}'").select(F.col("o_custkey").alias("k")) for s in "OF")


@query("set_union", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_union(spark, d):
    return collections.union_set(*_two_sets(spark, d))


@query("set_difference", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_difference(spark, d):
    return collections.difference(*_two_sets(spark, d), ["k"])


@query("set_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersection(spark, d):
    return collections.intersection(*_two_sets(spark, d))


@query("set_symmetric_difference", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
(SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def set_symmetric_difference(spark, d):
    return collections.symmetric_difference(*_two_sets(spark, d))


@query("upsert", """
WITH new AS (SELECT CASE WHEN p_size > 45 THEN p_partkey + 1000000 ELSE p_partkey END AS k, p_size AS v FROM part WHERE p_size > 40)
SELECT p_partkey AS k, -1 AS v FROM part WHERE p_partkey NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new""")
def upsert(spark, d):
    p = table(spark, d, "part")
    key = F.when(F.col("p_size") > 45, F.col("p_partkey") + 1_000_000).otherwise(F.col("p_partkey"))
    new = p.where("p_size > 40").select(key.alias("k"), F.col("p_size").alias("v"))
    return collections.upsert(p.select(F.col("p_partkey").alias("k"), F.lit(-1).alias("v")), new, ["k"])


@query("buckets_merged", """
SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def buckets_merged(spark, d):
    e = table(spark, d, "events")
    part = lambda test: e.where(test).groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    merged = collections.merge_buckets(part("value < 50"), part("value >= 50"), key="user_id", values="kinds", distinct=True)
    return merged.select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("buckets_summed", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def buckets_summed(spark, d):
    e = table(spark, d, "events")
    part = lambda test: e.where(test).groupBy("user_id").agg(F.count("*").alias("n"))
    return collections.sum_buckets(part("value < 50"), part("value >= 50"), key="user_id", value="n")


@query("line_diff", """
WITH a AS (SELECT p_partkey AS ord, p_name AS line FROM part),
b AS (SELECT p_partkey AS ord, CASE WHEN p_size % 10 = 0 THEN upper(p_name) ELSE p_name END AS line FROM part WHERE p_partkey % 50 <> 3)
SELECT count(*) FILTER (WHERE a.line IS NOT NULL AND b.line IS NOT NULL AND a.line <> b.line) AS differences,
    count(*) FILTER (WHERE a.line IS NULL OR b.line IS NULL) AS missing FROM a FULL JOIN b ON a.ord = b.ord""")
def line_diff(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("line"))
    b = p.where("p_partkey % 50 <> 3").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 10 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("line"))
    return collections.line_differences(a, b)


@query("first_or_default", "SELECT coalesce((SELECT min(p_name) FROM part WHERE p_partkey = 0 AND p_size > 1000), 'none') AS p_name")
def first_or_default(spark, d):
    return collections.first_or(table(spark, d, "part").where("p_partkey = 0 AND p_size > 1000"), "p_name", "p_partkey", "none")


@query("bernoulli_sample")
def bernoulli_sample(spark, d):
    return table(spark, d, "orders").where(collections.bernoulli(["o_orderkey"], 0.1)).select("o_orderkey")


@query("shuffled", "SELECT c_custkey FROM customer")
def shuffled(spark, d):
    return collections.shuffled(table(spark, d, "customer").select("c_custkey"), ["c_custkey"])


@query("db_selection", """
SELECT n_name, c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 1000""")
def db_selection(spark, d):
    """Both tables go into a database, with their keys, and are selected from there."""
    mark = uuid.uuid4().hex[:8]
    nation = Table(f"nation_{mark}", [Column("n_nationkey", "integer"), Column("n_name", "text", required=True)], ("n_nationkey",))
    key = ForeignKey(nation.name, ("c_nationkey",), ("n_nationkey",))
    customer = Table(f"customer_{mark}", [Column("c_custkey", "integer"), Column("c_nationkey", "integer"), Column("c_acctbal", "real")], ("c_custkey",), [key])
    db = database(spark, f"orrery_{mark}")
    for t, name in ((nation, "nation"), (customer, "customer")):
        db.create(t)
        db.append(table(spark, d, name).select(*[F.col(c.name).cast(TYPES[c.type]).alias(c.name) for c in t.columns]), t)
    joined = Join(nation.name, "c_nationkey", "n_nationkey", "left")
    chosen = Selection(customer.name, ["n_name", "c_custkey", "round(c_acctbal, 2) AS c_acctbal"], [joined], "c_acctbal > 1000", [OrderBy("c_custkey")])
    return db.select(chosen, {customer.name: "c_custkey"})
