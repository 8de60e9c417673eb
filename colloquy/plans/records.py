"""Queries on semi-structured records."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import records as R

from .metrics import points, r6

LEVELS = [1000.0, 1300.0, 1600.0, 1900.0]
CHOICES = ["ask", "confirm", "refine", "stop"]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_orders(spark, sf_dir):
    """Nested parameters of each order as columns."""
    inner = F.struct(F.col("o_orderpriority").alias("priority"), F.struct(F.col("o_orderstatus").alias("status")).alias("state"))
    return R.flattened(table(spark, sf_dir, "orders").select("o_orderkey", inner.alias("param")), "param")


def answer_objects(spark, sf_dir):
    """The JSON object and list that free text around an event's properties holds."""
    rows = table(spark, sf_dir, "events")
    odd = F.col("event_id") % 5 == 0
    text = F.concat(F.lit("Sure: "), F.when(odd, F.lit("none }")).otherwise(F.col("props")), F.lit(" [1, 2] ok"))
    return rows.select("event_id", R.json_object(text).alias("object"), R.json_list(text).alias("list"))


def slot_checks(spark, sf_dir):
    """Which slots of a customer's form are missing."""
    rows = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    slots = F.create_map(
        F.lit("segment"), F.when(key % 3 != 0, F.col("c_mktsegment")), F.lit("nation"), F.when(key % 4 == 0, "None").otherwise(F.col("c_nationkey").cast("string")), F.lit("name"), F.col("c_name")
    )
    return rows.select("c_custkey", R.all_collected(slots).alias("complete"), F.array_join(R.missing_slots(slots), ",").alias("missing"))


def lower_prices(spark, sf_dir):
    """The next lower price level of each part, and whether it is at the lowest."""
    levels = F.array(*map(F.lit, LEVELS))
    price = F.col("p_retailprice").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", R.next_lower(price, levels).alias("lower"), R.is_lowest(price, levels).alias("lowest"))


def picked_intents(spark, sf_dir):
    """A weighted choice among the intents that are open to a customer."""
    rows = table(spark, sf_dir, "customer")
    open_ = F.slice(F.array(*map(F.lit, CHOICES)), 1, (F.col("c_custkey") % 5).cast("int"))
    weights = F.create_map(F.lit("ask"), F.lit(1.0), F.lit("stop"), F.lit(0.25))
    return rows.select("c_custkey", R.weighted_pick(open_, weights, F.lit("pick"), F.col("c_custkey").cast("string")).alias("intent"))


def objective_bounds(spark, sf_dir):
    return r6(R.ideal_and_nadir(points(spark, sf_dir), "g", ["x", "y"]), "ideal_x", "nadir_x", "ideal_y", "nadir_y")


QUERIES = {f.__name__: f for f in (flat_orders, answer_objects, slot_checks, lower_prices, picked_intents, objective_bounds)}

SQL = {
    "flat_orders": "SELECT o_orderkey, o_orderpriority AS param_priority, o_orderstatus AS param_state_status FROM orders",
    "answer_objects": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props END AS object, '[1, 2]' AS list FROM events",
    "slot_checks": "SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AS complete, concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'nation' END, CASE WHEN c_custkey % 3 = 0 THEN 'segment' END) AS missing FROM customer",
    "lower_prices": "SELECT p_partkey, list_max(list_filter([1000.0, 1300.0, 1600.0, 1900.0]::DOUBLE[], lambda x: x < p_retailprice)) AS lower, p_retailprice <= 1000 AS lowest FROM part",
    "picked_intents": """
WITH u AS (SELECT c_custkey, c_custkey % 5 AS n, ('0x' || substr(md5('pick:' || c_custkey), 1, 8))::UBIGINT / 4294967296.0 AS u FROM customer),
b AS (SELECT *, u * (CASE n WHEN 0 THEN 0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 WHEN 3 THEN 2.0 ELSE 2.25 END) AS b FROM u)
SELECT c_custkey, CASE WHEN n = 0 THEN NULL WHEN b < 1 THEN 'ask' WHEN b < 1.5 THEN 'confirm' WHEN b < 2 THEN 'refine' ELSE 'stop' END AS intent FROM b""",
    "objective_bounds": "SELECT l_suppkey AS g, round(min(l_quantity / 100), 6) AS ideal_x, round(max(l_quantity / 100), 6) AS nadir_x, round(min(l_discount), 6) AS ideal_y, round(max(l_discount), 6) AS nadir_y FROM lineitem GROUP BY 1",
}
