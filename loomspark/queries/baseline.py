"""Plain engine queries; they are no parity claims, only what any user of Spark expects to run."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL"
)
def tpch_q1_like(spark, d):
    lines = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )


@query(
    "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10"
)
def tpch_q3_like(spark, d):
    buyers = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = buyers.join(orders, F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum("r"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6_like(spark, d):
    return table(spark, d, "lineitem").where("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lineitem(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT a.event_id, arg_max(b.value, struct_pack(t := b.ts, i := b.event_id)) AS price FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id)) WHERE a.event_type = 'purchase' GROUP BY a.event_id")
def asof_price(spark, d):
    """As-of join in one shuffle: both sides in one table, the last view carried forward per user."""
    e = table(spark, d, "events").where("event_type IN ('view', 'purchase')").select("event_id", "user_id", "ts", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w)
    return e.withColumn("price", last).where("event_type = 'purchase'").select("event_id", "price")


@query("SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part")
def rank_window(spark, d):
    w = Window.partitionBy("p_brand")
    return table(spark, d, "part").select("p_partkey", "p_brand", F.rank().over(w.orderBy(F.desc("p_retailprice"))).cast("long").alias("r"), F.dense_rank().over(w.orderBy("p_size")).cast("long").alias("dr"))


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def set_intersect(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")))
