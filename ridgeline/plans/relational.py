"""Queries over the order tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money, revenue
from ..session import table
from ..sources import scratch
from ..sources.history import History


def revenue_by_nation(spark: SparkSession, root: str) -> DataFrame:
    """Net revenue by region and nation of the customer."""
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, root, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, root, "nation").join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by_order = lines.groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"))
    joined = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    by_nation = joined.groupBy("c_nationkey").agg(F.sum("r").alias("r"))
    return by_nation.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", F.col("r").cast("double").alias("revenue"))


def pricing_summary(spark: SparkSession, root: str) -> DataFrame:
    """Sums and means of line items by return flag and status up to a date."""
    lines = table(spark, root, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-12-01").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.sum(revenue()).cast("double").alias("sum_disc_price"),
        F.round(F.sum(money("l_quantity")).cast("double") / F.count(F.lit(1)), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"),
    )


def nation_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Customers and balances by region and nation, with subtotals."""
    names = table(spark, root, "nation").join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = table(spark, root, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    sums = rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.sum(money("c_acctbal")).cast("double").alias("balance"), F.grouping_id().cast("long").alias("level"))
    return sums.select("r_name", "n_name", "customers", "balance", "level")


def orders_cube(spark: SparkSession, root: str) -> DataFrame:
    """Orders by status and priority, all combinations of subtotals."""
    return table(spark, root, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.sum(money("o_totalprice")).cast("double").alias("total"))


def status_pivot(spark: SparkSession, root: str) -> DataFrame:
    """Orders by priority, a column for each status."""
    return table(spark, root, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


def customers_without_urgent(spark: SparkSession, root: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, root, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    return table(spark, root, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def orders_without_lines(spark: SparkSession, root: str) -> DataFrame:
    """Orders that no line item names."""
    lines = table(spark, root, "lineitem").select("l_orderkey")
    return table(spark, root, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus")


def top_customers(spark: SparkSession, root: str) -> DataFrame:
    """The three customers of largest balance of each nation."""
    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranked = table(spark, root, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(order).alias("place"))
    return ranked.filter("place <= 3")


def moving_total(spark: SparkSession, root: str) -> DataFrame:
    """Total of each order and the customer's two before it."""
    frame = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, root, "orders").select("o_custkey", "o_orderkey", F.sum(money("o_totalprice")).over(frame).cast("double").alias("moving"))


def parts_never_returned(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of part and supplier sold in large lines and never returned."""
    lines = table(spark, root, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    pair = ["l_partkey", "l_suppkey"]
    return lines.filter("l_quantity >= 40").select(*pair).subtract(lines.filter("l_returnflag = 'R'").select(*pair))


def suppliers_in_both(spark: SparkSession, root: str) -> DataFrame:
    """Nations that both a rich supplier and a rich customer are from."""
    a = table(spark, root, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey"))
    b = table(spark, root, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"))
    return a.intersect(b)


_REVENUE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(12,2)) - CAST(l_discount AS DECIMAL(12,2)))"

def customer_priority_as_of(spark: SparkSession, root: str) -> DataFrame:
    """The priority of each customer's latest order by the start of 1999, as
    known from finished orders, and as known once the others were recorded."""
    orders = table(spark, root, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderdate").alias("valid_from"), "o_orderstatus")
    history = History(spark, scratch.new_path(spark, "priorities"), ["o_custkey"], ["o_orderpriority"])
    loads = {1: (datetime(2002, 1, 1), "o_orderstatus = 'F'"), 2: (datetime(2003, 1, 1), "o_orderstatus <> 'F'")}
    for at, which in loads.values():
        history.merge(orders.filter(which), at)
    found = [history.as_of(datetime(1999, 1, 1), at).withColumn("load", F.lit(load)) for load, (at, _) in loads.items()]
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("valid_from", "valid_to")]
    return found[0].unionByName(found[1]).select("load", "o_custkey", "o_orderpriority", *times)


QUERIES = (
    revenue_by_nation, pricing_summary, nation_rollup, orders_cube, status_pivot, customers_without_urgent,
    orders_without_lines, top_customers, moving_total, parts_never_returned, suppliers_in_both,
    customer_priority_as_of,
)

SQL = {
    "customer_priority_as_of": """
WITH known AS (
  SELECT load, o_custkey, o_orderdate AS valid_from, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS since FROM orders, (VALUES (1), (2)) l(load) WHERE load >= since),
points AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY load, o_custkey, valid_from ORDER BY since DESC, o_orderpriority DESC) = 1),
line AS (SELECT *, lead(valid_from) OVER (PARTITION BY load, o_custkey ORDER BY valid_from) AS valid_to FROM points)
SELECT load, o_custkey, o_orderpriority, valid_from, valid_to FROM line WHERE valid_from <= TIMESTAMP '1999-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1999-01-01')""",
    "revenue_by_nation": f"""
SELECT r_name, n_name, CAST(sum({_REVENUE}) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    "pricing_summary": f"""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty, CAST(sum({_REVENUE}) AS DOUBLE) AS sum_disc_price,
  round(CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(*), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-12-01' GROUP BY l_returnflag, l_linestatus""",
    "nation_rollup": """
SELECT r_name, n_name, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance, CAST(grouping(r_name, n_name) AS BIGINT) AS level
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    "orders_cube": """
SELECT o_orderstatus, o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "status_pivot": """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P
FROM orders GROUP BY o_orderpriority""",
    "customers_without_urgent": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "orders_without_lines": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "top_customers": """
SELECT c_nationkey, c_custkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS place
FROM customer QUALIFY place <= 3""",
    "moving_total": """
SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving
FROM orders""",
    "parts_never_returned": """
SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 40 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'""",
    "suppliers_in_both": "SELECT s_nationkey AS nationkey FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000",
}
