"""Tables by name: readers, views and the roles that the test tables play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> list[str]:
    """One temporary view for each table, by sorted name; nothing is stored."""
    for name in sorted(names):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return sorted(names)


def query(spark: SparkSession, sql: str, *parameters: object) -> DataFrame:
    """SQL over the views, with positional parameters."""
    return spark.sql(sql, args=list(parameters))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-precision events: orders with their customer as issuer and the customer's nation as security."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kind = F.when(F.col("o_orderstatus") == "O", "equity_purchase").when(F.col("o_orderstatus") == "F", "equity_sale").otherwise("other")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("issuer_id"), F.col("c_nationkey").alias("security_id"),
        F.col("o_orderdate").cast("date").alias("public_date"), kind.alias("event_type"), F.col("o_orderpriority").alias("family"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by supplier nation and ship date; open and close are the least and largest price."""
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).groupBy(F.col("s_nationkey").alias("security_id"), F.col("l_shipdate").cast("date").alias("session_date")).agg(F.min(price).alias("open"), F.max(price).alias("close"), F.count("*").alias("n"))


def benchmark_bars(bars: DataFrame) -> DataFrame:
    """The bars of all securities together, by day."""
    return bars.groupBy("session_date").agg(F.min("open").alias("open"), F.max("close").alias("close"))
