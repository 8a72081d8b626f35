"""Star-schema tables read as node-day series: a supplier's nation is a node, a ship date a day, net price the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASELINE = (1996, 2000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def node_lon(node: Column) -> Column:
    return ((node * 37) % 360 - 180).cast("double")


def node_lat(node: Column) -> Column:
    return ((node * 17) % 140 - 70).cast("double")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, lon, lat of all nations."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))
    return n.select("node", node_lon(F.col("node")).alias("lon"), node_lat(F.col("node")).alias("lat"))


def node_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, day, value, year, month, doy: net price shipped from a nation on a day, to four decimals."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("node"))
    # Pre-aggregated by supplier and day, the join moves days instead of order lines.
    daily = lines.groupBy("l_suppkey", "day").agg(F.sum("net").alias("net"))
    summed = daily.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("node", "day").agg(F.round(F.sum("net"), 4).alias("value"))
    return summed.select("node", "day", "value", F.year("day").alias("year"), F.month("day").alias("month"), F.dayofyear("day").alias("doy"))


def orders_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """status, year, n: orders counted by status and year."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.year("o_orderdate").alias("year"))
    return o.groupBy(F.col("o_orderstatus").alias("status"), "year").agg(F.count(F.lit(1)).alias("n"))
