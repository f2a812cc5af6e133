"""Tables of the test star schema read as sonar tables.

lineitem is a sounding table (l_orderkey = ping, l_linenumber = beam, l_quantity = depth, l_extendedprice = x,
l_returnflag 'R' = rejected); events is a ping or attitude series (user_id = system, value = depth or heading).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("ping"),
        F.col("l_linenumber").alias("beam"),
        F.col("l_quantity").alias("z"),
        F.col("l_extendedprice").alias("x"),
        F.col("l_orderkey").cast("double").alias("y"),
        F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("detectioninfo"),
        F.col("l_discount").alias("tvu"),
        F.col("l_tax").alias("thu"),
        F.col("l_suppkey").alias("frequency"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (system, time in seconds, counter, value, mode, props)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("system"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("time"),
        F.col("event_id").alias("counter"),
        "value",
        F.col("event_type").alias("mode"),
        "props",
    )


#: The same series in SQL.
SERIES_SQL = "(SELECT user_id AS system, epoch_us(ts) / 1e6 AS time, event_id AS counter, value, event_type AS mode, props FROM events)"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as navigation: line = a number of the customer, time = the date's seconds and the key, positions from the keys."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("ping"), (c % 40).alias("line"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 + (k % 1000)).alias("time"),
        ((c % 160) - 80 + (k % 1000) / 1000.0).cast("double").alias("lat"), ((k % 340) - 170 + (c % 1000) / 1000.0).cast("double").alias("lon"), F.col("o_totalprice").alias("z"),
    )


POSITIONS_SQL = "(SELECT o_orderkey AS ping, o_custkey % 40 AS line, epoch_us(o_orderdate) / 1e6 + (o_orderkey % 1000) AS time, (o_custkey % 160) - 80 + (o_orderkey % 1000) / 1000.0 AS lat, (o_orderkey % 340) - 170 + (o_custkey % 1000) / 1000.0 AS lon, o_totalprice AS z FROM orders)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a system: for each of the modes, the half of its span that begins there; line names are the modes."""
    s = series(spark, sf_dir)
    return s.groupBy("system", F.col("mode").alias("line")).agg(F.min("time").alias("start_time"), (F.min("time") + (F.max("time") - F.min("time")) / 8).alias("end_time"))


LINES_SQL = f"(SELECT system, mode AS line, min(time) AS start_time, min(time) + (max(time) - min(time)) / 8 AS end_time FROM {SERIES_SQL} GROUP BY 1, 2)"
