"""Market frames from the warehouse tables, and the SQL that makes the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators import bars as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark, sf_dir) -> DataFrame:
    """Daily bars of seven instruments: line numbers, with order lines for ticks."""
    lines = table(spark, sf_dir, "lineitem")
    ticks = lines.select(
        F.col("l_linenumber").alias("instrument_id"),
        F.to_date("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("order"),
    )
    got = B.from_ticks(ticks, None, F.col("order"))
    return got.withColumn("quote_volume", F.round("quote_volume", 2))


def ticks(spark, sf_dir) -> DataFrame:
    """Events as ticks: users are instruments, each event a trade of one."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("instrument_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id")


def minutes(spark, sf_dir) -> DataFrame:
    return B.from_ticks(ticks(spark, sf_dir), "1m", F.struct("ts", "event_id"))


def macro(spark, sf_dir) -> DataFrame:
    """Mean order totals by priority and day, as series of their own."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("value"))


def instrument(spark, sf_dir) -> DataFrame:
    """One instrument for each nation; even ones are crypto with minutes, every seventh is not active."""
    n = table(spark, sf_dir, "nation")
    even = F.col("n_nationkey") % 2 == 0
    return n.select(
        F.col("n_nationkey").cast("int").alias("instrument_id"),
        F.col("n_name").alias("symbol"),
        F.when(even, "crypto").otherwise("equity").alias("asset_class"),
        F.when(even, "1m").otherwise("1d").alias("native_granularity"),
        (F.col("n_nationkey") % 7 != 6).alias("active"),
    )


def bench(spark, sf_dir) -> DataFrame:
    return daily_bars(spark, sf_dir).where("instrument_id = 1")


BARS = """
bars AS (SELECT l_linenumber AS instrument_id, CAST(l_shipdate AS DATE) AS ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
  sum(l_quantity) AS volume, round(sum(price * l_quantity), 2) AS quote_volume, count(*) AS trades
  FROM (SELECT *, l_extendedprice / l_quantity AS price, row(l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem) GROUP BY 1, 2)"""
MINUTES = """
minutes AS (SELECT user_id AS instrument_id, time_bucket(INTERVAL 1 minute, ts) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume, sum(value) AS quote_volume, count(*) AS trades FROM events GROUP BY 1, 2)"""
MACRO = "macro AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"
INSTRUMENT = """
instrument AS (SELECT n_nationkey::INT AS instrument_id, n_name AS symbol, CASE WHEN n_nationkey % 2 = 0 THEN 'crypto' ELSE 'equity' END AS asset_class,
  CASE WHEN n_nationkey % 2 = 0 THEN '1m' ELSE '1d' END AS native_granularity, n_nationkey % 7 <> 6 AS active FROM nation)"""
