"""Daily equity bars from JSON files, {symbol}.json or in a folder symbol={symbol}: {"values": [{"datetime", "open", ...}]}, all strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "struct<datetime:string,open:string,high:string,low:string,close:string,adjusted_close:string,volume:string>"


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bars by symbol, errors): a file whose status is error gives a message instead of bars."""
    raw = spark.read.schema(f"status string, message string, values array<{_VALUE}>").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    name = F.input_file_name()
    raw = raw.withColumn("symbol", F.coalesce(F.nullif(F.regexp_extract(name, "/symbol=([^/]+)/", 1), F.lit("")), F.regexp_extract(name, r"([^/]+)\.json$", 1)))
    bad = F.coalesce(F.col("status") == "error", F.lit(False))
    v = raw.where(~bad).select("symbol", F.explode("values").alias("v"))
    d = lambda c: F.col(f"v.{c}").cast("double")
    bars = v.select("symbol", F.to_date("v.datetime").alias("ts"), d("open").alias("open"), d("high").alias("high"), d("low").alias("low"), d("close").alias("close"), F.coalesce(d("adjusted_close"), d("close")).alias("adj_close"), d("volume").alias("volume"))
    return bars, raw.where(bad).select("symbol", "message")


def to_bars(bars: DataFrame, instrument: DataFrame) -> DataFrame:
    """In the shape of bar_1d: no quote volume and no count of trades."""
    got = bars.join(instrument.select("symbol", "instrument_id"), "symbol").drop("symbol")
    return got.select("instrument_id", "ts", "open", "high", "low", "close", "adj_close", "volume", F.lit(None).cast("double").alias("quote_volume"), F.lit(None).cast("int").alias("trades"))
