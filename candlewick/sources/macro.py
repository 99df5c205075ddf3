"""Macro series from CSV files, {series_id}.csv or any in a folder series_id={series_id}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAILY_FROM = "2025-01-01"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, ts, value): blank dates and one-column rows are left out; '.' and '' are null."""
    raw = spark.read.schema("date string, value string").option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).option("nullValue", "\u0000").option("recursiveFileLookup", True).csv(path)
    name = F.input_file_name()
    folder = F.url_decode(F.regexp_extract(name, "/series_id=([^/]+)/", 1))
    v = F.trim(F.coalesce("value", F.lit("")))
    got = raw.where("value is not null and trim(coalesce(date, '')) <> ''")
    return got.select(F.coalesce(F.nullif(folder, F.lit("")), F.regexp_extract(name, r"([^/]+)\.csv$", 1)).alias("series_id"), F.to_date(F.trim("date")).alias("ts"), F.when(v.isin("", "."), None).otherwise(v).cast("double").alias("value"))


def capped(observations: DataFrame, series: DataFrame, since: str = DAILY_FROM) -> DataFrame:
    """Daily series (frequency D) from a date on only; others whole."""
    joined = observations.join(series.select("series_id", "frequency"), "series_id", "left")
    return joined.where(F.coalesce(F.col("frequency") != "D", F.lit(True)) | (F.col("ts") >= F.lit(since).cast("date"))).drop("frequency")
