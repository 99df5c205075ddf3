"""Reads: instruments, bars by timeframe and range, macro series, and the shapes that charts take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.windows import KEY, TIME
from candlewick.operators.bars import WIDTHS


def instruments(table: DataFrame, asset_class: str | None = None) -> DataFrame:
    """Active instruments, of one class if asked."""
    found = table.where("active")
    return found if asset_class is None else found.where(F.col("asset_class") == asset_class)


def resolve(wanted: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, unknown) for symbols: active instruments only."""
    active = table.where("active").select("symbol", KEY, "native_granularity", "asset_class")
    return wanted.join(active, "symbol"), wanted.join(active, "symbol", "left_anti")


def between(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows with start <= ts <= end; a date as the end of intraday rows means its midnight."""
    if start is not None:
        df = df.where(F.col(TIME) >= F.lit(start).cast(df.schema[TIME].dataType))
    return df if end is None else df.where(F.col(TIME) <= F.lit(end).cast(df.schema[TIME].dataType))


def get_bars(frames: dict[str, DataFrame], timeframe: str, start=None, end=None) -> DataFrame:
    """Bars of one timeframe and range, in order."""
    if timeframe not in WIDTHS or timeframe not in frames:
        raise ValueError(f"unknown timeframe: {timeframe}")
    return between(frames[timeframe], start, end).select(KEY, TIME, "open", "high", "low", "close", "volume").orderBy(KEY, TIME)


def granularity(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """wanted (instrument_id, timeframe) with ``served``: daily instruments have no intraday bars."""
    known = F.col("timeframe").isin(*WIDTHS)
    return wanted.join(table.select(KEY, "native_granularity"), KEY, "left").withColumn("served", known & F.coalesce((F.col("native_granularity") == "1m") | (F.col("timeframe") == "1d"), F.lit(False)))


def latest(minutes: DataFrame, days: DataFrame) -> DataFrame:
    """The last time of each instrument over minutes and days."""
    both = minutes.select(KEY, F.col(TIME).cast("timestamp_ntz").alias(TIME)).unionByName(days.select(KEY, F.col(TIME).cast("timestamp_ntz").alias(TIME)))
    return both.groupBy(KEY).agg(F.max(TIME).alias("latest_ts"))


def get_macro(macro: DataFrame, series: str, start=None, end=None) -> DataFrame:
    return between(macro.where(F.col("series_id") == series), start, end).orderBy(TIME)


def _seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def chart_bars(bars: DataFrame, table: DataFrame) -> DataFrame:
    """Bars as charts take them: upper-case symbol, Unix seconds, no missing volume, and the candle's side."""
    named = bars.join(table.select(KEY, F.upper("symbol").alias("symbol")), KEY)
    return named.select("symbol", _seconds(F.col(TIME)).alias("time"), "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"), (F.col("close") >= F.col("open")).alias("up"))


def chart_macro(macro: DataFrame) -> DataFrame:
    return macro.where("value is not null").select("series_id", _seconds(F.col(TIME)).alias("time"), "value")
