"""Bars: roll-ups of ticks and minutes, their quality, and macro series beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.windows import KEY, TIME, sofar

#: Widths of bars by name; all divide a day, so buckets start at midnight UTC.
WIDTHS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}
BAR = ["open", "high", "low", "close", "volume", "quote_volume", "trades"]


def _summed() -> list[Column]:
    return [
        F.min_by("open", TIME).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", TIME).alias("close"),
        *(F.sum(c).alias(c) for c in ("volume", "quote_volume", "trades")),
    ]


def from_ticks(ticks: DataFrame, width: str | None, order: Column) -> DataFrame:
    """Bars of one width from ticks (instrument_id, ts, price, volume); width None: ts is the bucket already.

    order decides which of a bucket's ticks are first and last. Aggregated before the shuffle.
    """
    bucket = F.col(TIME) if width is None else F.window(TIME, WIDTHS[width])["start"]
    return ticks.groupBy(KEY, bucket.alias(TIME)).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("quote_volume"),
        F.count("*").alias("trades"),
    )


def rollup(bars: DataFrame, width: str) -> DataFrame:
    """Coarser bars; coarser ones may come from these in turn, with the same result as from minutes."""
    return bars.groupBy(KEY, F.window(TIME, WIDTHS[width])["start"].alias(TIME)).agg(*_summed())


def cascade(minutes: DataFrame, widths: tuple[str, ...] = ("5m", "1h", "1d")) -> dict[str, DataFrame]:
    """Roll-ups each made from the one before, so that minutes are read once."""
    made, at = {}, minutes
    for w in widths:
        made[w] = at = rollup(at, w)
    return made


def daily(minutes: DataFrame) -> DataFrame:
    """Daily bars from minutes, in the shape of bar_1d: a date, and no adjusted close."""
    d = rollup(minutes, "1d")
    return d.select(KEY, F.to_date(TIME).alias(TIME), "open", "high", "low", "close", F.lit(None).cast("double").alias("adj_close"), "volume", "quote_volume", F.col("trades").cast("int").alias("trades"))


def quality(bars: DataFrame, intraday: bool) -> DataFrame:
    """Rows, first and last time by instrument, and for minutes how many there should be and are missing."""
    got = bars.groupBy(KEY).agg(F.count("*").alias("total"), F.min(TIME).alias("first_ts"), F.max(TIME).alias("last_ts"))
    if not intraday:
        return got.withColumn("expected", F.lit(None).cast("long")).withColumn("missing", F.lit(None).cast("long"))
    seconds = F.unix_seconds(F.col("last_ts").cast("timestamp")) - F.unix_seconds(F.col("first_ts").cast("timestamp"))
    return got.withColumn("expected", F.floor(seconds / 60).cast("long") + 1).withColumn("missing", F.col("expected") - F.col("total"))


def coverage(q: DataFrame) -> DataFrame:
    """Rows of quality() with their share of the expected ones in per cent; null where none are expected."""
    return q.withColumn("coverage_pct", F.when(F.col("expected") > 0, F.round(F.col("total") / F.col("expected") * 100, 1)))


def align(bars: DataFrame, macro: DataFrame, series: list[str]) -> DataFrame:
    """Bars with one column for each macro series, by equal time, then filled forward within the instrument.

    A value dated off the bars' grid is lost, and a series without data is an empty column. The pivoted
    series are one row a day, so Spark broadcasts them where its size check allows.
    """
    wide = macro.where(F.col("series_id").isin(series)).groupBy(F.col(TIME).alias("_at")).pivot("series_id", series).agg(F.first("value"))
    joined = bars.join(wide, bars[TIME] == wide["_at"], "left").drop("_at")
    return joined.withColumns({s: F.last(s, ignorenulls=True).over(sofar()) for s in series})


def pair(a: DataFrame, b: DataFrame, x: str = "close") -> DataFrame:
    """Two series at the times that both have: (instrument_id, ts, a, b); b has one series for all instruments."""
    return a.select(KEY, TIME, F.col(x).alias("a")).join(b.select(TIME, F.col(x).alias("b")), TIME).where("a is not null and b is not null").select(KEY, TIME, "a", "b")
