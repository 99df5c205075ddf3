"""Streams of candles: keyed loading without duplicates, and roll-ups with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.windows import KEY, TIME
from candlewick.operators.bars import WIDTHS
from candlewick.sources.tables import append_new

SCHEMA = "instrument_id int, ts timestamp, open double, high double, low double, close double, volume double, quote_volume double, trades int"


def read(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream of Parquet candle files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(candles: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of each (instrument_id, ts) within the watermark; the checkpoint remembers what has been seen."""
    return candles.withWatermark(TIME, late).dropDuplicatesWithinWatermark([KEY, TIME])


def rollup(candles: DataFrame, width: str, late: str = "1 hour", counted: bool = False) -> DataFrame:
    """Tumbling bars, given out when the watermark has passed them; later rows are dropped (:func:`late_rows` counts
    them). On the same rows it gives what the batch roll-up gives. counted: a column ``rows``, of how many rows a bar is made."""
    w = F.window(TIME, WIDTHS[width])
    more = [F.count("*").alias("rows")] if counted else []
    agg = candles.withWatermark(TIME, late).groupBy(KEY, w.alias("w")).agg(
        F.min_by("open", TIME).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", TIME).alias("close"), *(F.sum(c).alias(c) for c in ("volume", "quote_volume", "trades")), *more
    )
    return agg.select(KEY, F.col("w.start").alias(TIME), "open", "high", "low", "close", "volume", "quote_volume", "trades", *(["rows"] if counted else []))


def arrivals(candles: DataFrame, width: str, path: str, checkpoint: str):
    """A query that counts the rows of each batch by instrument and bar, before any watermark; a batch that comes again
    replaces its own counts. It keeps no state."""

    def put(batch: DataFrame, n: int) -> None:
        counts = batch.groupBy(KEY, F.window(TIME, WIDTHS[width]).alias("w")).agg(F.count("*").alias("rows"))
        counts.select(KEY, F.col("w.start").alias(TIME), "rows").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return candles.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def late_rows(arrived: DataFrame, bars: DataFrame, until: Column) -> DataFrame:
    """(instrument_id, ts, arrived, in_bar, late) of each bar that starts before ``until``, up to where all bars are out: rows of
    :func:`arrivals` that are not in the bar that ``rollup(counted=True)`` gave out came behind the watermark. A bar whose
    rows were all late was never given out, and has 0 in it."""
    came = arrived.where(F.col(TIME) < until).groupBy(KEY, TIME).agg(F.sum("rows").alias("arrived"))
    held = F.coalesce("rows", F.lit(0).cast("long"))
    return came.join(bars.select(KEY, TIME, "rows"), [KEY, TIME], "left").select(KEY, TIME, "arrived", held.alias("in_bar"), (F.col("arrived") - held).alias("late"))


def load_table(candles: DataFrame, path: str, checkpoint: str):
    """A query that inserts each batch's new keys into a table; a batch that comes again changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        append_new(batch.sparkSession, path, batch, [KEY, TIME], [F.col("open")])

    return candles.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
