"""Parquet tables: checked shapes, appends and rewrites of the date partitions that changed, and feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.windows import no_nan
from candlewick.operators.writes import insert_ignore, upsert

SHAPES = {
    "bar_1m": "instrument_id int, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades int",
    "bar_1d": "instrument_id int, ts date, open double, high double, low double, close double, adj_close double, volume double, quote_volume double, trades int",
    "macro_observation": "series_id string, ts date, value double",
    "ingest_log": "source string, symbol string, granularity string, period string, rows int, checksum_ok boolean, status string, ingested_at timestamp",
}
Feed = Callable[[SparkSession], DataFrame]


def shaped(df: DataFrame, shape: str) -> DataFrame:
    """df in the columns and types of a table, NaN as null; a missing column is an error."""
    kinds = [x.split(" ") for x in SHAPES[shape].split(", ")]
    missing = [n for n, _ in kinds if n not in df.columns]
    if missing:
        raise ValueError(f"{shape} lacks {', '.join(missing)}")
    return no_nan(df.select(*(F.col(n).cast(t).alias(n) for n, t in kinds)))


def load(spark: SparkSession, feed: Feed, shape: str) -> DataFrame:
    """Rows of any feed that gives a table's shape."""
    return shaped(feed(spark), shape)


def write(df: DataFrame, path: str) -> None:
    df.withColumn("date", F.to_date("ts")).write.mode("overwrite").partitionBy("date").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _touched(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """The target's partitions on the batch's dates, pruned by a join on the partition column; none of a table that is
    not written yet."""
    days = batch.select(F.to_date("ts").alias("date")).distinct()
    try:
        target = read(spark, path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        target = batch.withColumn("date", F.to_date("ts")).limit(0)
    return target.join(days, "date", "left_semi")


def append_new(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list) -> None:
    """Insert-ignore into a table: known keys stay as they are."""
    new = insert_ignore(_touched(spark, path, batch).drop("date"), batch, keys, order)
    new.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def rewrite(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], columns: list[str], staging: str, order: list | None = None) -> None:
    """Upsert into a table: only the dates of the batch are written anew, by way of a staging folder.

    The dates' folders are replaced one after the other when all are written, so a reader may see some of them new and
    some old, and so does a table after a crash in between; the staging folder still has all, and running it again
    with the same batch ends alike. :mod:`candlewick.sources.versions` has tables that change all at once.
    """
    merged = upsert(_touched(spark, path, batch).drop("date"), batch, keys, columns, order)
    merged.withColumn("date", F.to_date("ts")).write.mode("overwrite").parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
