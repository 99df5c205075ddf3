"""Keyed writes: what a table becomes when rows are inserted or updated, and what is left to load.

Each operator gives the new rows or the new table as a DataFrame; :mod:`candlewick.sources.tables` writes
them, one date partition at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of_each(batch: DataFrame, keys: list[str], order: list[Column], newest: bool = False) -> DataFrame:
    """One row a key: the first by order, or the last."""
    by = [c.desc() if newest else c.asc() for c in order]
    return batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The batch's rows to append: keys that the target has not, the first of each."""
    return first_of_each(batch, keys, order).join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """The whole target after the batch: its ``columns`` replace those of known keys, new keys come in.

    Other columns keep what they have, and are the batch's, or null, on new keys.
    """
    if order is not None:
        batch = first_of_each(batch, keys, order, newest=True)
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), batch.withColumn("_s", F.lit(True)).alias("s")
    joined = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    out = []
    for c in target.columns:
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}") if c in batch.columns else F.lit(None).cast(target.schema[c].dataType)
        if c in keys:
            out.append(F.coalesce(old, new).alias(c))
        elif c in columns:
            out.append(F.when(F.col("_s"), new).otherwise(old).alias(c))
        else:
            out.append(F.when(F.col("_t"), old).otherwise(new).alias(c))
    return joined.select(*out)


def log_periods(log: DataFrame, run: DataFrame) -> DataFrame:
    """The ingest log after a run: the newest status of each period, stamped now."""
    keys = ["source", "symbol", "granularity", "period"]
    return upsert(log, run.withColumn("ingested_at", F.current_timestamp()), keys, ["rows", "checksum_ok", "status", "ingested_at"], [F.coalesce("rows", F.lit(-1))])


def periods(symbols: DataFrame, first: str, today: str) -> DataFrame:
    """symbols with each period to load: whole months before this one, then its days up to yesterday."""
    this = F.date_trunc("month", F.lit(today).cast("date")).cast("date")
    start, until = F.date_trunc("month", F.lit(first).cast("date")).cast("date"), F.lit(today).cast("date")
    months = F.when(start < this, F.transform(F.sequence(start, F.add_months(this, -1), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))).otherwise(F.array().cast("array<string>"))
    days = F.when(this < until, F.transform(F.sequence(this, F.date_sub(until, 1)), lambda d: F.date_format(d, "yyyy-MM-dd"))).otherwise(F.array().cast("array<string>"))
    return symbols.withColumn("period", F.explode(F.concat(months, days)))


def to_load(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """Periods whose last status is not ok."""
    keys = ["source", "symbol", "granularity", "period"]
    return wanted.join(log.where("status = 'ok'").select(*keys), keys, "left_anti")


def missing_days(bars: DataFrame, today: str) -> DataFrame:
    """(instrument_id, day) after each instrument's last bar, up to yesterday."""
    ends = bars.groupBy("instrument_id").agg(F.to_date(F.max("ts")).alias("last"))
    yesterday = F.date_sub(F.lit(today).cast("date"), 1)
    start = F.date_add("last", 1)
    return ends.where(start <= yesterday).select("instrument_id", F.explode(F.sequence(start, yesterday)).alias("day"))


def summary(run: DataFrame) -> DataFrame:
    """By symbol: from when, rows fetched, and periods skipped or in error, from a run's log rows."""
    n = lambda s: F.count(F.when(F.col("status") == s, True))
    return run.groupBy("symbol").agg(F.min("period").alias("from_period"), F.sum(F.coalesce("rows", F.lit(0))).alias("fetched"), n("skipped").alias("skipped"), n("error").alias("errors"))
