"""Runs of rows in series too long for one task: drawdown durations, streaks and trades by chunks of time.

Whether a row begins a run is seen from the row before it. Where the current run began is the greatest place so far of a row
that begins one, a running maximum, which chunks compose. So a run may lie over any number of chunks, and no task holds a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.windows import KEY, TIME, chunked, prev, ratio, running, with_leads
from candlewick.operators.backtest import COST, SLIP


def run_lengths(df: DataFrame, flag: Column, chunk: Column, out: str = "run") -> DataFrame:
    """df with the number of rows up to this one that have its flag, without another between; a null flag is one of its own."""
    led = with_leads(df.withColumn("_f", flag), chunk, 1)
    new = led.withColumn("_new", F.when((F.col("_place") == 0) | ~F.col("_f").eqNullSafe(prev("_f")), F.col("_place")))
    own = new.where(~F.col("_lead")).withColumn(KEY, F.col("_own")).drop("_own", "_chunk", "_lead")
    return running(own, chunk, _start=("max", F.col("_new"))).withColumn(out, F.col("_place") - F.col("_start") + 1).drop("_f", "_new", "_start", "_place")


def drawdown_duration(equity: DataFrame, chunk: Column, x: str = "close") -> DataFrame:
    """(instrument_id, max_dd_duration_bars): the longest run of rows below the top so far."""
    under = F.col(x) < F.col("_top")
    runs = run_lengths(running(equity.select(KEY, TIME, x), chunk, _top=("max", F.col(x))), under, chunk)
    return runs.groupBy(KEY).agg(F.coalesce(F.max(F.when(under, F.col("run"))), F.lit(0)).cast("int").alias("max_dd_duration_bars"))


def streak(trades: DataFrame, flag: Column, out: str, chunk: Column) -> DataFrame:
    """The longest run of one value of the flag, whichever it is; chunk: of the trades' ``entry``."""
    rows = trades.withColumn("_chunk_of", chunk).withColumn(TIME, F.col("entry")).withColumn("_flag", flag).select(KEY, TIME, "_flag", "_chunk_of")
    return run_lengths(rows, F.col("_flag"), F.col("_chunk_of")).groupBy(KEY).agg(F.max("run").alias(out))


def trades(positions: DataFrame, chunk: Column, cost: float = COST + SLIP) -> DataFrame:
    """One row for each run of one side that ends, as :func:`candlewick.operators.backtest.trades` gives them."""
    rows = positions.select(KEY, TIME, "close", F.signum("position").alias("_side"))
    marked = chunked(rows, lambda d: d.withColumn("_new", ~F.col("_side").eqNullSafe(prev("_side")) | prev(TIME).isNull()), chunk, 1)
    # each first row of a run ends the run before it
    last = {"entry": prev(TIME), "entry_price": prev("close"), "_was": prev("_side")}
    ended = chunked(marked.where("_new").drop("_new"), lambda d: d.withColumns(last), chunk, 1).where("_was <> 0")
    pnl = F.col("_was") * (ratio(F.col("close"), F.col("entry_price")) - 1) - 2 * cost
    return ended.select(KEY, "entry", F.col(TIME).alias("exit"), F.when(F.col("_was") > 0, "long").otherwise("short").alias("side"), "entry_price", F.col("close").alias("exit_price"), pnl.alias("pnl"))
