"""Backtests of signals on closes, by instrument or by any finer keys (folds, sides)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.functions.windows import KEY, TIME, ordered, ratio, sofar

COST, SLIP, CAPITAL = 0.001, 0.0005, 10_000.0


def run_backtest(df: DataFrame, cost: float = COST, slip: float = SLIP, fraction: float = 1.0, capital: float = CAPITAL, short: bool = False, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """df (close, signal) with position, price_return, strategy_return and equity.

    A signal fills on the next bar; positions cost on every change; shorts count as flat unless allowed.
    """
    w = ordered(*keys)
    pos = F.coalesce(F.lag("signal").over(w).cast("double"), F.lit(0.0))
    pos = (pos if short else F.greatest(pos, F.lit(0.0))) * fraction
    got = df.withColumn("position", pos).withColumn("price_return", F.coalesce(ratio(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)))
    moved = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    got = got.withColumn("strategy_return", F.col("position") * F.col("price_return") - moved * (cost + slip))
    return got.withColumn("equity", F.product(1 + F.col("strategy_return")).over(sofar(*keys)) * capital)


def trades(positions: DataFrame, cost: float = COST + SLIP, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """One row for each run of one side that ends: it leaves at the first bar of the next run; an open run gives none."""
    w = ordered(*keys)
    side = positions.withColumn("_side", F.signum("position")).withColumn("_new", F.coalesce((F.col("_side") != F.lag("_side").over(w)).cast("int"), F.lit(1)))
    runs = side.where("_new = 1").select(*keys, F.col(TIME).alias("entry"), F.col("close").alias("entry_price"), "_side")
    by = Window.partitionBy(*keys).orderBy("entry")
    done = runs.withColumn("exit", F.lead("entry").over(by)).withColumn("exit_price", F.lead("entry_price").over(by)).where("_side <> 0 and exit is not null")
    pnl = F.col("_side") * (ratio(F.col("exit_price"), F.col("entry_price")) - 1) - 2 * cost
    return done.select(*keys, "entry", "exit", F.when(F.col("_side") > 0, "long").otherwise("short").alias("side"), "entry_price", "exit_price", pnl.alias("pnl"))


def event_study(bars: DataFrame, events: DataFrame, window: int = 20) -> DataFrame:
    """(instrument_id, lag, mean_ret, std_ret) of log returns around events (instrument_id, ts).

    Events off the bars or too near an edge are left out; a repeated event counts again; a lag with a
    missing return is null.
    """
    numbered = bars.withColumn("_rn", F.row_number().over(ordered())).withColumn("_lr", F.ln(ratio(F.col("close"), F.lag("close").over(ordered()))))
    numbered = numbered.withColumn("_n", F.count("*").over(Window.partitionBy(KEY)))
    at = events.select(KEY, TIME).join(numbered.select(KEY, TIME, "_rn", "_n"), [KEY, TIME])
    at = at.where((F.col("_rn") > window) & (F.col("_rn") + window <= F.col("_n")))
    paths = at.withColumn("lag", F.explode(F.sequence(F.lit(-window), F.lit(window)))).select(KEY, "lag", (F.col("_rn") + F.col("lag")).alias("_rn"))
    joined = paths.join(numbered.select(KEY, "_rn", "_lr"), [KEY, "_rn"])
    whole = F.count("_lr") == F.count("*")
    return joined.groupBy(KEY, "lag").agg(F.when(whole, F.avg("_lr")).alias("mean_ret"), F.when(whole, F.stddev_samp("_lr")).alias("std_ret"))


def regime_mask(df: DataFrame, regime: str = "regime") -> DataFrame:
    """The signal where the regime holds, else 0; an unknown regime holds."""
    return df.withColumn("signal", F.when(F.coalesce(F.col(regime).cast("boolean"), F.lit(True)), F.col("signal")).otherwise(F.lit(0)))


def cross_signal(df: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """A signal for tests and examples: 1 while the fast mean of closes is above the slow one, -1 while below."""
    w = ordered()
    mean = lambda p: F.avg("close").over(w.rowsBetween(-(p - 1), 0))
    ready = F.row_number().over(w) >= slow
    return df.withColumn("signal", F.when(ready & (mean(fast) > mean(slow)), 1).when(ready & (mean(fast) < mean(slow)), -1).otherwise(0))
