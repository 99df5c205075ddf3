"""Performance of equity curves: one wide row for each group of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.functions.tails import normal_cdf
from candlewick.functions.windows import KEY, TIME, corr, ordered, ratio, sofar
from candlewick.operators.returns import YEAR


def _curve(equity: DataFrame, x: str, keys: tuple[str, ...]) -> DataFrame:
    w = ordered(*keys)
    r = ratio(F.col(x), F.lag(x).over(w))
    top = F.max(x).over(sofar(*keys))
    return equity.select(*keys, TIME, F.col(x).alias("eq"), (r - 1).alias("ret"), F.ln(r).alias("log_ret"), ratio(F.col(x) - top, top).alias("dd"))


def underwater(curve: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The longest run of rows below the top so far, by islands that rows at the top part."""
    islands = curve.withColumn("_under", (F.col("dd") < 0).cast("int")).withColumn("_island", F.sum(1 - F.col("_under")).over(sofar(*keys)))
    return islands.groupBy(*keys, "_island").agg(F.sum("_under").alias("_n")).groupBy(*keys).agg(F.max("_n").cast("int").alias("max_dd_duration_bars"))


def tearsheet(equity: DataFrame, x: str = "close", bench: DataFrame | None = None, rf: float = 0.0, periods: int = YEAR, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """28 measures of each group's curve; groups with fewer than two returns give no row.

    bench: (instrument_id, ts, value) of one instrument, for all groups.
    """
    curve = _curve(equity, x, keys)
    e = F.col("log_ret") - rf / periods
    n, mean_log, sd = F.count("ret"), F.avg(e), F.stddev_samp(e)
    down = F.stddev_samp(F.when(e < 0, e))
    year = F.sqrt(F.lit(float(periods)))
    pct = F.percentile("ret", F.array(F.lit(0.05), F.lit(0.01), F.lit(0.95)))
    w = ordered(*keys)
    base = (
        curve.withColumn("_before", F.lag("ret").over(w))
        .groupBy(*keys)
        .agg(
            n.alias("n"),
            (ratio(F.max_by("eq", TIME), F.min_by("eq", TIME)) - 1).alias("total_return"),
            (F.avg("log_ret") * periods).alias("ann_return"),
            (F.stddev_samp("log_ret") * year).alias("ann_vol"),
            F.when(sd == 0, 0.0).otherwise(ratio(mean_log, sd) * year).alias("sharpe"),
            F.when(down > 0, ratio(mean_log, down) * year).alias("sortino"),
            F.min("dd").alias("max_drawdown"),
            F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer_index"),
            pct.alias("_p"),
            F.when(F.min("ret") < F.max("ret"), F.skewness("ret")).alias("skewness"),
            F.when(F.min("ret") < F.max("ret"), F.kurtosis("ret")).alias("excess_kurtosis"),
            ratio(F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)), F.abs(F.sum(F.when(F.col("ret") < 0, F.col("ret")).otherwise(0.0)))).alias("gain_pain_ratio"),
            corr("ret", "_before").alias("return_autocorr"),
        )
        .where("n >= 2")
    )
    wide = (
        base.withColumn("cagr", F.pow(1 + F.col("total_return"), F.lit(float(periods)) / F.col("n")) - 1)
        .withColumn("calmar", ratio(F.col("cagr"), F.abs("max_drawdown")))
        .withColumn("var_95", F.get("_p", F.lit(0)))
        .withColumn("var_99", F.get("_p", F.lit(1)))
        .withColumn("tail_ratio", ratio(F.get("_p", F.lit(2)), F.abs(F.get("_p", F.lit(0)))))
        .withColumn("jarque_bera_stat", F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("excess_kurtosis", F.lit(2)) / 4))
        .withColumn("jarque_bera_pval", F.exp(-F.col("jarque_bera_stat") / 2))
    )
    worst = curve.join(wide.select(*keys, "var_95"), [*keys]).where(F.col("ret") <= F.col("var_95")).groupBy(*keys).agg(F.avg("ret").alias("cvar_95"))
    out = wide.join(worst, [*keys], "left").join(underwater(curve, keys), [*keys])
    if bench is not None:
        out = out.join(against(curve, bench, periods, keys), [*keys], "left")
    return out.drop("_p")


def against(curve: DataFrame, bench: DataFrame, periods: int = YEAR, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Alpha, beta, fit, tracking and captures of simple returns against one benchmark (instrument_id, ts, value)."""
    b = bench.select(TIME, (ratio(F.col("value"), F.lag("value").over(ordered())) - 1).alias("b"))
    both = curve.select(*keys, TIME, F.col("ret").alias("a")).join(b, TIME).where("a is not null and b is not null")
    slope = ratio(F.covar_samp("a", "b"), F.var_samp("b"))
    d = F.col("a") - F.col("b")
    capture = lambda on: ratio(F.avg(F.when(on, F.col("a"))), F.avg(F.when(on, F.col("b"))))
    year = F.sqrt(F.lit(float(periods)))
    return (
        both.groupBy(*keys)
        .agg(
            F.count("*").alias("_m"),
            ((F.avg("a") - slope * F.avg("b")) * periods).alias("alpha"),
            slope.alias("beta"),
            F.pow(corr("a", "b"), F.lit(2)).alias("r_squared"),
            (F.stddev_samp(d) * year).alias("tracking_error"),
            (ratio(F.avg(d), F.stddev_samp(d)) * year).alias("information_ratio"),
            capture(F.col("b") > 0).alias("up_capture"),
            capture(F.col("b") < 0).alias("down_capture"),
        )
        .where("_m > 2")
        .drop("_m")
    )


def sharpe_radicand(sr, skew, excess):
    """As the measure is defined here: with the excess kurtosis in place of the kurtosis."""
    return 1 - skew * sr + (excess - 1) / 4 * sr * sr


def with_psr(sheet: DataFrame, ref: float = 0.0) -> DataFrame:
    """probabilistic_sharpe beside a tearsheet: the chance that the true ratio is above ``ref``."""
    sr = F.col("sharpe")
    root = sharpe_radicand(sr, F.col("skewness"), F.col("excess_kurtosis"))
    z = F.when(root > 0, (sr - ref) * F.sqrt(F.col("n") - 1) / F.sqrt(root))
    return sheet.withColumn("probabilistic_sharpe", normal_cdf(z))


def trade_metrics(trades: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Counts and ratios of trades (pnl) by group; where there are no losses or wins, their measures are null."""
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    base = trades.groupBy(*keys).agg(
        F.count("*").alias("n_trades"),
        (F.count(win) / F.count("*")).alias("win_rate"),
        ratio(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"),
        F.avg("pnl").alias("expectancy"),
        ratio(F.avg(win), F.abs(F.avg(loss))).alias("payoff"),
        F.avg(win).alias("avg_win"),
        F.avg(loss).alias("avg_loss"),
    )
    return base.join(streak(trades, F.col("pnl") > 0, "max_consec_wins", keys), [*keys]).join(streak(trades, F.col("pnl") < 0, "max_consec_losses", keys), [*keys])


def streak(trades: DataFrame, flag, out: str, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """The longest run of one value of the flag, whichever it is: for wins, a run of losses counts as well."""
    w = Window.partitionBy(*keys).orderBy("entry")
    runs = trades.withColumn("_f", flag).withColumn("_new", F.coalesce((F.col("_f") != F.lag("_f").over(w)).cast("int"), F.lit(0)))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max("_n").alias(out))
