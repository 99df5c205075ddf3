"""Checks against overfitting: walk-forward folds, purged folds, deflated Sharpe ratios, block bootstrap.

A signal function takes bars and adds the column ``signal`` with window expressions (or by a grouped function),
for all instruments at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.functions.tails import normal_cdf, normal_quantile
from candlewick.functions.windows import KEY, TIME, ordered, ratio, running, sofar, with_leads
from candlewick.operators.backtest import CAPITAL, COST, SLIP, run_backtest
from candlewick.operators.metrics import sharpe_radicand
from candlewick.operators.returns import YEAR

Signal = Callable[[DataFrame], DataFrame]
EULER = 0.5772156649


def _numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("_rn", F.row_number().over(ordered()) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(KEY)))


def _sharpe_and_drawdown(curve: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of backtest rows by keys; null with fewer than two returns."""
    w = ordered(*keys)
    lr = F.ln(ratio(F.col("equity"), F.lag("equity").over(w)))
    top = F.max("equity").over(sofar(*keys))
    rows = curve.withColumn("_lr", lr).withColumn("_dd", ratio(F.col("equity") - top, top))
    sd = F.stddev_samp("_lr")
    enough = F.count("_lr") >= 2
    return rows.groupBy(*keys).agg(
        F.when(enough, F.when(sd > 0, ratio(F.avg("_lr"), sd) * math.sqrt(YEAR)).otherwise(0.0)).alias("sharpe"),
        F.when(enough, F.min("_dd")).alias("max_dd"),
        F.min(TIME).alias("first_ts"),
        F.max(TIME).alias("last_ts"),
    )


def walk_forward(bars: DataFrame, signal: Signal, train: int = 504, test: int = 126, cost: float = COST, slip: float = SLIP, causal: bool = True) -> DataFrame:
    """(instrument_id, fold, fold_start, fold_end, is_sharpe, oos_sharpe, is_max_dd, oos_max_dd): growing
    training spans, test spans of ``test`` rows, each backtested by itself.

    causal: the signal of a row depends on rows up to it only. Then a prefix's signals and backtest are those of
    the whole series, and each training span is a prefix of one backtest: nothing is repeated. Otherwise every
    fold gets its own copy of its prefix, by (instrument, fold).
    """
    numbered = _numbered(bars)
    last = F.floor((F.col("_n") - train) / test).cast("int") - 1
    if causal:
        whole = signal(numbered)
        fold = F.floor((F.col("_rn") - train) / test).cast("int")
        tested = whole.withColumn("fold", fold).where((F.col("_rn") >= train) & (F.col("fold") <= last))
        oos = _sharpe_and_drawdown(run_backtest(tested, cost, slip, keys=(KEY, "fold")), (KEY, "fold"))
        trained = run_backtest(whole, cost, slip)
        w, run = ordered(), sofar()
        top = F.max("equity").over(run)
        trained = trained.withColumn("_lr", F.ln(ratio(F.col("equity"), F.lag("equity").over(w)))).withColumn("_dd", ratio(F.col("equity") - top, top))
        sd = F.stddev_samp("_lr").over(run)
        trained = trained.withColumn("is_sharpe", F.when(sd > 0, ratio(F.avg("_lr").over(run), sd) * math.sqrt(YEAR)).otherwise(0.0)).withColumn("is_max_dd", F.min("_dd").over(run))
        ends = trained.where((F.col("_rn") >= train - 1) & ((F.col("_rn") - (train - 1)) % test == 0)).withColumn("fold", ((F.col("_rn") - (train - 1)) / test).cast("int"))
        ins = ends.where(F.col("fold") <= last).select(KEY, "fold", "is_sharpe", "is_max_dd")
    else:
        # each prefix is a series of its own: the signal function sees (instrument, fold) as its instrument
        folds = numbered.groupBy(KEY).agg(F.max("_n").alias("_n")).where(last >= 0).select(KEY, F.explode(F.sequence(F.lit(0), last)).alias("fold"))
        copies = numbered.join(folds, KEY).where(F.col("_rn") < train + (F.col("fold") + 1) * test)
        named = copies.withColumn("_own", F.col(KEY)).withColumn(KEY, F.concat_ws("#", F.col(KEY).cast("string"), F.col("fold").cast("string")))
        done = signal(named).withColumn(KEY, F.col("_own")).withColumn("side", F.when(F.col("_rn") < train + F.col("fold") * test, "is").otherwise("oos"))
        both = _sharpe_and_drawdown(run_backtest(done.drop("_own"), cost, slip, keys=(KEY, "fold", "side")), (KEY, "fold", "side"))
        oos = both.where("side = 'oos'").drop("side")
        ins = both.where("side = 'is'").select(KEY, "fold", F.col("sharpe").alias("is_sharpe"), F.col("max_dd").alias("is_max_dd"))
    out = oos.join(ins, [KEY, "fold"])
    return out.select(KEY, "fold", F.col("first_ts").alias("fold_start"), F.col("last_ts").alias("fold_end"), "is_sharpe", F.col("sharpe").alias("oos_sharpe"), "is_max_dd", F.col("max_dd").alias("oos_max_dd"))


def purged_folds(bars: DataFrame, k: int = 5, embargo: int = 10) -> DataFrame:
    """(instrument_id, fold, ts, side): test rows of each fold, and training rows outside it and its embargo."""
    numbered = _numbered(bars).select(KEY, TIME, "_rn", "_n").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size = F.floor(F.col("_n") / k)
    start = F.col("fold") * size
    end = F.when(F.col("fold") == k - 1, F.col("_n")).otherwise(start + size)
    side = F.when((F.col("_rn") >= start) & (F.col("_rn") < end), "test").when((F.col("_rn") < start - embargo) | (F.col("_rn") >= F.least(F.col("_n"), end + embargo)), "train")
    return numbered.withColumn("side", side).where("side is not null").select(KEY, "fold", TIME, "side")


def pbo(bars: DataFrame, signal: Signal, k: int = 16, cost: float = COST, slip: float = SLIP) -> DataFrame:
    """(instrument_id, pbo): the share of test folds whose Sharpe ratio is below the folds' median."""
    numbered = signal(_numbered(bars))
    size = F.floor(F.col("_n") / k)
    folds = numbered.withColumn("fold", F.least(F.when(size > 0, F.floor(F.col("_rn") / size)).otherwise(k - 1), F.lit(k - 1)).cast("int"))
    each = _sharpe_and_drawdown(run_backtest(folds, cost, slip, keys=(KEY, "fold")), (KEY, "fold")).withColumn("sharpe", F.coalesce("sharpe", F.lit(0.0)))
    median = each.groupBy(KEY).agg(F.percentile("sharpe", F.lit(0.5)).alias("_m"))
    return each.join(median, KEY).groupBy(KEY).agg(F.avg((F.col("sharpe") < F.col("_m")).cast("double")).alias("pbo"))


def probabilistic_sharpe(sr: Column, ref: Column, n: Column, skew: Column, excess: Column) -> Column:
    root = sharpe_radicand(sr, skew, excess)
    return normal_cdf(F.when(root > 0, (sr - ref) * F.sqrt(n - 1) / F.sqrt(root)))


def expected_best(n: Column, trials: int) -> Column:
    """The Sharpe ratio to expect of the best of so many trials without skill."""
    inv = lambda p: normal_quantile(F.lit(p))
    return ((1 - EULER) * inv(1 - 1 / trials) + EULER * inv(1 - 1 / (trials * math.e))) / F.sqrt(n)


def deflated_sharpe(sr: Column, n: Column, trials: int, skew: Column, excess: Column) -> Column:
    return probabilistic_sharpe(sr, expected_best(n, trials), n, skew, excess)


def start_table(n: int, sims: int) -> np.ndarray:
    """Block starts of all simulations, drawn in their order from one generator: sims x blocks."""
    block = max(10, int(math.sqrt(n)))
    high = max(1, n - block)
    return np.random.default_rng(42).integers(0, high, (sims, -(-n // min(block, n))))


BANDS = (5, 25, 50, 75, 95)
STEPS = 64  # steps of all simulations that are one group when the bands are taken
SPAN = 4096  # places of a series that are one group when paths are made


def drawn(sizes: DataFrame, sims: int, together: int = 50) -> DataFrame:
    """(instrument_id, sim, block, start) of all simulations, drawn with one seed for each instrument; sizes: with n."""
    kind = sizes.schema[KEY].dataType.simpleString()

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, n in zip(frame[KEY], frame["n"], strict=True):
                starts = start_table(int(n), sims)
                for k in range(0, sims, together):
                    some = starts[k : k + together]
                    sim, block = (x.ravel() for x in np.indices(some.shape))
                    yield pd.DataFrame({KEY: key, "sim": sim + k, "block": block, "start": some.ravel()})

    return sizes.select(KEY, "n").mapInPandas(draw, f"{KEY} {kind}, sim long, block long, start long")


SUMS = ("_l", "_z", "_g")  # of the logarithms of the sizes of factors, of the zeros, of the negative ones


def _placed(rows: DataFrame, by: Column | None) -> DataFrame:
    """Rows with their place from 0, and the three sums up to each."""
    f = 1 + F.col("_r")
    parts = {"_l": F.when(f == 0, 0.0).otherwise(F.ln(F.abs(f))), "_z": (f == 0).cast("long"), "_g": (f < 0).cast("long")}
    if by is None:
        return rows.withColumn("_place", F.row_number().over(ordered()) - 1).withColumns({n: F.sum(c).over(sofar()) for n, c in parts.items()})
    numbered = with_leads(rows, by, 0).where(~F.col("_lead")).withColumn(KEY, F.col("_own")).drop("_own", "_chunk", "_lead")
    return running(numbered, by, **{n: ("sum", c) for n, c in parts.items()})


def _gathered(series: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Paths over one span of places: for each stretch of steps the values of those simulations that pass here then."""
    if not len(series) or not len(asked):
        return pd.DataFrame({KEY: [], "block": [], "part": [], "from": [], "width": [], "values": []})
    series = series.sort_values("_place")
    first, rows = int(series["_place"].iat[0]), []
    log, zeros, negatives = (series[c].to_numpy() for c in SUMS)
    for (block, part), some in asked.groupby(["block", "part"], sort=False):
        width = int(some["width"].iat[0])
        at = (some["place"].to_numpy() - first)[:, None] + np.arange(width)
        size, zero, negative = (x[at] + some[f"base{c}"].to_numpy()[:, None] for x, c in zip((log, zeros, negatives), SUMS, strict=True))
        with np.errstate(over="ignore"):
            values = np.where(zero > 0, 0.0, np.exp(size) * np.where(negative % 2 == 1, -1.0, 1.0))
        rows.append((asked[KEY].iat[0], block, part, int(some["from"].iat[0]), width, np.ascontiguousarray(values).tobytes()))
    return pd.DataFrame(rows, columns=[KEY, "block", "part", "from", "width", "values"])


def _bands(frame: pd.DataFrame) -> pd.DataFrame:
    """Linear percentiles of each step; null where one lies beyond the range of a double, or between such values."""
    width = int(frame["width"].iat[0])
    every = np.concatenate([np.frombuffer(v, dtype=np.float64).reshape(-1, width) for v in frame["values"]])
    with np.errstate(invalid="ignore", over="ignore"):
        found = np.percentile(every, BANDS, axis=0)
    found = np.where(np.isfinite(found), found, np.nan)
    return pd.DataFrame({KEY: frame[KEY].iat[0], "step": np.arange(width) + int(frame["from"].iat[0])} | {f"p{b}": v for b, v in zip(BANDS, found, strict=True)})


def monte_carlo(returns: DataFrame, sims: int = 1000, capital: float = CAPITAL, chunk: int = 50, x: str = "strategy_return", starts: DataFrame | None = None, by: Column | None = None) -> DataFrame:
    """(instrument_id, step, p5, p25, p50, p75, p95) of bootstrapped equity paths.

    A path is a row of blocks of the series, of about the root of its length. Products become sums of logarithms (signs and
    zeros are counted beside), so a path's value is what its earlier blocks come to, scanned over blocks, and a difference of
    two running sums of the series. Each stretch of STEPS steps of a path asks the span of SPAN places where it lies; the bands
    are taken over all paths of a stretch. No task holds a series or a path, whatever their length; a band beyond the range of
    a double is null.

    starts: (instrument_id, sim, block, start), by default drawn with one seed for each instrument, ``chunk`` simulations at a
    time; by: a chunk of a row's time, for series that are too long to be numbered in one task.
    """
    kind = returns.schema[KEY].dataType.simpleString()
    placed = _placed(returns.where(F.col(x).isNotNull()).select(KEY, TIME, F.col(x).cast("double").alias("_r")), by).select(KEY, "_place", *SUMS)
    sizes = placed.groupBy(KEY).agg(F.count("*").alias("n"))
    long = sizes.withColumn("size", F.least(F.greatest(F.lit(10), F.floor(F.sqrt("n"))), F.col("n")))
    blocks = (drawn(sizes, sims, chunk) if starts is None else starts.select(KEY, "sim", "block", "start")).join(long, KEY)
    # the sums before a block's start, and at its end
    for name, at in (("a", F.col("start") - 1), ("z", F.col("start") + F.col("size") - 1)):
        known = placed.select(F.col(KEY).alias("_of"), F.col("_place").alias("_at"), *(F.col(c).alias(f"{name}{c}") for c in SUMS))
        blocks = blocks.join(known, (F.col(KEY) == F.col("_of")) & (at == F.col("_at")), "left").drop("_of", "_at").fillna(0, [f"{name}{c}" for c in SUMS])
    before = Window.partitionBy(KEY, "sim").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = {"_l": math.log(capital), "_z": 0, "_g": 0}
    based = blocks.withColumns({f"base{c}": F.coalesce(F.sum(F.col(f"z{c}") - F.col(f"a{c}")).over(before), F.lit(0)) - F.col(f"a{c}") + start[c] for c in SUMS})
    width = F.least("size", F.col("n") - F.col("block") * F.col("size"))
    asked = (
        based.where(width > 0)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((width - 1) / STEPS))))
        .select(
            KEY, "block", "part", (F.col("block") * F.col("size") + F.col("part") * STEPS).alias("from"), F.least(F.lit(STEPS), width - F.col("part") * STEPS).alias("width"),
            (F.col("start") + F.col("part") * STEPS).alias("place"), *(f"base{c}" for c in SUMS),
        )
        .withColumn("span", F.floor(F.col("place") / SPAN))
    )
    # a span also has the places that a stretch from its end reaches into
    span = F.floor(F.col("_place") / SPAN)
    spans = placed.withColumn("span", F.explode(F.when((F.col("_place") % SPAN < STEPS) & (span > 0), F.array(span - 1, span)).otherwise(F.array(span))))
    made = spans.groupBy(KEY, "span").cogroup(asked.groupBy(KEY, "span")).applyInPandas(_gathered, f"{KEY} {kind}, block long, part long, `from` long, width int, values binary")
    return made.groupBy(KEY, "block", "part").applyInPandas(_bands, f"{KEY} {kind}, step long, " + ", ".join(f"p{b} double" for b in BANDS))
