"""Returns, risk, transforms and volume features, by instrument."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from candlewick.functions.windows import KEY, TIME, chunked, corr, last, ordered, prev, ratio, roll, running, sofar
from candlewick.operators.bars import pair

YEAR = 252


def simple_returns(df: DataFrame, x: str = "close", out: str = "ret") -> DataFrame:
    return df.withColumn(out, ratio(F.col(x), prev(x)) - 1)


def log_returns(df: DataFrame, x: str = "close", out: str = "log_ret") -> DataFrame:
    return df.withColumn(out, F.ln(ratio(F.col(x), prev(x))))


def horizons(df: DataFrame, periods: tuple[int, ...] = (1, 5, 21, 63, 252)) -> DataFrame:
    return df.withColumns({f"ret_{p}d": ratio(F.col("close"), prev("close", p)) - 1 for p in periods})


def cumulative(df: DataFrame) -> DataFrame:
    """The product of 1 + return from the second row on, less 1; null on the first."""
    got = simple_returns(df, out="_r")
    return got.withColumn("cum_ret", F.when(F.col("_r").isNotNull(), F.product(1 + F.col("_r")).over(sofar()) - 1)).drop("_r")


def rolling_vol(df: DataFrame, p: int = 20, periods: int = YEAR, out: str = "vol") -> DataFrame:
    got = log_returns(df, out="_r")
    return got.withColumn(out, roll(F.stddev_samp, "_r", p) * F.sqrt(F.lit(float(periods)))).drop("_r")


def drawdown(df: DataFrame, x: str = "close", out: str = "drawdown") -> DataFrame:
    top = F.max(x).over(sofar())
    return df.withColumn(out, ratio(F.col(x) - top, top))


def drawdown_chunked(df: DataFrame, chunk: Column, x: str = "close", out: str = "drawdown") -> DataFrame:
    """The same for series too long for one task."""
    return running(df, chunk, _top=("max", F.col(x))).withColumn(out, ratio(F.col(x) - F.col("_top"), F.col("_top"))).drop("_top")


def max_drawdown(df: DataFrame) -> DataFrame:
    return drawdown(df).groupBy(KEY).agg(F.min("drawdown").alias("max_drawdown"))


def sharpe(df: DataFrame, rf: float = 0.0, periods: int = YEAR) -> DataFrame:
    """0 where returns don't vary."""
    e = F.col("log_ret") - rf / periods
    mean, sd = F.avg(e), F.stddev_samp(e)
    return log_returns(df).groupBy(KEY).agg(F.when(sd == 0, 0.0).otherwise(ratio(mean, sd) * F.sqrt(F.lit(float(periods)))).alias("sharpe"))


def sortino(df: DataFrame, rf: float = 0.0, periods: int = YEAR) -> DataFrame:
    """Against the sample deviation of the negative returns; null with fewer than two of them."""
    e = F.col("log_ret") - rf / periods
    down = F.stddev_samp(F.when(e < 0, e))
    return log_returns(df).groupBy(KEY).agg(F.when(down == 0, 0.0).otherwise(ratio(F.avg(e), down) * F.sqrt(F.lit(float(periods)))).alias("sortino"))


def beta(df: DataFrame, bench: DataFrame) -> DataFrame:
    """Slope of log returns on the benchmark's; returns come before the alignment."""
    both = pair(log_returns(df), log_returns(bench), "log_ret")
    return both.groupBy(KEY).agg(F.when(F.count("*") >= 2, ratio(F.covar_samp("a", "b"), F.var_samp("b"))).alias("beta"))


def _ranks(df: DataFrame, *by: str) -> DataFrame:
    """Average ranks of a and b among each pair's rows."""
    for x in ("a", "b"):
        w = Window.partitionBy(*by).orderBy(x)
        ties = Window.partitionBy(*by, x)
        df = df.withColumn(f"_{x}", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)
    return df.select(*by, F.col("_a").alias("a"), F.col("_b").alias("b"))


def _swaps(x: np.ndarray) -> int:
    """Pairs that stand in falling order, counted by a merge sort from the bottom up."""
    n, swaps, width = len(x), 0, 1
    x = x.copy()
    while width < n:
        for a in range(0, n - width, 2 * width):
            left, right = x[a : a + width], x[a + width : a + 2 * width]
            at = np.searchsorted(left, right, side="right")
            swaps += int((len(left) - at).sum())
            x[a : a + 2 * width] = np.sort(x[a : a + 2 * width], kind="stable")
        width *= 2
    return swaps


def _tied(*columns: np.ndarray) -> int:
    """Pairs of rows that are equal in all columns."""
    _, n = np.unique(np.column_stack(columns), axis=0, return_counts=True)
    return int((n * (n - 1) // 2).sum())


def kendall(a: np.ndarray, b: np.ndarray) -> float | None:
    """Tau-b, in n log n: sorted by a, the pairs that b has in falling order are the discordant ones."""
    n = len(a)
    order = np.lexsort((b, a))
    tie_a, tie_b, tie_both = _tied(a), _tied(b), _tied(a, b)
    pairs = n * (n - 1) // 2
    low = ((pairs - tie_a) * (pairs - tie_b)) ** 0.5
    return (pairs - tie_a - tie_b + tie_both - 2 * _swaps(b[order])) / low if low else None


def correlations(df: DataFrame, method: str = "pearson", x: str = "close") -> DataFrame:
    """(left, right, corr) for each pair of instruments left < right, over the times both have."""
    a, b = df.select(F.col(KEY).alias("left"), TIME, F.col(x).alias("a")), df.select(F.col(KEY).alias("right"), TIME, F.col(x).alias("b"))
    both = a.join(b, TIME).where("left < right and a is not null and b is not null")
    if method == "kendall":

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"left": frame["left"].iloc[:1], "right": frame["right"].iloc[:1], "corr": [kendall(frame["a"].to_numpy(), frame["b"].to_numpy())]})

        kind = df.schema[KEY].dataType.simpleString()
        return both.groupBy("left", "right").applyInPandas(run, f"left {kind}, right {kind}, corr double")
    if method == "spearman":
        both = _ranks(both, "left", "right")
    return both.groupBy("left", "right").agg(corr("a", "b").alias("corr"))


SLICE = 4096  # times that are multiplied together


def _pair_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of all pairs of one group's instruments over the times that both have: products of matrices, times by instruments."""
    i, j = int(frame["_i"].iat[0]), int(frame["_j"].iat[0])
    block = frame["_block"].to_numpy()
    ids, who = np.unique(frame[KEY].to_numpy(), return_inverse=True)
    _, when = np.unique(frame[TIME].to_numpy(), return_inverse=True)
    of_block = np.zeros(len(ids), dtype=np.int64)
    of_block[who] = block
    one, other = np.flatnonzero(of_block == i), np.flatnonzero(of_block == j)
    order = np.argsort(when, kind="stable")
    who, when, value = who[order], when[order], frame["_v"].to_numpy()[order]
    total = np.zeros((6, len(one), len(other)))
    for start in range(0, int(when[-1]) + 1, SLICE):
        a, z = np.searchsorted(when, [start, start + SLICE])
        known, v = np.zeros((2, SLICE, len(ids)))
        known[when[a:z] - start, who[a:z]] = 1.0
        v[when[a:z] - start, who[a:z]] = value[a:z]
        (p, x), (q, y) = (known[:, one], v[:, one]), (known[:, other], v[:, other])
        total += np.stack([p.T @ q, x.T @ q, p.T @ y, (x * x).T @ q, p.T @ (y * y), x.T @ y])
    left, right = np.nonzero((total[0] > 0) & ((i != j) | (one[:, None] < other[None, :])))
    n, sx, sy, sxx, syy, sxy = total[:, left, right]
    a, b = one[left], other[right]
    turn = a > b  # ids are in order, so their places are too
    pick = lambda p, q: np.where(turn, q, p)
    return pd.DataFrame({"left": ids[pick(a, b)], "right": ids[pick(b, a)], "n": n.astype(np.int64), "sx": pick(sx, sy), "sy": pick(sy, sx), "sxx": pick(sxx, syy), "syy": pick(syy, sxx), "sxy": sxy})


def correlations_blocked(df: DataFrame, chunk: Column, x: str = "close", size: int = 256) -> DataFrame:
    """Pearson's correlations as :func:`correlations` gives them, for many instruments: instruments fall into blocks of about
    ``size``, and a group is a pair of blocks in a chunk of time. A value goes to as many groups as there are blocks, and sums of
    pairs leave a group once, in place of a row for each pair and time."""
    known = df.where(F.col(x).isNotNull()).select(KEY, TIME, F.col(x).cast("double").alias("_x"), chunk.alias("_chunk"))
    least = known.groupBy(KEY).agg(F.min("_x").alias("_least"))  # levels are held against it: a flat series is zero
    blocks = -(-least.count() // size) or 1
    rows = known.join(least, KEY).select(KEY, TIME, "_chunk", (F.col("_x") - F.col("_least")).alias("_v"), F.pmod(F.xxhash64(KEY), F.lit(blocks)).cast("int").alias("_block"))
    dealt = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")})
    kind = df.schema[KEY].dataType.simpleString()
    sums = dealt.drop("_other").groupBy("_i", "_j", "_chunk").applyInPandas(_pair_sums, f"left {kind}, right {kind}, n long, sx double, sy double, sxx double, syy double, sxy double")
    one = sums.groupBy("left", "right").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))

    def spread(square: str, total: str) -> Column:
        v = F.col(square) - F.col(total) * F.col(total) / F.col("n")
        return F.when(v > 1e-13 * F.col(square), v)  # of equal values rounding is left

    together = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    return one.select("left", "right", ratio(together, F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy"))).alias("corr"))


def rolling_correlation(both: DataFrame, p: int = 60) -> DataFrame:
    whole = F.count(F.col("a") + F.col("b")).over(last(p)) == p
    return both.withColumn("corr", F.when(whole, corr("a", "b", last(p))))


def lead_lag(both: DataFrame, most: int = 20) -> DataFrame:
    """(instrument_id, lag, corr) of a with b that many rows later; a null inside makes its lag null."""
    lags = range(-most, most + 1)
    later = [F.lead("b", k).over(ordered()) if k >= 0 else F.lag("b", -k).over(ordered()) for k in lags]
    pairs = both.select(KEY, "a", *(c.alias(f"_b{i}") for i, c in enumerate(later)))
    # one row a lag, summed before the shuffle
    rows = pairs.select(KEY, "a", F.posexplode(F.array(*(f"_b{i}" for i in range(len(later))))).alias("_i", "b"))
    got = rows.groupBy(KEY, (F.col("_i") - most).alias("lag")).agg(F.count("*").alias("_n"), F.count(F.col("a") + F.col("b")).alias("_both"), corr("a", "b").alias("corr"))
    return got.select(KEY, "lag", F.when(F.col("_both") == F.col("_n") - F.abs("lag"), F.col("corr")).alias("corr"))


def volume_zscore(df: DataFrame, p: int = 20) -> DataFrame:
    return df.withColumn("volume_z", ratio(F.col("volume") - roll(F.avg, "volume", p), roll(F.stddev_samp, "volume", p)))


def divergence(df: DataFrame, p: int = 20) -> DataFrame:
    """Change of price less change of volume over p rows."""
    change = lambda c: ratio(F.col(c), prev(c, p)) - 1
    return df.withColumn("divergence", change("close") - change("volume"))


def confirmed_move(df: DataFrame, p: int = 20) -> DataFrame:
    """1 and -1 for rises and other moves on a volume above its rolling median, else 0."""
    median = roll(lambda c: F.percentile(c, F.lit(0.5)), "volume", p)
    up = F.coalesce(F.col("close") > prev("close"), F.lit(False))
    return df.withColumn("_m", median).withColumn("confirmed", F.when(F.col("volume") > F.col("_m"), F.when(up, 1).otherwise(-1)).otherwise(0)).drop("_m")


def dollar_volume(df: DataFrame, p: int = 20) -> DataFrame:
    return df.withColumn("dollar_volume", roll(F.avg, F.col("close") * F.col("volume"), p))


def zscore(df: DataFrame, x: str = "close", p: int = 0) -> DataFrame:
    """Over p rows, or with 0 over the whole series."""
    if p:
        return df.withColumn("z", ratio(F.col(x) - roll(F.avg, x, p), roll(F.stddev_samp, x, p)))
    w = Window.partitionBy(KEY)
    return df.withColumn("z", ratio(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def rank_in(values: Column, p: int) -> Column:
    """Place of an array's last value among the other p - 1, from 0 to 1; null if any is missing."""
    newest = F.element_at(values, -1)
    others = F.slice(values, 1, p - 1)
    below = F.size(F.filter(others, lambda v: v < newest))
    upto = F.size(F.filter(others, lambda v: v <= newest))
    tie = F.when(upto > below, 1).otherwise(0)
    return F.when(F.size(values) == p, (below + upto + tie) * 50.0 / (p - 1) / 100)


def percentile_rank(df: DataFrame, x: str = "close", p: int = 252) -> DataFrame:
    """collect_list leaves nulls out, so a window with one is too short and gives null."""
    got = df.withColumn("_a", F.collect_list(x).over(last(p)))
    return got.withColumn("pct_rank", rank_in(F.col("_a"), p)).drop("_a")


def percentile_rank_chunked(df: DataFrame, chunk: Column, x: str = "close", p: int = 252) -> DataFrame:
    """The same for long series and wide windows: by chunks of time, each led by p - 1 rows. The window's values are kept in
    order, so a row costs two searches, one value more and one less, and no array of p values."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME, kind="stable").reset_index(drop=True)
        values = frame[x].astype(float).tolist()
        held: list[float] = []  # those of the p - 1 rows before that are known
        ranks: list[float | None] = []
        for i, v in enumerate(values):
            if i >= p and not math.isnan(old := values[i - p]):
                del held[bisect_left(held, old)]
            known = not math.isnan(v)
            if known and len(held) == p - 1:
                below, upto = bisect_left(held, v), bisect_right(held, v)
                ranks.append((below + upto + (upto > below)) * 50.0 / (p - 1) / 100)
            else:
                ranks.append(None)
            if known:
                insort(held, v)
        frame["pct_rank"] = pd.Series(ranks, dtype=float)
        return frame

    def ranked(led: DataFrame) -> DataFrame:
        return led.groupBy(KEY).applyInPandas(run, T.StructType([*led.schema.fields, T.StructField("pct_rank", T.DoubleType())]))

    got = chunked(df, ranked, chunk, p - 1)
    return got.withColumn("pct_rank", F.when(~F.isnan("pct_rank"), F.col("pct_rank")))


def change_over(df: DataFrame, x: str, k: int, out: str) -> DataFrame:
    """Change over k rows, with gaps filled forward first."""
    filled = df.withColumn("_f", F.last(x, ignorenulls=True).over(sofar()))
    return filled.withColumn(out, ratio(F.col("_f"), prev("_f", k)) - 1).drop("_f")
