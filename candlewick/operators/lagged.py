"""Unit-root, cointegration and causality tests of long series, from products of a series with its own lags.

The regressions of these tests differ in their lags and in their first rows only, so one matrix holds them all: the products
of all columns, summed over the rows that have the most lags. Spark sums it over chunks of time, each led by as many rows of the
chunk before as there are lags, so no task holds a series. What is left for an instrument is that matrix and the series' first
rows. Sweeping the matrix column by column gives the residual sums of all shorter regressions in turn; the first rows are added
for those that use them.

Levels are held against the series' mean first where a constant takes it up, and columns are scaled, so that little is lost to
rounding. Columns that depend on others (of flat series, say) are left out. Too few rows give nulls or no rows, as the tests in
:mod:`candlewick.operators.tsstats`, which these equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.tails import f_upper
from candlewick.functions.windows import KEY, TIME, ratio, with_leads
from candlewick.operators.tsstats import critical, unit_root_p

BLOCK = 4096  # rows whose columns are written out at a time
DEPENDENT = 1e-12  # of a scaled column, what others must leave of it

#: Rows (of a series of one or more values, led by enough others) and lags to columns, what is explained last.
Design = Callable[[np.ndarray, int], np.ndarray]


def adf_design(constant: bool) -> Design:
    """x before, a constant, ``lags`` changes before, and the change; for rows from ``lags`` + 1 on."""

    def design(values: np.ndarray, lags: int) -> np.ndarray:
        x = values[:, 0]
        d = np.diff(x)
        n = len(d) - lags
        cols = [x[lags:-1], *([np.ones(n)] if constant else []), *(d[lags - k : len(d) - k] for k in range(1, lags + 1)), d[lags:]]
        return np.column_stack(cols)

    return design


def granger_design(values: np.ndarray, lags: int) -> np.ndarray:
    """A constant, ``lags`` values of a and as many of b before, and a; for rows from ``lags`` on."""
    a, b = values.T
    n = len(a) - lags
    return np.column_stack([np.ones(n), *(a[lags - k : len(a) - k] for k in range(1, lags + 1)), *(b[lags - k : len(b) - k] for k in range(1, lags + 1)), a[lags:]])


def _products(design: Design, names: list[str], more: int):
    """Products of all columns over a chunk's own rows that have the most lags; more: rows needed besides the lags."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME, kind="stable")
        lags, values, lead = int(frame["_lags"].iat[0]), frame[names].to_numpy(dtype=float), int(frame["_lead"].sum())
        first, total = max(lead, lags + more), 0.0
        for start in range(first, len(values), BLOCK):
            m = design(values[start - lags - more : start + BLOCK], lags)
            total = total + m.T @ m
        rows = [] if isinstance(total, float) else [(frame["_own"].iat[0], total[np.triu_indices(len(total))])]
        return pd.DataFrame(rows, columns=["_own", "products"])

    return run


def gathered(rows: DataFrame, names: list[str], design: Design, more: int, chunk: Column) -> DataFrame:
    """One row an instrument: n, its lags, the upper half of the matrix (null with too few rows), and the series' first rows.

    rows: with the columns names, without nulls, and ``_lags`` and ``n``, equal for an instrument.
    """
    kind = rows.schema[KEY].dataType.simpleString()
    sizes = rows.groupBy(KEY).agg(F.first("n").alias("n"), F.first("_lags").alias("lags"))
    back = (sizes.agg(F.max("lags")).first()[0] or 0) + more
    led = with_leads(rows.select(KEY, TIME, *names, "_lags"), chunk, back)
    parts = led.where("_lags >= 0").groupBy(KEY).applyInPandas(_products(design, names, more), f"_own {kind}, products array<double>")
    summed = parts.select("_own", F.posexplode("products").alias("at", "v")).groupBy("_own", "at").agg(F.sum("v").alias("v"))
    matrix = summed.groupBy("_own").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("products"))
    first = led.where(~F.col("_lead") & (F.col("_place") < F.col("_lags") + more))
    head = first.groupBy("_own").agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", F.array(*(F.col(c).cast("double") for c in names)).alias("v")))), lambda p: p["v"]).alias("head"))
    return sizes.join(matrix.withColumnRenamed("_own", KEY), KEY, "left").join(head.withColumnRenamed("_own", KEY), KEY, "left")


def _square(products) -> np.ndarray:
    size = int((math.isqrt(8 * len(products) + 1) - 1) // 2)
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = products
    return m + np.triu(m, 1).T


def swept(m: np.ndarray) -> list[float]:
    """Sums of squares of the last column that the first k others leave, for k from 0 to all of them."""
    scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
    m = m / np.outer(scale, scale)
    out = [m[-1, -1]]
    for j in range(len(m) - 1):
        if m[j, j] > DEPENDENT:
            m = m - np.outer(m[:, j], m[j]) / m[j, j]
        out.append(m[-1, -1])
    return [max(v, 0.0) * scale[-1] ** 2 for v in out]


def _part(m: np.ndarray, columns: list[int], more: np.ndarray) -> np.ndarray:
    """The matrix of some columns, with the rows ``more`` of these columns added."""
    return m[np.ix_(columns, columns)] + more.T @ more


def adf_from(m: np.ndarray, head: np.ndarray, n: int, most: int, constant: bool, lags: int | None) -> tuple[float, int, int]:
    """(statistic, lags, rows) from the matrix of the most lags and the first rows; lags: those stated, else by AIC."""
    own, design = 2 if constant else 1, adf_design(constant)
    if lags is None:
        rows, left = n - 1 - most, swept(m)
        lags = min(range(most + 1), key=lambda p: rows * math.log(max(left[own + p], 1e-300) / rows) + 2 * (own + p))
    columns = [*range(own + lags), own + most]
    whole = _part(m, columns, design(head[: most + 1], lags) if lags < most else np.zeros((0, len(columns))))
    rows, free = n - 1 - lags, n - 1 - lags - own - lags
    scale = np.sqrt(np.where(np.diag(whole) > 0, np.diag(whole), 1.0))
    scaled = whole / np.outer(scale, scale)
    inverse = np.linalg.pinv(scaled[:-1, :-1], rcond=DEPENDENT, hermitian=True)
    b = inverse @ scaled[:-1, -1]
    rss = swept(whole)[-1]
    # the coefficient's own scale falls out of the ratio, but for that of what is explained
    se = math.sqrt(rss / free * max(inverse[0, 0], 0.0)) if free > 0 else 0.0
    return (float(b[0] * scale[-1] / se) if se > 0 else -math.inf), lags, rows


def _levels(df: DataFrame, x: str, constant: bool, lags: int | None) -> DataFrame:
    """x less its mean where there is a constant, with n and the most lags (negative with too few rows)."""
    rows = df.where(F.col(x).isNotNull()).select(KEY, TIME, F.col(x).cast("double").alias("x"))
    sizes = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.avg("x").alias("_m"))
    most = F.least(F.ceil(12 * F.pow(F.col("n") / 100, 0.25)), F.floor(F.col("n") / 2) - (2 if constant else 1)) if lags is None else F.when(F.col("n") > 2 * lags + 3, lags).otherwise(-1)
    sizes = sizes.withColumn("_lags", F.when(F.col("n") < 6, -1).otherwise(most).cast("int"))
    return rows.join(sizes, KEY).withColumn("x", F.col("x") - (F.col("_m") if constant else F.lit(0.0))).drop("_m")


def _statistics(df: DataFrame, x: str, chunk: Column, constant: bool, lags: int | None) -> DataFrame:
    """(instrument_id, stat, lags, rows)"""
    kind = df.schema[KEY].dataType.simpleString()
    found = gathered(_levels(df, x, constant, lags), ["x"], adf_design(constant), 1, chunk)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, n, most, products, head in zip(*(frame[c] for c in (KEY, "n", "lags", "products", "head")), strict=True):
                got = (None, None, None)
                if products is not None:
                    got = adf_from(_square(products), np.array([list(v) for v in head]).reshape(-1, 1), int(n), int(most), constant, lags)
                out.append((key, *got))
            yield pd.DataFrame(out, columns=[KEY, "stat", "lags", "rows"]).astype({"stat": float, "lags": "Int32", "rows": "Int64"})

    return found.mapInPandas(run, f"{KEY} {kind}, stat double, lags int, rows long")


def _with_p(df: DataFrame, series: int, alias: str) -> DataFrame:
    """p-value, whether below 5 %, and the critical values of one row an instrument."""

    @F.pandas_udf("double")
    def p_of(stat: pd.Series) -> pd.Series:
        return stat.map(lambda t: None if pd.isna(t) else unit_root_p(t, series))

    @F.pandas_udf("c1 double, c5 double, c10 double")
    def levels(rows: pd.Series) -> pd.DataFrame:
        found = [dict.fromkeys(("1%", "5%", "10%")) if pd.isna(n) else critical(int(n)) for n in rows]
        return pd.DataFrame({"c1": [c["1%"] for c in found], "c5": [c["5%"] for c in found], "c10": [c["10%"] for c in found]}, dtype=float)

    got = df.withColumn("p_value", p_of("stat")).withColumn(alias, F.col("p_value") < 0.05).withColumn("_c", levels("rows"))
    return got.withColumns({f"crit_{k}": F.col(f"_c.c{k}") for k in (1, 5, 10)}).drop("_c", "rows")


def adf_test(df: DataFrame, chunk: Column, x: str = "close", lags: int | None = None) -> DataFrame:
    """One row an instrument: statistic, p-value, lags, whether stationary at 5 %, and critical values; chunk: of a row's time,
    lags: as many, where AIC isn't to choose."""
    stats = df.select(KEY).distinct().join(_statistics(df, x, chunk, True, lags), KEY, "left")  # also of those without a value
    got = _with_p(stats, 1, "stationary")
    return got.select(KEY, "stat", "p_value", "lags", "stationary", "crit_1", "crit_5", "crit_10")


def cointegration(both: DataFrame, chunk: Column, lags: int | None = None) -> DataFrame:
    """(instrument_id, stat, p_value, cointegrated): a unit-root test without a constant on what a leaves when b explains it."""
    rows = both.where("a is not null and b is not null").select(KEY, TIME, F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    means = rows.groupBy(KEY).agg(F.avg("a").alias("_ma"), F.avg("b").alias("_mb"))
    off = rows.join(means, KEY).select(KEY, TIME, (F.col("a") - F.col("_ma")).alias("a"), (F.col("b") - F.col("_mb")).alias("b"))
    fit = off.groupBy(KEY).agg(F.coalesce(ratio(F.sum(F.col("a") * F.col("b")), F.sum(F.col("b") * F.col("b"))), F.lit(0.0)).alias("_s"), F.sum(F.col("a") * F.col("a")).alias("_tss"))
    left = off.join(fit, KEY).withColumn("x", F.col("a") - F.col("_s") * F.col("b"))
    stats = _statistics(left, "x", chunk, False, lags)
    # a perfect fit leaves rounding only, and no test of that
    perfect = left.groupBy(KEY).agg((F.sum(F.col("x") * F.col("x")) <= 1e-10 * F.first("_tss")).alias("_perfect"))
    stats = stats.join(perfect, KEY).withColumn("stat", F.when(F.col("_perfect"), F.lit(-math.inf)).otherwise(F.col("stat"))).drop("_perfect")
    return _with_p(stats, 2, "cointegrated").select(KEY, "stat", "p_value", F.coalesce("cointegrated", F.lit(False)).alias("cointegrated"))


def granger(both: DataFrame, chunk: Column, most: int = 5) -> DataFrame:
    """(instrument_id, lag, f_stat, p_value): do lags of b help to explain a beyond a's own?"""
    kind = both.schema[KEY].dataType.simpleString()
    rows = both.where("a is not null and b is not null").select(KEY, TIME, F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    sizes = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.avg("a").alias("_ma"), F.avg("b").alias("_mb"))
    # k lags want more than 2 k + 1 rows behind them
    sizes = sizes.withColumn("_lags", F.least(F.lit(most), F.floor((F.col("n") - 2) / 3)).cast("int"))
    off = rows.join(sizes, KEY).where("_lags >= 1").withColumns({"a": F.col("a") - F.col("_ma"), "b": F.col("b") - F.col("_mb")}).drop("_ma", "_mb")
    found = gathered(off, ["a", "b"], granger_design, 0, chunk)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, n, top, products, head in zip(*(frame[c] for c in (KEY, "n", "lags", "products", "head")), strict=True):
                m, first, n, top = _square(products), np.array([list(v) for v in head]), int(n), int(top)
                for k in range(1, top + 1):
                    columns = [*range(k + 1), *range(1 + top, 1 + top + k), 2 * top + 1]
                    left = swept(_part(m, columns, granger_design(first[:top], k) if k < top else np.zeros((0, len(columns)))))
                    r0, r1, free = left[k + 1], left[2 * k + 1], n - k - 2 * k - 1
                    f = (r0 - r1) / k / (r1 / free) if r1 > 0 else math.inf
                    out.append((key, k, f, f_upper(f, k, free) if math.isfinite(f) else 0.0))
            yield pd.DataFrame(out, columns=[KEY, "lag", "f_stat", "p_value"])

    return found.mapInPandas(run, f"{KEY} {kind}, lag int, f_stat double, p_value double")
