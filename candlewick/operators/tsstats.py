"""Regressions and time-series tests: sums in Spark where sums are enough, numpy by group for the rest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.tails import f_upper, phi, t_two_sided
from candlewick.functions.windows import KEY, TIME, last, ratio

# Published response surfaces. By number of series: joint, polynomial below it, above it, ends.
P_VALUES = {
    1: (-1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), (-18.83, 2.74)),
    2: (-2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377), (-18.86, 0.92)),
}
CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}


def unit_root_p(tau: float, series: int = 1) -> float:
    joint, low, high, (least, most) = P_VALUES[series]
    if tau <= least:
        return 0.0
    if tau >= most:
        return 1.0
    return phi(sum(b * tau**k for k, b in enumerate(low if tau <= joint else high)))


def critical(n: int) -> dict[str, float]:
    return {k: sum(b / n**i for i, b in enumerate(bs)) for k, bs in CRITICAL.items()}


def _solve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and (X'X)^-1, by QR of columns of unit length.

    Where columns depend on each other the shortest coefficients are given.
    """
    length = np.sqrt((x * x).sum(axis=0))
    length[length == 0] = 1.0
    q, r = np.linalg.qr(x / length)
    if np.abs(np.diag(r)).min(initial=1.0) > 1e-12 and len(x) >= x.shape[1]:
        half = np.linalg.solve(r, np.eye(len(r)))
        b, inverse = half @ (q.T @ y), half @ half.T
    else:
        half = np.linalg.pinv(x / length)
        b, inverse = half @ y, half @ half.T
    b = b / length
    e = y - x @ b
    return b, float(e @ e), inverse / np.outer(length, length)


def adf(x: np.ndarray, constant: bool = True) -> tuple[float, int, int] | None:
    """(statistic, lags, rows): lags by AIC over one common sample, then a fit on all rows."""
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - (2 if constant else 1))
    if n < 6 or most < 0:
        return None
    d = np.diff(x)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        y = d[skip:]
        cols = [x[skip:-1], *(d[skip - k : len(d) - k] for k in range(1, lags + 1))]
        if constant:
            cols.append(np.ones(len(y)))
        return np.column_stack(cols), y

    def aic(lags: int) -> float:
        m, y = design(lags, most)
        _, rss, _ = _solve(m, y)
        k = len(y)
        return k * math.log(max(rss, 1e-300) / k) + 2 * m.shape[1]

    lags = min(range(most + 1), key=aic)
    m, y = design(lags, lags)
    b, rss, inverse = _solve(m, y)
    free = len(y) - m.shape[1]
    se = math.sqrt(max(rss, 0.0) / free * inverse[0, 0]) if free > 0 else 0.0
    return (float(b[0] / se) if se > 0 else -math.inf), lags, len(y)


def adf_test(df: DataFrame, x: str = "close") -> DataFrame:
    """One row an instrument: statistic, p-value, lags, whether stationary at 5 %, and critical values."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values(TIME, kind="stable")[x].dropna().to_numpy(dtype=float)
        got = adf(values)
        if got is None:
            return pd.DataFrame([{KEY: frame[KEY].iat[0]}])
        tau, lags, rows = got
        p, c = unit_root_p(tau), critical(rows)
        return pd.DataFrame([{KEY: frame[KEY].iat[0], "stat": tau, "p_value": p, "lags": lags, "stationary": p < 0.05, "crit_1": c["1%"], "crit_5": c["5%"], "crit_10": c["10%"]}])

    kind = df.schema[KEY].dataType.simpleString()
    names = ["stat", "p_value", "lags", "stationary", "crit_1", "crit_5", "crit_10"]

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        return run(frame).reindex(columns=[KEY, *names])

    return df.groupBy(KEY).applyInPandas(whole, f"{KEY} {kind}, stat double, p_value double, lags int, stationary boolean, crit_1 double, crit_5 double, crit_10 double")


def granger(both: DataFrame, most: int = 5) -> DataFrame:
    """(instrument_id, lag, f_stat, p_value): do lags of b help to explain a beyond a's own?"""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME, kind="stable")
        y, x = frame["a"].to_numpy(dtype=float), frame["b"].to_numpy(dtype=float)
        out = []
        for k in range(1, most + 1):
            n = len(y) - k
            if n <= 2 * k + 1:
                continue
            own = [y[k - i : len(y) - i] for i in range(1, k + 1)] + [np.ones(n)]
            other = [x[k - i : len(x) - i] for i in range(1, k + 1)]
            r0, r1 = _solve(np.column_stack(own), y[k:])[1], _solve(np.column_stack(own + other), y[k:])[1]
            free = n - 2 * k - 1
            f = (r0 - r1) / k / (r1 / free) if r1 > 0 else math.inf
            out.append({KEY: frame[KEY].iat[0], "lag": k, "f_stat": f, "p_value": f_upper(f, k, free) if math.isfinite(f) else 0.0})
        return pd.DataFrame(out, columns=[KEY, "lag", "f_stat", "p_value"])

    return both.groupBy(KEY).applyInPandas(run, f"{KEY} {both.schema[KEY].dataType.simpleString()}, lag int, f_stat double, p_value double")


def cointegration(both: DataFrame) -> DataFrame:
    """(instrument_id, stat, p_value, cointegrated): a unit-root test on what a leaves when b explains it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME, kind="stable")
        a, b = frame["a"].to_numpy(dtype=float), frame["b"].to_numpy(dtype=float)
        m = np.column_stack([b, np.ones(len(b))])
        coef, rss, _ = _solve(m, a)
        if rss <= 1e-10 * float(((a - a.mean()) ** 2).sum()):
            tau = -math.inf
        else:
            got = adf(a - m @ coef, constant=False)
            tau = got[0] if got else math.nan
        p = unit_root_p(tau, 2) if not math.isnan(tau) else None
        return pd.DataFrame([{KEY: frame[KEY].iat[0], "stat": tau, "p_value": p, "cointegrated": p is not None and p < 0.05}])

    return both.groupBy(KEY).applyInPandas(run, f"{KEY} {both.schema[KEY].dataType.simpleString()}, stat double, p_value double, cointegrated boolean")


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(instrument_id, term, coef, t_stat, p_value, r2, adj_r2, n): least squares with a constant.

    Only sums leave the rows: means first, then products of deviations from them, so levels far from zero cost no
    digits; the small systems are solved by group. Too few rows give no row.
    """
    k = len(xs)
    names = [*xs, y]
    rows = df.where(F.expr(" and ".join(f"`{c}` is not null" for c in names))).select(KEY, *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)))
    means = rows.groupBy(KEY).agg(F.count("*").alias("n"), *(F.avg(f"_v{i}").alias(f"_m{i}") for i in range(k + 1))).where(F.col("n") >= k + 2)
    off = rows.join(means, KEY)
    d = [F.col(f"_v{i}") - F.col(f"_m{i}") for i in range(k + 1)]
    sums = off.groupBy(KEY).agg(
        F.first("n").alias("n"),
        F.array(*(F.first(f"_m{i}") for i in range(k + 1))).alias("means"),
        F.array(*(F.sum(a * b) for a in d for b in d)).alias("products"),
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.itertuples():
            m, mean = np.array(r.products).reshape(k + 1, k + 1), np.array(r.means)
            xx, xy, tss = m[:k, :k], m[:k, k], m[k, k]
            scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
            inverse = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale)
            b = inverse @ xy
            rss, free = max(tss - 2 * b @ xy + b @ xx @ b, 0.0), r.n - k - 1
            coef = [*b, mean[k] - b @ mean[:k]]
            spread = [*np.diag(inverse), 1 / r.n + mean[:k] @ inverse @ mean[:k]]
            r2 = 1 - rss / tss if tss > 0 else None
            for name, c, v in zip([*xs, "const"], coef, spread, strict=True):
                se = math.sqrt(rss / free * max(v, 0.0))
                t = c / se if se > 0 else None
                out.append({KEY: getattr(r, KEY), "term": name, "coef": c, "t_stat": t, "p_value": t_two_sided(t, free) if t is not None else None, "r2": r2, "adj_r2": 1 - (1 - r2) * (r.n - 1) / free if r2 is not None else None, "n": r.n})
        return pd.DataFrame(out, columns=[KEY, "term", "coef", "t_stat", "p_value", "r2", "adj_r2", "n"])

    return sums.groupBy(KEY).applyInPandas(run, f"{KEY} {df.schema[KEY].dataType.simpleString()}, term string, coef double, t_stat double, p_value double, r2 double, adj_r2 double, n long")


def residuals(df: DataFrame, fit: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """df with ``residual``, the fit's coefficients joined back."""
    wide = fit.groupBy(KEY).pivot("term", [*xs, "const"]).agg(F.first("coef"))
    wide = wide.select(KEY, *(F.col(c).alias(f"_b_{c}") for c in [*xs, "const"]))
    guess = sum((F.col(c) * F.col(f"_b_{c}") for c in xs), F.col("_b_const"))
    return df.join(wide, KEY).withColumn("residual", F.col(y) - guess).drop(*(f"_b_{c}" for c in [*xs, "const"]))


def rolling_beta(both: DataFrame, p: int = 60) -> DataFrame:
    """Sample covariance over population variance, as this measure is defined."""
    whole = F.count(F.col("a") + F.col("b")).over(last(p)) == p
    return both.withColumn("beta", F.when(whole, ratio(F.covar_samp("a", "b").over(last(p)), F.var_pop("b").over(last(p)))))
