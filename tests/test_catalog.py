import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.jobs import catalog
from candlewick.operators import validation

from tests.conftest import SF


def test_monte_carlo_query_has_a_thousand_paths(spark):
    returns = catalog._run(spark, SF).where("strategy_return is not null")
    one, n = returns.groupBy("instrument_id").count().orderBy(F.desc("count"), "instrument_id").first()
    r = np.array([x.strategy_return for x in returns.where(F.col("instrument_id") == one).orderBy("ts").collect()])
    block = min(max(10, int(np.sqrt(n))), n)
    at = (validation.start_table(n, 1000)[:, :, None] + np.arange(block)).reshape(1000, -1)[:, :n]
    want = np.percentile(validation.CAPITAL * np.cumprod(1 + r[at], axis=1), [5, 25, 50, 75, 95], axis=0).T
    got = catalog.queries()["b10_monte_carlo"](spark, SF).where(F.col("instrument_id") == one).orderBy("step").collect()
    assert np.array([x[2:] for x in got]) == pytest.approx(want, rel=1e-9, abs=0.006)


def test_lead_lag_has_all_lags_of_the_default(spark):
    pair = catalog._pair(spark, SF).where("a is not null and b is not null").orderBy("instrument_id", "ts").toPandas()
    one = pair["instrument_id"].max()
    a, b = (pair.loc[pair["instrument_id"] == one, c].to_numpy() for c in "ab")
    got = {r.lag: r["corr"] for r in catalog.queries()["t13_lead_lag_full"](spark, SF).where(F.col("instrument_id") == int(one)).collect()}
    n = len(a)
    want = {k: np.corrcoef(a[max(0, -k) : n - max(0, k)], b[max(0, k) : n + min(0, k)])[0, 1] for k in range(-20, 21)}
    assert got == pytest.approx(want, abs=2e-6)


def test_percentile_rank_has_the_window_of_the_default(spark):
    bars = catalog.f.daily_bars(spark, SF)
    one = bars.agg(F.max("instrument_id")).first()[0]
    close = np.array([r.close for r in bars.where(F.col("instrument_id") == one).orderBy("ts").collect()])
    got = [r.pct_rank for r in catalog.queries()["t19_percentile_rank_full"](spark, SF).where(F.col("instrument_id") == one).orderBy("ts").collect()]
    assert len(close) > 252 and got[:251] == [None] * 251
    for i in range(251, len(close)):
        rest = close[i - 251 : i]
        below, upto = (rest < close[i]).sum(), (rest <= close[i]).sum()
        assert got[i] == pytest.approx((below + upto + (upto > below)) * 50 / 251 / 100, abs=2e-6)
