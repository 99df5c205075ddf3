"""What is done for long series and large groups equals what is done for small ones."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.functions.joins import joined_by_keys
from candlewick.operators import backtest, indicators, metrics, returns, runs, selection

DAY = dt.date(2020, 1, 1)


def of_days(every):
    return F.floor(F.datediff("ts", F.lit(DAY)) / every)


@pytest.mark.parametrize("held,bins", [(2, 256), (10**6, 16)])
def test_selected_percentiles_equal_sorted_ones(spark, held, bins):
    draw = np.random.default_rng(1)
    groups = {
        ("a", 1): draw.normal(0, 1, 500),
        ("a", 2): np.repeat([1.0, 2.0, 3.0], [300, 1, 5]),  # many equal ones
        ("b", 1): np.array([7.0]),
        ("b", None): np.array([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1e-300] * 3),
        (None, 3): np.exp(draw.normal(0, 40, 400)),  # over many magnitudes
        ("c", 0): np.array([-0.0, 0.0, 0.0]),
    }
    rows = [(*k, float(x), "x") for k, v in groups.items() for x in v] + [("a", 1, None, "x"), ("d", 1, None, "x")]
    df = spark.createDataFrame(rows, "instrument_id string, fold int, x double, lo string")
    qs = [0.0, 0.01, 0.05, 0.5, 0.95, 1.0]
    got = {(r.instrument_id, r.fold): r for r in selection.percentiles(df, "x", qs, ("instrument_id", "fold"), held, bins).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k].n == len(v)
        ordered = np.sort(v)
        for q, x in zip(qs, got[k].percentiles, strict=True):
            at = q * (len(v) - 1)
            low = math.floor(at)
            a, b = ordered[low], ordered[min(low + 1, len(v) - 1)]
            with np.errstate(over="ignore", invalid="ignore"):
                want = a + (b - a) * (at - low)
            assert x == pytest.approx(want, rel=1e-12, abs=0) or (math.isnan(want) and math.isnan(x))
    assert selection.percentiles(df.limit(0), "x", [0.5]).count() == 0


def test_joined_rows_of_a_hot_key(spark):
    rows = [(i, None if i % 3 == 0 else i % 7, "k") for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k int, _key string")
    sums = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("total"))
    want = {}
    for i, k, _ in rows:
        want[k] = want.get(k, 0) + i
    for most in (1, 4, 4096):
        got = joined_by_keys(df, sums, ["k"], "n", most).collect()
        assert sorted(r.i for r in got) == list(range(300)) and all(r.total == want[r.k] for r in got)


@pytest.mark.parametrize("every", [1, 9, 10_000])
def test_runs_over_chunks(spark, every):
    draw, rows = np.random.default_rng(every), []
    for one in range(4):
        x = 100.0
        for k in range(120):
            x *= 1 + draw.normal(0.0, 0.02)
            pos = float(draw.choice([-1, 0, 0.5, 1, 1])) if one % 2 else float(k // 25 % 3 - 1)
            rows.append((one, DAY + dt.timedelta(days=k), x, pos))
    rows.append((9, DAY, 5.0, 1.0))  # a single row
    df = spark.createDataFrame(rows, "instrument_id int, ts date, close double, position double")
    chunk = of_days(every)
    want = {r.instrument_id: r.max_dd_duration_bars for r in metrics.underwater(metrics._curve(df, "close", ("instrument_id",)), ("instrument_id",)).collect()}
    assert {r.instrument_id: r.max_dd_duration_bars for r in runs.drawdown_duration(df, chunk).collect()} == want
    plain = backtest.trades(df)
    assert sorted(map(tuple, runs.trades(df, chunk).collect())) == sorted(map(tuple, plain.collect()))
    for flag in (F.col("pnl") > 0, F.col("pnl") < 0):
        got = runs.streak(plain, flag, "n", F.floor(F.datediff("entry", F.lit(DAY)) / every))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, metrics.streak(plain, flag, "n").collect()))


def test_run_lengths_with_null_flags(spark):
    flags = [True, True, None, None, False, True, True, True, None, False]
    df = spark.createDataFrame([(1, DAY + dt.timedelta(days=k), x) for k, x in enumerate(flags)], "instrument_id int, ts date, f boolean")
    for every in (1, 3, 100):
        assert [r.run for r in runs.run_lengths(df, F.col("f"), of_days(every)).orderBy("ts").collect()] == [1, 2, 1, 2, 1, 1, 2, 3, 1, 1]


@pytest.mark.parametrize("p", [2, 5, 30])
@pytest.mark.parametrize("every", [3, 17, 10_000])
def test_percentile_ranks_over_chunks(spark, p, every):
    draw = np.random.default_rng(p)
    rows = [(one, DAY + dt.timedelta(days=k), None if one == 2 and draw.random() < 0.1 else float(draw.integers(0, 9))) for one in range(3) for k in range(90)]
    df = spark.createDataFrame(rows, "instrument_id int, ts date, close double")
    null_first = lambda rows: [(a, b, -1.0 if c is None else c) for a, b, c in rows]
    got = null_first((r.instrument_id, r.ts, r.pct_rank) for r in returns.percentile_rank_chunked(df, of_days(every), p=p).collect())
    want = null_first((r.instrument_id, r.ts, r.pct_rank) for r in returns.percentile_rank(df, p=p).collect())
    assert [r[:2] for r in sorted(got)] == [r[:2] for r in sorted(want)] and [r[2] for r in sorted(got)] == pytest.approx([r[2] for r in sorted(want)])


@pytest.mark.parametrize("every", [7, 40])
def test_parabolic_sar_over_chunks(spark, every):
    draw, rows = np.random.default_rng(every), []
    for one, drift in enumerate((0.0, 1.0, -1.0, 0.1)):  # a steady rise never turns, so all its chunks depend on the first
        x = 100.0
        for k in range(60):
            x += drift + (draw.normal(0, 2) if one in (0, 3) else 0.0)
            rows.append((one, DAY + dt.timedelta(days=k), x + 1 + draw.random() * (one != 1), x - 1, x))
    rows.append((9, DAY, 5.0, 4.0, 4.5))
    df = spark.createDataFrame(rows, "instrument_id int, ts date, high double, low double, close double")
    got = indicators.parabolic_sar_chunked(df, of_days(every))
    assert got.columns == [*df.columns, "sar"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, indicators.parabolic_sar(df).collect()))
    assert indicators.parabolic_sar_chunked(df.limit(0), of_days(every)).count() == 0


@pytest.mark.parametrize("size,every", [(2, 7), (100, 10_000)])
def test_correlations_by_blocks(spark, monkeypatch, size, every):
    monkeypatch.setattr(returns, "SLICE", 5)
    draw = np.random.default_rng(size)
    rows = []
    for one in ("a", "b", "c", "d", "flat", "late", "none"):
        for k in range(60):
            x = {"flat": 0.1, "none": None}.get(one, float(1e6 + draw.normal()))
            if one == "late" and k < 59 or draw.random() < 0.2:
                continue
            rows.append((one, DAY + dt.timedelta(days=k), x))
    df = spark.createDataFrame(rows, "instrument_id string, ts date, close double")
    want = {(r.left, r.right): r["corr"] for r in returns.correlations(df).collect()}
    got = {(r.left, r.right): r["corr"] for r in returns.correlations_blocked(df, of_days(every), size=size).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-7), k
    assert returns.correlations_blocked(df.limit(0), of_days(every)).count() == 0
