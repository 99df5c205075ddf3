import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.functions import tails, windows
from candlewick.jobs import studies
from candlewick.operators import backtest, bars, ewm, indicators, metrics, returns, tsstats, validation, writes

DAY = dt.date(2020, 1, 1)


def frame(spark, closes, **more):
    n = len(closes)
    cols = {"open": closes, "high": [c + 1.0 for c in closes], "low": [c - 1.0 for c in closes], "close": closes, "volume": [100.0 + (i * 37) % 50 for i in range(n)]} | more
    rows = [(1, DAY + dt.timedelta(i), *(float(cols[k][i]) for k in cols)) for i in range(n)]
    return spark.createDataFrame(rows, "instrument_id int, ts date, " + ", ".join(f"{k} double" for k in cols))


def column(df, name):
    return [r[name] for r in df.orderBy("ts").select(name).collect()]


SERIES = [10, 11, 12, 11, 13, 14, 13.5, 15, 14, 16]


def test_means(spark):
    df = frame(spark, SERIES)
    sma = column(indicators.sma(df, 3), "sma")
    assert sma[:2] == [None, None] and sma[2] == 11 and sma[3] == pytest.approx(34 / 3)
    assert column(indicators.ema(df, 3), "ema")[:2] == [10, 10.5]
    assert column(returns.log_returns(df), "log_ret")[1] == pytest.approx(math.log(1.1))
    z = column(returns.zscore(df), "z")
    assert np.mean(z) == pytest.approx(0, abs=1e-10) and np.std(z, ddof=1) == pytest.approx(1)


def test_rsi_ends(spark):
    assert column(indicators.rsi(frame(spark, [10 + i for i in range(20)])), "rsi")[-1] > 95
    low = column(indicators.rsi(frame(spark, [40 - i for i in range(20)])), "rsi")
    assert low[-1] < 5 and low[0] == 50


def test_obv(spark):
    assert column(indicators.obv(frame(spark, [10, 11, 10, 12], volume=[100, 200, 150, 300])), "obv") == [0, 200, 50, 350]


def test_ewm_chunks_equal_the_whole_and_nulls_age(spark):
    draw = np.random.default_rng(1)
    closes = list(100 + draw.normal(0, 1, 200).cumsum())
    df = frame(spark, closes)
    whole = column(ewm.ewm(df, ("close", 0.1, "y")), "y")
    assert column(ewm.ewm_chunked(df, "close", 0.1, "y", F.date_trunc("month", "ts").cast("date")), "y") == pytest.approx(whole)
    assert whole == pytest.approx(pd.Series(closes).ewm(alpha=0.1, adjust=False).mean().tolist())
    x = [None, 1.0, None, 4.0]
    aged = (0.9**2 * 1 + 0.1 * 4) / (0.9**2 + 0.1)
    assert ewm.scan(pd.Series(x, dtype=float), 0.1).tolist()[1:] == pytest.approx([1, 1, aged])


@pytest.mark.parametrize("every", [1, 3, 7, 1000])
def test_scans_of_chunks_equal_whole_ones_with_nulls_anywhere(spark, every):
    draw = np.random.default_rng(every)
    rows = []
    for one in range(5):
        for k in range(60):
            x = None if one == 4 or draw.random() < (0, 0.3, 0.7, 0.95, 1)[one] else float(draw.normal())
            y = None if k < 12 else float(draw.normal())  # nothing in the first chunks
            rows.append((one, dt.date(2020, 1, 1) + dt.timedelta(days=k), x, y))
    df = spark.createDataFrame(rows, "instrument_id int, ts date, x double, y double")
    by = lambda d: sorted(map(tuple, d.select("instrument_id", "ts", "a", "b", "c").collect()), key=lambda r: r[:2])
    chunk = F.floor(F.datediff("ts", F.lit("2020-01-01").cast("date")) / every)
    want = by(ewm.ewm(df, ("x", 0.2, "a"), ("y", 0.5, "b"), ("a", 0.3, "c")))
    got = by(ewm.affine_scan(ewm.affine_scan(df, [("x", 0.2, "a"), ("y", 0.5, "b")], chunk), [("a", 0.3, "c")], chunk))
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2]
        assert [v is None or math.isnan(v) for v in g[2:]] == [v is None or math.isnan(v) for v in w[2:]]
        assert [v for v in g[2:] if v is not None] == pytest.approx([v for v in w[2:] if v is not None and not math.isnan(v)], rel=1e-9)


def slow_sar(high, low, step=0.02, most=0.2):
    """State by state, as the definition reads."""
    state = {"bull": True, "af": step, "ep": low[0]}
    out = [high[0]]
    for i in range(1, len(high)):
        s = out[-1] + state["af"] * (state["ep"] - out[-1])
        if state["bull"]:
            s = min([s, low[i - 1]] + ([low[i - 2]] if i > 1 else []))
            if low[i] < s:
                s, state = state["ep"], {"bull": False, "af": step, "ep": low[i]}
            elif high[i] > state["ep"]:
                state |= {"ep": high[i], "af": min(state["af"] + step, most)}
        else:
            s = max([s, high[i - 1]] + ([high[i - 2]] if i > 1 else []))
            if high[i] > s:
                s, state = state["ep"], {"bull": True, "af": step, "ep": high[i]}
            elif low[i] < state["ep"]:
                state |= {"ep": low[i], "af": min(state["af"] + step, most)}
        out.append(s)
    return out


def test_sar(spark):
    draw = np.random.default_rng(3)
    closes = list(50 + draw.normal(0, 2, 120).cumsum())
    want = slow_sar([c + 1.0 for c in closes], [c - 1.0 for c in closes])
    assert column(indicators.parabolic_sar(frame(spark, closes)), "sar") == pytest.approx(want)


def test_tearsheet(spark):
    line = metrics.tearsheet(frame(spark, [100 * (1 + i / 252) for i in range(253)])).first()
    assert line.total_return == pytest.approx(1, rel=0.01)
    draw = np.random.default_rng(42)
    sheet = metrics.tearsheet(frame(spark, list(100 * np.cumprod(1 + draw.normal(0.001, 0.02, 3000))))).first()
    assert abs(sheet.skewness) < 0.5 and abs(sheet.excess_kurtosis) < 0.5
    down = metrics.tearsheet(frame(spark, [100, 110, 120, 90, 95, 100, 115])).first()
    assert down.max_drawdown == -0.25 and down.max_dd_duration_bars == 4
    assert metrics.tearsheet(frame(spark, [1, 2])).count() == 0


def test_tails():
    assert tails.phi(1.959963985) == pytest.approx(0.975) and tails.phi_inv(0.975) == pytest.approx(1.959963985)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_upper(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-5)
    for series, crit in ((1, -2.86), (2, -3.34)):
        assert tsstats.unit_root_p(crit, series) == pytest.approx(0.05, abs=0.002)


def test_unit_roots_cointegration_and_granger(spark):
    draw = np.random.default_rng(5)
    walk, noise = draw.normal(0, 1, 400).cumsum(), draw.normal(0, 1, 400)
    assert not tsstats.adf_test(frame(spark, list(walk + 100))).first().stationary
    assert tsstats.adf_test(frame(spark, list(noise + 100))).first().stationary
    rows = lambda a, b: spark.createDataFrame([(1, DAY + dt.timedelta(i), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "instrument_id int, ts date, a double, b double")
    assert tsstats.cointegration(rows(2 * walk + noise, walk)).first().cointegrated
    assert not tsstats.cointegration(rows(draw.normal(0, 1, 400).cumsum(), walk)).first().cointegrated
    led = np.concatenate([[0], noise[:-1]]) + 0.1 * draw.normal(0, 1, 400)
    assert tsstats.granger(rows(led, noise), 1).first().p_value < 1e-6
    assert tsstats.granger(rows(draw.normal(0, 1, 400), noise), 1).first().p_value > 0.01
    fit = {r.term: r for r in tsstats.ols(rows(3 * noise + 1, noise), "a", ["b"]).collect()}
    assert fit["b"].coef == pytest.approx(3) and fit["const"].coef == pytest.approx(1) and fit["b"].r2 == pytest.approx(1)


def test_ols_on_levels_far_from_zero(spark):
    draw = np.random.default_rng(11)
    x = 1e6 + draw.normal(0, 1, 300)
    z = 5e5 + 0.3 * (x - 1e6) + draw.normal(0, 2, 300)
    y = 2 * x - 0.5 * z + draw.normal(0, 1, 300)
    df = spark.createDataFrame([(1, DAY + dt.timedelta(i), *map(float, r)) for i, r in enumerate(zip(y, x, z, strict=True))], "instrument_id int, ts date, y double, x double, z double")
    got = {r.term: r for r in tsstats.ols(df, "y", ["x", "z"]).collect()}
    # by least squares on centred columns
    m = np.column_stack([x - x.mean(), z - z.mean(), np.ones(300)])
    want, rss, *_ = np.linalg.lstsq(m, y - y.mean(), rcond=None)
    assert got["x"].coef == pytest.approx(want[0], rel=1e-8) and got["z"].coef == pytest.approx(want[1], rel=1e-8)
    assert got["const"].coef == pytest.approx(y.mean() - want[0] * x.mean() - want[1] * z.mean(), rel=1e-6)
    se = np.sqrt(rss[0] / 297 * np.linalg.inv(m.T @ m)[0, 0])
    assert got["x"].t_stat == pytest.approx(want[0] / se, rel=1e-6)
    b, own, _ = tsstats._solve(np.column_stack([x, z, np.ones(300)]), y)
    assert b[:2] == pytest.approx(want[:2], rel=1e-6) and own == pytest.approx(rss[0], rel=1e-6)
    same = tsstats.ols(df.withColumn("w", F.col("x") * 2), "y", ["x", "w"]).where("term = 'x'").first()  # columns that depend on each other
    assert math.isfinite(same.coef)


def test_kendall_by_all_pairs(spark):
    draw = np.random.default_rng(12)
    for n, most in ((2, 9), (50, 4), (200, 1000), (77, 2)):
        a, b = draw.integers(0, most, n).astype(float), draw.integers(0, most, n).astype(float)
        x, y = np.sign(a[:, None] - a[None, :]), np.sign(b[:, None] - b[None, :])
        up = np.triu_indices(n, 1)
        low = math.sqrt((x[up] != 0).sum() * (y[up] != 0).sum())
        want = (x * y)[up].sum() / low if low else None
        assert returns.kendall(a, b) == (pytest.approx(want) if want is not None else None)
    df = frame(spark, SERIES).unionByName(frame(spark, SERIES[::-1]).withColumn("instrument_id", F.lit(2)))
    assert returns.correlations(df, "kendall").first().corr == pytest.approx(returns.kendall(np.array(SERIES, float), np.array(SERIES[::-1], float)))


def test_a_flat_instrument_fails_nobody(spark):
    """One constant series among others: its correlations are null, the others' stay."""
    draw = np.random.default_rng(13)
    two = frame(spark, list(100 + draw.normal(0, 1, 300).cumsum())).withColumn("instrument_id", F.lit(2))
    flat = frame(spark, [50.0] * 300, high=[50.0] * 300, low=[50.0] * 300, volume=[10.0] * 300).withColumn("instrument_id", F.lit(3))
    one = frame(spark, list(80 + draw.normal(0, 1, 300).cumsum()))
    every, bench = one.unionByName(two).unionByName(flat), one
    both = bars.pair(every, bench)
    for method in ("pearson", "spearman", "kendall"):
        got = {(r.left, r.right): r.corr for r in returns.correlations(every, method).collect()}
        assert got[1, 2] is not None and got[1, 3] is None and got[2, 3] is None
    rolling = {r.instrument_id: r.corr for r in returns.rolling_correlation(both).where(F.col("ts") == DAY + dt.timedelta(299)).collect()}
    assert rolling[2] is not None and rolling[3] is None
    lags = returns.lead_lag(both, 2).collect()
    assert all((r.corr is None) == (r.instrument_id == 3) for r in lags) and len(lags) == 15
    sheet = {r.instrument_id: r for r in metrics.tearsheet(every, bench=bench.select("instrument_id", "ts", F.col("close").alias("value"))).collect()}
    assert sheet[2].return_autocorr is not None and sheet[3].return_autocorr is None and sheet[3].r_squared is None and sheet[3].sharpe == 0
    results = studies.studies(every, bench)
    assert results.count() == 75 and studies.report(results).count() == 3
    assert {r.group for r in results.collect()}.isdisjoint({"error"})


def test_a_failed_study_is_a_row(spark):
    df = frame(spark, list(np.linspace(50, 200, 60)))
    good = lambda f: {"group": "own", "value": len(f), "signal": "bull", "score": 1, "note": "n"}
    bad = lambda f: {"value": 1 / 0}
    got = {r.study: r for r in studies.studies(df, which=[studies.registry()[0], F.struct(F.col("no such column"))], more={"mine": good, "broken": bad}).collect()}
    assert got["MA Stack/Alignment"].group == "trend" and got["mine"].value == 60
    for name in ("study 1", "broken"):
        assert (got[name].group, got[name].signal, got[name].score, got[name].value) == ("error", "neutral", 0.5, None) and got[name].note.startswith("error: ")


def test_studies_that_raise_on_some_rows(spark):
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=k), 11.0 + k + i, 9.0 + k, 10.0 + k, 100.0) for i in range(6) for k in range(30)]
    df = spark.createDataFrame(rows, "instrument_id int, ts date, high double, low double, close double, volume double")

    def flag(x):
        return F.struct(F.lit("x").alias("study"), F.lit("mine").alias("group"), x.cast("double").alias("value"), F.lit('{"a": "\\"é"}').alias("value_json"), F.lit("bull").alias("signal"), F.lit(1.0).alias("score"), F.lit("fine").alias("note"))

    by = F.col("instrument_id").cast("double") - 2
    which = [
        flag(F.lit(1.0) / by),  # raises on one instrument
        flag(1 / by + 1 / by),  # the same part twice
        flag(F.lit("x").cast("int")),  # on all
        flag(F.when(by == 0, F.raise_error(F.lit("no good"))).otherwise(by)),
        flag(F.pow(F.lit(0.1), by)),  # on none
        F.when(by > 0, flag(by)),  # null on some, which is no failure
        flag(F.lit(float("nan"))),
        studies.registry()[0],
    ]
    got = {(r.instrument_id, r.place): r for r in studies.studies(df, which=which).collect()}
    plain = {(r.instrument_id, r.place): r for r in studies.studies(df).collect()}
    assert len(got) == 6 * 8
    failed = {k for k, r in got.items() if r["group"] == "error"}
    assert failed == {(2, 0), (2, 1), (2, 3), *((i, 2) for i in range(6))}
    for k in failed:
        assert (got[k].study, got[k].signal, got[k].score, got[k].value, got[k].note) == (f"study {k[1]}", "neutral", 0.5, None, "error: " + studies.RAISED)
    assert got[5, 0].value == 1 / 3 and got[5, 1].value == 2 / 3 and got[0, 4].value == 0.1**-2 and got[0, 0].value_json == '{"a": "\\"é"}'
    assert got[0, 5].study is None and got[3, 5].value == 1 and math.isnan(got[0, 6].value)
    assert all(tuple(got[i, 7])[2:] == tuple(plain[i, 0])[2:] for i in range(6))
    said = studies.reasons(df, which)
    assert set(said) == {0, 1, 2, 3} and "DIVIDE_BY_ZERO" in said[0] and "no good" in said[3]


def test_study_notes(spark):
    df = frame(spark, list(np.linspace(50, 200, 300)))
    notes = {r.study: r.note for r in studies.studies(df, df.withColumn("instrument_id", F.lit(9))).collect()}
    close, mean = 200, np.linspace(50, 200, 300)[-200:].mean()
    assert notes["MA Stack/Alignment"] == "Price above 5/5 MAs" and notes["Price vs 200-DMA"] == f"{(close / mean - 1) * 100:.1f}% vs 200-DMA"
    assert notes["RS vs SPY (3m)"] == "RS=1.000" and notes["RSI Overbought Streak"] == "10/10 days RSI>70" and notes["52w High Proximity"] in ("0.0% off 52w high", "-0.0% off 52w high")
    assert notes["ROC Multi-Period"].startswith("1m:") and notes["ROC Multi-Period"].count("|") == 3


def test_share_of_folds_below_the_median(spark):
    draw = np.random.default_rng(14)
    closes = list(100 * np.exp(draw.normal(0, 0.01, 163).cumsum()))
    got = validation.pbo(frame(spark, closes), lambda b: b.withColumn("signal", F.lit(1)), 4).first().pbo
    sharpes = []
    for k in range(4):
        c = np.array(closes[k * 40 : (k + 1) * 40 if k < 3 else None])
        r = np.concatenate([[0.0], c[1:] / c[:-1] - 1])
        r[1] -= 0.0015  # the position opens on the second bar
        lr = np.diff(np.log(np.cumprod(1 + r)))
        sharpes.append(lr.mean() / lr.std(ddof=1))
    assert got == pytest.approx(np.mean(np.array(sharpes) < np.median(sharpes)))


def test_backtest_by_hand(spark):
    df = frame(spark, [10, 11, 12, 9, 9, 10]).join(spark.createDataFrame([(DAY + dt.timedelta(i), s) for i, s in enumerate([1, 1, -1, -1, 0, 0])], "ts date, signal int"), "ts")
    run = backtest.run_backtest(df, short=True)
    assert column(run, "position") == [0, 1, 1, -1, -1, 0]
    assert column(run, "strategy_return")[:4] == pytest.approx([0, 0.1 - 0.0015, 1 / 11, -1 * (9 / 12 - 1) - 0.003])
    got = backtest.trades(run).orderBy("entry").collect()
    assert [(t.side, t.entry_price, t.exit_price) for t in got] == [("long", 11, 9), ("short", 9, 10)]
    assert got[0].pnl == pytest.approx(9 / 11 - 1 - 0.003)


def test_monte_carlo_equals_one_generator(spark):
    r = np.random.default_rng(2).normal(0, 0.01, 60)
    df = spark.createDataFrame([(1, DAY + dt.timedelta(i), float(x)) for i, x in enumerate(r)], "instrument_id int, ts date, strategy_return double")
    rng, block, paths = np.random.default_rng(42), 10, []
    for _ in range(30):
        parts = []
        while sum(map(len, parts)) < 60:
            k = rng.integers(0, 50)
            parts.append(r[k : k + block])
        paths.append(10_000 * np.cumprod(1 + np.concatenate(parts)[:60]))
    want = np.percentile(np.array(paths), [5, 50], axis=0)
    got = validation.monte_carlo(df, sims=30, chunk=7).orderBy("step").collect()
    assert [g.p5 for g in got] == pytest.approx(want[0].tolist()) and [g.p50 for g in got] == pytest.approx(want[1].tolist())


def test_monte_carlo_over_spans_with_zeros_signs_and_overflow(spark, monkeypatch):
    draw, sims = np.random.default_rng(5), 20
    series = {1: draw.normal(0, 0.3, 150), 2: draw.normal(0, 1.2, 70), 3: np.full(60, 1e10), 4: draw.normal(0, 0.1, 7), 5: np.array([0.5])}
    series[2][[10, 50]] = -1.0  # all is lost
    rows = [(k, DAY + dt.timedelta(i), float(x)) for k, r in series.items() for i, x in enumerate(r)] + [(1, DAY - dt.timedelta(1), None), (6, DAY, None)]
    df = spark.createDataFrame(rows, "instrument_id int, ts date, strategy_return double")
    monkeypatch.setattr(validation, "SPAN", 16)
    monkeypatch.setattr(validation, "STEPS", 5)
    for by in (None, F.floor(F.datediff("ts", F.lit(DAY)) / 20)):
        got = {(r.instrument_id, r.step): r for r in validation.monte_carlo(df, sims=sims, by=by).collect()}
        assert len(got) == sum(map(len, series.values()))
        for k, r in series.items():
            n = len(r)
            size = min(max(10, int(math.sqrt(n))), n)
            at = (validation.start_table(n, sims)[:, :, None] + np.arange(size)).reshape(sims, -1)[:, :n]
            with np.errstate(over="ignore", invalid="ignore"):
                want = np.percentile(10_000 * np.cumprod(1 + r[at], axis=1), validation.BANDS, axis=0).T
            for i in range(n):
                for w, g in zip(want[i].tolist(), tuple(got[k, i])[2:], strict=True):
                    assert g is None if not math.isfinite(w) else g == pytest.approx(w, rel=1e-9, abs=1e-9)
    assert got[3, 59].p50 is None and got[3, 20].p50 > 1e200


def test_deflated_ratio_is_below_the_plain_one(spark):
    row = spark.range(1).select(F.lit(0.1).alias("sr"), F.lit(250.0).alias("n"), F.lit(0.0).alias("sk"), F.lit(0.0).alias("k"))
    args = F.col("sr"), F.col("n"), F.col("sk"), F.col("k")
    psr = validation.probabilistic_sharpe(args[0], F.lit(0.0), *args[1:])
    got = row.select(psr.alias("p"), validation.deflated_sharpe(args[0], args[1], 10, *args[2:]).alias("d")).first()
    assert got.p == pytest.approx(tails.phi(0.1 * math.sqrt(249) / math.sqrt(1 - 0.01 / 4))) and got.d < got.p


def test_minutes_and_keyed_writes(spark):
    rows = [(1, dt.datetime(2017, 8, 17, 0, 0), 4285.08, 4285.08, 4200.74, 4261.48, 7.20, 30680.0, 42), (1, dt.datetime(2017, 8, 17, 0, 1), 4261.48, 4261.48, 4200.00, 4220.00, 3.10, 13100.0, 18), (1, dt.datetime(2017, 8, 17, 0, 2), 4220.00, 4250.00, 4210.00, 4240.00, 5.50, 23250.0, 30)]
    m = spark.createDataFrame(rows, "instrument_id int, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades int")
    five = bars.rollup(m, "5m").first()
    assert (five.open, five.high, five.low, five.close, round(five.volume, 2)) == (4285.08, 4285.08, 4200.0, 4240.0, 15.8)
    q = bars.quality(m, True).first()
    assert (q.total, q.missing) == (3, 0)
    assert writes.insert_ignore(m, m, ["instrument_id", "ts"], [F.col("open")]).count() == 0
    once, twice = bars.rollup(m, "1d").first(), bars.cascade(m)["1d"].first()
    assert once[:2] == twice[:2] and tuple(once)[2:] == pytest.approx(tuple(twice)[2:])


def test_log_and_periods(spark):
    kind = "source string, symbol string, granularity string, period string, rows int, checksum_ok boolean, status string"
    log = spark.createDataFrame([("d", "A", "1m", "2020-01", 1, True, "ok"), ("d", "A", "1m", "2020-02", 0, None, "error")], kind).withColumn("ingested_at", F.current_timestamp())
    wanted = writes.periods(log.select("source", "symbol", "granularity").distinct(), "2020-01-15", "2020-03-03")
    assert sorted(r.period for r in wanted.collect()) == ["2020-01", "2020-02", "2020-03-01", "2020-03-02"]
    assert sorted(r.period for r in writes.to_load(wanted, log).collect()) == ["2020-02", "2020-03-01", "2020-03-02"]
    run = spark.createDataFrame([("d", "A", "1m", "2020-02", 9, True, "ok")], kind)
    after = {r.period: r.status for r in writes.log_periods(log, run).collect()}
    assert after == {"2020-01": "ok", "2020-02": "ok"}


def test_studies_with_few_bars_and_no_benchmark(spark):
    got = {r.study: r for r in studies.studies(frame(spark, [10 + i % 3 for i in range(12)])).collect()}
    assert len(got) == 25 and got["Price vs 200-DMA"].note == "insufficient data" and got["RS vs SPY"].note == "no SPY data"
    assert got["MA Slope"].score == 0.5 and got["Hurst Exponent"].value is None
    row = studies.report(studies.studies(frame(spark, list(np.linspace(50, 200, 300))))).first()
    assert row.n_studies == 25 and row.momentum_intact_score > 0.5 and row.bull_pct > row.bear_pct


def test_hurst_by_loops(spark):
    x = np.log(100 + np.random.default_rng(8).normal(0, 1, 300).cumsum() ** 2 / 50)
    points = []
    for lag in (2, 4, 8, 16, 32):
        rs = []
        for i in range(0, len(x) - lag, lag):
            seg = x[i : i + lag]
            dev, sd = np.cumsum(seg - seg.mean()), seg.std(ddof=1)
            if sd > 0:
                rs.append((dev.max() - dev.min()) / sd)
        points.append((math.log(lag), math.log(np.mean(rs))))
    want = np.polyfit(*zip(*points, strict=True), 1)[0]
    df = spark.createDataFrame([(1, [float(v) for v in x])], "instrument_id int, logs array<double>")
    assert studies.with_hurst(df).first().hurst == pytest.approx(want)


def test_chunked_windows_equal_whole_ones(spark):
    """Chunks longer and shorter than what a window looks back, and gaps between them."""
    draw = np.random.default_rng(15)
    df = frame(spark, list(100 + draw.normal(0, 1, 200).cumsum())).where("dayofmonth(ts) not between 10 and 25 or month(ts) = 3")
    df = df.unionByName(df.withColumn("instrument_id", F.lit(2)).withColumn("close", F.col("close") * 2))
    for op, back in ((lambda b: indicators.sma(b, 25), 24), (indicators.stochastic, 15), (lambda b: returns.rolling_vol(b, 10), 10)):
        for chunk in (F.date_trunc("month", "ts"), F.dayofyear("ts"), F.lit(0)):
            whole = sorted(map(tuple, op(df).select(df.columns + [c for c in op(df).columns if c not in df.columns]).collect()))
            got = windows.chunked(df, op, chunk, back)
            assert sorted(map(tuple, got.select(op(df).columns).collect())) == whole


def by_lstsq(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    return b, e @ e


def test_unit_root_numbers_by_least_squares(spark):
    """The statistic, its lags and the F statistics, each from plain regressions."""
    draw = np.random.default_rng(16)
    x = draw.normal(0, 1, 150).cumsum() + 0.3 * draw.normal(0, 1, 150)
    d, most = np.diff(x), math.ceil(12 * 1.5**0.25)

    def design(lags, skip):
        rows = range(skip, len(d))
        return np.array([[x[i], *(d[i - k] for k in range(1, lags + 1)), 1.0] for i in rows]), np.array([d[i] for i in rows])

    def aic(lags):
        m, y = design(lags, most)
        return len(y) * math.log(by_lstsq(m, y)[1] / len(y)) + 2 * m.shape[1]

    lags = min(range(most + 1), key=aic)
    m, y = design(lags, lags)
    b, rss = by_lstsq(m, y)
    want = b[0] / math.sqrt(rss / (len(y) - m.shape[1]) * np.linalg.inv(m.T @ m)[0, 0])
    got = tsstats.adf_test(frame(spark, list(x + 50))).first()
    assert got.lags == lags and got.stat == pytest.approx(want, rel=1e-6)
    assert got.p_value == pytest.approx(tsstats.unit_root_p(want)) and got.crit_5 == pytest.approx(-2.86154 - 2.8903 / len(y) - 4.234 / len(y) ** 2 - 40.04 / len(y) ** 3)
    z = np.concatenate([[0.0, 0.0], 0.4 * x[:-2]]) + draw.normal(0, 1, 150)
    both = spark.createDataFrame([(1, DAY + dt.timedelta(i), float(p), float(q)) for i, (p, q) in enumerate(zip(z, x, strict=True))], "instrument_id int, ts date, a double, b double")
    for r in tsstats.granger(both, 3).collect():
        rows = range(r.lag, 150)
        own = np.array([[1.0, *(z[i - k] for k in range(1, r.lag + 1))] for i in rows])
        more = np.hstack([own, np.array([[x[i - k] for k in range(1, r.lag + 1)] for i in rows])])
        y = z[r.lag :]
        r0, r1, free = by_lstsq(own, y)[1], by_lstsq(more, y)[1], len(y) - 2 * r.lag - 1
        assert r.f_stat == pytest.approx((r0 - r1) / r.lag / (r1 / free), rel=1e-6) and r.p_value == pytest.approx(tails.f_upper(r.f_stat, r.lag, free))
    fit, _ = by_lstsq(np.column_stack([x, np.ones(150)]), z)
    left = z - np.column_stack([x, np.ones(150)]) @ fit
    tau = tsstats.adf(left, constant=False)[0]
    got = tsstats.cointegration(both).first()
    assert got.stat == pytest.approx(tau, rel=1e-6) and got.p_value == pytest.approx(tsstats.unit_root_p(tau, 2))


@pytest.mark.parametrize("every", [5, 40, 10_000])
def test_tests_from_lagged_products_equal_those_of_whole_series(spark, every):
    from candlewick.operators import lagged

    draw = np.random.default_rng(7)
    rows = []
    for one, n in enumerate((400, 120, 25, 9, 5, 2, 60, 60)):
        e, g = draw.normal(size=n), draw.normal(size=n)
        b = 1e4 + g.cumsum()
        a = 3 * b + e.cumsum() * 0.2 if one % 2 else np.concatenate([[0.0], g[:-1]]) + e + 50
        if one == 6:
            a = np.full(n, 5.0)  # flat
        if one == 7:
            a = 2 * b + 1  # a perfect fit
        rows += [(one, dt.date(2020, 1, 1) + dt.timedelta(days=k), float(a[k]), float(b[k])) for k in range(n)]
    rows += [(0, dt.date(2019, 1, 1), None, 1.0), (8, dt.date(2019, 1, 1), None, None)]
    both = spark.createDataFrame(rows, "instrument_id int, ts date, a double, b double")
    chunk = F.floor(F.datediff("ts", F.lit("2019-01-01").cast("date")) / every)

    def same(got, want, *keys):
        got, want = ({tuple(r[k] for k in keys): r for r in x.collect()} for x in (got, want))
        assert set(got) == set(want)
        for k, w in want.items():
            for name in w.asDict():
                x, y = got[k][name], w[name]
                if y is None or (isinstance(y, float) and math.isnan(y)):
                    assert x is None or math.isnan(x), (k, name, x)
                else:
                    assert x == pytest.approx(y, rel=1e-6, abs=1e-9), (k, name)

    known = both.where("a is not null and b is not null")
    same(lagged.adf_test(both, chunk, "a"), tsstats.adf_test(both, "a"), "instrument_id")
    same(lagged.adf_test(both, chunk, "b"), tsstats.adf_test(both, "b"), "instrument_id")
    noisy = known.where("instrument_id not in (6, 7)")  # of flat and perfect ones the plain test takes rounding for noise
    same(lagged.granger(noisy, chunk), tsstats.granger(noisy), "instrument_id", "lag")
    steady = known.where("instrument_id <> 6")
    same(lagged.cointegration(steady, chunk), tsstats.cointegration(steady), "instrument_id")
    assert lagged.granger(both, chunk).where("instrument_id in (6, 7)").count() == 10
    for op in (lagged.granger, lagged.cointegration, lambda d, c: lagged.adf_test(d, c, "a")):
        assert op(both.limit(0), chunk).count() == 0


def test_probabilistic_ratio_beside_the_sheet(spark):
    draw = np.random.default_rng(17)
    r = metrics.with_psr(metrics.tearsheet(frame(spark, list(100 * np.cumprod(1 + draw.normal(0.0002, 0.02, 400)))))).first()
    root = 1 - r.skewness * r.sharpe + (r.excess_kurtosis - 1) / 4 * r.sharpe**2
    assert r.probabilistic_sharpe == (pytest.approx(tails.phi(r.sharpe * math.sqrt(r.n - 1) / math.sqrt(root))) if root > 0 else None)
