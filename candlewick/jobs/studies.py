"""The battery of 25 studies at each instrument's last bar, and the report that they add up to.

Window columns are added once, over one window specification; each instrument then becomes one row: its last
bar, and its last bars as an array. Every study is an expression on that row, so all 25 cost no further shuffle.

A study that fails gives a row of group ``error``, neutral, with the message as its note, and the others go on. The 25
divide by nothing that may be zero, so they don't fail on flat or short series; added studies may be expressions on
:func:`facts` or Python functions of an instrument's bars. An added expression may fail while the plan is made (then it is an
error for all instruments) or while it runs, for some instruments only: a division by zero, a cast, an overflow. Each is
evaluated under a guard of its own, so only the rows on which it raises become error rows, in the same pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.functions.windows import KEY, TIME, clip, corr, last, ordered, prev, ratio, roll
from candlewick.operators import indicators as ind
from candlewick.operators import returns as ret

TAIL = 500
STUDY = "struct<study:string,group:string,value:double,value_json:string,signal:string,score:double,note:string>"


def _steps(x: Column, bull: float, bear: float) -> Column:
    return F.when(x >= bull, "bull").when(x <= bear, "bear").otherwise("neutral")


def _side(bull: Column, bear: Column) -> Column:
    return F.when(bull, "bull").when(bear, "bear").otherwise("neutral")


def _score_of(signal: Column, bull: float, bear: float, neutral: float = 0.5) -> Column:
    return F.when(signal == "bull", bull).when(signal == "bear", bear).otherwise(neutral)


def _study(name: str, group: str, value: Column, signal: Column, score: Column, least: Column | int = 0, short: str | None = None, note: Column | None = None, json: Column | None = None) -> Column:
    """One result; with fewer than ``least`` bars it is neutral and empty, under the short name."""
    enough = least if isinstance(least, Column) else F.col("n") >= least
    none = F.lit(None)
    return F.struct(
        F.when(enough, name).otherwise(short or name).alias("study"),
        F.lit(group).alias("group"),
        F.when(enough, value).otherwise(none).cast("double").alias("value"),
        F.when(enough, json if json is not None else none).otherwise(none).cast("string").alias("value_json"),
        F.when(enough, signal).otherwise("neutral").alias("signal"),
        F.when(enough, score).otherwise(0.5).cast("double").alias("score"),
        F.when(enough, note if note is not None else F.lit("")).otherwise("insufficient data").alias("note"),
    )


def _said(pattern: str, *values: Column) -> Column:
    """A note with numbers in it; empty where one is missing."""
    known = values[0].isNotNull()
    for v in values[1:]:
        known = known & v.isNotNull()
    return F.when(known, F.format_string(pattern, *(v.cast("double") for v in values))).otherwise("")


# ---- the row that studies look at


def facts(bars: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """One row an instrument: fields of the last bar, and what the studies read from the bars before it."""
    w, whole = ordered(), Window.partitionBy(KEY)
    before = lambda p: w.rowsBetween(-p, -1)
    bars = bars.select(KEY, TIME, "high", "low", "close", "volume")  # what is read: all of it passes through Python once
    df = ind.recursive_set(bars).withColumn("n", F.count("*").over(whole)).withColumn("rn", F.row_number().over(w))
    df = ind.obv(ind.chaikin(ind.bollinger(ind.ichimoku(ret.rolling_vol(df, out="vol20")))))
    df = ret.log_returns(df)
    cols = {f"sma{p}": roll(F.avg, "close", p) for p in (10, 20, 50, 100, 200)}
    cols |= {f"close_{k}": prev("close", k) for k in (20, 62, 125, 251)}
    cols |= {
        "obv_20": prev("obv", 20), "hist_1": prev("macd_hist"), "log_ret_1": prev("log_ret"),
        "top_252": F.max("close").over(last(252)), "top_all": F.max("close").over(whole),
        "high_252": F.when(F.count("high").over(before(252)) == 252, F.max("high").over(before(252))),
        "low_252": F.when(F.count("low").over(before(252)) == 252, F.min("low").over(before(252))),
        "high_before": F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "low_before": F.min("low").over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "top_21": F.max("close").over(before(21)), "volume_21": F.percentile("volume", F.lit(0.5)).over(before(21)),
        "low_22": F.min("low").over(last(22)),
    }
    df = df.withColumns(cols).withColumn("sma50_4", prev("sma50", 4))
    near = F.col("n") - F.col("rn") < TAIL
    row = F.struct(*(c for c in df.columns if c not in (KEY, "rn")))
    one = df.groupBy(KEY).agg(
        F.max_by(row, TIME).alias("x"),
        F.sort_array(F.collect_list(F.when(near, F.struct(TIME, "close", "vol20", "rsi")))).alias("tail"),
        corr("log_ret", "log_ret_1").alias("ac1"),
        F.count("vol20").alias("vols"),
    )
    one = _from_tail(one.select(KEY, "x.*", "tail", "ac1", "vols"))
    if bench is None:
        return one.withColumn("rs", F.lit(None).cast("double")).withColumn("common", F.lit(None).cast("long"))
    b = bench.select(TIME, F.col("close").alias("b"), F.col(KEY).alias("bench"))
    by = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
    both = bars.select(KEY, TIME, "close").join(b, TIME).where("close is not null and b is not null").where(F.col(KEY) != F.col("bench")).withColumn("back", F.row_number().over(by))
    at = lambda k, c: F.max(F.when(F.col("back") == k, F.col(c)))
    strength = both.groupBy(KEY).agg(F.count("*").alias("common"), ratio(ratio(at(1, "close"), at(63, "close")), ratio(at(1, "b"), at(63, "b"))).alias("rs"))
    return one.join(strength, KEY, "left")


def _peaks(x: Column, up: bool) -> Column:
    """Strict inner maxima (or minima) of an array."""
    turn = lambda v, a, b: (v > a) & (v > b) if up else (v < a) & (v < b)
    return F.filter(x, lambda v, i: (i > 0) & (i < F.size(x) - 1) & turn(v, F.get(x, i - 1), F.get(x, i + 1)))


def _rising(x: Column) -> Column:
    return F.when(F.size(x) >= 2, F.get(x, F.size(x) - 1) > F.get(x, F.size(x) - 2)).otherwise(F.lit(False))


LAGS = (2, 4, 8, 16, 32)


def _scaled(seg: Column, lag: int) -> Column:
    """Range of the running sum of a segment's deviations over their sample deviation; null where they don't vary."""
    zero = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0.0).alias("square"))

    def of(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / lag
        centred = F.transform(x, lambda v: v - mean)

        def add(a: Column, v: Column) -> Column:
            at = a["at"] + v
            return F.struct(at.alias("at"), F.least(a["low"], at).alias("low"), F.greatest(a["high"], at).alias("high"), (a["square"] + v * v).alias("square"))

        return F.aggregate(centred, zero, add, lambda a: F.when(a["square"] > 0, (a["high"] - a["low"]) / F.sqrt(a["square"] / (lag - 1))))

    return of(seg)


def with_hurst(df: DataFrame, logs: str = "logs") -> DataFrame:
    """df with ``hurst``: slope of log mean rescaled range on log segment length over an array of log prices.

    Null with fewer than three lengths. Each step is a column, so that nothing is computed twice.
    """
    x = F.col(logs)
    starts = {k: F.when(F.size(x) > k, F.sequence(F.lit(0), F.size(x) - k - 1, F.lit(k))).otherwise(F.array().cast("array<int>")) for k in LAGS}
    df = df.withColumns({f"_seg{k}": _slices(starts[k], x, k) for k in LAGS})
    df = df.withColumns({f"_rs{k}": F.filter(_each(F.col(f"_seg{k}"), k), lambda v: v.isNotNull()) for k in LAGS})
    df = df.withColumns({f"_y{k}": F.when(F.size(f"_rs{k}") > 0, F.ln(F.aggregate(f"_rs{k}", F.lit(0.0), lambda a, v: a + v) / F.size(f"_rs{k}"))) for k in LAGS})
    total = lambda f: sum((F.when(F.col(f"_y{k}").isNotNull(), f(math.log(k), F.col(f"_y{k}"))).otherwise(0.0) for k in LAGS), F.lit(0.0))
    df = df.withColumns({"_k": total(lambda a, y: F.lit(1.0)), "_sx": total(lambda a, y: F.lit(a)), "_sy": total(lambda a, y: y), "_sxy": total(lambda a, y: a * y), "_sxx": total(lambda a, y: F.lit(a * a))})
    slope = ratio(F.col("_k") * F.col("_sxy") - F.col("_sx") * F.col("_sy"), F.col("_k") * F.col("_sxx") - F.col("_sx") * F.col("_sx"))
    df = df.withColumn("hurst", F.when(F.col("_k") >= 3, slope))
    return df.drop(*(f"{p}{k}" for p in ("_seg", "_rs", "_y") for k in LAGS), "_k", "_sx", "_sy", "_sxy", "_sxx")


def _slices(starts: Column, x: Column, lag: int) -> Column:
    return F.transform(starts, lambda i: F.slice(x, i + 1, F.lit(lag)))


def _each(segments: Column, lag: int) -> Column:
    return F.transform(segments, lambda seg: _scaled(seg, lag))


def _from_tail(one: DataFrame) -> DataFrame:
    """Columns that studies read from the last bars, step by step; the arrays themselves go."""
    tail = F.col("tail")

    def newest(k: int, field: str) -> Column:
        return F.transform(F.slice(tail, -F.least(F.size(tail), F.lit(k)), F.lit(k)), lambda t: t[field])

    one = one.withColumns({"_c60": newest(60, "close"), "_rsi10": newest(10, "rsi"), "_vols": newest(252, "vol20"), "logs": F.transform(tail, lambda t: F.ln(t["close"]))}).drop("tail")
    one = one.withColumns({"_high": _peaks(F.col("_c60"), True), "_low": _peaks(F.col("_c60"), False), "hot": F.size(F.filter("_rsi10", lambda v: v > 70))})
    one = one.withColumn("vol_rank", F.when(F.col("vols") < 30, F.lit(0.5)).when(F.forall("_vols", lambda v: v.isNotNull()), ret.rank_in(F.col("_vols"), 252)))
    one = one.withColumns({"hh": _rising(F.col("_high")), "hl": _rising(F.col("_low"))}).drop("_c60", "_rsi10", "_vols", "_high", "_low")
    return with_hurst(one).drop("logs")


def registry(bench: bool = True) -> list[Column]:
    """All studies in their order, as expressions on a row of facts()."""
    c = F.col
    close = c("close")
    known = [p for p in (10, 20, 50, 100, 200)]
    above = sum((F.coalesce((close > c(f"sma{p}")).cast("int"), F.lit(0)) for p in known), F.lit(0))
    have = sum((c(f"sma{p}").isNotNull().cast("int") for p in known), F.lit(0))
    stack = F.when(have > 0, above / have).otherwise(0.5)
    pct200 = (ratio(close, c("sma200")) - 1) * 100
    slope = ratio(c("sma50") - c("sma50_4"), c("sma50_4")) * 100
    hh, hl, hot, vol, h = c("hh"), c("hl"), c("hot"), c("vol_rank"), c("hurst")
    plus = c("plus_di") > c("minus_di")
    trending = c("adx") > 25
    top, low = F.greatest("senkou_a", "senkou_b"), F.least("senkou_a", "senkou_b")
    cloud = c("senkou_a").isNotNull() & c("senkou_b").isNotNull()
    regime = F.when(cloud, _side(close > top, close < low)).otherwise("neutral")
    year = (ratio(c("close_20"), c("close_251")) - 1) * 100
    rocs = {"1m": (21, "close_20"), "3m": (63, "close_62"), "6m": (126, "close_125"), "12m": (252, "close_251")}
    change = lambda x: (ratio(close, c(x)) - 1) * 100
    up = sum((F.when((c("n") > p) & (change(x) > 0), 1).otherwise(0) for p, x in rocs.values()), F.lit(0))
    asked = sum((F.when(c("n") > p, 1).otherwise(0) for p, _ in rocs.values()), F.lit(0))
    share = ratio(up.cast("double"), asked.cast("double"))
    off = (ratio(close, c("top_252")) - 1) * 100
    hist = _side((c("macd_hist") > 0) & (c("macd_hist") > c("hist_1")), (c("macd_hist") < 0) & (c("macd_hist") < c("hist_1")))
    upper = F.when(c("n") >= 252, c("high_252")).otherwise(c("high_before"))
    lower = F.when(c("n") >= 252, c("low_252")).otherwise(c("low_before"))
    channel = _side(close >= upper, close <= lower)
    high, surge = F.coalesce(close >= c("top_21"), F.lit(False)), F.coalesce(c("volume") > c("volume_21") * 1.5, F.lit(False))
    burst = F.when(high & surge, "bull").when(high | surge, "neutral").otherwise("bear")
    stretched = F.when(pct200 > 30, "bear").when(pct200 > 0, "bull").otherwise("neutral")
    band = c("bb_pct")
    far = F.when(c("atr") > 0, ratio(close - c("sma50"), c("atr"))).otherwise(0.0)
    fall = (ratio(close, c("top_all")) - 1) * 100
    flow = ratio(c("obv") - c("obv_20"), F.greatest(F.abs("obv_20"), F.lit(1.0)))
    risk = close - F.least(c("low_22"), close - 2 * c("atr"))
    rr = F.when(risk > 0, ratio(2 * risk, risk))
    note = F.when(c("rsi") > 70, "Overbought").when(c("rsi") < 30, "Oversold").otherwise("")
    whole = lambda x: x.cast("int").cast("string")
    stacked = F.concat(F.lit("Price above "), whole(above), F.lit("/"), whole(have), F.lit(" MAs"))
    said_rocs = F.concat_ws(" | ", *(F.when(c("n") > p, F.concat(F.lit(f"{k}:"), _said("%.1f%%", change(x)))) for k, (p, x) in rocs.items()))
    extended = F.when(pct200 > 50, _said("Extended %.1f%% above 200-DMA — markup risk", pct200)).otherwise(_said("%.1f%% above 200-DMA", pct200))
    banded = F.when(band > 1, "Above upper band — overbought").when(band < 0, "Below lower band — oversold").otherwise(_said("%%B=%.2f", band))
    wandering = F.when(h > 0.6, "trending").when(h < 0.4, "mean-reverting").otherwise("random walk")
    stopped = F.concat(F.lit("Stop="), F.bround(close - risk, 2).cast("string"), F.lit(", ATR="), F.bround("atr", 2).cast("string"))
    rs_known = F.lit(bench) & c("common").isNotNull()
    strength = _study("RS vs SPY (3m)", "relative_strength", F.bround(c("rs"), 4), _steps(c("rs"), 1.05, 0.95), clip((c("rs") - 0.7) / 0.6), F.coalesce(c("common") >= 63, F.lit(False)), "RS vs SPY")
    strength = strength.withField("note", F.when(~rs_known, "no SPY data").when(c("common") < 63, "insufficient overlap").otherwise(_said("RS=%.3f", c("rs"))))
    return [
        _study("MA Stack/Alignment", "trend", stack, _steps(stack, 0.8, 0.2), stack, note=stacked),
        _study("Price vs 200-DMA", "trend", F.bround(pct200, 2), _steps(pct200, 5, -5), clip((pct200 + 30) / 60), 200, note=_said("%.1f%% vs 200-DMA", pct200)),
        _study("MA Slope (50-DMA)", "trend", F.bround(slope, 3), _steps(slope, 0.5, -0.5), clip((slope + 3) / 6), 55, "MA Slope", _said("%.2f%% per 5d", slope)),
        _study("HH/HL Structure", "trend", F.lit(None), _side(hh & hl, ~hh & ~hl), 0.5 * hh.cast("int") + 0.5 * hl.cast("int"), json=F.to_json(F.struct(hh.alias("hh"), hl.alias("hl")))),
        _study("ADX Strength", "trend", F.bround("adx", 1), _side(trending & plus, trending & (c("minus_di") > c("plus_di"))), clip(c("adx") / 50) * F.when(plus, 1).otherwise(-1) * 0.5 + 0.5, 30, note=_said("ADX=%.1f +DI=%.1f -DI=%.1f", c("adx"), c("plus_di"), c("minus_di"))),
        _study("Ichimoku Regime", "trend", F.lit(None), regime, _score_of(regime, 0.8, 0.2), 80, json=F.to_json(F.struct(regime.alias("signal")))),
        _study("12-1m Academic Momentum", "momentum", F.bround(year, 2), _steps(year, 10, -10), clip((year + 50) / 100), 252, note=_said("%.1f%%", year)),
        _study("ROC Multi-Period", "momentum", F.lit(None), _steps(share, 0.75, 0.25), share, 22, note=said_rocs, json=F.to_json(F.struct(*(F.when(c("n") > p, F.bround(change(x), 4)).alias(k) for k, (p, x) in rocs.items())))),
        _study("RSI", "momentum", F.bround("rsi", 1), _side(c("rsi") > 50, c("rsi") < 50), c("rsi") / 100, 20, note=note),
        _study("MACD State", "momentum", F.bround("macd_hist", 4), hist, _score_of(hist, 0.7, 0.3), 35, note=F.when(c("macd_hist") > c("hist_1"), "histogram=rising").otherwise("histogram=falling")),
        _study("52w High Proximity", "momentum", F.bround(off, 2), _steps(off, -5, -20), clip(1 + off / 50), note=_said("%.1f%% off 52w high", off)),
        strength,
        _study("Donchian 52w Breakout", "breakout", F.lit(None), channel, _score_of(channel, 0.8, 0.2), 55, json=F.to_json(F.struct(F.bround(close, 2).alias("close"), F.bround(upper, 2).alias("upper")))),
        _study("Volume-Confirmed Breakout", "breakout", F.lit(None), burst, F.when(burst == "bull", 0.85).when(burst == "neutral", 0.5).otherwise(0.3), 22, json=F.to_json(F.struct(high.alias("new_high"), surge.alias("vol_surge")))),
        _study("% Above 200-DMA", "extension", F.bround(pct200, 2), stretched, clip(1 - pct200 / 80), 200, note=extended),
        _study("Bollinger %B", "extension", F.bround(band, 3), F.when(band > 1, "bear").when(band < 0, "bull").otherwise(_steps(band, 0.5, 0.2)), clip(band), 25, note=banded),
        _study("ATR Distance from MA50", "extension", F.bround(far, 2), _side(far < -2, far > 3), clip(1 - far / 5), 55, note=_said("%.1f ATRs from 50-DMA", far)),
        _study("RSI Overbought Streak", "extension", hot, F.when(hot >= 7, "bear").otherwise("neutral"), clip(1 - hot / 10), 20, note=F.concat(whole(hot), F.lit("/10 days RSI>70"))),
        _study("Volatility Regime (ATR %ile)", "volatility", F.bround(vol, 3), _side(vol < 0.3, vol > 0.8), 1 - vol, 60, "Volatility Regime", _said("%.0fth percentile vol", vol * 100)),
        _study("Drawdown from ATH", "volatility", F.bround(fall, 2), _side(fall > -10, fall < -30), clip(1 + fall / 50), note=_said("%.1f%% from ATH", fall)),
        _study("OBV Trend", "volume", F.bround(flow, 4), _steps(flow, 0.05, -0.05), clip((flow + 0.2) / 0.4), 22),
        _study("Chaikin Money Flow", "volume", F.bround("cmf", 4), _steps(c("cmf"), 0.05, -0.05), clip(c("cmf") + 0.5), 22),
        _study("Hurst Exponent", "statistical", F.bround(h, 3), _side(h > 0.6, h < 0.4), clip((h - 0.2) / 0.6), (c("n") >= 50) & h.isNotNull(), note=wandering),
        _study("Momentum Persistence (AC1)", "statistical", F.bround("ac1", 4), _steps(c("ac1"), 0.05, -0.05), clip((c("ac1") + 0.3) / 0.6), 30, "Momentum Persistence"),
        _study("R/R to Support", "risk_of_entry", F.bround(rr, 2), F.when(rr >= 2, "bull").when(rr < 1, "bear").otherwise("neutral"), F.coalesce(clip((rr - 0.5) / 3.5), F.lit(0.5)), 22, note=stopped),
    ]


def _error(name: str, message: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(name).alias("study"), F.lit("error").alias("group"), none.cast("double").alias("value"), none.cast("string").alias("value_json"),
        F.lit("neutral").alias("signal"), F.lit(0.5).alias("score"), F.concat(F.lit("error: "), message).alias("note"),
    )


RAISED = "raised while it ran"


def _guarded(study: Column) -> Column:
    """The study; null on rows where it raises, in whatever part of it.

    ``try_to_binary`` answers null to anything that its argument raises. The argument stands inside a lambda, as Spark
    evaluates parts that columns have in common ahead of them, outside of the guard, but none of a lambda's. A study that
    is null itself is an empty object on the way, and no failure.
    """
    packed = F.to_json(F.struct(study.cast(STUDY).alias("s")))
    tried = F.element_at(F.transform(F.array(F.lit(0)), lambda _: F.try_to_binary(packed, F.lit("utf-8"))), 1)
    return F.from_json(F.decode(tried, "utf-8"), f"s {STUDY}")


def _checked(one: DataFrame, study: Column, place: int) -> Column:
    """The study, or its error row where it can't be evaluated: on these columns, or on a row's values."""
    try:
        one.select(_guarded(study))
    except AnalysisException as e:
        return _error(f"study {place}", F.lit(str(e).split("\n")[0])).cast(STUDY)
    got = _guarded(study)
    return F.when(got.isNotNull(), got["s"]).otherwise(_error(f"study {place}", F.lit(RAISED)).cast(STUDY))


def reasons(bars: DataFrame, which: list[Column], bench: DataFrame | None = None) -> dict[int, str]:
    """By place in which, what a study that raises says on the first instrument on which it does: a job for each such study."""
    one, said = facts(bars, bench), {}
    for place, study in enumerate(which):
        try:
            row = one.where(_guarded(study).isNull()).orderBy(KEY).limit(1).select(KEY).first()
            if row:
                one.where(F.col(KEY) == row[0]).select(study.cast(STUDY)).collect()
        except PySparkException as e:
            said[place] = str(e).split("\n")[0]
    return said


Study = Callable[[pd.DataFrame], dict]


def python_studies(bars: DataFrame, which: dict[str, Study], first: int = 0) -> DataFrame:
    """Rows of studies that are functions of one instrument's bars in time order: they give a dict of group, value (or
    value_json), signal, score and note. One that raises gives its error row, and the next goes on."""
    kind = bars.schema[KEY].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME, kind="stable").reset_index(drop=True)
        rows = []
        for place, (name, f) in enumerate(which.items(), first):
            empty = {"value": None, "value_json": None, "signal": "neutral", "score": 0.5, "note": ""}
            try:
                got = empty | f(frame)
                got["score"], got["value"] = float(got["score"]), None if got["value"] is None else float(got["value"])
            except Exception as e:  # noqa: BLE001
                got = empty | {"group": "error", "note": f"error: {e}"}
            rows.append({KEY: frame[KEY].iat[0], "place": place, "study": name} | {"group": ""} | got)
        return pd.DataFrame(rows)[[KEY, "place", "study", "group", "value", "value_json", "signal", "score", "note"]]

    return bars.groupBy(KEY).applyInPandas(run, f"{KEY} {kind}, place int, study string, group string, value double, value_json string, signal string, score double, note string")


def studies(bars: DataFrame, bench: DataFrame | None = None, which: list[Column] | None = None, more: dict[str, Study] | None = None) -> DataFrame:
    """25 rows an instrument: study, group, value or value_json, signal, score, note; which: other expressions instead, each
    under its guard, more: Python functions besides."""
    one = facts(bars, bench)
    own = registry(bench is not None) if which is None else [_checked(one, s, k) for k, s in enumerate(which)]
    got = one.select(KEY, F.posexplode(F.array(*(s.cast(STUDY) for s in own))).alias("place", "s")).select(KEY, "place", "s.*")
    return got if not more else got.unionByName(python_studies(bars, more, len(own)))


def _share(signal: str, groups: tuple[str, ...], empty: float) -> Column:
    inside = F.col("group").isin(*groups)
    return F.coalesce(F.bround(ratio(F.sum(F.when(inside & (F.col("signal") == signal), 1).otherwise(0)).cast("double"), F.sum(inside.cast("int")).cast("double")), 3), F.lit(empty))


def report(results: DataFrame) -> DataFrame:
    """One row an instrument: scores, regime and shares of signals, from the rounded study values."""
    value = lambda name: F.max(F.when(F.col("study") == name, F.col("value")))
    n = F.count("*")
    got = results.groupBy(KEY).agg(
        _share("bull", ("trend", "momentum", "relative_strength", "breakout", "statistical"), 0.5).alias("momentum_intact_score"),
        _share("bear", ("extension",), 0.0).alias("extension_score"),
        F.bround(F.count(F.when(F.col("signal") == "bull", 1)) / n * 100, 1).alias("bull_pct"),
        F.bround(F.count(F.when(F.col("signal") == "bear", 1)) / n * 100, 1).alias("bear_pct"),
        n.alias("n_studies"),
        F.coalesce(value("ADX Strength"), F.lit(20.0)).alias("_adx"),
        F.coalesce(value("Hurst Exponent"), F.lit(0.5)).alias("_hurst"),
        F.coalesce(value("Volatility Regime (ATR %ile)"), F.lit(0.5)).alias("_vol"),
    )
    regime = F.when((F.col("_adx") > 25) & (F.col("_hurst") > 0.55), "trending").when(F.col("_vol") > 0.75, "high_volatility").when(F.col("_hurst") < 0.45, "mean_reverting").otherwise("range_bound")
    return got.withColumn("regime", regime).drop("_adx", "_hurst", "_vol")


def listing(results: DataFrame) -> DataFrame:
    """Studies by group, and bull before bear before neutral within it."""
    rank = F.when(F.col("signal") == "bull", 0).when(F.col("signal") == "bear", 2).otherwise(1)
    return results.withColumn("signal_rank", rank).orderBy(KEY, "group", "signal_rank", "study")
