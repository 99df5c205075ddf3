"""Technical indicators on bars (instrument_id, ts, open, high, low, close, volume): each adds its columns.

All share one window specification, so several in a row cost one shuffle and one sort. Recursive means come
from :mod:`candlewick.operators.ewm`; the parabolic SAR is the one true state machine.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from candlewick.functions.windows import KEY, TIME, chunked, last, ordered, prev, ratio, roll, running, sofar, with_leads
from candlewick.operators.ewm import affine_scan, ewm
from candlewick.sources.shared import kept


def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


# ---- trend


def sma(df: DataFrame, p: int = 20, x: str = "close", out: str = "sma") -> DataFrame:
    return df.withColumn(out, roll(F.avg, x, p))


def ema(df: DataFrame, p: int = 20, x: str = "close", out: str = "ema") -> DataFrame:
    return ewm(df, (x, 2 / (p + 1), out))


def wma(df: DataFrame, p: int = 20, x: str = "close", out: str = "wma") -> DataFrame:
    """Weights 1 to p, the newest the heaviest."""
    total = sum(((p - k) * F.coalesce(prev(x, k), F.lit(0.0)) for k in range(1, p)), p * F.col(x))
    return df.withColumn(out, F.when(F.count(x).over(last(p)) == p, total / (p * (p + 1) / 2)))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    got = ewm(df, ("close", 2 / (fast + 1), "_fast"), ("close", 2 / (slow + 1), "_slow"), (lambda f: f["_fast"] - f["_slow"], 2 / (signal + 1), "macd_signal"))
    return got.withColumn("macd", F.col("_fast") - F.col("_slow")).withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def macd_chunked(df: DataFrame, chunk: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """The same for series too long for one task, as are the other ``_chunked`` ones; chunk: of a row's time."""
    got = affine_scan(df, [("close", 2 / (fast + 1), "_fast"), ("close", 2 / (slow + 1), "_slow")], chunk).withColumn("macd", F.col("_fast") - F.col("_slow"))
    return affine_scan(got, [("macd", 2 / (signal + 1), "macd_signal")], chunk).withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def true_range(df: DataFrame, out: str = "tr") -> DataFrame:
    """The first row has high - low."""
    pc = prev("close")
    return df.withColumn(out, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


def adx(df: DataFrame, p: int = 14) -> DataFrame:
    """adx, plus_di and minus_di with span means; the minus movement is held against the plus movement as filtered."""
    moved, a = _movements(df), 2 / (p + 1)

    def dx(f: pd.DataFrame) -> pd.Series:
        plus, minus = 100 * f["_p"] / f["_t"], 100 * f["_m"] / f["_t"]
        return 100 * (plus - minus).abs() / (plus + minus).replace(0, float("nan"))

    got = ewm(moved, ("_tr", a, "_t"), ("_pdm", a, "_p"), ("_mdm", a, "_m"), (dx, a, "adx"))
    return _sides(got).drop("_tr", "_pdm", "_mdm", "_t", "_p", "_m")


def _movements(df: DataFrame) -> DataFrame:
    up, down = F.col("high") - prev("high"), prev("low") - F.col("low")
    moved = true_range(df, "_tr").withColumn("_pdm", F.when((up > down) & (up > 0), up).otherwise(0.0))
    return moved.withColumn("_mdm", F.when((down > F.col("_pdm")) & (down > 0), down).otherwise(0.0))


def _sides(df: DataFrame) -> DataFrame:
    di = lambda c: 100 * ratio(F.col(c), F.col("_t"))
    return df.withColumn("plus_di", di("_p")).withColumn("minus_di", di("_m"))


def adx_chunked(df: DataFrame, chunk: Column, p: int = 14) -> DataFrame:
    a = 2 / (p + 1)
    got = _sides(affine_scan(chunked(df, _movements, chunk, 1), [("_tr", a, "_t"), ("_pdm", a, "_p"), ("_mdm", a, "_m")], chunk))
    got = got.withColumn("_dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return affine_scan(got, [("_dx", a, "adx")], chunk).drop("_tr", "_pdm", "_mdm", "_t", "_p", "_m", "_dx")


State = tuple[bool, float, float, float]  # of the parabolic SAR: rising, speed, the stop and the extreme


def sar_from(high: list[float], low: list[float], state: State | None, first: int, step: float, most: float) -> tuple[list[float], State]:
    """The stops from row ``first`` on, given the state behind the row before it, and the state behind the last row.

    Without a state the series starts at ``first``: rising from its high, with its low as the extreme.
    """
    out = []
    if state is None:
        state, out, first = (True, step, high[first], low[first]), [high[first]], first + 1
    rising, speed, sar, extreme = state
    for i in range(first, len(high)):
        sar += speed * (extreme - sar)
        back = range(max(i - 2, 0), i)
        sar = min([sar, *(low[k] for k in back)]) if rising else max([sar, *(high[k] for k in back)])
        if (low[i] < sar) if rising else (high[i] > sar):
            rising, sar, speed = not rising, extreme, step
            extreme = high[i] if rising else low[i]
        elif (high[i] > extreme) if rising else (low[i] < extreme):
            extreme, speed = high[i] if rising else low[i], min(speed + step, most)
        out.append(sar)
    return out, (rising, speed, sar, extreme)


def sar_of(high: list[float], low: list[float], step: float, most: float) -> list[float]:
    """Parabolic SAR: starts rising from the first high with the first low as its extreme."""
    return sar_from(high, low, None, 0, step, most)[0]


def parabolic_sar(df: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME, kind="stable").reset_index(drop=True)
        frame["sar"] = sar_of(frame["high"].tolist(), frame["low"].tolist(), step, most)
        return frame

    return df.groupBy(KEY).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField("sar", T.DoubleType())]))


SAR_STATE = "rising boolean, speed double, stop double, extreme double"


def parabolic_sar_chunked(df: DataFrame, chunk: Column, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """The same for series too long for one task, whose state no chunk knows ahead.

    At first each chunk runs as if the series began with it. Then each runs again from the state in which the chunk before it
    has ended, until no chunk ends otherwise than before. Turns make different states meet, so a chunk's end hardly depends on
    its start and a round or two are enough; a round that changes nothing proves all states, whatever their number. Rounds pass
    on one small row a chunk.
    """
    led = kept(with_leads(df, chunk, 2), "sar")
    kind = led.schema[KEY].dataType.simpleString()
    chunks = led.where("not _lead").groupBy("_own", "_chunk", KEY).agg(F.min("_place").alias("_from"))
    before = F.lag(KEY).over(Window.partitionBy("_own").orderBy("_chunk"))
    chunks = kept(chunks.select(F.col(KEY).alias("name"), before.alias("follows")), "chunks")

    def walked(frame: pd.DataFrame, starts: pd.DataFrame) -> tuple[pd.DataFrame, list[float], State]:
        frame = frame.sort_values(TIME, kind="stable").reset_index(drop=True)
        known = len(starts) and not pd.isna(starts["speed"].iat[0])
        state = tuple(starts[["rising", "speed", "stop", "extreme"]].iloc[0]) if known else None
        lead = int(frame["_lead"].sum())
        return frame, *sar_from(frame["high"].tolist(), frame["low"].tolist(), state, lead, step, most)

    def end(frame: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        _, _, state = walked(frame, starts)
        return pd.DataFrame([(frame[KEY].iat[0], *state)], columns=["name", "rising", "speed", "stop", "extreme"])

    def rows(frame: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        frame, stops, _ = walked(frame, starts)
        return frame[~frame["_lead"].astype(bool)].assign(sar=stops)

    def starts_of(ends: DataFrame) -> DataFrame:
        """The state in which each chunk starts; null for a series' first."""
        return chunks.join(ends.withColumnRenamed("name", "follows"), "follows", "left").select("name", "rising", "speed", "stop", "extreme")

    def met(starts: DataFrame, what, schema) -> DataFrame:
        return led.groupBy(KEY).cogroup(starts.groupBy("name")).applyInPandas(what, schema)

    nothing = chunks.select("name", *(F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in SAR_STATE.split(", "))))
    ends = kept(met(nothing, end, f"name {kind}, {SAR_STATE}"), "ends")
    while True:
        again = kept(met(starts_of(ends), end, f"name {kind}, {SAR_STATE}"), "ends")
        if not again.exceptAll(ends).limit(1).count():
            break
        ends = again
    done = met(starts_of(ends), rows, T.StructType([*led.schema.fields, T.StructField("sar", T.DoubleType())]))
    return done.withColumn(KEY, F.col("_own")).drop("_own", "_chunk", "_place", "_lead")


def ichimoku(df: DataFrame, conversion: int = 9, base: int = 26, span: int = 52, shift: int = 26) -> DataFrame:
    """chikou looks ahead by design; it is not for signals."""
    mid = lambda p: (roll(F.max, "high", p) + roll(F.min, "low", p)) / 2
    got = df.withColumn("tenkan", mid(conversion)).withColumn("kijun", mid(base)).withColumn("_b", mid(span)).withColumn("_a", (F.col("tenkan") + F.col("kijun")) / 2)
    return got.withColumn("senkou_a", prev("_a", shift)).withColumn("senkou_b", prev("_b", shift)).withColumn("chikou", F.lead("close", shift).over(ordered())).drop("_a", "_b")


def golden_cross(df: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """1 where the fast mean rises above the slow one, -1 where it falls below; too few bars count as below."""
    above = F.coalesce(roll(F.avg, "close", fast) > roll(F.avg, "close", slow), F.lit(False)).cast("int")
    return df.withColumn("_above", above).withColumn("cross", F.coalesce(F.col("_above") - prev("_above"), F.lit(0))).drop("_above")


# ---- momentum


def rsi(df: DataFrame, p: int = 14, out: str = "rsi") -> DataFrame:
    """50 on the first row; without losses 100 if there were gains, else 50."""
    return _strength(ewm(_gains(df), ("_g", 1 / p, "_ag"), ("_l", 1 / p, "_al")), out)


def _gains(df: DataFrame) -> DataFrame:
    d = F.col("close") - prev("close")
    return df.withColumn("_g", F.greatest(d, F.lit(0.0)) + d * 0).withColumn("_l", F.greatest(-d, F.lit(0.0)) + d * 0)


def _strength(df: DataFrame, out: str) -> DataFrame:
    value = F.when(F.col("_al") > 0, 100 - 100 / (1 + ratio(F.col("_ag"), F.col("_al")))).when(F.col("_ag") > 0, 100.0).otherwise(50.0)
    return df.withColumn(out, value).drop("_g", "_l", "_ag", "_al")


def rsi_chunked(df: DataFrame, chunk: Column, p: int = 14, out: str = "rsi") -> DataFrame:
    return _strength(affine_scan(chunked(df, _gains, chunk, 1), [("_g", 1 / p, "_ag"), ("_l", 1 / p, "_al")], chunk), out)


def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    high, low = roll(F.max, "high", k), roll(F.min, "low", k)
    return df.withColumn("stoch_k", 100 * ratio(F.col("close") - low, high - low)).withColumn("stoch_d", roll(F.avg, "stoch_k", d))


def williams_r(df: DataFrame, p: int = 14) -> DataFrame:
    high, low = roll(F.max, "high", p), roll(F.min, "low", p)
    return df.withColumn("williams_r", -100 * ratio(high - F.col("close"), high - low))


def roc(df: DataFrame, p: int = 10) -> DataFrame:
    return df.withColumn("roc", 100 * (ratio(F.col("close"), prev("close", p)) - 1))


def cci(df: DataFrame, p: int = 20) -> DataFrame:
    """Deviations are about the window's own mean; null where there are none."""
    got = df.withColumn("_tp", _typical()).withColumn("_m", roll(F.avg, "_tp", p)).withColumn("_a", F.collect_list("_tp").over(last(p)))
    off = F.aggregate("_a", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_m"))) / p
    return got.withColumn("cci", ratio(F.col("_tp") - F.col("_m"), 0.015 * off)).drop("_tp", "_m", "_a")


def tsi(df: DataFrame, slow: int = 25, fast: int = 13) -> DataFrame:
    moved = df.withColumn("_d", F.col("close") - prev("close")).withColumn("_abs", F.abs("_d"))
    a, b = 2 / (slow + 1), 2 / (fast + 1)
    got = ewm(moved, ("_d", a, "_d1"), ("_d1", b, "_d2"), ("_abs", a, "_a1"), ("_a1", b, "_a2"))
    return got.withColumn("tsi", 100 * ratio(F.col("_d2"), F.col("_a2"))).drop("_d", "_abs", "_d1", "_d2", "_a1", "_a2")


def tsi_chunked(df: DataFrame, chunk: Column, slow: int = 25, fast: int = 13) -> DataFrame:
    moved = chunked(df, lambda b: b.withColumn("_d", F.col("close") - prev("close")), chunk, 1).withColumn("_abs", F.abs("_d"))
    a, b = 2 / (slow + 1), 2 / (fast + 1)
    got = affine_scan(affine_scan(moved, [("_d", a, "_d1"), ("_abs", a, "_a1")], chunk), [("_d1", b, "_d2"), ("_a1", b, "_a2")], chunk)
    return got.withColumn("tsi", 100 * ratio(F.col("_d2"), F.col("_a2"))).drop("_d", "_abs", "_d1", "_d2", "_a1", "_a2")


# ---- volatility


def bollinger(df: DataFrame, p: int = 20, width: float = 2.0) -> DataFrame:
    """Population deviation."""
    got = df.withColumn("bb_mid", roll(F.avg, "close", p)).withColumn("_s", roll(F.stddev_pop, "close", p))
    got = got.withColumn("bb_upper", F.col("bb_mid") + width * F.col("_s")).withColumn("bb_lower", F.col("bb_mid") - width * F.col("_s"))
    span = F.col("bb_upper") - F.col("bb_lower")
    return got.withColumn("bb_pct", ratio(F.col("close") - F.col("bb_lower"), span)).withColumn("bb_width", ratio(span, F.col("bb_mid"))).drop("_s")


def atr(df: DataFrame, p: int = 14, out: str = "atr") -> DataFrame:
    return ewm(true_range(df, "_tr"), ("_tr", 2 / (p + 1), out)).drop("_tr")


def atr_chunked(df: DataFrame, chunk: Column, p: int = 14, out: str = "atr") -> DataFrame:
    return affine_scan(chunked(df, lambda b: true_range(b, "_tr"), chunk, 1), [("_tr", 2 / (p + 1), out)], chunk).drop("_tr")


def keltner_chunked(df: DataFrame, chunk: Column, p: int = 20, width: float = 2.0) -> DataFrame:
    a = 2 / (p + 1)
    return _channel(affine_scan(chunked(df, lambda b: true_range(b, "_tr"), chunk, 1), [("close", a, "kc_mid"), ("_tr", a, "_atr")], chunk), width)


def _channel(df: DataFrame, width: float) -> DataFrame:
    return df.withColumn("kc_upper", F.col("kc_mid") + width * F.col("_atr")).withColumn("kc_lower", F.col("kc_mid") - width * F.col("_atr")).drop("_tr", "_atr")


def keltner(df: DataFrame, p: int = 20, width: float = 2.0) -> DataFrame:
    return _channel(ewm(true_range(df, "_tr"), ("close", 2 / (p + 1), "kc_mid"), ("_tr", 2 / (p + 1), "_atr")), width)


def donchian(df: DataFrame, p: int = 20) -> DataFrame:
    return df.withColumn("dc_upper", roll(F.max, "high", p)).withColumn("dc_lower", roll(F.min, "low", p)).withColumn("dc_mid", (F.col("dc_upper") + F.col("dc_lower")) / 2)


def realized_vol(df: DataFrame, p: int = 20, periods: int = 252, out: str = "realized_vol") -> DataFrame:
    got = df.withColumn("_r", F.ln(ratio(F.col("close"), prev("close"))))
    return got.withColumn(out, roll(F.stddev_samp, "_r", p) * F.sqrt(F.lit(float(periods)))).drop("_r")


# ---- volume


def obv(df: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(F.col("close") - prev("close")), F.lit(0.0)) * F.col("volume")
    return df.withColumn("_v", step).withColumn("obv", F.sum("_v").over(sofar())).drop("_v")


def obv_chunked(df: DataFrame, chunk: Column) -> DataFrame:
    """The same for series too long for one task."""
    signed = chunked(df, lambda b: b.withColumn("_v", F.coalesce(F.signum(F.col("close") - prev("close")), F.lit(0.0)) * F.col("volume")), chunk, 1)
    return running(signed, chunk, obv=("sum", F.col("_v"))).drop("_v")


def vwap_chunked(df: DataFrame, chunk: Column) -> DataFrame:
    got = running(df, chunk, _pv=("sum", _typical() * F.col("volume")), _vv=("sum", F.col("volume")))
    return got.withColumn("vwap", ratio(F.col("_pv"), F.col("_vv"))).drop("_pv", "_vv")


def vwap(df: DataFrame) -> DataFrame:
    """From the series' start."""
    return df.withColumn("vwap", ratio(F.sum(_typical() * F.col("volume")).over(sofar()), F.sum("volume").over(sofar())))


def mfi(df: DataFrame, p: int = 14) -> DataFrame:
    """The first row counts as no flow; null without outflow."""
    got = df.withColumn("_tp", _typical()).withColumn("_d", F.col("_tp") - prev("_tp"))
    flow = F.col("_tp") * F.col("volume")
    got = got.withColumn("_in", F.when(F.col("_d") > 0, flow).otherwise(0.0)).withColumn("_out", F.when(F.col("_d") < 0, flow).otherwise(0.0))
    return got.withColumn("mfi", 100 - ratio(F.lit(100.0), 1 + ratio(roll(F.sum, "_in", p), roll(F.sum, "_out", p)))).drop("_tp", "_d", "_in", "_out")


def _flow() -> Column:
    """Where the close lies between low and high, -1 to 1, times the volume; null where they are equal."""
    return ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low")) * F.col("volume")


def accumulation(df: DataFrame) -> DataFrame:
    got = df.withColumn("_f", _flow())
    return got.withColumn("ad_line", F.when(F.col("_f").isNotNull(), F.sum("_f").over(sofar()))).drop("_f")


def chaikin(df: DataFrame, p: int = 20) -> DataFrame:
    got = df.withColumn("_f", _flow())
    return got.withColumn("cmf", ratio(roll(F.sum, "_f", p), roll(F.sum, "volume", p))).drop("_f")


def recursive_set(df: DataFrame) -> DataFrame:
    """rsi, MACD histogram, ADX with its sides, and ATR in one pass over each instrument, for the studies."""
    d, pc = F.col("close") - prev("close"), prev("close")
    up, down = F.col("high") - prev("high"), prev("low") - F.col("low")
    moved = (
        df.withColumn("_g", F.greatest(d, F.lit(0.0)) + d * 0)
        .withColumn("_l", F.greatest(-d, F.lit(0.0)) + d * 0)
        .withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))
        .withColumn("_pdm", F.when((up > down) & (up > 0), up).otherwise(0.0))
        .withColumn("_mdm", F.when((down > F.col("_pdm")) & (down > 0), down).otherwise(0.0))
    )

    def dx(f: pd.DataFrame) -> pd.Series:
        return 100 * (f["_p"] - f["_m"]).abs() / (f["_p"] + f["_m"]).replace(0, float("nan"))

    a = 2 / 15
    got = ewm(
        moved,
        ("_g", 1 / 14, "_ag"), ("_l", 1 / 14, "_al"), ("close", 2 / 13, "_fast"), ("close", 2 / 27, "_slow"),
        (lambda f: f["_fast"] - f["_slow"], 2 / 10, "_signal"), ("_tr", a, "atr"), ("_pdm", a, "_p"), ("_mdm", a, "_m"), (dx, a, "adx"),
    )
    return (
        got.withColumn("rsi", F.when(F.col("_al") > 0, 100 - 100 / (1 + ratio(F.col("_ag"), F.col("_al")))).when(F.col("_ag") > 0, 100.0).otherwise(50.0))
        .withColumn("macd_hist", F.col("_fast") - F.col("_slow") - F.col("_signal"))
        .withColumn("plus_di", 100 * ratio(F.col("_p"), F.col("atr")))
        .withColumn("minus_di", 100 * ratio(F.col("_m"), F.col("atr")))
        .drop("_g", "_l", "_tr", "_pdm", "_mdm", "_ag", "_al", "_fast", "_slow", "_signal", "_p", "_m")
    )
