"""All market queries by name, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.jobs import frames as f
from candlewick.jobs import loads, study_sql
from candlewick.jobs import studies as S
from candlewick.functions.tails import phi_inv
from candlewick.functions.windows import chunked
from candlewick.operators import backtest as bt
from candlewick.operators import bars as B
from candlewick.operators import ewm as E
from candlewick.operators import indicators as ind
from candlewick.operators import lagged as L
from candlewick.operators import lookups as look
from candlewick.operators import metrics as M
from candlewick.operators import returns as R
from candlewick.operators import runs
from candlewick.operators import selection
from candlewick.operators import tsstats as TS
from candlewick.operators import validation as V
from candlewick.operators import writes as W
from candlewick.sources.shared import kept

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}
ID = ["instrument_id", "ts"]


def _add(name: str, query: Callable, sql: str | None = None) -> None:
    _queries[name] = query
    if sql is not None:
        _sql[name] = sql


def _rounded(df: DataFrame, digits: int, *keep: str) -> DataFrame:
    """keep (all without it) with doubles rounded, as both sides of a comparison are."""
    df = df.select(*keep) if keep else df
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# ---- pieces of SQL


def _sel(items: dict[str, str], digits: int = 6, source: str = "bars", keys: str = "instrument_id, ts", with_: str = f.BARS, more: str = "") -> str:
    """Rounded expressions over windows of a source."""
    return f"WITH {with_} SELECT {keys}, " + ", ".join(f"round({x}, {digits}) AS {n}" for n, x in items.items()) + f" FROM {source} {more} WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)"


def _frame(p: int) -> str:
    return f"OVER (PARTITION BY instrument_id ORDER BY ts ROWS {p - 1} PRECEDING)"


def _roll(agg: str, x: str, p: int) -> str:
    return f"CASE WHEN count({x}) {_frame(p)} = {p} THEN {agg}({x}) {_frame(p)} END"


RUN = "OVER (PARTITION BY instrument_id ORDER BY ts ROWS UNBOUNDED PRECEDING)"
TP = "((high + low + close) / 3)"
LR = "lr AS (SELECT *, ln(close / lag(close) OVER w) AS lr, close / lag(close) OVER w - 1 AS sr FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY ts))"


def _ewm(out: str, source: str, x: str, a: float) -> str:
    """CTE ``out`` (instrument_id, ts, y): the mean in closed form; terms below 1e-18 are left out."""
    far = int(42 / -math.log(1 - a)) + 2
    return f"""{out}_n AS (SELECT instrument_id, ts, {x} AS x, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) AS i FROM {source} WHERE ({x}) IS NOT NULL),
    {out} AS (SELECT t.instrument_id, t.ts, sum(CASE WHEN s.i = 1 THEN 1 ELSE {a!r} END * pow({1 - a!r}, t.i - s.i) * s.x) AS y
      FROM {out}_n t JOIN {out}_n s ON t.instrument_id = s.instrument_id AND s.i <= t.i AND s.i > t.i - {far} GROUP BY 1, 2)"""


# ---- sources of bars, reads


def _flagship(s, d):
    return S.report(S.studies(f.daily_bars(s, d), f.bench(s, d)))


flagship = _flagship

for _w, _i in (("5m", "5 minutes"), ("15m", "15 minutes"), ("1h", "1 hour"), ("4h", "4 hours"), ("1d", "1 day")):
    _add(
        f"r1_bars_{_w}" if _w != "1d" else "r2_bars_1d",
        (lambda w: lambda s, d: _rounded(B.rollup(f.minutes(s, d), w) if w != "1d" else B.daily(f.minutes(s, d)), 4))(_w),
        f"WITH {f.MINUTES} SELECT instrument_id, {'CAST(time_bucket(INTERVAL ' + repr(_i) + ', ts) AS DATE)' if _w == '1d' else 'time_bucket(INTERVAL ' + repr(_i) + ', ts)'} AS ts, round(arg_min(open, minutes.ts), 4) AS open, round(max(high), 4) AS high, round(min(low), 4) AS low, round(arg_max(close, minutes.ts), 4) AS close, "
        + ("CAST(NULL AS DOUBLE) AS adj_close, " if _w == "1d" else "")
        + f"sum(volume) AS volume, round(sum(quote_volume), 4) AS quote_volume, sum(trades)::{'INT' if _w == '1d' else 'BIGINT'} AS trades FROM minutes GROUP BY 1, 2",
    )
_add("s10_daily_bars", lambda s, d: _rounded(f.daily_bars(s, d), 8), f"WITH {f.BARS} SELECT instrument_id, ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume, quote_volume, trades FROM bars")
_add(
    "r3_quality_minutes",
    lambda s, d: B.quality(f.minutes(s, d), True),
    f"WITH {f.MINUTES} SELECT instrument_id, count(*) AS total, min(ts) AS first_ts, max(ts) AS last_ts, (epoch(max(ts)) - epoch(min(ts)))::BIGINT // 60 + 1 AS expected, (epoch(max(ts)) - epoch(min(ts)))::BIGINT // 60 + 1 - count(*) AS missing FROM minutes GROUP BY 1",
)
_add("r4_quality_daily", lambda s, d: B.quality(f.daily_bars(s, d), False), f"WITH {f.BARS} SELECT instrument_id, count(*) AS total, min(ts) AS first_ts, max(ts) AS last_ts, CAST(NULL AS BIGINT) AS expected, CAST(NULL AS BIGINT) AS missing FROM bars GROUP BY 1")
_add(
    "a10_coverage",
    lambda s, d: B.coverage(B.quality(f.minutes(s, d), True)).select("instrument_id", "coverage_pct"),
    f"WITH {f.MINUTES}, q AS (SELECT instrument_id, count(*) AS n, (epoch(max(ts)) - epoch(min(ts)))::BIGINT // 60 + 1 AS e FROM minutes GROUP BY 1) SELECT instrument_id, round(n / e * 100, 1) AS coverage_pct FROM q",
)
SERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "none"]


def _names(df: DataFrame, digits: int) -> DataFrame:
    got = _rounded(df.select(*ID, *(F.col(f"`{n}`").alias(f"m{i}") for i, n in enumerate(SERIES)), F.col("close").cast("string").alias("c")), digits)
    return got.withColumn("close", F.round(F.col("c").cast("double"), 8)).drop("c")


_add(
    "r5_aligned_macro",
    lambda s, d: _names(B.align(f.daily_bars(s, d), f.macro(s, d), SERIES), 5),
    f"WITH {f.BARS}, {f.MACRO}, wide AS (SELECT ts AS day, " + ", ".join(f"max(value) FILTER (series_id = '{n}') AS v{i}" for i, n in enumerate(SERIES)) + " FROM macro GROUP BY 1) SELECT instrument_id, ts, round(close, 8) AS close, "
    + ", ".join(f"round(last_value(v{i} IGNORE NULLS) {RUN}, 5) AS m{i}" for i in range(len(SERIES))) + " FROM bars LEFT JOIN wide ON ts = day",
)
PAIR = "pair AS (SELECT a.instrument_id, a.ts, a.close AS a, b.close AS b FROM bars a JOIN bars b ON a.ts = b.ts WHERE b.instrument_id = 1)"
_pair = lambda s, d: B.pair(f.daily_bars(s, d), f.bench(s, d))
_add("r6_pair", lambda s, d: _rounded(_pair(s, d), 8), f"WITH {f.BARS}, {PAIR} SELECT instrument_id, ts, round(a, 8) AS a, round(b, 8) AS b FROM pair")
_add("a1_instruments", lambda s, d: look.instruments(f.instrument(s, d), "crypto"), f"WITH {f.INSTRUMENT} SELECT * FROM instrument WHERE active AND asset_class = 'crypto'")


_add(
    "a2_resolved_symbols",
    lambda s, d: look.resolve(f.table(s, d, "nation").select(F.col("n_name").alias("symbol")), f.instrument(s, d))[0],
    f"WITH {f.INSTRUMENT} SELECT symbol, instrument_id, native_granularity, asset_class FROM instrument WHERE active",
)
_add("a2_unknown_symbols", lambda s, d: look.resolve(f.table(s, d, "nation").select(F.col("n_name").alias("symbol")), f.instrument(s, d))[1], f"WITH {f.INSTRUMENT} SELECT symbol FROM instrument WHERE NOT active")
_add(
    "a3_bars_in_range",
    lambda s, d: _rounded(look.get_bars({"1d": f.daily_bars(s, d)}, "1d", "1995-01-01", "1995-12-31"), 8),
    f"WITH {f.BARS} SELECT instrument_id, ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume FROM bars WHERE ts BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'",
)


def _granularity(s, d):
    i = f.instrument(s, d)
    return look.granularity(i.select("instrument_id", F.explode(F.array(*map(F.lit, ("1h", "1d", "2w")))).alias("timeframe")), i)


_add("a4_granularity", _granularity, f"WITH {f.INSTRUMENT} SELECT instrument_id, timeframe, native_granularity, timeframe <> '2w' AND (native_granularity = '1m' OR timeframe = '1d') AS served FROM instrument, (VALUES ('1h'), ('1d'), ('2w')) v(timeframe)")
_add("a5_latest", lambda s, d: look.latest(f.minutes(s, d), f.daily_bars(s, d)), f"WITH {f.BARS}, {f.MINUTES} SELECT instrument_id, max(ts) AS latest_ts FROM (SELECT instrument_id::BIGINT AS instrument_id, ts FROM minutes UNION ALL SELECT instrument_id, ts::TIMESTAMP FROM bars) GROUP BY 1")
_add("a6_macro", lambda s, d: _rounded(look.get_macro(f.macro(s, d), "2-HIGH", "1994-01-01", "1996-06-30"), 4), f"WITH {f.MACRO} SELECT series_id, ts, round(value, 4) AS value FROM macro WHERE series_id = '2-HIGH' AND ts BETWEEN DATE '1994-01-01' AND DATE '1996-06-30'")
_add(
    "a7_chart_bars",
    lambda s, d: _rounded(look.chart_bars(f.daily_bars(s, d), f.instrument(s, d)), 8),
    f"WITH {f.BARS}, {f.INSTRUMENT} SELECT upper(symbol) AS symbol, epoch(ts)::BIGINT AS time, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, coalesce(volume, 0) AS volume, close >= open AS up FROM bars JOIN instrument USING (instrument_id)",
)
_add("a8_chart_macro", lambda s, d: _rounded(look.chart_macro(f.macro(s, d)), 4), f"WITH {f.MACRO} SELECT series_id, epoch(ts)::BIGINT AS time, round(value, 4) AS value FROM macro WHERE value IS NOT NULL")
_add("a9_up_candles", lambda s, d: f.daily_bars(s, d).select(*ID, (F.col("close") >= F.col("open")).alias("up")), f"WITH {f.BARS} SELECT instrument_id, ts, close >= open AS up FROM bars")

# ---- keyed writes, between two halves of the daily bars


def _halves(s, d):
    b = f.daily_bars(s, d)
    old = b.where("year(ts) < 1996")
    new = b.where("year(ts) >= 1995").withColumn("close", F.col("close") + 1)
    return old, new


HALVES = "old AS (SELECT * FROM bars WHERE year(ts) < 1996), new AS (SELECT * REPLACE (close + 1 AS close) FROM bars WHERE year(ts) >= 1995)"
_add("w1_insert_ignore", lambda s, d: _rounded(W.insert_ignore(*_halves(s, d), ID, [F.col("open")]), 8, *ID, "close"), f"WITH {f.BARS}, {HALVES} SELECT instrument_id, ts, round(close, 8) AS close FROM new ANTI JOIN old USING (instrument_id, ts)")
_add(
    "w3_upsert",
    lambda s, d: _rounded(W.upsert(*_halves(s, d), ID, ["open", "high", "low", "close", "volume"]), 8, *ID, "close", "volume"),
    f"WITH {f.BARS}, {HALVES} SELECT instrument_id, ts, round(coalesce(n.close, o.close), 8) AS close, coalesce(n.volume, o.volume) AS volume FROM old o FULL JOIN new n USING (instrument_id, ts)",
)
_add(
    "w4_upsert_some",
    lambda s, d: _rounded(W.upsert(*_halves(s, d), ID, ["volume"]), 8, *ID, "close", "volume"),
    f"WITH {f.BARS}, {HALVES} SELECT instrument_id, ts, round(coalesce(o.close, n.close), 8) AS close, coalesce(n.volume, o.volume) AS volume FROM old o FULL JOIN new n USING (instrument_id, ts)",
)
_add(
    "w9_missing_days",
    lambda s, d: W.missing_days(f.minutes(s, d), "2024-02-05"),
    f"WITH {f.MINUTES}, e AS (SELECT instrument_id, max(ts)::DATE AS last FROM minutes GROUP BY 1) SELECT instrument_id, unnest(generate_series(last + 1, DATE '2024-02-04', INTERVAL 1 day))::DATE AS day FROM e WHERE last < DATE '2024-02-04'",
)


def _log(s, d):
    o = f.table(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error").otherwise("skipped")
    return o.select(F.lit("dump").alias("source"), F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")).alias("symbol"), F.lit("1m").alias("granularity"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"), (F.col("o_orderkey") % 100).cast("long").alias("rows"), status.alias("status"))


LOG = "log AS (SELECT 'S' || (o_custkey % 40) AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS period, o_orderkey % 100 AS rows, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' ELSE 'skipped' END AS status FROM orders)"


def _to_load(s, d):
    symbols = _log(s, d).select("source", "symbol", "granularity").distinct()
    return W.to_load(W.periods(symbols, "1996-05-20", "1996-08-10"), _log(s, d)).select("symbol", "period")


_add(
    "w8_periods_to_load",
    _to_load,
    f"WITH {LOG}, p AS (SELECT strftime(unnest(generate_series(DATE '1996-05-01', DATE '1996-07-01', INTERVAL 1 month)), '%Y-%m') AS period UNION ALL SELECT strftime(unnest(generate_series(DATE '1996-08-01', DATE '1996-08-09', INTERVAL 1 day)), '%Y-%m-%d')), "
    "w AS (SELECT DISTINCT symbol, p.period FROM log, p) SELECT symbol, period FROM w ANTI JOIN (SELECT * FROM log WHERE status = 'ok') USING (symbol, period)",
)
_add("w10_update_summary", lambda s, d: W.summary(_log(s, d)), f"WITH {LOG} SELECT symbol, min(period) AS from_period, sum(rows)::BIGINT AS fetched, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errors FROM log GROUP BY 1")

# ---- indicators


def _ind(name: str, op: Callable[[DataFrame], DataFrame], cols: dict[str, str] | list[str], digits: int = 6, sql: str | None = None) -> None:
    """A query of one indicator on the daily bars; cols: its columns, with their SQL."""
    names = list(cols)
    _add(name, lambda s, d: _rounded(op(f.daily_bars(s, d)), digits, *ID, *names), sql if sql or isinstance(cols, list) else _sel(cols, digits))


W14H, W14L = _roll("max", "high", 14), _roll("min", "low", 14)
_ind("i1_sma", ind.sma, {"sma": _roll("avg", "close", 20)})
_ind("i3_wma", lambda b: ind.wma(b, 10), {"wma": "CASE WHEN count(close) " + _frame(10) + " = 10 THEN (" + " + ".join(f"{10 - k} * lag(close, {k}) OVER w" if k else "10 * close" for k in range(10)) + ") / 55 END"})
_ind("i10_stochastic", ind.stochastic, ["stoch_k", "stoch_d"], 4, f"WITH {f.BARS}, k AS (SELECT instrument_id, ts, 100 * (close - {W14L}) / nullif({W14H} - {W14L}, 0) AS k FROM bars) SELECT instrument_id, ts, round(k, 4) AS stoch_k, round({_roll('avg', 'k', 3)}, 4) AS stoch_d FROM k")
_ind("i11_williams_r", ind.williams_r, {"williams_r": f"-100 * ({W14H} - close) / nullif({W14H} - {W14L}, 0)"}, 4)
_ind("i12_roc", ind.roc, {"roc": "100 * (close / lag(close, 10) OVER w - 1)"}, 4)
_ind(
    "i13_cci", ind.cci, ["cci"], 4,
    f"WITH {f.BARS}, t AS (SELECT instrument_id, ts, {TP} AS tp, list({TP}) {_frame(20)} AS l FROM bars), u AS (SELECT *, list_avg(l) AS m FROM t) SELECT instrument_id, ts, round(CASE WHEN len(l) = 20 THEN (tp - m) / nullif(0.015 * list_avg(list_transform(l, lambda x: abs(x - m))), 0) END, 4) AS cci FROM u",
)
_mid = lambda p: f"(({_roll('max', 'high', p)}) + ({_roll('min', 'low', p)})) / 2"
_ind(
    "i7_ichimoku", ind.ichimoku, ["tenkan", "kijun", "senkou_a", "senkou_b", "chikou"], 8,
    f"WITH {f.BARS}, m AS (SELECT instrument_id, ts, close, {_mid(9)} AS t, {_mid(26)} AS k, {_mid(52)} AS b FROM bars) SELECT instrument_id, ts, round(t, 8) AS tenkan, round(k, 8) AS kijun, round(lag((t + k) / 2, 26) OVER w, 8) AS senkou_a, round(lag(b, 26) OVER w, 8) AS senkou_b, round(lead(close, 26) OVER w, 8) AS chikou FROM m WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)",
)
_ind(
    "i8_golden_cross", ind.golden_cross, ["cross"], 0,
    f"WITH {f.BARS}, a AS (SELECT instrument_id, ts, coalesce(({_roll('avg', 'close', 50)}) > ({_roll('avg', 'close', 200)}), false)::INT AS a FROM bars) SELECT instrument_id, ts, coalesce(a - lag(a) OVER (PARTITION BY instrument_id ORDER BY ts), 0) AS cross FROM a",
)
_sd = _roll("stddev_pop", "close", 20)
_m20 = _roll("avg", "close", 20)
_ind(
    "i15_bollinger", ind.bollinger, ["bb_mid", "bb_upper", "bb_lower", "bb_pct", "bb_width"], 4,
    f"WITH {f.BARS}, s AS (SELECT instrument_id, ts, close, {_m20} AS m, {_sd} AS s FROM bars) SELECT instrument_id, ts, round(m, 4) AS bb_mid, round(m + 2 * s, 4) AS bb_upper, round(m - 2 * s, 4) AS bb_lower, round((close - (m - 2 * s)) / nullif(4 * s, 0), 4) AS bb_pct, round(4 * s / m, 4) AS bb_width FROM s",
)
_ind("i18_donchian", ind.donchian, {"dc_upper": _roll("max", "high", 20), "dc_lower": _roll("min", "low", 20), "dc_mid": f"(({_roll('max', 'high', 20)}) + ({_roll('min', 'low', 20)})) / 2"}, 8)
_vol = f"WITH {f.BARS}, {LR} SELECT instrument_id, ts, round({_roll('stddev_samp', 'lr', 20)} * sqrt(252), 4) AS "
_vol = _vol.replace(f"round({_roll('stddev_samp', 'lr', 20)} *", f"round(({_roll('stddev_samp', 'lr', 20)}) *")
_ind("i19_realized_vol", ind.realized_vol, ["realized_vol"], 4, _vol + "realized_vol FROM lr")
_ind("i20_obv", ind.obv, ["obv"], 4, f"WITH {f.BARS}, d AS (SELECT *, coalesce(sign(close - lag(close) OVER (PARTITION BY instrument_id ORDER BY ts)), 0) * volume AS v FROM bars) SELECT instrument_id, ts, round(sum(v) {RUN}, 4) AS obv FROM d")
_ind("i21_vwap", ind.vwap, {"vwap": f"sum({TP} * volume) {RUN} / nullif(sum(volume) {RUN}, 0)"}, 4)
_ind(
    "i22_mfi", ind.mfi, ["mfi"], 4,
    f"WITH {f.BARS}, t AS (SELECT *, {TP} AS tp, {TP} - lag({TP}) OVER (PARTITION BY instrument_id ORDER BY ts) AS dtp FROM bars), u AS (SELECT *, CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END AS i, CASE WHEN dtp < 0 THEN tp * volume ELSE 0 END AS o FROM t) "
    f"SELECT instrument_id, ts, round(100 - 100 / (1 + ({_roll('sum', 'i', 14)}) / nullif({_roll('sum', 'o', 14)}, 0)), 4) AS mfi FROM u",
)
FLOW = "fl AS (SELECT *, ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS fl FROM bars)"
_ind("i23_accumulation", ind.accumulation, ["ad_line"], 4, f"WITH {f.BARS}, {FLOW} SELECT instrument_id, ts, round(CASE WHEN fl IS NOT NULL THEN sum(fl) {RUN} END, 4) AS ad_line FROM fl")
_ind("i24_chaikin", ind.chaikin, ["cmf"], 4, f"WITH {f.BARS}, {FLOW} SELECT instrument_id, ts, round(({_roll('sum', 'fl', 20)}) / nullif({_roll('sum', 'volume', 20)}, 0), 4) AS cmf FROM fl")

# recursive means
MOVES = """mv AS (SELECT *, close - lag(close) OVER w AS d, greatest(close - lag(close) OVER w, 0) + 0 * lag(close) OVER w AS g, greatest(lag(close) OVER w - close, 0) + 0 * lag(close) OVER w AS l,
  greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
  CASE WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high - lag(high) OVER w > 0 THEN high - lag(high) OVER w ELSE 0 END AS pdm, lag(low) OVER w - low AS dn FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
mm AS (SELECT *, CASE WHEN dn > pdm AND dn > 0 THEN dn ELSE 0 END AS mdm FROM mv)"""
_using = "USING (instrument_id, ts)"
_ind("i2_ema", ind.ema, ["ema"], 4, f"WITH {f.BARS}, {_ewm('e', 'bars', 'close', 2 / 21)} SELECT instrument_id, ts, round(y, 4) AS ema FROM e")
_ind(
    "i4_macd", ind.macd, ["macd", "macd_signal", "macd_hist"], 4,
    f"WITH {f.BARS}, {_ewm('a', 'bars', 'close', 2 / 13)}, {_ewm('b', 'bars', 'close', 2 / 27)}, m AS (SELECT instrument_id, ts, a.y - b.y AS m FROM a JOIN b {_using}), {_ewm('g', 'm', 'm', 2 / 10)} SELECT instrument_id, ts, round(m, 4) AS macd, round(g.y, 4) AS macd_signal, round(m - g.y, 4) AS macd_hist FROM m JOIN g {_using}",
)
ADX = f"{MOVES}, {_ewm('t', 'mm', 'tr', 2 / 15)}, {_ewm('p', 'mm', 'pdm', 2 / 15)}, {_ewm('q', 'mm', 'mdm', 2 / 15)}, di AS (SELECT instrument_id, ts, 100 * p.y / nullif(t.y, 0) AS pdi, 100 * q.y / nullif(t.y, 0) AS mdi FROM t JOIN p {_using} JOIN q {_using}), {_ewm('x', 'di', '100 * abs(pdi - mdi) / nullif(pdi + mdi, 0)', 2 / 15)}"
_ind("i5_adx", ind.adx, ["adx", "plus_di", "minus_di"], 4, f"WITH {f.BARS}, {ADX} SELECT instrument_id, ts, round(x.y, 4) AS adx, round(pdi, 4) AS plus_di, round(mdi, 4) AS minus_di FROM di LEFT JOIN x {_using}")
# bar by bar: the state is the side, the speed, the extreme and the stop
_ind(
    "i6_parabolic_sar", ind.parabolic_sar, ["sar"], 6,
    f"""WITH RECURSIVE {f.BARS}, n AS (SELECT instrument_id, ts, high, low, row_number() OVER w AS i, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
    st AS (SELECT instrument_id, ts, i, true AS up, 0.02::DOUBLE AS af, low AS ep, high AS sar FROM n WHERE i = 1
    UNION ALL SELECT instrument_id, ts, i, up <> flip, CASE WHEN flip THEN 0.02 WHEN CASE WHEN up THEN high > ep ELSE low < ep END THEN least(af + 0.02, 0.2) ELSE af END,
      CASE WHEN up <> flip THEN CASE WHEN flip THEN high ELSE greatest(ep, high) END ELSE CASE WHEN flip THEN low ELSE least(ep, low) END END, CASE WHEN flip THEN ep ELSE s END
    FROM (SELECT *, CASE WHEN up THEN low < s ELSE high > s END AS flip FROM (
      SELECT n.instrument_id, n.ts, n.i, n.high, n.low, st.up, st.af, st.ep, CASE WHEN st.up THEN least(st.sar + st.af * (st.ep - st.sar), n.l1, coalesce(n.l2, n.l1)) ELSE greatest(st.sar + st.af * (st.ep - st.sar), n.h1, coalesce(n.h2, n.h1)) END AS s
      FROM st JOIN n ON n.instrument_id = st.instrument_id AND n.i = st.i + 1)))
    SELECT instrument_id, ts, round(sar, 6) AS sar FROM st""",
)
RSI = f"{_ewm('u', 'mm', 'g', 1 / 14)}, {_ewm('v', 'mm', 'l', 1 / 14)}, rsi AS (SELECT instrument_id, ts, CASE WHEN v.y > 0 THEN 100 - 100 / (1 + u.y / v.y) WHEN u.y > 0 THEN 100 ELSE 50 END AS rsi FROM bars LEFT JOIN u {_using} LEFT JOIN v {_using})"
_ind("i9_rsi", ind.rsi, ["rsi"], 4, f"WITH {f.BARS}, {MOVES}, {RSI} SELECT instrument_id, ts, round(rsi, 4) AS rsi FROM rsi")
_ind(
    "i14_tsi", ind.tsi, ["tsi"], 4,
    f"WITH {f.BARS}, {MOVES}, {_ewm('a', 'mm', 'd', 2 / 26)}, {_ewm('b', 'a', 'y', 2 / 14)}, {_ewm('g', 'mm', 'abs(d)', 2 / 26)}, {_ewm('h', 'g', 'y', 2 / 14)} SELECT instrument_id, ts, round(100 * b.y / nullif(h.y, 0), 4) AS tsi FROM bars LEFT JOIN b {_using} LEFT JOIN h {_using}",
)
_ind("i16_atr", ind.atr, ["atr"], 4, f"WITH {f.BARS}, {MOVES}, {_ewm('t', 'mm', 'tr', 2 / 15)} SELECT instrument_id, ts, round(y, 4) AS atr FROM t")
_ind("i17_keltner", ind.keltner, ["kc_mid", "kc_upper", "kc_lower"], 4, f"WITH {f.BARS}, {MOVES}, {_ewm('e', 'bars', 'close', 2 / 21)}, {_ewm('t', 'mm', 'tr', 2 / 21)} SELECT instrument_id, ts, round(e.y, 4) AS kc_mid, round(e.y + 2 * t.y, 4) AS kc_upper, round(e.y - 2 * t.y, 4) AS kc_lower FROM e JOIN t {_using}")
_ind("i2_ema_chunked", lambda b: E.ewm_chunked(b, "close", 2 / 21, "ema", F.date_trunc("month", "ts").cast("date")), ["ema"], 4, _sql["i2_ema"])

# the same by chunks of time, for series too long for one task
for _name, _op, _cols in (
    ("i4_macd", ind.macd_chunked, ["macd", "macd_signal", "macd_hist"]), ("i5_adx", ind.adx_chunked, ["adx", "plus_di", "minus_di"]), ("i9_rsi", ind.rsi_chunked, ["rsi"]),
    ("i14_tsi", ind.tsi_chunked, ["tsi"]), ("i16_atr", ind.atr_chunked, ["atr"]), ("i17_keltner", ind.keltner_chunked, ["kc_mid", "kc_upper", "kc_lower"]),
):
    _ind(f"{_name}_chunked", (lambda op: lambda b: op(b, F.year("ts")))(_op), _cols, 4, _sql[_name])
_by_year = lambda op, back: lambda b: chunked(b, op, F.year("ts"), back)
_ind("i6_parabolic_sar_chunked", lambda b: ind.parabolic_sar_chunked(b, F.year("ts")), ["sar"], 6, _sql["i6_parabolic_sar"])
_ind("i1_sma_chunked", _by_year(ind.sma, 19), ["sma"], 6, _sql["i1_sma"])
_ind("i15_bollinger_chunked", _by_year(ind.bollinger, 19), ["bb_mid", "bb_upper", "bb_lower", "bb_pct", "bb_width"], 4, _sql["i15_bollinger"])
_ind("i20_obv_chunked", lambda b: ind.obv_chunked(b, F.year("ts")), ["obv"], 4, _sql["i20_obv"])
_ind("i21_vwap_chunked", lambda b: ind.vwap_chunked(b, F.year("ts")), ["vwap"], 4, _sql["i21_vwap"])
_ind("i10_stochastic_chunked", _by_year(ind.stochastic, 15), ["stoch_k", "stoch_d"], 4, _sql["i10_stochastic"])

# ---- returns, risk, features

_ind("t1_simple_returns", R.simple_returns, {"ret": "close / lag(close) OVER w - 1"})
_ind("t2_log_returns", R.log_returns, {"log_ret": "ln(close / lag(close) OVER w)"})
_ind("t3_horizons", R.horizons, {f"ret_{p}d": f"close / lag(close, {p}) OVER w - 1" for p in (1, 5, 21, 63, 252)})
_ind("t4_cumulative", R.cumulative, ["cum_ret"], 4, f"WITH {f.BARS} SELECT instrument_id, ts, CASE WHEN row_number() OVER w > 1 THEN round(close / first_value(close) OVER w - 1, 4) END AS cum_ret FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)")
_ind("t5_rolling_vol", R.rolling_vol, ["vol"], 4, _vol + "vol FROM lr")
_ind("t6_drawdown", R.drawdown, {"drawdown": f"(close - max(close) {RUN}) / max(close) {RUN}"})
_ind("t6_drawdown_chunked", lambda b: R.drawdown_chunked(b, F.year("ts")), ["drawdown"], 6, _sql["t6_drawdown"])
_add("t7_max_drawdown", lambda s, d: _rounded(R.max_drawdown(f.daily_bars(s, d)), 6), f"WITH {f.BARS}, x AS (SELECT instrument_id, (close - max(close) {RUN}) / max(close) {RUN} AS dd FROM bars) SELECT instrument_id, round(min(dd), 6) AS max_drawdown FROM x GROUP BY 1")
_add("t8_sharpe", lambda s, d: _rounded(R.sharpe(f.daily_bars(s, d)), 6), f"WITH {f.BARS}, {LR} SELECT instrument_id, round(avg(lr) / stddev_samp(lr) * sqrt(252), 6) AS sharpe FROM lr GROUP BY 1")
_add("t9_sortino", lambda s, d: _rounded(R.sortino(f.daily_bars(s, d)), 6), f"WITH {f.BARS}, {LR} SELECT instrument_id, round(avg(lr) / stddev_samp(lr) FILTER (lr < 0) * sqrt(252), 6) AS sortino FROM lr GROUP BY 1")
_add("t10_beta", lambda s, d: _rounded(R.beta(f.daily_bars(s, d), f.bench(s, d)), 6), f"WITH {f.BARS}, {LR} SELECT a.instrument_id, round(covar_samp(a.lr, b.lr) / var_samp(b.lr), 6) AS beta FROM lr a JOIN lr b ON a.ts = b.ts WHERE b.instrument_id = 1 AND a.lr IS NOT NULL AND b.lr IS NOT NULL GROUP BY 1")
_ALL = "al AS (SELECT a.instrument_id AS l, b.instrument_id AS r, a.close AS a, b.close AS b FROM bars a JOIN bars b ON a.ts = b.ts AND a.instrument_id < b.instrument_id)"
_names_ = 'SELECT l AS "left", r AS "right", '
_add("t11_pearson", lambda s, d: _rounded(R.correlations(f.daily_bars(s, d)), 6), f'WITH {f.BARS}, {_ALL} {_names_} round(corr(a, b), 6) AS corr FROM al GROUP BY 1, 2')
_add("t11_pearson_blocked", lambda s, d: _rounded(R.correlations_blocked(f.daily_bars(s, d), F.year("ts"), size=3), 6), _sql["t11_pearson"])
_add(
    "t11_spearman",
    lambda s, d: _rounded(R.correlations(f.daily_bars(s, d), "spearman"), 6),
    f"WITH {f.BARS}, {_ALL}, k AS (SELECT l, r, rank() OVER (PARTITION BY l, r ORDER BY a) + (count(*) OVER (PARTITION BY l, r, a) - 1) / 2 AS a, rank() OVER (PARTITION BY l, r ORDER BY b) + (count(*) OVER (PARTITION BY l, r, b) - 1) / 2 AS b FROM al) {_names_} round(corr(a, b), 6) AS corr FROM k GROUP BY 1, 2",
)
_add(
    "t11_kendall",
    lambda s, d: _rounded(R.correlations(f.daily_bars(s, d), "kendall"), 6),
    f"WITH {f.BARS}, {_ALL}, nn AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY a, b) AS i FROM al), k AS (SELECT x.l, x.r, sum(sign(x.a - y.a) * sign(x.b - y.b)) AS s, sum((x.a <> y.a)::INT) AS u, sum((x.b <> y.b)::INT) AS v FROM nn x JOIN nn y ON x.l = y.l AND x.r = y.r AND x.i < y.i GROUP BY 1, 2) {_names_} round(s / sqrt(u::DOUBLE * v), 6) AS corr FROM k",
)
_add("t12_rolling_correlation", lambda s, d: _rounded(R.rolling_correlation(_pair(s, d).where("instrument_id <> 1")), 4, *ID, "corr"), f"WITH {f.BARS}, {PAIR} SELECT instrument_id, ts, round(CASE WHEN count(*) {_frame(60)} = 60 THEN corr(a, b) {_frame(60)} END, 4) + 0.0 AS corr FROM pair WHERE instrument_id <> 1")
_add(
    "t13_lead_lag",
    lambda s, d: _rounded(R.lead_lag(_pair(s, d)), 6),
    f"WITH {f.BARS}, {PAIR}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) AS i FROM pair) SELECT a.instrument_id, (b.i - a.i)::INT AS lag, round(corr(a.a, b.b), 6) AS corr FROM n a JOIN n b ON a.instrument_id = b.instrument_id AND b.i - a.i BETWEEN -20 AND 20 GROUP BY 1, 2",
)
_add("t13_lead_lag_full", _queries["t13_lead_lag"], _sql["t13_lead_lag"])
_ind("t14_volume_zscore", R.volume_zscore, {"volume_z": f"(volume - ({_roll('avg', 'volume', 20)})) / nullif({_roll('stddev_samp', 'volume', 20)}, 0)"}, 4)
_ind("t15_divergence", R.divergence, {"divergence": "close / lag(close, 20) OVER w - volume / nullif(lag(volume, 20) OVER w, 0)"}, 4)
_ind(
    "t16_confirmed_move", R.confirmed_move, ["confirmed"], 0,
    f"WITH {f.BARS}, m AS (SELECT *, CASE WHEN count(volume) {_frame(20)} = 20 THEN quantile_cont(volume, 0.5) {_frame(20)} END AS m, lag(close) OVER (PARTITION BY instrument_id ORDER BY ts) AS pc FROM bars) SELECT instrument_id, ts, CASE WHEN volume > m THEN CASE WHEN coalesce(close > pc, false) THEN 1 ELSE -1 END ELSE 0 END AS confirmed FROM m",
)
_ind("t17_dollar_volume", R.dollar_volume, {"dollar_volume": _roll("avg", "close * volume", 20)}, 6)
_ind("t18_zscore", R.zscore, {"z": "(close - avg(close) OVER (PARTITION BY instrument_id)) / nullif(stddev_samp(close) OVER (PARTITION BY instrument_id), 0)"}, 4)
_ind("t18_rolling_zscore", lambda b: R.zscore(b, p=60), {"z": f"(close - ({_roll('avg', 'close', 60)})) / nullif({_roll('stddev_samp', 'close', 60)}, 0)"}, 4)
_ind(
    "t19_percentile_rank", R.percentile_rank, ["pct_rank"], 6,
    f"WITH {f.BARS}, l AS (SELECT instrument_id, ts, close, list(close) {_frame(252)} AS l FROM bars), c AS (SELECT *, len(list_filter(l[1:251], lambda x: x < close)) AS b, len(list_filter(l[1:251], lambda x: x <= close)) AS u FROM l) SELECT instrument_id, ts, CASE WHEN len(l) = 252 THEN round((b + u + (u > b)::INT) * 50.0 / 251 / 100, 6) END AS pct_rank FROM c",
)
_add("t19_percentile_rank_full", _queries["t19_percentile_rank"], _sql["t19_percentile_rank"])
_ind("t19_percentile_rank_chunked", lambda b: R.percentile_rank_chunked(b, F.year("ts")), ["pct_rank"], 6, _sql["t19_percentile_rank"])
_ind("t19_percentile_rank_60", lambda b: R.percentile_rank(b, p=60), ["pct_rank"], 6, _sql["t19_percentile_rank"].replace("252", "60").replace("251", "59"))
_add(
    "t20_macro_changes",
    lambda s, d: _rounded(R.change_over(R.change_over(f.macro(s, d).withColumnRenamed("series_id", "instrument_id"), "value", 252, "yoy"), "value", 21, "mom"), 6, *ID, "yoy", "mom"),
    f"WITH {f.MACRO} SELECT series_id AS instrument_id, ts, round(value / lag(value, 252) OVER w - 1, 6) AS yoy, round(value / lag(value, 21) OVER w - 1, 6) AS mom FROM macro WINDOW w AS (PARTITION BY series_id ORDER BY ts)",
)

# ---- regressions and tests


def _simpson(of: str, start: str, end: str, steps: int = 400) -> str:
    """The integral of an expression in @, by Simpson's rule."""
    at = f"({start}) + (({end}) - ({start})) * k / {steps}.0"
    return f"((({end}) - ({start})) / {3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda k: CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * ({of.replace('@', f'({at})')}))))"


def _normal(z: str) -> str:
    """The normal distribution function of a column z."""
    return f"(0.5 + sign({z}) * {_simpson('exp(-@ * @ / 2)', '0', f'least(abs({z}), 12)')} / sqrt(2 * pi()))"


def _t_tails(t: str, df: str) -> str:
    """Both tails of Student's t: with t = sqrt(df) tan(x) the density is a power of the cosine."""
    return f"(2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {_simpson(f'pow(cos(@), {df} - 1)', f'atan(abs({t}) / sqrt({df}))', 'pi() / 2', 4000)})"


_both = lambda s, d: B.pair(R.log_returns(f.daily_bars(s, d)), R.log_returns(f.bench(s, d)), "log_ret").where("instrument_id <> 1")
_add(
    "m1_ols",
    lambda s, d: _rounded(TS.ols(_both(s, d), "a", ["b"]), 6),
    f"""WITH {f.BARS}, {LR}, p AS (SELECT a.instrument_id, a.lr AS a, b.lr AS b FROM lr a JOIN lr b ON a.ts = b.ts WHERE b.instrument_id = 1 AND a.instrument_id <> 1 AND a.lr IS NOT NULL AND b.lr IS NOT NULL),
    g AS (SELECT instrument_id, count(*) AS n, regr_slope(a, b) AS s, regr_intercept(a, b) AS c, regr_r2(a, b) AS r2, regr_sxx(a, b) AS sxx, regr_syy(a, b) AS syy, avg(b) AS mb FROM p GROUP BY 1),
    e AS (SELECT *, sqrt((1 - r2) * syy / (n - 2)) AS se FROM g),
    t AS (SELECT instrument_id, 'b' AS term, s AS coef, s / (se / sqrt(sxx)) AS t, r2, n FROM e UNION ALL SELECT instrument_id, 'const', c, c / (se * sqrt(1.0 / n + mb * mb / sxx)), r2, n FROM e)
    SELECT instrument_id, term, round(coef, 6) AS coef, round(t, 6) AS t_stat, round({_t_tails('t', '(n - 2)')}, 6) AS p_value, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2, n FROM t""",
)
_add(
    "m1_ols_residuals",
    lambda s, d: (lambda b: _rounded(TS.residuals(b, TS.ols(b, "a", ["b"]), "a", ["b"]), 5, *ID, "residual"))(_both(s, d)),
    f"WITH {f.BARS}, {LR}, p AS (SELECT a.instrument_id, a.ts, a.lr AS a, b.lr AS b FROM lr a JOIN lr b ON a.ts = b.ts WHERE b.instrument_id = 1 AND a.instrument_id <> 1 AND a.lr IS NOT NULL AND b.lr IS NOT NULL) SELECT instrument_id, ts, round(a - regr_intercept(a, b) OVER z - regr_slope(a, b) OVER z * b, 5) AS residual FROM p WINDOW z AS (PARTITION BY instrument_id)",
)
_add("m2_rolling_beta", lambda s, d: _rounded(TS.rolling_beta(_pair(s, d)), 4, *ID, "beta"), f"WITH {f.BARS}, {PAIR} SELECT instrument_id, ts, round(CASE WHEN count(*) {_frame(60)} = 60 THEN covar_samp(a, b) {_frame(60)} / nullif(var_pop(b) {_frame(60)}, 0) END, 4) + 0.0 AS beta FROM pair")
_add("m3_adf", lambda s, d: _rounded(TS.adf_test(f.daily_bars(s, d)), 6))


def _swept(name: str, source: str, columns: list[str], constant: bool) -> str:
    """CTEs name_0 to name_k: the columns less what the first, then the second of them (and so on to the last but one) explain."""
    over = "OVER (PARTITION BY instrument_id)"
    held = [f"{c} - avg({c}) {over} AS {c}" if constant else c for c in columns]
    out = [f"{name}_0 AS (SELECT instrument_id, {', '.join(held)} FROM {source})"]
    for j, c in enumerate(columns[:-1]):
        rest = [f"{r} - {c} * (sum({r} * {c}) {over}) / nullif(sum({c} * {c}) {over}, 0) AS {r}" for r in columns[j + 1 :]]
        out.append(f"{name}_{j + 1} AS (SELECT instrument_id, {', '.join(rest)} FROM {name}_{j})")
    return ", ".join(out)


def _f_tail(f_: str, k: str, df: str) -> str:
    """The upper tail of the F distribution: with f k / df the square of a tangent its density is one of cosines and sines."""
    return f"(2 * exp(lgamma(({df} + {k}) / 2) - lgamma({df} / 2) - lgamma({k} / 2.0)) * {_simpson(f'pow(cos(@), {df} - 1) * pow(sin(@), {k} - 1)', f'atan(sqrt({f_} * {k} / {df}))', 'pi() / 2', 4000)})"


def _granger_sql() -> str:
    ctes, rows = [], []
    for k in range(1, 6):
        own, other = [f"a{i}" for i in range(1, k + 1)], [f"b{i}" for i in range(1, k + 1)]
        lags = ", ".join(f"lag({c[0]}, {c[1:]}) OVER w AS {c}" for c in own + other)
        ctes.append(f"g{k} AS (SELECT * FROM (SELECT instrument_id, a AS y, {lags} FROM p WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)) WHERE a{k} IS NOT NULL)")
        ctes.append(_swept(f"s{k}", f"g{k}", [*own, *other, "y"], True))
        rows.append(f"SELECT instrument_id, {k} AS lag, n - {2 * k + 1} AS free, (r0 - r1) / {k} / (r1 / (n - {2 * k + 1})) AS f FROM (SELECT instrument_id, count(*) AS n, sum(y * y) AS r0 FROM s{k}_{k} GROUP BY 1) JOIN (SELECT instrument_id, sum(y * y) AS r1 FROM s{k}_{2 * k} GROUP BY 1) USING (instrument_id)")
    return f"WITH {f.BARS}, {LR}, p AS (SELECT a.instrument_id, a.ts, a.lr AS a, b.lr AS b FROM lr a JOIN lr b ON a.ts = b.ts WHERE b.instrument_id = 1 AND a.instrument_id <> 1 AND a.lr IS NOT NULL AND b.lr IS NOT NULL), {', '.join(ctes)}, u AS ({' UNION ALL '.join(rows)}) SELECT instrument_id, lag, round(f, 6) AS f_stat, round({_f_tail('f', 'lag', 'free')}, 6) AS p_value FROM u"


def _unit_root(series: int) -> str:
    """The p-value of a column t."""
    joint, low, high, (least, most) = TS.P_VALUES[series]
    poly = lambda bs: " + ".join(f"{b!r} * pow(t, {k})" for k, b in enumerate(bs))
    z = f"(CASE WHEN t <= {joint} THEN {poly(low)} ELSE {poly(high)} END)"
    return f"CASE WHEN t <= {least} THEN 0 WHEN t >= {most} THEN 1 ELSE {_normal(z)} END"


def _unit_root_stat(source: str, lags: int, constant: bool) -> str:
    """CTE ``t`` (instrument_id, rows, t) of column x at so many lags."""
    ds = [f"d{k}" for k in range(1, lags + 1)]
    cols = ", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in range(1, lags + 1))
    own = 2 if constant else 1
    return f"""df AS (SELECT *, x - lag(x) OVER w AS d, lag(x) OVER w AS x1 FROM {source} WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
    dl AS (SELECT * FROM (SELECT instrument_id, d AS y, x1, {cols} FROM df WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)) WHERE d{lags} IS NOT NULL), {_swept("e", "dl", [*ds, "x1", "y"], constant)},
    t AS (SELECT instrument_id, n AS rows, b / sqrt(rss / (n - {lags + own}) / sxx) AS t FROM (SELECT instrument_id, count(*) AS n, sum(x1 * y) / sum(x1 * x1) AS b, sum(x1 * x1) AS sxx FROM e_{lags} GROUP BY 1) JOIN (SELECT instrument_id, sum(y * y) AS rss FROM e_{lags + 1} GROUP BY 1) USING (instrument_id))"""


_add("m4_granger", lambda s, d: _rounded(TS.granger(_both(s, d)), 6), _granger_sql())
# the same from products by chunks of time, for series too long for one task; SQL solves the normal equations
_add("m4_granger_chunked", lambda s, d: _rounded(L.granger(_both(s, d), F.year("ts")), 6), _granger_sql())
_add("m3_adf_chunked", lambda s, d: _rounded(L.adf_test(f.daily_bars(s, d), F.year("ts")), 6))
_crit = lambda k: " + ".join(f"{b!r} / pow(rows, {i})" for i, b in enumerate(TS.CRITICAL[k]))
_add(
    "m3_adf_two_lags",
    lambda s, d: _rounded(L.adf_test(f.daily_bars(s, d), F.year("ts"), lags=2), 5),
    f"WITH {f.BARS}, xs AS (SELECT instrument_id, ts, close AS x FROM bars), {_unit_root_stat('xs', 2, True)} SELECT instrument_id, round(t, 5) AS stat, round({_unit_root(1)}, 5) AS p_value, 2 AS lags, {_unit_root(1)} < 0.05 AS stationary, "
    + ", ".join(f"round({_crit(f'{k}%')}, 5) AS crit_{k}" for k in (1, 5, 10)) + " FROM t",
)
_add("m5_cointegration_chunked", lambda s, d: _rounded(L.cointegration(_pair(s, d).where("instrument_id <> 1"), F.year("ts")), 6))
_add(
    "m5_cointegration_one_lag",
    lambda s, d: _rounded(L.cointegration(_pair(s, d).where("instrument_id <> 1"), F.year("ts"), lags=1), 5),
    f"WITH {f.BARS}, {PAIR}, xs AS (SELECT instrument_id, ts, a - regr_intercept(a, b) OVER z - regr_slope(a, b) OVER z * b AS x FROM pair WHERE instrument_id <> 1 WINDOW z AS (PARTITION BY instrument_id)), {_unit_root_stat('xs', 1, False)} "
    f"SELECT instrument_id, round(t, 5) AS stat, round({_unit_root(2)}, 5) AS p_value, {_unit_root(2)} < 0.05 AS cointegrated FROM t",
)
_add("m5_cointegration", lambda s, d: _rounded(TS.cointegration(_pair(s, d).where("instrument_id <> 1")), 6))

# ---- performance, backtests, overfitting

SHEET = f"""{LR}, dd AS (SELECT *, (close - max(close) {RUN}) / max(close) {RUN} AS dd FROM lr),
i AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) {RUN} AS isl FROM dd), dur AS (SELECT instrument_id, max(n)::INT AS dur FROM (SELECT instrument_id, isl, sum((dd < 0)::INT) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
lg AS (SELECT *, lag(sr) OVER (PARTITION BY instrument_id ORDER BY ts) AS before FROM dd),
st AS (SELECT instrument_id, count(sr) AS n, arg_max(close, ts) / arg_min(close, ts) - 1 AS tr, avg(lr) AS ml, stddev_samp(lr) AS sl, stddev_samp(lr) FILTER (lr < 0) AS dl, min(dd) AS mdd, sqrt(avg(dd * dd)) AS ulcer,
  quantile_cont(sr, 0.05) AS v5, quantile_cont(sr, 0.01) AS v1, quantile_cont(sr, 0.95) AS v95, avg(sr) AS m1, avg(sr * sr) AS m2, avg(sr * sr * sr) AS m3, kurtosis_pop(sr) AS k,
  sum(sr) FILTER (sr > 0) / abs(sum(sr) FILTER (sr < 0)) AS gp, corr(sr, before) AS ac FROM lg GROUP BY 1),
mo AS (SELECT *, (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 1.5) AS sk FROM st)"""
SHEET_COLS = ["n", "total_return", "cagr", "ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar", "ulcer_index", "max_dd_duration_bars", "var_95", "var_99", "cvar_95", "skewness", "excess_kurtosis", "jarque_bera_stat", "jarque_bera_pval", "tail_ratio", "gain_pain_ratio", "return_autocorr"]
_add(
    "p1_tearsheet",
    lambda s, d: _rounded(M.tearsheet(f.daily_bars(s, d)), 5, "instrument_id", *SHEET_COLS),
    f"WITH {f.BARS}, {SHEET}, cv AS (SELECT instrument_id, avg(sr) AS cvar FROM lr JOIN mo USING (instrument_id) WHERE sr <= v5 GROUP BY 1) SELECT instrument_id, n, round(tr, 5) AS total_return, round(pow(1 + tr, 252.0 / n) - 1, 5) AS cagr, round(ml * 252, 5) AS ann_return, round(sl * sqrt(252), 5) AS ann_vol, round(ml / sl * sqrt(252), 5) AS sharpe, round(ml / dl * sqrt(252), 5) AS sortino, "
    "round(mdd, 5) AS max_drawdown, round((pow(1 + tr, 252.0 / n) - 1) / nullif(abs(mdd), 0), 5) AS calmar, round(ulcer, 5) AS ulcer_index, dur AS max_dd_duration_bars, round(v5, 5) AS var_95, round(v1, 5) AS var_99, round(cvar, 5) AS cvar_95, round(sk, 5) AS skewness, round(k, 5) AS excess_kurtosis, "
    "round(n / 6 * (sk * sk + k * k / 4), 5) AS jarque_bera_stat, round(exp(-n / 12 * (sk * sk + k * k / 4)), 5) AS jarque_bera_pval, round(v95 / abs(v5), 5) AS tail_ratio, round(gp, 5) AS gain_pain_ratio, round(ac, 5) AS return_autocorr FROM mo JOIN cv USING (instrument_id) JOIN dur USING (instrument_id)",
)
# measures of groups of any size: percentiles by selection (with so few values held that rounds run), runs over chunks of time
_add(
    "p5_tails_selected",
    lambda s, d: _rounded(selection.tails(R.simple_returns(f.daily_bars(s, d)), held=20), 6),
    f"WITH {f.BARS}, {LR}, q AS (SELECT instrument_id, quantile_cont(sr, 0.05) AS v5, quantile_cont(sr, 0.01) AS v1, quantile_cont(sr, 0.95) AS v95 FROM lr GROUP BY 1) SELECT instrument_id, round(any_value(v5), 6) AS var_95, round(any_value(v1), 6) AS var_99, round(avg(sr) FILTER (sr <= v5), 6) AS cvar_95, round(any_value(v95 / abs(v5)), 6) AS tail_ratio FROM lr JOIN q USING (instrument_id) GROUP BY 1",
)
_add("p4_drawdown_duration_chunked", lambda s, d: runs.drawdown_duration(f.daily_bars(s, d), F.year("ts")), f"WITH {f.BARS}, {SHEET} SELECT instrument_id, dur AS max_dd_duration_bars FROM dur")
_add(
    "p9_probabilistic_sharpe",
    lambda s, d: _rounded(M.with_psr(M.tearsheet(f.daily_bars(s, d))), 6, "instrument_id", "probabilistic_sharpe"),
    f"WITH {f.BARS}, {SHEET}, q AS (SELECT *, ml / sl * sqrt(252) AS sr FROM mo), r AS (SELECT *, 1 - sk * sr + (k - 1) / 4 * sr * sr AS root FROM q), z AS (SELECT instrument_id, CASE WHEN root > 0 THEN sr * sqrt(n - 1) / sqrt(root) END AS z FROM r) SELECT instrument_id, round({_normal('z')}, 6) AS probabilistic_sharpe FROM z",
)


def _bench_value(s, d):
    return f.bench(s, d).select("instrument_id", "ts", F.col("close").alias("value"))


BENCH_COLS = ["alpha", "beta", "r_squared", "tracking_error", "information_ratio", "up_capture", "down_capture"]
_add(
    "p10_against_benchmark",
    lambda s, d: _rounded(M.tearsheet(f.daily_bars(s, d).where("instrument_id <> 1"), bench=_bench_value(s, d)), 5, "instrument_id", *BENCH_COLS),
    f"WITH {f.BARS}, {LR}, ab AS (SELECT a.instrument_id, a.sr AS a, b.sr AS b FROM lr a JOIN lr b ON a.ts = b.ts WHERE b.instrument_id = 1 AND a.instrument_id <> 1 AND a.sr IS NOT NULL AND b.sr IS NOT NULL), k AS (SELECT instrument_id, covar_samp(a, b) / var_samp(b) AS be, avg(a) AS ma, avg(b) AS mb, corr(a, b) AS c, stddev_samp(a - b) AS te, avg(a - b) AS md, avg(a) FILTER (b > 0) / avg(b) FILTER (b > 0) AS u, avg(a) FILTER (b < 0) / avg(b) FILTER (b < 0) AS dn FROM ab GROUP BY 1) "
    "SELECT instrument_id, round((ma - be * mb) * 252, 5) AS alpha, round(be, 5) AS beta, round(c * c, 5) AS r_squared, round(te * sqrt(252), 5) AS tracking_error, round(md / te * sqrt(252), 5) AS information_ratio, round(u, 5) AS up_capture, round(dn, 5) AS down_capture FROM k",
)
SIGNAL = f"""sg AS (SELECT *, CASE WHEN row_number() OVER w < 50 THEN 0 WHEN avg(close) {_frame(20)} > avg(close) {_frame(50)} THEN 1 WHEN avg(close) {_frame(20)} < avg(close) {_frame(50)} THEN -1 ELSE 0 END AS signal FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
po AS (SELECT *, coalesce(lag(signal) OVER w, 0)::DOUBLE AS pos, coalesce(close / lag(close) OVER w - 1, 0) AS pr FROM sg WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
sr AS (SELECT *, pos * pr - abs(pos - coalesce(lag(pos) OVER w, 0)) * 0.0015 AS sr FROM po WINDOW w AS (PARTITION BY instrument_id ORDER BY ts))"""
_run = lambda s, d: bt.run_backtest(bt.cross_signal(f.daily_bars(s, d)), short=True)
_add("b1_backtest", lambda s, d: _rounded(_run(s, d).withColumn("log_equity", F.ln(F.abs("equity"))).withColumn("equity_sign", F.signum("equity")), 5, *ID, "position", "price_return", "strategy_return", "log_equity", "equity_sign"), f"WITH {f.BARS}, {SIGNAL} SELECT instrument_id, ts, pos AS position, round(pr, 5) AS price_return, round(sr, 5) AS strategy_return, round(ln(10000) + sum(ln(abs(1 + sr))) {RUN}, 5) AS log_equity, CASE WHEN sum((1 + sr = 0)::INT) {RUN} > 0 THEN 0 WHEN sum((1 + sr < 0)::INT) {RUN} % 2 = 1 THEN -1 ELSE 1 END::DOUBLE AS equity_sign FROM sr")
TRADES = f"""ch AS (SELECT *, sign(pos) AS side, coalesce(sign(pos) <> lag(sign(pos)) OVER (PARTITION BY instrument_id ORDER BY ts), true) AS new FROM sr),
ru AS (SELECT instrument_id, ts AS entry, close AS entry_price, side, lead(ts) OVER w AS exit, lead(close) OVER w AS exit_price FROM ch WHERE new WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
trd AS (SELECT instrument_id, entry, exit, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS side, entry_price, exit_price, side * (exit_price / entry_price - 1) - 0.003 AS pnl FROM ru WHERE side <> 0 AND exit IS NOT NULL)"""
_add("b2_trades", lambda s, d: _rounded(bt.trades(_run(s, d)), 8), f"WITH {f.BARS}, {SIGNAL}, {TRADES} SELECT instrument_id, entry, exit, side, round(entry_price, 8) AS entry_price, round(exit_price, 8) AS exit_price, round(pnl, 8) AS pnl FROM trd")
_streak = lambda c, n: f"(SELECT instrument_id, max(k) AS {n} FROM (SELECT instrument_id, run, count(*) AS k FROM (SELECT *, sum(nw) OVER (PARTITION BY instrument_id ORDER BY entry ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce((({c}) <> lag({c}) OVER (PARTITION BY instrument_id ORDER BY entry))::INT, 0) AS nw FROM trd)) GROUP BY 1, 2) GROUP BY 1)"
_add(
    "p12_trade_metrics",
    lambda s, d: _rounded(M.trade_metrics(bt.trades(_run(s, d))), 6),
    f"WITH {f.BARS}, {SIGNAL}, {TRADES}, wn AS {_streak('pnl > 0', 'max_consec_wins')}, ls AS {_streak('pnl < 0', 'max_consec_losses')} SELECT instrument_id, count(*) AS n_trades, round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate, round(sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0)), 6) AS profit_factor, round(avg(pnl), 6) AS expectancy, round(avg(pnl) FILTER (pnl > 0) / abs(avg(pnl) FILTER (pnl < 0)), 6) AS payoff, "
    "round(avg(pnl) FILTER (pnl > 0), 6) AS avg_win, round(avg(pnl) FILTER (pnl < 0), 6) AS avg_loss, any_value(max_consec_wins) AS max_consec_wins, any_value(max_consec_losses) AS max_consec_losses FROM trd JOIN wn USING (instrument_id) JOIN ls USING (instrument_id) GROUP BY 1",
)
_add("b2_trades_chunked", lambda s, d: _rounded(runs.trades(_run(s, d), F.year("ts")), 8), _sql["b2_trades"])
_add(
    "p13_streaks_chunked",
    lambda s, d: (lambda t: runs.streak(t, F.col("pnl") > 0, "max_consec_wins", F.year("entry")).join(runs.streak(t, F.col("pnl") < 0, "max_consec_losses", F.year("entry")), "instrument_id"))(kept(runs.trades(_run(s, d), F.year("ts")), "trades")),
    f"WITH {f.BARS}, {SIGNAL}, {TRADES}, wn AS {_streak('pnl > 0', 'max_consec_wins')}, ls AS {_streak('pnl < 0', 'max_consec_losses')} SELECT instrument_id, max_consec_wins, max_consec_losses FROM wn JOIN ls USING (instrument_id)",
)
_event_days = lambda s, d: f.daily_bars(s, d).where("dayofmonth(ts) = 15").select(*ID)
_add(
    "b3_event_study",
    lambda s, d: _rounded(bt.event_study(f.daily_bars(s, d), _event_days(s, d)), 6),
    f"WITH {f.BARS}, {LR}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY instrument_id) AS n FROM lr), e AS (SELECT instrument_id, i FROM n WHERE day(ts) = 15 AND i > 20 AND i + 20 <= n) SELECT e.instrument_id, (n.i - e.i)::INT AS lag, CASE WHEN count(lr) = count(*) THEN round(avg(lr), 6) END AS mean_ret, CASE WHEN count(lr) = count(*) THEN round(stddev_samp(lr), 6) END AS std_ret FROM e JOIN n ON e.instrument_id = n.instrument_id AND n.i BETWEEN e.i - 20 AND e.i + 20 GROUP BY 1, 2",
)
_add("b4_regime_mask", lambda s, d: bt.regime_mask(bt.cross_signal(f.daily_bars(s, d)).withColumn("regime", F.when(F.month("ts") == 1, None).otherwise(F.col("volume") > 100))).select(*ID, "signal"), f"WITH {f.BARS}, {SIGNAL} SELECT instrument_id, ts, CASE WHEN coalesce(CASE WHEN month(ts) = 1 THEN NULL ELSE volume > 100 END, true) THEN signal ELSE 0 END AS signal FROM sg")
_WF = """WITH {bars}, {signal}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY instrument_id) AS n FROM sg),
fo AS (SELECT instrument_id, unnest(range(0, (max(n) - 504) // 126)) AS fold FROM n GROUP BY 1),
c AS (SELECT n.instrument_id, fold, i >= 504 + fold * 126 AS oos, ts, close, CASE WHEN signal > 0 THEN 1.0 ELSE 0.0 END AS s FROM n JOIN fo USING (instrument_id) WHERE i < 504 + (fold + 1) * 126),
p AS (SELECT *, coalesce(lag(s) OVER w, 0) AS pos, coalesce(close / lag(close) OVER w - 1, 0) AS pr FROM c WINDOW w AS (PARTITION BY instrument_id, fold, oos ORDER BY ts)),
r AS (SELECT *, pos * pr - abs(pos - coalesce(lag(pos) OVER w, 0)) * 0.0015 AS r FROM p WINDOW w AS (PARTITION BY instrument_id, fold, oos ORDER BY ts)),
e AS (SELECT *, product(1 + r) OVER w AS eq, row_number() OVER w AS k, CASE WHEN 1 + r > 0 THEN ln(1 + r) END AS lr FROM r WINDOW w AS (PARTITION BY instrument_id, fold, oos ORDER BY ts ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, eq / max(eq) OVER (PARTITION BY instrument_id, fold, oos ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
g AS (SELECT instrument_id, fold, oos, min(ts) AS a, max(ts) AS z, coalesce(avg(lr) FILTER (k > 1) / nullif(stddev_samp(lr) FILTER (k > 1), 0) * sqrt(252), 0) AS sh, min(dd) AS dd FROM d GROUP BY 1, 2, 3)
SELECT o.instrument_id, o.fold::INT AS fold, o.a AS fold_start, o.z AS fold_end, round(x.sh, 4) AS is_sharpe, round(o.sh, 4) AS oos_sharpe, round(x.dd, 4) AS is_max_dd, round(o.dd, 4) AS oos_max_dd FROM g o JOIN g x ON o.instrument_id = x.instrument_id AND o.fold = x.fold AND o.oos AND NOT x.oos""".format(bars=f.BARS, signal=SIGNAL)
_add("b5_walk_forward", lambda s, d: _rounded(V.walk_forward(f.daily_bars(s, d), bt.cross_signal), 4), _WF)
_add("b5_walk_forward_copies", lambda s, d: _rounded(V.walk_forward(f.daily_bars(s, d), bt.cross_signal, causal=False), 4), _WF)
_add(
    "b6_purged_folds",
    lambda s, d: V.purged_folds(f.daily_bars(s, d)),
    f"WITH {f.BARS}, n AS (SELECT instrument_id, ts, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY instrument_id) AS n FROM bars), x AS (SELECT *, fold * (n // 5) AS a, CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END AS z FROM n, (SELECT unnest(range(5)) AS fold)) "
    "SELECT instrument_id, fold::INT AS fold, ts, CASE WHEN i >= a AND i < z THEN 'test' ELSE 'train' END AS side FROM x WHERE (i >= a AND i < z) OR i < a - 10 OR i >= least(n, z + 10)",
)


def _deflated(s, d):
    t = M.tearsheet(f.daily_bars(s, d))
    args = F.col("sharpe") / 16, F.col("n").cast("double")
    more = F.col("skewness"), F.col("excess_kurtosis")
    return _rounded(t.select("instrument_id", V.probabilistic_sharpe(args[0], F.lit(0.0), args[1], *more).alias("psr"), V.deflated_sharpe(*args, 20, *more).alias("dsr")), 6)


_BEST = (1 - V.EULER) * phi_inv(1 - 1 / 20) + V.EULER * phi_inv(1 - 1 / (20 * math.e))
_add(
    "b7_b8_deflated_sharpe",
    _deflated,
    f"WITH {f.BARS}, {SHEET}, q AS (SELECT *, ml / sl * sqrt(252) / 16 AS sr FROM mo), r AS (SELECT *, 1 - sk * sr + (k - 1) / 4 * sr * sr AS root FROM q), z AS (SELECT instrument_id, CASE WHEN root > 0 THEN sr * sqrt(n - 1) / sqrt(root) END AS z, CASE WHEN root > 0 THEN (sr - {_BEST!r} / sqrt(n)) * sqrt(n - 1) / sqrt(root) END AS y FROM r) SELECT instrument_id, round({_normal('z')}, 6) AS psr, round({_normal('y')}, 6) AS dsr FROM z",
)
_add(
    "b9_pbo",
    lambda s, d: _rounded(V.pbo(f.daily_bars(s, d), bt.cross_signal), 6),
    f"""WITH {f.BARS}, {SIGNAL}, n AS (SELECT instrument_id, ts, close, CASE WHEN signal > 0 THEN 1.0 ELSE 0.0 END AS s, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY instrument_id) AS n FROM sg),
    fo AS (SELECT *, least(i // (n // 16), 15) AS fold FROM n),
    p AS (SELECT *, coalesce(lag(s) OVER w, 0) AS pos, coalesce(close / lag(close) OVER w - 1, 0) AS pr, row_number() OVER w AS k FROM fo WINDOW w AS (PARTITION BY instrument_id, fold ORDER BY ts)),
    r AS (SELECT *, pos * pr - abs(pos - coalesce(lag(pos) OVER w, 0)) * 0.0015 AS r FROM p WINDOW w AS (PARTITION BY instrument_id, fold ORDER BY ts)),
    g AS (SELECT instrument_id, fold, coalesce(avg(ln(1 + r)) FILTER (k > 1) / nullif(stddev_samp(ln(1 + r)) FILTER (k > 1), 0) * sqrt(252), 0) AS sh FROM r GROUP BY 1, 2),
    m AS (SELECT *, quantile_cont(sh, 0.5) OVER (PARTITION BY instrument_id) AS m FROM g) SELECT instrument_id, round(avg((sh < m)::INT), 6) AS pbo FROM m GROUP BY 1""",
)
_add("b10_monte_carlo", lambda s, d: _rounded(V.monte_carlo(_run(s, d)), 2))


def _stored_paths(s, d):
    """Bands of 60 paths from a start table that is given; as logarithms, since paths run over many magnitudes."""
    returns = _run(s, d).where("strategy_return is not null")
    n = returns.groupBy("instrument_id").agg(F.count("*").alias("n")).withColumn("size", F.least(F.greatest(F.lit(10), F.floor(F.sqrt("n"))), F.col("n")))
    blocks = n.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("size")))))
    start = ((F.col("sim") + 1) * 7919 + (F.col("block") + 1) * 104_729 * (F.col("sim") + 3)) % F.greatest(F.lit(1), F.col("n") - F.col("size"))
    bands = V.monte_carlo(returns, starts=blocks.withColumn("start", start), by=F.year("ts"))
    return _rounded(bands.select("instrument_id", "step", *(F.signum(f"p{b}").alias(f"s{b}") for b in V.BANDS), *(F.ln(F.abs(F.col(f"p{b}"))).alias(f"ln{b}") for b in V.BANDS)), 5)


_band = lambda b: f"quantile_cont(e, {b / 100})"
_add(
    "b10_monte_carlo_stored",
    _stored_paths,
    f"""WITH {f.BARS}, {SIGNAL}, r AS (SELECT instrument_id, sr, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS i FROM sr),
    n AS (SELECT instrument_id, n, least(greatest(10, floor(sqrt(n))::BIGINT), n) AS size FROM (SELECT instrument_id, count(*) AS n FROM r GROUP BY 1)),
    st AS (SELECT *, ((sim + 1) * 7919 + (block + 1) * 104729 * (sim + 3)) % greatest(1, n - size) AS start FROM (SELECT *, unnest(range(0, (n - 1) // size + 1)) AS block FROM n, range(0, 60) t(sim))),
    pa AS (SELECT instrument_id, sim, block * size + k AS step, start + k AS i FROM (SELECT *, unnest(range(0, least(size, n - block * size))) AS k FROM st)),
    eq AS (SELECT instrument_id, step, CASE WHEN sum((1 + sr = 0)::INT) OVER w > 0 THEN 0 ELSE exp(ln(10000) + sum(CASE WHEN 1 + sr = 0 THEN 0 ELSE ln(abs(1 + sr)) END) OVER w) * CASE WHEN sum((1 + sr < 0)::INT) OVER w % 2 = 1 THEN -1 ELSE 1 END END AS e
      FROM pa JOIN r USING (instrument_id, i) WINDOW w AS (PARTITION BY instrument_id, sim ORDER BY step ROWS UNBOUNDED PRECEDING))
    SELECT instrument_id, step, """
    + ", ".join(f"sign({_band(b)})::DOUBLE AS s{b}, CASE WHEN {_band(b)} <> 0 THEN round(ln(abs({_band(b)})), 5) END AS ln{b}" for b in V.BANDS)
    + " FROM eq GROUP BY 1, 2",
)

# ---- loads

for _name, _query, _digits, _text in loads.QUERIES:
    _add(_name, (lambda q, n: lambda s, d: _rounded(q(s, d), n))(_query, _digits), _text)

# ---- studies and report

_results = lambda s, d: S.studies(f.daily_bars(s, d), f.bench(s, d))
_STUDIES = "WITH " + study_sql.studies(f.BARS, ADX, RSI, _ewm, _roll, LR, FLOW) + " "
_add("q6_studies", lambda s, d: _rounded(_results(s, d), 4))
_add("q6_study_values", lambda s, d: _rounded(_results(s, d), 4, "instrument_id", "place", "study", "group", "value", "signal", "score"), _STUDIES + study_sql.VALUES)


def _json_values(s, d):
    """The values of the five studies that are maps, field by field."""
    shape = "hh boolean, hl boolean, signal string, `1m` double, `3m` double, `6m` double, `12m` double, close double, upper double, new_high boolean, vol_surge boolean"
    rows = _results(s, d).where("value_json is not null").select("instrument_id", "study", F.from_json("value_json", shape).alias("v"))
    return _rounded(rows.select("instrument_id", "study", *(F.col(f"v.`{c}`").alias(f"v_{c}") for c in ("hh", "hl", "signal", "1m", "3m", "6m", "12m", "close", "upper", "new_high", "vol_surge"))), 3)


_add("q6_study_json", _json_values, _STUDIES + study_sql.JSON)


def _failing(s, d):
    """Four added studies: one divides by zero on all instruments, one on even ones, one casts a text on the last one, one is sound."""
    flag = lambda x: F.struct(F.lit("added").alias("study"), F.lit("mine").alias("group"), x.cast("double").alias("value"), F.lit(None).cast("string").alias("value_json"), F.lit("bull").alias("signal"), F.lit(1.0).alias("score"), F.lit("").alias("note"))
    odd = (F.col("instrument_id") % 2).cast("double")
    own = [F.col("n") / (odd - odd), F.lit(1.0) / odd, F.when(F.col("instrument_id") == 7, F.lit("x")).otherwise("5").cast("int"), F.col("n")]
    return S.studies(f.daily_bars(s, d), f.bench(s, d), which=[*S.registry(), *map(flag, own)])


_add(
    "q5_failed_studies",
    lambda s, d: _rounded(_failing(s, d), 4, "instrument_id", "place", "study", "group", "value", "signal", "score"),
    _STUDIES + study_sql.VALUES + " UNION ALL " + study_sql.FAILED,
)
_add("q1_report", _flagship, _STUDIES + study_sql.REPORT)
_add("q7_listing", lambda s, d: S.listing(_results(s, d)).select("instrument_id", "group", "study", "signal", "signal_rank"), _STUDIES + study_sql.LISTING)


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
