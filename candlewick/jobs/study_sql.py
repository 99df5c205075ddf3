"""The study battery in SQL, for checking: facts of each instrument's last bar, then one SELECT for each study."""

from __future__ import annotations

from collections.abc import Callable


def _steps(x: str, bull: float, bear: float) -> str:
    return f"CASE WHEN {x} >= {bull} THEN 'bull' WHEN {x} <= {bear} THEN 'bear' ELSE 'neutral' END"


def _side(bull: str, bear: str) -> str:
    return f"CASE WHEN {bull} THEN 'bull' WHEN {bear} THEN 'bear' ELSE 'neutral' END"


def _clip(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


def _scored(signal: str, bull: float, bear: float) -> str:
    return f"CASE {signal} WHEN 'bull' THEN {bull} WHEN 'bear' THEN {bear} ELSE 0.5 END"


#: From n closes' logarithms l, the mean rescaled range of segments of k.
_RANGES = """hs AS (SELECT instrument_id, k, l[i + 1:i + k] AS s FROM (SELECT instrument_id, l, k, unnest(range(0, len(l) - k, k)) AS i FROM lg, (VALUES (2), (4), (8), (16), (32)) v(k))),
hd AS (SELECT instrument_id, k, list_aggregate(s, 'stddev_samp') AS sd, [list_sum(s[1:j]) - j * list_avg(s) for j in range(1, k + 1)] AS d FROM hs),
hy AS (SELECT instrument_id, ln(k) AS x, ln(avg((list_max(d) - list_min(d)) / sd) FILTER (sd > 0)) AS y FROM hd GROUP BY instrument_id, k),
hu AS (SELECT instrument_id, CASE WHEN count(y) >= 3 THEN regr_slope(y, x) END AS hurst FROM hy GROUP BY 1)"""


def studies(bars: str, adx: str, rsi: str, ewm: Callable, roll: Callable, returns: str, flow: str) -> str:
    """CTEs that end in ``st`` (instrument_id, study, "group", value, signal, score); the pieces are the catalogue's."""
    using = "USING (instrument_id, ts)"
    w, key = "OVER (PARTITION BY instrument_id ORDER BY ts)", "OVER (PARTITION BY instrument_id)"
    before = lambda p: f"OVER (PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN {p} PRECEDING AND 1 PRECEDING)"
    frame = lambda p: f"OVER (PARTITION BY instrument_id ORDER BY ts ROWS {p - 1} PRECEDING)"
    mid = lambda p: f"(({roll('max', 'high', p)}) + ({roll('min', 'low', p)})) / 2"
    ctes = [
        bars, adx, rsi, returns, flow,
        ewm("ma", "bars", "close", 2 / 13), ewm("mb", "bars", "close", 2 / 27),
        f"mc AS (SELECT instrument_id, ts, ma.y - mb.y AS m FROM ma JOIN mb {using})", ewm("mg", "mc", "m", 2 / 10),
        f"mh AS (SELECT instrument_id, ts, m - mg.y AS h, lag(m - mg.y) {w} AS h1 FROM mc JOIN mg {using})",
        f"ob AS (SELECT instrument_id, ts, o, lag(o, 20) {w} AS o20 FROM (SELECT instrument_id, ts, sum(v) OVER (PARTITION BY instrument_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS o FROM (SELECT instrument_id, ts, coalesce(sign(close - lag(close) {w}), 0) * volume AS v FROM bars)))",
        f"ic AS (SELECT instrument_id, ts, lag((tk + kj) / 2, 26) {w} AS sa, lag(sb, 26) {w} AS sb FROM (SELECT instrument_id, ts, {mid(9)} AS tk, {mid(26)} AS kj, {mid(52)} AS sb FROM bars))",
        f"vo AS (SELECT instrument_id, ts, ({roll('stddev_samp', 'lr', 20)}) * sqrt(252) AS vol, lr, lag(lr) {w} AS lr1 FROM lr)",
        f"ac AS (SELECT instrument_id, corr(lr, lr1) AS ac1, count(vol) AS vols FROM vo GROUP BY 1)",
        f"cf AS (SELECT instrument_id, ts, ({roll('sum', 'fl', 20)}) / nullif({roll('sum', 'volume', 20)}, 0) AS cmf FROM fl)",
        "fa AS (SELECT instrument_id, ts, close, volume, "
        + ", ".join(f"{roll('avg', 'close', p)} AS sma{p}" for p in (10, 20, 50, 100, 200)) + ", "
        + ", ".join(f"lag(close, {k}) {w} AS c{k}" for k in (20, 62, 125, 251))
        + f", row_number() {w} AS rn, count(*) {key} AS n, max(close) {frame(252)} AS top252, max(close) {key} AS topall, CASE WHEN count(high) {before(252)} = 252 THEN max(high) {before(252)} END AS h252, CASE WHEN count(low) {before(252)} = 252 THEN min(low) {before(252)} END AS l252"
        f", max(high) {before('UNBOUNDED')} AS hb, min(low) {before('UNBOUNDED')} AS lb, max(close) {before(21)} AS top21, quantile_cont(volume, 0.5) {before(21)} AS v21, min(low) {frame(22)} AS low22, {roll('stddev_pop', 'close', 20)} AS sd20"
        f", list(close) {frame(60)} AS c60, list(ln(close)) {frame(500)} AS l FROM bars)",
        f"fb AS (SELECT *, lag(sma50, 4) {w} AS sma50_4 FROM fa)",
        f"rk AS (SELECT instrument_id, ts, list(rsi) {frame(10)} AS r10 FROM rsi)",
        f"vk AS (SELECT instrument_id, ts, list(vol) {frame(252)} AS v252 FROM vo)",
        f"z0 AS (SELECT fb.*, sma20 + 2 * sd20 AS bu, sma20 - 2 * sd20 AS bl, rsi.rsi, r10, h, h1, o, o20, sa, sb, cmf, v252, ac1, vols, x.y AS adx, pdi, mdi, t.y AS atr FROM fb JOIN rsi {using} JOIN rk {using} LEFT JOIN mh {using} LEFT JOIN ob {using} LEFT JOIN ic {using} LEFT JOIN cf {using} LEFT JOIN vk {using} LEFT JOIN x {using} LEFT JOIN di {using} LEFT JOIN t {using} LEFT JOIN ac USING (instrument_id) WHERE rn = n)",
        "lg AS (SELECT instrument_id, l FROM z0)", _RANGES,
        "pk AS (SELECT instrument_id, [c60[i] for i in range(2, len(c60)) if c60[i] > c60[i - 1] AND c60[i] > c60[i + 1]] AS hi, [c60[i] for i in range(2, len(c60)) if c60[i] < c60[i - 1] AND c60[i] < c60[i + 1]] AS lo FROM z0)",
        "cm AS (SELECT a.instrument_id, a.close AS a, b.close AS b, row_number() OVER (PARTITION BY a.instrument_id ORDER BY a.ts DESC) AS back FROM bars a JOIN bars b ON a.ts = b.ts WHERE b.instrument_id = 1 AND a.instrument_id <> 1)",
        "rs AS (SELECT instrument_id, count(*) AS common, (max(a) FILTER (back = 1) / max(a) FILTER (back = 63)) / (max(b) FILTER (back = 1) / max(b) FILTER (back = 63)) AS rs FROM cm GROUP BY 1)",
        """z AS (SELECT z0.*, hurst, common, rs, coalesce(hi[-1] > hi[-2], false) AS hh, coalesce(lo[-1] > lo[-2], false) AS hl, len(list_filter(r10, lambda v: v > 70)) AS hot,
          (close / sma200 - 1) * 100 AS p200, (sma50 - sma50_4) / sma50_4 * 100 AS slope, (c20 / c251 - 1) * 100 AS year, (close / top252 - 1) * 100 AS off, (close / topall - 1) * 100 AS fall, (close - bl) / nullif(bu - bl, 0) AS band,
          CASE WHEN atr > 0 THEN (close - sma50) / atr ELSE 0 END AS far, (o - o20) / greatest(abs(o20), 1) AS flow, close - least(low22, close - 2 * atr) AS risk,
          (close > sma10)::INT + coalesce((close > sma20)::INT, 0) + coalesce((close > sma50)::INT, 0) + coalesce((close > sma100)::INT, 0) + coalesce((close > sma200)::INT, 0) AS above,
          (n > 21 AND close > c20)::INT + coalesce((n > 63 AND close > c62)::INT, 0) + coalesce((n > 126 AND close > c125)::INT, 0) + coalesce((n > 252 AND close > c251)::INT, 0) AS ups,
          (n > 21)::INT + (n > 63)::INT + (n > 126)::INT + (n > 252)::INT AS asked, (n >= 10)::INT + (n >= 20)::INT + (n >= 50)::INT + (n >= 100)::INT + (n >= 200)::INT AS have,
          CASE WHEN vols < 30 THEN 0.5 WHEN len(list_filter(v252, lambda v: v IS NOT NULL)) = 252 THEN (len(list_filter(v252[1:251], lambda v: v < v252[252])) + len(list_filter(v252[1:251], lambda v: v <= v252[252]))
            + (len(list_filter(v252[1:251], lambda v: v <= v252[252])) > len(list_filter(v252[1:251], lambda v: v < v252[252])))::INT) * 50.0 / 251 / 100 END AS vr
          FROM z0 LEFT JOIN hu USING (instrument_id) LEFT JOIN rs USING (instrument_id) LEFT JOIN pk USING (instrument_id))""",
    ]
    rows = []

    def add(name: str, group: str, value: str, signal: str, score: str, enough: str = "true", short: str | None = None) -> None:
        rows.append(
            f"SELECT instrument_id, {len(rows)} AS place, CASE WHEN {enough} THEN '{name}' ELSE '{short or name}' END AS study, '{group}' AS grp, CASE WHEN {enough} THEN {value} END::DOUBLE AS value, "
            f"CASE WHEN {enough} THEN {signal} ELSE 'neutral' END AS signal, CASE WHEN {enough} THEN {score} ELSE 0.5 END::DOUBLE AS score FROM z"
        )

    r = lambda x, k: f"round_even({x}, {k})"
    stack = "CASE WHEN have > 0 THEN above / have ELSE 0.5 END"
    cloud = f"CASE WHEN sa IS NULL OR sb IS NULL THEN 'neutral' ELSE {_side('close > greatest(sa, sb)', 'close < least(sa, sb)')} END"
    hist = _side("h > 0 AND h > h1", "h < 0 AND h < h1")
    channel = _side("close >= CASE WHEN n >= 252 THEN h252 ELSE hb END", "close <= CASE WHEN n >= 252 THEN l252 ELSE lb END")
    high, surge = "coalesce(close >= top21, false)", "coalesce(volume > v21 * 1.5, false)"
    burst = f"CASE WHEN {high} AND {surge} THEN 'bull' WHEN {high} OR {surge} THEN 'neutral' ELSE 'bear' END"
    add("MA Stack/Alignment", "trend", stack, _steps(f"({stack})", 0.8, 0.2), stack)
    add("Price vs 200-DMA", "trend", r("p200", 2), _steps("p200", 5, -5), _clip("(p200 + 30) / 60"), "n >= 200")
    add("MA Slope (50-DMA)", "trend", r("slope", 3), _steps("slope", 0.5, -0.5), _clip("(slope + 3) / 6"), "n >= 55", "MA Slope")
    add("HH/HL Structure", "trend", "NULL", _side("hh AND hl", "NOT hh AND NOT hl"), "0.5 * hh::INT + 0.5 * hl::INT")
    add("ADX Strength", "trend", r("adx", 1), _side("adx > 25 AND pdi > mdi", "adx > 25 AND mdi > pdi"), f"{_clip('adx / 50')} * CASE WHEN pdi > mdi THEN 1 ELSE -1 END * 0.5 + 0.5", "n >= 30")
    add("Ichimoku Regime", "trend", "NULL", cloud, _scored(cloud, 0.8, 0.2), "n >= 80")
    add("12-1m Academic Momentum", "momentum", r("year", 2), _steps("year", 10, -10), _clip("(year + 50) / 100"), "n >= 252")
    add("ROC Multi-Period", "momentum", "NULL", _steps("(ups / asked)", 0.75, 0.25), "ups / asked", "n > 21")
    add("RSI", "momentum", r("rsi", 1), _side("rsi > 50", "rsi < 50"), "rsi / 100", "n >= 20")
    add("MACD State", "momentum", r("h", 4), hist, _scored(hist, 0.7, 0.3), "n >= 35")
    add("52w High Proximity", "momentum", r("off", 2), _steps("off", -5, -20), _clip("1 + off / 50"))
    add("RS vs SPY (3m)", "relative_strength", r("rs", 4), _steps("rs", 1.05, 0.95), _clip("(rs - 0.7) / 0.6"), "coalesce(common >= 63, false)", "RS vs SPY")
    add("Donchian 52w Breakout", "breakout", "NULL", channel, _scored(channel, 0.8, 0.2), "n >= 55")
    add("Volume-Confirmed Breakout", "breakout", "NULL", burst, f"CASE {burst} WHEN 'bull' THEN 0.85 WHEN 'neutral' THEN 0.5 ELSE 0.3 END", "n >= 22")
    add("% Above 200-DMA", "extension", r("p200", 2), "CASE WHEN p200 > 30 THEN 'bear' WHEN p200 > 0 THEN 'bull' ELSE 'neutral' END", _clip("1 - p200 / 80"), "n >= 200")
    add("Bollinger %B", "extension", r("band", 3), f"CASE WHEN band > 1 THEN 'bear' WHEN band < 0 THEN 'bull' ELSE {_steps('band', 0.5, 0.2)} END", _clip("band"), "n >= 25")
    add("ATR Distance from MA50", "extension", r("far", 2), _side("far < -2", "far > 3"), _clip("1 - far / 5"), "n >= 55")
    add("RSI Overbought Streak", "extension", "hot", "CASE WHEN hot >= 7 THEN 'bear' ELSE 'neutral' END", _clip("1 - hot / 10"), "n >= 20")
    add("Volatility Regime (ATR %ile)", "volatility", r("vr", 3), _side("vr < 0.3", "vr > 0.8"), "1 - vr", "n >= 60", "Volatility Regime")
    add("Drawdown from ATH", "volatility", r("fall", 2), _side("fall > -10", "fall < -30"), _clip("1 + fall / 50"))
    add("OBV Trend", "volume", r("flow", 4), _steps("flow", 0.05, -0.05), _clip("(flow + 0.2) / 0.4"), "n >= 22")
    add("Chaikin Money Flow", "volume", r("cmf", 4), _steps("cmf", 0.05, -0.05), _clip("cmf + 0.5"), "n >= 22")
    add("Hurst Exponent", "statistical", r("hurst", 3), _side("hurst > 0.6", "hurst < 0.4"), _clip("(hurst - 0.2) / 0.6"), "n >= 50 AND hurst IS NOT NULL")
    add("Momentum Persistence (AC1)", "statistical", r("ac1", 4), _steps("ac1", 0.05, -0.05), _clip("(ac1 + 0.3) / 0.6"), "n >= 30", "Momentum Persistence")
    add("R/R to Support", "risk_of_entry", "CASE WHEN risk > 0 THEN 2 END", "CASE WHEN risk > 0 THEN 'bull' ELSE 'neutral' END", f"CASE WHEN risk > 0 THEN {_clip('(2 - 0.5) / 3.5')} ELSE 0.5 END", "n >= 22")
    return ", ".join(ctes) + ", st AS (" + " UNION ALL ".join(rows) + ")"


VALUES = 'SELECT instrument_id, place::INT AS place, study, grp AS "group", round(value, 4) AS value, signal, round(score, 4) AS score FROM st'
#: Added studies: the first fails on all instruments, the second on even ones, the third on instrument 7, the last on none.
FAILED = """SELECT instrument_id, p::INT AS place, CASE WHEN ok THEN 'added' ELSE 'study ' || p END AS study, CASE WHEN ok THEN 'mine' ELSE 'error' END AS "group", CASE WHEN ok THEN v END::DOUBLE AS value,
  CASE WHEN ok THEN 'bull' ELSE 'neutral' END AS signal, CASE WHEN ok THEN 1 ELSE 0.5 END::DOUBLE AS score FROM (SELECT instrument_id, p, CASE p WHEN 25 THEN false WHEN 26 THEN instrument_id % 2 = 1 WHEN 27 THEN instrument_id <> 7 ELSE true END AS ok,
  CASE p WHEN 26 THEN 1 WHEN 27 THEN 5 ELSE n END AS v FROM z, (VALUES (25), (26), (27), (28)) t(p))"""
_NO = {"hh": "BOOLEAN", "hl": "BOOLEAN", "signal": "VARCHAR", "1m": "DOUBLE", "3m": "DOUBLE", "6m": "DOUBLE", "12m": "DOUBLE", "close": "DOUBLE", "upper": "DOUBLE", "new_high": "BOOLEAN", "vol_surge": "BOOLEAN"}


def _map(study: str, least: int, **fields: str) -> str:
    """A study's map as columns; fields named 1m and so on are given as m1."""
    own = {k[1:] + "m" if k[0] == "m" else k: v for k, v in fields.items()}
    return f"SELECT instrument_id, '{study}' AS study, " + ", ".join(f'({own.get(n, "NULL")})::{t} AS "v_{n}"' for n, t in _NO.items()) + f" FROM z WHERE n >= {least}"


def _change(p: int, c: str) -> str:
    return f"CASE WHEN n > {p} THEN round(round_even((close / {c} - 1) * 100, 4), 3) END"


JSON = " UNION ALL ".join([
    _map("HH/HL Structure", 0, hh="hh", hl="hl"),
    _map("Ichimoku Regime", 80, signal=f"CASE WHEN sa IS NULL OR sb IS NULL THEN 'neutral' ELSE {_side('close > greatest(sa, sb)', 'close < least(sa, sb)')} END"),
    _map("ROC Multi-Period", 22, m1=_change(21, "c20"), m3=_change(63, "c62"), m6=_change(126, "c125"), m12=_change(252, "c251")),
    _map("Donchian 52w Breakout", 55, close="round_even(close, 2)", upper="round_even(CASE WHEN n >= 252 THEN h252 ELSE hb END, 2)"),
    _map("Volume-Confirmed Breakout", 22, new_high="coalesce(close >= top21, false)", vol_surge="coalesce(volume > v21 * 1.5, false)"),
])
LISTING = "SELECT instrument_id, grp AS \"group\", study, signal, CASE signal WHEN 'bull' THEN 0 WHEN 'bear' THEN 2 ELSE 1 END AS signal_rank FROM st"
_INTACT = "grp IN ('trend', 'momentum', 'relative_strength', 'breakout', 'statistical')"
REPORT = f"""SELECT instrument_id, coalesce(round_even(count(*) FILTER ({_INTACT} AND signal = 'bull') / nullif(count(*) FILTER ({_INTACT}), 0), 3), 0.5) AS momentum_intact_score,
  coalesce(round_even(count(*) FILTER (grp = 'extension' AND signal = 'bear') / nullif(count(*) FILTER (grp = 'extension'), 0), 3), 0) AS extension_score,
  round_even(count(*) FILTER (signal = 'bull') / count(*) * 100, 1) AS bull_pct, round_even(count(*) FILTER (signal = 'bear') / count(*) * 100, 1) AS bear_pct, count(*) AS n_studies,
  CASE WHEN coalesce(max(value) FILTER (study = 'ADX Strength'), 20) > 25 AND coalesce(max(value) FILTER (study = 'Hurst Exponent'), 0.5) > 0.55 THEN 'trending' WHEN coalesce(max(value) FILTER (study = 'Volatility Regime (ATR %ile)'), 0.5) > 0.75 THEN 'high_volatility'
    WHEN coalesce(max(value) FILTER (study = 'Hurst Exponent'), 0.5) < 0.45 THEN 'mean_reverting' ELSE 'range_bound' END AS regime FROM st GROUP BY 1"""
