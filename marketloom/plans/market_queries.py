"""Queries over bars: grid, indicators, microstructure, volatility, add-on features."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.series import Series
from ..operators import advanced as adv
from ..operators import grid as g
from ..operators import microstructure as mi
from ..operators import technical as te
from ..operators import volatility as vo
from .catalog import cols, lag, query, rnd, roll, sql
from .inputs import HOURLY, MINUTE, OHLCV, bars, hourly, minute_grid, ticks

G = "grid_1h"


def simple(name, op, columns, select, *, ctes: str = "", source: str = G, needs=(G,), recursive=False, ints=(), checks=None, **params):
    """Register a per-bar feature over the hourly grid, and as ``<name>_m1`` over the minute grid.

    The minute grid has several block and sub-block edges in each series.  Recursive checks take
    one step of SQL a row and stay on the hourly grid.  ``checks`` holds the SQL of a name that
    has its own.
    """
    checks = checks or {}
    floats = [c for c in columns if c not in ints]
    inner = f"f AS (SELECT instrument, time, {select} FROM {source})"
    tail = ", ".join(([rnd(*floats)] if floats else []) + list(ints))
    body = f"{ctes}{inner} SELECT instrument, time, {tail} FROM f"

    @query(name, checks.get(name) or sql(body, *needs, recursive=recursive))
    def run(spark, d):
        return cols(op(hourly(spark, d), HOURLY, **params), columns)

    if not recursive:
        own = checks.get(f"{name}_m1")
        @query(f"{name}_m1", own or sql(body.replace("_1h", "_1m"), *[n.replace("_1h", "_1m") for n in needs]))
        def run_m1(spark, d):
            return cols(op(g.grid_reindex_ffill(bars(spark, d, "M1"), MINUTE).select(*OHLCV), MINUTE, **params), columns)


def named(pairs) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in pairs.items())


# --- grid ---------------------------------------------------------------------------------------

for _k, _g, _n in (("ohlcv_bars", "H1", "1h"), ("ohlcv_bars_m1", "M1", "1m")):
    query(_k, sql(f"SELECT instrument, time, {rnd('open', 'high', 'low', 'close')}, volume FROM bars_{_n}", f"bars_{_n}"))(
        lambda s, d, _g=_g: bars(s, d, _g)
    )

query(
    "ohlcv_bars_daily",
    sql(
        "SELECT instrument, date_trunc('day', time)::TIMESTAMP AS time, R6(arg_min(price, time)) AS open, "
        "R6(max(price)) AS high, R6(min(price)) AS low, "
        "R6(arg_max(price, time)) AS close, count(*) AS volume FROM ticks GROUP BY 1, 2",
        "ticks",
    ),
)(lambda s, d: bars(s, d, "D"))

query(
    "grid_reindex_ffill",
    sql(
        f"SELECT instrument, time, {rnd('open', 'high', 'low', 'close')}, volume, "
        "minutes_since_last_data::INTEGER AS minutes_since_last_data, is_backfilled FROM grid_1m",
        "grid_1m",
    ),
)(lambda s, d: g.grid_reindex_ffill(bars(s, d, "M1"), MINUTE))

query(
    "minutes_since_last_data",
    sql("SELECT instrument, time, minutes_since_last_data::INTEGER AS minutes_since_last_data FROM grid_1m", "grid_1m"),
)(lambda s, d: g.minutes_since_last_data(bars(s, d, "M1"), MINUTE))

query("is_backfilled", sql("SELECT instrument, time, is_backfilled FROM grid_1m", "grid_1m"))(
    lambda s, d: g.is_backfilled(bars(s, d, "M1"), MINUTE)
)

ORIGINAL = {
    f"has_original_prev_30_to_{k}min": "coalesce(max(1 - is_backfilled) OVER (PARTITION BY instrument ORDER BY time "
    f"ROWS BETWEEN {k} PRECEDING AND 31 PRECEDING), 0)"
    for k in (60, 360)
}
for _c, _e in ORIGINAL.items():
    query(_c, sql(f"SELECT instrument, time, ({_e})::INTEGER AS {_c} FROM grid_1m", "grid_1m"))(
        lambda s, d, _c=_c: cols(minute_grid(s, d), [_c])
    )

query(
    "gap_coverage_stats",
    sql(
        f"f AS (SELECT instrument, is_backfilled, {named(ORIGINAL)} FROM grid_1m) SELECT instrument, "
        "R6(avg(is_backfilled)) AS backfilled_share, "
        "R6(avg(has_original_prev_30_to_60min)) AS recent_60_share, "
        "R6(avg(has_original_prev_30_to_360min)) AS recent_360_share, count(*) AS rows FROM f GROUP BY 1",
        "grid_1m",
    ),
)(lambda s, d: g.gap_coverage_stats(minute_grid(s, d), ["instrument"]))

query(
    "gap_minutes",
    sql(
        f"SELECT instrument, time, event_id, R6((epoch_us(time) - epoch_us({lag('time')})) / 60000000.0) "
        "AS gap_minutes FROM ticks",
        "ticks",
    ),
)(lambda s, d: g.gap_minutes(ticks(s, d).drop("price"), Series(step=None, ties=("event_id",))))

query(
    "session_bounds",
    sql(
        "SELECT instrument, time::DATE AS date, min(time) AS first_time, max(time) AS last_time, "
        "dayname(time::DATE) AS day_name FROM ticks GROUP BY 1, 2, 5",
        "ticks",
    ),
)(lambda s, d: g.session_bounds(ticks(s, d)))

query(
    "fill_within_day",
    sql(
        "s AS (SELECT instrument, time::DATE AS date, unnest(generate_series(min(time), max(time), INTERVAL 1 hour)) AS time "
        "FROM bars_1h GROUP BY 1, 2) SELECT s.instrument, s.date, s.time, R6(b.open) AS open, "
        "R6(b.high) AS high, R6(b.low) AS low, R6(b.close) AS close, b.volume "
        "FROM s LEFT JOIN bars_1h b USING (instrument, time)",
        "bars_1h",
    ),
)(lambda s, d: g.fill_within_day(bars(s, d), HOURLY))

query(
    "calendar_parts",
    sql(
        "SELECT instrument, time, time::DATE AS date, dayname(time) AS day_name, year(time)::INTEGER AS year, "
        "month(time)::INTEGER AS month, day(time)::INTEGER AS day, hour(time)::INTEGER AS hour FROM bars_1h",
        "bars_1h",
    ),
)(lambda s, d: g.calendar_parts(bars(s, d).select("instrument", "time")))

query(
    "floor_to_window",
    "SELECT event_id, time_bucket(INTERVAL 15 minute, ts, TIMESTAMP '2000-01-01') AS window_start FROM events",
)(lambda s, d: g.floor_to_window(ticks(s, d), 15).select("event_id", "window_start"))

query(
    "head_of_series",
    sql(f"SELECT instrument, time, {rnd('close')} FROM grid_1m ORDER BY time, instrument LIMIT 30000", "grid_1m"),
)(lambda s, d: cols(g.head_of_series(g.grid_reindex_ffill(bars(s, d, "M1"), MINUTE)), ["close"]))

# --- technical ----------------------------------------------------------------------------------

simple("returns", te.returns, [f"return_{k}" for k in te.RETURN_STEPS],
       named({f"return_{k}": f"close / nullif({lag('close', k)}, 0) - 1" for k in te.RETURN_STEPS}))

_rsi = (
    f"d AS (SELECT *, close - {lag('close')} AS delta FROM grid_1h), "
    "m AS (SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain, CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss FROM d), "
    "r AS (SELECT *, " + ", ".join(
        f"{roll('avg', 'gain', n)} AS g{n}, {roll('avg', 'loss', n)} AS l{n}" for n in (14, 20)) + " FROM m), "
)
simple("rsi", te.rsi, ["rsi_14", "rsi_20"], named({
    f"rsi_{n}": f"CASE WHEN l{n} = 0 THEN CASE WHEN g{n} > 0 THEN 100.0 END ELSE 100.0 - 100.0 / (1.0 + g{n} / l{n}) END"
    for n in (14, 20)}), ctes=_rsi, source="r")


def ema_sql(spans, name):
    idx = "i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY time) AS i FROM grid_1h), "
    first = ", ".join(f"close AS e{n}" for n in spans)
    nxt = ", ".join(f"{2 / (n + 1)!r} * i.close + {1 - 2 / (n + 1)!r} * {name}.e{n}" for n in spans)
    return idx + (
        f"{name} AS (SELECT instrument, time, i, {first} FROM i WHERE i = 1 UNION ALL "
        f"SELECT i.instrument, i.time, i.i, {nxt} FROM {name} JOIN i ON i.instrument = {name}.instrument AND i.i = {name}.i + 1), "
    )


simple("ema", te.ema, ["ema_7", "ema_14", "ema_21"], named({f"ema_{n}": f"e{n}" for n in (7, 14, 21)}),
       ctes=ema_sql((7, 14, 21), "e"), source="e", recursive=True)

_macd = (
    "i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY time) AS i FROM grid_1h), "
    "e AS (SELECT instrument, time, i, close AS a, close AS b, 0.0::DOUBLE AS s FROM i WHERE i = 1 UNION ALL "
    "SELECT instrument, time, i, a, b, 0.2 * (a - b) + 0.8 * s FROM (SELECT i.instrument, i.time, i.i, "
    "2.0 / 13 * i.close + 11.0 / 13 * e.a AS a, 2.0 / 27 * i.close + 25.0 / 27 * e.b AS b, e.s "
    "FROM e JOIN i ON i.instrument = e.instrument AND i.i = e.i + 1)), "
)
simple("macd", te.macd, ["macd", "macd_signal", "macd_histogram"],
       "a - b AS macd, s AS macd_signal, a - b - s AS macd_histogram", ctes=_macd, source="e", recursive=True)

simple("bollinger", te.bollinger, ["bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_position"],
       "m AS bb_middle, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, 4 * s / nullif(m, 0) AS bb_width, "
       "(close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0) AS bb_position",
       ctes=f"b AS (SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM grid_1h), ",
       source="b")
simple("sma", te.sma, [f"sma_{n}" for n in (7, 14, 21, 50)],
       named({f"sma_{n}": roll("avg", "close", n) for n in (7, 14, 21, 50)}))
TR = (
    f"t AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, "
    f"high - {lag('high')} AS up, {lag('low')} - low AS down FROM grid_1h), "
)
simple("true_range", te.true_range, ["true_range"], "tr AS true_range", ctes=TR, source="t")
simple("atr", te.atr, ["atr_14"], f"{roll('avg', 'tr', 14)} AS atr_14", ctes=TR, source="t")
simple("adx", te.adx, ["adx_14"], f"{roll('avg', 'dx', 14)} AS adx_14", source="x", ctes=TR + (
    "p AS (SELECT *, CASE WHEN up < 0 THEN 0 ELSE up END AS pdm, CASE WHEN down < 0 THEN 0 ELSE down END AS mdm FROM t), "
    f"y AS (SELECT instrument, time, 100 * {roll('avg', 'pdm', 14)} / nullif({roll('avg', 'tr', 14)}, 0) AS pdi, "
    f"100 * {roll('avg', 'mdm', 14)} / nullif({roll('avg', 'tr', 14)}, 0) AS mdi FROM p), "
    "x AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM y), "))
simple("momentum", te.momentum, [f"momentum_{k}" for k in (5, 10, 20)],
       named({f"momentum_{k}": f"close - {lag('close', k)}" for k in (5, 10, 20)}))
simple("roc", te.roc, ["roc_5", "roc_10"],
       named({f"roc_{k}": f"100 * (close - {lag('close', k)}) / nullif({lag('close', k)}, 0)" for k in (5, 10)}))
RET = f"r AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM grid_1h), "
simple("rolling_volatility", te.rolling_volatility, ["volatility_20", "volatility_50"],
       named({f"volatility_{n}": roll("stddev_samp", "ret", n) for n in (20, 50)}), ctes=RET, source="r")

query(
    "min_periods_guard",
    sql(
        f"SELECT instrument, date, time, {rnd('close')} FROM (SELECT *, time::DATE AS date FROM bars_1m) "
        "QUALIFY count(*) OVER (PARTITION BY instrument, date) >= 50",
        "bars_1m",
    ),
)(
    lambda s, d: te.min_periods_guard(
        g.calendar_parts(bars(s, d, "M1")).select("instrument", "date", "time", "close"), ("instrument", "date"), 50
    )
)

query(
    "drop_sparse_rows",
    sql(
        "f AS (SELECT instrument, time, " + ", ".join(
            f"close / nullif({lag('close', k)}, 0) - 1 AS return_{k}" for k in te.RETURN_STEPS) + " FROM grid_1h) "
        f"SELECT instrument, time, {rnd(*[f'return_{k}' for k in te.RETURN_STEPS])} FROM f WHERE 2 + "
        + " + ".join(f"(return_{k} IS NOT NULL)::INTEGER" for k in te.RETURN_STEPS) + " >= 0.5 * 15",
        G,
    ),
)(lambda s, d: te.drop_sparse_rows(cols(te.returns(hourly(s, d), HOURLY), [f"return_{k}" for k in te.RETURN_STEPS])))

# --- microstructure -----------------------------------------------------------------------------

simple("hl_range", mi.hl_range, ["hl_range", "hl_range_pct", "hl_range_ma20"],
       f"high - low AS hl_range, (high - low) / nullif(close, 0) AS hl_range_pct, {roll('avg', '(high - low)', 20)} AS hl_range_ma20")
simple("spread_proxy", mi.spread_proxy, ["spread_proxy", "spread_pct"],
       "high - low AS spread_proxy, (high - low) / nullif(close, 0) AS spread_pct")
simple("volume_profile", mi.volume_profile, ["volume_ma20", "volume_ma50", "volume_ratio", "volume_zscore"],
       "m20 AS volume_ma20, m50 AS volume_ma50, volume / nullif(m20, 0) AS volume_ratio, "
       "CASE WHEN s20 > 1e-12 THEN (volume - m20) / s20 END AS volume_zscore",
       ctes=f"v AS (SELECT *, {roll('avg', 'volume', 20)} AS m20, {roll('avg', 'volume', 50)} AS m50, "
            f"{roll('stddev_samp', 'volume', 20)} AS s20 FROM grid_1h), ", source="v")
simple("price_impact", mi.price_impact, ["price_impact", "price_impact_ma20"],
       f"price_impact, {roll('avg', 'price_impact', 20)} AS price_impact_ma20",
       ctes=f"p AS (SELECT *, abs(close - {lag('close')}) / (volume + 1) AS price_impact FROM grid_1h), ", source="p")
simple("order_flow_imbalance", mi.order_flow_imbalance, ["order_flow_imbalance"],
       "coalesce((close - open) / nullif(high - low, 0), 0) AS order_flow_imbalance")
simple("amihud_illiquidity", mi.amihud_illiquidity, ["illiquidity", "illiquidity_ma20"],
       f"illiquidity, {roll('avg', 'illiquidity', 20)} AS illiquidity_ma20",
       ctes=RET + "p AS (SELECT *, abs(ret) / (volume + 1) AS illiquidity FROM r), ", source="p")
simple("rolling_vwap", mi.rolling_vwap, ["vwap", "close_vwap_ratio"],
       "vwap, close / nullif(vwap, 0) AS close_vwap_ratio",
       ctes=f"v AS (SELECT *, {roll('sum', '(close * volume)', 20)} / nullif({roll('sum', 'volume', 20)}, 0) AS vwap FROM grid_1h), ",
       source="v")
simple("volume_dynamics", mi.volume_dynamics, ["volume_velocity", "volume_acceleration"],
       f"volume_velocity, volume_velocity - {lag('volume_velocity')} AS volume_acceleration",
       ctes=f"v AS (SELECT *, volume - {lag('volume')} AS volume_velocity FROM grid_1h), ", source="v",
       ints=("volume_velocity", "volume_acceleration"))

# --- volatility ---------------------------------------------------------------------------------

A = repr(math.sqrt(252))


def root(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN sqrt({x}) * {A} END"


def log_ratio(a: str, b: str) -> str:
    """ln(a / b); a zero denominator or a ratio that is not positive gives NULL, as the operators say."""
    return f"CASE WHEN {a} / nullif({b}, 0) > 0 THEN ln({a} / {b}) END"


def mean_check(value: str, term: str, unit: str, share: str = "1") -> str:
    """SQL of a volatility from the mean of a term of each bar, with ties of ticks and missing values as the operators say."""
    return sql(
        f"x AS (SELECT *, {term} AS u FROM clean_grid_{unit}), w AS (SELECT *, CASE WHEN isfinite(u) THEN u END AS t FROM x), "
        f"y AS (SELECT *, ({roll('avg', 't', 20)}) / ({share}) AS m FROM w), "
        f"f AS (SELECT instrument, time, {root('m')} AS {value} FROM y) SELECT instrument, time, {rnd(value)} FROM f",
        f"clean_grid_{unit}",
    )


HL, CO = log_ratio("high", "low"), log_ratio("close", "open")
GK = f"0.5 * ({HL}) ** 2 - (2 * ln(2) - 1) * ({CO}) ** 2"
simple("hist_vol", vo.hist_vol, ["hist_vol_20", "hist_vol_50"],
       named({f"hist_vol_{n}": f"({roll('stddev_samp', 'ret', n)}) * {A}" for n in (20, 50)}), ctes=RET, source="r")
simple("garman_klass", vo.garman_klass, ["gk_vol"], f"{root('m')} AS gk_vol", source="y", ctes=(
    f"x AS (SELECT *, {GK} AS t FROM grid_1h), "
    f"y AS (SELECT *, {roll('avg', 't', 20)} AS m FROM x), "), checks={"garman_klass_m1": mean_check("gk_vol", GK, "1m")})
simple("parkinson", vo.parkinson, ["parkinson_vol"], f"{root('m')} AS parkinson_vol", source="y", ctes=(
    f"y AS (SELECT *, ({roll('avg', f'(({HL}) ** 2)', 20)}) / (4 * ln(2)) AS m FROM grid_1h), "),
    checks={name: mean_check("parkinson_vol", f"({HL}) ** 2", unit, "4 * ln(2)") for name, unit in (("parkinson", "1h"), ("parkinson_m1", "1m"))})
RT = f"({log_ratio('high', 'close')}) * ({log_ratio('high', 'open')}) + ({log_ratio('low', 'close')}) * ({log_ratio('low', 'open')})"
RS = f"x AS (SELECT *, {RT} AS t, " \
     f"{log_ratio('open', lag('close'))} AS o, {CO} AS c FROM grid_1h), "
simple("rogers_satchell", vo.rogers_satchell, ["rs_vol"], f"{root('m')} AS rs_vol", source="y",
       ctes=RS + f"y AS (SELECT *, {roll('avg', 't', 20)} AS m FROM x), ", checks={"rogers_satchell": mean_check("rs_vol", RT, "1h")})
K = 0.34 / (1.34 + 21 / 19)
simple("yang_zhang", vo.yang_zhang, ["yz_vol"], f"{root('m')} AS yz_vol", source="y", ctes=RS + (
    f"y AS (SELECT *, ({roll('var_samp', 'o', 20)}) + {K!r} * ({roll('var_samp', 'c', 20)}) + {1 - K!r} * ({roll('avg', 't', 20)}) AS m FROM x), "))
HV = RET + f"h AS (SELECT *, ({roll('stddev_samp', 'ret', 20)}) * {A} AS hist_vol_20 FROM r), "
simple("vol_of_vol", vo.vol_of_vol, ["vol_of_vol"], f"{roll('stddev_samp', 'hist_vol_20', 20)} AS vol_of_vol",
       ctes=HV, source="h")

query(
    "vol_regime",
    sql(
        HV + "m AS (SELECT instrument, median(hist_vol_20) AS med FROM h GROUP BY 1) "
        "SELECT instrument, time, CASE WHEN hist_vol_20 < med * 0.7 THEN 1 ELSE 0 END AS vol_regime_low, "
        "CASE WHEN hist_vol_20 > med * 1.5 THEN 1 ELSE 0 END AS vol_regime_high FROM h JOIN m USING (instrument)",
        G,
    ),
)(lambda s, d: cols(vo.vol_regime(vo.hist_vol(hourly(s, d), HOURLY)), ["vol_regime_low", "vol_regime_high"]))

simple("realized_range", vo.realized_range, ["realized_range", "realized_range_ma"],
       f"rr AS realized_range, {roll('avg', 'rr', 20)} AS realized_range_ma",
       ctes="x AS (SELECT *, (high - low) / nullif(close, 0) AS rr FROM grid_1h), ", source="x")

B = 1 - 2 / 21
_ewma = RET + (
    "i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY time) AS i FROM r), "
    "e AS (SELECT instrument, time, i, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2, 0.0::DOUBLE AS q FROM i WHERE i = 1 UNION ALL "
    f"SELECT i.instrument, i.time, i.i, {B!r} * s0 + 1, {B!r} * s1 + ret, {B!r} * s2 + ret * ret, {B * B!r} * q + 1 "
    "FROM e JOIN i ON i.instrument = e.instrument AND i.i = e.i + 1), "
)
simple("ewma_vol", vo.ewma_vol, ["ewma_vol"],
       "CASE WHEN i > 2 THEN sqrt(greatest(s2 / s0 - (s1 / s0) ** 2, 0) * s0 * s0 / (s0 * s0 - q)) * " + A + " END AS ewma_vol",
       ctes=_ewma, source="e", recursive=True)

# --- add-on features ----------------------------------------------------------------------------

simple("adv_liquidity", adv.adv_liquidity, ["price_weighted_volume", "volume_imbalance"],
       f"close * volume AS price_weighted_volume, (volume - {lag('volume')}) / nullif({roll('avg', 'volume', 20)}, 0) AS volume_imbalance")
simple("adv_level_distance", adv.adv_level_distance,
       ["distance_from_vwap", "distance_from_high_20", "distance_from_low_20"],
       f"0.0::DOUBLE AS distance_from_vwap, (({roll('max', 'high', 20)}) - close) / nullif(close, 0) AS distance_from_high_20, "
       f"(close - ({roll('min', 'low', 20)})) / nullif(close, 0) AS distance_from_low_20")
simple("adv_range_position", adv.adv_range_position, ["position_in_range", "price_efficiency"],
       "(close - low) / (high - low + 0.0001) AS position_in_range, (close - open) / (high - low + 0.0001) AS price_efficiency")
simple("adv_volume_patterns", adv.adv_volume_patterns, ["volume_ratio_5_20", "abnormal_volume"],
       f"({roll('avg', 'volume', 5)}) / nullif({roll('avg', 'volume', 20)}, 0) AS volume_ratio_5_20, "
       f"volume / nullif({roll('avg', 'volume', 50)}, 0) - 1 AS abnormal_volume")
simple("adv_micro_vol", adv.adv_micro_vol, ["high_low_ratio", "close_to_close_vol"],
       f"high / nullif(low, 0) - 1 AS high_low_ratio, {roll('stddev_samp', 'ret', 20)} AS close_to_close_vol",
       ctes=RET, source="r")

CAL = {
    "adv_session_flags": (adv.adv_session_flags, {
        "hour": "hour(time)", "is_us_premarket": "(hour(time) BETWEEN 8 AND 14)",
        "is_us_regular": "(hour(time) BETWEEN 14 AND 20)",
        "is_us_afterhours": "(hour(time) BETWEEN 20 AND 24 OR hour(time) BETWEEN 0 AND 1)"}),
    "adv_calendar": (adv.adv_calendar, {
        "minute": "minute(time)", "day_of_week": "isodow(time) - 1", "is_monday": "(isodow(time) = 1)",
        "is_friday": "(isodow(time) = 5)", "month": "month(time)", "quarter": "quarter(time)"}),
    "adv_open_close_flags": (adv.adv_open_close_flags, {
        "is_market_open": "(hour(time) = 14 AND minute(time) < 31)",
        "is_market_close": "(hour(time) = 20 AND minute(time) >= 30)"}),
}
for _k, (_op, _c) in CAL.items():
    query(_k, sql("SELECT instrument, time, " + ", ".join(f"({e})::INTEGER AS {n}" for n, e in _c.items()) + " FROM bars_1m", "bars_1m"))(
        lambda s, d, _op=_op: _op(bars(s, d, "M1").select("instrument", "time"))
    )
query(
    "adv_cyclical",
    sql(
        "f AS (SELECT instrument, time, sin(2 * pi() * hour(time) / 24) AS hour_sin, cos(2 * pi() * hour(time) / 24) AS hour_cos, "
        "sin(2 * pi() * (isodow(time) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(time) - 1) / 7) AS dow_cos FROM bars_1m) "
        f"SELECT instrument, time, {rnd('hour_sin', 'hour_cos', 'dow_sin', 'dow_cos')} FROM f",
        "bars_1m",
    ),
)(lambda s, d: adv.adv_cyclical(bars(s, d, "M1").select("instrument", "time")))

simple("adv_trend_regime", adv.adv_trend_regime, ["sma_20", "sma_50", "trend_strength", "is_uptrend"],
       "a AS sma_20, b AS sma_50, (a - b) / nullif(b, 0) AS trend_strength, CASE WHEN a - b > 1e-12::DOUBLE * abs(b) THEN 1 ELSE 0 END AS is_uptrend",
       ctes=f"x AS (SELECT *, {roll('avg', 'close', 20)} AS a, {roll('avg', 'close', 50)} AS b FROM grid_1h), ",
       source="x", ints=("is_uptrend",))
STRESS = RET + (
    f"x AS (SELECT *, {roll('stddev_samp', 'ret', 20)} AS a, {roll('stddev_samp', 'ret', 50)} AS b, "
    f"{roll('avg', 'volume', 20)} AS va, {roll('avg', 'volume', 50)} AS vb FROM r), "
    "z AS (SELECT *, CASE WHEN a / nullif(b, 0) > 1.5 THEN 1 ELSE 0 END AS hv, CASE WHEN va / nullif(vb, 0) > 1.2 THEN 1 ELSE 0 END AS hvol, "
    f"{roll('avg', 'a', 252)} AS m, {roll('stddev_samp', 'a', 252)} AS s FROM x), "
)
simple("adv_vol_regime", adv.adv_vol_regime, ["volatility_20", "volatility_50", "volatility_ratio", "high_volatility"],
       "a AS volatility_20, b AS volatility_50, a / nullif(b, 0) AS volatility_ratio, hv AS high_volatility",
       ctes=STRESS, source="z", ints=("high_volatility",))
simple("adv_volume_regime", adv.adv_volume_regime, ["volume_20", "volume_50", "volume_regime", "high_volume"],
       "va AS volume_20, vb AS volume_50, va / nullif(vb, 0) AS volume_regime, hvol AS high_volume",
       ctes=STRESS, source="z", ints=("high_volume",))
simple("adv_market_stress", adv.adv_market_stress, ["market_stress"],
       "hv * 0.5 + hvol * 0.3 + (CASE WHEN a > m + 2 * s THEN 1 ELSE 0 END) * 0.2 AS market_stress",
       ctes=STRESS, source="z")
SHAPE = ("c AS (SELECT *, abs(close - open) / nullif(open, 0) AS body_size, (high - greatest(close, open)) / nullif(open, 0) AS upper_shadow, "
         "(least(close, open) - low) / nullif(open, 0) AS lower_shadow FROM grid_1h), ")
simple("candle_shape", adv.candle_shape, ["body_size", "upper_shadow", "lower_shadow"],
       "body_size, upper_shadow, lower_shadow", ctes=SHAPE, source="c")
simple("candle_patterns", adv.candle_patterns, ["is_doji", "is_hammer", "prev_body", "is_engulfing"],
       "CASE WHEN body_size < 0.001 THEN 1 ELSE 0 END AS is_doji, "
       "CASE WHEN body_size < 0.002 AND lower_shadow > body_size * 2 THEN 1 ELSE 0 END AS is_hammer, "
       f"{lag('body_size')} AS prev_body, CASE WHEN body_size > {lag('body_size')} * 1.5 THEN 1 ELSE 0 END AS is_engulfing",
       ctes=SHAPE, source="c", ints=("is_doji", "is_hammer", "is_engulfing"))
simple("support_resistance", adv.support_resistance, ["near_20d_high", "near_20d_low"],
       f"CASE WHEN close > ({roll('max', 'high', 20)}) * 0.98 THEN 1 ELSE 0 END AS near_20d_high, "
       f"CASE WHEN close < ({roll('min', 'low', 20)}) * 1.02 THEN 1 ELSE 0 END AS near_20d_low",
       ints=("near_20d_high", "near_20d_low"))
simple("breakout", adv.breakout, ["breakout_up", "breakout_down"],
       f"CASE WHEN close > ({roll('max', 'high', 20)}) THEN 1 ELSE 0 END AS breakout_up, "
       f"CASE WHEN close < ({roll('min', 'low', 20)}) THEN 1 ELSE 0 END AS breakout_down",
       ints=("breakout_up", "breakout_down"))
_prev = {x: f"CASE WHEN count({c}) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 "
            f"THEN {x}({c}) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END"
         for x, c in (("max", "high"), ("min", "low"))}
simple("breakout_previous", adv.breakout, ["breakout_up", "breakout_down"],
       f"CASE WHEN close > ({_prev['max']}) THEN 1 ELSE 0 END AS breakout_up, "
       f"CASE WHEN close < ({_prev['min']}) THEN 1 ELSE 0 END AS breakout_down",
       ints=("breakout_up", "breakout_down"), exclude_current=True)

@query("ffill_then_zero", sql(
    "SELECT instrument, time, " + ", ".join(
            f"R6(coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY time "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) AS {c}" for c in ("open", "close"))
        + " FROM (SELECT instrument, time, CASE WHEN volume > 3 THEN open END AS open, "
        "CASE WHEN volume % 3 = 1 THEN close END AS close FROM grid_1h)", G))
def _ffill_then_zero(s, d):
    h = hourly(s, d)
    holes = h.select("instrument", "time", F.when(F.col("volume") > 3, F.col("open")).alias("open"),
                     F.when(F.col("volume") % 3 == 1, F.col("close")).alias("close"))
    return adv.ffill_then_zero(holes, ["open", "close"], HOURLY)


simple("basic_dashboard_features", adv.basic_dashboard_features, ["returns", "volatility", "sma_20", "sma_50"],
       f"ret AS returns, {roll('stddev_samp', 'ret', 20)} AS volatility, {roll('avg', 'close', 20)} AS sma_20, "
       f"{roll('avg', 'close', 50)} AS sma_50", ctes=RET, source="r")
