"""Queries that run whole stages."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import medallion as md
from .catalog import cols, query, rnd, roll, sql
from .gold_queries import actionable
from .inputs import HOURLY, MINUTE, bars

SILVER = ["return_1", "return_360", "sma_50", "rsi_14", "volatility_20", "hl_range_ma20", "volume_ma50", "vwap", "hist_vol_20", "realized_range_ma"]


SILVER_SQL = (
    "d AS (SELECT *, close - lag(close) OVER w AS delta, close / nullif(lag(close) OVER w, 0) - 1 AS return_1, close / nullif(lag(close, 360) OVER w, 0) - 1 AS return_360 "
    "FROM grid_1h WINDOW w AS (PARTITION BY instrument ORDER BY time)), "
    "g AS (SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain, CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss, (high - low) / nullif(close, 0) AS rr FROM d), "
    f"f AS (SELECT instrument, time, return_1, return_360, {roll('avg', 'close', 50)} AS sma_50, {roll('avg', 'gain', 14)} AS g14, {roll('avg', 'loss', 14)} AS l14, "
    f"{roll('stddev_samp', 'return_1', 20)} AS volatility_20, {roll('avg', '(high - low)', 20)} AS hl_range_ma20, {roll('avg', 'volume', 50)} AS volume_ma50, "
    f"({roll('sum', '(close * volume)', 20)}) / ({roll('sum', 'volume', 20)}) AS vwap, {roll('avg', 'rr', 20)} AS realized_range_ma FROM g), "
    "h AS (SELECT *, volatility_20 * sqrt(252) AS hist_vol_20, CASE WHEN l14 = 0 THEN CASE WHEN g14 > 0 THEN 100 END ELSE 100 - 100 / (1 + g14 / l14) END AS rsi_14 FROM f) "
    f"SELECT instrument, time, {rnd(*SILVER)} FROM h")


@query("silver_market_features", sql(SILVER_SQL, "grid_1h"))
def _silver(s, d):
    return cols(md.silver_market(bars(s, d), HOURLY, gaps=False), SILVER)


@query("silver_selected_m1", sql(SILVER_SQL.replace("grid_1h", "grid_1m"), "grid_1m"))
def _silver_selected(s, d):
    """The same columns over the minute grid, across block edges."""
    return cols(md.silver_market(bars(s, d, "M1"), MINUTE, gaps=False), SILVER)


@query("silver_market_features_m1")
def _silver_m1(s, d):
    """All silver features over the minute grid, summarised so that the check stays small."""
    wide = md.silver_market(bars(s, d, "M1"), MINUTE)
    skip = ("instrument", "time")
    return wide.groupBy("instrument").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in wide.columns if c not in skip])


@query("training_table")
def _training(s, d):
    return md.training_table(bars(s, d), actionable(s, d), HOURLY)
