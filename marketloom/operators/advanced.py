"""Add-on features for the gold layer: liquidity, calendar, regimes, candle patterns."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import Context, FeatureSet, compute, feature
from ..functions.numeric import div, flag
from ..functions.series import ANY_SPACING, Series
from .grid import fill_null_cells


@feature
def adv_liquidity(c: Context) -> FeatureSet:
    return FeatureSet(
        [
            {
                "price_weighted_volume": F.col("close") * F.col("volume"),
                "volume_imbalance": div(c.rows.diff("volume"), c.rows.mean("volume", 20)),
            }
        ],
        20,
    )


@feature
def adv_level_distance(c: Context, vwap: str | None = None, n: int = 20) -> FeatureSet:
    close = F.col("close")
    from_vwap = div(close - F.col(vwap), vwap) if vwap else F.lit(0.0)
    return FeatureSet(
        [
            {
                "distance_from_vwap": from_vwap,
                f"distance_from_high_{n}": div(c.rows.max("high", n) - close, close),
                f"distance_from_low_{n}": div(close - c.rows.min("low", n), close),
            }
        ],
        n,
    )


@feature
def adv_range_position(c: Context, eps: float = 0.0001) -> FeatureSet:
    width = F.col("high") - F.col("low") + eps
    return FeatureSet(
        [
            {
                "position_in_range": div(F.col("close") - F.col("low"), width),
                "price_efficiency": div(F.col("close") - F.col("open"), width),
            }
        ],
        0,
    )


@feature
def adv_volume_patterns(c: Context) -> FeatureSet:
    mean = c.rows.mean
    return FeatureSet(
        [
            {
                "volume_ratio_5_20": div(mean("volume", 5), mean("volume", 20)),
                "abnormal_volume": div("volume", mean("volume", 50)) - 1,
            }
        ],
        50,
    )


@feature
def adv_micro_vol(c: Context, n: int = 20) -> FeatureSet:
    return FeatureSet(
        [
            {"high_low_ratio": div("high", "low") - 1, "_ret": c.rows.pct("close")},
            {"close_to_close_vol": c.rows.std("_ret", n)},
        ],
        n + 1,
    )


def adv_session_flags(df: DataFrame, time: str = "time") -> DataFrame:
    hour = F.hour(time)
    return df.withColumns(
        {
            "hour": hour,
            "is_us_premarket": flag(hour.between(8, 14)),
            "is_us_regular": flag(hour.between(14, 20)),
            "is_us_afterhours": flag(hour.between(20, 24) | hour.between(0, 1)),
        }
    )


def adv_calendar(df: DataFrame, time: str = "time") -> DataFrame:
    day = F.weekday(time)
    return df.withColumns(
        {
            "minute": F.minute(time),
            "day_of_week": day,
            "is_monday": flag(day == 0),
            "is_friday": flag(day == 4),
            "month": F.month(time),
            "quarter": F.quarter(time),
        }
    )


def adv_open_close_flags(df: DataFrame, time: str = "time") -> DataFrame:
    hour, minute = F.hour(time), F.minute(time)
    return df.withColumns(
        {
            "is_market_open": flag((hour == 14) & (minute < 31)),
            "is_market_close": flag((hour == 20) & (minute >= 30)),
        }
    )


def adv_cyclical(df: DataFrame, time: str = "time") -> DataFrame:
    turn = 2 * math.pi
    hour, day = F.hour(time) * turn / 24, F.weekday(time) * turn / 7
    return df.withColumns(
        {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "dow_sin": F.sin(day), "dow_cos": F.cos(day)}
    )


#: Relative difference up to which two means count as equal.
NO_TREND = 1e-12


@feature
def adv_trend_regime(c: Context) -> FeatureSet:
    return FeatureSet(
        [
            {"sma_20": c.rows.mean("close", 20), "sma_50": c.rows.mean("close", 50)},
            {
                "trend_strength": div(F.col("sma_20") - F.col("sma_50"), "sma_50"),
                # the two sums of a flat price differ in their last bits: that is no trend
                "is_uptrend": flag(F.col("sma_20") - F.col("sma_50") > NO_TREND * F.abs("sma_50")),
            },
        ],
        50,
    )


@feature
def adv_vol_regime(c: Context, high: float = 1.5) -> FeatureSet:
    return FeatureSet(
        [
            {"_ret": c.rows.pct("close")},
            {"volatility_20": c.rows.std("_ret", 20), "volatility_50": c.rows.std("_ret", 50)},
            {"volatility_ratio": div("volatility_20", "volatility_50")},
            {"high_volatility": flag(F.col("volatility_ratio") > high)},
        ],
        51,
    )


@feature
def adv_volume_regime(c: Context, high: float = 1.2) -> FeatureSet:
    return FeatureSet(
        [
            {"volume_20": c.rows.mean("volume", 20), "volume_50": c.rows.mean("volume", 50)},
            {"volume_regime": div("volume_20", "volume_50")},
            {"high_volume": flag(F.col("volume_regime") > high)},
        ],
        50,
    )


@feature
def adv_market_stress(c: Context, long: int = 252) -> FeatureSet:
    """Weighted sum of the two regime flags and a volatility breakout."""
    vol = adv_vol_regime.using()(c)
    volume = adv_volume_regime.using()(c)
    layers = [dict(layer) for layer in vol.layers]
    for i, layer in enumerate(volume.layers):
        layers[i].update(layer)
    layers.append({"_stress_mean": c.rows.mean("volatility_20", long), "_stress_std": c.rows.std("volatility_20", long)})
    surge = flag(F.col("volatility_20") > F.col("_stress_mean") + 2 * F.col("_stress_std"))
    layers.append(
        {"market_stress": F.col("high_volatility") * 0.5 + F.col("high_volume") * 0.3 + surge * 0.2}
    )
    return FeatureSet(layers, vol.before + long)


def _shape() -> dict:
    top = F.greatest("close", "open")
    bottom = F.least("close", "open")
    return {
        "body_size": div(F.abs(F.col("close") - F.col("open")), "open"),
        "upper_shadow": div(F.col("high") - top, "open"),
        "lower_shadow": div(bottom - F.col("low"), "open"),
    }


@feature
def candle_shape(c: Context) -> FeatureSet:
    return FeatureSet([_shape()], 0)


@feature
def candle_patterns(c: Context) -> FeatureSet:
    body = F.col("body_size")
    return FeatureSet(
        [
            _shape(),
            {
                "prev_body": c.rows.lag("body_size"),
                "is_doji": flag(body < 0.001),
                "is_hammer": flag((body < 0.002) & (F.col("lower_shadow") > body * 2)),
            },
            {"is_engulfing": flag(body > F.col("prev_body") * 1.5)},
        ],
        1,
    )


@feature
def support_resistance(c: Context, n: int = 20) -> FeatureSet:
    return FeatureSet(
        [
            {
                f"near_{n}d_high": flag(F.col("close") > c.rows.max("high", n) * 0.98),
                f"near_{n}d_low": flag(F.col("close") < c.rows.min("low", n) * 1.02),
            }
        ],
        n,
    )


@feature
def breakout(c: Context, n: int = 20, exclude_current: bool = False) -> FeatureSet:
    """Close beyond the rolling extreme; by default the extreme includes the current bar."""
    shift = int(exclude_current)
    return FeatureSet(
        [
            {
                "breakout_up": flag(F.col("close") > c.rows.max("high", n, shift)),
                "breakout_down": flag(F.col("close") < c.rows.min("low", n, shift)),
            }
        ],
        n + shift,
    )


def ffill_then_zero(df: DataFrame, columns: Sequence[str], series: Series = Series()) -> DataFrame:
    """Forward fill, then zero what is left."""
    return fill_null_cells(df, columns, series).fillna(0, subset=list(columns))


def advanced_builders(vwap: str | None = None):
    return [
        adv_liquidity.using(), adv_level_distance.using(vwap=vwap), adv_range_position.using(),
        adv_volume_patterns.using(), adv_micro_vol.using(), adv_trend_regime.using(), adv_market_stress.using(),
        candle_patterns.using(), support_resistance.using(), breakout.using(),
    ]


def advanced_features(df: DataFrame, series: Series = ANY_SPACING) -> DataFrame:
    """All add-on features, then forward fill and zero, as one pass plus one fill."""
    vwap = "vwap" if "vwap" in df.columns else None
    wide = compute(df, series, advanced_builders(vwap))
    for step in (adv_session_flags, adv_calendar, adv_open_close_flags, adv_cyclical):
        wide = step(wide, series.time)
    fill = [c for c in wide.columns if c not in (*series.keys, series.time)]
    return ffill_then_zero(wide, fill, series)


@feature
def basic_dashboard_features(c: Context) -> FeatureSet:
    return FeatureSet(
        [
            {"returns": c.rows.pct("close"), "sma_20": c.rows.mean("close", 20), "sma_50": c.rows.mean("close", 50)},
            {"volatility": c.rows.std("returns", 20)},
        ],
        50,
    )
