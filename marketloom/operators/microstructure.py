"""Liquidity and order-flow proxies from bars (silver layer)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import Context, FeatureSet, compute, feature
from ..functions.numeric import div
from ..functions.series import ANY_SPACING, Series

def _range():
    return F.col("high") - F.col("low")


@feature
def hl_range(c: Context, n: int = 20) -> FeatureSet:
    return FeatureSet(
        [
            {"hl_range": _range(), "hl_range_pct": div(_range(), "close")},
            {f"hl_range_ma{n}": c.rows.mean("hl_range", n)},
        ],
        n,
    )


@feature
def spread_proxy(c: Context) -> FeatureSet:
    return FeatureSet([{"spread_proxy": _range(), "spread_pct": div(_range(), "close")}], 0)


@feature
def volume_profile(c: Context) -> FeatureSet:
    roll = c.rows
    return FeatureSet(
        [
            {"volume_ma20": roll.mean("volume", 20), "volume_ma50": roll.mean("volume", 50),
             "_volume_std20": roll.std("volume", 20)},
            {
                "volume_ratio": div("volume", "volume_ma20"),
                "volume_zscore": F.when(
                    F.col("_volume_std20") > 1e-12,
                    div(F.col("volume") - F.col("volume_ma20"), "_volume_std20"),
                ),
            },
        ],
        50,
    )


@feature
def price_impact(c: Context, n: int = 20) -> FeatureSet:
    return FeatureSet(
        [
            {"price_impact": F.abs(c.rows.diff("close")) / (F.col("volume") + 1)},
            {f"price_impact_ma{n}": c.rows.mean("price_impact", n)},
        ],
        n + 1,
    )


@feature
def order_flow_imbalance(c: Context) -> FeatureSet:
    return FeatureSet(
        [{"order_flow_imbalance": F.coalesce(div(F.col("close") - F.col("open"), _range()), F.lit(0.0))}], 0
    )


@feature
def amihud_illiquidity(c: Context, n: int = 20) -> FeatureSet:
    return FeatureSet(
        [
            {"illiquidity": F.abs(c.rows.pct("close")) / (F.col("volume") + 1)},
            {f"illiquidity_ma{n}": c.rows.mean("illiquidity", n)},
        ],
        n + 1,
    )


@feature
def rolling_vwap(c: Context, n: int = 20) -> FeatureSet:
    return FeatureSet(
        [
            {"_turnover": F.col("close") * F.col("volume")},
            {"vwap": div(c.rows.sum("_turnover", n), c.rows.sum("volume", n))},
            {"close_vwap_ratio": div("close", "vwap")},
        ],
        n,
    )


@feature
def volume_dynamics(c: Context) -> FeatureSet:
    return FeatureSet(
        [
            {"volume_velocity": c.rows.diff("volume")},
            {"volume_acceleration": c.rows.diff("volume_velocity")},
        ],
        2,
    )


def microstructure_builders():
    return [
        hl_range.using(), spread_proxy.using(), volume_profile.using(), price_impact.using(),
        order_flow_imbalance.using(), amihud_illiquidity.using(), rolling_vwap.using(), volume_dynamics.using(),
    ]


def microstructure_features(df: DataFrame, series: Series = ANY_SPACING) -> DataFrame:
    return compute(df, series, microstructure_builders())
