"""Volatility estimators over rolling windows, annualised (silver layer)."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import Context, FeatureSet, compute, feature
from ..functions.frames import attach_by_key
from ..functions.numeric import div, flag, safe_sqrt
from ..functions.ranks import exact_median
from ..functions.rolling import warmup
from ..functions.series import ANY_SPACING, Series
from .technical import return_deviations

ANNUAL = math.sqrt(252)


def _log_ratio(a: str, b: str) -> Column:
    ratio = div(a, b)
    return F.when(ratio > 0, F.ln(ratio))


@feature
def hist_vol(c: Context, periods=(20, 50)) -> FeatureSet:
    out = {f"hist_vol_{n}": F.col(f"_ret_std_{n}") * ANNUAL for n in periods}
    return FeatureSet([*return_deviations(c, periods), out], max(periods) + 1)


@feature
def garman_klass(c: Context, n: int = 20) -> FeatureSet:
    hl, co = _log_ratio("high", "low"), _log_ratio("close", "open")
    term = 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co
    return FeatureSet(
        [{"_gk": term}, {"_gk_mean": c.rows.mean("_gk", n)}, {"gk_vol": safe_sqrt("_gk_mean") * ANNUAL}], n
    )


@feature
def parkinson(c: Context, n: int = 20) -> FeatureSet:
    hl = _log_ratio("high", "low")
    return FeatureSet(
        [
            {"_pk": hl * hl},
            {"_pk_mean": c.rows.mean("_pk", n)},
            {"parkinson_vol": safe_sqrt(F.col("_pk_mean") / (4 * math.log(2))) * ANNUAL},
        ],
        n,
    )


def _rs_term() -> Column:
    return _log_ratio("high", "close") * _log_ratio("high", "open") + _log_ratio("low", "close") * _log_ratio(
        "low", "open"
    )


@feature
def rogers_satchell(c: Context, n: int = 20) -> FeatureSet:
    return FeatureSet(
        [{"_rs": _rs_term()}, {"_rs_mean": c.rows.mean("_rs", n)}, {"rs_vol": safe_sqrt("_rs_mean") * ANNUAL}], n
    )


@feature
def yang_zhang(c: Context, n: int = 20) -> FeatureSet:
    gap = div("open", c.rows.lag("close"))
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    return FeatureSet(
        [
            {"_rs": _rs_term(), "_overnight": F.when(gap > 0, F.ln(gap)), "_intraday": _log_ratio("close", "open")},
            {
                "_rs_mean": c.rows.mean("_rs", n),
                "_overnight_var": c.rows.var("_overnight", n),
                "_intraday_var": c.rows.var("_intraday", n),
            },
            {
                "yz_vol": safe_sqrt(
                    F.col("_overnight_var") + k * F.col("_intraday_var") + (1 - k) * F.col("_rs_mean")
                )
                * ANNUAL
            },
        ],
        n + 1,
    )


@feature
def vol_of_vol(c: Context, n: int = 20) -> FeatureSet:
    return FeatureSet(
        [
            *return_deviations(c, (n,)),
            {"_hv": F.col(f"_ret_std_{n}") * ANNUAL},
            {"vol_of_vol": c.rows.std("_hv", n)},
        ],
        2 * n + 1,
    )


@feature
def realized_range(c: Context, n: int = 20) -> FeatureSet:
    return FeatureSet(
        [
            {"realized_range": div(F.col("high") - F.col("low"), "close")},
            {"realized_range_ma": c.rows.mean("realized_range", n)},
        ],
        n,
    )


@feature
def ewma_vol(c: Context, span: int = 20) -> FeatureSet:
    """Exponentially weighted, bias-corrected deviation of returns."""
    scan = c.scan
    inner, sums, out = scan.std_layers("ewma_vol", "_ret", span)
    return FeatureSet(
        [{"_ret": c.rows.pct("close")}, inner, sums, out, {"ewma_vol": F.col("ewma_vol") * ANNUAL}],
        warmup(span) + 1,
    )


def vol_regime(
    df: DataFrame, keys=("instrument",), value: str = "hist_vol_20", low: float = 0.7, high: float = 1.5,
    median_over: DataFrame | None = None,
) -> DataFrame:
    """Flags for volatility far below or above the series median.

    The median is exact and found over bucketed value counts.  Pass ``median_over`` (say, the training part) to avoid look-ahead.
    """
    medians = exact_median(median_over if median_over is not None else df, list(keys), value, "_median")
    return (
        attach_by_key(df, medians, list(keys))
        .withColumn("vol_regime_low", flag(F.col(value) < F.col("_median") * low))
        .withColumn("vol_regime_high", flag(F.col(value) > F.col("_median") * high))
        .drop("_median")
    )


def volatility_builders():
    return [
        hist_vol.using(), garman_klass.using(), parkinson.using(), rogers_satchell.using(), yang_zhang.using(),
        vol_of_vol.using(), realized_range.using(), ewma_vol.using(),
    ]


def volatility_features(df: DataFrame, series: Series = ANY_SPACING) -> DataFrame:
    return vol_regime(compute(df, series, volatility_builders()), series.keys)
