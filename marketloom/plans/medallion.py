"""The stages end to end: bars to silver, gold, labels, news and a training table.

All indicators, proxies, estimators and the label share one block layout, so the wide silver
row and its future close cost one shuffle of the grid; nothing is joined back by time.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import compute
from ..functions.numeric import div, flag
from ..functions.series import Series
from ..operators.asof import asof_ffill
from ..operators.grid import full_grid, grid_reindex_ffill
from ..operators.labels import future_close, multiclass, split_ratio
from ..operators.microstructure import microstructure_builders
from ..operators.news import clean_manifest
from ..operators.prep import gold_clean
from ..operators.signals import news_signal_windows
from ..operators.technical import min_periods_guard, technical_builders
from ..operators.volatility import vol_regime, volatility_builders
from ..session import materialize


def silver_market(bars: DataFrame, series: Series = Series(), horizon: int | None = None, gaps: bool = True) -> DataFrame:
    """Grid, then every market feature in one pass; with ``horizon`` also the future close."""
    grid = full_grid(bars, series) if gaps else grid_reindex_ffill(bars, series)
    builders = technical_builders() + microstructure_builders() + volatility_builders()
    if horizon:
        builders.append(future_close.using(horizon=horizon))
    return compute(min_periods_guard(grid, series.keys), series, builders)


def with_targets(df: DataFrame, horizon: int) -> DataFrame:
    """Targets from a ``future_close`` column."""
    change = F.col("future_close") - F.col("close")
    return df.withColumns(
        {
            "target_classification": flag(change > 0),
            "target_regression": change,
            "target_pct_change": 100 * div(change, "close"),
            "prediction_horizon_minutes": F.lit(horizon),
        }
    ).withColumn("target_multiclass", multiclass(F.col("target_pct_change")))


LABEL_COLUMNS = ("future_close", "target_classification", "target_regression", "target_pct_change", "target_multiclass",
                 "prediction_horizon_minutes")


def gold_market(silver: DataFrame, series: Series = Series()) -> DataFrame:
    """Volatility regime flags and cleaned rows; label columns do not count as gaps."""
    labels = [c for c in ("future_close",) if c in silver.columns]
    wide = vol_regime(silver, series.keys)
    if not labels:
        return gold_clean(wide, series)
    held = wide.withColumn("label_row", F.struct(*labels))
    return gold_clean(held.drop(*labels), series).select("*", "label_row.*").drop("label_row")


def gold_signals(articles: DataFrame, score: Callable[[DataFrame], DataFrame], minutes: int = 60) -> DataFrame:
    """Cleaned articles, scored and aggregated per window."""
    return news_signal_windows(score(clean_manifest(articles)), minutes)


def training_table(
    bars: DataFrame, signals: DataFrame | None, series: Series = Series(), horizon: int = 30, tolerance_hours: int = 6
) -> DataFrame:
    """Gold features with labels, news as of each bar, and the temporal part.

    Silver, gold and the joined table are written once each; the steps after them read a
    stage several times (medians, carries, positions).
    """
    silver = materialize(silver_market(bars, series, horizon), "silver")
    gold = materialize(with_targets(gold_market(silver, series), horizon), "gold")
    labelled = gold.filter(F.col("future_close").isNotNull())
    irregular = series.with_step(None)
    if signals is not None:
        signals = materialize(signals, "signals")
    joined = materialize(asof_ffill(labelled, signals, irregular, tolerance_hours), "training")
    return split_ratio(joined, irregular)
