"""Arithmetic around predictions: labels, prices, paths, ensembles, thresholds."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import attach_row
from ..functions.numeric import div


def direction(change: Column) -> Column:
    return F.when(change > 0, "bullish").when(change < 0, "bearish").when(change.isNotNull(), "neutral")


def pct_to_price(df: DataFrame, change: str = "predicted_relative_change", price: str = "close") -> DataFrame:
    """Price, direction and confidence from a predicted relative change."""
    c = F.col(change)
    return df.withColumns(
        {
            "predicted_price": F.col(price) * (1 + c),
            "prediction": direction(c),
            "confidence": F.least(F.abs(c), F.lit(1.0)),
            "signal_strength": c,
        }
    )


def class_to_signal(df: DataFrame, probability: str = "probability") -> DataFrame:
    p = F.col(probability)
    return df.withColumns(
        {
            "prediction": F.when(p > 0.5, "bullish").otherwise("bearish"),
            "confidence": F.abs(p - 0.5) * 2.0,
            "signal_strength": (p - 0.5) * 2.0,
        }
    )


def confidence_band_label(df: DataFrame, probability: str = "probability", strong: float = 0.7, moderate: float = 0.6) -> DataFrame:
    p = F.col(probability)
    top = F.greatest(p, 1 - p)
    return df.withColumns(
        {
            "direction": F.when(p > 0.5, "UP").otherwise("DOWN"),
            "top_probability": top,
            "strength": F.when(top > strong, "Strong").when(top > moderate, "Moderate").otherwise("Weak"),
        }
    )


def feature_vector_align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("instrument", "time")) -> DataFrame:
    """Columns in model order; missing columns and nulls are 0."""
    return df.select(
        *keep,
        *[
            (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
            for c in features
        ],
    )


def price_forecast_path(
    df: DataFrame, move: Column, price: str = "close", volatility: str = "volatility_20", time: str = "time",
    points: int = 12, minutes: int = 20,
) -> DataFrame:
    """Straight path to the expected move with bands that widen with the root of progress."""
    share = F.col("point") / F.lit(float(points))
    base = F.col(price) * (1 + F.col("_move") * share)
    band = F.col(price) * F.col(volatility) * F.sqrt(share) * 2
    path = df.withColumn("_move", move).withColumn("point", F.explode(F.sequence(F.lit(1), F.lit(points))))
    return path.withColumns(
        {
            "forecast_time": F.col(time) + F.make_dt_interval(mins=(F.col("point") * minutes).cast("int")),
            "forecast_price": base,
            "upper_band": base + band,
            "lower_band": base - band,
        }
    ).drop("_move")


def expected_move(
    predicted_price: Column, predicted_change: Column, prediction: Column, confidence: Column, price: Column,
    volatility: Column, hours: float = 4.0,
) -> Column:
    """Expected relative move: predicted price, else percentage change, else direction times confidence."""
    way = F.lower(prediction)
    sign = F.when(way.isin("neutral", "hold"), 0.0).when(way.isin("up", "bullish"), 1.0).when(way.isNotNull(), -1.0)
    return (
        F.when(predicted_price != 0, (predicted_price - price) / price)
        .when(predicted_change != 0, predicted_change / 100.0)
        .otherwise(F.coalesce(sign * F.coalesce(confidence, F.lit(0.5)) * volatility * (hours**0.5), F.lit(0.0)))
    )


def arima_sign_prob(df: DataFrame, predicted: str = "predicted_close", last: str = "close") -> DataFrame:
    """Strength, probability and confidence from a predicted level."""
    scale = F.greatest(F.abs(F.col(last)), F.lit(1e-6))
    strength = F.tanh((F.col(predicted) - F.col(last)) / scale)
    p = F.least(F.greatest(0.5 + strength / 2, F.lit(0.0)), F.lit(1.0))
    return df.withColumns({"signal_strength": strength, "probability": p, "confidence": F.abs(p - 0.5) * 2.0})


# Member weights of the ensemble.
ENSEMBLE_WEIGHTS = {"conservative": 0.3, "moderate": 0.4, "aggressive": 0.3}


def weighted_ensemble(df: DataFrame, weights: Mapping[str, float] = ENSEMBLE_WEIGHTS, name: str = "ensemble") -> DataFrame:
    """Weighted mean of the member columns that are present in a row."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for member, w in weights.items():
        has = F.col(member).isNotNull()
        total = total + F.when(has, F.col(member) * w).otherwise(0.0)
        weight = weight + F.when(has, F.lit(w)).otherwise(0.0)
    return df.withColumn(name, div(total, weight))


def threshold_search(
    df: DataFrame, probability: str = "probability", label: str = "label", low: float = 0.45, high: float = 0.55, points: int = 100
) -> DataFrame:
    """F1 at evenly spaced thresholds; ``best`` marks the highest (smallest threshold on ties).

    A row counts as positive for all thresholds up to its probability, so each row is
    reduced to the number of thresholds it passes; sums over that small table give all curves.
    """
    step = (high - low) / (points - 1)
    grid = F.array(*[F.lit(low + i * step) for i in range(points)])
    passed = F.size(F.filter(grid, lambda t: t <= F.col(probability)))
    counts = df.groupBy(passed.alias("passed")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    wide = counts.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "passed", "pos", "n")
    hit = F.col("passed") > F.col("i")
    agg = wide.groupBy("i").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum("pos").alias("actual"),
    )
    scored = agg.select(
        (F.lit(low) + F.col("i") * step).alias("threshold"), "tp", "predicted", "actual",
        F.coalesce(div(2 * F.col("tp"), F.col("predicted") + F.col("actual")), F.lit(0.0)).alias("f1"),
    )
    best = scored.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("_best"))
    return attach_row(scored, best).withColumn("best", (F.col("threshold") == F.col("_best")).cast("int")).drop("_best")


def mean_threshold_model(df: DataFrame, feature: str = "feat_mean", label: str = "label") -> DataFrame:
    """Threshold at the mean feature, share of ones as score on its upper side."""
    row = df.agg(F.avg(feature).alias("threshold"), F.avg(label).alias("p1"))
    p = F.when(F.col(feature) >= F.col("threshold"), F.col("p1")).otherwise(1 - F.col("p1"))
    return attach_row(df, row).withColumn("score", F.round(p, 3))
