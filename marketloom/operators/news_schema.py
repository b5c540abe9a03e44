"""Validation of structured news features (JSON) against bounds and required fields."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names of the structured features, by kind.
SIGNED = (  # -1..1
    "sentiment_score", "sentiment_score_vs_expectation", "surprise_indicator", "predicted_price_impact_direction",
    "macro_sentiment_score", "sector_sentiment_score", "policy_bias_score", "data_tone_score",
    "relative_to_historical_sentiment", "cumulative_context_bias_score", "overall_market_sentiment_score",
)
UNIT = (  # 0..1
    "sentiment_magnitude", "subjectivity", "uncertainty_score", "confidence_in_trend", "sentiment_trend_strength",
    "emotion_intensity_score", "reaction_magnitude_score", "volatility_pressure_score",
    "predicted_price_impact_probability", "predicted_price_impact_magnitude", "impact_duration_score",
    "catalyst_strength_score", "relevance_to_stock", "cross_sector_correlation_score", "geopolitical_tension_score",
    "cross_asset_impact_score", "deviation_from_historical_volatility", "narrative_continuity_score",
    "recency_alignment_score", "event_impact_level", "event_novelty_score", "liquidity_stress_score",
    "risk_appetite_score", "time_horizon_numeric", "model_confidence_score",
)
TEN = ("is_macro_related",)  # 0..10
FLAGS = (
    "volatility_flag", "market_reaction_flag", "policy_impact_flag", "data_dependency_flag", "liquidity_impact_flag",
    "safe_haven_mention_flag",
)
LISTS = (
    "emotion_keywords", "named_entities", "geography_mentions", "historical_similarity_examples",
    "volatility_trigger_keywords", "key_new_information",
)
MAPS = ("entity_sentiment",)
TEXTS = ("context_history_summary", "short_summary")
NULLABLE_TEXTS = (
    "sentiment_trend", "impact_duration_category", "catalyst_type", "industry_sector", "event_type", "time_horizon",
    "overall_market_sentiment", "language_detected",
)
BOUNDS = {**{n: (-1.0, 1.0) for n in SIGNED}, **{n: (0.0, 1.0) for n in UNIT}, **{n: (0.0, 10.0) for n in TEN}}

NEWS_FEATURES = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in BOUNDS]
    + [T.StructField(n, T.BooleanType()) for n in FLAGS]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in LISTS]
    + [T.StructField(n, T.MapType(T.StringType(), T.DoubleType())) for n in MAPS]
    + [T.StructField(n, T.StringType()) for n in TEXTS + NULLABLE_TEXTS]
)


def violations(parsed: str, keys: str) -> Column:
    """Names of fields that are missing, null though required, or out of bounds (sorted)."""
    keys = F.coalesce(F.col(keys), F.array().cast("array<string>"))
    checks = []
    for f in NEWS_FEATURES.fields:
        value = F.col(f"{parsed}.{f.name}")
        if f.name in NULLABLE_TEXTS:
            bad = ~F.array_contains(keys, f.name)
        elif f.name in BOUNDS:
            low, high = BOUNDS[f.name]
            bad = value.isNull() | ~value.between(low, high)
        else:
            bad = value.isNull()
        checks.append(F.when(bad, F.lit(f.name)))
    return F.array_sort(F.array_compact(F.array(*checks)))


def news_schema_validate(df: DataFrame, text: str = "features_json") -> DataFrame:
    """Parsed features with the list of violated fields and a validity flag.

    The keys are a column, so that a text is read twice (values, keys) and not once more for every field that may be null.
    """
    parsed = df.withColumns({"features": F.from_json(F.col(text), NEWS_FEATURES), "_keys": F.json_object_keys(F.col(text))})
    checked = parsed.withColumn("violations", violations("features", "_keys")).drop("_keys")
    return checked.withColumn("valid", (F.size("violations") == 0).cast("int"))
