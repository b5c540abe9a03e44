"""Explicit schemas of the files read and written."""
from __future__ import annotations

from pyspark.sql import types as T

CANDLE = T.StructType(
    [
        T.StructField("time", T.StringType()),
        T.StructField("instrument", T.StringType()),
        T.StructField("granularity", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("collected_at", T.StringType()),
    ]
)

BROKER_PAYLOAD = (
    "candles ARRAY<STRUCT<time: STRING, complete: BOOLEAN, volume: BIGINT, "
    "mid: STRUCT<o: STRING, h: STRING, l: STRING, c: STRING>>>"
)

ARTICLE = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("article_id", "story_id", "headline", "body", "summary", "url", "source", "published_at",
                  "collected_at", "collection_method", "language")
    ]
    + [T.StructField("sp500_relevant", T.BooleanType()), T.StructField("content_fetched", T.BooleanType())]
)

PREDICTION_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("instrument", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("probability", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("signal_strength", T.StringType()),
        T.StructField("predicted_price", T.StringType()),
        T.StructField("predicted_relative_change", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("features_used", T.StringType()),
        T.StructField("close", T.StringType()),
        T.StructField("rsi_14", T.StringType()),
        T.StructField("avg_sentiment", T.StringType()),
    ]
)
