"""Windowed news signals and look-ups over them."""
from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import floor_time, minutes_between


def join_article_body(silver: DataFrame, bodies: DataFrame, minimum: int = 10) -> DataFrame:
    """Full text by id; silver headline and body where it is missing or short; short ones dropped."""
    own = F.concat(F.coalesce("headline", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    full = F.when(F.length(F.trim("full_text")) >= minimum, F.col("full_text")).otherwise(own)
    return (
        silver.join(bodies.select("article_id", "full_text"), "article_id", "left")
        .withColumn("full_text", full)
        .filter(F.length(F.trim("full_text")) >= minimum)
    )


def signal_strength(df: DataFrame) -> DataFrame:
    return df.withColumn("signal_strength", F.abs("avg_sentiment") * F.col("quality_score"))


def trading_signal(df: DataFrame, sentiment: float = 0.2, strength: float = 0.3) -> DataFrame:
    s, strong = F.col("avg_sentiment"), F.col("signal_strength") > strength
    return df.withColumn(
        "trading_signal",
        F.when((s > sentiment) & strong, 1).when((s < -sentiment) & strong, -1).otherwise(0),
    )


def window_aggregates(time: str = "published_at", key: str = "article_id") -> list[Column]:
    at = F.struct(F.col(time), F.col(key))

    def newest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), at))

    return [
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.avg("confidence").alias("quality_score"),
        F.count(key).alias("article_count"),
        *[F.avg(c).alias(c) for c in ("positive_prob", "negative_prob", "neutral_prob")],
        newest("headline").alias("latest_headline"),
        newest("source").alias("latest_source"),
    ]


def news_signal_windows(scored: DataFrame, minutes: int = 60, time: str = "published_at", key: str = "article_id") -> DataFrame:
    """Mean scores, counts and newest article per window, with strength and trading signal."""
    grouped = (
        scored.withColumn("signal_time", floor_time(time, minutes * 60))
        .groupBy("signal_time")
        .agg(*window_aggregates(time, key))
    )
    return trading_signal(signal_strength(grouped))


def signal_distribution(signals: DataFrame) -> DataFrame:
    s = F.col("trading_signal")
    return signals.agg(
        *[F.count(F.when(s == v, 1)).alias(n) for v, n in ((1, "buy"), (-1, "sell"), (0, "hold"))],
        F.avg("avg_sentiment").alias("mean_sentiment"),
        F.avg("signal_strength").alias("mean_strength"),
    )


def sentiment_label_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("sentiment").agg(
        F.count(F.lit(1)).alias("articles"), F.avg("sentiment_score").alias("mean_score"),
        F.avg("confidence").alias("mean_confidence"),
    )


def newest(df: DataFrame, n: int, time: str, key: str) -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(n)


def recent_news(df: DataFrame, limit: int = 10, time: str = "signal_time") -> DataFrame:
    """Newest signals (a top-k)."""
    return newest(df, limit, time, time)


def decayed_sentiment(
    df: DataFrame, n: int = 5, alpha: float = 0.5, score: str = "sentiment_score", time: str = "published_at",
    key: str = "article_id",
) -> DataFrame:
    """Mean of the newest ``n`` scores with weights falling by exp(-alpha) per article."""
    rank = F.row_number().over(Window.orderBy(F.col(time).desc(), F.col(key).desc())) - 1
    weighted = newest(df, n, time, key).select(score, F.exp(-alpha * rank).alias("_w"))
    return weighted.agg(
        (F.sum(F.col(score) * F.col("_w")) / F.sum("_w")).alias("decayed_sentiment"),
        F.count(F.lit(1)).alias("articles"),
    )


def news_impact_level(df: DataFrame, strength: str = "signal_strength") -> DataFrame:
    s = F.abs(strength)
    return df.withColumn("impact", F.when(s > 0.7, "high").when(s > 0.4, "medium").otherwise("low"))


def news_sentiment_summary(df: DataFrame, score: str = "sentiment_score", bound: float = 0.1) -> DataFrame:
    s = F.col(score)
    return df.agg(
        F.avg(s).alias("mean_sentiment"),
        F.count(F.when(s > bound, 1)).alias("positive"),
        F.count(F.when(s < -bound, 1)).alias("negative"),
        F.count(F.when(s.between(-bound, bound), 1)).alias("neutral"),
    )


def recent_lookback_join(
    articles: DataFrame, as_of: Column, hours: int = 6, score: str = "sentiment_score", time: str = "published_at",
    key: str = "article_id", mock: str | None = None,
) -> DataFrame:
    """One row of news features over the last hours before ``as_of``; neutral when there are none."""
    recent = articles.filter((F.col(time) >= as_of - F.expr(f"INTERVAL {hours} HOUR")) & (F.col(time) <= as_of))
    last = F.struct(F.col(time), F.col(key))
    is_mock = F.max_by(F.col(mock), last) if mock else F.lit(False)
    n = F.col("news_article_count")
    out = recent.agg(
        F.avg(score).alias("_mean"), F.count(F.lit(1)).alias("news_article_count"), F.max(time).alias("_last"),
        is_mock.alias("_mock"),
    )
    mean = F.coalesce("_mean", F.lit(0.0))
    return out.select(
        mean.alias("news_avg_sentiment"),
        F.abs(mean).alias("news_signal_strength"),
        n,
        F.when(n == 0, 0.0).when(F.coalesce("_mock", F.lit(False)), 0.5).otherwise(1.0).alias("news_quality_score"),
        minutes_between(as_of, "_last").alias("news_age_minutes"),
        F.when(n > 0, 1).otherwise(0).alias("news_available"),
    )
