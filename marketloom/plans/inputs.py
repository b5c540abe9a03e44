"""Market and news inputs derived from the given tables, with SQL twins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import Series
from ..operators.grid import full_grid, grid_reindex_ffill, ohlcv_bars
from ..operators.sentiment import lexicon_sentiment, sentiment_from_probs
from ..operators.signals import news_signal_windows
from .catalog import cte, table

HOURLY = Series(step=3_600)
MINUTE = Series(step=60)


def ticks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "event_type", "value")
    return e.select(
        F.col("event_type").alias("instrument"), F.col("ts").alias("time"), F.col("value").alias("price"), "event_id"
    )


def bars(spark: SparkSession, d: str, granularity: str = "H1") -> DataFrame:
    return ohlcv_bars(ticks(spark, d), granularity, tie=("event_id",))


OHLCV = ("instrument", "time", "open", "high", "low", "close", "volume")


def hourly_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid_reindex_ffill(bars(spark, d), HOURLY)


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return hourly_grid(spark, d).select(*OHLCV)


def minute_grid(spark: SparkSession, d: str) -> DataFrame:
    return full_grid(bars(spark, d, "M1"), MINUTE)


cte("ticks", "SELECT event_type AS instrument, ts AS time, value AS price, event_id FROM events")
# The clean ones write out what `ohlcv_bars` says of ticks: those of one time go by event_id, NaN and infinities are missing.
cte("clean_ticks", "SELECT instrument, time, CASE WHEN isfinite(price) THEN price END AS price, event_id FROM ticks", "ticks")
for _kind, _order in (("", "time"), ("clean_", "(time, event_id, price)")):
    for _name, _unit in (("1h", "hour"), ("1m", "minute")):
        cte(
            f"{_kind}bars_{_name}",
            f"SELECT instrument, date_trunc('{_unit}', time) AS time, arg_min(price, {_order}) AS open, max(price) AS high, "
            f"min(price) AS low, arg_max(price, {_order}) AS close, count(*) AS volume FROM {_kind}ticks GROUP BY 1, 2",
            f"{_kind}ticks",
        )
        cte(
            f"{_kind}grid_{_name}",
            f"SELECT s.instrument, s.time, b.open, b.high, b.low, b.close, b.volume, b.time AS source_time, "
            f"datediff('{_unit}', b.time, s.time) AS minutes_since_last_data, "
            "CASE WHEN b.time = s.time THEN 0 ELSE 1 END AS is_backfilled "
            f"FROM (SELECT instrument, unnest(generate_series(min(time), max(time), INTERVAL 1 {_unit})) AS time "
            f"FROM {_kind}bars_{_name} GROUP BY instrument) s ASOF JOIN {_kind}bars_{_name} b "
            "ON s.instrument = b.instrument AND s.time >= b.time",
            f"{_kind}bars_{_name}",
        )


# --- news ---------------------------------------------------------------------------------------

# Words that do occur in the test corpus stand in for the financial lexicons.
POSITIVE = ("that", "thon", "than", "thed", "thin")
NEGATIVE = ("with", "ther", "thes", "thor", "then")
HAWKISH = ("thth", "thble")
DOVISH = ("thre", "thnd")
KEYWORDS = ("thon", "thes", "tion")


def articles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    minute = F.make_dt_interval(mins=((F.col("doc_id") * 43) % 43_200).cast("int"))
    return docs.select(
        F.col("doc_id").alias("article_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"),
        F.col("text").alias("body"),
        "source",
        F.col("lang").alias("language"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minute).alias("published_at"),
        (F.col("n_chars") >= 100).alias("content_fetched"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Articles with class probabilities from the lexicon balance."""
    s = F.col("_s")
    base = lexicon_sentiment(articles(spark, d), "body", POSITIVE, NEGATIVE, "_s")
    return sentiment_from_probs(
        base.withColumns(
            {
                "positive_prob": F.greatest(s, F.lit(0.0)),
                "negative_prob": F.greatest(-s, F.lit(0.0)),
                "neutral_prob": 1.0 - F.abs(s),
            }
        ).drop("_s", "body")
    )


def signals(spark: SparkSession, d: str, minutes: int = 60) -> DataFrame:
    return news_signal_windows(scored(spark, d), minutes)


def sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'))"


def sql_lexicon(x: str, pos=POSITIVE, neg=NEGATIVE) -> str:
    p, n = (f"len(list_intersect({sql_words(x)}, {sql_list(w)}))" for w in (pos, neg))
    return f"coalesce(({p} - {n})::DOUBLE / nullif({p} + {n}, 0), 0.0)"


cte(
    "articles",
    "SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS headline, text AS body, source, "
    "lang AS language, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 43) % 43200) AS published_at, "
    "n_chars >= 100 AS content_fetched FROM documents",
)
cte("lexicon", f"SELECT *, {sql_lexicon('body')} AS s FROM articles", "articles")
cte(
    "scored",
    "SELECT * EXCLUDE (s, body), greatest(s, 0) AS positive_prob, greatest(-s, 0) AS negative_prob, "
    "1 - abs(s) AS neutral_prob, s AS sentiment_score, greatest(s, -s, 1 - abs(s)) AS confidence, "
    "CASE WHEN greatest(s, 0) = greatest(s, -s, 1 - abs(s)) THEN 'positive' "
    "WHEN greatest(-s, 0) = greatest(s, -s, 1 - abs(s)) THEN 'negative' ELSE 'neutral' END AS sentiment FROM lexicon",
    "lexicon",
)
for _m in (60, 15):
    cte(
        f"signals_{_m}m",
        "SELECT *, CASE WHEN avg_sentiment > 0.2 AND signal_strength > 0.3 THEN 1 "
        "WHEN avg_sentiment < -0.2 AND signal_strength > 0.3 THEN -1 ELSE 0 END AS trading_signal FROM ("
        "SELECT *, abs(avg_sentiment) * quality_score AS signal_strength FROM ("
        f"SELECT time_bucket(INTERVAL {_m} minute, published_at, TIMESTAMP '2000-01-01') AS signal_time, "
        "avg(sentiment_score) AS avg_sentiment, avg(confidence) AS quality_score, count(article_id) AS article_count, "
        "avg(positive_prob) AS positive_prob, avg(negative_prob) AS negative_prob, avg(neutral_prob) AS neutral_prob, "
        "arg_max(headline, (published_at, article_id)) AS latest_headline, "
        "arg_max(source, (published_at, article_id)) AS latest_source FROM scored GROUP BY 1))",
        "scored",
    )
SIGNAL_FLOATS = ("avg_sentiment", "quality_score", "positive_prob", "negative_prob", "neutral_prob", "signal_strength")
SIGNAL_REST = ("signal_time", "article_count", "latest_headline", "latest_source", "trading_signal")


# --- predictions --------------------------------------------------------------------------------


def prediction_rows(spark: SparkSession, d: str) -> DataFrame:
    """A prediction log derived from the events."""
    e = table(spark, d, "events", "event_id", "ts", "event_type", "value")
    return e.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("instrument"),
        F.when(F.col("value") > 50, "bullish").otherwise("bearish").alias("prediction"),
        F.least(F.col("value") / 200, F.lit(1.0)).alias("confidence"),
        (((F.col("event_id") % 21) - 10) / 10.0).alias("avg_sentiment"),
        F.col("value").alias("predicted_price"),
    )


cte(
    "pred_log",
    "SELECT event_id, ts AS timestamp, event_type AS instrument, CASE WHEN value > 50 THEN 'bullish' ELSE 'bearish' END AS prediction, "
    "least(value / 200, 1.0::DOUBLE) AS confidence, ((event_id % 21) - 10) / 10.0::DOUBLE AS avg_sentiment, value AS predicted_price FROM events",
)
