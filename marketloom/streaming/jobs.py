"""Streaming forms of the bar, news, join and monitoring operators."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import epoch_seconds, floor_div
from ..operators.asof import asof_zero_fill
from ..operators.drift import DEFAULTS, DriftConfig
from ..operators.signals import signal_strength, trading_signal, window_aggregates
from ..session import scratch_path
from ..sources.tables import orderable
from .core import DELAY, LatestTable, drain_batches
from .state import DriftWatch, NewestMatch

ALERT = ("type STRING, severity STRING, drift_value DOUBLE, baseline DOUBLE, recent DOUBLE, threshold DOUBLE, "
         "message STRING, timestamp TIMESTAMP_NTZ")

#: Times inside JSON keep their microseconds.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def event_time(df: DataFrame, time: str, delay: str = DELAY) -> DataFrame:
    """Watermarked event time; rows later than the delay are dropped by stateful operators."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def stream_bars(ticks: DataFrame, width: str = "1 minute", delay: str = DELAY, time: str = "time", tie: tuple[str, ...] = ()) -> DataFrame:
    """Bars from a tick stream: partial aggregates per (window, instrument), closed by the watermark.

    Ticks of one time are ordered by the ``tie`` columns, then by price.
    """
    order = F.struct(F.col(time), *[F.col(c) for c in tie], F.col("price"))
    grouped = event_time(ticks, time, delay).groupBy(F.window(time, width).alias("w"), "instrument").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("volume"),
    )
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("time"), "instrument", "open", "high", "low", "close", "volume")


def stream_news_signals(scored: DataFrame, width: str = "15 minutes", delay: str = DELAY, time: str = "published_at") -> DataFrame:
    """Windowed news signals with strength and trading signal."""
    grouped = event_time(scored, time, delay).groupBy(F.window(time, width).alias("w")).agg(*window_aggregates(time))
    flat = grouped.select(F.col("w.start").cast("timestamp_ntz").alias("signal_time"), *[c for c in grouped.columns if c != "w"])
    return trading_signal(signal_strength(flat))


def stream_recent_lookback(
    scored: DataFrame, lookback: str = "6 hours", slide: str = "15 minutes", delay: str = DELAY, time: str = "published_at"
) -> DataFrame:
    """News of the last hours at every slide: sliding windows instead of repeated scans."""
    grouped = event_time(scored, time, delay).groupBy(F.window(time, lookback, slide).alias("w")).agg(
        F.avg("sentiment_score").alias("news_avg_sentiment"), F.count(F.lit(1)).alias("news_article_count"), F.max(time).alias("last")
    )
    return grouped.select(
        F.col("w.end").cast("timestamp_ntz").alias("as_of"), "news_avg_sentiment",
        F.abs("news_avg_sentiment").alias("news_signal_strength"), "news_article_count",
    )


def stream_dedup(articles: DataFrame, key: str = "article_id", time: str = "published_at", delay: str = "7 days") -> DataFrame:
    """First arrival per id; ids are forgotten once the watermark has passed them."""
    return event_time(articles, time, delay).dropDuplicatesWithinWatermark([key])


def stream_session_gaps(ticks: DataFrame, gap: str = "30 minutes", delay: str = DELAY, time: str = "time") -> DataFrame:
    """Activity sessions per instrument separated by quiet gaps."""
    grouped = event_time(ticks, time, delay).groupBy(F.session_window(time, gap).alias("w"), "instrument").agg(
        F.count(F.lit(1)).alias("ticks")
    )
    return grouped.select(
        "instrument", F.col("w.start").cast("timestamp_ntz").alias("session_start"),
        F.col("w.end").cast("timestamp_ntz").alias("session_end"), "ticks",
    )


def stream_new_file_trigger(articles: DataFrame, score: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Score the articles of every newly arrived file; each batch writes its own folder."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    drain_batches(articles, "trigger", handle)


def stream_asof(bars: DataFrame, signals: DataFrame, path: str, tolerance_hours: int = 2) -> None:
    """Enrich a bar stream with the newest signal table as of each bar."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        asof_zero_fill(batch, signals, tolerance_hours).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    drain_batches(bars, "asof", handle)


def stream_interval_join(
    bars: DataFrame, signals: DataFrame, tolerance_seconds: int = 7_200, delay: str = DELAY, time: str = "time",
    right_time: str = "signal_time",
) -> DataFrame:
    """Stream-stream form: every pair of a bar and a signal within the tolerance before it.

    Slots of the tolerance's width give the equality the join is partitioned by; a signal
    enters its own slot and the next.  The time bounds let Spark drop old state on both sides;
    the newest match per bar is taken downstream.
    """
    left, right = event_time(bars, time, delay), event_time(signals, right_time, delay)
    left = left.withColumn("_slot", floor_div(epoch_seconds(time), tolerance_seconds))
    own = floor_div(epoch_seconds(right_time), tolerance_seconds)
    right = right.withColumn("_right_slot", F.explode(F.array(own, own + 1)))
    bounds = F.expr(
        f"_slot = _right_slot AND {right_time} <= {time} AND {right_time} >= {time} - INTERVAL {tolerance_seconds} SECONDS"
    )
    return left.join(right, bounds, "inner").drop("_slot", "_right_slot")


def stream_asof_newest(
    bars: DataFrame, signals: DataFrame, tolerance_seconds: int = 7_200, delay: str = DELAY, time: str = "time",
    right_time: str = "signal_time", shares: int = 8, prefix: str = "news_", quiet: bool = False,
) -> DataFrame:
    """Both sides as streams: every bar once, with the newest signal within the tolerance before it.

    State is keyed by slots of the tolerance's width; a signal enters its own slot and the next.  The bars of
    a slot are dealt over ``shares`` by a hash of the row, each of which gets the slot's few signals, so that
    a busy slot is no single task.  A bar comes out once both watermarks have passed it; of signals with one
    time the largest (columns in order, as JSON) counts.  Bars without a time have no match and are dropped.
    A stream without rows has no watermark and holds all bars back: where it is known that there are no signals
    (``quiet``), bars come out by their own watermark, without a match.
    """
    width = tolerance_seconds * 1_000_000
    values = [c for c in signals.columns if c != right_time]
    left, right = event_time(bars, time, delay), event_time(signals, right_time, delay)
    whole = F.struct(*[F.col(c).cast(bars.schema[c].dataType).alias(c) for c in bars.columns])
    slot = floor_div(F.unix_micros(time), width)
    asks = left.select(slot.alias("slot"), F.pmod(F.xxhash64(*bars.columns), F.lit(shares)).alias("share"), F.col(time).alias("seen"),
                       F.unix_micros(time).alias("at"), F.lit(1).cast("long").alias("side"), F.to_json(whole, EXACT).alias("payload"))
    own = floor_div(F.unix_micros(right_time), width)
    marks = right.select(F.explode(F.array(own, own + 1)).alias("slot"), right_time, *values)
    marks = marks.select("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"), F.col(right_time).alias("seen"),
                         F.unix_micros(right_time).alias("at"), F.lit(0).cast("long").alias("side"), F.to_json(F.struct(*values), EXACT).alias("payload"))
    both = asks if quiet else asks.unionByName(marks)
    found = both.filter(F.col("at").isNotNull()).groupBy("slot", "share").transformWithStateInPandas(
        NewestMatch(width, width, ["bar", "signal_at", "signal"]), "bar STRING, signal_at LONG, signal STRING", "Append", "EventTime")
    bar_schema, signal_schema = bars.schema, T.StructType([signals.schema[c] for c in values])
    told = found.select(F.from_json("bar", bar_schema, EXACT).alias("b"), "signal_at", F.from_json("signal", signal_schema, EXACT).alias("s"))
    when = F.timestamp_micros("signal_at").cast(signals.schema[right_time].dataType)
    return told.select("b.*", when.alias(f"{prefix}{right_time}"), *[F.col(f"s.{c}").alias(f"{prefix}{c}") for c in values])


def stream_drift_alerts(
    log: DataFrame, config: DriftConfig = DEFAULTS, keys: Sequence[str] = ("instrument",), delay: str = DELAY, time: str = "timestamp", tie: str = "event_id"
) -> DataFrame:
    """Drift alerts of every key, as a stream: checked at every prediction in event order, with cooldown.

    The state of a key is the tail of its measures and the times of its last alerts; rows of a key pass
    through one task, those of a micro-batch at a time.
    """
    filled = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    rows = event_time(log, time, delay).select(
        *keys, F.col(time).alias("seen"), F.unix_micros(time).alias("at"), F.coalesce(F.col(tie).cast("long"), F.lit(DriftWatch.NO_TIE)).alias("tie"), filled(F.col("avg_sentiment")).alias("sentiment"),
        filled(F.col("prediction") == "bullish").alias("bullish"), filled(F.col("confidence")).alias("confidence"))
    schema = ", ".join([*[f"{k} {log.schema[k].dataType.simpleString()}" for k in keys], ALERT.replace("TIMESTAMP_NTZ", "TIMESTAMP"), f"{tie} LONG"])
    columns = [x.split()[0] for x in schema.split(", ")]
    found = rows.filter(F.col("at").isNotNull()).groupBy(*keys).transformWithStateInPandas(DriftWatch(config, columns), schema, "Append", "EventTime")
    return found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def stream_latest_features(
    features: DataFrame, path: str, keys: Sequence[str] = ("instrument",), time: str = "event_timestamp", parts: int = 64,
    checkpoint: str | None = None,
) -> DataFrame:
    """Newest row per key, upserted per micro-batch into the parts it touches.  Returns the table.

    Of rows with one time the largest wins, compared column by column in the order of their names.
    """
    spark: SparkSession = features.sparkSession
    table = LatestTable(spark, path or scratch_path(spark, "latest"), features.schema, keys, parts)
    order = F.struct(time, *orderable(features, sorted(c for c in features.columns if c not in keys)))
    drain_batches(features, "latest", lambda batch, batch_id: table.upsert(batch, order, batch_id), checkpoint)
    return table.read()
