"""Parquet/CSV by extension, gold tables, incremental writes and online look-ups."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import attach_by_key

FORMATS = {".parquet": "parquet", ".csv": "csv"}


def _format(path: str) -> str:
    for ext, name in FORMATS.items():
        if path.rstrip("/").lower().endswith(ext):
            return name
    raise ValueError(f"unsupported extension: {path}")


def read_table_auto(spark: SparkSession, path: str, schema: T.StructType | str | None = None, line_breaks: bool = True) -> DataFrame:
    """Read Parquet or CSV by extension; CSV wants an explicit schema to avoid a second pass.

    Quoted CSV cells may hold line breaks, so a CSV file is one task; ``line_breaks=False`` (for tables of
    numbers and plain names) lets Spark split the files.
    """
    kind = _format(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return reader.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)
    return reader.parquet(path)


def write_table_auto(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    if _format(path) == "csv":
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode(mode).parquet(path)


def write_gold_dual(
    df: DataFrame, base: str, time: str = "time", partition_by: Sequence[str] = ("instrument", "date")
) -> DataFrame:
    """Write gold rows as CSV and as Parquet with an ``event_timestamp`` copy of the time.

    Parquet is partitioned by instrument and date and clustered by them first, so that a
    date of an instrument is one file instead of one per task.
    """
    stamped = df.withColumn("event_timestamp", F.col(time))
    out = stamped
    if "date" in partition_by and "date" not in df.columns:
        out = out.withColumn("date", F.to_date(time))
    out.repartition(*partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(f"{base}.parquet")
    # the CSV is made from the Parquet just written, so that the rows are computed once
    written = df.sparkSession.read.schema(out.schema).parquet(f"{base}.parquet")
    write_table_auto(written.select(*df.columns), f"{base}.csv")
    return written.select(*stamped.columns)


def resume_from_watermark(incoming: DataFrame, stored: DataFrame, keys: Sequence[str] = ("instrument",),
                          time: str = "time", step_seconds: int = 60) -> DataFrame:
    """Rows of ``incoming`` at least one step after the last stored time of their key."""
    last = stored.groupBy(*keys).agg(F.max(time).alias("_last"))
    start = F.col("_last") + F.make_dt_interval(secs=F.lit(step_seconds))
    return (
        attach_by_key(incoming, last, list(keys))
        .filter(F.col("_last").isNull() | (F.col(time) >= start))
        .drop("_last")
    )


def incremental_upsert(
    existing: DataFrame, incoming: DataFrame, key: str = "article_id", time: str = "published_at"
) -> DataFrame:
    """Add rows whose key is not processed yet; per key the last row in time order stays.

    The choice per key is an aggregate with partial results, not a window over all copies.
    """
    fresh = incoming.filter(F.col(key).isNotNull()).join(existing.select(key), key, "left_anti")
    both = existing.withColumn("_run", F.lit(0)).unionByName(
        fresh.withColumn("_run", F.lit(1)), allowMissingColumns=True
    )
    cols = [c for c in both.columns if c != "_run"]
    order = F.struct(F.col(time).isNotNull(), F.col(time), F.col("_run"), *[F.col(c) for c in cols if c not in (key, time)])
    return (
        both.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_row")).select("_row.*")
    )


def orderable(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Columns as parts of a sort key; maps and variants, which have no order, as their JSON text."""
    return [F.col(n) if df.schema[n].dataType.typeName() not in ("map", "variant") else F.to_json(n) for n in names]


def latest_features_by_key(
    df: DataFrame, as_of: Column, ttl: str = "INTERVAL 1 DAY", keys: Sequence[str] = ("instrument",),
    time: str = "event_timestamp",
) -> DataFrame:
    """Newest row per key not newer than ``as_of`` and not older than the time to live.

    Of rows with one time the largest wins, compared column by column in the order of their names.
    """
    bounded = df.filter((F.col(time) <= as_of) & (F.col(time) > as_of - F.expr(ttl)))
    values = [c for c in df.columns if c not in keys]
    return bounded.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(time, *orderable(df, sorted(values)))).alias("_v")).select(*keys, "_v.*")


def materialize_window(
    df: DataFrame, end: Column, days: int = 30, keys: Sequence[str] = ("instrument",), time: str = "event_timestamp"
) -> DataFrame:
    """Newest row per key within the materialisation window."""
    return latest_features_by_key(df, end, f"INTERVAL {days} DAY", keys, time)


def export_online_features(
    signals: DataFrame, as_of: Column, instrument: str, hours: int = 1,
    columns=("avg_sentiment", "signal_strength", "trading_signal", "article_count", "quality_score"),
) -> DataFrame:
    """Signals of the last hours in the shape the online store takes."""
    recent = F.col("signal_time") >= as_of - F.expr(f"INTERVAL {hours} HOUR")
    return signals.filter(recent & (F.col("signal_time") <= as_of)).select(
        F.col("signal_time").alias("event_timestamp"), F.lit(instrument).alias("instrument"), *columns
    )
