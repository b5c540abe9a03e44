"""Bars, gap-free time grids, gap features and calendar columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import Context, FeatureSet, feature
from ..functions.numeric import clean_double, flag
from ..functions.series import (
    BUCKET, Series, carry_forward, epoch_micros, floor_div, floor_time, minutes_between, task_count,
)

#: Slots of a pause that one task fills: a day of minutes.
PIECE = 1_440
GRANULARITY = {"M1": 60, "M5": 300, "M15": 900, "H1": 3_600, "D": 86_400}


def floor_to_window(df: DataFrame, minutes: int = 60, time: str = "time", name: str = "window_start") -> DataFrame:
    return df.withColumn(name, floor_time(time, minutes * 60))


def ohlcv_bars(
    ticks: DataFrame, granularity: str = "M1", keys: Sequence[str] = ("instrument",), time: str = "time",
    price: str = "price", tie: Sequence[str] = (),
) -> DataFrame:
    """Open/high/low/close/volume bars; partial aggregates before the only shuffle.

    Ticks of one time are ordered by the ``tie`` columns, then by price, so the result does not
    depend on the order of arrival.  NaN and infinite prices count as missing.
    """
    order = F.when(F.col(price).isNotNull(), F.struct(F.col(time), *[F.col(c) for c in tie], F.col(price)))
    ticks = ticks.withColumn(price, clean_double(price))
    seconds = GRANULARITY[granularity]
    slot = ticks.withColumn("_slot", floor_time(time, seconds))
    return (
        slot.groupBy(*keys, F.col("_slot").alias("_bar"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .withColumnRenamed("_bar", time)
    )


def grid_reindex_ffill(df: DataFrame, series: Series = Series()) -> DataFrame:
    """Insert the missing slots between first and last row, repeating the last row.

    The next row is found inside a time bucket, or is the first row of the next filled
    bucket (one row per bucket).  Null cells of original rows are filled by
    :func:`fill_null_cells`, kept apart because most inputs have none.
    Adds ``minutes_since_last_data`` (slots since the last original) and ``is_backfilled``.
    """
    keys = list(series.keys)
    t = series.time
    df = df.withColumn(BUCKET, series.bucket_of())
    firsts = df.groupBy(*keys, BUCKET).agg(F.min(t).alias("_first"))
    following = firsts.select(
        *keys, BUCKET, F.lead("_first").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("_next_bucket")
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(t)
    nexts = df.join(following, [*keys, BUCKET]).withColumn(
        "_next", F.coalesce(F.lead(t).over(inside), F.col("_next_bucket"))
    )
    between = floor_div(epoch_micros("_next") - epoch_micros(t), series.step * 1_000_000)
    counted = nexts.withColumn("_slots", F.greatest(F.coalesce(between, F.lit(1)), F.lit(1)))
    # A long pause is cut into pieces before any slot exists, and the pieces go to many tasks.
    pieces = F.sequence(F.lit(0).cast("long"), floor_div(F.col("_slots") - 1, PIECE))
    whole = counted.filter(F.col("_slots") <= PIECE).withColumn("_piece", F.lit(0).cast("long"))
    cut = counted.filter(F.col("_slots") > PIECE).withColumn("_piece", F.explode(pieces)).repartition(task_count(df), *keys, t, "_piece")
    first = F.col("_piece") * PIECE
    slots = F.explode(F.sequence(first, F.least(F.col("_slots"), first + PIECE) - 1))
    filled = whole.unionByName(cut).withColumn("minutes_since_last_data", slots)
    return (
        filled.withColumn(t, F.col(t) + F.make_dt_interval(secs=F.col("minutes_since_last_data") * series.step))
        .withColumn("minutes_since_last_data", F.col("minutes_since_last_data").cast("int"))
        .withColumn("is_backfilled", flag(F.col("minutes_since_last_data") > 0))
        .select(*[c for c in df.columns if c != BUCKET], "minutes_since_last_data", "is_backfilled")
    )


def fill_null_cells(df: DataFrame, columns: Sequence[str], series: Series = Series()) -> DataFrame:
    """Forward fill null cells along each series."""
    staged = df.withColumn(BUCKET, series.bucket_of())
    names = {f"_f_{c}": F.col(c) for c in columns}
    filled = carry_forward(staged, series.keys, BUCKET, [series.time, *series.ties], names)
    return filled.withColumns({c: F.col(f"_f_{c}") for c in columns}).drop(BUCKET, *names)


def minutes_since_last_data(df: DataFrame, series: Series = Series()) -> DataFrame:
    return grid_reindex_ffill(df, series).select(*series.keys, series.time, "minutes_since_last_data")


def is_backfilled(df: DataFrame, series: Series = Series()) -> DataFrame:
    return grid_reindex_ffill(df, series).select(*series.keys, series.time, "is_backfilled")


@feature
def has_original(c: Context, near: int = 30, far=(60, 360)) -> FeatureSet:
    """Was any original bar seen between ``near`` and ``far`` slots ago?

    Differences of a running count, so the cost does not grow with the frame.
    """
    running = F.sum(1 - F.col("is_backfilled")).over(c.series.rows().rowsBetween(Window.unboundedPreceding, 0))

    def seen(k: int):
        return F.coalesce(c.rows.lag("_seen", k), F.lit(0))

    return FeatureSet(
        [
            {"_seen": running},
            {
                f"has_original_prev_{near}_to_{k}min": flag(seen(near + 1) - seen(k + 1) > 0)
                for k in far
            },
        ],
        max(far) + 2,
    )


def full_grid(bars: DataFrame, series: Series = Series()) -> DataFrame:
    """Grid with every gap column, as the silver stage consumes it."""
    return has_original(grid_reindex_ffill(bars, series), series)


def gap_coverage_stats(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return grid.groupBy(*keys).agg(
        F.avg("is_backfilled").alias("backfilled_share"),
        F.avg("has_original_prev_30_to_60min").alias("recent_60_share"),
        F.avg("has_original_prev_30_to_360min").alias("recent_360_share"),
        F.count(F.lit(1)).alias("rows"),
    )


def _with_previous_time(df: DataFrame, series: Series) -> DataFrame:
    """Time of the previous row, however long ago."""
    keys = [*series.keys, BUCKET]
    t = series.time
    df = df.withColumn(BUCKET, series.bucket_of())
    lasts = df.groupBy(*keys).agg(F.max(t).alias("_last"))
    before = lasts.select(
        *keys, F.lag("_last").over(Window.partitionBy(*series.keys).orderBy(BUCKET)).alias("_prev_bucket")
    )
    inside = Window.partitionBy(*keys).orderBy(t, *series.ties)
    return (
        df.join(before, keys)
        .withColumn("_prev", F.coalesce(F.lag(t).over(inside), F.col("_prev_bucket")))
        .drop(BUCKET, "_prev_bucket")
    )


def gap_minutes(df: DataFrame, series: Series = Series()) -> DataFrame:
    return (
        _with_previous_time(df, series)
        .withColumn("gap_minutes", minutes_between(series.time, "_prev"))
        .drop("_prev")
    )


def session_bounds(df: DataFrame, keys: Sequence[str] = ("instrument",), time: str = "time") -> DataFrame:
    """First and last time of each day with its weekday name."""
    return (
        df.groupBy(*keys, F.to_date(time).alias("date"))
        .agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))
        .withColumn("day_name", F.date_format("date", "EEEE"))
    )


def fill_within_day(df: DataFrame, series: Series = Series()) -> DataFrame:
    """Insert missing slots only between the first and last bar of each day; values stay null.

    A (instrument, day) group has at most one row per slot of the day.
    """
    t = series.time
    day = df.withColumn("date", F.to_date(t))
    nexts = day.withColumn("_next", F.lead(t).over(Window.partitionBy(*series.keys, "date").orderBy(t)))
    step = F.make_dt_interval(secs=F.lit(series.step))
    slots = F.when(
        F.col("_next").isNotNull(), F.sequence(F.col(t), F.col("_next") - step, step)
    ).otherwise(F.array(F.col(t)))
    keep = [*series.keys, "date"]
    cells = [c for c in df.columns if c not in (*keep, t)]
    filled = nexts.select(*keep, *cells, F.posexplode(slots).alias("_since", t))
    return filled.select(
        *keep, t, *[F.when(F.col("_since") == 0, F.col(c)).alias(c) for c in cells]
    )


def calendar_parts(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns(
        {
            "date": F.to_date(time),
            "day_name": F.date_format(time, "EEEE"),
            "year": F.year(time),
            "month": F.month(time),
            "day": F.dayofmonth(time),
            "hour": F.hour(time),
        }
    )


def head_of_series(df: DataFrame, rows: int = 30_000, time: str = "time", ties: Sequence[str] = ("instrument",)) -> DataFrame:
    """The first rows in time order: a top-k, not a sort of everything."""
    return df.orderBy(time, *ties).limit(rows)
