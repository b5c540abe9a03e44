"""Backward as-of joins.

Left rows and right rows are put into one stream, dealt into time buckets, and merged by one window per
bucket.  What a bucket needs from before is brought by the right side alone: the last right row of a bucket
is copied into the buckets after it, up to the next one with right rows or as far as the tolerance reaches.
So each left row is shuffled once, with nothing joined back.  No candidate lists, no range join.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import attach_row
from ..functions.numeric import flag
from ..functions.series import ANY_SPACING, BUCKET, Series, epoch_seconds, floor_div, minutes_between

NEWS_VALUES = ("avg_sentiment", "signal_strength", "trading_signal", "article_count", "quality_score")

AT, SIDE, ROW, LEFT, DEAL = "_at", "_side", "_row", "_left", "_deal"


def bucketed_marks(
    right: DataFrame, time: str, keys: Sequence[str], width: int, tolerance: int | None, ties: Sequence[str], end: DataFrame | None,
) -> DataFrame:
    """Right rows as keys, bucket, `_at`, `_row` (all values) and tie columns, with the copies later buckets need.

    ``end``, one row with the last left bucket as `_end`, bounds the copies where there is no tolerance.
    """
    values = [c for c in right.columns if c not in keys]
    tie = [f"_tie_{k}" for k in range(len(ties))]
    marks = right.filter(F.col(time).isNotNull()).select(
        *keys, floor_div(epoch_seconds(time), width).alias(BUCKET), F.col(time).alias(AT), F.struct(*values).alias(ROW), *[F.col(c).alias(t) for c, t in zip(ties, tie)])
    whole = F.struct(AT, *tie, ROW)
    last = marks.groupBy(*keys, BUCKET).agg(F.max_by(whole, F.struct(AT, *tie)).alias("m"))
    # a row per bucket that has right rows
    last = last.withColumn("_next", F.lead(BUCKET).over(Window.partitionBy(*keys).orderBy(BUCKET)))
    if end is not None:
        last = attach_row(last, end)
    until = F.coalesce(F.col("_next"), F.col("_end") if end is not None else F.lit(None).cast("long"))
    if tolerance is not None:
        reach = F.col(BUCKET) + F.lit(tolerance // width + 1)
        until = F.least(until, reach)
    copies = last.filter(until > F.col(BUCKET)).select(*keys, F.explode(F.sequence(F.col(BUCKET) + 1, until)).alias(BUCKET), "m.*")
    return marks.select(*keys, BUCKET, AT, ROW, *tie).unionByName(copies.select(*keys, BUCKET, AT, ROW, *tie))


def within(tolerance: int | None, at: Column, match: Column, right_time: str) -> Column:
    if tolerance is None:
        return match
    return F.when(at - F.make_dt_interval(secs=F.lit(tolerance)) <= match[right_time], match)


def asof_join(
    left: DataFrame, right: DataFrame, left_time: str = "time", right_time: str = "signal_time",
    keys: Sequence[str] = (), tolerance: int | None = 6 * 3_600, prefix: str = "news_", ties: Sequence[str] = (),
    width: int = 3_600, deals: int = 8,
) -> DataFrame:
    """Left rows with the prefixed columns of the last right row at or before them (null without one).

    ``tolerance`` is in seconds.  The left rows of a bucket of ``width`` seconds are dealt over ``deals``
    tasks, each of which gets the bucket's right rows, so that busy times are no single task.  Of right rows
    with one time the largest by the ``ties`` columns counts.  Left rows without a time have no match.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    tie = [f"_tie_{k}" for k in range(len(ties))]
    bucket = floor_div(epoch_seconds(left_time), width)
    end = left.agg(F.max(bucket).alias("_end")) if tolerance is None else None
    marks = bucketed_marks(right, right_time, keys, width, tolerance, ties, end)
    marks = marks.withColumn(DEAL, F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).withColumn(SIDE, F.lit(0))
    hashed = [f.name for f in left.schema.fields if f.dataType.typeName() not in ("map", "variant", "array", "struct")]
    asks = left.select(*keys, bucket.alias(BUCKET), F.col(left_time).alias(AT), F.lit(1).alias(SIDE), F.struct(*left.columns).alias(LEFT),
                       F.pmod(F.xxhash64(*hashed), F.lit(deals)).cast("int").alias(DEAL))
    stream = asks.unionByName(marks, allowMissingColumns=True)
    order = [AT, SIDE, *[F.col(t) for t in tie]]
    rows = Window.partitionBy(*keys, BUCKET, DEAL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    merged = stream.withColumn(ROW, F.last(ROW, ignorenulls=True).over(rows)).filter(F.col(SIDE) == 1)
    match = within(tolerance, F.col(AT), F.col(ROW), right_time)
    own = [F.col(LEFT)[c].alias(c) for c in left.columns]
    return merged.select(*own, *[match[c].alias(f"{prefix}{c}") for c in values])


def asof_no_news(df: DataFrame, variant: str = "ffill") -> DataFrame:
    """Columns of a run without any news: nulls ('ffill') or zeros ('simple')."""
    if variant == "ffill":
        return df.withColumns(
            {
                "news_rows_since_update": F.lit(None).cast("long"),
                "news_available": F.lit(0),
                "news_age_minutes": F.lit(None).cast("double"),
            }
        )
    zeros: dict[str, Column] = {f"news_{c}": F.lit(0.0) for c in NEWS_VALUES}
    return df.withColumns({**zeros, "news_age_minutes": F.lit(0.0), "news_available": F.lit(0)})


def asof_zero_fill(left: DataFrame, right: DataFrame | None, tolerance_hours: int = 6) -> DataFrame:
    """As-of within tolerance; values 0 and age null where there is none."""
    if right is None:
        return left
    values = [c for c in NEWS_VALUES if c in right.columns]
    joined = asof_join(left, right.select("signal_time", *values), tolerance=tolerance_hours * 3_600)
    return joined.withColumns(
        {
            "news_age_minutes": minutes_between("time", "news_signal_time"),
            "news_available": flag(F.col("news_signal_time").isNotNull()),
            **{f"news_{c}": F.coalesce(F.col(f"news_{c}").cast("double"), F.lit(0.0)) for c in values},
        }
    ).drop("news_signal_time")


def asof_simple(left: DataFrame, right: DataFrame | None, tolerance_hours: int = 6) -> DataFrame:
    """As-of with zeros; news counts as available when its sentiment is not zero; age 0."""
    if right is None:
        return asof_no_news(left, "simple")
    values = [c for c in NEWS_VALUES if c in right.columns]
    joined = asof_join(left, right.select("signal_time", *values), tolerance=tolerance_hours * 3_600)
    filled = {
        f"news_{c}": F.coalesce(F.col(f"news_{c}").cast("double"), F.lit(0.0)) if c in values else F.lit(0.0)
        for c in NEWS_VALUES
    }
    return joined.withColumns(filled).withColumns(
        {"news_available": flag(F.col("news_avg_sentiment") != 0), "news_age_minutes": F.lit(0.0)}
    ).drop("news_signal_time")


def asof_ffill(
    left: DataFrame, right: DataFrame | None, series: Series = ANY_SPACING, tolerance_hours: int | None = 6
) -> DataFrame:
    """As-of within tolerance, then the last matched news is kept on past the tolerance.

    ``news_rows_since_update`` counts the rows of the series since the match last changed.  Series and right
    rows are merged per series and time bucket; a summary of each bucket (a row) carries the match, its
    place and the number of rows on to later buckets, so the left rows are moved twice at most: once
    without their columns for the summary, once whole.
    """
    if right is None:
        return asof_no_news(left, "ffill")
    keys, time, values = list(series.keys), series.time, list(right.columns)
    tolerance = None if tolerance_hours is None else tolerance_hours * 3_600
    width = series.width
    bucket = floor_div(epoch_seconds(time), width)
    there = left.select(*keys, bucket.alias(BUCKET)).distinct()  # a row per series and bucket
    end = left.agg(F.max(bucket).alias("_end")) if tolerance is None else None
    marks = bucketed_marks(right, "signal_time", (), width, tolerance, (), end).join(there, BUCKET).withColumn(SIDE, F.lit(0))
    asks = left.select(*keys, bucket.alias(BUCKET), F.col(time).alias(AT), F.lit(1).alias(SIDE), F.struct(*left.columns).alias(LEFT))
    by = Window.partitionBy(*keys, BUCKET).orderBy(AT, SIDE)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    stream = asks.unionByName(marks, allowMissingColumns=True)
    merged = stream.withColumn(ROW, F.last(ROW, ignorenulls=True).over(upto)).filter(F.col(SIDE) == 1)
    now = F.col("_match.signal_time")
    matched = merged.withColumn("_match", within(tolerance, F.col(AT), F.col(ROW), "signal_time")).drop(ROW)
    placed = matched.withColumns({"_pos": F.row_number().over(by) - 1, "_before": F.lag(now).over(by)})
    new = (F.col("_pos") > 0) & now.isNotNull() & ~now.eqNullSafe(F.col("_before"))
    placed = placed.withColumn("_new", F.when(new, F.col("_pos"))).drop("_before")

    at = F.col("_pos")
    summary = placed.groupBy(*keys, BUCKET).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(now, at).alias("_first"), F.max_by(now, at).alias("_last"),
        F.max_by("_match", F.when(now.isNotNull(), at)).alias("_kept"), F.max("_new").alias("_since"))
    order = Window.partitionBy(*keys).orderBy(BUCKET)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    begins = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.lag("_last").over(order))
    summary = summary.withColumns({"_offset": offset, "_begins": begins})
    summary = summary.withColumn("_changed", F.coalesce(F.col("_offset") + F.col("_since"), F.when(F.col("_begins"), F.col("_offset"))))
    carry = summary.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col(BUCKET).alias("_of"), "_offset", "_begins",
        F.last("_kept", ignorenulls=True).over(earlier).alias("_kept"), F.last("_changed", ignorenulls=True).over(earlier).alias("_changed"))
    same = F.col(BUCKET).eqNullSafe(F.col("_of"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    inside = Window.partitionBy(*keys, BUCKET).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = placed.withColumns({"_own": F.last("_match", ignorenulls=True).over(inside), "_since": F.last("_new", ignorenulls=True).over(inside)})
    joined = kept.join(carry, same)
    last = F.coalesce(F.col("_own"), F.col("_kept"))
    place = F.col("_offset") + F.col("_pos")
    since = F.coalesce(F.col("_offset") + F.col("_since"), F.when(F.col("_begins"), F.col("_offset")), F.col("_changed"))
    own = [F.col(LEFT)[c].alias(c) for c in left.columns]
    out = joined.select(*own, *[last[c].alias(f"news_{c}") for c in values], (place - since).cast("long").alias("news_rows_since_update"))
    return out.withColumns(
        {
            "news_available": flag(F.col("news_signal_time").isNotNull()),
            "news_age_minutes": minutes_between(time, "news_signal_time"),
        }
    )


def asof_coverage(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    fresh = F.coalesce((F.col("news_rows_since_update") == 0).cast("double"), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.avg("news_available").alias("news_coverage"), F.avg(fresh).alias("fresh_news_share"), F.count(F.lit(1)).alias("rows")
    )
