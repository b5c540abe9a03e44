"""Forward-looking labels, folds and temporal splits."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import Context, FeatureSet, feature
from ..functions.frames import attach_by_key
from ..functions.numeric import div, flag
from ..functions.series import ANY_SPACING, POS, Series, ordinal

LENGTH = "_length"


@feature
def future_close(c: Context, horizon: int = 30, close: str = "close") -> FeatureSet:
    return FeatureSet([{"future_close": c.rows.lead(close, horizon)}], 0, horizon)


def multiclass(change: Column) -> Column:
    """Five classes of a percentage change, bins closed on the right."""
    return (
        F.when(change <= -0.5, "strong_down")
        .when(change <= -0.1, "down")
        .when(change <= 0.1, "neutral")
        .when(change <= 0.5, "up")
        .when(change.isNotNull(), "strong_up")
    )


def target_labels(df: DataFrame, series: Series = ANY_SPACING, horizon: int = 30, drop: bool = True) -> DataFrame:
    """Direction, difference, percentage and class of the move over the horizon."""
    out = future_close(df, series, horizon=horizon)
    change = 100 * div(F.col("future_close") - F.col("close"), "close")
    out = out.withColumns(
        {
            "target_classification": flag(F.col("future_close") > F.col("close")),
            "target_regression": F.col("future_close") - F.col("close"),
            "target_pct_change": change,
        }
    ).withColumn("target_multiclass", multiclass(F.col("target_pct_change")))
    return out.filter(F.col("future_close").isNotNull()) if drop else out


def target_multiclass(df: DataFrame, change: str = "target_pct_change", name: str = "target_multiclass") -> DataFrame:
    return df.withColumn(name, multiclass(F.col(change)))


def label_distribution(df: DataFrame, label: str = "target_classification", keys: Sequence[str] = ()) -> DataFrame:
    """Rows, ups, downs and their shares."""
    up = F.sum(F.col(label))
    n = F.count(label)
    return df.groupBy(*keys).agg(
        n.alias("rows"), up.alias("up"), (n - up).alias("down"), div(up, n).alias("up_share"), div(n - up, n).alias("down_share")
    )


def target_summary(df: DataFrame, target: str = "target_pct_change", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(target).alias("rows"), F.avg(target).alias("target_mean"), F.stddev_samp(target).alias("target_std")
    )


def label_metadata(df: DataFrame, horizon: int, generated_at: str) -> DataFrame:
    return df.withColumns(
        {"prediction_horizon_minutes": F.lit(horizon), "label_generated_at": F.lit(generated_at)}
    )


def label_horizon_check(labels: DataFrame, requested: int, column: str = "prediction_horizon_minutes") -> DataFrame:
    """The horizon to use: the one stored with the labels wins over the requested one."""
    return labels.agg(F.min(column).alias("label_horizon")).select(
        F.lit(requested).alias("requested_horizon"),
        "label_horizon",
        F.coalesce("label_horizon", F.lit(requested)).alias("horizon"),
        flag(F.col("label_horizon") != requested).alias("overridden"),
    )


def drop_missing_target(df: DataFrame, target: str = "target") -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def _placed(df: DataFrame, series: Series) -> DataFrame:
    return ordinal(df, series, POS, LENGTH)


def expanding_folds(df: DataFrame, series: Series = Series(), folds: int = 5, name: str = "fold") -> DataFrame:
    """Fold number by position; the first block and the remainder get -1."""
    size = F.floor(F.col(LENGTH) / (folds + 1))
    number = F.floor(F.try_divide(F.col(POS), size)) - 1
    inside = (number >= 0) & (number < folds)
    return (
        _placed(df, series).withColumn(name, F.when(inside, number).otherwise(F.lit(-1)).cast("int")).drop(POS, LENGTH)
    )


def split_ratio(
    df: DataFrame, series: Series = Series(), shares: Sequence[float] = (0.6, 0.2, 0.1, 0.1), name: str = "split"
) -> DataFrame:
    """Train, validation, test and out-of-time parts by position."""
    ends = [sum(shares[: i + 1]) for i in range(3)]
    pos = F.col(POS)
    split = F.lit("oot")
    for label, end in reversed(list(zip(("train", "val", "test"), ends))):
        split = F.when(pos < F.floor(F.col(LENGTH) * F.lit(end)), label).otherwise(split)
    return _placed(df, series).withColumn(name, split).drop(POS, LENGTH)


# The dates that end the train, validation and test parts.
CUTOFFS = {"train": "2023-10-12 16:03:00", "val": "2024-10-11 06:16:00", "test": "2025-04-11 13:22:00"}


def split_dates(
    df: DataFrame, series: Series = Series(), cutoffs: Mapping[str, str] = CUTOFFS, withheld: int = 10_000,
    name: str = "split",
) -> DataFrame:
    """Parts by date; the last row up to a date already belongs to the next part.

    The last ``withheld`` rows of a series are set aside as "oot2".
    """
    keys = list(series.keys)
    counts = df.groupBy(*keys).agg(
        *[F.sum(flag(F.col(series.time) <= F.lit(at).cast("timestamp_ntz"))).alias(f"_n_{part}") for part, at in cutoffs.items()]
    )
    pos = F.col(POS)
    split = F.when(pos < F.col(LENGTH) - withheld, "oot").otherwise("oot2")
    for part in reversed(list(cutoffs)):
        split = F.when(pos < F.col(f"_n_{part}") - 1, part).otherwise(split)
    return (
        attach_by_key(_placed(df, series), counts, keys, "inner").withColumn(name, split)
        .drop(POS, LENGTH, *[f"_n_{p}" for p in cutoffs])
    )


def split_summary(df: DataFrame, keys: Sequence[str] = ("instrument",), time: str = "time", split: str = "split") -> DataFrame:
    """Rows, share and time range per part; totals come from the small summary, not from the rows."""
    parts = df.groupBy(*keys, split).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )
    totals = parts.groupBy(*keys).agg(F.sum("rows").alias("_total"))
    return parts.join(totals, list(keys)).withColumn("share", div("rows", "_total")).drop("_total")


def walk_forward_splits(
    df: DataFrame, series: Series = Series(), folds: int = 3, test_share: float | None = 0.15, test_rows: int | None = None,
    gap: int = 0, name: str = "test_fold",
) -> DataFrame:
    """Forward-chaining folds by position.

    Adds the fold a row is tested in (-1: never) and the first fold it may be trained in
    (null: in none).  A row trains every fold from that one on.
    """
    n = F.col(LENGTH)
    if test_rows is not None:
        size = F.lit(test_rows).cast("long")
    elif test_share is not None:
        size = F.floor(n * test_share)
    else:
        size = F.floor(n / (folds + 1))
    placed = _placed(df, series).withColumn("_size", size).withColumn("_start", n - folds * F.col("_size"))
    fold = F.floor((F.col(POS) - F.col("_start")) / F.col("_size"))
    # Fold f trains on positions below start + f * size - gap.
    first = F.greatest(F.floor((F.col(POS) - F.col("_start") + gap) / F.col("_size")) + 1, F.lit(0))
    return (
        placed.withColumn(name, F.when(F.col(POS) >= F.col("_start"), fold).otherwise(-1).cast("int"))
        .withColumn("train_from_fold", F.when(first < folds, first).cast("int"))
        .drop(POS, LENGTH, "_size", "_start")
    )


def purged_folds(df: DataFrame, series: Series = Series(), folds: int = 10, gap: int = 100, test_rows: int = 10_000) -> DataFrame:
    """Walk-forward folds of fixed test length with a gap before each test part."""
    return walk_forward_splits(df, series, folds, None, test_rows, gap)
