"""Data-quality checks: every check is one aggregation with a verdict."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import attach_row
from ..functions.numeric import div, flag


def dq_bronze(df: DataFrame, minimum: int = 1_000, time: str = "time") -> DataFrame:
    """Row count against the minimum, time range and column list."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        F.lit(",".join(df.columns)).alias("columns"), flag(F.count(F.lit(1)) >= minimum).alias("passed"),
    )


def dq_gold_missing(df: DataFrame, limit: float = 50.0) -> DataFrame:
    """Percentage of nulls per column; a column above the limit fails."""
    n = F.count(F.lit(1))
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(div(100 * (n - F.count(c)), n), F.lit(0.0)).alias("missing_pct"))
        for c in df.columns
    ])
    return (
        df.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")
        .withColumn("failed", flag(F.col("missing_pct") > limit))
    )


def dq_profile(df: DataFrame, time: str = "time") -> DataFrame:
    n = F.count(F.lit(1))
    nulls = sum((n - F.count(c) for c in df.columns), F.lit(0))
    return df.agg(
        n.alias("rows"), F.lit(len(df.columns)).alias("columns"), F.min(time).alias("first_time"),
        F.max(time).alias("last_time"), nulls.alias("nulls"),
    )


def dq_schema_range(
    df: DataFrame, minimum: int = 50, required: Sequence[str] = ("user_id", "feature_a", "label"), feature: str = "feature_a",
    low: float = 0, high: float = 10, label: str = "label",
) -> DataFrame:
    """Minimum rows, required columns, value range, binary labels; the first failed check is the reason."""
    missing = [c for c in required if c not in df.columns]
    n = F.count(F.lit(1))

    def bad(column: str, ok: Column) -> Column:
        if column not in df.columns:
            return F.lit(0).cast("long")
        return F.count(F.when(~F.coalesce(ok, F.lit(False)), 1))

    out = df.agg(
        n.alias("rows"), bad(feature, F.col(feature).between(low, high)).alias("out_of_range"),
        bad(label, F.col(label).isin(0, 1)).alias("bad_labels"),
    )
    reason = (
        F.when(F.col("rows") < minimum, "too few rows")
        .when(F.lit(bool(missing)), "missing columns: " + ",".join(missing))
        .when(F.col("out_of_range") > 0, f"{feature} out of range")
        .when(F.col("bad_labels") > 0, "invalid label values")
        .otherwise("")
    )
    return out.withColumn("reason", reason).withColumn("passed", flag(F.col("reason") == ""))


def dq_outlier_5sigma(df: DataFrame, columns: Sequence[str], keys: Sequence[str], sigmas: float = 5.0) -> DataFrame:
    """Cells farther than ``sigmas`` deviations from the column mean."""
    stats = df.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]
    )
    cells = F.array_compact(F.array(*[
        F.when(
            F.abs(F.col(c) - F.col(f"_m_{c}")) > sigmas * F.col(f"_s_{c}"),
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                     div(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}").alias("z")),
        )
        for c in columns
    ]))
    return attach_row(df.select(*keys, *columns), stats).select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def dq_duplicate_time(df: DataFrame, keys: Sequence[str] = ("instrument", "time"), order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first in ``order`` (or by all columns)."""
    by = F.struct(*(order or df.columns))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), by).alias("_r")).select(*keys, "_r.*")


def dq_freshness(df: DataFrame, as_of: Column, days: int = 7, keys: Sequence[str] = (), time: str = "time") -> DataFrame:
    newest = F.max(time)
    return df.groupBy(*keys).agg(
        newest.alias("newest_time"), flag(newest < as_of - F.expr(f"INTERVAL {days} DAY")).alias("stale")
    )


def health_check(df: DataFrame, min_auc: float = 0.5, max_overfit: float = 0.3, rmse_ratio: float = 1.2) -> DataFrame:
    """Verdicts per run on out-of-time AUC, overfitting and error growth."""
    auc_ok = flag(F.col("oot_auc") >= min_auc)
    overfit = F.col("train_auc") - F.col("test_auc")
    fit_ok = flag(overfit <= max_overfit)
    rmse_ok = flag(F.col("oot_rmse") < rmse_ratio * F.col("test_rmse"))
    return df.withColumns(
        {"overfitting": overfit, "auc_ok": auc_ok, "overfit_ok": fit_ok, "rmse_ok": rmse_ok, "healthy": auc_ok * fit_ok * rmse_ok}
    )


def transform_filter(df: DataFrame, feature: str = "feature_a", minimum: float = 3) -> DataFrame:
    return df.filter(F.col(feature) >= minimum)


def user_feature_mean(
    df: DataFrame, user: str = "user_id", feature: str = "feature_a", label: str = "label", order: str = "row_id"
) -> DataFrame:
    """Mean feature per user with the user's first label."""
    return df.groupBy(user).agg(F.avg(feature).alias("feat_mean"), F.min_by(label, order).alias("label"))
