"""Selection and history over tables of training runs and predictions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, by: Column, keys: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """Whole row with the largest (smallest) ``by`` per key."""
    pick = F.max_by if largest else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*df.columns), by).alias("_r")).filter(F.col("_r").isNotNull()).select("_r.*")


def best_by_test_rmse(runs: DataFrame, created: str = "created_at", key: str = "run_id") -> DataFrame:
    """Newest run per model type, of those the one with the smallest test error (model type decides ties)."""
    newest = _row(runs, F.struct(F.col(created), F.col(key)), ["model_type"])
    rmse = F.coalesce("test_rmse", F.lit(float("inf")))
    return _row(newest, F.struct(rmse, F.col("model_type")), largest=False)


def qualified_runs(runs: DataFrame, metric: str, threshold: float, overfit: float) -> DataFrame:
    test, train = metric.replace("oot_", "test_"), metric.replace("oot_", "train_")
    return (
        runs.withColumn("overfitting", F.col(train) - F.col(test))
        .filter((F.col(metric) >= threshold) & (F.col(test) >= threshold) & (F.col("overfitting") < overfit))
    )


def select_qualified_run(
    runs: DataFrame, metric: str = "oot_auc", min_threshold: float = 0.55, max_overfitting: float = 0.10, key: str = "run_id"
) -> DataFrame:
    """Best run by metric among those good enough and not overfitted (smallest id on ties)."""
    return qualified_runs(runs, metric, min_threshold, max_overfitting).orderBy(F.col(metric).desc(), key).limit(1)


def multi_experiment_select(
    experiments: Sequence[DataFrame], metric: str = "oot_auc", min_threshold: float = 0.50, max_overfitting: float = 0.15
) -> DataFrame:
    """The same over finished runs of several experiments."""
    runs = experiments[0]
    for e in experiments[1:]:
        runs = runs.unionByName(e, allowMissingColumns=True)
    return select_qualified_run(runs.filter(F.col("status") == "FINISHED"), metric, min_threshold, max_overfitting)


def best_per_type(runs: DataFrame, metric: str = "oot_auc", key: str = "run_id") -> DataFrame:
    present = runs.filter(F.col(metric).isNotNull())
    return _row(present, F.struct(F.col(metric), -F.col(key)), ["model_type"])


def top_n_runs(runs: DataFrame, n: int = 5, metric: str = "oot_auc", key: str = "run_id") -> DataFrame:
    return runs.filter(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), key).limit(n)


def latest_per_stage(versions: DataFrame, keys: Sequence[str] = ("name", "stage"), version: str = "version") -> DataFrame:
    return _row(versions, F.col(version), list(keys))


def all_versions(versions: DataFrame, version: str = "version") -> DataFrame:
    return versions.orderBy("name", F.col(version).desc())


def prediction_history_hourly(log: DataFrame, as_of: Column, instrument: str, hours: int = 24, time: str = "timestamp") -> DataFrame:
    """Hourly slots back from ``as_of`` with the last prediction of each slot, neutral where there is none."""
    start = as_of - F.expr(f"INTERVAL {hours} HOUR")
    recent = log.filter((F.col("instrument") == instrument) & (F.col(time) >= start) & (F.col(time) < as_of))
    elapsed = F.floor((F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3_600_000_000)
    # predictions of one time: the larger id, where there is one, then the larger values
    order = F.struct(time, *[c for c in ("event_id", "prediction", "probability", "confidence") if c in log.columns])
    last = recent.groupBy(elapsed.alias("slot")).agg(
        *[F.max_by(c, order).alias(c) for c in ("prediction", "probability", "confidence")],
    )
    slots = log.sparkSession.range(hours).withColumnRenamed("id", "slot")
    return slots.join(last, "slot", "left").select(
        (start + F.make_dt_interval(hours=F.col("slot").cast("int"))).alias("time"),
        F.coalesce("prediction", F.lit("neutral")).alias("prediction"),
        F.coalesce("probability", F.lit(0.5)).alias("probability"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
    )


def history_cap(log: DataFrame, n: int = 100, time: str = "timestamp", key: str = "event_id") -> DataFrame:
    return log.orderBy(F.col(time).desc(), F.col(key).desc()).limit(n)
