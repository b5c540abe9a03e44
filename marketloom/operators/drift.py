"""Drift checks over prediction logs and data sets; thresholds are parameters."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import attach_row, long_form, numeric_columns
from ..functions.numeric import div
from ..functions.ranks import sorted_running
from ..functions.series import Series, ordinal


@dataclass(frozen=True)
class DriftConfig:
    sentiment: float = 0.3
    prediction: float = 0.25
    confidence: float = 0.15
    window: int = 10
    cooldown_minutes: int = 15
    newest: int = 100


DEFAULTS = DriftConfig()
STRICT = DriftConfig(0.5, 0.3, 0.2, 20, 30)


def recent_bands(log: DataFrame, window: int, newest: int = 100, time: str = "timestamp", key: str = "event_id") -> DataFrame:
    """The newest rows with a band: 1 for the last ``window`` rows, 2 for the ones before.

    Only the top-k reaches the ranking, so its window holds at most ``newest`` rows.
    """
    if 2 * window > newest:
        raise ValueError("two bands need 2 x window rows: raise `newest`")
    order = [F.col(time).desc(), F.col(key).desc()]
    tail = log.orderBy(*order).limit(newest)
    rank = F.row_number().over(Window.orderBy(*order))
    return tail.withColumn("band", F.ceil(rank / F.lit(window)).cast("int")).filter(F.col("band") <= 2)


@dataclass(frozen=True)
class Check:
    """What one kind of alert compares: a measure's mean in the newest band with that in the band before."""

    kind: str
    measure: Column
    threshold: float
    high: float
    text: str
    fall: bool = False


def checks(config: DriftConfig) -> tuple[Check, Check, Check]:
    bullish = F.coalesce((F.col("prediction") == "bullish").cast("double"), F.lit(0.0))
    return (
        Check("sentiment_drift", F.coalesce("avg_sentiment", F.lit(0.0)), config.sentiment, 2.0, "Sentiment drift detected"),
        Check("prediction_drift", bullish, config.prediction, 1.5, "Prediction distribution drift detected"),
        Check("confidence_drop", F.coalesce("confidence", F.lit(0.0)), config.confidence, 1.5, "Model confidence drop detected", True),
    )


def _alerts(log: DataFrame, as_of: Column, config: DriftConfig, wanted: Sequence[Check]) -> DataFrame:
    """One alert row per check whose bands' means differ by more than its threshold; the log is ranked once."""
    bands = recent_bands(log, config.window, config.newest)
    means = bands.agg(
        *[F.avg(F.when(F.col("band") == band, c.measure)).alias(f"_{side}{k}") for k, c in enumerate(wanted) for side, band in (("b", 2), ("r", 1))],
        F.count(F.lit(1)).alias("_n"))
    rows = []
    for k, c in enumerate(wanted):
        change = F.col(f"_b{k}") - F.col(f"_r{k}")
        rows.append(F.struct(
            F.lit(c.kind).alias("type"), (change if c.fall else F.abs(change)).alias("drift_value"), F.col(f"_b{k}").alias("baseline"), F.col(f"_r{k}").alias("recent"),
            F.lit(float(c.threshold)).alias("threshold"), F.lit(c.threshold * c.high).alias("_severe"), F.lit(c.text).alias("_text")))
    told = means.filter(F.col("_n") >= 2 * config.window).select(F.explode(F.array(*rows)).alias("a")).select("a.*").filter(F.col("drift_value") > F.col("threshold"))
    numbers = F.format_string("%s: %.3f (baseline: %.3f, recent: %.3f)", "_text", "drift_value", "baseline", "recent")
    return told.select(
        "type", F.when(F.col("drift_value") > F.col("_severe"), "high").otherwise("medium").alias("severity"),
        "drift_value", "baseline", "recent", "threshold", numbers.alias("message"), as_of.alias("timestamp"))


def sentiment_drift(log: DataFrame, as_of: Column, config: DriftConfig = DEFAULTS) -> DataFrame:
    return _alerts(log, as_of, config, checks(config)[:1])


def prediction_drift(log: DataFrame, as_of: Column, config: DriftConfig = DEFAULTS) -> DataFrame:
    return _alerts(log, as_of, config, checks(config)[1:2])


def confidence_drop(log: DataFrame, as_of: Column, config: DriftConfig = DEFAULTS) -> DataFrame:
    return _alerts(log, as_of, config, checks(config)[2:])


def alert_cooldown(alerts: DataFrame, alert_log: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """Alerts whose type was not alerted within the last minutes."""
    recent = alert_log.filter(F.col("timestamp") > as_of - F.expr(f"INTERVAL {minutes} MINUTE")).select("type").distinct()
    return alerts.join(recent, "type", "left_anti")


def all_drifts(log: DataFrame, alert_log: DataFrame, as_of: Column, config: DriftConfig = DEFAULTS) -> DataFrame:
    return alert_cooldown(_alerts(log, as_of, config, checks(config)), alert_log, as_of, config.cooldown_minutes)


def ks_pvalue(d: Column, n: Column, m: Column, terms: int = 30) -> Column:
    """Asymptotic two-sample p-value."""
    lam = d * F.sqrt(n.cast("double") * m / (n + m))
    total = F.lit(0.0)
    for k in range(1, terms + 1):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam)
    return F.when(lam < 0.3, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def ks_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.1) -> DataFrame:
    """Two-sample statistic, p-value and verdict per numeric column.

    Both samples are reduced to counts per distinct value before anything is sorted.
    """
    columns = list(columns or numeric_columns(reference))
    long = long_form(reference, columns).withColumn("cur", F.lit(0)).unionByName(
        long_form(current, columns).withColumn("cur", F.lit(1))
    )
    counts = long.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.sum("cur").alias("c"), F.sum(1 - F.col("cur")).alias("r")
    )
    cum = sorted_running(counts, ["feature"], "value", {"r": F.col("r"), "c": F.col("c")})
    gap = F.abs(div("upto_r", "total_r") - div("upto_c", "total_c"))
    per = cum.groupBy("feature").agg(
        F.max(gap).alias("ks_stat"), F.max("total_r").alias("reference_rows"), F.max("total_c").alias("current_rows")
    )
    p = ks_pvalue(F.col("ks_stat"), F.col("reference_rows"), F.col("current_rows"))
    return per.withColumn("p_value", p).withColumn("drifted", (F.col("p_value") < threshold).cast("int"))


def dataset_drift(per_column: DataFrame, share: float = 0.5) -> DataFrame:
    """Number and share of drifted columns, and the verdict for the data set."""
    return per_column.agg(
        F.sum("drifted").alias("drifted_columns"), F.count(F.lit(1)).alias("columns"), F.avg("drifted").alias("drift_share"),
        (F.avg("drifted") >= share).cast("int").alias("dataset_drift"),
    )


def performance_degradation(
    df: DataFrame, part: str = "part", prediction: str = "prediction", actual: str = "actual", threshold: float = 0.2
) -> DataFrame:
    """Relative increase of the error from the reference to the current part."""
    e = F.col(prediction) - F.col(actual)

    def rmse(which: str) -> Column:
        return F.coalesce(F.sqrt(F.avg(F.when(F.col(part) == which, e * e))), F.lit(0.0))

    both = df.agg(rmse("reference").alias("reference_rmse"), rmse("current").alias("current_rmse"))
    rise = F.coalesce(div(F.col("current_rmse") - F.col("reference_rmse"), "reference_rmse"), F.lit(0.0))
    return both.withColumn("rmse_increase", rise).withColumn("degraded", (F.col("rmse_increase") > threshold).cast("int"))


def null_share(df: DataFrame) -> Column:
    cells = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    return F.try_divide(F.sum(cells).cast("double"), F.count(F.lit(1)).cast("double") * len(df.columns))


def missing_value_drift(reference: DataFrame, current: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Share of empty cells before and now."""
    ref = reference.agg(null_share(reference).alias("reference_missing"))
    cur = current.agg(null_share(current).alias("current_missing"))
    both = attach_row(ref, cur)
    return both.withColumns(
        {
            "missing_increase": F.col("current_missing") - F.col("reference_missing"),
            "missing_drift": (F.col("current_missing") > threshold).cast("int"),
        }
    )


def overall_drift(dataset: DataFrame, performance: DataFrame, missing: DataFrame) -> DataFrame:
    """The three verdicts (one row each) and their union."""
    row = attach_row(attach_row(dataset.select("dataset_drift"), performance.select("degraded")), missing.select("missing_drift"))
    return row.withColumn("overall_drift", F.greatest("dataset_drift", "degraded", "missing_drift"))


def reference_current_split(
    log: DataFrame, share: float = 0.7, time: str = "timestamp", key: str = "event_id", bucket: int = 3_600
) -> DataFrame:
    """Older and newer part of a log by position."""
    placed = ordinal(log, Series((), time, None, bucket=bucket, ties=(key,)), "_pos", "_length")
    return placed.withColumn(
        "part", F.when(F.col("_pos") < F.floor(F.col("_length") * share), "reference").otherwise("current")
    ).drop("_pos", "_length")


def monitored_features(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """Columns usable for drift checks: filled in both parts and not constant now; the first ``top`` are monitored."""
    now, then = F.col("part") == "current", F.col("part") == "reference"
    cells = []
    for i, c in enumerate(columns):
        current = F.when(now, F.col(c))
        usable = (F.count(current) > 0) & (F.count(F.when(then, F.col(c))) > 0) & ~F.min(current).eqNullSafe(F.max(current))
        cells.append(F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), usable.cast("int").alias("usable")))
    table = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    nth = F.sum("usable").over(Window.orderBy("place"))  # one row per column
    return table.withColumn("monitored", ((F.col("usable") == 1) & (nth <= top)).cast("int")).drop("place")


def prediction_log_stats(log: DataFrame, keys: Sequence[str] = (), time: str = "timestamp") -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("predictions"), F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        F.count(F.when(F.col("prediction") == "bullish", 1)).alias("bullish"),
        F.count(F.when(F.col("prediction") == "bearish", 1)).alias("bearish"),
        F.avg("confidence").alias("mean_confidence"), F.avg("predicted_price").alias("mean_price"),
        F.min("predicted_price").alias("min_price"), F.max("predicted_price").alias("max_price"),
    )
