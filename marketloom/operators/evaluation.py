"""Evaluation metrics as aggregations."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import div
from ..functions.ranks import sorted_running


def regression_metrics(
    df: DataFrame, keys: Sequence[str] = ("split",), prediction: str = "prediction", actual: str = "actual"
) -> DataFrame:
    """MSE, RMSE, MAE and R2 per group in one pass."""
    e = F.col(prediction) - F.col(actual)
    return df.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(actual))).alias("r2"),
        F.count(e).alias("rows"),
    )


def mape(
    df: DataFrame, keys: Sequence[str] = ("split",), prediction: str = "prediction", actual: str = "actual", floor: float = 1e-8
) -> DataFrame:
    """Mean absolute percentage error over rows whose truth is not (nearly) zero."""
    y = F.col(actual)
    term = F.when(F.abs(y) > floor, F.abs(div(y - F.col(prediction), y)))
    return df.groupBy(*keys).agg((F.avg(term) * 100).alias("mape"), F.count(term).alias("rows"))


def accuracy(df: DataFrame, keys: Sequence[str] = (), prediction: str = "prediction", actual: str = "actual") -> DataFrame:
    same = (F.col(prediction) == F.col(actual)).cast("double")
    return df.groupBy(*keys).agg(F.avg(same).alias("accuracy"), F.count(same).alias("rows"))


def auc(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve; tied scores count half.

    Scores are counted per distinct value first, so the sorted part is small.
    """
    counts = df.groupBy(*keys, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )
    ranked = sorted_running(counts, keys, score, {"neg": F.col("neg"), "pos": F.col("pos")})
    wins = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0))
    return ranked.groupBy(*keys).agg(
        F.try_divide(wins, F.max("total_pos").cast("double") * F.max("total_neg")).alias("auc"),
        F.max("total_pos").alias("positives"),
        F.max("total_neg").alias("negatives"),
    )


def confusion_matrix(df: DataFrame, keys: Sequence[str] = (), prediction: str = "prediction", actual: str = "actual") -> DataFrame:
    return df.groupBy(*keys, actual, prediction).agg(F.count(F.lit(1)).alias("rows"))


def classification_report(df: DataFrame, prediction: str = "prediction", actual: str = "actual") -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts."""
    cells = confusion_matrix(df, (), prediction, actual)
    sides = F.explode(
        F.array(
            F.struct(F.col(actual).alias("class"), F.col("rows").alias("truth"), F.lit(0).cast("long").alias("guess")),
            F.struct(F.col(prediction).alias("class"), F.lit(0).cast("long").alias("truth"), F.col("rows").alias("guess")),
        )
    )
    hit = F.when((F.col(actual) == F.col(prediction)) & (F.col("s.truth") > 0), F.col("rows")).otherwise(0)
    per = cells.withColumn("s", sides).groupBy("s.class").agg(
        F.sum(hit).alias("tp"), F.sum("s.truth").alias("support"), F.sum("s.guess").alias("guessed")
    )
    zero = F.lit(0.0)
    return per.select(
        "class",
        F.coalesce(div("tp", "guessed"), zero).alias("precision"),
        F.coalesce(div("tp", "support"), zero).alias("recall"),
        F.coalesce(div(2 * F.col("tp"), F.col("guessed") + F.col("support")), zero).alias("f1"),
        "support",
    )


def prediction_outcomes(df: DataFrame, prediction: str = "prediction", actual: str = "actual") -> DataFrame:
    return df.groupBy(
        F.col(prediction).alias("prediction"), (F.col(prediction) == F.col(actual)).cast("int").alias("correct")
    ).agg(F.count(F.lit(1)).alias("rows"))


def metric_diff(v1: DataFrame, v2: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Difference and percentage change of the metrics both versions have."""
    joined = v1.withColumnRenamed("value", "v1").join(v2.withColumnRenamed("value", "v2"), list(keys))
    diff = F.col("v2") - F.col("v1")
    return joined.withColumns({"diff": diff, "pct_change": F.coalesce(100 * div(diff, "v1"), F.lit(0.0))})


def cv_summary(df: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Mean and population deviation of fold scores."""
    return df.groupBy(*keys).agg(
        F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"), F.count(score).alias("folds")
    )
