"""Prediction log: append and read."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PREDICTION_LOG

NUMERIC = ("probability", "confidence", "signal_strength", "predicted_price", "predicted_relative_change",
           "features_used", "close", "rsi_14", "avg_sentiment")


def append_prediction_log(df: DataFrame, path: str) -> None:
    """Append one line per prediction; missing fields are written as null."""
    filled = [
        (F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in PREDICTION_LOG.fields
    ]
    df.select(*filled).write.mode("append").option("ignoreNullFields", "false").json(path)


def unwrap(x: Column) -> Column:
    """First element of a one-element JSON list, otherwise the value itself."""
    return F.when(x.startswith("["), F.get(F.from_json(x, "array<string>"), F.lit(0))).otherwise(x)


def parse_prediction_log(raw: DataFrame, min_records: int = 10) -> DataFrame:
    """Typed log rows; an empty result below the minimum record count."""
    typed = raw.withColumns(
        {
            **{c: unwrap(F.col(c)).try_cast("double") for c in NUMERIC},
            "prediction": unwrap(F.col("prediction")),
            "timestamp": F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz"),
        }
    )
    enough = raw.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_records).select(F.lit(1).alias("_one"))
    return typed.withColumn("_one", F.lit(1)).join(F.broadcast(enough), "_one", "left_semi").drop("_one")


def read_prediction_log(spark: SparkSession, path: str, min_records: int = 10) -> DataFrame:
    raw = spark.read.schema(PREDICTION_LOG).option("mode", "DROPMALFORMED").json(path)
    return parse_prediction_log(raw, min_records)
