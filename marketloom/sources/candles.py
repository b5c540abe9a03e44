"""Candle files and nested broker payloads."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clean_double
from ..schemas import BROKER_PAYLOAD, CANDLE


def read_candles_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One candle per line; malformed lines and unreadable times are dropped, times are UTC.

    NaN and infinite values become NULL.

    Row order is left to the consumer: every operator here orders inside its partitions.
    """
    raw = spark.read.schema(CANDLE).option("mode", "DROPMALFORMED").json(path)
    parsed = raw.withColumn("time", F.try_to_timestamp(F.col("time")).cast("timestamp_ntz"))
    doubles = [f.name for f in parsed.schema if f.dataType.typeName() in ("double", "float")]
    return parsed.filter(F.col("time").isNotNull()).withColumns({c: clean_double(c) for c in doubles})


def flatten_broker_payload(df: DataFrame, payload: str = "payload", granularity: str = "M1") -> DataFrame:
    """Complete candles of nested payloads as flat rows with numeric prices."""
    parsed = df.withColumn("_p", F.from_json(payload, BROKER_PAYLOAD))
    keep = [c for c in df.columns if c != payload]
    return (
        parsed.select(*keep, F.explode("_p.candles").alias("k"))
        .filter(F.col("k.complete"))
        .select(
            *keep,
            F.try_to_timestamp("k.time").cast("timestamp_ntz").alias("time"),
            F.lit(granularity).alias("granularity"),
            *[
                clean_double(F.col(f"k.mid.{s}")).alias(n)
                for s, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))
            ],
            F.col("k.volume").alias("volume"),
        )
    )
