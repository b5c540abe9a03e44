"""Equality joins of the gold stage."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_silver(
    technical: DataFrame, micro: DataFrame, volatility: DataFrame, keys: Sequence[str] = ("instrument", "time")
) -> DataFrame:
    """Inner join on key and time; each side adds only the columns not seen before."""
    merged = technical
    for side in (micro, volatility):
        new = [c for c in side.columns if c not in merged.columns]
        merged = merged.join(side.select(*keys, *new), list(keys), "inner")
    return merged


TARGETS = {
    "classification": "target_classification",
    "regression": "target_pct_change",
    "absolute": "target_regression",
}


def merge_labels(
    features: DataFrame, labels: DataFrame, task: str = "regression", keys: Sequence[str] = ("instrument", "time")
) -> DataFrame:
    """Inner join with the label table; ``target`` is chosen by task."""
    target = TARGETS[task]
    side = labels.select(*keys, F.col(target).alias("target"))
    return features.join(side, list(keys), "inner")


def manifest_left_join(
    manifest: DataFrame, gold: DataFrame, manifest_time: str = "published_at", gold_time: str = "timestamp",
    suffix: str = "_gold",
) -> DataFrame:
    """Articles with the gold rows of exactly their time; clashing names get a suffix."""
    for df, c in ((manifest, manifest_time), (gold, gold_time)):
        if c not in df.columns:
            raise KeyError(f"timestamp column {c!r} is missing")

    def parsed(df: DataFrame, c: str) -> DataFrame:
        if dict(df.dtypes)[c] == "string":
            return df.withColumn(c, F.try_to_timestamp(F.col(c)).cast("timestamp_ntz"))
        return df

    manifest, gold = parsed(manifest, manifest_time), parsed(gold, gold_time)
    renamed = gold.withColumnsRenamed({c: c + suffix for c in gold.columns if c in manifest.columns})
    right_time = gold_time + suffix if gold_time in manifest.columns else gold_time
    return manifest.join(renamed, manifest[manifest_time] == renamed[right_time], "left")
