"""Feature importance tables (one row per feature of a model)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import attach_row
from ..functions.ranks import sorted_running

# Edges of the cumulative share groups.
EDGES = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9, 1.1)


def cumulative_importance(df: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """Rank (1 is the most important, ties by name) and cumulative share of each feature."""
    values = df.groupBy((-F.col(importance)).alias("_neg")).agg(F.count(F.lit(1)).alias("_n"), F.sum(importance).alias("_sum"))
    ranked = sorted_running(values, [], "_neg", {"n": F.col("_n"), "s": F.col("_sum")})
    tie = F.row_number().over(Window.partitionBy(importance).orderBy(feature))
    placed = df.withColumns({"_neg": -F.col(importance), "_tie": tie}).join(ranked, "_neg")
    rank = F.col("below_n") + F.col("_tie")
    upto = F.col("below_s") + F.col("_tie") * F.col(importance)
    return placed.select(
        feature, importance, rank.alias("rank"), F.try_divide(upto, F.col("total_s")).alias("cum_share"), F.col("total_n").alias("n_features")
    )


def share_bin(share: Column) -> Column:
    out = F.lit(None).cast("int")
    for i in range(len(EDGES) - 2, -1, -1):
        out = F.when(share <= EDGES[i + 1], F.lit(i)).otherwise(out)
    return out


def bin_label(i: int) -> str:
    return f"{int(EDGES[i] * 100)}–{int(EDGES[i + 1] * 100)}%"


def importance_cum_bins(df: DataFrame, feature: str = "feature", importance: str = "importance", minimum: int = 3) -> DataFrame:
    """Nested feature groups by cumulative share: (group, feature) rows.

    A group holds every feature of its own and all smaller bins; bins without features of
    their own and groups with fewer than ``minimum`` features are left out.
    """
    binned = cumulative_importance(df, feature, importance).withColumn("_bin", share_bin(F.col("cum_share")))
    sizes = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_own"))
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # at most nine rows
    kept = sizes.withColumn("_size", F.sum("_own").over(upto)).filter(F.col("_size") >= minimum)
    groups = kept.select(F.col("_bin").alias("_group"), F.col("_size").alias("group_size"))
    labels = F.array(*[F.lit(bin_label(i)) for i in range(len(EDGES) - 1)])
    member = binned.withColumn("_group", F.explode(F.sequence(F.col("_bin"), F.lit(len(EDGES) - 2))))
    return member.join(F.broadcast(groups), "_group").select(
        F.get(labels, F.col("_group")).alias("group"), "group_size", feature, "rank", "cum_share"
    )


def importance_knee(df: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """Features up to the point farthest above the straight line of equal shares."""
    cum = cumulative_importance(df, feature, importance)
    gap = F.col("cum_share") - F.col("rank") / F.col("n_features")
    knee = cum.agg(F.max_by("rank", F.struct(gap.alias("g"), -F.col("rank"))).alias("knee_rank"))
    return attach_row(cum, knee).filter(F.col("rank") <= F.col("knee_rank")).drop("n_features")


def top_importance(df: DataFrame, n: int = 20, feature: str = "feature", importance: str = "importance") -> DataFrame:
    return df.orderBy(F.col(importance).desc(), feature).limit(n)
