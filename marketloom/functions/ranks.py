"""Running sums over sorted values without one task per key.

Values are first reduced to one row per distinct value.  Each key is split at quantiles of its distinct
values, taken from a mergeable sketch (partial in the map tasks), so that a bucket holds about one part in
`PARTS` of them however the values lie.  Running sums inside a bucket plus offsets from the bucket totals
are exact: only the sizes of the buckets, not the results, rest on the sketch.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import attach_by_key, attach_row

PARTS = 256  # buckets of a key, a power of two
ACCURACY = 10 * PARTS  # the sketch's error is a tenth of a bucket

EDGES, BUCKET = "_edges", "_vb"


def value_edges(df: DataFrame, keys: Sequence[str], value: str, parts: int = PARTS) -> DataFrame:
    """keys and `_edges`: the values at 1/parts, 2/parts, ... of a table of distinct values."""
    shares = [k / parts for k in range(1, parts)]
    return df.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), shares, ACCURACY).alias(EDGES))


def with_bucket(df: DataFrame, value: Column, parts: int = PARTS, edges: str = EDGES, name: str = BUCKET) -> DataFrame:
    """Number of edges below each value, by binary search (one column a step, so that no step is worked out twice)."""
    step, now = parts // 2, F.lit(0)
    while step:
        below = F.coalesce(F.get(F.col(edges), now + (step - 1)) < value, F.lit(False))
        df = df.withColumn(f"{name}_{step}", now + F.when(below, step).otherwise(0))
        now, step = F.col(f"{name}_{step}"), step // 2
    steps = [f"{name}_{2 ** k}" for k in range(parts.bit_length() - 1)]
    return df.withColumn(name, now).drop(edges, *steps)


def sorted_running(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column], parts: int = PARTS) -> DataFrame:
    """For rows unique per (keys, value): add below_<n>, upto_<n> and total_<n> of each sum; rows with a null value go."""
    keys = list(keys)
    df = df.filter(F.col(value).isNotNull()).withColumns({f"_m_{n}": c for n, c in sums.items()})
    edges = value_edges(df, keys, value, parts)
    df = with_bucket(attach_by_key(df, edges, keys, "inner") if keys else attach_row(df, edges), F.col(value).cast("double"), parts)
    totals = df.groupBy(*keys, BUCKET).agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in sums])
    by_key = Window.partitionBy(*keys)  # a row per bucket
    earlier = by_key.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        BUCKET,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(by_key).alias(f"total_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(offsets, [*keys, BUCKET]).withColumns(
        {f"upto_{n}": F.sum(f"_m_{n}").over(inside) + F.col(f"_o_{n}") for n in sums}
    )
    out = out.withColumns({f"below_{n}": F.col(f"upto_{n}") - F.col(f"_m_{n}") for n in sums})
    return out.drop(BUCKET, *[p + n for n in sums for p in ("_m_", "_o_")])


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per key: the mean of the two middle values."""
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = sorted_running(counts, keys, value, {"n": F.col("n")})
    last = F.col("total_n") - 1
    low, high = F.floor(last / 2), F.ceil(last / 2)

    def holds(rank: Column) -> Column:
        return (F.col("below_n") <= rank) & (rank < F.col("upto_n"))

    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2.0).alias(name)
    )
