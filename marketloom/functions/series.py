"""Partitioned time series.

One instrument may hold a third of all rows, so no operator here opens a window
over a whole series.  Three building blocks replace it:

* ``split_blocks``/``home_rows``: fixed blocks of rows plus a copied halo, for
  frames of bounded reach (lag, lead, rolling aggregates, exponential means);
* ``carry_forward``: in-bucket ``last`` plus a carry from a per-bucket summary,
  for unbounded look-back (forward fill, as-of lookups);
* ``ordinal``: in-bucket ``row_number`` plus an offset from per-bucket counts,
  for positions.

The summary tables hold one row per (key, time bucket): their size is bounded by
the covered time span divided by the bucket width, whatever the row count.  They
are joined back without a broadcast hint, so Spark broadcasts them only below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles on (key, bucket) otherwise.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import col

POS, BLOCK, SUB, BUCKET = "_pos", "_block", "_sub", "_bucket"


def epoch_seconds(time) -> Column:
    return F.unix_seconds(col(time).cast("timestamp"))


def epoch_micros(time) -> Column:
    return F.unix_micros(col(time).cast("timestamp"))


def floor_div(x: Column, n: int) -> Column:
    """Floor division of integers, also for negative values."""
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("long")


def floor_time(time, seconds: int) -> Column:
    """Start of the time slot of the given width (NTZ in UTC)."""
    s = epoch_seconds(time)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds))).cast("timestamp_ntz")


def minutes_between(later, earlier) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(60_000_000.0)


@dataclass(frozen=True)
class Series:
    """How rows form series: key columns, time column, and spacing.

    ``step`` is the spacing of a gap-free grid in seconds.  With ``step=None`` the
    rows are irregular and positions come from :func:`ordinal`.
    """

    keys: tuple[str, ...] = ("instrument",)
    time: str = "time"
    step: int | None = 60
    block: int = 8_192
    bucket: int = 86_400
    ties: tuple[str, ...] = ()

    def with_step(self, step: int | None) -> "Series":
        return replace(self, step=step)

    @property
    def width(self) -> int:
        """Bucket width in seconds; for grids about 1,440 slots."""
        return max(self.bucket, self.step * 1_440) if self.step else self.bucket

    def position(self) -> Column:
        return floor_div(epoch_seconds(self.time), self.step)

    def bucket_of(self, time=None) -> Column:
        return floor_div(epoch_seconds(time or self.time), self.width)

    def rows(self):
        """Window over the rows of one block, in time order."""
        return Window.partitionBy(*self.keys, BLOCK).orderBy(SUB, POS)

    def sub_rows(self):
        """Window over one sub-block; shares the sort of :meth:`rows`."""
        return Window.partitionBy(*self.keys, BLOCK, SUB).orderBy(POS)


#: For rows of any spacing: the default wherever a lag or a frame counts rows.
ANY_SPACING = Series(step=None)


def ordinal(df: DataFrame, series: Series, name: str = POS, total: str | None = None) -> DataFrame:
    """Add the 0-based position of every row in its series (and the series length)."""
    keys = [*series.keys, BUCKET]
    bucketed = df.withColumn(BUCKET, series.bucket_of())
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*series.keys)
    offsets = counts.withColumn(
        "_offset",
        F.coalesce(F.sum("_n").over(by_key.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    drop = ["_n", "_offset", BUCKET]
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(by_key))
    inside = Window.partitionBy(*keys).orderBy(series.time, *series.ties)
    return (
        bucketed.join(offsets, keys)
        .withColumn(name, F.row_number().over(inside) - F.lit(1) + F.col("_offset"))
        .drop(*drop)
    )


def split_blocks(
    df: DataFrame, series: Series, before: int = 0, after: int = 0, sub: int = 1_024
) -> DataFrame:
    """Assign rows to fixed blocks; copy edge rows so each block sees its neighbours.

    Adds the position, block and sub-block.  The last ``before`` rows of a block are
    also sent to the next block and the first ``after`` rows to the previous one.
    """
    if series.step is None:
        if POS not in df.columns:
            df = ordinal(df, series)
    else:
        df = df.withColumn(POS, series.position())
    size = max(series.block, 4 * max(before, after, 1))
    home = floor_div(F.col(POS), size)
    within = F.pmod(F.col(POS), F.lit(size))
    targets = [home]
    if before:
        targets.append(F.when(within >= size - before, home + 1))
    if after:
        targets.append(F.when(within < after, home - 1))
    df = df.withColumn("_home", home)
    if len(targets) == 1:
        df = df.withColumn(BLOCK, F.col("_home"))
    else:
        df = df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*targets))))
    df = df.withColumn(SUB, floor_div(F.col(POS), sub))
    # The work per row is far above its size: a fixed count keeps small inputs from being
    # coalesced into one task.
    return df.repartition(task_count(df), *series.keys, BLOCK)


def task_count(df: DataFrame) -> int:
    """Tasks for compute-heavy stages: the configured shuffle width, at least twice the cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def home_rows(df: DataFrame) -> DataFrame:
    """Drop the copied halo rows and all helper columns."""
    kept = df.filter(F.col(BLOCK) == F.col("_home"))
    return kept.drop(*[c for c in kept.columns if c.startswith("_")])


def apply_layers(
    df: DataFrame,
    series: Series,
    layers: Sequence[Mapping[str, Column]],
    before: int,
    after: int = 0,
    sub: int = 1_024,
    totals: Mapping[str, Mapping[str, Column]] | None = None,
) -> DataFrame:
    """Evaluate feature layers over blocks: one shuffle and one sort for all of them.

    Layer k may refer to columns of the layers below it.  ``before``/``after`` is the
    summed reach of the layers; ``totals`` are running totals per column, added once the
    column is there; helper columns start with an underscore.
    """
    blocked = split_blocks(df, series, before, after, sub)
    there = set(blocked.columns)
    waiting = dict(totals or {})
    for layer in layers:
        ready = [x for x in waiting if x in there]
        running = {n: c for x in ready for n, c in waiting.pop(x).items()}
        if running:
            blocked = blocked.withColumns(running)
        blocked = blocked.withColumns(dict(layer))
        there.update(layer)
    return home_rows(blocked)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    values: Mapping[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Add, per name, the last non-null value at (if inclusive) or before each row in ``order``."""
    group = [*keys, bucket]
    at = F.struct(*[F.col(c) for c in order])
    summary = df.groupBy(*group).agg(
        *[F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_s_{n}") for n, v in values.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *group, *[F.last(f"_s_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values]
    )
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = df.join(carried, group, "left").withColumns(
        {n: F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_c_{n}")) for n, v in values.items()}
    )
    return out.drop(*[f"_c_{n}" for n in values])


def cumulative(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Add, per name, the running sum up to each row: in-bucket sums plus bucket offsets."""
    staged = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    group = [*keys, bucket]
    totals = staged.groupBy(*group).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        staged.join(offsets, group)
        .withColumns({n: F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}") for n in sums})
        .drop(*[p + n for n in sums for p in ("_v_", "_o_")])
    )
