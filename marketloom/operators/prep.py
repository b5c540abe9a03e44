"""Gold cleaning and feature preparation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import Context, FeatureSet, feature
from ..functions.frames import attach_row, long_form, numeric_columns
from ..functions.ranks import exact_median
from ..functions.series import Series, apply_layers
from ..functions.rolling import Rows
from ..session import materialize
from .grid import fill_null_cells
from .technical import drop_sparse_rows

# Columns that never are features.
NOT_FEATURES = (
    "time", "instrument", "granularity", "close", "target", "target_classification", "target_regression",
    "target_pct_change", "target_multiclass", "future_close", "signal_time", "collected_at", "event_timestamp",
    "prediction_horizon_minutes", "label_generated_at", "fold", "news_signal_time",
)


def gold_clean(df: DataFrame, series: Series = Series(), share: float = 0.7) -> DataFrame:
    """Drop rows with too many gaps, fill forward, drop what still has gaps."""
    kept = drop_sparse_rows(df, share)
    fill = [c for c in df.columns if c not in (*series.keys, series.time)]
    return drop_sparse_rows(fill_null_cells(kept, fill, series), 1.0)


def feature_names(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def select_feature_columns(df: DataFrame, keep: Sequence[str] = (), exclude: Sequence[str] = NOT_FEATURES) -> DataFrame:
    return df.select(*keep, *feature_names(df, exclude))


#: Spark numbers the rows of a partition from the partition's number times two to this power.
PARTITION_BITS = 33


def ranked_values(values: DataFrame, column: str, name: str) -> DataFrame:
    """Different values with their rank from 0, numbered by all tasks at once."""
    ordered = values.select(column).repartitionByRange(column).sortWithinPartitions(column)
    # written, so that numbers and sizes are of the same partitions
    placed = materialize(ordered.withColumn("_id", F.monotonically_increasing_id()), "ranked-values")
    part = F.shiftright("_id", PARTITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_id") - F.shiftleft("_part", PARTITION_BITS)
    return placed.withColumn("_part", part).join(offsets, "_part").select(column, (F.col("_before") + inside).alias(name))


def categorical_codes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace strings and booleans by their rank among the sorted values; null is -1.

    The different values are range partitioned by samples of themselves, numbered inside each
    partition, and shifted by the sizes of the partitions before: a large dictionary is spread
    evenly over the tasks however long the prefixes are that its values share.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    for c in columns:
        values = df.select(F.col(c).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
        codes = ranked_values(values, "_v", "_code")
        df = (
            df.join(codes, df[c] == codes["_v"], "left")
            .withColumn(c, F.coalesce("_code", F.lit(-1)).cast("int"))
            .drop("_v", "_code")
        )
    return df


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians as one row."""
    per = exact_median(long_form(df, columns), ["feature"], "value", "median")
    return per.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_med_{c}") for c in columns])


def median_impute(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Fill gaps with the column median (of ``fit_on``, else of all rows).

    ``exact=False`` takes one pass with approximate percentiles instead of sorted value counts.
    """
    base = fit_on if fit_on is not None else df
    if exact:
        row = medians(base, columns)
    else:
        row = base.agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"_med_{c}") for c in columns])
    filled = attach_row(df, row)
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in columns}).drop(
        *[f"_med_{c}" for c in columns]
    )


def ffill_impute(df: DataFrame, columns: Sequence[str], series: Series = Series()) -> DataFrame:
    return fill_null_cells(df, columns, series)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at most one distinct value: one row of minima and maxima reaches the driver."""
    row = df.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def drop_constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*constant_columns(df, columns or numeric_columns(df)))


def standardize(df: DataFrame, columns: Sequence[str], train: Column, population: bool = True) -> DataFrame:
    """Z-scores with mean and deviation of the training rows; a constant column is only centred."""
    std = F.stddev_pop if population else F.stddev_samp
    stats = [F.avg(F.when(train, F.col(c))).alias(f"_mu_{c}") for c in columns]
    stats += [std(F.when(train, F.col(c))).alias(f"_sd_{c}") for c in columns]
    scaled = attach_row(df, df.agg(*stats))
    scale = {c: F.when(F.col(f"_sd_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_sd_{c}")) for c in columns}
    return scaled.withColumns({c: (F.col(c) - F.col(f"_mu_{c}")) / scale[c] for c in columns}).drop(
        *[p + c for c in columns for p in ("_mu_", "_sd_")]
    )


def lag_matrix(df: DataFrame, columns: Sequence[str], lags: int, series: Series = Series()) -> DataFrame:
    """Each column with its lags 1..n; incomplete rows dropped."""
    rows = Rows(series)
    layer = {f"{c}_lag{k}": rows.lag(c, k) for c in columns for k in range(1, lags + 1)}
    return apply_layers(df, series, [layer], lags).dropna(subset=[*columns, *layer])


def ar_design(
    df: DataFrame, lags: int, series: Series = Series(), value: str = "return_30", target: str | None = "target",
    drop: bool = True,
) -> DataFrame:
    """Value in percent, its lags 1..p and the next value ``y_ar``; incomplete rows dropped."""
    rows = Rows(series)
    scaled = df.withColumn(value, F.col(value).cast("double") * 100)
    layer = {f"{value}_lag{k}": rows.lag(value, k) for k in range(1, lags + 1)}
    layer["y_ar"] = rows.lead(value, 1)
    out = apply_layers(scaled, series, [layer], lags, 1)
    return out.dropna(subset=[value, *layer, *([target] if target else [])]) if drop else out


def block_lag_design(df: DataFrame, lags: int = 4, h: int = 3, series: Series = Series(), value: str = "y") -> DataFrame:
    """y(t), y(t-h), ... with the target y(t+h); incomplete rows dropped."""
    rows = Rows(series)
    layer = {f"lag_{i}": rows.lag(value, i * h) if i else F.col(value) for i in range(lags)}
    layer["target"] = rows.lead(value, h)
    return apply_layers(df, series, [layer], (lags - 1) * h, h).dropna(subset=list(layer))


@feature
def sequence_windows(c: Context, columns: Sequence[str] = ("close",), length: int = 50) -> FeatureSet:
    """The last ``length`` rows as arrays per column; null until there are that many."""
    frame = c.rows.frame(length)
    full = F.count(F.lit(1)).over(frame) == length
    return FeatureSet(
        [{f"{x}_sequence": F.when(full, F.collect_list(x).over(frame)) for x in columns}], length
    )


@feature
def difference(c: Context, value: str = "close", lag: int = 1, order: int | None = None) -> FeatureSet:
    """y - y(lag); with ``order`` the repeated first difference instead."""
    if order is None:
        return FeatureSet([{f"{value}_diff": c.rows.diff(value, lag)}], lag)
    layers = [{"_d0": F.col(value)}] + [{f"_d{i}": c.rows.diff(f"_d{i - 1}")} for i in range(1, order + 1)]
    return FeatureSet([*layers, {f"{value}_diff": F.col(f"_d{order}")}], order)


def _product_error(a: Column, b: Column, p: Column) -> Column:
    """a * b - p without rounding, from products of half-width parts."""

    def halves(x: Column) -> tuple[Column, Column]:
        c = x * 134_217_729.0
        high = c - (c - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    return ((ah * bh - p) + ah * bl + al * bh) + al * bl


def sigfigs(x: Column, digits: int = 4) -> Column:
    """Round to significant figures as decimal formatting of the exact binary value does.

    Only an exact half of the scaled value is ambiguous; the sign of the scaling error decides it.
    """
    x = x.cast("double")
    shift = F.floor(F.log10(F.abs(x))) - (digits - 1)
    scale = F.pow(F.lit(10.0), F.abs(shift))
    scaled = F.when(shift >= 0, x / scale).otherwise(x * scale)
    rest = F.when(shift >= 0, (x - scaled * scale) - _product_error(scaled, scale, scaled * scale)).otherwise(
        _product_error(x, scale, scaled)
    )
    low = F.floor(scaled)
    half = scaled - low == 0.5
    whole = F.when(half & (rest > 0), low + 1).when(half & (rest < 0), low).otherwise(F.rint(scaled)).cast("double")
    return F.when(x == 0, F.lit(0.0)).otherwise(F.when(shift >= 0, whole * scale).otherwise(whole / scale))


def round_sigfigs(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), sigfigs(F.col(c), digits)) for c in columns})


# The quantitative columns handed to the news feature extraction.
QUANT_FEATURES = ("ret_10", "momentum_20", "volume_ma_20", "sma_50", "volatility_50", "volume_ma50")


def quant_feature_json(df: DataFrame, names: Sequence[str] = QUANT_FEATURES, name: str = "quant_json") -> DataFrame:
    """Present quantitative columns, rounded, as JSON with sorted keys; nulls left out."""
    present = sorted(c for c in names if c in df.columns)

    def cell(c: str) -> Column:
        floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        return (F.when(F.col(c).isNotNull(), sigfigs(F.col(c))) if floating else F.col(c)).alias(c)

    return df.withColumn(name, F.to_json(F.struct(*[cell(c) for c in present])))
