"""Technical indicators per instrument (silver layer)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import Context, FeatureSet, compute, feature
from ..functions.frames import attach_by_key
from ..functions.numeric import div
from ..functions.rolling import warmup
from ..functions.series import ANY_SPACING, Series

RETURN_STEPS = (1, 5, 10, 30, 60, 90, 120, 150, 180, 210, 240, 270, 360)


@feature
def returns(c: Context, close: str = "close", steps=RETURN_STEPS) -> FeatureSet:
    return FeatureSet([{f"return_{k}": c.rows.pct(close, k) for k in steps}], max(steps))


@feature
def rsi(c: Context, close: str = "close", periods=(14, 20)) -> FeatureSet:
    """Relative strength with simple rolling means; no loss gives 100, no move gives NULL."""
    delta = c.rows.diff(close)
    zero = F.lit(0.0)
    moves = {
        "_gain": F.when(delta > 0, delta).otherwise(zero),
        "_loss": F.when(delta < 0, -delta).otherwise(zero),
    }
    means, out = {}, {}
    for n in periods:
        gain, loss = f"_gain_{n}", f"_loss_{n}"
        means |= {gain: c.rows.mean("_gain", n), loss: c.rows.mean("_loss", n)}
        out[f"rsi_{n}"] = F.when(
            F.col(loss) == 0, F.when(F.col(gain) > 0, F.lit(100.0))
        ).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + div(gain, loss)))
    return FeatureSet([moves, means, out], max(periods) + 1)


@feature
def ema(c: Context, close: str = "close", spans=(7, 14, 21)) -> FeatureSet:
    scan = c.scan
    layers = scan.mean_layers({f"ema_{n}": (close, n) for n in spans})
    return FeatureSet([scan.start(), *layers], warmup(max(spans)))


@feature
def macd(c: Context, close: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> FeatureSet:
    scan = c.scan
    lines = scan.mean_layers({"_macd_fast": (close, fast), "_macd_slow": (close, slow)})
    diff = {"macd": F.col("_macd_fast") - F.col("_macd_slow")}
    smooth = scan.mean_layers({"macd_signal": ("macd", signal)})
    hist = {"macd_histogram": F.col("macd") - F.col("macd_signal")}
    return FeatureSet([scan.start(), *lines, diff, *smooth, hist], warmup(slow) + warmup(signal))


@feature
def bollinger(c: Context, close: str = "close", period: int = 20, width: float = 2.0) -> FeatureSet:
    upper = F.col("bb_middle") + width * F.col("_bb_std")
    lower = F.col("bb_middle") - width * F.col("_bb_std")
    return FeatureSet(
        [
            {"bb_middle": c.rows.mean(close, period), "_bb_std": c.rows.std(close, period)},
            {"bb_upper": upper, "bb_lower": lower},
            {
                "bb_width": div(F.col("bb_upper") - F.col("bb_lower"), "bb_middle"),
                "bb_position": div(F.col(close) - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")),
            },
        ],
        period,
    )


@feature
def sma(c: Context, close: str = "close", periods=(7, 14, 21, 50)) -> FeatureSet:
    return FeatureSet([{f"sma_{n}": c.rows.mean(close, n) for n in periods}], max(periods))


def _true_range(c: Context) -> Column:
    prev = c.rows.lag("close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


@feature
def true_range(c: Context) -> FeatureSet:
    return FeatureSet([{"true_range": _true_range(c)}], 1)


@feature
def atr(c: Context, period: int = 14) -> FeatureSet:
    return FeatureSet([{"_tr": _true_range(c)}, {f"atr_{period}": c.rows.mean("_tr", period)}], period + 1)


@feature
def adx(c: Context, period: int = 14) -> FeatureSet:
    """Trend strength from simple rolling means; both directions may count in the same bar."""

    def floored(move: Column) -> Column:
        return F.when(move < 0, F.lit(0.0)).otherwise(move)

    roll = c.rows.mean
    return FeatureSet(
        [
            {
                "_tr": _true_range(c),
                "_up_move": floored(c.rows.diff("high")),
                "_down_move": floored(-c.rows.diff("low")),
            },
            {
                "_adx_atr": roll("_tr", period),
                "_adx_up": roll("_up_move", period),
                "_adx_down": roll("_down_move", period),
            },
            {
                "_plus_di": 100 * div("_adx_up", "_adx_atr"),
                "_minus_di": 100 * div("_adx_down", "_adx_atr"),
            },
            {"_dx": 100 * div(F.abs(F.col("_plus_di") - F.col("_minus_di")), F.col("_plus_di") + F.col("_minus_di"))},
            {f"adx_{period}": roll("_dx", period)},
        ],
        2 * period + 1,
    )


@feature
def momentum(c: Context, close: str = "close", steps=(5, 10, 20)) -> FeatureSet:
    return FeatureSet([{f"momentum_{k}": c.rows.diff(close, k) for k in steps}], max(steps))


@feature
def roc(c: Context, close: str = "close", steps=(5, 10)) -> FeatureSet:
    return FeatureSet(
        [{f"roc_{k}": 100 * div(c.rows.diff(close, k), c.rows.lag(close, k)) for k in steps}], max(steps)
    )


def return_deviations(c: Context, periods, close: str = "close") -> list[dict]:
    """Layers with the one-step return and its rolling deviations, shared by several features."""
    return [{"_ret": c.rows.pct(close, 1)}, {f"_ret_std_{n}": c.rows.std("_ret", n) for n in periods}]


@feature
def rolling_volatility(c: Context, close: str = "close", periods=(20, 50)) -> FeatureSet:
    out = {f"volatility_{n}": F.col(f"_ret_std_{n}") for n in periods}
    return FeatureSet([*return_deviations(c, periods, close), out], max(periods) + 1)


def min_periods_guard(df: DataFrame, keys=("instrument",), minimum: int = 50) -> DataFrame:
    """Drop series with fewer than ``minimum`` rows.

    The counts are one row per key; the rows of a key are dealt over many tasks.
    """
    enough = df.groupBy(*keys).count().filter(F.col("count") >= minimum).select(*keys)
    return attach_by_key(df, enough, list(keys), "left_semi")


def drop_sparse_rows(df: DataFrame, share: float = 0.5, columns=None) -> DataFrame:
    """Keep rows with at least ``share`` of their cells filled."""
    columns = list(columns or df.columns)
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.filter(filled >= share * len(columns))


def technical_builders():
    return [
        returns.using(), rsi.using(), macd.using(), bollinger.using(), sma.using(), ema.using(), atr.using(),
        adx.using(), momentum.using(), roc.using(), rolling_volatility.using(),
    ]


def technical_features(df: DataFrame, series: Series = ANY_SPACING, minimum: int = 50) -> DataFrame:
    """All indicators in one pass over the blocks."""
    return compute(min_periods_guard(df, series.keys, minimum), series, technical_builders())
