"""The online feature row: the newest bars of each instrument, with its own formulas."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import SUB_ROWS
from ..functions.numeric import div, flag, safe_sqrt
from ..functions.rolling import ExpScan, Rows
from ..functions.series import POS, Series, apply_layers, ordinal
from .labels import LENGTH

ANNUAL = math.sqrt(252)
EPS = 1e-10


def newest_bars(df: DataFrame, series: Series = Series(), rows: int = 200, minimum: int = 50) -> DataFrame:
    """The last ``rows`` bars of every series that has at least ``minimum`` bars, numbered from 0."""
    placed = ordinal(df, series, POS, LENGTH)
    start = F.greatest(F.col(LENGTH) - rows, F.lit(0))
    tail = placed.filter((F.col(POS) >= start) & (F.col(LENGTH) >= minimum))
    return tail.withColumn(POS, F.col(POS) - start).drop(LENGTH)


def snapshot_features(df: DataFrame, series: Series = Series(), rows: int = 200, minimum: int = 50) -> DataFrame:
    """One feature row per series from its newest bars.

    Exponential means here weigh all rows (adjust=True), ratios carry a small constant, and
    the regime compares 20 with 50 rows.  At most ``rows`` bars per series take part.
    """
    own = series.with_step(None)
    totals: dict = {}
    r, scan = Rows(own, totals), ExpScan(own, SUB_ROWS)
    c, v = F.col("close"), F.col("volume")
    hl = F.col("high") - F.col("low")

    def log_ratio(a: str | Column, b: str | Column) -> Column:
        q = div(a, b)
        return F.when(q > 0, F.ln(q))

    delta = r.diff("close")
    up, down = r.diff("high"), -r.diff("low")
    zero = F.lit(0.0)
    base = {
        "_last": F.lead(F.lit(1)).over(r.w).isNull(),
        "return_1": r.pct("close", 1), "return_5": r.pct("close", 5), "return_10": r.pct("close", 10),
        "_gain": F.when(delta > 0, delta).otherwise(zero), "_loss": F.when(delta < 0, -delta).otherwise(zero),
        "_tr": F.greatest(hl, F.abs(F.col("high") - r.lag("close")), F.abs(F.col("low") - r.lag("close"))),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(zero),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(zero),
        "hl_range": hl, "hl_range_pct": div(hl, c), "spread_proxy": hl, "spread_pct": div(hl, c),
        "order_flow_imbalance": (c - F.col("open")) / (hl + EPS),
        "realized_range": div(hl, c), "_dv": r.diff("volume"),
        "_gk": 0.5 * log_ratio("high", "low") ** 2 - (2 * math.log(2) - 1) * log_ratio("close", "open") ** 2,
        "_pk": log_ratio("high", "low") ** 2,
        "_rs": log_ratio("high", "open") * log_ratio("high", "close") + log_ratio("low", "open") * log_ratio("low", "close"),
        "_co": log_ratio("close", "open"), "_oc": log_ratio("open", r.lag("close")),
        "_typical": (F.col("high") + F.col("low") + c) / 3 * v,
        "_d5": r.lag("close", 5), "_d10": r.lag("close", 10), "_d20": r.lag("close", 20),
    }
    whole = Window.partitionBy(*own.keys, "_block")
    second = {
        **{f"_g{n}": r.mean("_gain", n) for n in (14, 20)}, **{f"_l{n}": r.mean("_loss", n) for n in (14, 20)},
        "bb_middle": r.mean("close", 20), "_bb_std": r.std("close", 20),
        **{f"sma_{n}": r.mean("close", n) for n in (7, 14, 21, 50)},
        "atr_14": r.mean("_tr", 14), "_p14": r.mean("_pdm", 14), "_m14": r.mean("_mdm", 14),
        "momentum_5": c - F.col("_d5"), "momentum_10": c - F.col("_d10"), "momentum_20": c - F.col("_d20"),
        "roc_5": 100 * (div(c, "_d5") - 1), "roc_10": 100 * (div(c, "_d10") - 1),
        "volatility_20": r.std("return_1", 20), "volatility_50": r.std("return_1", 50),
        "hl_range_ma20": r.mean("hl_range", 20), "volume_ma20": r.mean("volume", 20), "volume_ma50": r.mean("volume", 50),
        "_vstd": r.std("volume", 20), "price_impact": F.abs("return_1") / (v + EPS),
        "illiquidity": F.abs("return_1") / (v + EPS) * 1e6,
        "vwap": div(F.sum("_typical").over(whole), F.sum("volume").over(whole)),
        "volume_velocity": r.mean("_dv", 10), "_ddv": r.diff("_dv"),
        "_gk20": r.mean("_gk", 20), "_pk20": r.mean("_pk", 20), "_rs20": r.mean("_rs", 20),
        "_co20": r.var("_co", 20), "_oc20": r.var("_oc", 20), "realized_range_ma": r.mean("realized_range", 20),
    }
    k = 0.34 / (1.34 + 21 / 19)
    pdi, mdi = 100 * div("_p14", "atr_14"), 100 * div("_m14", "atr_14")
    third = {
        **{f"rsi_{n}": 100 - 100 / (1 + F.col(f"_g{n}") / (F.col(f"_l{n}") + EPS)) for n in (14, 20)},
        "bb_upper": F.col("bb_middle") + 2 * F.col("_bb_std"), "bb_lower": F.col("bb_middle") - 2 * F.col("_bb_std"),
        "_dx": 100 * F.abs(pdi - mdi) / (pdi + mdi + EPS),
        "volume_ratio": v / (F.col("volume_ma20") + EPS),
        "volume_zscore": (v - F.col("volume_ma20")) / (F.col("_vstd") + EPS),
        "price_impact_ma20": r.mean("price_impact", 20), "illiquidity_ma20": r.mean("illiquidity", 20),
        "close_vwap_ratio": div(c, "vwap"), "volume_acceleration": r.mean("_ddv", 10),
        "hist_vol_20": F.col("volatility_20") * ANNUAL, "hist_vol_50": F.col("volatility_50") * ANNUAL,
        "gk_vol": safe_sqrt("_gk20") * ANNUAL, "parkinson_vol": safe_sqrt(F.col("_pk20") / (4 * math.log(2))) * ANNUAL,
        "rs_vol": safe_sqrt("_rs20") * ANNUAL,
        "yz_vol": safe_sqrt(F.col("_oc20") + k * F.col("_co20") + (1 - k) * F.col("_rs20")) * ANNUAL,
        "vol_of_vol": r.std("volatility_20", 20),
        "vol_regime_low": flag(F.col("volatility_20") < F.col("volatility_50") * 0.8),
        "vol_regime_high": flag(F.col("volatility_20") > F.col("volatility_50") * 1.2),
    }
    fourth = {
        "bb_width": F.col("bb_upper") - F.col("bb_lower"),
        "bb_position": (c - F.col("bb_lower")) / (F.col("bb_upper") - F.col("bb_lower") + EPS),
        "adx_14": r.mean("_dx", 14),
    }
    means = scan.mean_layers(
        {"ema_7": (c, 7), "ema_14": (c, 14), "ema_21": (c, 21), "_fast": (c, 12), "_slow": (c, 26)}, adjust=True
    )
    macd = {"macd": F.col("_fast") - F.col("_slow")}
    smooth = scan.mean_layers({"macd_signal": ("macd", 9)}, adjust=True)
    layers = [
        base, second, third, fourth, *means, macd, *smooth, {"macd_histogram": F.col("macd") - F.col("macd_signal")},
        *scan.std_layers("ewma_vol", "return_1", 20), {"is_last": F.col("_last")},
    ]
    tail = newest_bars(df, own, rows, minimum)
    return apply_layers(tail, own, layers, 0, sub=SUB_ROWS, totals=totals).filter("is_last").drop("is_last")
