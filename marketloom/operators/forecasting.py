"""Least squares on lags, recursive forecasts and stationarity statistics.

Fits need one aggregation of means and covariances per key; the small systems are solved
in batches of moment rows (one row per key), and predictions are dot products in Spark.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import Context, FeatureSet, feature
from ..functions.frames import attach_by_key
from ..functions.numeric import div, safe_sqrt
from ..functions.rolling import Rows
from ..functions.series import POS, Series, apply_layers, cumulative, floor_div, ordinal
from .labels import LENGTH

FIT_FIELDS = (
    "coef array<double>, n_obs bigint, rss double, tss double, r2 double, adj_r2 double, aic double, bic double, "
    "sigma2 double, xtx_inv array<array<double>>"
)


def moments(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Row count, means and co-moments (upper triangle) of features and target per key."""
    names = [*features, target]
    if where is not None:
        df = df.filter(where)
    df = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    pairs = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    return df.groupBy(*keys).agg(
        F.count(target).alias("n_obs"),
        F.array(*[F.avg(c) for c in names]).alias("means"),
        F.array(*pairs).alias("comoments"),
    )


def _unpack(n: float, means: Sequence[float], flat: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    m = np.asarray(means, dtype=float)
    c = np.zeros((len(m), len(m)))
    c[np.triu_indices(len(m))] = flat
    c = c + np.triu(c, 1).T
    return m, c * n


def solve(n: int, means: np.ndarray, sxy: np.ndarray, p: int) -> dict:
    """Intercept and slopes from centred sums of squares for the first ``p`` features."""
    s, y = sxy[:p, :p], sxy[:p, -1]
    inv = np.linalg.pinv(s)
    slope = inv @ y
    mx, my = means[:p], means[-1]
    tss = sxy[-1, -1]
    rss = max(float(tss - slope @ y), 0.0)
    k = p + 1
    dof = n - k
    full = np.empty((k, k))
    full[1:, 1:] = inv
    full[0, 1:] = full[1:, 0] = -inv @ mx
    full[0, 0] = 1.0 / n + mx @ inv @ mx
    r2 = 1.0 - rss / tss if tss > 0 else float("nan")
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(rss / n) + 1.0) if rss > 0 else float("inf")
    return {
        "coef": [float(my - slope @ mx), *map(float, slope)],
        "n_obs": int(n), "rss": rss, "tss": float(tss), "r2": r2,
        "adj_r2": 1.0 - (1.0 - r2) * (n - 1) / dof if dof > 0 else float("nan"),
        "aic": -2 * llf + 2 * k, "bic": -2 * llf + math.log(n) * k,
        "sigma2": rss / dof if dof > 0 else float("nan"),
        "xtx_inv": full.tolist(),
    }


def ols_fit(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ("instrument",), where: Column | None = None
) -> DataFrame:
    """One fit per key: coefficients (intercept first) and fit statistics.

    A key with too few rows keeps its row with ``n_obs`` and nulls.
    """
    p = len(features)
    stats = moments(df, features, target, keys, where)
    key_fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in stats.select(*keys).schema.fields)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                if r["n_obs"] <= p + 1:
                    rows.append({**{k: r[k] for k in keys}, "n_obs": int(r["n_obs"]), "coef": None, "xtx_inv": None})
                    continue
                means, sxy = _unpack(r["n_obs"], r["means"], r["comoments"])
                rows.append({**{k: r[k] for k in keys}, **solve(r["n_obs"], means, sxy, p)})
            names = [*keys, "coef", "n_obs", "rss", "tss", "r2", "adj_r2", "aic", "bic", "sigma2", "xtx_inv"]
            yield pd.DataFrame(rows, columns=names)

    return stats.mapInPandas(fit, key_fields + FIT_FIELDS)


def dot(weights: Column, terms: Sequence[Column]) -> Column:
    """weights[0] + sum of weights[i] * terms[i-1]."""
    out = F.get(weights, F.lit(0))
    for i, t in enumerate(terms, 1):
        out = out + F.get(weights, F.lit(i)) * t
    return out


def ols_predict(
    df: DataFrame, fits: DataFrame, features: Sequence[str], keys: Sequence[str] = ("instrument",), name: str = "prediction"
) -> DataFrame:
    weights = fits.select(*keys, F.col("coef").alias("_coef"))
    return (
        attach_by_key(df, weights, list(keys))
        .withColumn(name, dot(F.col("_coef"), [F.col(c) for c in features]))
        .drop("_coef")
    )


def ar_columns(lags: int, value: str = "return_30") -> list[str]:
    return [value, *[f"{value}_lag{k}" for k in range(1, lags + 1)]]


def ar_ols_fit(
    df: DataFrame, lags: int, keys: Sequence[str] = ("instrument",), value: str = "return_30", where: Column | None = None
) -> DataFrame:
    """Regress the next value on the current one and its lags (an ``ar_design`` table)."""
    return ols_fit(df, ar_columns(lags, value), "y_ar", keys, where)


def horizon_weights(coef: Sequence[float], steps: int) -> list[float]:
    """Weights (constant first) that give the value ``steps`` ahead of a one-step recursion.

    The recursion is linear, so its ``steps``-th power acts on [1, y(t), y(t-1), ...].
    """
    k = len(coef) - 1
    m = np.zeros((k + 1, k + 1))
    m[0, 0] = 1.0
    m[1, :] = coef
    for i in range(2, k + 1):
        m[i, i - 1] = 1.0
    return np.linalg.matrix_power(m, steps)[1].tolist()


def forecast_weights(fits: DataFrame, steps: int, keys: Sequence[str] = ("instrument",)) -> DataFrame:
    key_fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in fits.select(*keys).schema.fields)

    def power(batches):
        for batch in batches:
            out = batch[list(keys)].copy()
            out["coef"] = [None if c is None else horizon_weights(c, steps) for c in batch["coef"]]
            yield out

    return fits.select(*keys, "coef").mapInPandas(power, key_fields + "coef array<double>")


def ar_recursive_forecast(
    df: DataFrame, fits: DataFrame, lags: int, steps: int = 30, keys: Sequence[str] = ("instrument",),
    value: str = "return_30", name: str = "forecast",
) -> DataFrame:
    """The value ``steps`` ahead: one dot product per row instead of a loop per row."""
    return ols_predict(df, forecast_weights(fits, steps, keys), ar_columns(lags, value), keys, name)


def squared_error(coef: Sequence[float], n: int, means: np.ndarray, co: np.ndarray) -> float:
    """Mean squared error of a linear forecast from the moments of rows: regressors first, the truth last.

    The error is linear in the row, so its mean square is its squared mean plus a quadratic form of the co-moments.
    """
    p = len(coef) - 1
    at = [*range(p), len(means) - 1]
    v = np.array([*coef[1:], -1.0])
    bias = coef[0] + v @ means[at]
    return float(bias * bias + v @ (co[np.ix_(at, at)] / n) @ v)


def ar_lag_search(
    df: DataFrame, lag_min: int = 1, lag_max: int = 10, steps: int = 30, series: Series = Series(),
    value: str = "return_30", target: str = "target", split: str = "split", per_lag_rows: bool = False, mae: bool = True,
) -> DataFrame:
    """Validation error, AIC and BIC per lag count; ``best`` marks the smallest error.

    ``df`` is the ``ar_design`` table for ``lag_max`` with a split column.  By default every
    lag count uses the rows complete for ``lag_max``: one aggregate of the training rows gives all
    fits, one of the validation rows all squared errors.  ``per_lag_rows`` expects a table built
    with ``drop=False`` and uses the rows complete for each lag count.  Absolute errors (``mae``) need
    one more pass over the validation rows, with all fits of a key beside each row.
    """
    keys = list(series.keys)
    columns = ar_columns(lag_max, value)
    lags = list(range(lag_min, lag_max + 1))
    train, valid = F.col(split) == "train", F.col(split) == "val"

    def complete(n: int) -> Column:
        ok = F.col("y_ar").isNotNull() & F.col(target).isNotNull()
        for c in ar_columns(n, value):
            ok = ok & F.col(c).isNotNull()
        return ok

    key_fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*keys).schema.fields)
    schema = key_fields + "lag int, coef array<double>, aic double, bic double, train_samples bigint, val_rmse_target double, val_samples bigint"
    names = [*keys, "lag", "coef", "aic", "bic", "train_samples", "val_rmse_target", "val_samples"]

    def scores_for(wanted: Sequence[int], width: int) -> DataFrame:
        """Fits and squared errors of some lag counts over the rows complete for ``width`` lags."""
        fitted = moments(df, ar_columns(width, value), "y_ar", keys, train & complete(width))
        judged = moments(df, ar_columns(width, value), target, keys, valid & complete(width))
        both = fitted.join(judged.select(*keys, *[F.col(c).alias(f"v_{c}") for c in ("n_obs", "means", "comoments")]), keys)  # a row per key

        def score(batches):
            for batch in batches:
                rows = []
                for r in batch.to_dict("records"):
                    own = {k: r[k] for k in keys} | {"train_samples": int(r["n_obs"]), "val_samples": int(r["v_n_obs"])}
                    if r["n_obs"] <= width + 3:
                        rows += [{**own, "lag": n, "coef": None} for n in wanted]
                        continue
                    means, sxy = _unpack(r["n_obs"], r["means"], r["comoments"])
                    v_means, v_co = _unpack(r["v_n_obs"], r["v_means"], r["v_comoments"])
                    for n in wanted:
                        s = solve(r["n_obs"], means, sxy, n + 1)
                        coef = horizon_weights(s["coef"], steps)
                        error = math.sqrt(max(squared_error(coef, r["v_n_obs"], v_means, v_co), 0.0))
                        rows.append({**own, "lag": n, "coef": coef, "aic": s["aic"], "bic": s["bic"], "val_rmse_target": error})
                yield pd.DataFrame(rows, columns=names)

        return both.mapInPandas(score, schema)

    if per_lag_rows:
        scores = scores_for([lags[0]], lags[0])
        for n in lags[1:]:
            scores = scores.unionByName(scores_for([n], n))
    else:
        scores = scores_for(lags, lag_max)
    if mae:
        held = scores.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lag", "coef"))).alias("_fits"))  # a row per key
        rows = attach_by_key(df.filter(valid), held, keys, "inner")
        errors = {n: F.abs(dot(F.try_element_at("_fits", F.lit(n)), [F.col(c) for c in ar_columns(n, value)]) - F.col(target)) for n in lags}
        means = rows.groupBy(*keys).agg(*[F.avg(F.when(complete(n if per_lag_rows else lag_max), e)).alias(f"_{n}") for n, e in errors.items()])
        long = means.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"_{n}").alias("val_mae_target")) for n in lags])).alias("m")).select(*keys, "m.*")
        scores = scores.join(long, [*keys, "lag"], "left")
    best = scores.groupBy(*keys).agg(F.min_by("lag", F.when(F.col("val_rmse_target").isNotNull(), F.struct("val_rmse_target", "lag"))).alias("_best"))
    return scores.join(best, keys).withColumn("best", F.coalesce((F.col("lag") == F.col("_best")).cast("int"), F.lit(0))).drop("_best", "coef")


def ar_metrics(
    df: DataFrame, fits: DataFrame | None = None, keys: Sequence[str] = ("instrument",), prediction: str = "forecast",
    target: str = "target", split: str = "split",
) -> DataFrame:
    """Error of the horizon forecast per part, with the fit's R2 when given."""
    e = F.col(prediction) - F.col(target)
    out = df.groupBy(*keys, split).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(e).alias("rows")
    )
    return out if fits is None else out.join(fits.select(*keys, "r2", "adj_r2"), list(keys), "left")


def direct_h_ols(df: DataFrame, lags: int = 4, keys: Sequence[str] = ("instrument",), where: Column | None = None) -> DataFrame:
    """Fit y(t+h) on h-spaced lags (a ``block_lag_design`` table)."""
    return ols_fit(df, [f"lag_{i}" for i in range(lags)], "target", keys, where)


def student_quantile(dof: float, z: float = 1.959963984540054) -> float:
    """97.5 % point of the t distribution from the normal one (series in 1/dof)."""
    return (
        z + (z**3 + z) / (4 * dof) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * dof**2)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * dof**3)
    )


def prediction_interval(
    df: DataFrame, fits: DataFrame, lags: int = 4, h: int = 3, steps: int = 5, keys: Sequence[str] = ("instrument",),
    time: str = "time",
) -> DataFrame:
    """Mean, its error and 95 % bounds for t+h, t+2h, ... from the newest lags of each key.

    Step one uses the fit's covariance; later steps feed the forecast back and add the
    variance of the fed-back value.
    """
    keys = list(keys)
    names = [f"lag_{i}" for i in range(lags)]
    newest = df.groupBy(*keys).agg(F.max_by(F.array(*names), time).alias("lags"), F.max(time).alias("origin"))
    rows = newest.join(fits.select(*keys, "coef", "sigma2", "xtx_inv", "n_obs"), keys)
    key_fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*keys, "origin").schema.fields)
    schema = key_fields + ("step int, horizon int, mean double, mean_se double, pred_var double, ci_low double, ci_high double")

    def path(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                if r["coef"] is None:
                    out += [(*[r[k] for k in keys], r["origin"], step, step * h, *[None] * 5) for step in range(1, steps + 1)]
                    continue
                beta, inv = np.asarray(r["coef"]), np.stack([np.asarray(x) for x in r["xtx_inv"]])
                cov, state = inv * r["sigma2"], list(r["lags"])
                q = student_quantile(r["n_obs"] - len(beta))
                fed = 0.0
                for step in range(1, steps + 1):
                    x = np.array([1.0, *state])
                    mean, var_mean = float(x @ beta), float(x @ cov @ x)
                    var = var_mean + r["sigma2"] + fed
                    width = (q if step == 1 else 1.96) * math.sqrt(var)
                    out.append((*[r[k] for k in keys], r["origin"], step, step * h, mean, math.sqrt(var_mean), var,
                                mean - width, mean + width))
                    fed = float(beta[1]) ** 2 * var
                    state = [mean, *state[:-1]]
            yield pd.DataFrame(out, columns=[*keys, "origin", "step", "horizon", "mean", "mean_se", "pred_var", "ci_low", "ci_high"])

    return rows.mapInPandas(path, schema)


def walk_forward_predictions(
    df: DataFrame, fits: DataFrame, lags: int = 4, h: int = 3, series: Series = Series(), value: str = "y",
    split: str = "split", part: str = "val",
) -> DataFrame:
    """Forecasts of y(t+h) from every row of a part, with the truth inside the same part."""
    rows = Rows(series)
    layer = {f"lag_{i}": rows.lag(value, i * h) if i else F.col(value) for i in range(lags)}
    layer |= {"actual": rows.lead(value, h), "_part": rows.lead(split, h)}
    placed = apply_layers(
        df, series, [layer, {"actual": F.when(F.col("_part") == part, F.col("actual"))}], (lags - 1) * h, h
    )
    names = list(layer)[:lags]
    usable = placed.filter((F.col(split) == part) & F.col("actual").isNotNull()).dropna(subset=names)
    return ols_predict(usable, fits, names, series.keys)


def walk_forward_mse(df: DataFrame, fits: DataFrame, keys: Sequence[str] = ("instrument",), **params) -> DataFrame:
    """Mean squared error of :func:`walk_forward_predictions` per key."""
    p = walk_forward_predictions(df, fits, **params)
    e = F.col("prediction") - F.col("actual")
    return p.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.count(F.lit(1)).alias("forecasts"))


def series_chunks(df: DataFrame, chunks: int, series: Series = Series(), name: str = "chunk") -> DataFrame:
    """Number of the near-equal chunk (1..n) of each row; longer chunks come first."""
    placed = ordinal(df, series, POS, LENGTH)
    small = F.floor(F.col(LENGTH) / chunks)
    rest = F.col(LENGTH) % chunks
    edge = rest * (small + 1)
    number = F.when(F.col(POS) < edge, F.floor(F.col(POS) / (small + 1))).otherwise(
        rest + F.floor(F.try_divide(F.col(POS) - edge, small))
    )
    return placed.withColumn(name, (number + 1).cast("int")).drop(LENGTH, POS)


@feature
def _with_previous(c: Context, value: str, chunk: str) -> FeatureSet:
    same = c.rows.lag(chunk) == F.col(chunk)
    return FeatureSet([{"previous": F.when(same, c.rows.lag(value))}], 1)


def dickey_fuller_stat(
    df: DataFrame, value: str = "close", chunk: str = "chunk", series: Series = Series()
) -> DataFrame:
    """t statistic of y(t-1) in the regression of the difference on it and a constant."""
    pairs = _with_previous(df, series, value=value, chunk=chunk).filter(F.col("previous").isNotNull())
    x = F.col("previous").cast("double")
    dy = F.col(value).cast("double") - x
    n = F.col("n_obs")
    sums = pairs.withColumns({"_x": x, "_dy": dy}).groupBy(*series.keys, chunk).agg(
        F.count(F.lit(1)).alias("n_obs"), (F.var_pop("_x") * F.count(F.lit(1))).alias("_sxx"),
        (F.var_pop("_dy") * F.count(F.lit(1))).alias("_syy"), (F.covar_pop("_x", "_dy") * F.count(F.lit(1))).alias("_sxy"),
    )
    beta = div("_sxy", "_sxx")
    rss = F.col("_syy") - beta * F.col("_sxy")
    return sums.select(
        *series.keys, chunk, "n_obs", beta.alias("beta"), div(beta, safe_sqrt(div(div(rss, n - 2), "_sxx"))).alias("df_stat")
    )


# Published response surfaces of the unit-root test with a constant (one series): p-values as the
# normal distribution function of a polynomial in the statistic, below and above a break, and critical values in 1/n.
UNIT_ROOT_BREAK, UNIT_ROOT_MIN, UNIT_ROOT_MAX = -1.61, -18.83, 2.74
UNIT_ROOT_LOW = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
UNIT_ROOT_CRITICAL = {"crit_1": (-3.43035, -6.5393, -16.786, -79.433), "crit_5": (-2.86154, -2.8903, -4.234, -40.040), "crit_10": (-2.56677, -1.5384, -2.809, 0.0)}


def unit_root_pvalue(stat: float) -> float:
    if stat > UNIT_ROOT_MAX:
        return 1.0
    if stat < UNIT_ROOT_MIN:
        return 0.0
    z = sum(c * stat**k for k, c in enumerate(UNIT_ROOT_LOW if stat <= UNIT_ROOT_BREAK else UNIT_ROOT_HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def merged_moments(parts: Sequence[dict], at: Sequence[int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred products of some columns over several groups of rows."""
    n = sum(int(p["n_obs"]) for p in parts)
    means = [np.asarray(p["means"], float)[list(at)] for p in parts]
    mean = sum(p["n_obs"] * m for p, m in zip(parts, means)) / n
    total = np.zeros((len(at), len(at)))
    for p, m in zip(parts, means):
        _, co = _unpack(p["n_obs"], p["means"], p["comoments"])
        off = m - mean
        total += co[np.ix_(at, at)] + p["n_obs"] * np.outer(off, off)
    return n, mean, total


@feature
def _with_changes(c: Context, value: str, chunk: str, lags: int) -> FeatureSet:
    near = [c.rows.lag(chunk, k) == F.col(chunk) for k in range(1, lags + 1)]
    return FeatureSet([
        {"previous": F.when(c.rows.lag(chunk) == F.col(chunk), c.rows.lag(value).cast("double"))},
        {"change": F.col(value).cast("double") - F.col("previous")},
        {f"change_{k}": F.when(near[k - 1], c.rows.lag("change", k)) for k in range(1, lags + 1)},
    ], lags + 1)


def unit_root_test(
    df: DataFrame, value: str = "close", chunk: str = "chunk", max_lag: int = 12, series: Series = Series()
) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; the number of lagged changes is chosen by AIC.

    One aggregate per chunk gives the moments of the change, the level before and all lagged changes, in
    groups by how many lags a row has (only the first rows of a chunk lack some).  All lag orders are
    compared over the rows that have every lag; the chosen one is then fitted over all rows that have its
    own.  Columns: used_lag, n_obs, adf_stat, p_value, crit_1, crit_5, crit_10, aic (of the comparison).
    A chunk with too few rows, or a constant one, keeps its row with nulls.
    """
    keys = [*series.keys, chunk]
    names = ["previous", *[f"change_{k}" for k in range(1, max_lag + 1)]]
    rows = _with_changes(df, series, value=value, chunk=chunk, lags=max_lag)
    there = sum((F.col(c).isNotNull().cast("int") for c in names[1:]), F.lit(0))
    stats = moments(rows.filter(F.col("previous").isNotNull()).withColumn("_there", there), names, "change", [*keys, "_there"])
    parts = stats.groupBy(*keys).agg(F.collect_list(F.struct("_there", "n_obs", "means", "comoments")).alias("parts"))  # max_lag + 1 at most
    key_fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in parts.select(*keys).schema.fields)
    fields = ["used_lag", "n_obs", "adf_stat", "p_value", *UNIT_ROOT_CRITICAL, "aic"]

    def judged(groups: list[dict]) -> dict:
        whole = [g for g in groups if g["_there"] == max_lag]
        n = sum(int(g["n_obs"]) for g in whole)
        if n <= max_lag + 3:
            return {}
        last = max_lag + 1
        n, mean, total = merged_moments(whole, range(max_lag + 2))
        if total[0, 0] <= 0 or total[last, last] <= 0:
            return {}
        aic, used = min((solve(n, mean, total, p + 1)["aic"], p) for p in range(max_lag + 1))
        own = [g for g in groups if g["_there"] >= used]
        n, mean, total = merged_moments(own, [*range(used + 1), last])
        fit = solve(n, mean, total, used + 1)
        if not fit["sigma2"] > 0:
            return {}
        stat = fit["coef"][1] / math.sqrt(fit["sigma2"] * fit["xtx_inv"][1][1])
        critical = {k: sum(c / n**j for j, c in enumerate(v)) for k, v in UNIT_ROOT_CRITICAL.items()}
        return {"used_lag": used, "n_obs": n, "adf_stat": stat, "p_value": unit_root_pvalue(stat), **critical, "aic": aic}

    def test(batches):
        for batch in batches:
            out = pd.DataFrame([{**{k: r[k] for k in keys}, **judged(list(r["parts"]))} for r in batch.to_dict("records")], columns=[*keys, *fields])
            yield out.astype({"used_lag": "Int64", "n_obs": "Int64"})

    return parts.mapInPandas(test, key_fields + "used_lag int, n_obs bigint, adf_stat double, p_value double, " + "".join(f"{c} double, " for c in UNIT_ROOT_CRITICAL) + "aic double")


def kpss_stat(
    df: DataFrame, value: str = "close", chunk: str = "chunk", lags: int = 8, series: Series = Series()
) -> DataFrame:
    """Level-stationarity statistic with Bartlett weights over a fixed number of lags."""
    keys = [*series.keys, chunk]
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    centred = attach_by_key(df, means, keys, "inner").withColumn("e", F.col(value) - F.col("_mean")).drop("_mean")
    placed = ordinal(centred, series) if series.step is None else centred.withColumn(POS, series.position())
    placed = placed.withColumn("_b", floor_div(F.col(POS), series.block))
    summed = cumulative(placed, keys, "_b", [POS], {"partial": F.col("e")}).drop("_b")
    rows = Rows(series)
    lagged = {f"_e{k}": F.when(rows.lag(chunk, k) == F.col(chunk), rows.lag("e", k)) for k in range(1, lags + 1)}
    long_run = F.col("e") * F.col("e")
    for k in range(1, lags + 1):
        weight = 2.0 * (1.0 - k / (lags + 1.0))
        long_run = long_run + F.coalesce(weight * F.col("e") * F.col(f"_e{k}"), F.lit(0.0))
    base = summed if series.step is None else summed.drop(POS)
    out = apply_layers(base, series, [lagged, {"long_run": long_run}], lags)
    n = F.count(F.lit(1))
    return out.groupBy(*keys).agg(
        n.alias("n_obs"),
        F.try_divide(F.sum(F.col("partial") * F.col("partial")) / (n * n), F.sum("long_run") / n).alias("kpss_stat"),
    )
