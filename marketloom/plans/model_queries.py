"""Queries over forecasts, boosted trees, importance and evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import numeric_columns
from ..functions.numeric import correlation
from ..functions.series import Series
from ..operators import boosting as bo
from ..operators import evaluation as ev
from ..operators import forecasting as fo
from ..operators import importance as im
from ..operators import labels as la
from ..operators import prep as pr
from ..operators import scoring as sc
from ..operators import snapshot as sn
from ..operators import technical as te
from ..session import materialize
from .catalog import cols, cte, query, rnd, sql, table
from .gold_queries import RATIO, ar_rows, block_rows, closes, labelled
from .inputs import HOURLY, bars, hourly
from .market_queries import log_ratio
from .medallion import silver_market

IRREGULAR = Series(step=None)
KEYS = ["instrument"]

# --- autoregression -----------------------------------------------------------------------------


@query("ar_ols_fit", sql(
    "SELECT instrument, R6(regr_intercept(y_ar, return_30)) AS intercept, R6(regr_slope(y_ar, return_30)) AS slope, count(*) AS n_obs, R6(regr_r2(y_ar, return_30)) AS r2 "
    "FROM ar_rows GROUP BY 1", "ar_rows"))
def _ar_fit(s, d):
    fit = fo.ar_ols_fit(ar_rows(s, d), 0)
    return fit.select("instrument", F.get("coef", F.lit(0)).alias("intercept"), F.get("coef", F.lit(1)).alias("slope"), "n_obs", "r2")


# Two regressors (value and one lag) solved by Cramer's rule, then the 30-step recursion step by step.
_FORECAST = (
    "m AS (SELECT instrument, covar_pop(y_ar, return_30) AS c1, covar_pop(y_ar, return_30_lag1) AS c2, var_pop(return_30) AS v1, "
    "var_pop(return_30_lag1) AS v2, covar_pop(return_30, return_30_lag1) AS v12, avg(y_ar) AS my, avg(return_30) AS m1, avg(return_30_lag1) AS m2 FROM ar_rows GROUP BY 1), "
    "b AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM m), "
    "k AS (SELECT instrument, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM b), "
    "f AS (SELECT r.instrument, r.time, r.target, 0 AS step, r.return_30 AS p, r.return_30_lag1 AS q FROM ar_rows r UNION ALL "
    "SELECT f.instrument, f.time, f.target, step + 1, b0 + b1 * p + b2 * q, p FROM f JOIN k USING (instrument) WHERE step < 30), "
)


def forecasts(s, d):
    rows = ar_rows(s, d)
    return fo.ar_recursive_forecast(rows, fo.ar_ols_fit(rows, 1), 1)


def deep_forecasts(s, d):
    """Seven lags, the depth in use; the SQL twin above solves two regressors."""
    rows = ar_rows(s, d, 7)
    return fo.ar_recursive_forecast(rows, fo.ar_ols_fit(rows, 7), 7)


query("ar_recursive_forecast", sql(_FORECAST + "x AS (SELECT * FROM f WHERE step = 30) SELECT instrument, time, R6(p) AS forecast FROM x", "ar_rows", recursive=True))(
    lambda s, d: cols(forecasts(s, d), ["forecast"]))
_split = RATIO.replace("pos", "(row_number() OVER w - 1)").replace("n *", "count(*) OVER (PARTITION BY instrument) *")
query("ar_recursive_forecast_7")(lambda s, d: cols(deep_forecasts(s, d), ["forecast"]))
query("ar_metrics_7")(lambda s, d: fo.ar_metrics(la.split_ratio(deep_forecasts(s, d), IRREGULAR)))
query("ar_metrics", sql(
    _FORECAST + f"x AS (SELECT instrument, p - target AS e, {_split} AS split FROM f WHERE step = 30 WINDOW w AS (PARTITION BY instrument ORDER BY time)) "
    "SELECT instrument, split, R6(sqrt(avg(e * e))) AS rmse, R6(avg(abs(e))) AS mae, count(*) AS rows FROM x GROUP BY 1, 2", "ar_rows", recursive=True))(
    lambda s, d: fo.ar_metrics(la.split_ratio(forecasts(s, d), IRREGULAR)))


@query("ar_lag_search")
def _lag_search(s, d):
    rows = la.split_ratio(ar_rows(s, d, 10), IRREGULAR)
    return fo.ar_lag_search(rows, 1, 10, 30, HOURLY)


@query("direct_h_ols")
def _direct(s, d):
    fit = fo.direct_h_ols(block_rows(s, d), 4)
    return fit.select("instrument", *[F.get("coef", F.lit(i)).alias(f"coef_{i}") for i in range(5)], "n_obs", "r2")


query("direct_h_ols_single", sql(
    "SELECT instrument, R6(regr_intercept(target, lag_0)) AS intercept, R6(regr_slope(target, lag_0)) AS slope, count(*) AS n_obs FROM block_rows GROUP BY 1", "block_rows"))(
    lambda s, d: fo.direct_h_ols(block_rows(s, d), 1).select(
        "instrument", F.get("coef", F.lit(0)).alias("intercept"), F.get("coef", F.lit(1)).alias("slope"), "n_obs"))


@query("prediction_interval")
def _interval(s, d):
    rows = block_rows(s, d)
    return fo.prediction_interval(rows, fo.direct_h_ols(rows, 4), 4, 3, 5)


_wf = (
    f"p AS (SELECT instrument, time, close AS y, {_split} AS split FROM grid_1h WINDOW w AS (PARTITION BY instrument ORDER BY time)), "
    "q AS (SELECT *, lead(y, 3) OVER (PARTITION BY instrument ORDER BY time) AS y3, lead(split, 3) OVER (PARTITION BY instrument ORDER BY time) AS s3 FROM p), "
    "m AS (SELECT instrument, regr_slope(y3, y) AS b, regr_intercept(y3, y) AS a FROM q WHERE split = 'train' GROUP BY 1), "
    "e AS (SELECT instrument, a + b * y - y3 AS e FROM q JOIN m USING (instrument) WHERE split = 'val' AND s3 = 'val') "
)


@query("walk_forward_mse", sql(_wf + "SELECT instrument, R6(avg(e * e)) AS mse, count(*) AS forecasts FROM e GROUP BY 1", "grid_1h"))
def _walk_forward(s, d):
    y = la.split_ratio(closes(s, d).withColumnRenamed("close", "y"), IRREGULAR)
    design = pr.block_lag_design(y, 1, 3, HOURLY)
    fits = fo.direct_h_ols(design, 1, where=F.col("split") == "train")
    return fo.walk_forward_mse(y, fits, lags=1, h=3, series=HOURLY)


_chunk = "SELECT instrument, time, close, ntile(4) OVER (PARTITION BY instrument ORDER BY time) AS chunk FROM grid_1h"


def chunked(s, d):
    return fo.series_chunks(closes(s, d), 4, IRREGULAR)


query("series_chunks", sql(f"c AS ({_chunk}) SELECT instrument, time, chunk::INTEGER AS chunk FROM c", "grid_1h"))(lambda s, d: cols(chunked(s, d), ["chunk"]))
query("dickey_fuller_stat", sql(
    f"c AS ({_chunk}), l AS (SELECT instrument, chunk, lag(close) OVER (PARTITION BY instrument, chunk ORDER BY time) AS x, close FROM c), "
    "g AS (SELECT instrument, chunk, count(x) AS n, regr_slope(close - x, x) AS b, regr_sxx(close - x, x) AS sxx, regr_syy(close - x, x) AS syy, regr_sxy(close - x, x) AS sxy FROM l WHERE x IS NOT NULL GROUP BY 1, 2) "
    "SELECT instrument, chunk::INTEGER AS chunk, n AS n_obs, R6(b) AS beta, R6(b / sqrt((syy - b * sxy) / (n - 2) / sxx)) AS df_stat FROM g", "grid_1h"))(
    lambda s, d: fo.dickey_fuller_stat(chunked(s, d), series=HOURLY))
_kp = " + ".join(f"{2 * (1 - k / 9)!r}::DOUBLE * coalesce(e * lag(e, {k}) OVER w, 0)" for k in range(1, 9))
query("kpss_stat", sql(
    f"c AS ({_chunk}), e AS (SELECT instrument, chunk, time, close - avg(close) OVER (PARTITION BY instrument, chunk) AS e FROM c), "
    f"p AS (SELECT instrument, chunk, sum(e) OVER w AS s, e * e + {_kp} AS v FROM e WINDOW w AS (PARTITION BY instrument, chunk ORDER BY time)) "
    "SELECT instrument, chunk::INTEGER AS chunk, count(*) AS n_obs, R6((sum(s * s) / (count(*) * count(*))) / (sum(v) / count(*))) AS kpss_stat FROM p GROUP BY 1, 2", "grid_1h"))(
    lambda s, d: fo.kpss_stat(chunked(s, d), series=HOURLY))

# --- boosted trees ------------------------------------------------------------------------------

GRID = {"maxDepth": [3, 6]}


def training(s, d):
    """All silver features of the hourly grid with both targets."""
    wide = silver_market(bars(s, d), HOURLY, gaps=False)
    lab = labelled(s, d).select("instrument", "time", F.col("target_pct_change").alias("target"), "target_classification")
    return wide.join(lab, ["instrument", "time"])


def feature_names(df):
    return [c for c in numeric_columns(df) if not c.startswith("target") and c not in ("train_from_fold", "test_fold")]


@query("fit_gbt")
def _fit(s, d):
    """Default rounds and depth on all features; the validation part ends boosting."""
    data = materialize(la.split_ratio(training(s, d), IRREGULAR), "train")
    names = feature_names(data)
    model = bo.fit_gbt(data.filter(F.col("split") == "train"), names, validation=data.filter(F.col("split") == "val"))
    return bo.feature_importance(model, names)


@query("score_batch")
def _score(s, d):
    data = materialize(la.split_ratio(training(s, d), IRREGULAR), "train")
    model = bo.fit_gbt(data.filter(F.col("split") == "train"), feature_names(data), "target_classification", "classification",
                       validation=data.filter(F.col("split") == "val"))
    return bo.score_batch(model, data, "classification").select(
        "instrument", "time", "split", "prediction", "probability_up", F.col("target_classification").alias("actual"))


def folds(s, d):
    return materialize(la.walk_forward_splits(training(s, d), IRREGULAR, 3), "folds")


@query("tune_grid_walk_forward")
def _tune(s, d):
    data = folds(s, d)
    return bo.tune_grid_walk_forward(data, feature_names(data), GRID, folds=3)


@query("two_stage_tuning")
def _two_stages(s, d):
    data = folds(s, d)
    return bo.two_stage_tuning(data, feature_names(data), GRID, folds=3)


@query("corr_feature_filter")
def _corr(s, d):
    data = materialize(training(s, d).withColumn("sma_copy", F.col("sma_7") * 2 + 1), "correlated")
    names = [*feature_names(data)]
    row = data.agg(*[F.abs(correlation(c, "target")).alias(c) for c in names])
    table_ = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in names])).alias("r")).select("r.*")
    return bo.corr_feature_filter(data, table_, 0.0)


@query("unit_root_test")
def _unit_root(s, d):
    return fo.unit_root_test(chunked(s, d), series=HOURLY)


# --- importance: parts by sold quantity stand in for features by importance -----------------------

cte("importance", "SELECT 'part_' || l_partkey AS feature, sum(l_quantity) AS importance FROM lineitem GROUP BY 1")
cte("cum", "SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank, sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) "
    "/ sum(importance) OVER () AS cum_share, count(*) OVER () AS n FROM importance", "importance")


def importance(s, d):
    return table(s, d, "lineitem", "l_partkey", "l_quantity").groupBy(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("feature")).agg(F.sum("l_quantity").alias("importance"))


_bin = "CASE " + " ".join(f"WHEN cum_share <= {im.EDGES[i + 1]} THEN {i}" for i in range(9)) + " END"
_lab = "CASE g.b " + " ".join(f"WHEN {i} THEN '{im.bin_label(i)}'" for i in range(9)) + " END"
query("importance_cum_bins", sql(
    f"b AS (SELECT *, {_bin} AS b FROM cum), s AS (SELECT b, sum(count(*)) OVER (ORDER BY b) AS size FROM b GROUP BY b), g AS (SELECT * FROM s WHERE size >= 3) "
    f"SELECT {_lab} AS \"group\", g.size::BIGINT AS group_size, feature, rank, R6(cum_share) AS cum_share FROM b JOIN g ON b.b <= g.b", "cum"))(
    lambda s, d: im.importance_cum_bins(importance(s, d)))
query("importance_knee", sql(
    "k AS (SELECT arg_max(rank, (cum_share - rank / n, -rank)) AS knee_rank FROM cum) SELECT feature, R6(importance) AS importance, rank, R6(cum_share) AS cum_share, knee_rank "
    "FROM cum, k WHERE rank <= knee_rank", "cum"))(lambda s, d: im.importance_knee(importance(s, d)))
query("top_importance", sql("SELECT feature, R6(importance) AS importance FROM importance ORDER BY importance.importance DESC, feature LIMIT 20", "importance"))(
    lambda s, d: im.top_importance(importance(s, d)))

# --- arithmetic on predictions ------------------------------------------------------------------

# Each event stands for a prediction: a relative change from its value, a probability from its id.
cte("preds", "SELECT event_id, ts AS timestamp, event_type AS instrument, value AS close, (value - 60) / 400 AS predicted_relative_change, "
    "((event_id * 37) % 101) / 100.0::DOUBLE AS probability FROM events")


def preds(s, d):
    e = table(s, d, "events", "event_id", "ts", "event_type", "value")
    return e.select("event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("instrument"), F.col("value").alias("close"),
                    ((F.col("value") - 60) / 400).alias("predicted_relative_change"), ((F.col("event_id") * 37) % 101 / 100.0).alias("probability"))


query("pct_to_price", sql(
    "SELECT event_id, R6(close * (1 + predicted_relative_change)) AS predicted_price, CASE WHEN predicted_relative_change > 0 THEN 'bullish' WHEN predicted_relative_change < 0 THEN 'bearish' ELSE 'neutral' END AS prediction, "
    "R6(least(abs(predicted_relative_change), 1)) AS confidence, R6(predicted_relative_change) AS signal_strength FROM preds", "preds"))(
    lambda s, d: sc.pct_to_price(preds(s, d)).select("event_id", "predicted_price", "prediction", "confidence", "signal_strength"))
query("class_to_signal", sql(
    "SELECT event_id, CASE WHEN probability > 0.5 THEN 'bullish' ELSE 'bearish' END AS prediction, R6(abs(probability - 0.5) * 2) AS confidence, R6((probability - 0.5) * 2) AS signal_strength FROM preds", "preds"))(
    lambda s, d: sc.class_to_signal(preds(s, d)).select("event_id", "prediction", "confidence", "signal_strength"))
query("confidence_band_label", sql(
    "SELECT event_id, CASE WHEN probability > 0.5 THEN 'UP' ELSE 'DOWN' END AS direction, R6(greatest(probability, 1 - probability)) AS top_probability, "
    "CASE WHEN greatest(probability, 1 - probability) > 0.7::DOUBLE THEN 'Strong' WHEN greatest(probability, 1 - probability) > 0.6::DOUBLE THEN 'Moderate' ELSE 'Weak' END AS strength FROM preds", "preds"))(
    lambda s, d: sc.confidence_band_label(preds(s, d)).select("event_id", "direction", "top_probability", "strength"))
query("feature_vector_align", sql(
    "x AS (SELECT instrument, time, CASE WHEN count(close) OVER w = 7 THEN avg(close) OVER w END AS sma_7 FROM grid_1h WINDOW w AS (PARTITION BY instrument ORDER BY time ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) "
    "SELECT instrument, time, R6(coalesce(sma_7, 0)) AS sma_7, R6(0) AS absent FROM x", "grid_1h"))(
    lambda s, d: sc.feature_vector_align(te.sma(hourly(s, d), HOURLY, periods=(7,)), ["sma_7", "absent"]))
_vol = "stddev_samp(ret) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("price_forecast_path", sql(
    "r AS (SELECT instrument, time, close, close / lag(close) OVER (PARTITION BY instrument ORDER BY time) - 1 AS ret FROM grid_1h), "
    f"v AS (SELECT *, {_vol} AS vol FROM r), l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY time DESC) = 1), "
    "p AS (SELECT *, unnest(generate_series(1, 12)) AS point FROM l) "
    "SELECT instrument, point::INTEGER AS point, time + to_minutes(point * 20) AS forecast_time, R6(close * (1 + 0.5 * vol * 2 * point / 12.0)) AS forecast_price, "
    "R6(close * (1 + 0.5 * vol * 2 * point / 12.0) + close * vol * sqrt(point / 12.0) * 2) AS upper_band, "
    "R6(close * (1 + 0.5 * vol * 2 * point / 12.0) - close * vol * sqrt(point / 12.0) * 2) AS lower_band FROM p", "grid_1h"))
def _path(s, d):
    wide = te.rolling_volatility(hourly(s, d), HOURLY, periods=(20,))
    last = wide.groupBy("instrument").agg(F.max_by(F.struct("time", "close", "volatility_20"), "time").alias("r")).select("instrument", "r.*")
    none = F.lit(None).cast("double")
    move = sc.expected_move(none, none, F.lit("UP"), none, F.col("close"), F.col("volatility_20"))
    return sc.price_forecast_path(last, move).select("instrument", "point", "forecast_time", "forecast_price", "upper_band", "lower_band")


_ss = "tanh((close * (1 + predicted_relative_change) - close) / greatest(abs(close), 1e-6))"
query("arima_sign_prob", sql(
    f"x AS (SELECT event_id, {_ss} AS k FROM preds) SELECT event_id, R6(k) AS signal_strength, R6(least(greatest(0.5 + k / 2, 0), 1)) AS probability, "
    "R6(abs(least(greatest(0.5 + k / 2, 0), 1) - 0.5) * 2) AS confidence FROM x", "preds"))(
    lambda s, d: sc.arima_sign_prob(preds(s, d).withColumn("predicted_close", F.col("close") * (1 + F.col("predicted_relative_change")))).select(
        "event_id", "signal_strength", "probability", "confidence"))
query("weighted_ensemble", sql(
    "x AS (SELECT event_id, probability AS a, ((event_id * 53) % 101) / 100.0 AS b, CASE WHEN event_id % 3 <> 0 THEN ((event_id * 71) % 101) / 100.0 END AS c FROM preds) "
    "SELECT event_id, R6((0.3 * a + 0.4 * b + coalesce(0.3 * c, 0)) / (0.7 + CASE WHEN c IS NOT NULL THEN 0.3 ELSE 0 END)) AS ensemble FROM x", "preds"))(
    lambda s, d: sc.weighted_ensemble(preds(s, d).select(
        "event_id", F.col("probability").alias("conservative"), ((F.col("event_id") * 53) % 101 / 100.0).alias("moderate"),
        F.when(F.col("event_id") % 3 != 0, (F.col("event_id") * 71) % 101 / 100.0).alias("aggressive"))).select("event_id", "ensemble"))

cte("scored_labels", "SELECT doc_id, quality AS label, ((doc_id * 37) % 101) / 100.0::DOUBLE AS score FROM labels WHERE quality IS NOT NULL")


def scored_labels(s, d):
    return table(s, d, "labels", "doc_id", "quality").filter(F.col("quality").isNotNull()).select(
        "doc_id", F.col("quality").alias("label"), ((F.col("doc_id") * 37) % 101 / 100.0).alias("score"))


query("threshold_search", sql(
    "t AS (SELECT 0.45::DOUBLE + i * (0.55::DOUBLE - 0.45::DOUBLE) / 99 AS threshold FROM range(100) r(i)), "
    "c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold) AS predicted, count(*) FILTER (label = 1) AS actual FROM t, scored_labels GROUP BY 1), "
    "f AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(predicted + actual, 0), 0) AS f1 FROM c), b AS (SELECT min(threshold) AS best FROM f WHERE f1 = (SELECT max(f1) FROM f)) "
    "SELECT R6(threshold) AS threshold, tp, predicted, actual, R6(f1) AS f1, (threshold = best)::INTEGER AS best FROM f, b", "scored_labels"))(
    lambda s, d: sc.threshold_search(scored_labels(s, d), "score"))
query("mean_threshold_model", "WITH m AS (SELECT avg(n_chars) AS t, avg(quality) AS p FROM labels JOIN documents USING (doc_id)) "
      "SELECT doc_id, R6(CASE WHEN n_chars >= t THEN round(p, 3) ELSE round(1 - p, 3) END) AS score FROM labels JOIN documents USING (doc_id), m")(
    lambda s, d: sc.mean_threshold_model(
        table(s, d, "labels", "doc_id", "quality").join(table(s, d, "documents", "doc_id", "n_chars"), "doc_id"), "n_chars", "quality").select("doc_id", "score"))

# --- evaluation ---------------------------------------------------------------------------------

# Forecast of the close 30 bars ahead by the current close, per part.
EVAL = (
    f"e AS (SELECT instrument, time, {_split} AS split, close AS prediction, lead(close, 30) OVER w AS actual FROM grid_1h WINDOW w AS (PARTITION BY instrument ORDER BY time)), "
    "v AS (SELECT * FROM e WHERE actual IS NOT NULL) "
)


def evaluated(s, d):
    h = la.future_close(hourly(s, d), HOURLY)
    split = la.split_ratio(h, IRREGULAR)
    return split.filter(F.col("future_close").isNotNull()).select(
        "instrument", "time", "split", F.col("close").alias("prediction"), F.col("future_close").alias("actual"))


query("regression_metrics", sql(
    EVAL + "SELECT split, R6(avg((prediction - actual) ** 2)) AS mse, R6(sqrt(avg((prediction - actual) ** 2))) AS rmse, R6(avg(abs(prediction - actual))) AS mae, "
    "R6(1 - avg((prediction - actual) ** 2) / var_pop(actual)) AS r2, count(*) AS rows FROM v GROUP BY 1", "grid_1h"))(
    lambda s, d: ev.regression_metrics(evaluated(s, d)))
query("mape", sql(EVAL + "SELECT split, R6(100 * avg(abs((actual - prediction) / actual)) FILTER (abs(actual) > 1e-8)) AS mape, count(*) FILTER (abs(actual) > 1e-8) AS rows FROM v GROUP BY 1", "grid_1h"))(
    lambda s, d: ev.mape(evaluated(s, d)))
CLS = "c AS (SELECT label AS actual, (score >= 0.5)::INTEGER AS prediction FROM scored_labels) "


def classes(s, d):
    return scored_labels(s, d).select(F.col("label").alias("actual"), (F.col("score") >= 0.5).cast("int").alias("prediction"))


query("accuracy", sql(CLS + "SELECT R6(avg((actual = prediction)::INTEGER)) AS accuracy, count(*) AS rows FROM c", "scored_labels"))(lambda s, d: ev.accuracy(classes(s, d)))
query("auc", sql(
    "p AS (SELECT p.score AS a, n.score AS b FROM scored_labels p, scored_labels n WHERE p.label = 1 AND n.label = 0) "
    "SELECT R6(avg(CASE WHEN a > b THEN 1 WHEN a = b THEN 0.5 ELSE 0 END)) AS auc, (SELECT count(*) FROM scored_labels WHERE label = 1) AS positives, "
    "(SELECT count(*) FROM scored_labels WHERE label = 0) AS negatives FROM p", "scored_labels"))(lambda s, d: ev.auc(scored_labels(s, d)))
query("confusion_matrix", sql(CLS + "SELECT actual, prediction, count(*) AS rows FROM c GROUP BY 1, 2", "scored_labels"))(lambda s, d: ev.confusion_matrix(classes(s, d)))
query("classification_report", sql(
    CLS + ", k AS (SELECT DISTINCT actual AS class FROM c), r AS (SELECT class, count(*) FILTER (actual = class AND prediction = class) AS tp, count(*) FILTER (actual = class) AS support, "
    "count(*) FILTER (prediction = class) AS guessed FROM k, c GROUP BY 1) SELECT class, R6(coalesce(tp / nullif(guessed, 0), 0)) AS precision, R6(coalesce(tp / nullif(support, 0), 0)) AS recall, "
    "R6(coalesce(2 * tp / nullif(guessed + support, 0), 0)) AS f1, support FROM r", "scored_labels"))(lambda s, d: ev.classification_report(classes(s, d)))
query("prediction_outcomes", sql(CLS + "SELECT prediction, (actual = prediction)::INTEGER AS correct, count(*) AS rows FROM c GROUP BY 1, 2", "scored_labels"))(
    lambda s, d: ev.prediction_outcomes(classes(s, d)))


def _metric_table(s, d, split):
    m = ev.regression_metrics(evaluated(s, d).filter(F.col("split") == split), ["instrument"])
    return m.select("instrument", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("mse", "mae")])).alias("r")).select("instrument", "r.*")


query("metric_diff", sql(
    EVAL + ", a AS (SELECT instrument, split, 'mse' AS metric, avg((prediction - actual) ** 2) AS value FROM v GROUP BY 1, 2 UNION ALL SELECT instrument, split, 'mae', avg(abs(prediction - actual)) FROM v GROUP BY 1, 2) "
    "SELECT x.instrument, x.metric, R6(x.value) AS v1, R6(y.value) AS v2, R6(y.value - x.value) AS diff, R6(coalesce(100 * (y.value - x.value) / nullif(x.value, 0), 0)) AS pct_change "
    "FROM a x JOIN a y ON x.instrument = y.instrument AND x.metric = y.metric WHERE x.split = 'val' AND y.split = 'test'", "grid_1h"))(
    lambda s, d: ev.metric_diff(_metric_table(s, d, "val"), _metric_table(s, d, "test"), ["instrument", "metric"]))
query("cv_summary", sql(
    EVAL + ", f AS (SELECT instrument, split, sqrt(avg((prediction - actual) ** 2)) AS score FROM v GROUP BY 1, 2) "
    "SELECT instrument, R6(avg(score)) AS cv_mean, R6(stddev_pop(score)) AS cv_std, count(*) AS folds FROM f GROUP BY 1", "grid_1h"))(
    lambda s, d: ev.cv_summary(ev.regression_metrics(evaluated(s, d), ["instrument", "split"]).withColumnRenamed("rmse", "score"), ["instrument"]))


def snapshot_sql() -> str:
    """The newest row from aggregates over the last n rows (r = 1 is the newest)."""
    def last(agg: str, n: int) -> str:
        """NULL unless all of the last n rows have a value, as in the rolling features."""
        x = agg[agg.index("(") + 1:-1]
        return f"(CASE WHEN count({x}) FILTER (r <= {n}) = {n} THEN {agg} FILTER (r <= {n}) END)"

    def ewm(x: str, span: int) -> str:
        w = f"power({1 - 2 / (span + 1)!r}, r - 1)"
        return f"sum({x} * {w}) / sum(CASE WHEN {x} IS NOT NULL THEN {w} END)"

    def at(x: str, k: int = 0) -> str:
        return f"max({x}) FILTER (r = {k + 1})"

    def pair(span: int) -> str:
        w = f"power({1 - 2 / (span + 1)!r}, b.r - a.r)"
        return f"sum(b.close * {w}) / sum({w})"

    c, v, e = at("close"), at("volume"), "1e-10::DOUBLE"
    root, k = "sqrt(252)", 0.34 / (1.34 + 21 / 19)
    std20, std50 = last("stddev_samp(ret)", 20), last("stddev_samp(ret)", 50)
    mid, dev = last("avg(close)", 20), last("stddev_samp(close)", 20)
    vwap = "(sum((high + low + close) / 3 * volume) / sum(volume))"
    q = f"{1 - 2 / 21!r}"
    s0, q0 = f"sum(CASE WHEN ret IS NOT NULL THEN power({q}, r - 1) END)", f"sum(CASE WHEN ret IS NOT NULL THEN power({q}, 2 * (r - 1)) END)"
    s1, s2 = f"sum(ret * power({q}, r - 1))", f"sum(ret * ret * power({q}, r - 1))"
    ratio = lambda a, b: f"({log_ratio(a, b)})"
    rs = last(f"avg({ratio('high', 'open')} * {ratio('high', 'close')} + {ratio('low', 'open')} * {ratio('low', 'close')})", 20)
    out = {
        **{f"return_{n}": f"{c} / nullif({at('close', n)}, 0) - 1" for n in (1, 5, 10)},
        **{f"rsi_{n}": f"100 - 100 / (1 + {last('avg(gain)', n)} / ({last('avg(loss)', n)} + {e}))" for n in (14, 20)},
        "macd": at("macd"), "macd_signal": ewm("macd", 9), "macd_histogram": f"{at('macd')} - {ewm('macd', 9)}",
        "bb_middle": mid, "bb_upper": f"{mid} + 2 * {dev}", "bb_lower": f"{mid} - 2 * {dev}", "bb_width": f"4 * {dev}",
        "bb_position": f"({c} - ({mid} - 2 * {dev})) / (4 * {dev} + {e})",
        **{f"sma_{n}": last("avg(close)", n) for n in (7, 14, 21, 50)}, **{f"ema_{n}": ewm("close", n) for n in (7, 14, 21)},
        "atr_14": last("avg(tr)", 14), "adx_14": last("avg(dx)", 14),
        **{f"momentum_{n}": f"{c} - {at('close', n)}" for n in (5, 10, 20)},
        **{f"roc_{n}": f"100 * ({c} / nullif({at('close', n)}, 0) - 1)" for n in (5, 10)},
        "volatility_20": std20, "volatility_50": std50, "hl_range": at("high - low"), "spread_proxy": at("high - low"),
        **{n: at("(high - low) / nullif(close, 0)") for n in ("hl_range_pct", "spread_pct", "realized_range")},
        "hl_range_ma20": last("avg(high - low)", 20), "realized_range_ma": last("avg((high - low) / nullif(close, 0))", 20),
        "volume_ma20": last("avg(volume)", 20), "volume_ma50": last("avg(volume)", 50),
        "volume_ratio": f"{v} / ({last('avg(volume)', 20)} + {e})",
        "volume_zscore": f"({v} - {last('avg(volume)', 20)}) / ({last('stddev_samp(volume)', 20)} + {e})",
        "price_impact": at(f"abs(ret) / (volume + {e})"), "price_impact_ma20": last(f"avg(abs(ret) / (volume + {e}))", 20),
        "illiquidity": at(f"abs(ret) / (volume + {e}) * 1e6"), "illiquidity_ma20": last(f"avg(abs(ret) / (volume + {e}) * 1e6)", 20),
        "order_flow_imbalance": at(f"(close - open) / (high - low + {e})"),
        "vwap": vwap, "close_vwap_ratio": f"{c} / nullif({vwap}, 0)", "volume_velocity": last("avg(dv)", 10), "volume_acceleration": last("avg(ddv)", 10),
        "hist_vol_20": f"{std20} * {root}", "hist_vol_50": f"{std50} * {root}",
        "gk_vol": f"sqrt(CASE WHEN {last('avg(gk)', 20)} >= 0 THEN {last('avg(gk)', 20)} END) * {root}",
        "parkinson_vol": f"sqrt({last(f"avg({ratio('high', 'low')} ** 2)", 20)} / (4 * ln(2))) * {root}", "rs_vol": f"sqrt({rs}) * {root}",
        "yz_vol": f"sqrt({last('var_samp(oc)', 20)} + {k!r} * {last(f"var_samp({ratio('close', 'open')})", 20)} + {1 - k!r} * {rs}) * {root}",
        "vol_of_vol": last("stddev_samp(v20)", 20),
        "ewma_vol": f"sqrt(greatest({s2} / {s0} - ({s1} / {s0}) ** 2, 0) * {s0} * {s0} / ({s0} * {s0} - {q0}))",
    }
    lag = "lag({}) OVER (PARTITION BY instrument ORDER BY time)"
    w = "(PARTITION BY instrument ORDER BY time ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    floats = ", ".join(f"R6({x}) AS {n}" for n, x in {**{p: at(p) for p in ("open", "high", "low", "close")}, **out}.items())
    return sql(
        "t AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY time DESC) AS r FROM grid_1h "
        "QUALIFY r <= 200 AND count(*) OVER (PARTITION BY instrument) >= 50), "
        f"x AS (SELECT *, close / nullif({lag.format('close')}, 0) - 1 AS ret, close - {lag.format('close')} AS delta, high - {lag.format('high')} AS up, {lag.format('low')} - low AS down, "
        f"greatest(high - low, abs(high - {lag.format('close')}), abs(low - {lag.format('close')})) AS tr, volume - {lag.format('volume')} AS dv, "
        f"{log_ratio('open', lag.format('close'))} AS oc, 0.5 * {ratio('high', 'low')} ** 2 - (2 * ln(2) - 1) * {ratio('close', 'open')} ** 2 AS gk FROM t), "
        "y AS (SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain, CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss, "
        "CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm, "
        f"dv - {lag.format('dv')} AS ddv, CASE WHEN count(ret) OVER {w.format(19)} = 20 THEN stddev_samp(ret) OVER {w.format(19)} END AS v20 FROM x), "
        f"z AS (SELECT *, 100 * avg(pdm) OVER {w.format(13)} / nullif(avg(tr) OVER {w.format(13)}, 0) AS pdi, 100 * avg(mdm) OVER {w.format(13)} / nullif(avg(tr) OVER {w.format(13)}, 0) AS mdi FROM y), "
        f"m AS (SELECT a.instrument, a.r, {pair(12)} - {pair(26)} AS macd FROM t a JOIN t b ON a.instrument = b.instrument AND b.r >= a.r GROUP BY 1, 2), "
        "f AS (SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + 1e-10::DOUBLE) AS dx FROM z JOIN m USING (instrument, r)) "
        f"SELECT instrument, max(time) AS time, {at('volume')} AS volume, {floats}, coalesce(({std20} < 0.8::DOUBLE * {std50})::INTEGER, 0) AS vol_regime_low, "
        f"coalesce(({std20} > 1.2::DOUBLE * {std50})::INTEGER, 0) AS vol_regime_high FROM f GROUP BY instrument", "grid_1h")


@query("snapshot_features", snapshot_sql())
def _snapshot(s, d):
    return sn.snapshot_features(hourly(s, d), HOURLY)
