"""Queries over drift, quality, run tables and streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as dr
from ..operators import quality as dq
from ..operators import runs as ru
from ..operators.asof import NEWS_VALUES
from ..operators.sentiment import lexicon_sentiment, sentiment_from_probs
from ..session import materialize, scratch_path
from ..streaming import core as st
from ..streaming import jobs as sj
from .catalog import cte, query, rnd, sql, table
from .gold_queries import VALUES, actionable, ts
from .inputs import NEGATIVE, POSITIVE, SIGNAL_FLOATS, SIGNAL_REST, bars, prediction_rows, ticks

AS_OF = "2024-01-31 00:00:00"
# Small windows and low thresholds so that the checks do fire on the test log.
CONFIG = dr.DriftConfig(0.001, 0.05, 0.02, 20, 15)


def as_of():
    return ts(AS_OF)


# --- drift --------------------------------------------------------------------------------------

cte("tail", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY timestamp DESC, event_id DESC) AS rn FROM pred_log) WHERE rn <= 40", "pred_log")


def alert_sql(kind, measure, thr, high, text, fall=False) -> str:
    change = "baseline - recent" if fall else "abs(baseline - recent)"
    return (
        f"SELECT '{kind}' AS type, CASE WHEN d > {thr * high!r}::DOUBLE THEN 'high' ELSE 'medium' END AS severity, R6(d) AS drift_value, R6(baseline) AS baseline, R6(recent) AS recent, "
        f"R6({thr}) AS threshold, printf('{text}: %.3f (baseline: %.3f, recent: %.3f)', d, baseline, recent) AS message, TIMESTAMP '{AS_OF}' AS timestamp "
        f"FROM (SELECT *, {change} AS d FROM (SELECT avg({measure}) FILTER (rn > 20) AS baseline, avg({measure}) FILTER (rn <= 20) AS recent, count(*) AS n FROM tail)) WHERE n >= 40 AND d > {thr}::DOUBLE"
    )


ALERTS = {
    "sentiment_drift": alert_sql("sentiment_drift", "avg_sentiment", 0.001, 2.0, "Sentiment drift detected"),
    "prediction_drift": alert_sql("prediction_drift", "(prediction = 'bullish')::INTEGER", 0.05, 1.5, "Prediction distribution drift detected"),
    "confidence_drop": alert_sql("confidence_drop", "confidence", 0.02, 1.5, "Model confidence drop detected", True),
}
for _k, _op in (("sentiment_drift", dr.sentiment_drift), ("prediction_drift", dr.prediction_drift), ("confidence_drop", dr.confidence_drop)):
    query(_k, sql(ALERTS[_k], "tail"))(lambda s, d, _op=_op: _op(prediction_rows(s, d), as_of(), CONFIG))


def alert_log(s, d):
    """Alerts raised earlier: one per instrument from its last event, five types in turn."""
    kinds = F.create_map(*[F.lit(x) for kv in zip(("click", "view", "error", "signup", "purchase"),
                                                    ("sentiment_drift", "prediction_drift", "confidence_drop", "other", "other")) for x in kv])
    last = ticks(s, d).groupBy("instrument").agg(F.max("time").alias("timestamp"))
    return last.select(kinds[F.col("instrument")].alias("type"), "timestamp")


cte("alert_log", "SELECT CASE event_type WHEN 'click' THEN 'sentiment_drift' WHEN 'view' THEN 'prediction_drift' WHEN 'error' THEN 'confidence_drop' ELSE 'other' END AS type, "
    "max(ts) AS timestamp FROM events GROUP BY event_type")


def all_alerts(s, d):
    parts = [f(prediction_rows(s, d), as_of(), CONFIG) for f in (dr.sentiment_drift, dr.prediction_drift, dr.confidence_drop)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_union = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in ALERTS.values())
_cool = f"a AS ({_union}) SELECT * FROM a WHERE type NOT IN (SELECT type FROM alert_log WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL {{m}} MINUTE)"
query("alert_cooldown", sql(_cool.replace("{m}", "10"), "tail", "alert_log"))(
    lambda s, d: dr.alert_cooldown(all_alerts(s, d), alert_log(s, d), as_of(), 10))
query("all_drifts", sql(_cool.replace("{m}", "15"), "tail", "alert_log"))(
    lambda s, d: dr.all_drifts(prediction_rows(s, d), alert_log(s, d), as_of(), CONFIG))

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUT = "1998-06-01 00:00:00"


def halves(s, d, *columns):
    li = table(s, d, "lineitem", *(columns or NUMS), "l_shipdate")
    cut = F.col("l_shipdate") < ts(CUT)
    return li.filter(cut).drop("l_shipdate"), li.filter(~cut).drop("l_shipdate")


def shifted(s, d):
    ref, cur = halves(s, d)
    return ref, cur.withColumn("l_discount", F.col("l_discount") + 0.01)


_long = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c if c != 'l_discount' else 'CASE WHEN NOT old THEN l_discount + 0.01::DOUBLE ELSE l_discount END'} AS value, old FROM h" for c in NUMS)
_p = " + ".join(f"{2.0 if k % 2 else -2.0}::DOUBLE * exp(-2.0::DOUBLE * {k * k} * lam * lam)" for k in range(1, 31))
KS = (
    f"h AS (SELECT *, l_shipdate < TIMESTAMP '{CUT}' AS old FROM lineitem), u AS ({_long}), "
    "g AS (SELECT feature, value, count(*) FILTER (old) AS r, count(*) FILTER (NOT old) AS c FROM u GROUP BY 1, 2), "
    "k AS (SELECT feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY feature) AS nr, sum(c) OVER (PARTITION BY feature) AS nc FROM g WINDOW w AS (PARTITION BY feature ORDER BY value)), "
    "m AS (SELECT feature, max(abs(cr::DOUBLE / nr - cc::DOUBLE / nc)) AS ks, max(nr)::BIGINT AS nr, max(nc)::BIGINT AS nc FROM k GROUP BY 1), "
    "l AS (SELECT *, ks * sqrt(nr::DOUBLE * nc / (nr + nc)) AS lam FROM m), "
    f"p AS (SELECT feature, ks, nr, nc, CASE WHEN lam < 0.3 THEN 1.0::DOUBLE ELSE least(greatest({_p}, 0), 1) END AS p FROM l) "
)
query("ks_drift", sql(KS + "SELECT feature, R6(ks) AS ks_stat, nr AS reference_rows, nc AS current_rows, R6(p) AS p_value, (p < 0.1)::INTEGER AS drifted FROM p"))(
    lambda s, d: dr.ks_drift(*shifted(s, d), NUMS))
query("dataset_drift", sql(KS + "SELECT sum((p < 0.1)::INTEGER)::BIGINT AS drifted_columns, count(*) AS columns, R6(avg((p < 0.1)::INTEGER)) AS drift_share, (avg((p < 0.1)::INTEGER) >= 0.5)::INTEGER AS dataset_drift FROM p"))(
    lambda s, d: dr.dataset_drift(dr.ks_drift(*shifted(s, d), NUMS)))

PERF = f"q AS (SELECT l_quantity * 1500 AS prediction, l_extendedprice AS actual, l_shipdate < TIMESTAMP '{CUT}' AS old FROM lineitem), " \
       "r AS (SELECT sqrt(avg((prediction - actual) ** 2) FILTER (old)) AS a, sqrt(avg((prediction - actual) ** 2) FILTER (NOT old)) AS b FROM q) "


def performance(s, d):
    li = table(s, d, "lineitem", "l_quantity", "l_extendedprice", "l_shipdate")
    return dr.performance_degradation(li.select(
        (F.col("l_quantity") * 1500).alias("prediction"), F.col("l_extendedprice").alias("actual"),
        F.when(F.col("l_shipdate") < ts(CUT), "reference").otherwise("current").alias("part")))


query("performance_degradation", sql(PERF + "SELECT R6(a) AS reference_rmse, R6(b) AS current_rmse, R6((b - a) / a) AS rmse_increase, ((b - a) / a > 0.2)::INTEGER AS degraded FROM r"))(performance)
MISS = (
    f"h AS (SELECT CASE WHEN l_quantity > 5 THEN l_quantity END AS a, CASE WHEN l_discount > 0.02 THEN l_discount END AS b, l_shipdate < TIMESTAMP '{CUT}' AS old FROM lineitem), "
    "m AS (SELECT sum((a IS NULL)::INTEGER + (b IS NULL)::INTEGER) FILTER (old) / (2.0::DOUBLE * count(*) FILTER (old)) AS x, "
    "sum((a IS NULL)::INTEGER + (b IS NULL)::INTEGER) FILTER (NOT old) / (2.0::DOUBLE * count(*) FILTER (NOT old)) AS y FROM h) "
)


def missing(s, d):
    ref, cur = (h.select(F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("a"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("b"))
                for h in halves(s, d))
    return dr.missing_value_drift(ref, cur)


query("missing_value_drift", sql(MISS + "SELECT R6(x) AS reference_missing, R6(y) AS current_missing, R6(y - x) AS missing_increase, (y > 0.05)::INTEGER AS missing_drift FROM m"))(missing)
query("overall_drift", sql(
    KS + ", " + PERF.strip() + ", " + MISS.replace("h AS (", "h2 AS (").replace("FROM h)", "FROM h2)").strip()
    + ", o AS (SELECT (SELECT (avg((p < 0.1)::INTEGER) >= 0.5)::INTEGER FROM p) AS dataset_drift, (SELECT ((b - a) / a > 0.2)::INTEGER FROM r) AS degraded, (SELECT (y > 0.05)::INTEGER FROM m2) AS missing_drift) "
    "SELECT *, greatest(dataset_drift, degraded, missing_drift) AS overall_drift FROM o".replace("FROM m2", "FROM mm")).replace("m AS (SELECT sum((a IS", "mm AS (SELECT sum((a IS"))(
    lambda s, d: dr.overall_drift(dr.dataset_drift(dr.ks_drift(*shifted(s, d), NUMS)), performance(s, d), missing(s, d)))

PARTS = ("x AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY timestamp, event_id) - 1 < floor(count(*) OVER () * 0.7::DOUBLE) THEN 'reference' ELSE 'current' END AS part, "
         "1.0 AS flat, CASE WHEN event_id < 3 THEN 1.0 END AS early FROM pred_log) ")
query("reference_current_split", sql(PARTS + "SELECT event_id, part FROM x", "pred_log"))(
    lambda s, d: dr.reference_current_split(prediction_rows(s, d)).select("event_id", "part"))
_feat = ("avg_sentiment", "flat", "early", "confidence", "predicted_price")
query("monitored_features", sql(
    PARTS + ", u AS (" + " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS feature, (count({c}) FILTER (part = 'current') > 0 AND count({c}) FILTER (part = 'reference') > 0 AND count(DISTINCT {c}) FILTER (part = 'current') > 1)::INTEGER AS usable FROM x"
        for i, c in enumerate(_feat)) + ") SELECT feature, usable, (usable = 1 AND sum(usable) OVER (ORDER BY i) <= 2)::INTEGER AS monitored FROM u", "pred_log"))(
    lambda s, d: dr.monitored_features(
        dr.reference_current_split(prediction_rows(s, d)).withColumns({"flat": F.lit(1.0), "early": F.when(F.col("event_id") < 3, 1.0)}), _feat, 2))
query("prediction_log_stats", sql(
    "SELECT instrument, count(*) AS predictions, min(timestamp) AS first_time, max(timestamp) AS last_time, count(*) FILTER (prediction = 'bullish') AS bullish, "
    "count(*) FILTER (prediction = 'bearish') AS bearish, R6(avg(confidence)) AS mean_confidence, R6(avg(predicted_price)) AS mean_price, R6(min(predicted_price)) AS min_price, "
    "R6(max(predicted_price)) AS max_price FROM pred_log GROUP BY 1", "pred_log"))(lambda s, d: dr.prediction_log_stats(prediction_rows(s, d), ["instrument"]))

# --- quality ------------------------------------------------------------------------------------

query("dq_bronze", sql(
    "SELECT count(*) AS rows, min(time) AS first_time, max(time) AS last_time, 'time,instrument,open,high,low,close,volume' AS columns, (count(*) >= 1000)::INTEGER AS passed FROM bars_1m", "bars_1m"))(
    lambda s, d: dq.dq_bronze(bars(s, d, "M1").select("time", "instrument", "open", "high", "low", "close", "volume")))
query("dq_gold_missing", "WITH h AS (SELECT l_orderkey, CASE WHEN l_quantity > 30 THEN l_quantity END AS a, CASE WHEN l_discount > 0.02 THEN l_discount END AS b FROM lineitem) "
      + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", R6(100.0 * (count(*) - count({c})) / count(*)) AS missing_pct, (100.0 * (count(*) - count({c})) / count(*) > 50)::INTEGER AS failed FROM h" for c in ("l_orderkey", "a", "b")))(
    lambda s, d: dq.dq_gold_missing(table(s, d, "lineitem").select(
        "l_orderkey", F.when(F.col("l_quantity") > 30, F.col("l_quantity")).alias("a"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("b"))))
query("dq_profile", "SELECT count(*) AS rows, 3 AS columns, min(ts) AS first_time, max(ts) AS last_time, count(*) FILTER (value <= 50) AS nulls FROM events")(
    lambda s, d: dq.dq_profile(table(s, d, "events").select(F.col("ts").alias("time"), "event_type", F.when(F.col("value") > 50, F.col("value")).alias("value"))))


def dq_events(s, d):
    e = table(s, d, "events", "event_id", "user_id", "value")
    return e.select(F.col("event_id").alias("row_id"), "user_id", (F.col("event_id") % 11).alias("feature_a"), (F.col("event_id") % 2).alias("label"))


query("dq_schema_range", "SELECT count(*) AS rows, 0::BIGINT AS out_of_range, 0::BIGINT AS bad_labels, '' AS reason, 1 AS passed FROM events")(
    lambda s, d: dq.dq_schema_range(dq_events(s, d)))
query("dq_schema_range_failing", "SELECT count(*) AS rows, count(*) FILTER (event_id % 11 > 9) AS out_of_range, 0::BIGINT AS bad_labels, 'feature_a out of range' AS reason, 0 AS passed FROM events")(
    lambda s, d: dq.dq_schema_range(dq_events(s, d), high=9))
query("dq_outlier_5sigma",
      "WITH w AS (SELECT o_orderkey, exp(o_totalprice / 10000) AS price, o_totalprice AS plain FROM orders), st AS (SELECT avg(price) AS m, stddev_samp(price) AS s, avg(plain) AS pm, stddev_samp(plain) AS ps FROM w) "
      "SELECT o_orderkey, 'price' AS feature, R6(price / 1e18) AS value, R6((price - m) / s) AS z FROM w, st WHERE abs(price - m) > 5 * s "
      "UNION ALL SELECT o_orderkey, 'plain', R6(plain / 1e18), R6((plain - pm) / ps) FROM w, st WHERE abs(plain - pm) > 5 * ps")(
    lambda s, d: dq.dq_outlier_5sigma(table(s, d, "orders").select(
        "o_orderkey", F.exp(F.col("o_totalprice") / 10000).alias("price"), F.col("o_totalprice").alias("plain")), ["price", "plain"], ["o_orderkey"]).withColumn(
        "value", F.col("value") / 1e18))
query("dq_duplicate_time", sql(
    "SELECT instrument, date_trunc('hour', time) AS time, R6(price) AS price, event_id FROM ticks QUALIFY row_number() OVER (PARTITION BY instrument, date_trunc('hour', time) ORDER BY event_id) = 1", "ticks"))(
    lambda s, d: dq.dq_duplicate_time(ticks(s, d).withColumn("time", F.date_trunc("hour", "time").cast("timestamp_ntz")), order=("event_id",)))
query("dq_freshness", sql(
    "SELECT instrument, max(time) AS newest_time, (max(time) < TIMESTAMP '2024-02-06 20:00:00' - INTERVAL 7 DAY)::INTEGER AS stale FROM ticks GROUP BY 1", "ticks"))(
    lambda s, d: dq.dq_freshness(ticks(s, d), ts("2024-02-06 20:00:00"), 7, ["instrument"]))
query("transform_filter", "SELECT event_id AS row_id, user_id, event_id % 11 AS feature_a, event_id % 2 AS label FROM events WHERE event_id % 11 >= 3")(
    lambda s, d: dq.transform_filter(dq_events(s, d)))
query("user_feature_mean", "SELECT user_id, R6(avg(event_id % 11)) AS feat_mean, arg_min(event_id % 2, event_id) AS label FROM events WHERE event_id % 11 >= 3 GROUP BY 1")(
    lambda s, d: dq.user_feature_mean(dq.transform_filter(dq_events(s, d))))

# --- run tables: each customer stands for a training run ------------------------------------------

_R = {
    "run_id": "c_custkey", "model_type": "c_mktsegment", "experiment": "CASE WHEN c_nationkey < 12 THEN 'first' ELSE 'second' END",
    "status": "CASE WHEN c_custkey % 10 = 0 THEN 'FAILED' ELSE 'FINISHED' END",
    "oot_auc": "CASE WHEN c_nationkey <> 3 THEN 0.48 + ((c_custkey * 11) % 180) / 1000.0 END",
    "test_auc": "0.47 + ((c_custkey * 7) % 190) / 1000.0", "train_auc": "0.5 + ((c_custkey * 13) % 300) / 1000.0",
    "oot_rmse": "0.1 + ((c_custkey * 17) % 50) / 1000.0", "test_rmse": "0.1 + ((c_custkey * 29) % 60) / 1000.0",
    "created_at": "(c_custkey * 31) % 1009",
}
cte("runs", "SELECT " + ", ".join(f"({e.replace('1000.0', '1000.0::DOUBLE').replace('0.48', '0.48::DOUBLE').replace('0.47', '0.47::DOUBLE').replace('0.5 ', '0.5::DOUBLE ').replace('0.1 ', '0.1::DOUBLE ')}) AS {n}" for n, e in _R.items()) + " FROM customer")
AUCS = ("oot_auc", "test_auc", "train_auc", "oot_rmse", "test_rmse")
RUN_SQL = f"run_id, model_type, experiment, status, created_at, {rnd(*AUCS)}"


def runs(s, d):
    c = table(s, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    doubles = {n: e.replace("1000.0", "1000D").replace("0.48", "0.48D").replace("0.47", "0.47D").replace("0.5 ", "0.5D ").replace("0.1 ", "0.1D ") for n, e in _R.items()}
    return c.select(*[F.expr(e).alias(n) for n, e in doubles.items()])


query("health_check", sql(
    f"x AS (SELECT *, train_auc - test_auc AS overfitting, (coalesce(oot_auc, 0) >= 0.5::DOUBLE)::INTEGER AS auc_ok, (train_auc - test_auc <= 0.3::DOUBLE)::INTEGER AS overfit_ok, (oot_rmse < 1.2::DOUBLE * test_rmse)::INTEGER AS rmse_ok FROM runs) "
    f"SELECT {RUN_SQL}, R6(overfitting) AS overfitting, auc_ok, overfit_ok, rmse_ok, auc_ok * overfit_ok * rmse_ok AS healthy FROM x", "runs"))(lambda s, d: dq.health_check(runs(s, d)))
query("best_by_test_rmse", sql(
    f"n AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY created_at DESC, run_id DESC) = 1) SELECT {RUN_SQL} FROM n ORDER BY n.test_rmse, model_type LIMIT 1", "runs"))(
    lambda s, d: ru.best_by_test_rmse(runs(s, d)))
_q = "oot_auc >= {t}::DOUBLE AND test_auc >= {t}::DOUBLE AND train_auc - test_auc < {o}::DOUBLE"
query("select_qualified_run", sql(
    f"q AS (SELECT *, train_auc - test_auc AS overfitting FROM runs WHERE {_q.format(t=0.55, o=0.1)}) SELECT {RUN_SQL}, R6(overfitting) AS overfitting FROM q ORDER BY q.oot_auc DESC, run_id LIMIT 1", "runs"))(
    lambda s, d: ru.select_qualified_run(runs(s, d)))
query("multi_experiment_select", sql(
    f"q AS (SELECT *, train_auc - test_auc AS overfitting FROM runs WHERE status = 'FINISHED' AND {_q.format(t=0.5, o=0.15)}) SELECT {RUN_SQL}, R6(overfitting) AS overfitting FROM q ORDER BY q.oot_auc DESC, run_id LIMIT 1", "runs"))(
    lambda s, d: ru.multi_experiment_select([runs(s, d).filter(F.col("experiment") == e) for e in ("first", "second")]))
query("best_per_type", sql(
    f"q AS (SELECT * FROM runs WHERE oot_auc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY oot_auc DESC, run_id) = 1) SELECT {RUN_SQL} FROM q", "runs"))(
    lambda s, d: ru.best_per_type(runs(s, d)))
query("top_n_runs", sql(f"SELECT {RUN_SQL} FROM runs WHERE runs.oot_auc IS NOT NULL ORDER BY runs.oot_auc DESC, run_id LIMIT 10", "runs"))(lambda s, d: ru.top_n_runs(runs(s, d), 10))
_stage = "CASE run_id % 4 WHEN 0 THEN 'Production' WHEN 1 THEN 'Staging' WHEN 2 THEN 'Archived' ELSE 'None' END"


def versions(s, d):
    return runs(s, d).select(F.col("model_type").alias("name"), F.expr(_stage).alias("stage"), F.col("run_id").alias("version"), "test_rmse")


query("latest_per_stage", sql(
    f"v AS (SELECT model_type AS name, {_stage} AS stage, run_id AS version, test_rmse FROM runs) SELECT name, stage, version, R6(test_rmse) AS test_rmse FROM v "
    "QUALIFY row_number() OVER (PARTITION BY name, stage ORDER BY version DESC) = 1", "runs"))(lambda s, d: ru.latest_per_stage(versions(s, d)))
query("all_versions", sql(f"v AS (SELECT model_type AS name, {_stage} AS stage, run_id AS version, test_rmse FROM runs) SELECT name, stage, version, R6(test_rmse) AS test_rmse FROM v", "runs"))(
    lambda s, d: ru.all_versions(versions(s, d)))
query("prediction_history_hourly", sql(
    "h AS (SELECT TIMESTAMP '2024-01-20 12:30:00' - to_hours(24 - i) AS time FROM range(24) r(i)), "
    "p AS (SELECT h.time, arg_max(l.prediction, l.timestamp) AS prediction, arg_max(l.confidence, l.timestamp) AS confidence FROM h LEFT JOIN pred_log l ON l.instrument = 'click' AND l.timestamp >= h.time AND l.timestamp < h.time + INTERVAL 1 HOUR GROUP BY 1) "
    "SELECT time, coalesce(prediction, 'neutral') AS prediction, R6(coalesce(confidence / 2, 0.5)) AS probability, R6(coalesce(confidence, 0.5)) AS confidence FROM p", "pred_log"))(
    lambda s, d: ru.prediction_history_hourly(prediction_rows(s, d).withColumn("probability", F.col("confidence") / 2), ts("2024-01-20 12:30:00"), "click"))
query("history_cap", sql("SELECT event_id, timestamp, prediction FROM pred_log ORDER BY timestamp DESC, event_id DESC LIMIT 100", "pred_log"))(
    lambda s, d: ru.history_cap(prediction_rows(s, d)).select("event_id", "timestamp", "prediction"))

# --- streams: the same tables read as file streams ------------------------------------------------


def tick_stream(s, d):
    raw = st.table_stream(s, f"{d}/events.parquet", table(s, d, "events").schema)
    return raw.select(F.col("event_type").alias("instrument"), F.col("ts").alias("time"), F.col("value").alias("price"), "event_id")


def article_stream(s, d):
    raw = st.table_stream(s, f"{d}/documents.parquet", table(s, d, "documents").schema)
    minute = F.make_dt_interval(mins=((F.col("doc_id") * 43) % 43_200).cast("int"))
    return raw.select(
        F.col("doc_id").alias("article_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"),
        F.col("text").alias("body"), "source", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minute).alias("published_at"))


def score(df):
    s = F.col("_s")
    base = lexicon_sentiment(df, "body", POSITIVE, NEGATIVE, "_s")
    return sentiment_from_probs(base.withColumns({
        "positive_prob": F.greatest(s, F.lit(0.0)), "negative_prob": F.greatest(-s, F.lit(0.0)), "neutral_prob": 1.0 - F.abs(s)}).drop("_s", "body"))


# In append mode a window is written once the watermark (newest time less ten minutes) has passed its end.
query("stream_bars", sql(
    f"SELECT instrument, time, {rnd('open', 'high', 'low', 'close')}, volume FROM bars_1h WHERE time + INTERVAL 1 HOUR <= (SELECT max(time) FROM ticks) - INTERVAL 10 MINUTE", "bars_1h"))(
    lambda s, d: st.drain(sj.stream_bars(tick_stream(s, d), "1 hour"), "bars"))
query("stream_news_signals", sql(
    f"SELECT {rnd(*SIGNAL_FLOATS)}, {', '.join(SIGNAL_REST)} FROM signals_15m WHERE signal_time + INTERVAL 15 MINUTE <= (SELECT max(published_at) FROM scored) - INTERVAL 10 MINUTE", "signals_15m"))(
    lambda s, d: st.drain(sj.stream_news_signals(score(article_stream(s, d))), "signals"))
query("stream_recent_lookback", sql(
    "w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 15 minute, published_at, TIMESTAMP '2000-01-01') + INTERVAL 15 MINUTE, "
    "time_bucket(INTERVAL 15 minute, published_at, TIMESTAMP '2000-01-01') + INTERVAL 6 HOUR, INTERVAL 15 MINUTE)) AS as_of, sentiment_score AS x FROM scored) "
    "SELECT as_of, R6(avg(x)) AS news_avg_sentiment, R6(abs(avg(x))) AS news_signal_strength, count(*) AS news_article_count FROM w "
    "WHERE as_of <= (SELECT max(published_at) FROM scored) - INTERVAL 10 MINUTE GROUP BY 1", "scored"))(
    lambda s, d: st.drain(sj.stream_recent_lookback(score(article_stream(s, d))), "lookback"))
query("stream_dedup", "SELECT DISTINCT md5(text) AS article_id FROM documents")(
    lambda s, d: st.drain(sj.stream_dedup(article_stream(s, d).select(F.md5("body").alias("article_id"), "published_at")).select("article_id"), "dedup"))
query("stream_session_gaps", sql(
    "g AS (SELECT *, CASE WHEN lag(time) OVER w IS NULL OR time >= lag(time) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM ticks WINDOW w AS (PARTITION BY instrument ORDER BY time)), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY instrument ORDER BY time) AS sid FROM g) SELECT instrument, min(time) AS session_start, max(time) + INTERVAL 30 MINUTE AS session_end, count(*) AS ticks "
    "FROM s GROUP BY instrument, sid HAVING max(time) + INTERVAL 30 MINUTE <= (SELECT max(time) FROM ticks) - INTERVAL 10 MINUTE", "ticks"))(
    lambda s, d: st.drain(sj.stream_session_gaps(tick_stream(s, d)), "sessions"))


@query("stream_new_file_trigger", sql(
    "SELECT s.article_id, split_part(d.text, chr(10), 1) AS headline, s.source, s.published_at, s.sentiment, R6(s.sentiment_score) AS sentiment_score, R6(s.confidence) AS confidence, "
    "R6(s.positive_prob) AS positive_prob, R6(s.negative_prob) AS negative_prob, R6(s.neutral_prob) AS neutral_prob FROM scored s JOIN documents d ON d.doc_id = s.article_id", "scored"))
def _trigger(s, d):
    path = scratch_path(s, "scored")
    sj.stream_new_file_trigger(article_stream(s, d), score, path)
    return s.read.parquet(path).drop("batch")


_zero = ", ".join(f"R6(CASE WHEN st IS NULL THEN 0 ELSE {x} END) AS {n}" for n, x in VALUES.items())


@query("stream_asof", sql(
    "m AS (SELECT t.instrument, t.time, t.event_id, CASE WHEN s.signal_time >= t.time - INTERVAL 2 HOUR THEN s.signal_time END AS st, s.avg_sentiment AS a, s.signal_strength AS b, s.trading_signal AS c, "
    "s.article_count AS e, s.quality_score AS q FROM ticks t ASOF LEFT JOIN actionable s ON t.time >= s.signal_time) "
    f"SELECT instrument, time, event_id, {_zero}, R6((epoch_us(time) - epoch_us(st)) / 60000000.0) AS news_age_minutes, (st IS NOT NULL)::INTEGER AS news_available FROM m", "ticks", "actionable"))
def _stream_asof(s, d):
    path = scratch_path(s, "enriched")
    sj.stream_asof(tick_stream(s, d).drop("price"), actionable(s, d).select("signal_time", *NEWS_VALUES), path)
    return s.read.parquet(path).drop("batch")


@query("stream_interval_join", sql(
    "SELECT t.event_id, s.signal_time, s.trading_signal FROM ticks t JOIN actionable s ON s.signal_time <= t.time AND s.signal_time >= t.time - INTERVAL 2 HOUR", "ticks", "actionable"))
def _interval_join(s, d):
    """Both sides as streams: ticks, and the signal table from files."""
    path = scratch_path(s, "signal-files")
    sig = actionable(s, d).select("signal_time", "trading_signal")
    sig.write.parquet(path)
    right = st.read_stream(s, path, sig.schema)
    out = sj.stream_interval_join(tick_stream(s, d), right).select(
        "event_id", F.col("signal_time").cast("timestamp_ntz").alias("signal_time"), "trading_signal")
    return st.drain(out, "pairs")


SLICES = 4


def time_slices(df, time, n=SLICES):
    """The rows in n parts of equal spans of time, in order."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return [df.limit(0)] * n
    slice_no = F.least(F.floor((at - F.lit(lo)) * n / F.lit(max(hi - lo, 1))), F.lit(n - 1))
    return [df.filter(slice_no == k) for k in range(n)]


def arrive(sources, run):
    """Write the k-th slice of every source (folder to slices) and run the stream over what is there.

    A slice is one micro-batch, however many files its tasks write: rows of one span of time must not be
    taken apart, or the watermark of the first files passes the rows of the others.
    """
    for parts in zip(*sources.values()):
        for folder, part in zip(sources, parts):
            part.write.mode("append").parquet(folder)
        out = run()
    return out


_kinds = " UNION ALL ".join(
    f"SELECT instrument, ts, event_id, '{kind}' AS type, b{m} AS baseline, r{m} AS recent, {change.format(m=m)} AS d, {thr}::DOUBLE AS threshold, {thr * high!r}::DOUBLE AS severe FROM w WHERE n = 40"
    for m, (kind, thr, high, change) in enumerate((("sentiment_drift", 0.152, 2.0, "abs(b{m} - r{m})"), ("prediction_drift", 0.22, 1.5, "abs(b{m} - r{m})"), ("confidence_drop", 0.1, 1.5, "b{m} - r{m}"))))
_means = ", ".join(f"avg(m{m}) OVER ({_w} ROWS BETWEEN {a} PRECEDING AND {b}) AS {side}{m}" for m in range(3)
                   for _w in ["PARTITION BY instrument ORDER BY ts, event_id"] for side, a, b in (("b", 39, "20 PRECEDING"), ("r", 19, "CURRENT ROW")))


@query("stream_drift_alerts",
       "WITH p AS (SELECT event_type AS instrument, ts, event_id, ((event_id % 21) - 10) / 10.0 AS m0, (value > 50)::INTEGER AS m1, least(value / 200, 1.0) AS m2 FROM events), "
       f"w AS (SELECT *, {_means}, count(*) OVER (PARTITION BY instrument ORDER BY ts, event_id ROWS 39 PRECEDING) AS n FROM p), c AS (SELECT * FROM ({_kinds}) WHERE d > threshold "
       "AND ts <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE), k AS (SELECT instrument, type, unnest(kept) AS us FROM (SELECT instrument, type, list_reduce(list([epoch_us(ts)] ORDER BY ts, event_id), "
       "lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 36000000000 THEN list_concat(acc, x) ELSE acc END) AS kept FROM c GROUP BY instrument, type)) "
       "SELECT instrument, type, CASE WHEN d > severe THEN 'high' ELSE 'medium' END AS severity, R6(d) AS drift_value, R6(baseline) AS baseline, R6(recent) AS recent, R6(threshold) AS threshold, "
       "ts AS timestamp, event_id FROM c JOIN k USING (instrument, type) WHERE epoch_us(ts) = us")
def _alerts(s, d):
    """Four micro-batches of the log; state per instrument, ten hours of cooldown."""
    events = table(s, d, "events")
    folder, path, state = (scratch_path(s, n) for n in ("log-files", "alerts", "alerts-state"))
    raw = st.table_stream(s, folder, events.schema)
    log = raw.select("event_id", F.col("event_type").alias("instrument"), F.col("ts").alias("timestamp"), F.when(F.col("value") > 50, "bullish").otherwise("bearish").alias("prediction"),
                     F.least(F.col("value") / 200, F.lit(1.0)).alias("confidence"), (((F.col("event_id") % 21) - 10) / 10.0).alias("avg_sentiment"))
    found = sj.stream_drift_alerts(log, dr.DriftConfig(0.152, 0.22, 0.1, 20, 600))
    return arrive({folder: time_slices(events, "ts")}, lambda: st.drain(found, "alerts", path, state, keyed=True)).drop("message")


@query("stream_asof_newest", sql(
    "m AS (SELECT t.instrument, t.time, t.event_id, s.signal_time, s.trading_signal, s.avg_sentiment FROM ticks t ASOF LEFT JOIN actionable s ON t.time >= s.signal_time "
    "WHERE t.time <= least((SELECT max(time) FROM ticks), (SELECT max(signal_time) FROM actionable)) - INTERVAL 10 MINUTE) SELECT instrument, time, event_id, "
    + ", ".join(f"CASE WHEN signal_time >= time - INTERVAL 2 HOUR THEN {x} END AS {n}" for x, n in (("signal_time", "news_signal_time"), ("trading_signal", "news_trading_signal"), ("R6(avg_sentiment)", "news_avg_sentiment")))
    + " FROM m", "ticks", "actionable"))
def _asof_newest(s, d):
    """Both sides as streams in several micro-batches."""
    bars = ticks(s, d).select("instrument", "time", "event_id")
    sig = materialize(actionable(s, d).select("signal_time", "trading_signal", "avg_sentiment"), "signals")
    bar_files, signal_files, path, state = (scratch_path(s, n) for n in ("bar-files", "signal-files", "newest", "newest-state"))
    left, right = st.table_stream(s, bar_files, bars.schema), st.table_stream(s, signal_files, sig.schema)
    found = sj.stream_asof_newest(left, right, quiet=sig.isEmpty())
    return arrive({bar_files: time_slices(bars, "time"), signal_files: time_slices(sig, "signal_time")}, lambda: st.drain(found, "newest", path, state, keyed=True))


@query("stream_latest_features", sql(
    "SELECT instrument, time AS event_timestamp, R6(price) AS price FROM ticks QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY time DESC, price DESC) = 1", "ticks"))
def _latest(s, d):
    rows = ticks(s, d).select("instrument", F.col("time").alias("event_timestamp"), "price")
    folder, path, state = (scratch_path(s, n) for n in ("feature-files", "latest", "latest-state"))
    stream = st.table_stream(s, folder, rows.schema)
    return arrive({folder: time_slices(rows, "event_timestamp")}, lambda: sj.stream_latest_features(stream, path, checkpoint=state))
