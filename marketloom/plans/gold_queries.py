"""Queries over sources, joins, labels, splits and preparation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.series import Series
from ..operators import asof as ao
from ..operators import joins as jo
from ..operators import labels as la
from ..operators import microstructure as mi
from ..operators import prep as pr
from ..operators import technical as te
from ..operators import volatility as vo
from ..schemas import ARTICLE
from ..session import scratch_path
from ..sources import articles as ar
from ..sources import candles as ca
from ..sources import predictions as pl
from ..sources import tables as tb
from .catalog import cols, cte, lag, query, rnd, roll, sql, table
from .inputs import HOURLY, SIGNAL_FLOATS, SIGNAL_REST, articles, bars, hourly, prediction_rows, signals

IRREGULAR = Series(step=None)
SIGNAL_SQL = f"{rnd(*SIGNAL_FLOATS)}, {', '.join(SIGNAL_REST)}"
OHLC_SQL = f"instrument, time, {rnd('open', 'high', 'low', 'close')}, volume"


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- sources and sinks --------------------------------------------------------------------------


@query("read_candles_ndjson", sql(f"SELECT {OHLC_SQL} FROM bars_1h", "bars_1h"))
def _read_candles(s, d):
    """Candles written as lines, one broken line per instrument and day, read back."""
    path = scratch_path(s, "candles")
    lines = bars(s, d).select(F.to_json(F.struct(
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), "instrument", F.lit("H1").alias("granularity"),
        "open", "high", "low", "close", "volume")).alias("value"), F.hour("time").alias("h"))
    broken = lines.filter(F.col("h") == 0).select(F.substring("value", 1, 40).alias("value"))
    lines.select("value").unionByName(broken).write.text(path)
    return ca.read_candles_ndjson(s, path).select("instrument", "time", "open", "high", "low", "close", "volume")


@query("flatten_broker_payload", sql(f"SELECT {OHLC_SQL}, 'H1' AS granularity FROM bars_1h WHERE volume > 1", "bars_1h"))
def _flatten(s, d):
    """Nested payloads per instrument and day (at most 24 candles each)."""
    candle = F.struct(
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), (F.col("volume") > 1).alias("complete"), "volume",
        F.struct(*[F.col(c).cast("string").alias(k) for k, c in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))]).alias("mid"),
    )
    payload = bars(s, d).groupBy("instrument", F.to_date("time").alias("day")).agg(
        F.to_json(F.struct(F.collect_list(candle).alias("candles"))).alias("payload"))
    return ca.flatten_broker_payload(payload.drop("day"), granularity="H1")


def _article_files(s, d) -> str:
    path = scratch_path(s, "articles")
    rows = articles(s, d).withColumns(
        {"article_id": F.col("article_id").cast("string"), "published_at": F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    known = [c for c in ARTICLE.fieldNames() if c in rows.columns]
    rows.select(*known).write.json(path)
    return path


@query("read_articles_json", sql("SELECT article_id::VARCHAR AS article_id, headline, source, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at FROM articles", "articles"))
def _read_articles(s, d):
    return ar.read_articles_json(s, _article_files(s, d), one_per_file=False).select("article_id", "headline", "source", "published_at")


@query("build_manifest")
def _manifest(s, d):
    return ar.build_manifest(ar.read_articles_json(s, _article_files(s, d), one_per_file=False)).drop("file_path", "file_size_bytes")


AUTO = "event_id BIGINT, event_type STRING, value DOUBLE"


@query("read_table_auto", f"SELECT event_id, event_type, R6(value) AS value, k AS kind FROM events, (VALUES ('parquet'), ('csv')) t(k)")
def _read_auto(s, d):
    rows = table(s, d, "events", "event_id", "event_type", "value")
    base = scratch_path(s, "auto")
    out = []
    for kind in ("parquet", "csv"):
        tb.write_table_auto(rows, f"{base}.{kind}")
        out.append(tb.read_table_auto(s, f"{base}.{kind}", AUTO).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


@query("write_table_auto", sql(f"SELECT {SIGNAL_SQL} FROM signals_60m", "signals_60m"))
def _write_auto(s, d):
    path = scratch_path(s, "signals") + ".csv"
    rows = signals(s, d)
    tb.write_table_auto(rows, path)
    return tb.read_table_auto(s, path, rows.schema)


@query("write_gold_dual", sql(f"SELECT {OHLC_SQL}, time AS event_timestamp, time::DATE AS date FROM bars_1h", "bars_1h"))
def _gold_dual(s, d):
    base = scratch_path(s, "gold")
    tb.write_gold_dual(bars(s, d), base)
    return s.read.parquet(base + ".parquet").withColumn("instrument", F.col("instrument").cast("string"))


@query("append_prediction_log", sql(
    "SELECT date_trunc('millisecond', timestamp) AS timestamp, instrument, prediction, R6(confidence) AS confidence, R6(predicted_price) AS predicted_price "
    "FROM pred_log WHERE prediction IN ('bullish', 'bearish')", "pred_log"))
def _append_log(s, d):
    path = scratch_path(s, "log")
    rows = prediction_rows(s, d)
    pl.append_prediction_log(rows.filter(F.col("prediction") == "bullish"), path)
    pl.append_prediction_log(rows.filter(F.col("prediction") == "bearish"), path)
    return pl.read_prediction_log(s, path).select("timestamp", "instrument", "prediction", "confidence", "predicted_price")


@query("read_prediction_log", sql(
    "SELECT date_trunc('second', timestamp) AS timestamp, instrument, prediction, R6(confidence) AS confidence, R6(avg_sentiment) AS avg_sentiment, "
    "R6(predicted_price) AS predicted_price FROM pred_log", "pred_log"))
def _read_log(s, d):
    """Lines with one-element lists, broken lines and unreadable numbers."""
    path = scratch_path(s, "log")
    rows = prediction_rows(s, d)
    line = F.to_json(F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "instrument", "prediction", "confidence",
        F.array("avg_sentiment").alias("avg_sentiment"), F.lit("n/a").alias("rsi_14"), "predicted_price"))
    text = rows.select(F.explode(F.when(F.hour("timestamp") == 0, F.array(line, F.substring(line, 1, 30))).otherwise(F.array(line))).alias("value"))
    text.write.text(path)
    return pl.read_prediction_log(s, path).select("timestamp", "instrument", "prediction", "confidence", "avg_sentiment", "predicted_price")


query(
    "resume_from_watermark",
    sql(
        f"l AS (SELECT instrument, max(time) AS m FROM bars_1h WHERE time < TIMESTAMP '2024-01-20' AND instrument <> 'view' GROUP BY 1) "
        f"SELECT {OHLC_SQL} FROM bars_1h LEFT JOIN l USING (instrument) WHERE m IS NULL OR time >= m + INTERVAL 1 MINUTE",
        "bars_1h",
    ),
)(
    lambda s, d: tb.resume_from_watermark(
        bars(s, d), bars(s, d).filter((F.col("time") < ts("2024-01-20")) & (F.col("instrument") != "view"))
    )
)


@query("incremental_upsert", sql(
    "e AS (SELECT article_id, published_at, 'old' AS run FROM articles WHERE language = 'en'), "
    "i AS (SELECT article_id, published_at, 'new' AS run FROM articles WHERE article_id NOT IN (SELECT article_id FROM e) "
    "UNION ALL SELECT article_id, published_at + INTERVAL 1 MINUTE, 'again' FROM articles WHERE language = 'fr') "
    "SELECT article_id, published_at, run FROM (SELECT * FROM e UNION ALL SELECT * FROM i) "
    "QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY published_at DESC) = 1", "articles"))
def _upsert(s, d):
    a = articles(s, d).select("article_id", "published_at", "language")
    old = a.filter(F.col("language") == "en").drop("language").withColumn("run", F.lit("old"))
    again = a.filter(F.col("language") == "fr").drop("language").withColumns(
        {"published_at": F.col("published_at") + F.expr("INTERVAL 1 MINUTE"), "run": F.lit("again")})
    return tb.incremental_upsert(old, a.drop("language").withColumn("run", F.lit("new")).unionByName(again))


query(
    "export_online_features",
    sql(
        f"SELECT signal_time AS event_timestamp, 'SPX500_USD' AS instrument, {rnd('avg_sentiment', 'signal_strength', 'quality_score')}, trading_signal, article_count "
        "FROM signals_15m WHERE signal_time BETWEEN TIMESTAMP '2024-01-15 11:00:00' AND TIMESTAMP '2024-01-15 12:00:00'",
        "signals_15m",
    ),
)(lambda s, d: tb.export_online_features(signals(s, d, 15), ts("2024-01-15 12:00:00"), "SPX500_USD"))
for _k, _days, _op in (("latest_features_by_key", 1, tb.latest_features_by_key), ("materialize_window", 30, tb.materialize_window)):
    query(
        _k,
        sql(
            f"SELECT instrument, time AS event_timestamp, {rnd('open', 'high', 'low', 'close')}, volume FROM bars_1h "
            f"WHERE time <= TIMESTAMP '2024-01-18 12:30:00' AND time > TIMESTAMP '2024-01-18 12:30:00' - INTERVAL {_days} DAY "
            "QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY time DESC) = 1",
            "bars_1h",
        ),
    )(lambda s, d, _op=_op: _op(bars(s, d).withColumnRenamed("time", "event_timestamp"), ts("2024-01-18 12:30:00")))

# --- joins --------------------------------------------------------------------------------------

_hl = "high - low AS hl_range, (high - low) / nullif(close, 0) AS hl_range_pct"


@query("merge_silver", sql(
    f"f AS (SELECT *, {roll('avg', 'close', 7)} AS sma_7, {_hl}, {roll('avg', '(high - low)', 20)} AS hl_range_ma20, "
    f"{roll('avg', '((high - low) / nullif(close, 0))', 20)} AS realized_range_ma FROM grid_1h) SELECT instrument, time, "
    f"{rnd('open', 'high', 'low', 'close', 'sma_7', 'hl_range', 'hl_range_pct', 'hl_range_ma20', 'realized_range_ma')}, volume, R6(hl_range_pct) AS realized_range FROM f",
    "grid_1h"))
def _merge_silver(s, d):
    h = hourly(s, d)
    return jo.merge_silver(te.sma(h, HOURLY, periods=(7,)), mi.hl_range(h, HOURLY), vo.realized_range(h, HOURLY))


LABELS = (
    "l AS (SELECT *, lead(close, 30) OVER (PARTITION BY instrument ORDER BY time) AS future_close FROM grid_1h), "
    "t AS (SELECT *, (future_close > close)::INTEGER AS target_classification, future_close - close AS target_regression, "
    "100 * (future_close - close) / nullif(close, 0) AS target_pct_change FROM l WHERE future_close IS NOT NULL), "
)


def labelled(s, d):
    return la.target_labels(hourly(s, d), HOURLY)


query("merge_labels", sql(
    LABELS + f"f AS (SELECT instrument, time, {roll('avg', 'close', 7)} AS sma_7 FROM grid_1h) SELECT instrument, time, R6(sma_7) AS sma_7, "
    "R6(target_pct_change) AS target FROM f JOIN t USING (instrument, time)", "grid_1h"))(
    lambda s, d: jo.merge_labels(cols(te.sma(hourly(s, d), HOURLY, periods=(7,)), ["sma_7"]), labelled(s, d)))

query("manifest_left_join", sql(
    "SELECT a.article_id, a.source, a.published_at, b.time AS timestamp, R6(b.close) AS close, b.instrument AS source_gold FROM articles a "
    "LEFT JOIN bars_1h b ON a.published_at = b.time", "articles", "bars_1h"))(
    lambda s, d: jo.manifest_left_join(
        articles(s, d).select("article_id", "source", "published_at"),
        bars(s, d).select(F.col("time").alias("timestamp"), "close", F.col("instrument").alias("source"))))

# As-of joins use the actionable signals, which leave gaps of more than six hours.
cte("actionable", "SELECT * FROM signals_60m WHERE trading_signal <> 0", "signals_60m")
cte(
    "matched",
    "SELECT g.instrument, g.time, g.close, CASE WHEN s.signal_time >= g.time - INTERVAL 6 HOUR THEN s.signal_time END AS st, "
    "s.avg_sentiment AS a, s.signal_strength AS b, s.trading_signal AS c, s.article_count AS e, s.quality_score AS q "
    "FROM grid_1h g ASOF LEFT JOIN actionable s ON g.time >= s.signal_time",
    "grid_1h", "actionable",
)
VALUES = {"news_avg_sentiment": "a", "news_signal_strength": "b", "news_trading_signal": "c", "news_article_count": "e", "news_quality_score": "q"}


def actionable(s, d):
    return signals(s, d).filter(F.col("trading_signal") != 0).select("signal_time", *ao.NEWS_VALUES)


def closes(s, d):
    return cols(hourly(s, d), ["close"])


_zero = ", ".join(f"R6(CASE WHEN st IS NULL THEN 0 ELSE {x} END) AS {n}" for n, x in VALUES.items())
_age = "(epoch_us(time) - epoch_us(st)) / 60000000.0"
query("asof_zero_fill", sql(
    f"SELECT instrument, time, R6(close) AS close, {_zero}, R6({_age}) AS news_age_minutes, (st IS NOT NULL)::INTEGER AS news_available FROM matched", "matched"))(
    lambda s, d: ao.asof_zero_fill(closes(s, d), actionable(s, d)))
query("asof_simple", sql(
    f"SELECT instrument, time, R6(close) AS close, {_zero}, R6(0) AS news_age_minutes, (st IS NOT NULL AND a <> 0)::INTEGER AS news_available FROM matched", "matched"))(
    lambda s, d: ao.asof_simple(closes(s, d), actionable(s, d)))

_w = "(PARTITION BY instrument ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
FFILL = (
    "n AS (SELECT *, st IS NOT NULL AND st IS DISTINCT FROM lag(st) OVER (PARTITION BY instrument ORDER BY time) AS is_new FROM matched), "
    "v AS (SELECT instrument, time, close, " + ", ".join(
        f"last_value(CASE WHEN st IS NOT NULL THEN {x} END IGNORE NULLS) OVER {_w} AS {x}" for x in ("st", *VALUES.values()))
    + f", sum(is_new::INTEGER) OVER {_w} AS ev FROM n), "
    "r AS (SELECT *, CASE WHEN ev > 0 THEN row_number() OVER (PARTITION BY instrument, ev ORDER BY time) - 1 END AS rows_since FROM v) "
)
query("asof_ffill", sql(
    FFILL + "SELECT instrument, time, R6(close) AS close, st AS news_signal_time, R6(a) AS news_avg_sentiment, R6(b) AS news_signal_strength, c AS news_trading_signal, "
    f"e AS news_article_count, R6(q) AS news_quality_score, rows_since AS news_rows_since_update, R6({_age}) AS news_age_minutes, (st IS NOT NULL)::INTEGER AS news_available FROM r",
    "matched"))(lambda s, d: ao.asof_ffill(closes(s, d), actionable(s, d), HOURLY))
query("asof_coverage", sql(
    FFILL + "SELECT instrument, R6(avg((st IS NOT NULL)::INTEGER)) AS news_coverage, R6(avg(coalesce((rows_since = 0)::INTEGER, 0))) AS fresh_news_share, "
    "count(*) AS rows FROM r GROUP BY 1", "matched"))(
    lambda s, d: ao.asof_coverage(ao.asof_ffill(closes(s, d), actionable(s, d), HOURLY), ["instrument"]))
query("asof_no_news", sql(
    "SELECT instrument, time, R6(close) AS close, NULL::BIGINT AS news_rows_since_update, 0 AS news_available, NULL::DOUBLE AS news_age_minutes FROM grid_1h", "grid_1h"))(
    lambda s, d: ao.asof_ffill(closes(s, d), None))
query("asof_no_news_zeros", sql(
    "SELECT instrument, time, R6(close) AS close, " + ", ".join(f"R6(0) AS {n}" for n in VALUES) + ", R6(0) AS news_age_minutes, 0 AS news_available FROM grid_1h", "grid_1h"))(
    lambda s, d: ao.asof_simple(closes(s, d), None))

# --- labels and splits --------------------------------------------------------------------------

query("future_close", sql("SELECT instrument, time, R6(close) AS close, R6(lead(close, 30) OVER (PARTITION BY instrument ORDER BY time)) AS future_close FROM grid_1h", "grid_1h"))(
    lambda s, d: cols(la.future_close(hourly(s, d), HOURLY), ["close", "future_close"]))
query("target_labels", sql(
    LABELS + f"x AS (SELECT * FROM t) SELECT instrument, time, {rnd('close', 'future_close', 'target_regression', 'target_pct_change')}, target_classification FROM x", "grid_1h"))(
    lambda s, d: cols(labelled(s, d), ["close", "future_close", "target_regression", "target_pct_change", "target_classification"]))
_multi = ("CASE WHEN {x} <= -0.5 THEN 'strong_down' WHEN {x} <= -0.1 THEN 'down' WHEN {x} <= 0.1 THEN 'neutral' WHEN {x} <= 0.5 THEN 'up' "
          "WHEN {x} IS NOT NULL THEN 'strong_up' END")
query("target_multiclass", sql(
    LABELS + f"x AS (SELECT * FROM t) SELECT instrument, time, {_multi.replace('{x}', 'target_pct_change')} AS target_multiclass FROM x", "grid_1h"))(
    lambda s, d: cols(la.target_multiclass(labelled(s, d)), ["target_multiclass"]))
query("label_distribution", sql(
    LABELS + "x AS (SELECT * FROM t) SELECT instrument, count(*) AS rows, sum(target_classification)::BIGINT AS up, (count(*) - sum(target_classification))::BIGINT AS down, "
    "R6(avg(target_classification)) AS up_share, R6(1 - avg(target_classification)) AS down_share FROM x GROUP BY 1", "grid_1h"))(
    lambda s, d: la.label_distribution(labelled(s, d), keys=["instrument"]))
query("target_summary", sql(
    LABELS + "x AS (SELECT * FROM t) SELECT instrument, count(*) AS rows, R6(avg(target_pct_change)) AS target_mean, R6(stddev_samp(target_pct_change)) AS target_std FROM x GROUP BY 1", "grid_1h"))(
    lambda s, d: la.target_summary(labelled(s, d), keys=["instrument"]))

POSN = (
    "p AS (SELECT instrument, time, row_number() OVER (PARTITION BY instrument ORDER BY time) - 1 AS pos, count(*) OVER (PARTITION BY instrument) AS n FROM bars_1h), "
)
query("expanding_folds", sql(
    POSN + "f AS (SELECT *, n // 6 AS fs FROM p) SELECT instrument, time, (CASE WHEN pos // fs - 1 BETWEEN 0 AND 4 THEN pos // fs - 1 ELSE -1 END)::INTEGER AS fold FROM f", "bars_1h"))(
    lambda s, d: la.expanding_folds(bars(s, d).select("instrument", "time"), IRREGULAR))
query("label_metadata", sql(
    LABELS + "x AS (SELECT * FROM t) SELECT instrument, time, 30 AS prediction_horizon_minutes, '2024-02-01T00:00:00' AS label_generated_at FROM x", "grid_1h"))(
    lambda s, d: cols(la.label_metadata(labelled(s, d), 30, "2024-02-01T00:00:00"), ["prediction_horizon_minutes", "label_generated_at"]))
query("label_horizon_check", "SELECT 30 AS requested_horizon, min(60 + 0 * doc_id)::INTEGER AS label_horizon, 60 AS horizon, 1 AS overridden FROM labels")(
    lambda s, d: la.label_horizon_check(table(s, d, "labels", "doc_id").withColumn("prediction_horizon_minutes", F.lit(60)), 30))
query("drop_missing_target", sql(
    "SELECT instrument, time, R6(f) AS target FROM (SELECT instrument, time, lead(close, 30) OVER (PARTITION BY instrument ORDER BY time) AS f FROM grid_1h) WHERE f IS NOT NULL", "grid_1h"))(
    lambda s, d: la.drop_missing_target(la.future_close(hourly(s, d), HOURLY).select("instrument", "time", F.col("future_close").alias("target"))))

RATIO = ("CASE WHEN pos < floor(n * 0.6::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.8::DOUBLE) THEN 'val' WHEN pos < floor(n * 0.9::DOUBLE) THEN 'test' ELSE 'oot' END")
query("split_ratio", sql(POSN + f"f AS (SELECT * FROM p) SELECT instrument, time, {RATIO} AS split FROM f", "bars_1h"))(
    lambda s, d: la.split_ratio(bars(s, d).select("instrument", "time"), IRREGULAR))
CUTS = {"train": "2024-01-18 00:00:00", "val": "2024-01-24 06:30:00", "test": "2024-01-27 12:00:00"}
_cnt = ", ".join(f"count(*) FILTER (time <= TIMESTAMP '{v}') OVER (PARTITION BY instrument) - 1 AS c_{k}" for k, v in CUTS.items())
DATES = (f"q AS (SELECT instrument, time, row_number() OVER (PARTITION BY instrument ORDER BY time) - 1 AS pos, count(*) OVER (PARTITION BY instrument) AS n, {_cnt} FROM bars_1h), "
         "y AS (SELECT instrument, time, CASE WHEN pos < c_train THEN 'train' WHEN pos < c_val THEN 'val' WHEN pos < c_test THEN 'test' WHEN pos < n - 24 THEN 'oot' ELSE 'oot2' END AS split FROM q) ")


def dated(s, d):
    return la.split_dates(bars(s, d).select("instrument", "time"), IRREGULAR, CUTS, 24)


query("split_dates", sql(DATES + "SELECT * FROM y", "bars_1h"))(dated)
query("split_summary", sql(
    DATES + "SELECT instrument, split, count(*) AS rows, min(time) AS first_time, max(time) AS last_time, R6(count(*) / sum(count(*)) OVER (PARTITION BY instrument)) AS share FROM y GROUP BY 1, 2", "bars_1h"))(
    lambda s, d: la.split_summary(dated(s, d)))


def folds_sql(size: str, folds: int, gap: int) -> str:
    trains = "least(" + ", ".join(f"CASE WHEN pos < n - {folds - f} * z - {gap} THEN {f} ELSE 9999 END" for f in range(folds)) + ")"
    tests = "CASE " + " ".join(
        f"WHEN pos >= n - {folds - f} * z AND pos < n - {folds - f - 1} * z THEN {f}" for f in range(folds)) + " ELSE -1 END"
    return sql(POSN + f"f AS (SELECT *, {size} AS z FROM p) SELECT instrument, time, ({tests})::INTEGER AS test_fold, nullif({trains}, 9999)::INTEGER AS train_from_fold FROM f", "bars_1h")


query("walk_forward_splits", folds_sql("floor(n * 0.15::DOUBLE)::BIGINT", 3, 0))(
    lambda s, d: la.walk_forward_splits(bars(s, d).select("instrument", "time"), IRREGULAR))
query("walk_forward_splits_equal", folds_sql("n // 6", 5, 0))(
    lambda s, d: la.walk_forward_splits(bars(s, d).select("instrument", "time"), IRREGULAR, 5, None))
query("purged_folds", folds_sql("50", 10, 20))(
    lambda s, d: la.purged_folds(bars(s, d).select("instrument", "time"), IRREGULAR, 10, 20, 50))

# --- preparation --------------------------------------------------------------------------------


@query("gold_clean", sql(
    "h AS (SELECT instrument, time, CASE WHEN volume > 1 THEN open END AS open, CASE WHEN volume % 2 = 1 THEN high END AS high, "
    f"CASE WHEN volume > 3 THEN low END AS low, close, {lag('close', 3)} AS close_3 FROM grid_1h), "
    "k AS (SELECT * FROM h WHERE 3 + (open IS NOT NULL)::INTEGER + (high IS NOT NULL)::INTEGER + (low IS NOT NULL)::INTEGER + (close_3 IS NOT NULL)::INTEGER >= 0.7 * 7), "
    "f AS (SELECT instrument, time, close, " + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER {_w} AS {c}" for c in ("open", "high", "low", "close_3")) + " FROM k) "
    f"SELECT instrument, time, {rnd('open', 'high', 'low', 'close', 'close_3')} FROM f WHERE open + high + low + close_3 IS NOT NULL", "grid_1h"))
def _gold_clean(s, d):
    h = hourly(s, d)
    v = F.col("volume")
    lagged = te.momentum(h, HOURLY, steps=(3,)).withColumn("close_3", F.col("close") - F.col("momentum_3"))
    wide = lagged.select("instrument", "time", F.when(v > 1, F.col("open")).alias("open"), F.when(v % 2 == 1, F.col("high")).alias("high"),
                         F.when(v > 3, F.col("low")).alias("low"), "close", "close_3")
    return pr.gold_clean(wide, HOURLY)


query("select_feature_columns", sql(LABELS + f"x AS (SELECT * FROM t) SELECT {rnd('open', 'high', 'low')}, volume FROM x", "grid_1h"))(
    lambda s, d: pr.select_feature_columns(labelled(s, d)))
query("categorical_codes", "SELECT doc_id, (CASE WHEN n_chars > 500 THEN dense_rank() OVER (PARTITION BY n_chars > 500 ORDER BY source) - 1 ELSE -1 END)::INTEGER AS source, "
      "(dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS lang FROM documents")(
    lambda s, d: pr.categorical_codes(table(s, d, "documents").select("doc_id", F.when(F.col("n_chars") > 500, F.col("source")).alias("source"), "lang")))
_gaps = {"l_quantity": "l_quantity % 7 <> 0", "l_extendedprice": "l_discount > 0.02", "l_tax": "l_tax < 0.05"}
query("median_impute", "WITH g AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN {c} THEN {n} END AS {n}" for n, c in _gaps.items()) + " FROM lineitem) "
      "SELECT l_orderkey, l_linenumber, " + ", ".join(f"R6(coalesce({n}, (SELECT median({n}) FROM g))) AS {n}" for n in _gaps) + " FROM g")(
    lambda s, d: pr.median_impute(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.when(F.expr(c), F.col(n)).alias(n) for n, c in _gaps.items()]), list(_gaps)))
query("ffill_impute", sql(
    f"SELECT instrument, time, R6(last_value(CASE WHEN volume > 3 THEN close END IGNORE NULLS) OVER {_w}) AS close FROM grid_1h", "grid_1h"))(
    lambda s, d: pr.ffill_impute(cols(hourly(s, d).withColumn("close", F.when(F.col("volume") > 3, F.col("close"))), ["close"]), ["close"], HOURLY))
query("drop_constant_columns", "SELECT l_orderkey, l_linenumber, R6(l_quantity) AS l_quantity FROM lineitem")(
    lambda s, d: pr.drop_constant_columns(table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").withColumns(
        {"unit": F.lit(1), "gap": F.lit(None).cast("double")})))
query("standardize", "WITH t AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS me, stddev_pop(l_extendedprice) AS se FROM lineitem "
      "WHERE l_shipdate < TIMESTAMP '1999-01-01') SELECT l_orderkey, l_linenumber, R6((l_quantity - mq) / sq) AS l_quantity, R6((l_extendedprice - me) / se) AS l_extendedprice FROM lineitem, t")(
    lambda s, d: pr.standardize(table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"),
                                ["l_quantity", "l_extendedprice"], F.col("l_shipdate") < ts("1999-01-01")).drop("l_shipdate"))
_lags = {f"{c}_lag{k}": lag(c, k) for c in ("close", "high") for k in (1, 2, 3)}
query("lag_matrix", sql(
    "x AS (SELECT instrument, time, close, high, " + ", ".join(f"{e} AS {n}" for n, e in _lags.items()) + " FROM grid_1h) "
    f"SELECT instrument, time, {rnd('close', 'high', *_lags)} FROM x WHERE close_lag3 IS NOT NULL", "grid_1h"))(
    lambda s, d: pr.lag_matrix(cols(hourly(s, d), ["close", "high"]), ["close", "high"], 3, HOURLY))

cte("ar_base", f"SELECT instrument, time, close, 100 * (close / nullif({lag('close', 30)}, 0) - 1) AS return_30, "
    "100 * (lead(close, 30) OVER (PARTITION BY instrument ORDER BY time) - close) / nullif(close, 0) AS target FROM grid_1h", "grid_1h")
_ar = ", ".join(f"lag(return_30, {k}) OVER (PARTITION BY instrument ORDER BY time) AS return_30_lag{k}" for k in range(1, 4))
cte("ar_rows", f"SELECT * FROM (SELECT *, {_ar}, lead(return_30) OVER (PARTITION BY instrument ORDER BY time) AS y_ar FROM ar_base) "
    "WHERE return_30_lag3 IS NOT NULL AND y_ar IS NOT NULL AND target IS NOT NULL", "ar_base")


def ar_base(s, d):
    h = hourly(s, d)
    return la.target_labels(te.returns(h, HOURLY, steps=(30,)), HOURLY, drop=False).select(
        "instrument", "time", "return_30", F.col("target_pct_change").alias("target"))


def ar_rows(s, d, lags: int = 3):
    return pr.ar_design(ar_base(s, d), lags, HOURLY)


query("ar_design", sql(f"SELECT instrument, time, {rnd('return_30', 'target', 'return_30_lag1', 'return_30_lag2', 'return_30_lag3', 'y_ar')} FROM ar_rows", "ar_rows"))(ar_rows)
_blk = ", ".join([f"{lag('close', i * 3)} AS lag_{i}" if i else "close AS lag_0" for i in range(4)])
cte("block_rows", f"SELECT * FROM (SELECT instrument, time, close, {_blk}, lead(close, 3) OVER (PARTITION BY instrument ORDER BY time) AS target FROM grid_1h) "
    "WHERE lag_3 IS NOT NULL AND target IS NOT NULL", "grid_1h")


def block_rows(s, d):
    return pr.block_lag_design(cols(hourly(s, d), ["close"]), 4, 3, HOURLY, "close")


query("block_lag_design", sql(f"SELECT instrument, time, {rnd('close', 'lag_0', 'lag_1', 'lag_2', 'lag_3', 'target')} FROM block_rows", "block_rows"))(block_rows)
_seq = "OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
query("sequence_windows", sql(
    f"SELECT instrument, time, list(close) {_seq} AS close_sequence FROM grid_1h QUALIFY count(*) {_seq} = 50", "grid_1h"))(
    lambda s, d: cols(pr.sequence_windows(hourly(s, d), HOURLY), ["close_sequence"]).filter(F.col("close_sequence").isNotNull()))
query("difference", sql(f"SELECT instrument, time, R6(close - {lag('close', 2)}) AS close_diff FROM grid_1h", "grid_1h"))(
    lambda s, d: cols(pr.difference(hourly(s, d), HOURLY, lag=2), ["close_diff"]))
query("difference_second_order", sql(f"SELECT instrument, time, R6(close - 2 * {lag('close', 1)} + {lag('close', 2)}) AS close_diff FROM grid_1h", "grid_1h"))(
    lambda s, d: cols(pr.difference(hourly(s, d), HOURLY, order=2), ["close_diff"]))
query("round_sigfigs", "SELECT l_orderkey, l_linenumber, R6(printf('%.3e', l_extendedprice)::DOUBLE) AS l_extendedprice FROM lineitem")(
    lambda s, d: pr.round_sigfigs(table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"]))


@query("quant_feature_json")
def _quant(s, d):
    h = te.rolling_volatility(te.sma(te.momentum(hourly(s, d), HOURLY), HOURLY), HOURLY)
    return cols(pr.quant_feature_json(h), ["quant_json"])
