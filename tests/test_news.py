"""As-of joins, articles, scoring, drift and streams."""
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions.series import Series
from marketloom.operators import asof as ao
from marketloom.operators import drift as dr
from marketloom.operators import news_schema as ns
from marketloom.operators import prep as pr
from marketloom.operators import sentiment as se
from marketloom.sources.articles import build_manifest, read_articles_json
from marketloom.streaming import core as st
from marketloom.streaming import jobs as sj


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def sides(spark, seed=3):
    rng = np.random.default_rng(seed)
    left = pd.concat([pd.DataFrame({"instrument": k, "time": pd.date_range("2024-01-02", periods=500, freq="15min")}) for k in "ab"])
    times = pd.Timestamp("2024-01-01 20:00") + pd.to_timedelta(np.sort(rng.choice(8_000, 25, replace=False)), unit="min")
    right = pd.DataFrame({"signal_time": times, **{c: rng.normal(size=25) for c in ao.NEWS_VALUES}})
    return left, right, ntz(spark.createDataFrame(left), "time"), ntz(spark.createDataFrame(right), "signal_time")


def test_asof_equals_pandas(spark):
    left, right, l, r = sides(spark)
    want = pd.merge_asof(left.sort_values("time"), right, left_on="time", right_on="signal_time", tolerance=pd.Timedelta(hours=6))
    want = want.sort_values(["instrument", "time"]).reset_index(drop=True)
    got = ao.asof_zero_fill(l, r).toPandas().sort_values(["instrument", "time"]).reset_index(drop=True)
    assert want.signal_time.isna().any() and list(got.news_available) == list(want.signal_time.notna().astype(int))
    np.testing.assert_allclose(got.news_avg_sentiment, want.avg_sentiment.fillna(0))


def test_asof_ffill_equals_pandas(spark):
    left, right, l, r = sides(spark)
    got = ao.asof_ffill(l, r, Series(step=None)).toPandas().sort_values(["instrument", "time"]).reset_index(drop=True)
    for k, p in left.groupby("instrument"):
        m = pd.merge_asof(p.sort_values("time"), right, left_on="time", right_on="signal_time", tolerance=pd.Timedelta(hours=6))
        new = m.signal_time.notna() & m.signal_time.ne(m.signal_time.shift())
        ev = new.cumsum()
        since = m.groupby(ev).cumcount().where(ev > 0)
        g = got[got.instrument == k].reset_index(drop=True)
        np.testing.assert_allclose(g.news_avg_sentiment.astype(float), m.avg_sentiment.ffill())
        np.testing.assert_allclose(g.news_rows_since_update.astype(float), since)


def test_asof_bounds(spark):
    l = ntz(spark.createDataFrame([("a", "2024-01-01 12:00:00"), ("a", "2024-01-01 18:00:00"), ("a", "2024-01-01 18:00:01")], "instrument string, time string"), "time")
    r = ntz(spark.createDataFrame([("2024-01-01 12:00:00", 1.0)], "signal_time string, avg_sentiment double"), "signal_time")
    got = {str(x.time)[11:]: x.news_available for x in ao.asof_zero_fill(l, r).collect()}
    assert got == {"12:00:00": 1, "18:00:00": 1, "18:00:01": 0}


def test_article_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for i, folder in enumerate((tmp_path, tmp_path / "sub")):
        (folder / f"{i}.json").write_text(json.dumps({"article_id": f"x{i}", "headline": "h", "published_at": "2024-01-01T00:00:00+02:00" if i else "bad"}, indent=1))
    (tmp_path / "seen_articles.json").write_text(json.dumps({"seen": ["x0"]}))
    (tmp_path / "broken.json").write_text("{ not json")
    rows = {r.article_id: r for r in build_manifest(read_articles_json(spark, str(tmp_path))).collect()}
    assert set(rows) == {"x0", "x1"} and rows["x0"].published_at is None and str(rows["x1"].published_at) == "2023-12-31 22:00:00"
    assert rows["x1"].file_size_bytes > 0


def test_scorer_falls_back_per_text(spark):
    def fragile():
        def score(texts):
            if any("boom" in t for t in texts):
                raise ValueError("boom")
            return [(1.0, 0.0, 0.0) for _ in texts]

        return score

    df = spark.createDataFrame([("fine",), ("boom",), (None,)], "text string").coalesce(1)
    got = {r.text: r.sentiment for r in se.model_sentiment_batch(df, fragile).collect()}
    assert got == {"fine": "positive", "boom": "neutral", None: "positive"}


def test_sigfigs_as_python(spark):
    values = [909.55, 12225.0, 1.00449999, 0.0, -3.14159, 123456789.0, 1e-7, 911.85, 0.00012345]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.v for r in pr.round_sigfigs(df, ["v"]).collect()]
    assert got == [float(f"{v:.4g}") for v in values]


def test_ks_equals_direct(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=500).round(2), rng.normal(0.3, 1, 400).round(2)
    ref, cur = (spark.createDataFrame([(float(v),) for v in x], "v double") for x in (a, b))
    got = dr.ks_drift(ref, cur, ["v"]).first()
    grid = np.union1d(a, b)
    direct = np.abs(np.searchsorted(np.sort(a), grid, "right") / 500 - np.searchsorted(np.sort(b), grid, "right") / 400).max()
    assert abs(got.ks_stat - direct) < 1e-12 and got.drifted == 1


def test_drift_needs_two_windows(spark):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "bullish" if i < 10 else "bearish", 0.9 if i < 10 else 0.2, 0.5) for i in range(20)]
    log = ntz(spark.createDataFrame(rows, "event_id int, timestamp string, prediction string, confidence double, avg_sentiment double"), "timestamp")
    now = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    none = spark.createDataFrame([], "type string, timestamp timestamp_ntz")
    found = {r.type: r.severity for r in dr.all_drifts(log, none, now).collect()}
    assert found == {"prediction_drift": "high", "confidence_drop": "high"}
    assert dr.all_drifts(log.filter("event_id < 19"), none, now).count() == 0


def test_late_row_is_dropped(spark, tmp_path):
    schema = "instrument string, time timestamp_ntz, price double"

    def put(name, rows):
        ntz(spark.createDataFrame(rows, "instrument string, time string, price double"), "time").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = st.read_stream(spark, str(tmp_path / "in"), schema)
        return st.drain(sj.stream_bars(stream, "1 minute"), "bars", str(tmp_path / "out"), str(tmp_path / "state"))

    put("a", [("a", "2024-01-01 00:00:10", 1.0), ("a", "2024-01-01 00:30:00", 2.0)])
    run()
    put("b", [("a", "2024-01-01 00:00:30", 9.0), ("a", "2024-01-01 00:31:00", 3.0), ("a", "2024-01-01 01:00:00", 3.0)])
    got = {str(r.time)[11:16]: r.volume for r in run().collect()}
    assert got == {"00:00": 1, "00:30": 1, "00:31": 1}


LONG = "word " * 30


@pytest.mark.parametrize("html,want", [
    (f"<body><p>{LONG}<div class='content'><p>{LONG}in</div><p>out</p></body>", LONG + "in"),  # a closed container ends
    (f"<div class=sidebar><p>no</p></div><div class=article-body><p>{LONG}&#8217;&eacute;</p></div><p>no", LONG + "’é"),  # unquoted, references
    (f"<article><p>{LONG}<article><p>inner</p></article><p>tail</p></article><p>no</p>", LONG + "inner tail"),  # nested
    (f"<main><p>no {LONG}</p></main><article><nav><p>menu</p></nav><p>{LONG}x<script>var p='<p>'</script>y</p></article>", LONG + "xy"),
    (f'<div role="main"><p>{LONG}<b>bold</b> <i>it', LONG + "bold it"),  # never closed
    (f"<p>{LONG}a</p><p></p><p> b </p>", LONG + "a b"), ("<p>short</p>", None), (None, None), ("", None)])
def test_page_text(html, want):
    from marketloom.functions.pages import main_text

    assert main_text(html) == (" ".join(want.split()) if want else None)


@pytest.mark.parametrize("hours", [6, 30, None])
def test_asof_over_gaps_and_days(spark, hours):
    """Rows of any spacing, days without rows or news, tied and null times; against a loop."""
    rng = np.random.default_rng(11)
    start = pd.Timestamp("2024-01-01")
    left = [(k, (start + pd.Timedelta(minutes=int(m))).to_pydatetime(), int(i)) for k in "abc" for i, m in enumerate(sorted(rng.choice(14 * 1_440, 60, replace=False)))]
    news = sorted({(start + pd.Timedelta(minutes=int(m))).to_pydatetime() for m in rng.choice(9 * 1_440, 14, replace=False)})
    l = ntz(spark.createDataFrame(left, "instrument string, time timestamp, n int"), "time").repartition(3)
    r = ntz(spark.createDataFrame([(t, float(i)) for i, t in enumerate(news)], "signal_time timestamp, avg_sentiment double"), "signal_time")
    got = {(x.instrument, x.n): (x.news_avg_sentiment, x.news_rows_since_update) for x in ao.asof_ffill(l, r, tolerance_hours=hours).collect()}
    joined = {(x.instrument, x.n): x.news_avg_sentiment for x in ao.asof_join(l, r, tolerance=None if hours is None else hours * 3_600, deals=3).collect()}
    for k in "abc":
        kept = since = before = None
        for _, t, n in [x for x in left if x[0] == k]:
            near = [i for i, s in enumerate(news) if s <= t and (hours is None or t - s <= pd.Timedelta(hours=hours))]
            now = float(near[-1]) if near else None
            since = 0 if now is not None and now != before else None if since is None else since + 1
            kept, before = now if now is not None else kept, now
            assert got[k, n] == (kept, since) and joined[k, n] == now
    start = start.to_pydatetime()
    ties = spark.createDataFrame([("a", start, 1.0), ("a", start, 3.0), ("b", start, 2.0)], "instrument string, signal_time timestamp, x double")
    some = spark.createDataFrame([("a", start, "m"), ("b", start, "m"), ("c", start, "m"), ("a", None, "m")], "instrument string, time timestamp, _row string")
    out = ao.asof_join(some, ties, keys=["instrument"], ties=["x"]).collect()
    assert sorted((x.instrument, x.time is None, x.news_x, x._row) for x in out) == [("a", False, 3.0, "m"), ("a", True, None, "m"), ("b", False, 2.0, "m"), ("c", False, None, "m")]


def test_schema_validation_reads_the_keys_once(spark):
    texts = ['{"sentiment_trend": null}', '{"time_horizon": "x", "sentiment_trend": "up"}', "broken", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, features_json string")
    out = ns.news_schema_validate(df)
    assert out.columns == ["id", "features_json", "features", "violations", "valid"]
    spark.conf.set("spark.sql.debug.maxToStringFields", 1_000)
    try:
        plan = out.select("id", "violations", "valid")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("jsonObjectKeys") == 1
    missing = {r.id: set(ns.NULLABLE_TEXTS) - set(r.violations) for r in out.collect()}
    assert missing == {0: {"sentiment_trend"}, 1: {"time_horizon", "sentiment_trend"}, 2: set(), 3: set()}
