"""Keyed state over several micro-batches: drift alerts, newest match, latest rows."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators.drift import DriftConfig
from marketloom.plans.ops_queries import arrive, time_slices
from marketloom.streaming import core as st
from marketloom.streaming import jobs as sj

START = dt.datetime(2024, 1, 1)


def in_files(spark, rows, schema, path):
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def replay(rows, config):
    """Alerts of each key by a plain loop over its rows in order."""
    out = []
    for key in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        last = {}
        for k in range(len(own)):
            band = own[max(0, k - 2 * config.window + 1):k + 1]
            if len(band) < 2 * config.window:
                continue
            old, new = band[:config.window], band[config.window:]
            for kind, threshold, high, pick in (("sentiment_drift", config.sentiment, 2.0, lambda r: r[5] or 0.0), ("prediction_drift", config.prediction, 1.5, lambda r: float(r[3] == "bullish")),
                                                ("confidence_drop", config.confidence, 1.5, lambda r: r[4] or 0.0)):
                b, r = (sum(map(pick, x)) / config.window for x in (old, new))
                d = b - r if kind == "confidence_drop" else abs(b - r)
                at = own[k][1]
                if d > threshold and (kind not in last or at - last[kind] >= dt.timedelta(minutes=config.cooldown_minutes)):
                    last[kind] = at
                    out.append((key, kind, "high" if d > threshold * high else "medium", round(d, 9), at))
    return sorted(out)


@pytest.fixture(scope="module")
def log():
    rnd, rows = random.Random(2), []
    for k in range(700):
        rows.append((rnd.choice("aaab"), START + dt.timedelta(seconds=60 * k + rnd.randint(0, 240)), k, rnd.choice(["bullish", "bearish", None]), rnd.choice([rnd.random(), None]), rnd.choice([rnd.uniform(-1, 1), None])))
    return rows


def test_drift_alerts_do_not_depend_on_batches(spark, log, tmp_path):
    config = DriftConfig(0.31, 0.37, 0.21, 5, 45)
    schema = "instrument string, timestamp timestamp_ntz, event_id long, prediction string, confidence double, avg_sentiment double"
    end = max(r[1] for r in log) - dt.timedelta(minutes=10)
    want = replay([r for r in log if r[1] <= end], config)
    for name, parts in (("many", [log[k::1][:0] or log[k:k + 175] for k in range(0, 700, 175)]), ("one", [log])):
        path = in_files(spark, parts, schema, str(tmp_path / name))
        stream = st.read_stream(spark, path, spark.read.parquet(path).schema, files=1)
        got = st.drain(sj.stream_drift_alerts(stream, config), name, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"), keyed=True).collect()
        assert sorted((r.instrument, r.type, r.severity, round(r.drift_value, 9), r.timestamp) for r in got) == want
        assert all(f"{r.drift_value:.3f}" in r.message for r in got)
    assert len(want) > 20


def test_a_slice_of_many_files_is_one_batch(spark, log, tmp_path):
    config = DriftConfig(0.31, 0.37, 0.21, 5, 45)
    schema = "instrument string, timestamp timestamp_ntz, event_id long, prediction string, confidence double, avg_sentiment double"
    want = replay([r for r in log if r[1] <= max(r[1] for r in log) - dt.timedelta(minutes=10)], config)
    rows = spark.createDataFrame(log, schema).repartition(3)
    folder, out, state = (str(tmp_path / x) for x in "fos")
    found = sj.stream_drift_alerts(st.table_stream(spark, folder, rows.schema), config)
    got = arrive({folder: time_slices(rows, "timestamp")}, lambda: st.drain(found, "x", out, state, keyed=True)).collect()
    assert sorted((r.instrument, r.type, r.severity, round(r.drift_value, 9), r.timestamp) for r in got) == want


def test_bars_without_any_signal_come_out(spark, tmp_path):
    bars = spark.createDataFrame([("a", START + dt.timedelta(minutes=k), k) for k in range(60)], "instrument string, time timestamp_ntz, event_id long")
    signals = spark.createDataFrame([], "signal_time timestamp_ntz, score double")
    b, s, out, state = (str(tmp_path / x) for x in "bsoc")
    found = sj.stream_asof_newest(st.table_stream(spark, b, bars.schema), st.table_stream(spark, s, signals.schema), quiet=True)
    got = arrive({b: time_slices(bars, "time"), s: time_slices(signals, "signal_time")}, lambda: st.drain(found, "x", out, state, keyed=True)).collect()
    assert sorted(r.event_id for r in got) == list(range(50)) and all(r.news_signal_time is None and r.news_score is None for r in got)


def test_newest_match(spark, tmp_path):
    rnd = random.Random(8)
    bars = [("ab"[k % 2], START + dt.timedelta(seconds=97 * k, microseconds=k), k) for k in range(600)]
    signals = [(START + dt.timedelta(seconds=rnd.randint(0, 50_000)), k, None if k % 5 == 0 else k / 7) for k in range(40)]
    signals += [(START + dt.timedelta(days=1), 99, 0.0), signals[0][:1] + (77, 1.0)]
    tolerance = 1_800
    b = in_files(spark, [bars[k:k + 150] for k in range(0, 600, 150)], "instrument string, time timestamp_ntz, event_id long", str(tmp_path / "b"))
    s = in_files(spark, [signals[:25], signals[25:]], "signal_time timestamp_ntz, number long, score double", str(tmp_path / "s"))
    left = st.read_stream(spark, b, spark.read.parquet(b).schema, files=1)
    right = st.read_stream(spark, s, spark.read.parquet(s).schema)
    got = st.drain(sj.stream_asof_newest(left, right, tolerance, delay="1 minute", shares=3), "newest", str(tmp_path / "o"), str(tmp_path / "c"), keyed=True).collect()
    end, want = max(r[1] for r in bars) - dt.timedelta(minutes=1), []
    for i, t, e in bars:
        near = [x for x in signals if t - dt.timedelta(seconds=tolerance) <= x[0] <= t]
        if t <= end:
            want.append((i, t, e, *(max(near, key=lambda x: (x[0], f'{{"number":{x[1]}')) if near else (None, None, None))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_tables_of_one_file_or_many_are_streams(spark, tmp_path):
    rows = spark.range(20).withColumn("text", F.lit("x"))
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    one = next((tmp_path / "documents.parquet").glob("part-*.parquet"))
    few = spark.read.parquet(str(one)).count()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "documents.parquet").write_bytes(one.read_bytes())
    (tmp_path / "t" / "labels.parquet").write_bytes(one.read_bytes())
    for folder, n in ((tmp_path, 20), (tmp_path / "t", few)):
        stream = st.table_stream(spark, f"{folder}/documents.parquet", rows.schema)
        assert st.drain(stream, "table", str(folder / "out"), str(folder / "state")).count() == n


def test_latest_rows_keep_two_versions_and_break_ties(spark, tmp_path):
    at = [START + dt.timedelta(hours=h) for h in range(6)]
    first = [("a", at[1], 5.0), ("b", at[1], 1.0), ("c", at[5], 1.0)]
    later = [[("a", at[1], 7.0), ("d", at[0], 1.0)], [("a", at[1], 6.0), ("b", at[3], 2.0)], [("b", at[2], 9.0)]]
    schema = "instrument string, event_timestamp timestamp_ntz, price double"
    tables = []
    for name, parts in (("x", [first, *later]), ("y", [later[0] + later[2], first, later[1]])):
        path = in_files(spark, parts, schema, str(tmp_path / name))
        stream = st.read_stream(spark, path, spark.read.parquet(path).schema, files=1)
        tables.append(sorted(map(tuple, sj.stream_latest_features(stream, str(tmp_path / f"{name}-table"), parts=4).collect())))
    assert tables[0] == tables[1] == [("a", at[1], 7.0), ("b", at[3], 2.0), ("c", at[5], 1.0), ("d", at[0], 1.0)]
    kept = [p.name for p in (tmp_path / "x-table" / "manifest").iterdir() if p.is_dir()]
    assert sorted(kept) == ["2", "3"]
    last = spark.read.parquet(str(tmp_path / "x-table" / "manifest" / "3")).collect()
    assert {r.batch for r in last} > {3}  # parts the last batch didn't touch were not written again
