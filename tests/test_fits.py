"""Buckets from sketches, joins by key, lag search, unit roots, early stopping and two-stage tuning."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import ranks
from marketloom.functions.frames import attach_by_key
from marketloom.functions.series import Series
from marketloom.operators import advanced as adv
from marketloom.operators import boosting as bo
from marketloom.operators import forecasting as fo
from marketloom.operators import labels as la
from marketloom.operators import prep as pr

ANY = Series(step=None)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_buckets_are_even_however_the_values_lie(spark, keys):
    rnd = np.random.RandomState(1)
    values = np.unique(np.concatenate([5000 + 40 * rnd.rand(40_000), [1e12, -3.0, 0.0], np.exp(rnd.uniform(-300, 300, 2_000))]))
    df = spark.createDataFrame(pd.DataFrame({"k": "x", "v": values, "w": rnd.randint(1, 9, len(values))}))
    edges = ranks.value_edges(df, keys, "v", 64)
    placed = ranks.with_bucket(df.join(edges, keys) if keys else df.crossJoin(edges), F.col("v"), 64)
    sizes = [r["count"] for r in placed.groupBy(ranks.BUCKET).count().collect()]
    assert len(sizes) == 64 and max(sizes) <= 3 * np.median(sizes)
    got = ranks.sorted_running(df, keys, "v", {"w": F.col("w")}, 64).toPandas().sort_values("v")
    want = df.toPandas().sort_values("v").w.cumsum()
    assert (got.upto_w.to_numpy() == want.to_numpy()).all() and (got.total_w == want.iloc[-1]).all()
    assert (got.below_w.to_numpy() == want.to_numpy() - got.w.to_numpy()).all()


def test_running_sums_of_few_null_and_equal_values(spark):
    rows = [("a", 1.0, 1), ("a", None, 5), ("b", 2.0, 1), ("b", 3.0, 4), ("c", float("inf"), 1), (None, 1.0, 9)]
    got = ranks.sorted_running(spark.createDataFrame(rows, "k string, v double, n int"), ["k"], "v", {"n": F.col("n")}, 8).collect()
    assert sorted((r.k, r.v, r.below_n, r.upto_n, r.total_n) for r in got) == [("a", 1.0, 0, 1, 1), ("b", 2.0, 0, 1, 5), ("b", 3.0, 1, 5, 5), ("c", math.inf, 0, 1, 1)]
    medians = ranks.exact_median(spark.createDataFrame([(float(k % 7),) for k in range(100)], "v double"), [], "v", "m").first()
    assert medians.m == 3.0


def test_key_tables_never_gather_a_key_in_one_task(spark):
    df = spark.range(2_000).select((F.col("id") % 3 == 0).cast("string").alias("k"), "id", F.create_map("id", "id").alias("m"))
    per = df.groupBy("k").agg(F.max("id").alias("top"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach_by_key(df, per, ["k"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_share" in plan and out.filter(F.col("top").isNull()).count() == 0 and out.columns == ["k", "id", "m", "top"]
        assert attach_by_key(df, per.filter("top = -1"), ["k"], "left_semi").count() == 0 and attach_by_key(df, per.limit(0), ["k"]).count() == 2_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_flat_prices_have_no_trend(spark):
    pdf = pd.DataFrame({"instrument": "a", "time": pd.date_range("2024-01-01", periods=400, freq="min"), "close": [45.81] * 200 + list(np.linspace(45.81, 60, 200))})
    out = adv.adv_trend_regime(spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz")), Series(step=60)).toPandas().sort_values("time")
    assert (out.is_uptrend.iloc[:200].fillna(0) == 0).all() and (out.is_uptrend.iloc[260:] == 1).all()


def series(spark, y, chunk=None):
    pdf = pd.DataFrame({"instrument": "a", "time": pd.date_range("2024-01-01", periods=len(y), freq="min"), "close": y, "chunk": chunk if chunk is not None else 1})
    return spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))


def adf_by_hand(y, max_lag):
    d = np.diff(y)

    def fit(p, first):
        t = np.arange(first, len(d))
        x = np.column_stack([np.ones(len(t)), y[t], *[d[t - k] for k in range(1, p + 1)]])
        beta, *_ = np.linalg.lstsq(x, d[t], rcond=None)
        rss, n, k = float(((d[t] - x @ beta) ** 2).sum()), len(t), x.shape[1]
        aic = n * (math.log(2 * math.pi) + math.log(rss / n) + 1) + 2 * k
        return aic, beta[1] / math.sqrt(rss / (n - k) * np.linalg.inv(x.T @ x)[1, 1]), n
    used = min(range(max_lag + 1), key=lambda p: fit(p, max_lag)[0])
    return used, *fit(used, used)[1:]


def test_unit_root_with_lag_selection(spark):
    rnd = np.random.RandomState(4)
    walk = 1_000 + np.cumsum(rnd.randn(700))
    ar = np.zeros(700)
    for t in range(3, 700):
        ar[t] = 0.5 * ar[t - 1] - 0.3 * ar[t - 2] + 0.35 * ar[t - 3] + rnd.randn()
    y = np.concatenate([walk, ar, np.full(60, 3.0), [1.0, 2.0]])
    chunk = np.repeat([1, 2, 3, 4], [700, 700, 60, 2])
    got = {r.chunk: r for r in fo.unit_root_test(series(spark, y, chunk), max_lag=8, series=Series(step=60)).collect()}
    for k, part in ((1, walk), (2, ar)):
        used, stat, n = adf_by_hand(part, 8)
        assert got[k].used_lag == used and got[k].n_obs == n and got[k].adf_stat == pytest.approx(stat, rel=1e-8)
    assert got[2].used_lag >= 2 and got[2].p_value < 0.01 < 0.05 < got[1].p_value
    assert got[3].adf_stat is None and got[4].adf_stat is None
    # published: 5 % point of 100 rows is -2.8913 (rounded), the asymptotic 1, 5 and 10 % points are -3.43, -2.86, -2.57
    assert fo.UNIT_ROOT_CRITICAL["crit_5"][0] - 2.8903 / 100 - 4.234 / 100**2 - 40.04 / 100**3 == pytest.approx(-2.8909, abs=1e-3)
    for p, point in ((0.01, -3.43), (0.05, -2.86), (0.10, -2.57)):
        assert fo.unit_root_pvalue(point) == pytest.approx(p, abs=2e-3)


def test_lag_search_reads_rows_twice_and_multiplies_none(spark):
    rnd = np.random.RandomState(7)
    y = np.zeros(900)
    for t in range(2, 900):
        y[t] = 0.4 * y[t - 1] + 0.2 * y[t - 2] + rnd.randn()
    pdf = pd.DataFrame({"instrument": np.repeat(["a", "b"], 450), "time": list(pd.date_range("2024-01-01", periods=450, freq="min")) * 2, "return_30": y / 50 + 3, "target": np.roll(y, -4)})
    base = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))
    wide = la.split_ratio(pr.ar_design(base, 10, Series(step=60)), ANY)
    got = fo.ar_lag_search(wide, 1, 10, 6, Series(step=60)).toPandas()
    assert len(got) == 20 and (got.groupby("instrument").best.sum() == 1).all()
    p = wide.toPandas()
    for _, r in got.iterrows():
        q = p[p.instrument == r.instrument].dropna()
        tr, va, cols = q[q.split == "train"], q[q.split == "val"], fo.ar_columns(r.lag)
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(tr)), tr[cols]]), tr.y_ar, rcond=None)[0]
        e = np.column_stack([np.ones(len(va)), va[cols]]) @ np.array(fo.horizon_weights(beta, 6)) - va.target
        assert r.val_rmse_target == pytest.approx(math.sqrt((e**2).mean()), rel=1e-9) and r.val_mae_target == pytest.approx(e.abs().mean(), rel=1e-9)
        assert r.val_samples == len(va) and r.train_samples == len(tr)
    bare = fo.ar_lag_search(wide, 1, 10, 6, Series(step=60), mae=False).toPandas()
    assert "val_mae_target" not in bare and set(zip(bare.instrument, bare.lag, bare.best)) == set(zip(got.instrument, got.lag, got.best))


@pytest.fixture(scope="module")
def trees(spark):
    rnd = np.random.RandomState(3)
    x = rnd.rand(500, 4)
    target = np.sin(6 * x[:, 0]) + x[:, 1] + 0.4 * rnd.randn(500)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(_gbt_x=1.0, target=target, n=range(500))
    pdf["train_from_fold"] = np.where(pdf.n < 200, 0, np.where(pdf.n < 350, 1, 2))
    pdf["test_fold"] = np.where(pdf.n < 200, -1, np.where(pdf.n < 350, 0, 1))
    return spark.createDataFrame(pdf).repartition(2).cache()


def test_validation_rows_end_boosting(trees):
    train, held = trees.filter("n < 300"), trees.filter("n >= 300")
    early = bo.fit_gbt(train, list("abcd"), validation=held, maxDepth=3, maxIter=60, subsamplingRate=1.0)
    n = bo.rounds(early)
    assert 1 < n < 60
    exact = bo.fit_gbt(train, list("abcd"), maxDepth=3, maxIter=n, subsamplingRate=1.0)
    a, b = ({r.n: r.prediction for r in bo.score_batch(m, held).collect()} for m in (early, exact))
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a) and len(a) == 200
    scored = bo.score_batch(early, held)
    assert "_gbt_x" in scored.columns and set(scored.columns) == {*held.columns, "prediction"}


def test_two_stages(trees):
    out = bo.two_stage_tuning(trees, list("abcd"), {"maxDepth": [1, 3]}, lambda t: {"top": [t.orderBy(F.desc("importance")).first().feature]}, folds=2, maxIter=12, stepSize=0.3).toPandas()
    first, second = out[out.stage == 1], out[out.stage == 2]
    assert len(first) == 4 and len(second) == 4 and set(second.feature_group) == {"all", "top"} and out.rounds.between(1, 12).all()
    means = first.groupby("params").score.mean()
    assert set(first[first.chosen == 1].params) == {means.idxmin()} and set(second.params) == {means.idxmin()}
    groups = second.groupby("feature_group").score.mean()
    assert set(second[second.chosen == 1].feature_group) == {groups.idxmin()} and set(second[second.feature_group == "top"].n_features) == {1}


def test_a_long_pause_is_filled_in_pieces(spark, monkeypatch):
    from marketloom.operators import grid

    start = pd.Timestamp("2024-01-01 00:00:07")
    times = [start + pd.Timedelta(minutes=m) for m in (0, 1, 5, 4_000, 4_001, 9_500)]
    pdf = pd.DataFrame({"instrument": "a", "time": times, "close": [1.0, 2.0, None, 4.0, 5.0, 6.0]})
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))
    want = pdf.set_index("time").reindex(pd.date_range(times[0], times[-1], freq="min"))
    since = want.instrument.notna().cumsum()
    for piece in (1_440, 7):
        monkeypatch.setattr(grid, "PIECE", piece)
        got = grid.grid_reindex_ffill(df, Series(step=60)).toPandas().sort_values("time")
        assert list(got.time) == list(want.index) and list(got.minutes_since_last_data) == list(want.groupby(since).cumcount())
        assert got.is_backfilled.sum() == 9_501 - 6 and list(got.close.dropna().unique()) == [1.0, 2.0, 4.0, 5.0, 6.0]
    filled = grid.grid_reindex_ffill(df, Series(step=60))
    parts = filled.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 9_000


def test_dictionary_with_long_shared_prefixes(spark):
    values = ["the-same-twenty-letter" + f"{k * 7919 % 5000:06d}" for k in range(5_000)]
    rows = [(v, k % 2 == 0) for k, v in enumerate(values + values[:50])] + [(None, None), ("", True), ("ä", False)]
    df = spark.createDataFrame(rows, "name string, flag boolean").repartition(4)
    rank = {v: i for i, v in enumerate(sorted({r[0] for r in rows if r[0] is not None}, key=lambda x: x.encode()))}
    got = pr.categorical_codes(df.withColumn("was", F.col("name")).withColumn("is", F.col("flag")), ["name", "flag"]).collect()
    assert len(got) == len(rows) and all(r["name"] == (-1 if r["was"] is None else rank[r["was"]]) and r["flag"] == (-1 if r["is"] is None else int(r["is"])) for r in got)
    spread = df.select("name").distinct().repartitionByRange("name").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in spread) <= 2 * 5_002 / max(len(spread), 1) or len(spread) == 1
