"""Headline timings: one JSON line with seconds per query.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.  Results go to the no-op sink, so every
row is computed and none is collected.
"""
from __future__ import annotations

import json
import os
import sys
import time

from marketloom.operators.asof import asof_zero_fill
from marketloom.operators.grid import grid_reindex_ffill
from marketloom.operators.labels import target_labels
from marketloom.operators.microstructure import microstructure_features
from marketloom.operators.technical import technical_features
from marketloom.operators.volatility import volatility_features
from marketloom.plans.inputs import MINUTE, OHLCV, bars, signals
from marketloom.plans.registry import QUERIES
from marketloom.session import build_session, materialize

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CATALOGUE = ("ohlcv_bars_m1", "grid_reindex_ffill", "lexicon_sentiment", "news_signal_windows", "dedup_headline_earliest",
             "html_main_text", "median_impute", "ks_drift", "auc", "split_dates", "ar_recursive_forecast", "stream_bars", "training_table")


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    grid = materialize(grid_reindex_ffill(bars(spark, SF, "M1"), MINUTE), "bench-grid").select(*OHLCV)
    stages = {
        "silver_technical_m1": lambda: technical_features(grid, MINUTE),
        "silver_microstructure_m1": lambda: microstructure_features(grid, MINUTE),
        "silver_volatility_m1": lambda: volatility_features(grid, MINUTE),
        "labels_m1": lambda: target_labels(grid, MINUTE),
        "asof_news_m1": lambda: asof_zero_fill(grid, signals(spark, SF)),
    }
    stages |= {n: (lambda n=n: QUERIES[n](spark, SF)) for n in CATALOGUE}
    seconds = {}
    for name, build in stages.items():
        start = time.time()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF}))


if __name__ == "__main__":
    main()
