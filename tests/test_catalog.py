"""The driver contract: every SQL check belongs to a query, and some run end to end."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


@pytest.mark.parametrize("name", ["returns", "ema", "news_signal_windows", "asof_ffill", "auc", "ks_drift", "stream_bars"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cur.fetchall(), [c[0] for c in cur.description])
