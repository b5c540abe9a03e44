"""Operators on tables where less than the whole job used to be done."""
import random
from collections import Counter

import numpy as np

from marketloom.llm import jaccard_join, neighbours


def text(rnd, n):
    return [f"{rnd.choice('abcdefgh')}{rnd.randrange(10_000)}" for _ in range(n)]


def test_keep_one_each_repeated_ids(spark):
    rnd = random.Random(8)
    a, b, c, d = (text(rnd, 120) for _ in range(4))
    near_c = [*c[:60], "changed", *c[61:]]
    near_d = [*d[:60], "changed", *d[61:]]
    rows = [(1, a)] * 4 + [(5, b), (5, a), (7, c), (7, near_c), (9, c), (20, b), (30, near_d), (30, text(rnd, 90)), (40, d), (50, ["too"]), (60, []), (60, []), (None, a)]
    table = [(i, " ".join(w), "en") for i, w in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(4)
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one_each(docs).collect())
    other = table[11][:2]
    sevens = [kept.pop(table[k][:2], 0) for k in (6, 7)]
    assert sorted(sevens) == [0, 1]
    assert kept == Counter({(1, table[0][1]): 1, (5, table[4][1]): 1, (30, table[10][1]): 1, other: 1, (50, "too"): 1, (60, ""): 2, (None, table[0][1]): 1})
    # the links of both texts of doc 30 and doc 7 are found
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).filter("doc_id IN (7, 9, 30, 40)").collect()}
    assert got == {(7, 7, 2), (9, 7, 2), (30, 30, 1), (30, 30, 0), (40, 30, 1)}


def test_nearest_small_chunks(spark):
    """Chunks hold a hundredth of the vectors, so that the lists come from the descent."""
    rnd = np.random.RandomState(6)
    x = rnd.randn(3_000, 12).astype(np.float32)
    table = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(table, every=60, chunk=30).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(range(0, 3_000, 60))
    hit = 0
    for q, found in got.items():
        s = x.astype(np.float64) @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.98 * 20 * len(got)


def test_nearest_near_copies(spark, monkeypatch):
    """A third of the vectors lie in one cell of the pivots; the descent ends after a few rounds and rows of one key come in several batches."""
    rnd = np.random.RandomState(9)
    x = rnd.randn(3_000, 48).astype(np.float32)
    x[::3] = x[0] + 0.05 * rnd.randn(1_000, 48).astype(np.float32)
    table = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    stages, plain = Counter(), neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", lambda df, name: (stages.update([name]), plain(df, name))[1])
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "50")
    try:
        got = {}
        for r in neighbours.nearest(table, every=60, chunk=60).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
    finally:
        spark.conf.set(batch, before)
    assert set(got) == set(range(0, 3_000, 60))
    hit = 0
    for q, found in got.items():
        s = x.astype(np.float64) @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.98 * 20 * len(got)
    assert 2 <= stages["nn-lists"] <= 5, stages
