"""Decontamination and ranked search against brute force."""
import hashlib
import math
import random
import re
from collections import Counter

import pytest

from marketloom.llm import decontaminate, ranked_search
from marketloom.llm.common import read_table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def hits_by_hand(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = folded(t)
        for k in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = folded(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k:k + size])) in windows:
                    hit |= set(range(k, k + size))
                    ids |= windows[x]
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def ranks_by_hand(docs, items, top):
    docs = [(d, Counter(w), len(w)) for d, t in docs if (w := folded(t))]
    count, words, holding = len(docs), sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    asked, out = {}, []
    for i, t in set(items):
        asked.setdefault(i, []).extend(folded(t))
    for i, terms in asked.items():
        scores = []
        for d, c, n in docs:
            m = 75 + (25 * n * count) // words
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * holding[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


PASSAGE = "die Straße Über Äpfel 12 3a OK the cat sat on the mat and more words follow here now"
ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, "The cat"), (3, "x"), (None, "sat on the"), (4, None), (5, "..."), (2, "mat"), (6, " ".join(f"w{k}" for k in range(12)))]
DOCS = [(1, f"foo {PASSAGE} bar"), (1, f"foo {PASSAGE} bar"), (2, None), (None, "the CAT; x-x"), (3, ""), (4, PASSAGE[:40]), (5, " ".join(f"w{k}" for k in range(9000))),
        (6, "w0 " * 4090 + " ".join(f"w{k}" for k in range(12))), (7, "x " * 9000), (8, " ".join(f"w{k}" for k in range(9))), (0, "the cat; x-x")]


@pytest.fixture(scope="module")
def edges(spark):
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in DOCS], "doc_id long, text string, phrase int, rank int, item_id int").repartition(4)
    return docs.cache(), spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id int, text string, doc_id int").cache()


@pytest.mark.parametrize("window,shingle,segment,most", [(10, 4, 4096, 1 << 20), (10, 2, 16, 0), (10, 12, 7, 1 << 20), (3, 1, 4096, 0)])
def test_leaks(edges, window, shingle, segment, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    monkeypatch.setattr(decontaminate, "MOST_KEYS", most)
    got = decontaminate.decontaminate(*edges, window, shingle).collect()
    assert sorted(map(tuple, got), key=str) == hits_by_hand(DOCS, ITEMS, window)


def test_leaks_of_empty_tables(edges):
    docs, items = edges
    assert decontaminate.decontaminate(docs.filter("false"), items).count() == 0
    assert [r.n_hit for r in decontaminate.decontaminate(docs, items.filter("false")).collect()] == [0] * len(DOCS)


def test_leaks_of_the_tables(spark):
    docs, items = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    got = decontaminate.decontaminate(docs, items).collect()
    assert sorted(map(tuple, got), key=str) == hits_by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_leak_plan_is_native(edges):
    plan = decontaminate.decontaminate(*edges)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("top,pairs", [(2, 250_000), (20, 4)])
def test_ranks(edges, top, pairs, monkeypatch):
    monkeypatch.setattr(ranked_search, "MOST_PAIRS", pairs)
    got = ranked_search.search(*edges, top).collect()
    assert sorted(map(tuple, got), key=str) == ranks_by_hand(DOCS, ITEMS, top)


def test_ranks_of_the_tables(spark):
    docs, items = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    got = ranked_search.search(docs, items).collect()
    assert sorted(map(tuple, got), key=str) == ranks_by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 20)
    assert ranked_search.search(docs.filter("false"), items).count() == 0 and ranked_search.search(docs, items.filter("false")).count() == 0


@pytest.mark.parametrize("width", [4, 64, 4096])
def test_bounds_hold_and_end_the_rescoring(width):
    rnd = random.Random(5)
    vocabulary = [f"t{k}".encode() for k in range(400)]
    texts = [b" ".join(rnd.choices(vocabulary, weights=range(400, 0, -1), k=rnd.randint(1, 60))) for _ in range(900)]
    items = {i: dict(Counter(rnd.choices(vocabulary, k=12))) for i in range(15)}
    holding = Counter(t for x in texts for t in set(x.split()))
    queries = ranked_search.Queries.of(items, holding, len(texts), sum(len(x.split()) for x in texts), width)
    best = ranked_search.Best(queries, 5)
    for at in range(0, len(texts), 128):
        best.add(list(range(at, at + 128)), texts[at:at + 128])
    want = ranks_by_hand([(k, t.decode()) for k, t in enumerate(texts)], [(i, " ".join(t.decode() for t, n in c.items() for _ in range(n))) for i, c in items.items()], 5)
    assert sorted((i, -d, s) for i, heap in zip(queries.ids, best.heaps) for s, _, d in heap) == sorted((i, d, s) for i, _, d, s in want)
    if width == 4096:
        assert best.rescored < 0.5 * len(texts) * len(items)
