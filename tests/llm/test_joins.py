"""Jaccard join, passage removal, nearest neighbours and the pipeline against brute force."""
import hashlib
import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from marketloom.llm import components, jaccard_join, neighbours, packing, secret_scan, substrings, toxicity
from marketloom.llm.common import materialize, read_table
from marketloom.llm.queries import byte_bpe

SF = "/root/testdata/sf0.001"


def words(rnd, n):
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, a passage that many share, texts that repeat themselves, short ones, none."""
    rnd, out = random.Random(4), []
    passage = words(rnd, 60)
    for k in range(40):
        w = words(rnd, rnd.randint(1, 260))
        out.append(w)
        if k % 4 == 0:
            out += [list(w), list(w)]
        if k % 3 == 0:
            for _ in range(5):
                x = list(w)
                for _ in range(rnd.randint(1, 4)):
                    x[rnd.randrange(len(x))] = "changed"
                out.append(x)
        if k % 2:
            at = rnd.randint(0, len(w))
            out.append(w[:at] + passage + words(rnd, 40))
    out += [passage, passage * 3, ["x"] * 200, ["x"] * 201, ["x"] * 49, [], ["one"], ["one"], ["two", "three"]]
    rnd.shuffle(out)
    return [" ".join(w) if k % 5 else " \t\n".join(w) for k, w in enumerate(out)] + [None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(3 * k, t, "en", k, -k) for k, t in enumerate(texts)] + [(None, texts[0], "en", 0, 0), (3, texts[1], "en", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, digest int").repartition(5).cache()


def removed_by_hand(rows, n):
    first, out = {}, {}
    for d, t in sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k:k + n]), d)
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        if d is not None:
            for k in range(len(w) - n + 1):
                if first[tuple(w[k:k + n])] < d:
                    gone |= set(range(k, k + n))
        out[d, t] = [x for k, x in enumerate(w) if k not in gone]
    return out


@pytest.mark.parametrize("group,bundle", [(1_000, 600_000), (4, 300)])
def test_passages(docs, group, bundle, monkeypatch):
    monkeypatch.setattr(substrings, "BUNDLE", bundle)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = removed_by_hand(rows, 50)
    got = substrings.deduplicate(docs, group=group).collect()
    told = sorted((str(d), len((t or "").split()), len((t or "").split()) - len(want[d, t]), hashlib.sha256(b" ".join(want[d, t])).hexdigest()) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == told
    if group == 4:
        cut = substrings.cut_texts(docs, group=group)
        assert cut.columns == docs.columns
        for r in cut.collect():
            new = [" ".join(x.decode() for x in w) for (d, t), w in want.items() if d == r.doc_id and len(w) < len((t or "").split())]
            assert r.text in new or r.text in [t for d, t in rows if d == r.doc_id]
        assert sum(len((r.text or "").split()) for r in cut.collect()) == sum(len(want[d, t]) for d, t in rows)


def test_passages_of_an_empty_table(docs):
    assert substrings.deduplicate(docs.filter("false")).count() == 0 and substrings.cut_texts(docs.filter("false")).count() == 0


def test_depth_nodes():
    rnd = np.random.RandomState(3)
    w = rnd.randint(0, 2, 400)
    starts = np.arange(400 - 7 + 1)
    nodes = substrings.depth_nodes(w, starts, 7)
    by = {}
    for s, n in zip(starts, nodes):
        by.setdefault(n, set()).add(tuple(w[s:s + 7]))
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({tuple(w[s:s + 7]) for s in starts})


def jaccard_by_hand(rows):
    sets = {d: set(jaccard_join.tokens_of(t, 5).tolist()) for d, t in rows}
    links = {d: set() for d in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a].add(b)
            links[b].add(a)
    root = {}
    for d in sorted(sets):
        stack = [d] if d not in root else []
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = d
                stack += links[x]
    return sets, links, root


@pytest.mark.parametrize("leaf,block", [(100, 1_000), (3, 4)])
def test_jaccard_join(spark, docs, leaf, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    some = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    rows = [(r.doc_id, r.text) for r in some.collect()]
    sets, links, root = jaccard_by_hand(rows)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])).collect()}
    assert {d: (g.n_links, g.class_id, g.n_tokens) for d, g in got.items()} == {d: (len(links[d]), root[d], len(sets[d])) for d in sets}
    assert all(sets[g.copy_of] == sets[d] for d, g in got.items())
    if leaf == 3:
        pairs = {(r.class_a, r.class_b): r.jaccard for r in jaccard_join.linked_pairs(some).collect()}
        want = {(a, b) for a in links for b in links[a] if a < b and got[a].copy_of == a and got[b].copy_of == b and sets[a] != sets[b]}
        assert set(pairs) == want
        kept = jaccard_join.keep_one_each(docs)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {None, *root.values()}


def test_jaccard_edges(docs):
    rows = jaccard_join.near_duplicates(docs).collect()
    assert len(rows) == docs.count() and sum(r.doc_id is None and r.class_id is None and r.n_links == 0 for r in rows) == 1
    assert {r.n_links for r in rows if r.doc_id == 3} == {max(r.n_links for r in rows if r.doc_id == 3)}
    assert jaccard_join.near_duplicates(docs.filter("false")).count() == 0
    assert jaccard_join.runs_for(0.999, 1) < jaccard_join.runs_for(0.999, 3)


def test_common_counts():
    rnd = np.random.RandomState(1)
    lists = [np.unique(rnd.randint(0, 60, rnd.randint(0, 50))) for _ in range(40)]
    got = jaccard_join.common_counts(lists)
    assert all(got[a, b] == len(set(lists[a]) & set(lists[b])) for a in range(40) for b in range(40))


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)] + [(900, k) for k in range(901, 940)]
    root = {}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for d in sorted(near):
        stack = [d] if d not in root else []
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = d
                stack += near[x]
    got = {r.a: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: r for a, r in root.items() if a != r}


def nearest_by_hand(rows, top, every):
    good = {i: v for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    out = {}
    for q in good:
        if q % every == 0:
            out[q] = sorted(((-float(np.dot(good[q], v)), i) for i, v in good.items() if i != q))[:top]
    return out


def test_nearest(spark, monkeypatch):
    rnd = np.random.RandomState(5)
    rows = [(k, [float(x) for x in rnd.randn(8).astype(np.float32)]) for k in range(900)]
    rows += [(1_000 + k, rows[7][1]) for k in range(60)] + [(2_000, [0.0] * 8), (2_020, None), (2_040, [1.0] * 7 + [None]), (2_060, [1.0] * 7 + [float("nan")]), (2_080, [1.0] * 7), (None, [1.0] * 8), (0, rows[0][1]), (2_100, [float("inf")] * 8)]
    table = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, node long")
    monkeypatch.setattr(neighbours, "CHUNK", 200)
    want = nearest_by_hand(rows, 20, 20)
    got = {}
    for r in neighbours.nearest(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21)) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert i != q and abs(s - np.dot(dict(rows)[q], dict(rows)[i])) < 1e-6
        hit += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hit >= 0.9 * 20 * len(want)
    few = neighbours.nearest(table.filter("vec_id < 5")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert neighbours.nearest(table.filter("false")).count() == 0


def test_pipeline_equals_its_stages_by_hand(spark):
    docs = materialize(read_table(spark, SF, "documents"), "pipeline-test")
    seen = docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        seen = out[name] = materialize(stage(spark, seen, SF), name)
    model = toxicity.learn(docs, read_table(spark, SF, "labels"))
    clean = [(r.doc_id, r.text) for r in docs.collect() if model.score(r.text) < 0.3]
    _, _, root = jaccard_by_hand(clean)
    single = [(d, t) for d, t in clean if root[d] == d]
    assert {r.doc_id for r in out["near_duplicates"].collect()} == {d for d, _ in single}
    want = removed_by_hand(single, 50)
    cut = {d: t if len(want[d, t]) == len(t.encode().split()) else b" ".join(want[d, t]).decode() for d, t in single}
    assert {r.doc_id: r.text for r in out["substrings"].collect()} == cut
    queries = [secret_scan.trigram_query(r.pattern, r.any_case) for r in secret_scan.RULES]
    masked = {d: secret_scan.masked(t, s) for (d, t), s in zip(cut.items(), secret_scan.scan_texts(list(cut.values()), secret_scan.RULES, queries))}
    assert {r.doc_id: r.text for r in out["secrets"].collect()} == masked
    assert all(out[name].columns == docs.columns for name, _ in corpus_pipeline.STAGES[:-1])
    lengths = {r.doc_id: r.doc_tokens for r in out["packing"].collect()}
    assert lengths.keys() == masked.keys()
    direct = packing.pack(out["secrets"], byte_bpe())
    assert {r.doc_id: r.doc_tokens for r in direct.collect()} == lengths


def test_one_row_of_a_group_whatever_the_columns(spark):
    """Columns named like helpers keep values and types; maps, also inside arrays, have an order of their own."""
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long, "x", "y", {"a": 2}, [{"b": 1}]), (1, long, "x", "y", {"a": 1}, [{"b": 1}]), (2, long + " more", "p", "q", None, None), (3, "other text " * 9, "r", None, {"z": 1}, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, __text string, m map<string,int>, n array<map<string,int>>").repartition(3)
    got = jaccard_join.keep_one_each(df)
    assert got.schema == df.schema
    assert sorted((r.doc_id, r["__id"], r["__text"], r.m["a"] if r.doc_id == 1 else None) for r in got.collect()) == [(1, "x", "y", 1), (3, "r", None, None)]
