"""Jaccard self-join of word n-gram sets by chosen paths.

A run splits all sets: a set follows each of its tokens t for which hash(run, level, t) is below
1/(threshold x size), so it takes 1/threshold paths on average, and two sets of at least that
similarity share one or more paths on average.  Nodes with one set are dropped, small ones are settled
by brute force, large ones are split again by further tokens.  At the deepest level what is still
large is brute-forced in blocks, so that no task holds a whole node.  Runs are repeated until a
pair at the threshold is met with the target probability.  A 64-byte sketch drops sets without a
possible partner in a node; what is left is compared exactly.

Pairs are never written out in nodes: a pair counts only in the smallest node that both sets reached,
and a node gives each set its number of links and its local component.  Sets with the same tokens are
one class from the start, whatever their number.

Tokens are runs of `n` words (64-bit hashes); a text with fewer words is one token.  Defined results:
texts without words (and nulls) have no token: each is a class of its own without links; so are rows
with a null doc_id, with a null class; rows that repeat a doc_id count as further copies, or, with
another text, as documents of that text's class; extra columns are ignored.  Classes are known by a
64-bit hash of their tokens; doc_ids only name them.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, ids_and_texts, materialize, mix, per_batch, shingle_hashes, word_hashes, words_of
from .components import components

N, THRESHOLD, RECALL = 5, 0.8, 0.999
LEVELS = 3
#: A node with more sets is split by further tokens; at the deepest level it is compared in blocks.
#: Comparing 2,048 sketches takes less than sending as many sets through another level would.
LEAF, BLOCK = 2_048, 2_048
SKETCH = 64
MULTIPLIERS = np.random.RandomState(5_040).randint(1 << 62, size=1_024, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def meeting_chance(levels: int) -> float:
    """Least probability that a pair at the threshold still shares a path after so many levels."""
    q = 1.0
    for _ in range(levels):
        q = 1 - math.exp(-q)
    return q


def runs_for(recall: float, levels: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting_chance(levels)))


def least_equal(threshold: float) -> int:
    """Equal sketch bytes that a pair needs: 4 standard deviations below those of the threshold."""
    return math.floor(SKETCH * threshold - 4 * math.sqrt(SKETCH * threshold * (1 - threshold)))


def tokens_of(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct tokens."""
    hashes = word_hashes(words_of(text))
    if 0 < len(hashes) < n:
        # shorter texts: the word count goes in, so they never equal a token of n words by construction
        return mix(np.array([len(hashes)], np.uint64) + shingle_hashes(hashes, len(hashes)))
    return np.unique(shingle_hashes(hashes, n))


def paths_of(tokens: np.ndarray, runs: int, levels: int, threshold: float) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(sketch, column number run*levels+level of each chosen token, its path key)."""
    columns = SKETCH + runs * levels
    limit = np.uint64(min(2.0 ** 64 - 2049, 2.0 ** 64 / (threshold * len(tokens))))
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    where, keys = [], []
    for at in range(0, len(tokens), 2_048):
        some = tokens[at:at + 2_048]
        spread = some[:, None] * MULTIPLIERS[:columns]
        least = np.minimum(least, spread[:, :SKETCH].min(0))
        row, column = np.nonzero(spread[:, SKETCH:] < limit)
        where.append(column)
        keys.append(mix(some[row] ^ MULTIPLIERS[-1 - column]))
    return (mix(least) & np.uint64(0xFF)).astype(np.uint8).tobytes(), np.concatenate(where), np.concatenate(keys).view(np.int64)


#: With the doc_id, it tells rows with different texts apart.
def text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def scan(docs: DataFrame, n: int, runs: int, levels: int, threshold: float) -> DataFrame:
    """doc_id, hash of the text, digest of the token set, size, sketch, columns and keys of the chosen paths."""
    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            digest, size, sketch, where, keys = [], [], [], [], []
            for text in b.column(1).to_pylist():
                tokens = tokens_of(text, n)
                s, w, k = paths_of(tokens, runs, levels, threshold) if len(tokens) else (b"", [], [])
                digest.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                size.append(len(tokens))
                sketch.append(s)
                where.append(w)
                keys.append(k)
            return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text_key": b.column(2), "digest": pa.array(digest, pa.binary()), "size": pa.array(size, pa.int64()), "sketch": pa.array(sketch, pa.binary()),
                                               "columns": pa.array(where, pa.list_(pa.int32())), "keys": pa.array(keys, pa.list_(pa.int64()))})
        return work
    return per_batch(ids_and_texts(docs, text_key().alias("text_key")), make, "doc_id long, text_key long, digest binary, size long, sketch binary, columns array<int>, keys array<bigint>")


def leaves(classes: DataFrame, levels: int) -> DataFrame:
    """Nodes that are compared: node, class_id, parts (1, or the number of blocks of a large node)."""
    chosen = classes.select("class_id", F.explode(F.arrays_zip("columns", "keys")).alias("p")).select(
        "class_id", F.expr(f"p.columns div {levels}").cast("int").alias("run"), (F.col("p.columns") % levels).alias("level"), F.col("p.keys").alias("key"))
    chosen = materialize(chosen, "join-paths")
    now = chosen.filter("level = 0").select("class_id", "run", F.xxhash64("run", "key").alias("node"))
    out = None
    for level in range(levels):
        counts = now.groupBy("node").agg(F.count("*").alias("sets")).filter("sets > 1")
        sized = materialize(now.join(counts, "node"), "join-nodes")
        last = level == levels - 1
        done = sized.filter("true" if last else f"sets <= {LEAF}").select("node", "class_id", F.ceil(F.col("sets") / BLOCK).cast("int").alias("parts"))
        out = done if out is None else out.unionByName(done)
        if not last:
            deeper = chosen.filter(F.col("level") == level + 1).select("class_id", "run", "key")
            now = sized.filter(f"sets > {LEAF}").join(deeper, ["class_id", "run"]).select("class_id", "run", F.xxhash64("node", "key").alias("node"))
    return out.distinct()


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of a split node go to every cell of their block's row or column of the block triangle."""
    block = F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")
    wide = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return wide.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")


def groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Rows that agree in the first `key` columns, from batches sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if held and held[0][:key] != r[:key]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def by_cell(rows: DataFrame, order: str = "class_id") -> DataFrame:
    return rows.repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi", order)


LIVE = "node long, lo int, hi int, block int, class_id long, parts int, sig binary"


def alive(rows: DataFrame, threshold: float) -> DataFrame:
    """Sets that, by size and sketch, may have a partner in their cell.  sig: the cell's live sets."""
    least = least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in groups(batches, 3):
            if len(g) < 2:
                continue
            size = np.array([r[6] for r in g], float)
            block = np.array([r[3] for r in g])
            sketch = np.frombuffer(b"".join(r[7] for r in g), np.uint8).reshape(len(g), SKETCH)
            live = np.zeros(len(g), bool)
            for at in range(0, len(g), 64):
                some = slice(at, at + 64)
                good = (sketch[some, None] == sketch[None]).sum(2) >= least
                good &= np.minimum(size[some, None], size[None]) >= threshold * np.maximum(size[some, None], size[None])
                rows_ = np.arange(at, min(at + 64, len(g)))
                good[rows_ - at, rows_] = False
                if g[0][1] != g[0][2]:
                    good &= block[some, None] != block[None]
                live[rows_] |= good.any(1)
            kept = [g[k] for k in np.flatnonzero(live).tolist()]
            sig = hashlib.blake2b(repr([r[4] for r in kept]).encode(), digest_size=16).digest()
            out += [(*r[:6], sig) for r in kept]
            if len(out) > 5_000:
                yield as_batch(out, LIVE)
                out = []
        yield as_batch(out, LIVE)
    return by_cell(rows).select("node", "lo", "hi", "block", "class_id", "parts", "size", "sketch").mapInArrow(run, LIVE)


KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_pydict({n: pa.array(c, KINDS[k]) for (n, k), c in zip(names, columns)})


def common_counts(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the lists (distinct values in each) have in common."""
    m = len(lists)
    lengths = [len(x) for x in lists]
    values, number = np.unique(np.concatenate(lists), return_inverse=True)
    owner = np.repeat(np.arange(m), lengths)
    df = np.bincount(number, minlength=len(values))
    out = np.zeros((m, m), np.int64)
    out[np.arange(m), np.arange(m)] = lengths
    # values of many lists: one matrix product over bounded column blocks; of few: their pairs
    many = np.flatnonzero(df > max(8, m // 16))
    place = np.full(len(values), -1)
    place[many] = np.arange(len(many))
    for at in range(0, len(many), 2_048):
        use = (place[number] >= at) & (place[number] < at + 2_048)
        hit = np.zeros((m, min(2_048, len(many) - at)), np.float32)
        hit[owner[use], place[number[use]] - at] = 1
        part = (hit @ hit.T).astype(np.int64)
        part[np.arange(m), np.arange(m)] = 0
        out += part
    few = (place[number] < 0) & (df[number] > 1)
    order = np.argsort(number[few], kind="stable")
    owners, numbers = owner[few][order], number[few][order]
    if len(numbers):
        cut = np.flatnonzero(np.diff(numbers)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(numbers)]])
        for step in range(1, int((last - first).max())):
            # pairs that are `step` places apart in the same value's list
            same = numbers[step:] == numbers[:-step]
            a, b = owners[:-step][same], owners[step:][same]
            np.add.at(out, (a, b), 1)
            np.add.at(out, (b, a), 1)
    return out


def local_roots(linked: np.ndarray, ids: list[int]) -> list[int]:
    """Smallest id of each one's component."""
    root = np.array(ids, np.int64)
    a, b = np.nonzero(linked)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        if (new == root).all():
            return root.tolist()
        root = new


COUNTED = "class_id long, linked_classes long, linked_copies long, root long"
PAIRS = "class_a long, class_b long, jaccard double"


def verify(rows: DataFrame, threshold: float, pairs: bool) -> DataFrame:
    """Exact comparison in every cell: counts and local components, or the pairs themselves."""
    schema = PAIRS if pairs else COUNTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in groups(batches, 3):
            if len(g) < 2:
                continue
            node, lo, hi = g[0][:3]
            ids = [r[4] for r in g]
            sets = [np.frombuffer(r[7], np.uint64) for r in g]
            size = np.array([len(s) for s in sets], float)
            both = common_counts(sets)
            jaccard = both / np.maximum(size[:, None] + size[None] - both, 1)
            linked = jaccard >= threshold
            np.fill_diagonal(linked, False)
            if lo != hi:
                block = np.array([r[3] for r in g])
                linked &= block[:, None] != block[None]
            earlier = [np.array([x for x in r[6] if x < node], np.int64) for r in g]
            once = linked & (common_counts(earlier) == 0) if any(map(len, earlier)) else linked
            if pairs:
                for a, b in zip(*np.nonzero(np.triu(once | once.T))):
                    out.append((min(ids[a], ids[b]), max(ids[a], ids[b]), float(jaccard[a, b])))
            else:
                copies = np.array([r[5] for r in g])
                n, c = once.sum(1), once @ copies
                out += list(zip(ids, n.tolist(), c.tolist(), local_roots(linked, ids)))
            if len(out) > 5_000:
                yield as_batch(out, schema)
                out = []
        yield as_batch(out, schema)
    return by_cell(rows).select("node", "lo", "hi", "block", "class_id", "copies", "nodes", "tokens").mapInArrow(run, schema)


def candidates(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their digest, classes, rows of all cells with the token sets)."""
    runs = runs_for(recall, LEVELS)
    rows = materialize(scan(docs, n, runs, LEVELS, threshold), "join-scan")
    full = rows.filter("doc_id IS NOT NULL AND size > 0")
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("label"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("size", "sketch", "columns", "keys")]).withColumn("class_id", F.xxhash64("digest")), "join-classes")
    spread = in_blocks(leaves(classes, LEVELS)).join(classes.select("class_id", "size", "sketch"), "class_id")
    live = materialize(alive(spread, threshold), "join-live")
    # nodes with the same live sets would compare the same pairs: one of them is enough
    whole = live.filter("parts = 1")
    best = whole.groupBy("sig").agg(F.min("node").alias("node"))
    kept = whole.join(best, ["sig", "node"]).select("node", "lo", "hi", "block", "class_id").unionByName(live.filter("parts > 1").select("node", "lo", "hi", "block", "class_id"))
    cells = kept.groupBy("class_id").agg(F.collect_set("node").alias("nodes"), F.collect_list(F.struct("node", "lo", "hi", "block")).alias("cells"))
    cells = cells.join(classes.select("class_id", "label", "copies", "digest"), "class_id")
    # a label is a doc_id of the class; rows that repeat it with another text have another digest
    texts = ids_and_texts(docs).join(cells, F.col("doc_id") == F.col("label")).select("class_id", "text", "digest", "copies", "nodes", "cells")
    return rows, classes, with_sets(texts, n)


CELLS = "node long, lo int, hi int, block int, class_id long, copies long, nodes array<bigint>, tokens binary"


def with_sets(texts: DataFrame, n: int) -> DataFrame:
    """One row per cell of a class, with its whole token set."""
    def make():
        def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = []
            for class_id, text, digest, copies, nodes, cells in zip(*(b.column(k).to_pylist() for k in range(6))):
                tokens = tokens_of(text, n).tobytes()
                if hashlib.blake2b(tokens, digest_size=16).digest() == digest:
                    out += [(c["node"], c["lo"], c["hi"], c["block"], class_id, copies, nodes, tokens) for c in cells]
            return as_batch(out, CELLS)
        return work
    return per_batch(texts, make, CELLS).dropDuplicates(["node", "lo", "hi", "class_id"])


def linked_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """class_a, class_b, jaccard of the links between different texts; for tables where these are few.

    Classes are named by their smallest doc_id.
    """
    _, classes, cells = candidates(docs, n, threshold, recall)
    named = classes.select("class_id", "label")
    pairs = verify(cells, threshold, True)
    for side in ("a", "b"):
        pairs = pairs.join(named.select(F.col("class_id").alias(f"class_{side}"), F.col("label").alias(side)), f"class_{side}")
    return pairs.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "jaccard")


def grouped(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """The rows of near_duplicates with text_key, digest and root, the key of the group (null without tokens)."""
    rows, classes, cells = candidates(docs, n, threshold, recall)
    found = materialize(verify(cells, threshold, False), "join-links")
    links = found.groupBy("class_id").agg(F.sum("linked_classes").alias("n_link_classes"), F.sum("linked_copies").alias("linked_copies"))
    roots = materialize(components(found.filter("root <> class_id").select(F.col("class_id").alias("a"), F.col("root").alias("b"))).select(F.col("a").alias("class_id"), "root"), "join-roots")
    members = roots.unionByName(roots.select(F.col("root").alias("class_id"), "root").distinct())
    lowest = members.join(classes.select("class_id", "label"), "class_id").groupBy("root").agg(F.min("label").alias("low"))
    named = members.join(lowest, "root")
    told = classes.select("digest", "class_id", "label", "copies").join(links, "class_id", "left").join(named, "class_id", "left").select(
        "digest", F.coalesce("root", "class_id").alias("root"), F.coalesce("low", "label").alias("class_id"), F.col("label").alias("copy_of"),
        (F.col("copies") - 1 + F.coalesce("linked_copies", F.lit(0))).alias("n_links"), F.coalesce("n_link_classes", F.lit(0)).alias("n_link_classes"))
    usable = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    keyed = rows.select("doc_id", "text_key", F.col("size").alias("n_tokens"), F.when(usable, F.col("digest")).alias("digest"))
    return keyed.join(told, "digest", "left")


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document.

    class_id: smallest doc_id of the group connected by links or copies; copy_of: smallest doc_id with
    the same token set; n_links: documents linked to it, copies included; n_link_classes: different
    token sets linked to its own; n_tokens.
    """
    return grouped(docs, n, threshold, recall).select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_link_classes", F.lit(0)).alias("n_link_classes"), "n_tokens")


def keep_one_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each group: of the smallest doc_id and, where that has several texts or rows in the
    group, of the smallest digest, text hash and values.  Rows without tokens or without a doc_id stay.
    """
    key = ["doc_id", "text_key"]
    texts = materialize(grouped(docs, n, threshold, recall).filter("root IS NOT NULL").groupBy("root", "digest", *key).agg(F.count("*").alias("n")), "join-texts")
    first = texts.groupBy("root").agg(F.min(F.struct("doc_id", "digest", "text_key")).alias("f")).select("root", "f.doc_id", "f.digest", "f.text_key", F.lit(True).alias("stays"))
    fate = texts.join(first, ["root", "digest", *key], "left")
    row_id, row_text = free_name(docs, "__id"), free_name(docs, "__text")
    keyed = docs.withColumns({row_id: F.col("doc_id").cast("long"), row_text: text_key()})
    asked = [F.col("doc_id").alias(row_id), F.col("text_key").alias(row_text)]
    out = keyed.join(fate.filter("stays IS NULL OR n > 1").select(*asked), [row_id, row_text], "left_anti").select(*docs.columns)
    several = materialize(fate.filter("stays AND n > 1").select(*asked), "join-several")
    if several.isEmpty():
        return out
    # written first, so that repeats meet by partial results and not in the task of the join
    repeats = materialize(keyed.join(several, [row_id, row_text], "left_semi"), "join-repeats")
    # maps and variants, also inside other types, have no order: their JSON text has
    order = [F.to_json(F.struct(c)) if any(x in docs.schema[c].dataType.simpleString() for x in ("map<", "variant")) else F.col(c) for c in docs.columns]
    ones = repeats.groupBy(row_id, row_text).agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("row")).select("row.*")
    return out.unionByName(ones)
