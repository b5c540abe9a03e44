"""Ranked lexical search by hashed max-sketches: the best documents of every item, exactly.

A term's weight follows from the number of documents that hold it, a term's impact in a document from
its occurrences and the document's length; the score is the sum of weight times impact over the
item's terms.  Two passes over all documents:

1. Documents with a term, terms in all, and documents holding each of the items' terms: sums per task,
   added up by Spark.
2. Each document's impacts fold into a sketch of `COORDINATES` hashed coordinates, each the maximum of
   the impacts that fall there.  An item's weights, summed by coordinate, times the sketch is an upper
   bound of the score: terms that share a coordinate can only raise it.  The bounds of a block of
   documents and all items are one matrix product.  Per item the documents of the block are rescored
   exactly by descending bound, until the bound is below the score of the last place; that threshold
   goes on from block to block of a task.  What a task leaves is its best documents of each item, and
   two rounds of ranks (by item and a share of the tasks, then by item) make them the best of all.

No key of the documents is grouped or joined, so a hot source or group of copies changes nothing, and a
lost task is run again by itself.  Items are the stated query set: their terms are broadcast in blocks
of at most `MOST_PAIRS` (item, term) pairs on average and one pass each; the terms of one item must
fit into a task.  All numbers are whole; the products in bounds stay below 2**53 and are exact.

Defined results: a null or empty text has no terms and ranks nowhere, and an item without terms has no
rows; rows that share a doc_id rank one by one; equal scores are in ascending doc_id, null last; rows that
share an item_id are one item with the terms of all its different texts, null item_id being such an item;
extra columns are ignored.
"""
from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import halves, ids_and_texts, materialize
from .decontaminate import folded_words

COORDINATES = 4096
#: Documents whose sketches and bounds are in memory at a time.
BLOCK = 256
MOST_PAIRS, MOST_ITEMS = 250_000, 1024
#: Shares of the tasks whose best documents are ranked before those of all tasks.
SHARES = 64
RANKED = "item_id long, doc_id long, score long"

#: Bytes of UTF-8: A-Z become a-z, what separates terms becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def length_factor(n: int, documents: int, terms: int) -> int:
    return 100 - 25 + (25 * n * documents) // terms


def impact(tf, m):
    """Of a term that occurs tf times in a document of length factor m; numbers or arrays."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def coordinates(terms, width: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms), np.int64) % width


@dataclass(frozen=True)
class Queries:
    """A block of items, weighted: exact terms per item, and the matrix of weights by used coordinate."""

    ids: list
    exact: list[dict[bytes, int]]
    place: np.ndarray  # of each coordinate in the matrix, -1 if no item uses it
    matrix: np.ndarray
    documents: int
    terms: int

    @classmethod
    def of(cls, counts: dict[object, dict[bytes, int]], holding: dict[bytes, int], documents: int, terms: int, width: int = COORDINATES) -> Queries:
        exact = [{t: n * w for t, n in x.items() if t in holding and (w := weight(documents, holding[t]))} for x in counts.values()]
        where = [coordinates(x, width) for x in exact]
        used = np.unique(np.concatenate([*where, np.empty(0, np.int64)]))
        place = np.full(width, -1)
        place[used] = np.arange(len(used))
        matrix = np.zeros((len(used), len(exact)))
        for k, (x, at) in enumerate(zip(exact, where)):
            np.add.at(matrix[:, k], place[at], np.fromiter(x.values(), float, len(x)))
        return cls(list(counts), exact, place, matrix, documents, terms)


def sketches(counters: list[Counter], m: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """One row per document: the largest impact at each coordinate that some item uses."""
    rows = np.repeat(np.arange(len(counters)), [len(c) for c in counters])
    at = place[coordinates((t for c in counters for t in c), len(place))]
    tf = np.fromiter((n for c in counters for n in c.values()), np.int64, len(rows))
    asked = at >= 0
    out = np.zeros((len(counters), width))
    np.maximum.at(out, (rows[asked], at[asked]), impact(tf, m[rows])[asked].astype(float))
    return out


class Best:
    """The best documents of each item so far: heaps whose root is the last place."""

    def __init__(self, queries: Queries, top: int):
        self.queries, self.top, self.rescored = queries, top, 0
        self.heaps: list[list[tuple]] = [[] for _ in queries.ids]
        #: bound that a document needs: 1 while places are free, then the score of the last place
        self.needs = np.ones(len(queries.ids))

    def add(self, ids: list, texts: list) -> None:
        q = self.queries
        rows = [(d, Counter(t), len(t)) for d, t in zip(ids, map(terms_of, texts)) if t]
        if not rows:
            return
        m = np.array([length_factor(n, q.documents, q.terms) for _, _, n in rows], np.int64)
        bounds = sketches([c for _, c, _ in rows], m, q.place, len(q.matrix)) @ q.matrix
        for item in np.flatnonzero((bounds >= self.needs).any(0)):
            self.rescore(item, bounds[:, item], rows, m)

    def rescore(self, item: int, bounds: np.ndarray, rows: list[tuple], m: np.ndarray) -> None:
        """Exact scores by descending bound until no bound reaches the last place."""
        exact, heap = self.queries.exact[item], self.heaps[item]
        some = np.flatnonzero(bounds >= self.needs[item])
        for k in some[np.argsort(-bounds[some], kind="stable")].tolist():
            if bounds[k] < self.needs[item]:
                return
            self.rescored += 1
            d, counter, _ = rows[k]
            length = int(m[k])
            score = sum(exact[t] * impact(counter[t], length) for t in exact.keys() & counter.keys())
            if score:
                entry = (score, d is not None, -(d or 0))
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == self.top:
                    self.needs[item] = heap[0][0]

    def batch(self) -> pa.RecordBatch:
        found = [(i, -d if known else None, s) for i, heap in zip(self.queries.ids, self.heaps) for s, known, d in heap]
        return pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in found], pa.int64()) for k, n in enumerate(("item_id", "doc_id", "score"))})


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for part in halves(batch):
            for at in range(0, part.num_rows, BLOCK):
                block = part.slice(at, BLOCK)
                yield block.column(0).to_pylist(), block.column(1).to_pylist()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, n: terms of the items with repeats; the texts of an item_id are put together."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return texts.select("item_id", F.explode(folded_words(F.col("text"))).alias("term")).groupBy("item_id", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("n"))


def corpus_counts(docs: DataFrame, terms: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and the documents that hold each of the given terms."""
    asked = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, documents, n = Counter(), 0, 0
        for _, texts in in_blocks(batches):
            for words in map(terms_of, texts):
                documents += bool(words)
                n += len(words)
                told.update(asked.value & set(words))
        yield pa.RecordBatch.from_pydict({"term": pa.array([None, *told], pa.binary()), "documents": pa.array([documents, *told.values()], pa.int64()), "terms": pa.array([n] + [0] * len(told), pa.int64())})
    sums = docs.mapInArrow(run, "term binary, documents long, terms long").groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect()  # the given terms at most
    whole = next((r for r in sums if r.term is None), None)
    return (whole.documents if whole else 0, whole.terms if whole else 0, {bytes(r.term): r.documents for r in sums if r.term is not None})


def best_of_tasks(docs: DataFrame, queries: Queries, top: int) -> DataFrame:
    """The best documents of each item in each task."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value, top)
        for ids, texts in in_blocks(batches):
            best.add(ids, texts)
        yield best.batch()
    return docs.mapInArrow(run, RANKED)


def ranked(found: DataFrame, top: int, *more: str) -> DataFrame:
    order = Window.partitionBy("item_id", *more).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0."""
    spark = docs.sparkSession
    pairs = materialize(item_terms(items), "search-terms")
    size = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("-"))).alias("items")).first()
    blocks = max(1, math.ceil(size.pairs / MOST_PAIRS), math.ceil(size.items / MOST_ITEMS))
    texts = ids_and_texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    found = None
    for block in range(blocks):
        counts: dict[object, dict[bytes, int]] = {}
        for r in pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():  # a block of the query set
            counts.setdefault(r.item_id, {})[bytes(r.term)] = r.n
        if counts:
            documents, terms, holding = corpus_counts(texts, set().union(*counts.values()))
            part = best_of_tasks(texts, Queries.of(counts, holding, documents, terms), top)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], RANKED)
    shares = ranked(found.withColumn("share", F.spark_partition_id() % SHARES), top, "share").drop("rank", "share")
    return ranked(shares, top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
