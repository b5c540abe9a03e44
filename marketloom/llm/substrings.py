"""Exact removal of passages that repeat across documents, by prefix-partitioned suffix trees.

A window is `window` consecutive words.  A word goes if a window over it also starts in a document
with a smaller doc_id; windows are judged on the input.

1. Prefixes.  Only suffixes that share a prefix can share a window, so suffixes are grouped by
   prefixes.  The prefix of a window is not its first words but the seed (a run of `seed` words)
   with the smallest hash inside the window: equal windows choose the same seed at the same place,
   and neighbouring windows mostly choose one seed together, so one row carries them all.
2. Memory-sized groups.  Seeds that only one document has are dropped.  A seed with more than
   `group` occurrences is split by a salt of the occurrence; a task bundles many small groups.
3. Subtrees.  In a bundle all suffixes are sorted by prefix doubling down to depth `window`: runs of
   equal rank are the subtree's internal nodes of that depth or deeper, and all leaves below one
   share the window.  The smallest doc_id of the node decides the others.
4. Split groups leave open only each node's smallest document; those meet by the digest of the window
   (one row per node and part), aggregated before the shuffle.

Copies of a whole text are settled by their digest, so only the first of them enters the trees.

Defined results: null and empty texts have no words; rows with a null doc_id are kept whole and
remove nothing; rows that share a doc_id don't remove each other's words; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ids_and_texts, materialize, per_batch, shingle_hashes, word_hashes, words_of

WINDOW, SEED, GROUP = 50, 8, 1_000
#: Words in the bundle that one subtree pass takes; more only if a single group has more.
BUNDLE = 600_000
POSITION_BITS = np.uint64(30)
NOTHING = hashlib.sha256(b"").hexdigest()


def tag_of(digest: bytes) -> int:
    """Tells rows of one doc_id apart."""
    return int.from_bytes(digest[:8], "little", signed=True)


def chosen_seeds(words: list[bytes], window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the seed, first window, windows) for each run of windows that choose the same seed."""
    hashes = shingle_hashes(word_hashes(words), seed)
    windows, reach = len(words) - window + 1, window - seed + 1
    if windows <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    mask = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    # least over `reach` positions by doubling; the position in the low bits makes the leftmost win
    have = 1
    while have * 2 <= reach:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < reach:
        least = np.minimum(least[:len(least) - (reach - have)], least[reach - have:])
    at = (least & mask).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return hashes[at[first]].view(np.int64), first, np.diff(np.concatenate([first, [windows]]))


def scan(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """doc_id, tag, n_words, digest (sha256 of the words joined by one space), seeds (one per run)."""
    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            tags, n, digests, seeds = [], [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                digest = hashlib.sha256(b" ".join(words)).digest()
                tags.append(tag_of(digest))
                n.append(len(words))
                digests.append(digest)
                seeds.append(chosen_seeds(words, window, seed)[0])
            return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "tag": pa.array(tags, pa.int64()), "n_words": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()), "seeds": pa.array(seeds, pa.list_(pa.int64()))})
        return work
    return per_batch(ids_and_texts(docs), make, "doc_id long, tag long, n_words long, digest binary, seeds array<bigint>")


CONTEXT = "seed long, salt int, parts int, doc_id long, tag long, start long, windows int, words binary"


def contexts(found: DataFrame, window: int, seed: int, group: int) -> DataFrame:
    """One row per occurrence of a shared seed: the words of all windows that choose it."""
    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            doc_id, text, shared, many = (b.column(k).to_pylist() for k in range(4))
            for d, t, s, n in zip(doc_id, text, shared, many):
                words = words_of(t)
                tag = tag_of(hashlib.sha256(b" ".join(words)).digest())
                counts = dict(zip(s, n))
                for h, first, windows in zip(*(x.tolist() for x in chosen_seeds(words, window, seed))):
                    if h in counts:
                        parts = -(-counts[h] // group)
                        salt = hash((d, first)) % parts
                        rows.append((h, salt, parts, d, tag, first, windows, b" ".join(words[first:first + windows + window - 1])))
            columns = list(zip(*rows)) or [[]] * 8
            names = [x.split() for x in CONTEXT.split(", ")]
            kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
            return pa.RecordBatch.from_pydict({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns)})
        return work
    return per_batch(found, make, CONTEXT)


def depth_nodes(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Number of the depth-`window` node above each suffix in `starts`.

    `words` are word numbers, texts one after the other.  Prefix doubling: the rank of a suffix down to
    depth 2k comes from its rank to depth k and that of the suffix k words on.
    """
    rank, depth = words, 1
    while depth * 2 <= window:
        pair = rank[:-depth] * (int(rank.max()) + 1) + rank[depth:]
        rank = np.unique(pair, return_inverse=True)[1]
        depth *= 2
    rest = window - depth
    return np.unique(rank[starts] * (int(rank.max()) + 1) + rank[starts + rest], return_inverse=True)[1]


def subtree(rows: list[tuple], window: int) -> Iterator[tuple]:
    """Rows of whole groups -> (open, doc_id, tag, start, node digest): windows that are settled as
    repeats, and, of split groups, those that only a smaller document in another part could settle."""
    number: dict[bytes, int] = {}
    texts = [r[7].split(b" ") for r in rows]
    words = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    lengths = np.array([len(t) for t in texts])
    counts = np.array([r[6] for r in rows])
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    # a window never runs over the end of its text, so texts need no separators
    row = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    # the seed is part of the node: windows of different groups are never compared
    seeds = np.unique([r[0] for r in rows], return_inverse=True)[1]
    node = depth_nodes(words, begin[row] + offset, window)
    node = np.unique(node * (int(seeds.max()) + 1) + seeds[row], return_inverse=True)[1]
    doc = np.array([r[3] for r in rows], np.int64)[row]
    first = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, node, doc)
    repeated = doc > first[node]
    split = np.array([r[2] > 1 for r in rows])[row]
    for k in np.flatnonzero(repeated).tolist():
        r = rows[row[k]]
        yield False, r[3], r[4], r[5] + int(offset[k]), None
    for k in np.flatnonzero(~repeated & split).tolist():
        r = rows[row[k]]
        o = int(offset[k])
        yield True, r[3], r[4], r[5] + o, hashlib.blake2b(b" ".join(texts[row[k]][o:o + window]), digest_size=16).digest()


SETTLED = "open boolean, doc_id long, tag long, start long, length int, node binary"


def runs(found: Iterator[tuple]) -> pa.RecordBatch:
    """Settled windows of a document that follow each other become one row."""
    out: list[list] = []
    for is_open, d, tag, start, node in found:
        if out and not is_open and not out[-1][0] and out[-1][1:3] == [d, tag] and out[-1][3] + out[-1][4] == start:
            out[-1][4] += 1
        else:
            out.append([is_open, d, tag, start, 1, node])
    columns = list(zip(*out)) or [[]] * 6
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_pydict({x.split()[0]: pa.array(c, k) for x, c, k in zip(SETTLED.split(", "), columns, kinds)})


def trees(rows: DataFrame, window: int) -> DataFrame:
    """Suffix subtrees over bundles of whole groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(8))):
                key = r[:2]
                if size > BUNDLE and key != last:
                    yield runs(subtree(held, window))
                    held, size = [], 0
                held.append(r)
                size += r[6] + window - 1
                last = key
        if held:
            yield runs(subtree(held, window))
    grouped = rows.repartition(F.col("seed"), F.col("salt")).sortWithinPartitions("seed", "salt", "doc_id", "start")
    return grouped.mapInArrow(run, SETTLED)


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED, group: int = GROUP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row per document with its copies' first doc_id, texts that have shared seeds, repeated windows).

    The last has doc_id, tag, start, length: runs of windows that also start in a smaller document.
    """
    rows = materialize(scan(docs, window, seed), "substring-scan")
    named = rows.filter("doc_id IS NOT NULL")
    first = named.filter(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("first"))
    heads = named.join(first, "digest").filter("doc_id = first").dropDuplicates(["doc_id", "tag"])
    each = heads.select("doc_id", "tag", F.explode("seeds").alias("seed"))
    counts = each.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("seed", "n")
    # written first, so that both sides of the join are dealt anew and a hot seed's rows can be split
    shared = materialize(counts, "substring-seeds")
    per_doc = each.join(shared, "seed").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("seed", "n")).alias("shared"))
    per_doc = per_doc.select("doc_id", "tag", F.col("shared.seed").alias("seeds"), F.col("shared.n").alias("many"))
    texts = ids_and_texts(docs).filter("doc_id IS NOT NULL").join(per_doc.select("doc_id", "seeds", "many", "tag"), "doc_id")
    found = materialize(texts, "substring-texts")
    settled = materialize(trees(contexts(found.select("doc_id", "text", "seeds", "many"), window, seed, group), window), "substring-windows")
    opened = settled.filter("open")
    smallest = opened.groupBy("node").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("node", "lo")
    across = opened.join(smallest, "node").filter("doc_id > lo").select("doc_id", "tag", "start", "length")
    return rows.join(first, "digest", "left"), found, settled.filter("NOT open").select("doc_id", "tag", "start", "length").unionByName(across)


CUT = "doc_id long, tag long, n_removed long, kept_sha256 string"


def kept_words(words: list[bytes], starts: list[int], lengths: list[int], window: int) -> list[bytes]:
    """The words that no window covers; windows start at start, start+1 .. start+length-1 of each run."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.array(starts, np.int64), 1)
    np.add.at(edge, np.array(starts, np.int64) + np.array(lengths, np.int64) + window - 1, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def without(found: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, n_removed and the digest of what is kept, of the texts that have repeated windows."""
    per_doc = windows.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "length")).alias("runs"))
    per_doc = per_doc.select("doc_id", "tag", F.col("runs.start").alias("starts"), F.col("runs.length").alias("lengths"))

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            doc_id, text, tags, starts, lengths = (b.column(k).to_pylist() for k in range(5))
            for d, t, tag, s, n in zip(doc_id, text, tags, starts, lengths):
                words = words_of(t)
                if tag_of(hashlib.sha256(b" ".join(words)).digest()) != tag:
                    continue
                kept = kept_words(words, s, n, window)
                out.append((d, tag, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_pydict({x.split()[0]: pa.array(c, k) for x, c, k in zip(CUT.split(", "), columns, kinds)})
        return work
    # text and tag of one row: other rows of the same doc_id fall out by their tag
    return per_batch(found.select("doc_id", "text", "tag").join(per_doc, ["doc_id", "tag"]).select("doc_id", "text", "tag", "starts", "lengths"), make, CUT).dropDuplicates(["doc_id", "tag"])


def is_later_copy(window: int):
    return (F.col("n_words") >= window) & (F.col("doc_id") > F.col("first"))


def deduplicate(docs: DataFrame, window: int = WINDOW, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    rows, found, windows = repeated_windows(docs, window, seed, group)
    cut = without(found, windows, window)
    joined = rows.join(cut, ["doc_id", "tag"], "left")
    late = F.coalesce(is_later_copy(window), F.lit(False))
    return joined.select(
        "doc_id", "n_words", F.when(late, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(late, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"))


def cut_texts(docs: DataFrame, window: int = WINDOW, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """The documents with repeated passages cut out of their texts; what loses nothing stays as it is.

    A text that loses words becomes its kept words joined by one space; n_chars, where present, is
    counted anew for it.
    """
    rows, _, windows = repeated_windows(docs, window, seed, group)
    parts = windows.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "length")).alias("runs")).withColumn("whole", F.lit(False))
    late = rows.filter(is_later_copy(window)).select("doc_id", "tag", F.expr("CAST(array() AS array<struct<start: bigint, length: int>>) AS runs"), F.lit(True).alias("whole")).dropDuplicates(["doc_id", "tag"])
    entry_id, entry = free_name(docs, "cut_id"), free_name(docs, "cut_entries")
    entries = parts.unionByName(late).groupBy(F.col("doc_id").alias(entry_id)).agg(F.collect_list(F.struct("tag", "whole", F.col("runs.start").alias("start"), F.col("runs.length").alias("length"))).alias(entry))
    joined = docs.join(entries, docs.doc_id.cast("long") == F.col(entry_id), "left").select(*docs.columns, entry)
    names, at = docs.columns, docs.columns.index("text")
    chars = names.index("n_chars") if "n_chars" in names and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint") else None

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(at).to_pylist()
            counts = b.column(chars).to_pylist() if chars is not None else [None] * len(texts)
            for k, found in enumerate(b.column(len(names)).to_pylist()):
                if not found:
                    continue
                words = words_of(texts[k])
                tag = tag_of(hashlib.sha256(b" ".join(words)).digest())
                for e in found:
                    if e["tag"] == tag:
                        texts[k] = "" if e["whole"] else b" ".join(kept_words(words, e["start"], e["length"], window)).decode()
                        counts[k] = len(texts[k])
            new = {at: texts} if chars is None else {at: texts, chars: counts}
            columns = [pa.array(new[k], b.column(k).type) if k in new else b.column(k) for k in range(len(names))]
            return pa.RecordBatch.from_arrays(columns, names=names)
        return work
    return per_batch(joined, make, docs.schema)
