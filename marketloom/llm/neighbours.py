"""Approximate nearest neighbours by inner product: NN-descent graph, greedy graph search.

Graph.  Each vector starts with its best `k` among its chunks: one random chunk, and one cell of each
of `DRAWS` draws of pivots (a vector is in the cell of the pivot it is nearest to by angle; a cell
much larger than a chunk is cut at random).  Then rounds of joins: every node's list and a sample of
the lists it is in are brought together with their vectors, each two of those members are neighbours
of neighbours and are scored, and what beats a member's own worst neighbour is sent to it.  Rounds
end when at most one list entry in ten changes.

Search.  A query starts from its own list in the graph, expands its best nodes that are not yet
expanded, all that are open at once, and ends when its best `BEAM` nodes are all expanded.  A node's
neighbourhood and all queries that expand it meet once in each round.  Vectors are navigated by 8-bit
copies; the final candidates are scored in double precision on the original vectors.

Pivots are the only sample: at most 1,024 vectors for each draw and level, taken by the hash of the
id.  Every vector is in the graph.

Equal vectors are one node.  A result lists members of a node in ascending id; since only `top` rows
are asked for, the `top`+1 smallest ids of a node are enough, and they are whole.

Defined results: vectors that are null, zero, or hold a null or a non-finite component take no part,
nor do those of another dimension than most; rows with a null id take no part; a repeated id with one
vector is one row; fewer candidates than `top` give fewer rows; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

TOP = 20
K, CHUNK, DRAWS, SENT = 32, 1_024, 8, 10
#: Nodes that list a node, in its neighbourhood: while the graph is built, and in the search.
BACK, BACK_SEARCH = 16, 32
#: Smaller tables have smaller chunks: no chunk holds more than this share of the nodes, down to LEAST.
SHARE, LEAST, PIVOTS = 32, 64, 1_024
FEW_CHANGES = 0.1
BEAM = 512


# --- packed vectors and lists ---

def pack_vectors(x: np.ndarray) -> np.ndarray:
    """A row of bytes for each vector: a float32 scale and one signed byte per component."""
    scale = np.maximum(np.abs(x).max(1, keepdims=True), 1e-30) / 127
    return np.concatenate([scale.astype("<f4").view(np.int8), np.rint(x / scale).astype(np.int8)], 1)


def values_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins and the last ends."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8)[ends[0]:ends[-1]] if held is not None else np.empty(0, np.uint8), ends - ends[0]


def binary_of(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose values are the next counts[i] rows of `values`."""
    size = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    ends = np.concatenate([[0], np.cumsum(counts)]) * size
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def unpack_vectors(packed: np.ndarray, count: int) -> np.ndarray:
    raw = packed.view(np.int8).reshape(count, -1)
    return raw[:, 4:].astype(np.float32) * raw[:, :4].copy().view("<f4")


ENTRY = np.dtype([("id", "<i8"), ("score", "<f4")])


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the length."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def best_entries(node: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the k best distinct entries, score descending, then id: node, entry."""
    other = node != ids
    node, ids, scores = node[other], ids[other], scores[other]
    order = np.lexsort((-scores, ids, node))
    node, ids, scores = node[order], ids[order], scores[order]
    if len(node):
        first = np.concatenate([[True], (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])])
        node, ids, scores = node[first], ids[first], scores[first]
    order = np.lexsort((-scores, node))  # stable: ids ascend
    node = node[order]
    runs = runs_of(node)
    use = np.arange(len(node)) - np.repeat(runs[:-1], np.diff(runs)) < k
    entries = np.empty(int(use.sum()), ENTRY)
    entries["id"], entries["score"] = ids[order][use], scores[order][use]
    return node[use], entries


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the first column, in batches such that no value of it is in two of them."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield joined([*held, b.slice(0, last)])
            held = []
        elif held and held[0].column(0)[0].as_py() != keys[0]:
            yield joined(held)
            held = []
        held.append(b.slice(last))
    if held:
        yield joined(held)


LISTS = "node long, list binary"


def list_batch(node: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """Rows of LISTS; the entries of a node lie together."""
    runs = runs_of(node)
    return pa.RecordBatch.from_pydict({"node": pa.array(node[runs[:-1]], pa.int64()), "list": binary_of(entries, np.diff(runs))})


def entries_in(keys: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The key of every entry, the entries."""
    raw, ends = values_of(column)
    return np.repeat(keys, np.diff(ends) // ENTRY.itemsize), raw.view(ENTRY)


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "float": pa.float32()}
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_pydict({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns)})


# --- nodes ---

def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, vector (array of double) of the vectors that take part; repeated rows stay."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))
    rows = materialize(rows, "nn-rows")
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()  # one row per dimension
    return rows.filter(F.size("vector") == (sizes[0] if sizes else 0))


def nodes_of(rows: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """(node, vector), (node, members: the top+1 smallest ids of equal vectors)."""
    nodes = materialize(rows.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("rows")).select("node", "vector", "rows"), "nn-nodes")
    # ids of vectors in several rows: the smallest of each salted part, then of the parts
    keyed = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    wide = keyed.join(nodes.filter("rows > 1"), "vector").select("node", "salt", "vec_id").distinct()

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            out = []
            for node, salt, vec in zip(*(b.column(k).to_pylist() for k in range(3))):
                count = count + 1 if (node, salt) == last else 1
                last = (node, salt)
                if count <= top + 1:
                    out.append((node, vec))
            yield batch_of("node long, vec_id long", out)
    some = wide.repartition("node", "salt").sortWithinPartitions("node", "salt", "vec_id").mapInArrow(smallest, "node long, vec_id long")
    members = some.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, top + 1).alias("members"))
    alone = nodes.filter("rows = 1").select("node", F.array("node").alias("members"))
    return nodes.select("node", "vector"), materialize(members.unionByName(alone), "nn-members")


# --- graph ---

def packed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_pydict({"node": b.column(0), "vec": binary_of(pack_vectors(x), np.ones(b.num_rows, int))})
    return nodes.select("node", "vector").mapInArrow(run, "node long, vec binary")


def pivots_of(vectors: DataFrame, cells: int, draws: int) -> list[list[np.ndarray]]:
    """Directions of each draw and level: their numbers multiply to about `cells`, none above PIVOTS."""
    levels = 1
    while cells ** (1 / levels) > PIVOTS:
        levels += 1
    each = int(np.ceil(cells ** (1 / levels)))
    rows = vectors.orderBy(F.xxhash64("node", F.lit("pivot")), "node").select("vec").limit(each * levels * draws).collect()  # bounded
    x = unpack_vectors(np.frombuffer(b"".join(r["vec"] for r in rows), np.uint8), len(rows))
    x /= np.linalg.norm(x, axis=1, keepdims=True) + np.float32(1e-30)
    parts = np.array_split(x, draws * levels)
    return [parts[at * levels:(at + 1) * levels] for at in range(draws)]


def chunks_of(vectors: DataFrame, chunk: int, n: int) -> DataFrame:
    """chunk, node, vec: a row for the random chunk of each node and one for its cell of each draw."""
    cells = max(1, round(n / chunk))
    pivots = pivots_of(vectors, cells, DRAWS) if cells > 1 else []

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unpack_vectors(values_of(b.column(1))[0], b.num_rows)
            for at, levels in enumerate(pivots):
                cell = np.zeros(len(x), np.int64)
                for p in levels:
                    cell = cell * len(p) + np.concatenate([(x[k:k + 2048] @ p.T).argmax(1) for k in range(0, len(x), 2048)])
                yield pa.RecordBatch.from_pydict({"chunk": cell * DRAWS + at, "node": b.column(0), "vec": b.column(1)})
    drawn = vectors.select(-1 - F.pmod(F.xxhash64("node"), F.lit(cells)).alias("chunk"), "node", "vec").toDF("chunk", "node", "vec")
    if not pivots:
        return drawn.withColumn("piece", F.lit(0).cast("long"))
    near = vectors.select("node", "vec").mapInArrow(cells_of, "chunk long, node long, vec binary")
    large = near.groupBy("chunk").agg(F.count("*").alias("size")).filter(F.col("size") > 2 * chunk)
    if large.isEmpty():
        return drawn.unionByName(near).withColumn("piece", F.lit(0).cast("long"))
    pieces = F.coalesce(F.ceil(F.col("size") / chunk), F.lit(1).cast("long"))
    return drawn.unionByName(near).join(large, "chunk", "left").select("chunk", "node", "vec", F.pmod(F.xxhash64("node", "chunk"), pieces).alias("piece"))


def first_lists(vectors: DataFrame, k: int, chunk: int, n: int) -> DataFrame:
    """The k best of each chunk of a node, a row for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            piece, node, raw = b.column(1).to_numpy(), b.column(2).to_numpy(), values_of(b.column(3))[0]
            x = unpack_vectors(raw, b.num_rows)
            key = np.stack([b.column(0).to_numpy(), piece], 1)
            runs = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, e in zip(runs[:-1], runs[1:]):
                take = min(k, e - a - 1)
                for at in range(a, e, 2048):
                    own = node[at:min(at + 2048, e)]
                    if take <= 0:
                        yield pa.RecordBatch.from_pydict({"node": own, "list": binary_of(np.empty(0, ENTRY), np.zeros(len(own), int))})
                        continue
                    s = x[at:at + len(own)] @ x[a:e].T
                    s[np.arange(len(own)), np.arange(at - a, at - a + len(own))] = -np.inf
                    best = np.argpartition(s, e - a - take, 1)[:, e - a - take:]
                    entries = np.empty(best.shape, ENTRY)
                    entries["id"], entries["score"] = node[a:e][best], np.take_along_axis(s, best, 1)
                    yield pa.RecordBatch.from_pydict({"node": own, "list": binary_of(entries.ravel(), np.full(len(own), take))})
    # the chunk is a key of its own, so its size doesn't depend on the number of partitions
    return chunks_of(vectors, chunk, n).select("chunk", "piece", "node", "vec").repartition("chunk", "piece").sortWithinPartitions("chunk", "piece", "node").mapInArrow(run, LISTS)


def neighbours_in(lists: DataFrame) -> DataFrame:
    """One row per list entry: node, other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, entries = entries_in(b.column(0).to_numpy(), b.column(1))
            yield pa.RecordBatch.from_pydict({"node": node, "other": entries["id"].copy()})
    return lists.select("node", "list").mapInArrow(run, "node long, other long")


def neighbourhoods(lists: DataFrame, vectors: DataFrame, k: int, back: int) -> DataFrame:
    """center, node, vec, worst, sorted by the first two: the members are its list and a sample of about `back` of the nodes that list it."""
    forward = neighbours_in(lists)
    degree = forward.groupBy("other").agg(F.count("*").alias("degree"))
    rate = F.lit(float(back)) / F.col("degree") * (1 << 20)
    backward = forward.join(degree.hint("shuffle_hash"), "other").filter(F.pmod(F.xxhash64("node", "other"), F.lit(1 << 20)) < rate)
    pairs = forward.select(F.col("node").alias("center"), F.col("other").alias("node")).unionByName(backward.select(F.col("other").alias("center"), "node"))

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, ends = values_of(b.column(1))
            scores, counts = raw.view(ENTRY)["score"], np.diff(ends) // ENTRY.itemsize
            out = np.full(b.num_rows, -np.inf, np.float32)
            out[counts >= k] = scores[ends[1:][counts >= k] // ENTRY.itemsize - 1]  # best first
            yield pa.RecordBatch.from_pydict({"node": b.column(0), "worst": out})
    # the small side, a row for each node, is hashed: the pairs need no sort before the one by center
    told = vectors.join(lists.select("node", "list").mapInArrow(worst, "node long, worst float"), "node")
    return pairs.join(told.hint("shuffle_hash"), "node").select("center", "node", "vec", "worst").repartition("center").sortWithinPartitions("center", "node")


def members_in(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of whole neighbourhoods: center, node, packed vectors, worst; a member that came twice is there once."""
    center, node = b.column(0).to_numpy(), b.column(1).to_numpy()
    raw = values_of(b.column(2))[0].reshape(b.num_rows, -1)
    once = np.concatenate([[True], (center[1:] != center[:-1]) | (node[1:] != node[:-1])])
    return center[once], node[once], raw[once], b.column(3).to_numpy(zero_copy_only=False)[once]


def updates(around: DataFrame, k: int, sent: int) -> DataFrame:
    """For each member of a neighbourhood, the best of the other members that beat its worst neighbour."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            center, ids, raw, worst = members_in(b)
            x, runs, found = unpack_vectors(raw.ravel(), len(raw)), runs_of(center), []
            for at in range(0, len(runs) - 1, 128):
                starts, sizes = runs[at:at + 129][:-1], np.diff(runs[at:at + 129])
                most = int(sizes.max())
                place = np.arange(most)
                there = place < sizes[:, None]
                rows = np.where(there, starts[:, None] + place, starts[:, None])
                y = x[rows]
                s = y @ y.transpose(0, 2, 1)
                s[~np.broadcast_to(there[:, None, :], s.shape)] = -np.inf
                s[:, place, place] = -np.inf
                s = s.reshape(-1, most)
                good = s > np.where(there, worst[rows], np.inf).reshape(-1, 1)
                many = np.flatnonzero(good.sum(1) > sent)
                if len(many):
                    over = s[many]
                    good[many] &= over >= np.partition(over, most - sent, 1)[:, most - sent, None]
                r, c = np.nonzero(good)
                found.append((ids[rows.ravel()[r]], ids[rows[r // most, c]], s[r, c]))
            yield list_batch(*best_entries(*(np.concatenate(f) for f in zip(*found)), k))
    return around.mapInArrow(run, LISTS)


def merged(lists: DataFrame | None, more: DataFrame, k: int) -> DataFrame:
    """New lists and how many entries are new: node, list, changed."""
    rows = more.select("node", "list", F.lit(1).alias("late"))
    rows = rows if lists is None else lists.select("node", "list", F.lit(0).alias("late")).unionByName(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            keys, late = b.column(0).to_numpy(), b.column(2).to_numpy()
            own = keys[runs_of(keys)[:-1]]
            node, entries = entries_in(keys, b.column(1))
            was = np.repeat(late == 0, np.diff(values_of(b.column(1))[1]) // ENTRY.itemsize)
            now, best = best_entries(node, entries["id"], entries["score"], k)
            # an entry is kept if (node, id) was in the list before: equal neighbours once both are sorted
            both = np.concatenate([node[was], now]), np.concatenate([entries["id"][was], best["id"]])
            order = np.lexsort((both[1], both[0]))
            twice = np.flatnonzero((both[0][order][1:] == both[0][order][:-1]) & (both[1][order][1:] == both[1][order][:-1]))
            kept = np.bincount(np.searchsorted(own, both[0][order][twice]), minlength=len(own))
            counts = np.bincount(np.searchsorted(own, now), minlength=len(own))
            yield pa.RecordBatch.from_pydict({"node": own, "list": binary_of(best, counts), "changed": (counts - kept).astype(np.int32)})
    return rows.repartition("node").sortWithinPartitions("node", "late").mapInArrow(run, "node long, list binary, changed int")


def build_graph(vectors: DataFrame, k: int = K, chunk: int | None = None) -> DataFrame:
    """Neighbour lists (node, list) of packed vectors (node, vec), by NN-descent."""
    n = vectors.count()
    chunk = chunk or min(CHUNK, max(LEAST, n // SHARE))
    lists = materialize(merged(None, first_lists(vectors, k, chunk, n), k).select("node", "list"), "nn-lists")
    # lists only get better, so this ends
    while True:
        new = materialize(merged(lists, updates(neighbourhoods(lists, vectors, k, BACK), k, SENT), k), "nn-lists")
        changed, n = new.agg(F.sum("changed"), F.count("*")).first()  # one row
        lists = new.select("node", "list")
        if not n or changed <= FEW_CHANGES * k * n:
            break
    return lists


# --- search ---

def gathered(around: DataFrame) -> DataFrame:
    """center, ids, vecs: a row for each neighbourhood."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            center, ids, raw, _ = members_in(b)
            runs = runs_of(center)
            yield pa.RecordBatch.from_pydict({"center": center[runs[:-1]], "ids": binary_of(ids, np.diff(runs)), "vecs": binary_of(raw, np.diff(runs))})
    return around.mapInArrow(run, "center long, ids binary, vecs binary")


STATE = "query long, vec binary, beam binary, done binary, open int"
ASKED = "center long, query long, worst float, vecs binary"
FLUSH = 1 << 19
#: Up to so many open nodes are broadcast, so that only their neighbourhoods are shuffled.
FEW_ASKED = 1 << 18


def open_nodes(beam: np.ndarray, done: np.ndarray) -> np.ndarray:
    return beam["id"][~np.isin(beam["id"], done)]


def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch_of(STATE, [(q, v, x, np.array([q]).tobytes(), len(x) // ENTRY.itemsize) for q, v, x in zip(*(b.column(c).to_pylist() for c in range(3)))])


def frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each open node of each beam: what is to be expanded, and the score to beat."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            centers, worst = [], []
            for x, done in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                beam = np.frombuffer(x, ENTRY)
                centers.append(open_nodes(beam, np.frombuffer(done, np.int64)))
                worst.append(beam["score"][-1] if len(beam) >= BEAM else -np.inf)
            row = np.repeat(np.arange(b.num_rows), [len(c) for c in centers])
            yield pa.RecordBatch.from_pydict({"center": np.concatenate(centers), "query": b.column(0).to_numpy()[row], "worst": np.array(worst, np.float32)[row], "vecs": b.column(1).take(pa.array(row))})


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that beat the worst of a beam, by query.  A center's neighbourhood comes first, then the queries that ask for it."""
    held, ids, x, found, count = None, None, None, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        center, query, worst = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        (raw, ends), (listed, at) = values_of(b.column(3)), values_of(b.column(4))
        runs = runs_of(center).tolist()
        for a, e in zip(runs[:-1], runs[1:]):
            if at[a + 1] > at[a]:
                held, ids = center[a], listed[at[a]:at[a + 1]].view(np.int64)
                x = unpack_vectors(raw[ends[a]:ends[a + 1]], len(ids))
                a += 1
            if a < e and held == center[a]:
                s = x @ unpack_vectors(raw[ends[a]:ends[e]], e - a).T
                r, c = np.nonzero(s > worst[a:e])
                found.append((query[a:e][c], ids[r], s[r, c]))
                count += len(r)
        if count > FLUSH:
            yield list_batch(*best_entries(*(np.concatenate(f) for f in zip(*found)), BEAM)).rename_columns(["query", "beam"])
            found, count = [], 0
    if count:
        yield list_batch(*best_entries(*(np.concatenate(f) for f in zip(*found)), BEAM)).rename_columns(["query", "beam"])


def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of each query after its open nodes are expanded: its row before comes first, then what was found."""
    for b in whole_keys(batches):
        query, vec, done, out = b.column(0).to_numpy(), b.column(2), b.column(4), []
        (raw, ends), runs = values_of(b.column(3)), runs_of(b.column(0).to_numpy()).tolist()
        for a, e in zip(runs[:-1], runs[1:]):
            both = raw[ends[a]:ends[e]].view(ENTRY)
            seen = np.frombuffer(done[a].as_py(), np.int64)
            seen = np.concatenate([seen, open_nodes(raw[ends[a]:ends[a + 1]].view(ENTRY), seen)])
            _, beam = best_entries(np.full(len(both), query[a]), both["id"], both["score"], BEAM)
            out.append((int(query[a]), vec[a].as_py(), beam.tobytes(), seen.tobytes(), len(open_nodes(beam, seen))))
        yield batch_of(STATE, out)


def greedy_search(queries: DataFrame, lists: DataFrame, vectors: DataFrame, around: DataFrame) -> DataFrame:
    """query, beam: the best nodes found.  queries: node; around: gathered neighbourhoods of the graph."""
    state = materialize(queries.join(vectors, "node").join(lists, "node").select("node", "vec", "list").mapInArrow(start, STATE), "nn-search")
    ended = state.filter("open = 0").select("query", "beam")
    # every round expands all open nodes of each query that has any, and a node is expanded once, so this ends
    while left := state.agg(F.sum("open")).first()[0] or 0:  # one row
        state = state.filter("open > 0")
        asked = state.select("query", "vec", "beam", "done").mapInArrow(
            frontier, ASKED)
        some = around.join(F.broadcast(asked.select("center").distinct()), "center", "left_semi") if left <= FEW_ASKED else around
        none = F.lit(None)
        met = some.select("center", none.cast("long").alias("query"), none.cast("float").alias("worst"), "vecs", "ids", F.lit(0).alias("late")).unionByName(
            asked.select("center", "query", "worst", "vecs", F.lit(b"").alias("ids"), F.lit(1).alias("late")))
        found = met.repartition("center").sortWithinPartitions("center", "late").mapInArrow(expand, "query long, beam binary")
        rows = state.select("query", F.lit(0).alias("late"), "vec", "beam", "done").unionByName(found.select("query", F.lit(1).alias("late"), none.cast("binary").alias("vec"), "beam", none.cast("binary").alias("done")))
        state = materialize(rows.repartition("query").sortWithinPartitions("query", "late").mapInArrow(advance, STATE), "nn-search")
        ended = ended.unionByName(state.filter("open = 0").select("query", "beam"))
    return ended


def nearest(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, top: int = TOP, chunk: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found of every row whose id is divisible by `every`."""
    rows = usable(vectors, id_column, vector_column)
    nodes, members = nodes_of(rows, top)
    small = materialize(packed(nodes), "nn-vectors")
    lists = build_graph(small, chunk=chunk)
    around = materialize(gathered(neighbourhoods(lists, small, K, BACK_SEARCH)), "nn-around")
    asked = rows.filter(F.col("vec_id") % every == 0).distinct().join(nodes, "vector").select(F.col("vec_id").alias("query_id"), "node")
    beams = greedy_search(asked.select("node").distinct(), lists, small, around)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += [(q, q), *((q, int(i)) for i in np.frombuffer(x, ENTRY)["id"][:4 * top])]
            yield batch_of("query long, node long", out)
    pairs = beams.mapInArrow(candidates, "query long, node long")
    exact = F.aggregate(F.zip_with("a", "vector", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(nodes, "node").join(nodes.select(F.col("node").alias("query"), F.col("vector").alias("a")), "query").select("query", "node", exact.alias("score"))
    # members of the best nodes: one more than asked for, since a query is no candidate of its own
    listed = scored.join(members, "node").select("query", "score", F.explode("members").alias("vec_id"))
    by_node = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = materialize(listed.withColumn("place", F.row_number().over(by_node)).filter(F.col("place") <= top + 1).groupBy("query").agg(F.collect_list(F.struct("place", "vec_id", "score")).alias("found")), "nn-found")
    joined = asked.join(best, asked.node == best["query"]).select("query_id", F.filter(F.sort_array("found"), lambda x: x["vec_id"] != F.col("query_id")).alias("found"))
    return joined.select("query_id", F.posexplode(F.slice("found", 1, top)).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
