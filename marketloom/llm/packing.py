"""Harmonic packing of token ids into sequences of a fixed capacity.

Documents of up to `capacity` ids fall into reciprocal-capacity classes: class k holds the lengths of
which exactly k fit, floor(capacity / length) (lengths beyond `classes` share the last class).  A bin of
class k is closed once it has k whole documents; so bins need nothing but a count, and tasks fill them
independently.  The gap that is left in a closed bin is filled from documents longer than the
capacity, which have to be cut anyway and wait in a small reserve; what the reserve does not need is
cut into full sequences.  If the reserve is empty, the gap takes whole waiting documents that fit, and
only then the head of a waiting one, whose rest falls into its own class.

What a task holds back at its end (bins not closed, the reserve) is laid end to end.  All of it but the
last, shorter sequence is settled; those last ones meet in a second pass over few tasks, so that the
number of short sequences doesn't grow with the number of tasks.

Defined results: null or empty texts are one piece (the end id); rows with a null or repeated doc_id
are packed like any other; an empty table gives no pieces.  Sequence ids are distinct across tasks:
the task's partition number (in the second pass plus 2^25) times 2^36 plus a running number.  The pieces
of a retried task are the same, as its rows come straight from the scan.
"""
from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import halves, ids_and_texts, materialize
from .tokens import library_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PER_TASK, SECOND = 36, 1 << 25
#: Sequences of the reserve, and of held back ids for a task of the second pass.
RESERVE, TOGETHER = 16, 64


class Part:
    """What is left to place of a document."""

    __slots__ = ("doc_id", "start", "ids", "at", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.at, self.doc_tokens = doc_id, start, ids, 0, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4 - self.at

    def take(self, n: int) -> tuple:
        """The next n ids as a piece: doc_id, start, length, crc32, doc_tokens, ids."""
        raw = memoryview(self.ids)[4 * self.at:4 * (self.at + n)]
        piece = (self.doc_id, self.start + self.at, n, zlib.crc32(raw), self.doc_tokens, raw)
        self.at += n
        return piece


class HarmonicBins:
    """Bins of one task.  add() gives the pieces whose sequence is settled, close() the rest."""

    def __init__(self, capacity: int, first_id: int, classes: int = 64):
        self.capacity, self.next_id, self.classes = capacity, first_id, classes
        self.bins: dict[int, list[Part]] = {k: [] for k in range(1, classes + 1)}
        self.reserve: deque[Part] = deque()
        self.reserved = 0

    def add(self, part: Part) -> list[tuple]:
        if len(part) > self.capacity:
            self.reserve.append(part)
            self.reserved += len(part)
            out = []
            while self.reserved > RESERVE * self.capacity:
                out += self._sequence(self._fill(self.capacity))
            return out
        k = min(self.capacity // len(part), self.classes)
        held = self.bins[k]
        held.append(part)
        if len(held) < k:
            return []
        self.bins[k] = []
        gap = self.capacity - sum(map(len, held))
        filling, cut = self._gap(gap)
        out = self._sequence([p.take(len(p)) for p in held] + filling)
        return out + self.add(cut) if cut else out

    def _fill(self, n: int) -> list[tuple]:
        """Up to n ids from the reserve."""
        out = []
        while n and self.reserve:
            first = self.reserve[0]
            out.append(first.take(min(n, len(first))))
            n -= out[-1][2]
            self.reserved -= out[-1][2]
            if not len(first):
                self.reserve.popleft()
        return out

    def _gap(self, n: int) -> tuple[list[tuple], Part | None]:
        """(pieces that fill a gap of n, what is left of a document cut for it)."""
        out = self._fill(n)
        n -= sum(p[2] for p in out)
        for k in range(min(self.capacity // max(n, 1), self.classes), self.classes + 1):
            held = self.bins[k]
            for p in [p for p in held if n]:
                if len(p) <= n:
                    held.remove(p)
                    out.append(p.take(len(p)))
                    n -= out[-1][2]
        waiting = next((h for h in self.bins.values() if h), None) if n else None
        if waiting is None:
            return out, None
        cut = waiting.pop()
        out.append(cut.take(n))
        return out, cut

    def close(self) -> tuple[list[tuple], list[tuple]]:
        """(settled pieces, pieces of the last sequence, which is shorter than the capacity)."""
        left = [*self.reserve, *(p for held in self.bins.values() for p in held)]
        self.reserve, self.reserved = deque(left), sum(map(len, left))
        out = []
        while self.reserved >= self.capacity:
            out += self._sequence(self._fill(self.capacity))
        return out, self._fill(self.capacity)

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        sequence, self.next_id = self.next_id, self.next_id + 1
        out, offset = [], 0
        for p in pieces:
            out.append((*p[:5], sequence, offset))
            offset += p[2]
        return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Encoding and packing are one pass over the scan; only the short last sequences of the tasks are moved.
    """
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << PER_TASK)
        encoder = library_encoder(tokenizer)
        for batch in batches:
            for some in halves(batch):
                out = []
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                    out += bins.add(Part(doc_id, 0, ids + end, len(ids) // 4 + 1))
                yield as_batch(out, [])
        yield as_batch(*bins.close())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = HarmonicBins(capacity, SECOND + TaskContext.get().partitionId() << PER_TASK)
        for batch in batches:
            for doc_id, start, doc_tokens, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                bins.reserve.append(Part(doc_id, start, ids, doc_tokens))
                bins.reserved += len(bins.reserve[-1])
        out, last = bins.close()
        yield as_batch(out + bins._sequence(last), [])

    first = materialize(ids_and_texts(docs).mapInArrow(run, f"{SCHEMA}, ids binary"), "packing-pieces")
    late = first.filter("sequence_id IS NULL").select("doc_id", "start", "doc_tokens", "ids")
    held = late.agg(F.sum(F.octet_length("ids") / 4)).first()[0] or 0  # one row
    second = late.repartition(int(-(-held // (TOGETHER * capacity))) or 1).mapInArrow(again, f"{SCHEMA}, ids binary")
    return first.filter("sequence_id IS NOT NULL").unionByName(second).drop("ids")


def as_batch(settled: list[tuple], late: list[tuple]) -> pa.RecordBatch:
    """Pieces with their sequence, and those without one with their ids."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*settled, *((*p[:5], None, None) for p in late))) or [[]] * len(names)
    ids = pa.array([None] * len(settled) + [bytes(p[5]) for p in late], pa.binary())
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)} | {"ids": ids})


def padding(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences, ids, padding (none where a sequence's length is a power of two)."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    exact = F.expr("bit_count(used) = 1")
    return used.agg(F.count("*").alias("sequences"), F.sum("used").alias("ids"), F.sum(F.when(exact, 0).otherwise(capacity - F.col("used"))).alias("padding"))
