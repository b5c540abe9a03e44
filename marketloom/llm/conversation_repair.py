"""Conversation structure repair: the cheapest edits that make the roles of a conversation legal.

Rows of a conversation are in order of turn (nulls first; equal turns by role, then by the SHA-256 of
the text).  A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (its
last character other than white space isn't one of `.!?`).  Edits: Keep 0, Rerole to user or assistant
1, Delete 2 (blank and duplicate rows must go), Insert an empty message of user or assistant 5; a
truncated row that stays costs 5 more.  What is left has role initials `(s?(ua)+)?`.  Of the cheapest
edits the least string of initials (D, I, K, R) is the audit.

Method, a persistent audit DP.  The automaton has four states; each keeps its cheapest edit prefix.
Prefixes share their beginnings as linked nodes with binary-lifting ancestors and rolling hashes.  At
equal cost two prefixes are compared by searching their longest common prefix along the ancestors;
that the prefixes up to there are the same is then verified (as a rule they are the same node).
Neither of two equally dear prefixes that consumed the same rows is the beginning of the other (what
it has more are inserts, which cost), so the lesser one stays the lesser with anything appended.

On Spark.  Equal rows are counted, not moved; first occurrences are an aggregate joined back; the rows,
without texts, are range partitioned by conversation and place.  Runs of `RUN` rows are solved for every
state they may begin in, so that a conversation that holds a third of all rows is solved by many tasks;
the same DP then goes over the runs of a conversation.  Texts are moved once, at the end, and pass in
order beside the audit.  That last pass over one conversation is one task, because a digest of its
whole text can't be split; it holds the audit (a byte a row) and one text at a time.

Defined results: null role and text are one space; null turns are in no gap; rows with null conv_id are
one conversation; repeated rows are duplicates; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a run.
RUN = 4096
#: Costs of edits, and of a truncated row that stays.
RANKS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: States of the automaton after no message, system, user, assistant; initials and what they lead to.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL_PAIRS = {"su", "ua", "au"}
NAMES = {USER: "user", ASSISTANT: "assistant"}
MODULUS, BASE = (1 << 61) - 1, 1_000_003


def next_message(state: int) -> int:
    """State after a message of user or assistant, whichever is legal."""
    return ASSISTANT if state == USER else USER


# --- the damage that the query asks for ---

def damage(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the crc32 of `conv_id:turn` (nulls: one space) asks for."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    base = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


# --- edit prefixes ---

class Prefix:
    """An edit prefix: its last piece, its ancestors 1, 2, 4, ... pieces before, and its rolling hash."""

    __slots__ = ("piece", "up", "depth", "hash")

    def __init__(self, parent: Prefix | None = None, piece: str = ""):
        self.piece, self.up = piece, [] if parent is None else [parent]
        self.depth = 0 if parent is None else parent.depth + 1
        h = 0 if parent is None else parent.hash
        for c in piece:
            h = (h * BASE + ord(c)) % MODULUS
        self.hash = h
        k = 0
        while len(self.up) > k and len(self.up[k].up) > k:
            self.up.append(self.up[k].up[k])
            k += 1

    def ancestor(self, depth: int) -> Prefix:
        node, back = self, self.depth - depth
        while back:
            k = back.bit_length() - 1
            node, back = node.up[k], back - (1 << k)
        return node

    def pieces(self) -> list[str]:
        out, node = [], self
        while node.up:
            out.append(node.piece)
            node = node.up[0]
        return out[::-1]

    def text(self) -> str:
        return "".join(self.pieces())


def same(x: Prefix, y: Prefix) -> bool:
    """Are two prefixes of equal depth and hash piece by piece the same?"""
    while x is not y:
        if x.piece != y.piece:
            return False
        x, y = x.up[0], y.up[0]
    return True


def precedes(p: Prefix, c: str, q: Prefix, d: str) -> bool:
    """Is the text of p and c less than that of q and d?"""
    depth = min(p.depth, q.depth)
    x, y = p.ancestor(depth), q.ancestor(depth)
    if x.hash == y.hash:
        common = same(x, y)
        a = c if p.depth == depth else p.ancestor(depth + 1).piece
        b = d if q.depth == depth else q.ancestor(depth + 1).piece
    else:
        for k in range(len(x.up) - 1, -1, -1):
            if k < len(x.up) and x.up[k].hash != y.up[k].hash:
                x, y = x.up[k], y.up[k]
        common = same(x.up[0], y.up[0])
        a, b = x.piece, y.piece
    if common and not a.startswith(b) and not b.startswith(a):
        return a < b
    return p.text() + c < q.text() + d  # equal hashes of different prefixes, or pieces that don't decide


def offer(into: dict[int, tuple[int, Prefix, str]], state: int, cost: int, prefix: Prefix, piece: str) -> None:
    held = into.get(state)
    if held is None or cost < held[0] or cost == held[0] and precedes(prefix, piece, held[1], held[2]):
        into[state] = (cost, prefix, piece)


Alive = dict[int, tuple[int, Prefix]]


def grown(offers: dict[int, tuple[int, Prefix, str]]) -> Alive:
    return {s: (cost, Prefix(p, piece) if piece else p) for s, (cost, p, piece) in offers.items()}


def with_insert(alive: Alive) -> Alive:
    """One insert at most: two in a row never pay, since a legal place is one away from any other."""
    offers = {s: (cost, p, "") for s, (cost, p) in alive.items()}
    for s, (cost, p) in alive.items():
        offer(offers, next_message(s), cost + RANKS["I"], p, "I")
    return grown(offers)


def with_row(alive: Alive, initial: str, must_go: bool, truncated: bool) -> Alive:
    offers: dict[int, tuple[int, Prefix, str]] = {}
    stays = TRUNCATED if truncated else 0
    for s, (cost, p) in with_insert(alive).items():
        offer(offers, s, cost + RANKS["D"], p, "D")
        if not must_go:
            if s in STEPS.get(initial, ()):
                offer(offers, STEPS[initial][s], cost + RANKS["K"] + stays, p, "K")
            offer(offers, next_message(s), cost + RANKS["R"] + stays, p, "R")
    return grown(offers)


# --- runs of rows ---

@dataclass
class Run:
    """Adjacent rows of one conversation: the best way between any two states, and counts."""

    conv_id: int | None
    begins: bool  # is it known to be the first of its conversation?
    alive: dict[int, Alive] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0))
    first_initial: str = ""
    last_initial: str = ""
    first_turn: int | None = None
    last_turn: int | None = None

    def __post_init__(self):
        self.alive = {s: {s: (0, Prefix())} for s in ((START,) if self.begins else range(4))}

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        c = self.counts
        if c["rows"]:
            c["illegal"] += self.last_initial + initial not in LEGAL_PAIRS
        else:
            self.first_initial = initial
        c["rows"] += 1
        if fault:
            c[fault] += 1
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            c["turns"] += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        self.alive = {s: with_row(a, initial, fault in ("blank", "duplicate"), fault == "truncated") for s, a in self.alive.items()}

    def record(self, part: int, number: int) -> dict:
        ways = [{"entry": s, "exit": e, "cost": cost, "audit": p.text()} for s, a in self.alive.items() for e, (cost, p) in a.items()]
        return {"conv_id": self.conv_id, "part": part, "number": number, "ways": ways, **self.counts, **{k: getattr(self, k) for k in EDGES}}


COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
EDGES = ("first_initial", "last_initial", "first_turn", "last_turn")
WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
RUNS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), ("ways", WAYS), *[(c, pa.int64()) for c in COUNTS],
                  ("first_initial", pa.string()), ("last_initial", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())])
RUNS_SQL = "conv_id long, part long, number long, ways array<struct<entry:int,exit:int,cost:long,audit:string>>, " + "".join(f"{c} long, " for c in COUNTS) + "first_initial string, last_initial string, first_turn long, last_turn long"


def runs_of(rows: DataFrame, run: int) -> DataFrame:
    """Runs of sorted rows: conv_id, turn, initial, blank, truncated, later (seen before), n (equal rows)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, out, held = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            for conv_id, turn, initial, blank, truncated, later, n in zip(*(batch.column(k).to_pylist() for k in range(7))):
                for copy in range(n):
                    new = now is None or now.conv_id != conv_id
                    if new or now.counts["rows"] >= run:
                        if now is not None:
                            out.append(now.record(part, number))
                            held, number = held + now.counts["rows"], number + 1
                        now = Run(conv_id, begins=new and now is not None)
                    now.add(turn, initial, "blank" if blank else "duplicate" if later or copy else "truncated" if truncated else "")
                    if held >= 4 * run:
                        yield pa.RecordBatch.from_pylist(out, RUNS)
                        out, held = [], 0
        if now is not None:
            out.append(now.record(part, number))
        yield pa.RecordBatch.from_pylist(out, RUNS)
    return rows.mapInArrow(cut, RUNS_SQL)


# --- whole conversations ---

@dataclass
class Repair:
    """Report on one conversation and its edits."""

    conv_id: int | None
    gaps: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    cost: int = 0
    audit: str = ""

    @classmethod
    def of(cls, conv_id: int | None, runs: list[dict]) -> Repair:
        out = cls(conv_id)
        alive: Alive = {START: (0, Prefix())}
        turns, first, last, initial = 0, None, None, None
        for r in runs:
            offers: dict[int, tuple[int, Prefix, str]] = {}
            for w in r["ways"]:
                if w["entry"] in alive:
                    cost, p = alive[w["entry"]]
                    offer(offers, w["exit"], cost + w["cost"], p, w["audit"])
            alive = grown(offers)
            for c in ("blank", "duplicate", "truncated", "illegal"):
                setattr(out, c, getattr(out, c) + r[c])
            out.illegal += initial is not None and initial + r["first_initial"] not in LEGAL_PAIRS
            initial = r["last_initial"]
            if r["first_turn"] is not None:
                turns += r["turns"] - (r["first_turn"] == last)
                first, last = r["first_turn"] if first is None else first, r["last_turn"]
        out.gaps = 0 if first is None else last - first + 1 - turns
        offers = {}
        for s, (cost, p) in with_insert(alive).items():
            if s in (START, ASSISTANT):
                offer(offers, START, cost, p, "")
        cost, p, _ = offers[START]
        out.cost, out.audit = cost, p.text()
        return out


class Messages:
    """The messages that are left of a conversation, as its rows pass in order."""

    def __init__(self, repair: Repair):
        self.audit, self.at, self.state = repair.audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = next_message(self.state)
            yield NAMES[self.state], ""

    def row(self, role: str, text: str | None) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[role[:1]][self.state]
            yield role, text
        elif edit == "R":
            self.state = next_message(self.state)
            yield NAMES[self.state], text


def passed(rows: Iterator[tuple]) -> Iterator[tuple[Repair, Iterator[tuple[str, str]]]]:
    """Each conversation's repair and messages, from its sorted runs (kind 0), rows (1) and marks (2)."""
    ahead = next(rows, None)
    while ahead is not None:
        conv_id, runs = ahead[0], []
        while ahead is not None and ahead[0] == conv_id and ahead[1] == 0:
            runs.append(ahead[2])
            ahead = next(rows, None)
        repair = Repair.of(conv_id, runs)

        def messages() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            left = Messages(repair)
            while ahead is not None and ahead[0] == conv_id:
                if ahead[1] == 1:
                    yield from left.row(ahead[3], ahead[4])
                ahead = next(rows, None)
            yield from left.inserted()
        told = messages()
        yield repair, told
        for _ in told:  # what the caller has not taken
            pass


def trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def with_keys(rows: DataFrame) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    return base.withColumn("digest", F.unhex(F.sha2("text", 256)))


def sorted_runs(rows: DataFrame, run: int) -> DataFrame:
    """Runs of all conversations; texts take no part."""
    end = trimmed(F.col("text"))
    faults = with_keys(rows).select("conv_id", "turn", "role", "digest", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(*ENDS)).alias("truncated"))
    counted = materialize(faults.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.count("*").alias("n")), "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    firsts = counted.filter(~F.col("blank")).groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("places")).filter("places > 1")
    firsts = firsts.select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"), "first")
    flagged = counted.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest")), "left")
    order = ["conv_id", "turn", "role", "digest"]
    flagged = flagged.withColumn("later", F.coalesce(F.col("first") < place, F.lit(False)))
    ordered = flagged.repartitionByRange(*order).sortWithinPartitions(*order)
    return runs_of(ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "later", "n"), run)


def in_order(rows: DataFrame, every: DataFrame | None, run: int) -> DataFrame:
    """Runs, rows and marks of each conversation in one partition, in this order."""
    runs = sorted_runs(rows, run)
    keyed = with_keys(rows)
    none = F.lit(None)
    pieces = runs.select("conv_id", F.lit(0).alias("kind"), F.col("part").alias("place"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), F.col("number"), F.struct(*runs.columns).alias("run"), none.cast("string").alias("text"))
    empty = none.cast(pieces.schema["run"].dataType)
    texts = F.when(trimmed(F.col("text")) == "", None).otherwise(F.col("text"))  # blank ones go
    pieces = pieces.unionByName(keyed.select("conv_id", F.lit(1).alias("kind"), F.col("turn").alias("place"), "role", "digest", F.lit(0).cast("long").alias("number"), empty.alias("run"), texts.alias("text")))
    if every is not None:
        marks = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        pieces = pieces.unionByName(marks.select("conv_id", F.lit(2).alias("kind"), none.cast("long").alias("place"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), F.lit(0).cast("long").alias("number"), empty.alias("run"), none.cast("string").alias("text")))
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "place", "role", "digest", "number")
    return ordered.select("conv_id", "kind", "run", "role", "text")


def streamed(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(k).to_pylist() for k in range(5)))


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(rows: DataFrame, every: DataFrame | None = None, run: int = RUN) -> DataFrame:
    """One row per conversation of rows, and of `every` where it is given: faults, cost, audit, digest of what is left."""
    names = [x.split()[0] for x in REPORT.split(", ")]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for repair, messages in passed(streamed(batches)):
            sha = hashlib.sha256()
            for k, (role, text) in enumerate(messages):
                sha.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            out.append((repair.conv_id, repair.gaps, repair.blank, repair.duplicate, repair.truncated, repair.illegal, repair.cost, repair.audit, sha.hexdigest()))
            if len(out) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 6 else pa.int64()) for k, c in enumerate(zip(*out))], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 6 else pa.int64()) for k, c in enumerate(zip(*out))], names)
    return in_order(rows, every, run).mapInArrow(told, REPORT)


def repaired(rows: DataFrame, run: int = RUN) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for repair, messages in passed(streamed(batches)):
            out, size = [], 0
            for k, (role, text) in enumerate(messages):
                out.append((repair.conv_id, k, role, text))
                size += len(text)
                if size > 1 << 20 or len(out) == 1024:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 1 else pa.int64()) for k, c in enumerate(zip(*out))], ["conv_id", "place", "role", "text"])
    return in_order(rows, None, run).mapInArrow(told, "conv_id long, place long, role string, text string")
