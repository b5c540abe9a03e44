"""Toxicity by a weighted finite-state pattern grammar.

Words become tags: insult, threat, target (the reader or a person), negation, reporting verb, other.
Small transducers each rewrite tags and add weight: `targets` marks insults and threats near a target,
`negation` turns those in its scope into denied ones, `reported` turns those after a reporting verb or
in quotation into quoted ones, `scores` gives each outcome its weight.  They are composed into one
machine once, which then runs over the clauses that hold an insult or a threat; the weight of a match
is that of its outcome times the learned weight of its word.  Clauses, not isolated words, are scored.

Threats, targets, negations and reporting verbs are fixed lists.  Insults are learned: words and word
stems (first 4 to 6 letters) whose share of toxic documents is far above that of clean ones, and which
stand between different neighbours (the words of a copied text do not).  A logistic curve over the
clause weights gives the score.  Both are fitted on a bounded sample: about `per_label` labelled
documents of each label, chosen by a hash of doc_id.

Defined results: null and empty texts score as a text without matches; repeated labels count once
(the largest); without labels of both kinds the fixed lists and fixed coefficients hold; extra columns
are ignored.
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, per_batch
from .language import fold, sample_by_hash

# Words of the grammar, in English, German, French and Spanish.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumbass bastard asshole trottel arschloch idioten connard imbécile salaud idiota imbécil gilipollas".split()
THREATS = "kill hurt destroy murder beat stab shoot strangle töten umbringen verprügeln tuer frapper matar golpear".split()
TARGETS = "you your yours he she him her they them his their du dich dir ihr sie er tu toi te vous lui eux tú usted él ella ellos".split()
NEGATIONS = "not no never none isn't aren't wasn't don't nobody nicht kein keine keinen nie ne pas jamais aucun nunca ningún tampoco".split()
REPORTS = "said says told called calls wrote claimed quoted reportedly accused sagte nannte schrieb behauptete zitierte dit disait appela écrit selon dijo llamó escribió según".split()
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult threat target negation report other".split()
CLAUSE_END = re.compile(r"[.!?;:\n|]")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


# --- transducers ---

@dataclass(frozen=True)
class Transducer:
    """Deterministic machine over tags.  arcs: (state, tag) -> (state, tag written, weight added).

    A tag without an arc is written as it is and leads to `otherwise[state]` (default: the same state).
    """

    start: int
    arcs: dict[tuple[int, str], tuple[int, str, float]] = field(hash=False)
    otherwise: dict[int, int] = field(default_factory=dict, hash=False)

    def step(self, state: int, tag: str) -> tuple[int, str, float]:
        return self.arcs.get((state, tag)) or (self.otherwise.get(state, state), tag, 0.0)


def compose(first: Transducer, second: Transducer, tags: list[str]) -> Transducer:
    """The machine that writes what `second` makes of what `first` writes; weights add up."""
    number, arcs, open_ = {(first.start, second.start): 0}, {}, [(first.start, second.start)]
    while open_:
        pair = open_.pop()
        for tag in tags:
            a, middle, w1 = first.step(pair[0], tag)
            b, out, w2 = second.step(pair[1], middle)
            if (a, b) not in number:
                number[a, b] = len(number)
                open_.append((a, b))
            arcs[number[pair], tag] = (number[a, b], out, w1 + w2)
    return Transducer(0, arcs)


def scope(opener: str, changes: dict[str, str], length: int, keeps: bool = False) -> Transducer:
    """After `opener`, the next `length` words are in its scope, where tags change; keeps: to the clause's end."""
    arcs = {(s, opener): (length, opener, 0.0) for s in range(length + 1)}
    for s in range(1, length + 1):
        nxt = s if keeps else s - 1
        arcs |= {(s, tag): (nxt, new, 0.0) for tag, new in changes.items() if tag != opener}
    return Transducer(0, arcs, {s: (s if keeps else s - 1) for s in range(1, length + 1)})


TAGS = [INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER]
#: Outcome -> weight.  A denied or quoted insult is a weak sign, a targeted one a strong sign.
OUTCOMES = {"insult": 1.0, "aimed insult": 1.4, "denied insult": 0.5, "denied aimed insult": 0.6, "quoted insult": 0.6, "threat": 0.1, "aimed threat": 0.4, "denied threat": 0.0, "denied aimed threat": 0.1, "quoted threat": 0.0}


def grammar() -> Transducer:
    targets = scope(TARGET, {INSULT: "aimed insult", THREAT: "aimed threat"}, 4)
    negation = scope(NEGATION, {INSULT: "denied insult", "aimed insult": "denied aimed insult", THREAT: "denied threat", "aimed threat": "denied aimed threat"}, 3)
    reported = scope(REPORT, {k: "quoted insult" for k in OUTCOMES if k.endswith("insult")} | {k: "quoted threat" for k in OUTCOMES if k.endswith("threat")}, 1, keeps=True)
    scores = Transducer(0, {(0, k): (0, k, w) for k, w in OUTCOMES.items()})
    machine = targets
    for part in (negation, reported, scores):
        machine = compose(machine, part, TAGS)
    return machine


# --- lexicon and scoring ---

@dataclass
class Model:
    """words and stems (first letters) of insults with their weights; coefficients of the score."""

    words: dict[str, float]
    stems: dict[str, float]
    coefficients: tuple[float, ...] = (-4.5, 2.5, 2.0)

    def __post_init__(self):
        import ahocorasick

        self.machine = grammar()
        self.fixed = {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS}
        self.threats = set(THREATS)
        self.automaton = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *self.threats}:
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()
        self.lengths = sorted({len(s) for s in self.stems})

    def tag(self, word: str) -> tuple[str, float]:
        if word in self.words:
            return INSULT, self.words[word]
        for n in self.lengths:
            if word[:n] in self.stems and len(word) >= n:
                return INSULT, self.stems[word[:n]]
        if word in self.threats:
            return THREAT, 1.0
        return self.fixed.get(word, OTHER), 1.0

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the clauses that hold an insult or a threat."""
        low, out, done = text.lower(), [], -1
        for last, length in self.automaton.iter(low):
            start = last + 1 - length
            if start < done or start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            begin = max((m for m in (low.rfind(c, 0, start) for c in ".!?;:\n|")), default=-1) + 1
            end = CLAUSE_END.search(low, start)
            end = end.start() if end else len(low)
            weight, hit, state = 0.0, False, self.machine.start
            for word in WORD.findall(low[begin:end]):
                tag, strength = self.tag(word)
                state, _, w = self.machine.step(state, tag)
                if tag in (INSULT, THREAT):
                    hit = True
                    weight += w * strength
            done = end
            if hit:
                out.append((begin, end, weight))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """Largest clause weight and that of all clauses together, on a logarithmic scale."""
        if not text:
            return 0.0, 0.0
        weights = [max(w, 0.0) for *_, w in self.clauses(text)]
        return (math.log1p(max(weights)), math.log1p(sum(weights))) if weights else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        c = self.coefficients
        return 1 / (1 + math.exp(-(c[0] + c[1] * a + c[2] * b)))


STEMS = (4, 5, 6)


#: A term must stand between different pairs of neighbours, at least 4, and as many as 0.6 of its
#: documents up to 20: words of copied texts don't.
NEIGHBOURS = "bit_count(places) >= greatest(4, least(0.6 * toxic, 20))"


def terms_of(text: str) -> dict[str, int]:
    """Distinct words of three letters and more, and the stems of longer ones, which end in `*`.

    The value has one of 63 bits set for each pair of neighbours, by its hash.
    """
    words = WORD.findall(text.lower())
    out: dict[str, int] = {}
    for before, word, after in zip(["", *words], words, [*words[1:], ""]):
        if len(word) >= 3:
            bit = 1 << zlib.crc32(f"{before} {after}".encode()) % 63
            for term in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)):
                out[term] = out.get(term, 0) | bit
    return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the documents with a label that may be learned from."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return known.filter(fold(4) != 2)


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 3_000) -> Model:
    """Lexicon and coefficients from about per_label documents of each label."""
    chosen = sample_by_hash(labelled(docs, labels), "toxic", per_label)
    wanted = chosen.toArrow()  # at most about 2 x per_label ids, by the bound above
    number = dict(zip(wanted.column("doc_id").to_pylist(), wanted.column("toxic").to_pylist()))
    seeds = {w: 1.0 for w in INSULTS}
    if set(number.values()) != {0, 1}:
        return Model(seeds, {})
    sample = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            counts, places = (Counter(), Counter()), Counter()
            for text, toxic in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                terms = terms_of(text or "")
                counts[toxic].update(terms.keys())
                if toxic:
                    for t, bits in terms.items():
                        places[t] |= bits
            terms = sorted({*counts[0], *counts[1]})
            return pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string())} | {n: pa.array([c[t] for t in terms], pa.int64()) for n, c in (("clean", counts[0]), ("toxic", counts[1]), ("places", places))})
        return work
    n = Counter(number.values())
    counted = per_batch(sample, make, "term string, clean long, toxic long, places long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("places").alias("places"))
    least = max(5, round(0.004 * n[1]))
    lift = (F.col("toxic") + 0.5) / (n[1] + 1) / ((F.col("clean") + 0.5) / (n[0] + 1))
    strong = counted.filter((F.col("toxic") >= least) & (F.col("clean") <= 0.02 * F.col("toxic")) & (lift >= 8) & F.expr(NEIGHBOURS)).select("term", "toxic", lift.alias("lift")).toArrow().to_pylist()
    words, stems = dict(seeds), {}
    for r in sorted(strong, key=lambda r: (len(r["term"]), r["term"])):
        term, weight = r["term"], min(1.5, math.log(r["lift"]) / 4)
        if any(term.startswith(s) for s in stems):
            continue
        if term.endswith("*"):
            stems[term[:-1]] = weight
        else:
            words[term] = max(weight, words.get(term, 0.0))
    words = {w: v for w, v in words.items() if not any(w.startswith(s) for s in stems)}
    model = Model(words, stems)
    return Model(words, stems, fit(model, sample, n))


def fit(model: Model, sample: DataFrame, n: Counter) -> tuple[float, ...]:
    """Logistic coefficients; the few distinct pairs of features come back as counts."""
    told = sample.sparkSession.sparkContext.broadcast((model.words, model.stems))

    def make():
        m = Model(*told.value)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            f = [m.features(t) for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_pydict({"a": pa.array([round(x, 2) for x, _ in f], pa.float64()), "b": pa.array([round(x, 2) for _, x in f], pa.float64()), "y": b.column(2)})
        return work
    rows = per_batch(sample, make, "a double, b double, y int").groupBy("a", "b", "y").count().toArrow()
    x = np.stack([np.ones(rows.num_rows), rows.column("a").to_numpy(), rows.column("b").to_numpy()], 1)
    y = rows.column("y").to_numpy().astype(float)
    w = rows.column("count").to_numpy().astype(float)
    beta = np.array([-4.5, 2.5, 2.0])
    prior = beta.copy()
    for _ in range(50):  # Newton's method; a weak pull to the fixed coefficients keeps it finite
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - 0.5 * (beta - prior)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in np.round(beta, 6))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    told = docs.sparkSession.sparkContext.broadcast((model.words, model.stems, model.coefficients))

    def make():
        m = Model(*told.value)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            s = [m.score(t) for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "held_out": b.column(2), "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= threshold) for x in s], pa.int32())})
        return work
    return per_batch(ids_and_texts(docs, (fold(4) == 2).alias("held_out")), make, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    told = docs.sparkSession.sparkContext.broadcast((model.words, model.stems, model.coefficients))
    at = docs.columns.index("text")

    def make():
        m = Model(*told.value)
        return lambda b: b.filter(pa.array([m.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))
    return per_batch(docs, make, docs.schema)
