"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
contain: a literal run gives the AND of its trigrams, a choice gives an OR, what can be anything
gives nothing.  The index of a block of documents has, for each trigram that some rule asks for, the
sorted positions of the documents whose text holds it (letters folded to lower case).  A rule's
candidates are the intersections and unions of those postings, and only they are searched.  A rule
without a mandatory trigram has no query: it scans all documents of the block.

A block is what one task holds at a time, so index, candidates and texts meet without a shuffle, and
a lost executor only repeats its own blocks.

Spans are code points, end exclusive.  Defined results: null is the empty text; rows with null or
repeated doc_id are scanned like any other; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
import re._parser as regex_tree
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_texts, per_batch

EVERYTHING = None  # the query that excludes no document


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern`, leftmost and non-overlapping, whose `group` has `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    base: bool = False
    regex: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "regex", re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The three base kinds, in the order in which ties of a start are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    # A run of hex digits is taken whole either way; asking for the length in the pattern skips short runs at once.
    Rule("hex", r"[0-9a-f]{24,}", least=24, base=True),
)
#: Further public credential formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES


# --- queries: EVERYTHING, a trigram, ("and", ...) or ("or", ...) ---

def both(parts: list) -> object:
    """AND; parts that exclude nothing are left out."""
    flat = []
    for p in parts:
        if p is not EVERYTHING:
            flat += p[1:] if isinstance(p, tuple) and p[0] == "and" else [p]
    flat = list(dict.fromkeys(flat))
    return EVERYTHING if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def either(parts: list) -> object:
    """OR; one part that excludes nothing makes the whole exclude nothing."""
    if any(p is EVERYTHING for p in parts):
        return EVERYTHING
    flat = list(dict.fromkeys(parts))
    terms = {p: trigrams_of(p) for p in flat}
    # a part that asks for all that a simpler part asks for, and more, adds no document
    flat = [p for p in flat if not any(q != p and not is_or(q) and not is_or(p) and terms[q] < terms[p] for q in flat)]
    return flat[0] if len(flat) == 1 else ("or", *flat)


def is_or(query) -> bool:
    return isinstance(query, tuple) and query[0] == "or"


def of_literals(literals: list[str]) -> object:
    """Documents that hold one of the strings; a string under three characters excludes nothing."""
    return either([both([s[k:k + 3] for k in range(len(s) - 2)]) for s in literals])


MANY = 32


def trigram_query(pattern: str, any_case: bool = False) -> object:
    """The Boolean query of a regular expression, over lower-case trigrams."""
    tree = regex_tree.parse(pattern, re.IGNORECASE if any_case else 0)
    return _sequence(list(tree))


def _sequence(items: list) -> object:
    """Concatenation: literal strings are joined across items as long as few are possible."""
    parts, now = [], [""]
    for op, value in items:
        strings = _strings(op, value)
        if strings is not None and len(strings) * len(now) <= MANY:
            now = [a + b for a in now for b in strings]
            continue
        parts += [of_literals(now), _other(op, value)]
        now = [""] if strings is None else strings
    return both([*parts, of_literals(now)])


def _strings(op, value) -> list[str] | None:
    """All strings that an item can match, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return [chr(value).lower()]
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 8:
        return list(dict.fromkeys(chr(v).lower() for _, v in value))
    if name == "SUBPATTERN":
        return _all_of(list(value[3]))
    if name == "BRANCH":
        each = [_all_of(list(b)) for b in value[1]]
        return None if any(e is None for e in each) else [s for e in each for s in e]
    if name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] <= 2:
        once = _all_of(list(value[2]))
        if once is None:
            return None
        return list(dict.fromkeys(s * n for n in range(value[0], value[1] + 1) for s in once))
    return None


def _all_of(items: list) -> list[str] | None:
    now = [""]
    for op, value in items:
        strings = _strings(op, value)
        if strings is None or len(strings) * len(now) > MANY:
            return None
        now = [a + b for a in now for b in strings]
    return now


def _other(op, value) -> object:
    """What an item demands that isn't a short list of strings."""
    name = str(op)
    if name == "SUBPATTERN":
        return _sequence(list(value[3]))
    if name == "BRANCH":
        return either([_sequence(list(b)) for b in value[1]])
    if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
        return _sequence(list(value[2]))
    return EVERYTHING


def trigrams_of(query) -> set[str]:
    if query is EVERYTHING:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1:]))


# --- index of a block ---

class BlockIndex:
    """Postings of the rules' trigrams over the texts of a block."""

    def __init__(self, folded: list[str], trigrams: set[str]):
        self.n = len(folded)
        self.postings = {t: np.array([k for k, text in enumerate(folded) if t in text], np.int64) for t in sorted(trigrams)}

    def candidates(self, query) -> np.ndarray:
        if query is EVERYTHING:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        lists = sorted((self.candidates(q) for q in query[1:]), key=len)
        out = lists[0]
        for more in lists[1:]:
            if query[0] == "and":
                if not len(out):
                    break
                out = np.intersect1d(out, more, assume_unique=True)
            else:
                out = np.union1d(out, more)
        return out


def scan_texts(texts: list[str | None], rules: tuple[Rule, ...], queries: list) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end), in the order of start, then rule."""
    whole = [t or "" for t in texts]
    # Folding serves the index alone; the candidates are searched as they are.
    index = BlockIndex([t.lower() for t in whole], set().union(*map(trigrams_of, queries)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in whole]
    for k, (rule, query) in enumerate(zip(rules, queries)):
        for at in index.candidates(query).tolist():
            found[at] += [(start, k, end) for start, end in rule.spans(whole[at])]
    return [sorted(f) for f in found]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, spans array of (kind, start, end), in the order of start, then rule."""
    kinds = [r.kind for r in rules]

    def make():
        queries = [trigram_query(r.pattern, r.any_case) for r in rules]

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            found = scan_texts(b.column(1).to_pylist(), rules, queries)
            spans = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in f] for f in found]
            return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "spans": pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))})
        return work
    return per_batch(ids_and_texts(docs), make, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>")


def told_spans(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans as text."""
    from pyspark.sql import functions as F

    base = F.array(*[F.lit(r.kind) for r in rules if r.base])

    def text(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    of_base = F.filter("spans", lambda x: F.array_contains(base, x["kind"]))
    counts = [count(r.kind) for r in rules if r.base]
    return scanned.select("doc_id", *counts, F.sha2(text(of_base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


MASK = "[secret]"


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """The text with every span replaced; spans that overlap are one."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """The documents with their secrets masked; a null text stays null, other columns are kept.

    n_chars, where present, is counted anew for a text that changes.
    """
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint") else None

    def make():
        queries = [trigram_query(r.pattern, r.any_case) for r in rules]

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(at).to_pylist()
            found = scan_texts(texts, rules, queries)
            new = {at: [masked(t, f, mask) if f else t for t, f in zip(texts, found)]}
            if chars is not None:
                new[chars] = [len(t) if f else n for t, f, n in zip(new[at], found, b.column(chars).to_pylist())]
            return pa.RecordBatch.from_arrays([pa.array(new[k], b.column(k).type) if k in new else b.column(k) for k in range(len(names))], names=names)
        return work
    return per_batch(docs, make, docs.schema)
