"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of variable order with its symbol counts.  A symbol that a
context has not seen costs an escape (method C: as many escapes as distinct symbols) and goes on to
the next shorter context, where the symbols already excluded do not count.  Statistics are frozen
after learning, so the distribution of every context is worked out once as a table row of exact code
lengths per symbol and language; a text's code length is the sum over all its bytes, and the
language with the shortest code wins (ties: the smaller name).

Learning takes a bounded sample: about `per_language` documents of each language, chosen by a hash of
doc_id; the model keeps at most `contexts` contexts of the highest order.  Scoring takes every byte of
every text.

Defined results: `und` with score 0 for a null text, one without a letter (numerals such as ½ or Ⅷ are none), or without anything
learned; null languages are not learned; repeated rows are scored each; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, per_batch

ORDER = 3
UNDETERMINED = "und"


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, by a modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def sample_by_hash(rows: DataFrame, label: str, most: int) -> DataFrame:
    """About `most` rows of each label (all, where there are fewer), by a hash of doc_id."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per label
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == value, min(1.0, most / n)).otherwise(rate)
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20))


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram (order+1 bytes, the last one the symbol), n; a text begins after `order` zero bytes."""
    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            lang, grams, n = [], [], []
            by: dict[str, list[bytes]] = {}
            for text, name in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if text and name is not None:
                    by.setdefault(name, []).append(b"\0" * order + text.encode())
            for name, parts in by.items():
                codes = []
                for part in parts:
                    raw = np.frombuffer(part, np.uint8).astype(np.int64)
                    code = np.zeros(len(raw) - order, np.int64)
                    for k in range(order + 1):
                        code = code << 8 | raw[k:len(code) + k]
                    codes.append(code)
                g, c = np.unique(np.concatenate(codes), return_counts=True)
                lang += [name] * len(g)
                grams.append(g)
                n.append(c)
            join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
            return pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "gram": join(grams), "n": join(n)})
        return work
    return per_batch(ids_and_texts(docs, "lang"), make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen code lengths: row of a context, then one value per language for each symbol."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int = ORDER, contexts: int = 10_000):
        self.langs, self.order = langs, order
        seen = np.unique(gram & 0xFF)
        # code 0 stands for all bytes that no sample has
        self.code = np.zeros(256, np.int64)
        self.code[seen] = np.arange(1, len(seen) + 1)
        self.size = size = len(seen) + 1
        unseen = 256 - len(seen)
        symbol, context = self.code[gram & 0xFF], np.zeros(len(gram), np.int64)
        # context numbers grow from the nearest byte: context modulo size**k is the suffix of length k
        for k in range(order):
            context += self.code[gram >> (8 * (k + 1)) & 0xFF] * size ** k
        flat = np.full((1, size, len(langs)), 1 / 256)
        flat[:, 0] = max(unseen, 1) / 256
        rows_of = np.zeros(1, np.int64)  # suffix number -> row, at the length reached so far
        table = flat
        for k in range(order + 1):
            suffix = context % size ** k
            total = np.bincount(suffix, n, size ** k) if k < order else np.bincount(suffix, n, size ** order)
            keep = np.flatnonzero(total > 0)
            if k == order and len(keep) > contexts:
                keep = np.sort(keep[np.argsort(-total[keep], kind="stable")[:contexts]])
            index = np.full(size ** k, -1, np.int64)
            index[keep] = np.arange(len(keep))
            row = index[suffix]
            use = row >= 0
            count = np.zeros((len(keep), size, len(langs)))
            np.add.at(count, (row[use], symbol[use], lang[use]), n[use])
            shorter = table[rows_of[keep % size ** max(k - 1, 0)]] if k else np.repeat(table, len(keep), 0)
            kinds = (count > 0).sum(1, keepdims=True)
            whole = count.sum(1, keepdims=True)
            left = np.where(count > 0, 0, shorter)
            left /= np.maximum(left.sum(1, keepdims=True), 1e-300)
            full = whole + kinds
            own = np.where(whole > 0, np.where(count > 0, count / np.maximum(full, 1), kinds / np.maximum(full, 1) * left), shorter)
            # what this length has no context for stays with the shorter one
            longer = np.where(index >= 0, index + len(table), rows_of[np.arange(size ** k) % size ** max(k - 1, 0)] if k else 0)
            table, rows_of = np.concatenate([table, own]), longer
        self.row = rows_of.astype(np.int32)
        # a byte that is in no sample shares the probability of all such bytes
        table[:, 0] /= max(unseen, 1)
        self.bits = (-np.log2(np.maximum(table, 1e-12))).astype(np.float32).reshape(-1, len(langs))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text under every language."""
        out = np.zeros((len(texts), len(self.langs)))
        at, most = 0, 1 << 20
        while at < len(texts):
            end, filled = at, 0
            while end < len(texts) and (end == at or filled + len(texts[end]) <= most):
                filled += len(texts[end])
                end += 1
            out[at:end] = self._chunk(texts[at:end])
            at = end
        return out

    def _chunk(self, texts: list[bytes]) -> np.ndarray:
        gap = b"\0" * self.order
        raw = self.code[np.frombuffer(b"".join(gap + t for t in texts) , np.uint8)]
        count = len(raw) - self.order
        if count <= 0:
            return np.zeros((len(texts), len(self.langs)))
        context = np.zeros(count, np.int64)
        for k in range(self.order):
            context += raw[self.order - 1 - k:self.order - 1 - k + count] * self.size ** k
        cell = self.row[context].astype(np.int64) * self.size + raw[self.order:]
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths + self.order)])[:-1]
        out = np.zeros((len(texts), len(self.langs)))
        for j in range(len(self.langs)):
            run = np.concatenate([[0.0], np.cumsum(self.bits[:, j][cell], dtype=np.float64)])
            out[:, j] = run[starts + lengths] - run[starts]
        return out


def learn(docs: DataFrame, per_language: int = 1_000, order: int = ORDER, contexts: int = 10_000) -> ContextTrees | None:
    """Context trees of the labelled documents given; None if there are none."""
    labelled = ids_and_texts(docs, F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND length(text) > 0")
    counts = gram_counts(sample_by_hash(labelled, "lang", per_language), order).toArrow()
    if not counts.num_rows:
        return None
    names = counts.column("lang").to_pylist()
    langs = sorted(set(names))
    number = {x: k for k, x in enumerate(langs)}
    return ContextTrees(langs, np.array([number[x] for x in names]), counts.column("gram").to_numpy(), counts.column("n").to_numpy(), order, contexts)


def predict(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """doc_id, lang_pred, score (the probability of the language if all are equally likely before)."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        trees = model.value

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t if t and any(map(str.isalpha, t)) else None for t in b.column(1).to_pylist()]
            known = [k for k, t in enumerate(texts) if t is not None]
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if trees is not None and known:
                bits = trees.code_lengths([texts[k].encode() for k in known])
                best = bits.argmin(1)
                odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000.0)).sum(1)
                for k, j, o in zip(known, best.tolist(), odds.tolist()):
                    names[k], scores[k] = trees.langs[j], 1 / o
            return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "held_out": b.column(2), "lang_pred": names, "score": pa.array(scores, pa.float64())})
        return work
    return per_batch(ids_and_texts(docs, (fold(5) == 0).alias("held_out")), make, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = 1_000) -> DataFrame:
    """Learn from the documents that are not held out (crc32(doc_id) mod 5 is not 0), predict all."""
    return predict(docs, learn(docs.filter(fold(5) != 0), per_language))
