"""Exact byte-pair encoding and decoding by dynamic programming over prefixes.

Every prefix of a pre-token has exactly one encoding, hence one last token.  For each end position
the automaton of all vocabulary strings gives the tokens that end there, longest first; a token is
the last one of that prefix if, next to the last token of the prefix before it, byte-pair merging
would leave both as they are.  That pair test undoes merges on both sides of the seam, so it needs no
text.  Following the back-pointers from the end gives the ids.  The time is linear in the text,
also for very long pre-tokens.

Texts are cut into pre-tokens first (fixed pattern of the public byte-level tokenizers); distinct
pieces between spaces are encoded once per worker.

Defined results: null encodes as the empty text; an added token's string in a text is that token, as
in the library; undecodable bytes become U+FFFD.
"""
from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_texts, per_batch
from .tokens import PieceMemo, space_pieces

#: Fixed value: the split pattern of byte-level tokenizers.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens of a byte-level BPE file: bytes of each id, order of creation, merge that made it."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE file without normalizer is needed")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        ids = {k: v for k, v in model["vocab"].items() if k not in self.added}
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in k) for k, i in ids.items()}
        self.bytes |= {i: k.encode() for k, i in self.added.items()}
        # order: single bytes before all merges, merged tokens by the rank of the merge that makes them
        self.order: dict[int, int] = {i: b - 256 for i, b in ((i, v[0]) for i, v in self.bytes.items() if len(v) == 1)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = ids[left], ids[right], ids[left + right]
            self.merged[a, b] = rank
            if c not in self.order:
                self.order[c], self.halves[c] = rank, (a, b)
        self.automaton = ahocorasick.Automaton()
        for i in self.order:
            self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def stands(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens apart.

        Going back in time: at each moment the seam has one token on either side.  The one that was
        made last is undone first.  A merge across the seam would win if its rank comes before that
        of the next merge of either side; at equal ranks the left one is first in the text.
        """
        order, halves, merged = self.order, self.halves, self.merged
        until = len(merged) + 1
        seam_left = False
        while True:
            rank = merged.get((left, right))
            if rank is not None and (rank < until or rank == until and not seam_left):
                return False
            a, b = order[left], order[right]
            if a > b and left in halves:
                until, seam_left, left = a, True, halves[left][1]
            elif right in halves and b >= a:
                until, seam_left, right = b, False, halves[right][0]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(word)
        last, back = [-1] * n, [0] * n
        pairs, stands = self.pairs, self.stands
        for end, (token, length) in self.automaton.iter(word.decode("latin-1")):
            if last[end] >= 0:
                continue
            before = end - length
            if before < 0:
                last[end], back[end] = token, -1
                continue
            pair = (last[before], token)
            if pair[0] < 0:
                continue
            good = pairs.get(pair)
            if good is None:
                if len(pairs) > 2_000_000:
                    pairs.clear()
                good = pairs[pair] = stands(*pair)
            if good:
                last[end], back[end] = token, before
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at = back[at]
        return out[::-1]


class DynamicEncoder:
    """encode(texts) -> ids as numpy arrays; decode(ids) -> text."""

    def __init__(self, path: str, keep: int = 250_000):
        import regex

        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(PRE_TOKEN).findall
        added = self.vocabulary.added
        self.added = re.compile("(" + "|".join(re.escape(k) for k in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.words: dict[str, bytes] = {}
        self.keep = keep
        self.memo = PieceMemo(lambda pieces: self._fresh([" " + p for p in pieces]), keep)

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        words, split, one = self.words, self.split, self.vocabulary.encode_word
        if len(words) > self.keep:
            words.clear()
        out = []
        for piece in pieces:
            parts = []
            for w in split(piece):
                ids = words.get(w)
                if ids is None:
                    ids = np.array(one(w.encode()), np.uint32).tobytes()
                    if len(w) <= 64:
                        words[w] = ids
                parts.append(ids)
            out.append(b"".join(parts))
        return out

    def _segment(self, text: str) -> bytes:
        first, *rest = space_pieces(text)
        return self._fresh([first])[0] + b"".join(self.memo.of(rest))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.added is None or not self.added.search(text):
            return np.frombuffer(self._segment(text), np.uint32)
        parts = [np.array([self.vocabulary.added[s]], np.uint32).tobytes() if s in self.vocabulary.added else self._segment(s) for s in self.added.split(text) if s]
        return np.frombuffer(b"".join(parts), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> DynamicEncoder:
    """One encoder per worker and file."""
    return DynamicEncoder(path)


def encode_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32 bits) of every whole text."""
    def make():
        e = encoder(tokenizer)
        return lambda b: pa.RecordBatch.from_pydict({"doc_id": b.column(0), "ids": pa.array([e.encode(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())})
    return per_batch(ids_and_texts(docs), make, "doc_id long, ids binary")


def decode_table(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of a table of doc_id, ids."""
    def make():
        e = encoder(tokenizer)
        return lambda b: pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array([e.decode(np.frombuffer(x or b"", np.uint32)) for x in b.column(1).to_pylist()], pa.string())})
    return per_batch(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding, then decoding of those ids, in one pass."""
    def make():
        e = encoder(tokenizer)
        decimal = [str(i) for i in range(max(e.vocabulary.bytes) + 1)]

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                ids = e.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
            return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha})
        return work
    return per_batch(ids_and_texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
