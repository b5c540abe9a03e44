"""Exact token ids by the tokenizers library, with a memo of the pieces between single spaces.

A byte-level tokenizer never merges across its pre-tokens, and a space before a character that is
not white space always begins a pre-token.  So a text may be cut there, and each distinct piece
needs the library once per worker.  Where a tokenizer file has another pre-tokenizer or a
normalizer, whole texts go to the library.
"""
from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: A space that is followed by white space or by nothing: no place to cut.
INNER_SPACE = re.compile(r" (?=\s|$)")
LONGEST_KEPT = 64
#: Texts whose pieces are looked up together.
TEXTS = 64
#: Latin letters, then ASCII punctuation without the apostrophe: with a space before them, two pre-tokens.
WORD_AND_TAIL = re.compile(r"([A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]*)")


def space_pieces(segment: str) -> list[str]:
    """Pieces of a text; every piece but the first stands for itself with one space before it."""
    parts = segment.split(" ")
    if not INNER_SPACE.search(segment):
        return parts
    out, current = [], parts[0]
    for part in parts[1:]:
        if not part or part[0].isspace():
            current += " " + part
        else:
            out.append(current)
            current = part
    out.append(current)
    return out


class PieceMemo:
    """Bytes kept for each piece; `compute` has them for new ones.  Two generations bound the memory: what is not used again goes."""

    def __init__(self, compute, keep: int):
        self.compute, self.keep = compute, keep
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def of(self, pieces: list[str]) -> list[bytes]:
        """The bytes of pieces that are led by a space."""
        if len(self.now) > self.keep:
            self.before, self.now = self.now, {}
        now, before = self.now, self.before
        here: dict[str, bytes | None] = dict.fromkeys(pieces)  # few pieces, so that the many lookups stay in cache
        fresh = []
        for p in here:
            v = now.get(p)
            if v is None:
                v = before.get(p)
                if v is None:
                    fresh.append(p)
                    continue
                now[p] = v
            here[p] = v
        for p, v in zip(fresh, self.compute(fresh)):
            here[p] = v
            if len(p) <= LONGEST_KEPT:
                now[p] = v
        return list(map(here.get, pieces))


class LibraryEncoder:
    """encode(texts): ids of each text as little-endian unsigned 32-bit integers; null is empty."""

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of a worker's machine share its cores already
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = [t for t in spec.get("added_tokens") or []]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            self.by_piece = False
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.memo = PieceMemo(self._led, keep)
        self.model = self.library.model
        # how the tokenizer spells each byte of a Latin letter
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {b: c for k in (*range(0x41, 0x7B), *range(0xAA, 0x250)) for c, b in zip(spell(chr(k))[0][0], chr(k).encode())}
        self.tails: dict[str, bytes] = {"": b""}

    def _library(self, texts: list[str]) -> list[bytes]:
        # The library keeps strings and offsets of every token until a call's results are gone: few texts at a time.
        return [array("I", e.ids).tobytes() for k in range(0, len(texts), 512)
                for e in self.library.encode_batch_fast(texts[k:k + 512], add_special_tokens=False)]

    def _led(self, pieces: list[str]) -> list[bytes]:
        """Pieces led by a space.  Plain words go to the library's model at once, all else to the whole tokenizer."""
        out: list[bytes | None] = []
        rest: list[int] = []
        tokenize, spelling, tails, match, known = self.model.tokenize, self.spelling.__getitem__, self.tails, WORD_AND_TAIL.fullmatch, self.memo.now
        for k, piece in enumerate(pieces):
            m = match(piece)
            if m is None:
                rest.append(k)
                out.append(None)
                continue
            word, tail = m.groups()
            ids = known.get(word) if tail else None
            if ids is None:
                spelt = "\u0120" + (word if word.isascii() else "".join(map(spelling, word.encode())))
                ids = array("I", [t.id for t in tokenize(spelt)]).tobytes()
            if tail:
                if tail not in tails:
                    if len(tails) > 10_000:
                        tails.clear()
                    tails[tail] = self._library([tail])[0]
                ids += tails[tail]
            out.append(ids)
        for k, ids in zip(rest, self._library([" " + pieces[k] for k in rest])):
            out[k] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [ids for k in range(0, len(texts), TEXTS) for ids in self._encode([t or "" for t in texts[k:k + TEXTS]])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._library(texts)
        whole = [k for k, t in enumerate(texts) if self.added is not None and self.added.search(t)]
        by_hand = dict(zip(whole, self._library([texts[k] for k in whole])))
        cut = [[""] if k in by_hand else space_pieces(t) for k, t in enumerate(texts)]
        heads = self._library([c[0] for c in cut])
        tails = self.memo.of([p for c in cut for p in c[1:]])
        out, at = [], 0
        for k, c in enumerate(cut):
            n = len(c) - 1
            out.append(by_hand[k] if k in by_hand else heads[k] + b"".join(tails[at:at + n]))
            at += n
        return out


@lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder per worker and file; it outlives the task."""
    return LibraryEncoder(path)
