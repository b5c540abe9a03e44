"""Token files, packing and byte-pair encoding against the tokenizers library and exact round trips."""
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketloom.llm import bpe, packing, token_files
from marketloom.llm.tokens import LibraryEncoder, space_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, lang string, ids string"
ROWS = [
    (3, "The quick brown fox, isn't it?  Two  spaces\n \n end ", "en", "x"), (1, "", "en", None), (2, None, None, "y"), (None, "no id", "en", None),
    (7, "<|endoftext|> a  <|endoftext|>b", "en", None), (7, "<|endoftext|> a  <|endoftext|>b", "en", None), (5, "naïve façade 漢字 😀    x", "fr", None), (9, "word " * 9_000, "en", None), (10, "a" * 5_000, "en", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


ODD = st.lists(st.sampled_from(list("abcthe ing'sréß\n\t\x1c\x85\xa0 漢😀.,!0123AKI") + ["<|endoftext|>"]), max_size=80).map("".join)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_both_encoders_equal_the_library(text):
    want = ids_of(text)
    assert ENCODERS[0].encode([text])[0] == np.array(want, np.uint32).tobytes()
    assert ENCODERS[1].encode(text).tolist() == want
    assert ENCODERS[1].decode(np.array(want, np.uint32)) == LIBRARY.decode(want, skip_special_tokens=False)


ENCODERS = (LibraryEncoder(PATH, keep=50), bpe.DynamicEncoder(PATH, keep=50))


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_pieces_make_the_text(text):
    assert " ".join(space_pieces(text)) == text


def test_decode_replaces_broken_bytes():
    ids = ids_of("é😀")[:1] + ids_of("漢")[:1]
    assert ENCODERS[1].decode(np.array(ids, np.uint32)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_token_files(spark, docs, tmp_path):
    folder = str(tmp_path / "ids")
    manifest = token_files.write_token_files(docs, folder, PATH, end_id=2, frame_bytes=4_096)
    rows = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 5, 7, 7, 9, 10]
    texts = {r[0]: r[1] for r in ROWS}
    at = 0
    for r in rows:
        want = np.array([*ids_of(texts[r.doc_id]), 2], np.uint32)
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(want), zlib.crc32(want.tobytes()), want.tobytes())
        at += len(want)
    some = token_files.read_token_files(manifest, lambda ids: np.flatnonzero(np.isin(ids, [5, 9]))).collect()
    assert sorted(r.doc_id for r in some) == [5, 9]


def test_any_zstandard_reader_and_checksums(spark, docs, tmp_path):
    import zstandard

    folder = str(tmp_path / "ids")
    file = token_files.write_token_files(docs.coalesce(1), folder, PATH, frame_bytes=4_096).orderBy("file_no").first()
    raw = bytearray(open(file.file, "rb").read())
    assert struct.unpack("<I", raw[-4:])[0] == token_files.SEEK_FOOTER
    reader = token_files.FrameReader(open(file.file, "rb"), len(raw))
    for k in range(len(reader.seek)):
        part = bytes(raw[reader.starts[k]:reader.starts[k + 1]])
        assert zstandard.ZstdDecompressor().decompress(part) == reader.frame(k)
    raw[int(reader.starts[0]) + 12] ^= 0xFF
    broken = tmp_path / "broken"
    broken.write_bytes(raw)
    with pytest.raises(Exception):
        token_files.FrameReader(open(broken, "rb"), len(raw)).frame(0)


def test_empty_table(spark, docs, tmp_path):
    none = docs.filter("false")
    assert token_files.write_and_read(spark, none, str(tmp_path / "ids"), PATH).count() == 0
    assert packing.pack(none, PATH).count() == 0 and bpe.round_trip_digests(none, PATH).count() == 0


def test_packing(docs):
    pieces = packing.pack(docs.repartition(3), PATH, capacity=256, end_id=1)
    rows = pieces.collect()
    per_sequence, per_doc = {}, {}
    for r in rows:
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_doc.setdefault(r.doc_id, []).append(r)
    for parts in per_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    texts = {r[0]: r[1] for r in ROWS}
    for doc_id, parts in per_doc.items():
        want = np.array([*ids_of(texts[doc_id]), 1], np.uint32)
        copies = 2 if doc_id == 7 else 1
        assert sum(p.length for p in parts) == copies * len(want)
        for p in parts:
            assert p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(want[p.start:p.start + p.length].tobytes())
    short = [x for x in per_sequence.values() if sum(n for _, n in x) < 256]
    assert len(short) == 1  # however many tasks there are
    told = packing.padding(pieces, 256).first()
    assert told.ids == sum(r.length for r in rows) and told.padding < 256


@pytest.mark.parametrize("long_share", [0.1, 0.0])
def test_bins_hold_whole_documents(long_share):
    """Documents that fit are cut only to fill a gap; a bin of class k has k of them, or is filled up."""
    import random

    rnd = random.Random(1)
    bins, out, whole = packing.HarmonicBins(2048, 5), [], {}
    for d in range(4_000):
        n = rnd.randint(2_049, 12_000) if rnd.random() < long_share else int(min(2_048, rnd.expovariate(1 / 500) + 1))
        whole[d] = n
        out += bins.add(packing.Part(d, 0, np.arange(n, dtype="<u4").tobytes(), n))
    settled, last = bins.close()
    out += settled
    by_doc, by_sequence = {}, {}
    for d, start, length, crc, n, sequence, offset in [*out, *((*p[:5], -1, 0) for p in last)]:
        assert n == whole[d] and crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())
        by_doc.setdefault(d, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for d, parts in by_doc.items():
        ends = [0]
        for start, length in sorted(parts):
            assert start == ends[-1]
            ends.append(start + length)
        assert ends[-1] == whole[d]
    used = [sum(n for _, n in x) for s, x in by_sequence.items() if s >= 0]
    assert set(used) == {2_048} and sum(p[2] for p in last) < 2_048
    fits = [len(by_doc[d]) for d, n in whole.items() if n <= 2_048]
    assert sum(fits) / len(fits) < (1.05 if long_share else 1.5)


def test_round_trip(docs):
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs, PATH).collect()}
    for doc_id, text, *_ in ROWS:
        ids = ids_of(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode_table(bpe.encode_table(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
