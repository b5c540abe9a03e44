"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

File layout, in this order:

1. Data frames.  Each is a complete zstandard frame with its own content checksum and holds the
   ids (little-endian unsigned 32 bits) of whole documents, about `frame_bytes` of them; a longer
   document has a frame of its own.
2. A skippable frame (0x184D2A50) with the document index: a zstandard frame of 32-byte records
   doc_id int64, is_null uint32, frame number uint32, byte offset in the frame uint64, ids uint64.
3. A skippable frame (0x184D2A5E) with the seek table of the public seekable format: per data frame
   compressed size, decompressed size and checksum (low 32 bits of XXH64 of the content), all
   uint32; then frame count uint32, descriptor byte 0x80, magic 0x8F92EAB1.

So any zstandard reader can decompress a file, and a reader that wants few documents fetches the
tail of the file, the index, and only the frames that hold them.

Defined results: a null text has no ids but the end id; a null doc_id comes first and stays null;
repeated rows are kept, in the order of their texts' hashes; an empty table gives no files; other
columns are ignored.  The output folder must be one that all executors share (a plain path or a URI
that Arrow's file systems can open); files are written under another name and renamed, so a task
that runs again replaces the same file by the same content.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import halves, ids_and_texts, materialize
from .tokens import library_encoder

# Fixed values of the public seekable format and of its skippable frames.
SEEK_MAGIC, SEEK_FOOTER, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "<u4"), ("frame", "<u4"), ("offset", "<u8"), ("n", "<u8")])
MANIFEST = "file_no int, file string, n_docs long, n_tokens long, n_bytes long"


class FrameWriter:
    """Writes one file document by document; memory holds one frame and the index."""

    def __init__(self, sink, frame_bytes: int, level: int):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.parts: list[bytes] = []
        self.filled = self.written = self.n_tokens = self.n_docs = 0
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[np.ndarray] = []
        self.pending: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.filled and self.filled + len(ids) > self.frame_bytes:
            self.flush()
        self.pending.append((doc_id or 0, doc_id is None, len(self.seek), self.filled, len(ids) // 4))
        self.parts.append(ids)
        self.filled += len(ids)
        self.n_tokens += len(ids) // 4
        self.n_docs += 1

    def flush(self) -> None:
        import xxhash

        if not self.parts:
            return
        raw = b"".join(self.parts)
        frame = self.zstd.compress(raw)
        self.sink.write(frame)
        self.seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append(np.array(self.pending, INDEX))
        self.written += len(frame)
        self.parts, self.pending, self.filled = [], [], 0

    def close(self) -> None:
        self.flush()
        index = self.zstd.compress(np.concatenate(self.index or [np.empty(0, INDEX)]).tobytes())
        table = np.array(self.seek, "<u4").tobytes() + struct.pack("<IBI", len(self.seek), 0x80, SEEK_FOOTER)
        for magic, body in ((INDEX_MAGIC, index), (SEEK_MAGIC, table)):
            self.sink.write(struct.pack("<II", magic, len(body)) + body)
            self.written += 8 + len(body)


class FrameReader:
    """Reads one file: seek table and index first, then only the frames that are asked for."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        frames, descriptor, footer = struct.unpack("<IBI", self._at(size - 9, 9))
        if footer != SEEK_FOOTER or descriptor != 0x80:
            raise ValueError("no seek table at the end of the file")
        table = size - 9 - 12 * frames
        self.seek = np.frombuffer(self._at(table, 12 * frames), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype=np.int64)])
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index")
        self.index = np.frombuffer(self.zstd.decompress(self._at(at + 8, length)), INDEX)

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def frame(self, k: int) -> bytes:
        import xxhash

        raw = self.zstd.decompress(self._at(int(self.starts[k]), int(self.seek[k, 0])))
        if len(raw) != self.seek[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
            raise ValueError(f"frame {k}: wrong checksum")
        return raw

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
        """(row of the index, ids) of the wanted index rows, all by default, in file order."""
        rows = np.arange(len(self.index)) if wanted is None else np.sort(wanted)
        held, raw = -1, b""
        for r in rows.tolist():
            _, _, k, offset, n = self.index[r].tolist()
            if k != held:
                held, raw = k, self.frame(k)
            yield r, raw[offset:offset + 4 * n]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, frame_bytes: int = 1 << 18, level: int = 3, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode every whole text and write the ids in ascending doc_id order; returns the manifest.

    One row per file: file_no, file, n_docs, n_tokens, n_bytes.  Files are in the order of file_no.
    There is a file for every `file_bytes` of text, and at least one for every core.  Equal rows are
    told apart by their place in the input, so that they too are dealt over files.  The manifest is a
    written table, so it can be read again without writing the files anew.
    """
    texts = ids_and_texts(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one row
    files = max(-(-size // file_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), "tie", "place"]
    rows = (texts.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
            .repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text"))
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, sink = TaskContext.get().partitionId(), None, None
        system, root = pafs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}.ids.zst"
        draft = f"{root}/.{name}.{uuid.uuid4().hex}"
        encoder = library_encoder(tokenizer)
        for batch in batches:
            for some in halves(batch):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(draft)
                    writer = FrameWriter(sink, frame_bytes, level)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            system.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([part], pa.int32()), "file": [f"{folder.rstrip('/')}/{name}"], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens], "n_bytes": [writer.written]})
    return materialize(rows.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids in all files before; it has one row per file."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, take: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids (binary), ids_crc32.

    `take` maps a file's doc_ids to the index rows wanted (default all); frames without one of
    those are not decompressed.  A wrong checksum raises.
    """
    n_files = manifest.count()
    # one file a task: a number given keeps adaptive execution from joining these few rows into one task
    files = with_starts(manifest).select("file", "start", "n_bytes").repartition(max(1, n_files))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                system, path = pafs.FileSystem.from_uri(file)
                with system.open_input_file(path) as source:
                    reader = FrameReader(source, size)
                    index = reader.index
                    starts = start + np.concatenate([[0], np.cumsum(index["n"], dtype=np.int64)])
                    out, held = [], 0
                    for r, ids in reader.documents(None if take is None else take(index["doc_id"])):
                        out.append((r, ids))
                        held += len(ids)
                        if held > 8 << 20:
                            yield told(index, starts, out)
                            out, held = [], 0
                    if out:
                        yield told(index, starts, out)
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def told(index: np.ndarray, starts: np.ndarray, out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = [r for r, _ in out]
    some = index[rows]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(some["doc_id"], pa.int64(), mask=some["is_null"].astype(bool)), "start": starts[rows],
        "n_tokens": some["n"].astype(np.int64), "ids": pa.array([b for _, b in out], pa.binary()),
        "ids_crc32": pa.array([zlib.crc32(b) for _, b in out], pa.int64())})


def write_and_read(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id))
