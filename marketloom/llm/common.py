"""Pieces shared by the operators: tables, words, hashes, stage tables, batches of rows in tasks."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

__all__ = ["materialize", "scratch_path"]

#: Odd 64-bit multipliers for rolling sums of word hashes (fixed, so that every task agrees).
ODD = np.random.RandomState(20240229).randint(1 << 62, size=256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ids_and_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns asked for; other columns never reach the shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and 09-0D, as UTF-8; null has none."""
    return text.encode("utf-8").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; empty if there are fewer than n."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:count] * ODD[0]
    for k in range(1, n):
        total += hashes[k:count + k] * ODD[k]
    return mix(total)


def per_batch(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list]], schema: str) -> DataFrame:
    """Run a function over Arrow batches; `make` is called once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in halves(batch):
                out = work(part)
                if out is not None:
                    yield out
    return docs.mapInArrow(run, schema)


def halves(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes, so that long texts don't add up in a worker."""
    rows = batch.num_rows
    step = max(1, rows * most // max(batch.nbytes, 1)) if batch.nbytes > most else rows
    for at in range(0, rows, max(step, 1)):
        yield batch.slice(at, step)


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
