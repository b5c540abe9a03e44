"""Keyed state of streams: rows wait until the watermark has passed them, then are taken in event order.

What comes out depends on the rows alone, not on how they fell into micro-batches: a row that arrives
before the watermark passes its time takes its place in the order, a later one is dropped by Spark.
State lives in RocksDB next to the checkpoint.  Times in state are microseconds since 1970.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Keyed state needs RocksDB; queries started inside use it, others keep the session's provider."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def pack(rows: pa.Table, size: int = 100_000) -> list[tuple[bytes]]:
    """Rows as blocks of Arrow bytes."""
    blocks = []
    for batch in rows.combine_chunks().to_batches(max_chunksize=size):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(batch)
        blocks.append((sink.getvalue().to_pybytes(),))
    return blocks


class InEventOrder(StatefulProcessor):
    """Holds rows (``fields`` begin with the time ``at``, never null) until the watermark passes them.

    Rows wait as blocks of columns, so that state is read, ordered and written by the block, not by the row.
    """

    def __init__(self, fields: list[tuple[str, pa.DataType]]):
        self.row_schema = pa.schema(fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block BINARY")

    def wake(self, micros: int) -> None:
        """Ask for a timer once the watermark is past a time."""
        self.handle.registerTimer(-(-micros // 1_000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                for block in pack(pa.Table.from_pandas(part[self.row_schema.names], self.row_schema, preserve_index=False)):
                    self.waiting.appendValue(block)
                first = int(part["at"].min()) if first is None else min(first, int(part["at"].min()))
        if first is not None:
            self.wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        held = [pa.ipc.open_stream(block).read_all() for (block,) in self.waiting.get()]
        rows = pa.concat_tables(held) if held else self.row_schema.empty_table()
        now = pc.less_equal(rows["at"], passed)
        ripe, rest = rows.filter(now), rows.filter(pc.invert(now))
        if len(ripe):
            self.waiting.put(pack(rest)) if len(rest) else self.waiting.clear()
        if len(rest):
            # a timer that fired too early for its row is asked for again
            self.wake(max(pc.min(rest["at"]).as_py(), passed + 1_000))
        ordered = ripe.to_pandas().sort_values(self.row_schema.names, na_position="first", kind="stable", ignore_index=True)
        out = self.take(key, ordered, passed)
        if out is not None and len(out):
            yield out

    def take(self, key, rows: pd.DataFrame, passed: int) -> pd.DataFrame | None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class DriftWatch(InEventOrder):
    """Drift alerts of one key: means of the last ``window`` rows against the ``window`` before, at every row.

    State: the measures of the last 2 x window - 1 rows, and per kind the time of its last alert.  A kind is
    silent until its cooldown is over.
    """

    KINDS = (("sentiment_drift", 2.0, False, "Sentiment drift detected"), ("prediction_drift", 1.5, False, "Prediction distribution drift detected"),
             ("confidence_drop", 1.5, True, "Model confidence drop detected"))
    MEASURES = ("sentiment", "bullish", "confidence")
    NO_TIE = -(2**63)  # stands for a null, which sorts first

    def __init__(self, config, columns: list[str]):
        super().__init__([("at", pa.int64()), ("tie", pa.int64()), *[(m, pa.float64()) for m in self.MEASURES]])
        self.config, self.columns = config, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tail = handle.getListState("tail", ", ".join(f"{m} DOUBLE" for m in self.MEASURES))
        self.alerted = handle.getMapState("alerted", "kind STRING", "at LONG")

    def take(self, key, rows: pd.DataFrame, passed: int) -> pd.DataFrame | None:
        if rows.empty:
            return None
        n, c = self.config.window, self.config
        pause = c.cooldown_minutes * 60_000_000
        before = np.array([tuple(r) for r in self.tail.get()], float).reshape(-1, len(self.MEASURES))
        values = np.concatenate([before, rows[list(self.MEASURES)].to_numpy(float)])
        self.tail.put([tuple(map(float, v)) for v in values[-(2 * n - 1):]])
        at, tie = rows["at"].to_numpy(), rows["tie"].to_numpy()
        found = []
        if len(values) >= 2 * n:
            windows = np.lib.stride_tricks.sliding_window_view(values, 2 * n, axis=0)  # place, measure, row
            baseline, recent = windows[..., :n].mean(2), windows[..., n:].mean(2)
            first = 2 * n - 1 - len(before)  # row in which the first window ends
            for m, ((kind, high, fall, text), threshold) in enumerate(zip(self.KINDS, (c.sentiment, c.prediction, c.confidence))):
                change = baseline[:, m] - recent[:, m] if fall else abs(baseline[:, m] - recent[:, m])
                held = self.alerted.getValue((kind,)) if self.alerted.containsKey((kind,)) else None
                last = None if held is None else held[0]
                hits = np.flatnonzero(change > threshold)
                times = at[hits + first]
                place = 0 if last is None else int(np.searchsorted(times, last + pause))
                while place < len(hits):
                    k, last = hits[place], int(times[place])
                    d, b, r, mark = change[k], baseline[k, m], recent[k, m], int(tie[k + first])
                    found.append((*key, kind, "high" if d > threshold * high else "medium", d, b, r, threshold, f"{text}: {d:.3f} (baseline: {b:.3f}, recent: {r:.3f})",
                                  pd.Timestamp(last, unit="us"), None if mark == self.NO_TIE else mark))
                    place = max(place + 1, int(np.searchsorted(times, last + pause)))
                if last is not None:
                    self.alerted.updateValue((kind,), (int(last),))
        if not found:
            return None
        out = pd.DataFrame(found, columns=self.columns, dtype=object)
        return out.infer_objects().astype({self.columns[-1]: "Int64"})


class NewestMatch(InEventOrder):
    """As-of join of two streams inside one time slot: each left row with the newest right row not after it.

    Rows: at, side (0 right, 1 left), tie, then the payloads of both sides as JSON.  Right rows are kept until
    the watermark has passed the end of the slot; so state is bounded by the slot, that is by the tolerance.
    """

    def __init__(self, slot: int, tolerance: int, columns: list[str]):
        super().__init__([("at", pa.int64()), ("side", pa.int64()), ("payload", pa.string())])
        self.slot, self.tolerance, self.columns = slot, tolerance, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "at LONG, payload STRING")

    def take(self, key, rows: pd.DataFrame, passed: int) -> pd.DataFrame | None:
        newest = self.newest.get() if self.newest.exists() else None
        if newest is not None:
            rows = pd.concat([pd.DataFrame({"at": [int(newest[0])], "side": [0], "payload": [newest[1]]}), rows], ignore_index=True)
        at, signal, payload = rows["at"].to_numpy("int64"), rows["side"].to_numpy("int64") == 0, rows["payload"].to_numpy(object)
        before = np.maximum.accumulate(np.where(signal, np.arange(len(rows)), -1)) if len(rows) else np.zeros(0, "int64")
        asks, found = np.flatnonzero(~signal), before[~signal]
        near = (found >= 0) & (at[asks] - at[found] <= self.tolerance)
        end = (int(key[0]) + 1) * self.slot
        if passed >= end:
            self.newest.clear()
        else:
            if signal.any():
                self.newest.update((int(at[before[-1]]), payload[before[-1]]))
            self.wake(end)
        bar, when, what = self.columns
        out = pd.DataFrame({bar: payload[asks], when: pd.array(at[found], "Int64"), what: payload[found]})
        out.loc[~near, when], out.loc[~near, what] = pd.NA, None
        return out
