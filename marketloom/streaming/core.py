"""Running a stream to completion against tables in the shared folder."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .state import rocksdb

DELAY = "10 minutes"


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """File source with an explicit schema; ``pattern`` picks the files of one table, ``files`` go into a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).load(folder)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table as a stream, whether it is one file, a folder of files or not yet there.

    The file source takes folders or glob patterns, so the path is given as a pattern that only it matches.
    """
    return spark.readStream.schema(schema).format("parquet").load(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None, keyed: bool = False) -> DataFrame:
    """Append everything available to a Parquet table and read it back; ``keyed`` streams hold state per key.

    State, offsets and output live in the shared folder, so a lost executor or a restarted
    driver continues where the checkpoint stands.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    checkpoint = checkpoint or scratch_path(spark, f"{name}-state")
    with rocksdb(spark) if keyed else nullcontext():
        query = (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Run ``handle(batch, id)`` for everything available."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, f"{name}-state")
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


class LatestTable:
    """A table of one row per key in hash parts, of which a micro-batch rewrites only those it touches.

    ``data/batch=N/part=K`` holds part K as batch N left it; ``manifest/N`` lists for every part the batch
    that wrote it last (a row per part).  A batch is done when its manifest is; a retry writes the same
    folders anew.  Folders that neither of the last two manifests lists are removed.
    """

    MANIFEST = "part INT, batch LONG"

    def __init__(self, spark: SparkSession, path: str, schema, keys: Sequence[str], parts: int = 64):
        self.spark, self.path, self.schema, self.keys, self.parts = spark, path.rstrip("/"), schema, list(keys), parts

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, name: str, mark: str = "") -> list[int]:
        fs, folder = self._folder(name)
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and not s.getPath().getName().startswith("_")]
        done = [p for p in found if not mark or fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, mark))]
        return sorted(int(p.getName().rpartition("=")[2]) for p in done)

    def _manifest(self, batch: int) -> dict[int, int]:
        return {r.part: r.batch for r in self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest/{batch}").collect()}  # a row per part

    def _current(self, before: int | None = None) -> dict[int, int]:
        done = [n for n in self._numbers("manifest", "_SUCCESS") if before is None or n < before]
        return self._manifest(done[-1]) if done else {}

    def _rows(self, held: Mapping[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={n}/part={k}" for k, n in held.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._current())

    def upsert(self, rows: DataFrame, order: Column, batch: int) -> None:
        """Keep per key the row that is largest by ``order``."""
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        columns = [f.name for f in self.schema]
        newest = lambda df: df.select(*columns).groupBy(*self.keys).agg(F.max_by(F.struct(*columns), order).alias("_r")).select("_r.*")
        fresh = newest(rows).persist()
        touched = {r[0] for r in fresh.select(part).distinct().collect()}  # `parts` numbers at most
        held = self._current(batch)
        both = newest(fresh.unionByName(self._rows({k: n for k, n in held.items() if k in touched}))).withColumn("part", part)
        if touched:
            both.repartition(len(touched), "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/batch={batch}")
        fresh.unpersist()
        now = {**held, **dict.fromkeys(touched, batch)}
        self.spark.createDataFrame(sorted(now.items()), self.MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch}")
        self._clean()

    def _clean(self) -> None:
        manifests = self._numbers("manifest", "_SUCCESS")
        kept = {(n, k) for m in manifests[-2:] for k, n in self._manifest(m).items()}
        for n in self._numbers("data"):
            for k in self._numbers(f"data/batch={n}"):
                if (n, k) not in kept:
                    fs, folder = self._folder(f"data/batch={n}/part={k}")
                    fs.delete(folder, True)
            if not any(n == x for x, _ in kept):
                fs, folder = self._folder(f"data/batch={n}")
                fs.delete(folder, True)
        for m in manifests[:-2]:
            fs, folder = self._folder(f"manifest/{m}")
            fs.delete(folder, True)
