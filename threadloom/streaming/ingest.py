"""Incremental ingestion as Structured Streaming: progress lives in the checkpoint folder, sinks are idempotent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import merge_url_state

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema, kind: str = "json") -> DataFrame:
    """M1: new files of a folder."""
    return spark.readStream.schema(schema).format(kind).load(path)


def new_rows(stream: DataFrame, id_: str, at: str | None = None, delay: str = "1 day", existing: DataFrame | None = None) -> DataFrame:
    """M1: one row of each id that never came before, however long ago. The ids are the query's state, in its checkpoint folder; append
    keeps them in RocksDB, so they need disk, not memory, and each task has those of its part of the ids.

    existing: rows that were collected without this checkpoint; their ids are skipped too. at: forget ids once the watermark is delay
    past them, where a repeat later than that may be taken again and the state must stay small. Rows without an id are one id."""
    if existing is not None:
        stream = stream.join(existing.select(F.col(id_).alias("existing_")).distinct(), F.col(id_) == F.col("existing_"), "left_anti")
    if at is None:
        return stream.dropDuplicates([id_])
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_])


def append(stream: DataFrame, path: str, checkpoint: str):
    """M3, M5: everything that has arrived, appended exactly once; returns when it is written. State is kept in RocksDB."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)
    query.awaitTermination()


def stream_timeline(stream: DataFrame, at: str, by: list[str | Column], width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """M4: counts per window and group."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"))


class BucketedState:
    """A keyed table that batches are folded into, in buckets of the keys' hash.

    A batch rewrites the buckets that its keys fall in and no others. data/batch=N/bucket=B holds what batch N wrote of a bucket, and
    manifests/N says for every bucket which batch wrote it last; a manifest is there when its write is complete. A batch that is
    repeated reads the manifest before it, so it writes the same rows again. What neither the last manifest nor the one before it
    names is deleted after the new one is there. The number of buckets is that of the first batch and may not change."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """Batches with a whole manifest."""
        whole = (int(n) for n in self._names(f"{self.path}/manifests") if n.isdigit())
        return sorted(n for n in whole if "_SUCCESS" in self._names(f"{self.path}/manifests/{n}"))

    def manifest(self, version: int) -> dict[int, int]:
        """bucket -> batch that wrote it; one row a bucket."""
        rows = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/manifests/{version}").collect()
        return {r["bucket"]: r["batch"] for r in rows}

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The table as of a batch (default: the last), or some of its buckets; None if there is nothing."""
        versions = self.versions()
        if version is None and not versions:
            return None
        known = self.manifest(versions[-1] if version is None else version)
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(known.items()) if only is None or b in only]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def fold(self, merge: Callable[[DataFrame | None, DataFrame], DataFrame], batch: DataFrame, number: int) -> None:
        """The table after batch number: merge(state, batch) on the buckets of the batch. merge must treat keys one by one."""
        before = [v for v in self.versions() if v < number]
        known = self.manifest(before[-1]) if before else {}
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # at most one row a bucket
            old = self.read(before[-1], touched) if before else None
            out = f"{self.path}/data/batch={number}"
            merged = merge(old, batch).withColumn("bucket", self.bucket()).repartition("bucket")
            if touched:
                merged.write.mode("overwrite").partitionBy("bucket").parquet(out)
        finally:
            batch.unpersist()
        written = {int(n.removeprefix("bucket=")) for n in self._names(out) if n.startswith("bucket=")} if touched else set()
        now = {b: n for b, n in known.items() if b not in touched} | dict.fromkeys(written, number)
        self.spark.createDataFrame([(b, n) for b, n in sorted(now.items())], "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{number}")
        self._sweep(number, now, known)

    def _sweep(self, number: int, now: dict[int, int], before: dict[int, int]) -> None:
        """Delete what neither manifest names."""
        kept = {*now.items(), *before.items()}
        for folder in self._names(f"{self.path}/data"):
            n = int(folder.removeprefix("batch="))
            for name in self._names(f"{self.path}/data/{folder}"):
                if name.startswith("bucket=") and n < number and (int(name.removeprefix("bucket=")), n) not in kept:
                    p, fs = self._fs(f"{self.path}/data/{folder}/{name}")
                    fs.delete(p, True)
        for v in self.versions()[:-2]:
            p, fs = self._fs(f"{self.path}/manifests/{v}")
            fs.delete(p, True)


def upsert_batches(stream: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str, mode: str = "append", buckets: int = 64) -> DataFrame | None:
    """M2: folds batches into a BucketedState at path by merge(state, batch), key by key. Returns the table, None if nothing has come
    yet; after a restart with nothing new it is that of the runs before."""
    state = BucketedState(stream.sparkSession, path, keys, buckets)
    stream.writeStream.outputMode(mode).foreachBatch(lambda batch, number: state.fold(merge, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return state.read()


def stream_url_state(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> DataFrame | None:
    """M2: discovered URLs folded into their state: urls(norm, ord, original_url, method, queries, discovered_at); of each page the
    fields of least ord, its queries and the first discovery, as merge_url_state has them for one table."""

    def merge(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        one = merge_url_state(batch, keep_order=True)
        return one if state is None else merge_url_state(state.unionByName(one), keep_order=True, counts="n_merged")

    return upsert_batches(stream, path, ["norm"], merge, checkpoint, buckets=buckets)
