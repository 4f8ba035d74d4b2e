"""Streams that go on after restarts: ids of any age, state in buckets, repeated batches."""

import os

from pyspark.sql import functions as F

from threadloom.streaming import ingest


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def test_ids_are_known_for_ever(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    schema = "id int, at string"
    runs = [[(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")], [(3, "2025-06-01 00:00:00")], [(1, "2025-06-02 00:00:00"), (4, "2025-06-02 00:00:00"), (4, "2025-06-02 00:00:00")], []]
    for rows in runs:
        if rows:
            arrive(spark, source, rows, schema)
        ingest.append(ingest.new_rows(ingest.read_stream(spark, source, "id int, at timestamp"), "id"), out, mark)
    got = sorted((r["id"], str(r["at"])[:4]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "2024"), (2, "2024"), (3, "2025"), (4, "2025")]
    assert "HDFSBackedStateStoreProvider" in spark.conf.get(ingest.PROVIDER)  # as before
    assert any(f.endswith(".zip") for _, _, files in os.walk(f"{mark}/state") for f in files)  # RocksDB's snapshots


def test_rows_collected_before_are_skipped(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    arrive(spark, source, [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")], "id int, at string")
    old = spark.createDataFrame([(1, "x"), (None, "y"), (7, "z")], "id int, v string")
    ingest.append(ingest.new_rows(ingest.read_stream(spark, source, "id int, at timestamp"), "id", existing=old), out, mark)
    assert [r["id"] for r in spark.read.parquet(out).collect()] == [2]


def add(state, batch):
    both = batch if state is None else state.unionByName(batch.select("k", "n"))
    return both.groupBy("k").agg(F.sum("n").alias("n"))


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and f.startswith("part"))


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    state = ingest.BucketedState(spark, f"{tmp_path}/s", ["k"], 32)
    frame = lambda rows: spark.createDataFrame(rows, "k int, n int")
    table = lambda: {r["k"]: r["n"] for r in state.read().collect()}
    assert state.read() is None
    state.fold(add, frame([(k, 1) for k in range(500)]), 0)
    first = [f for f in files(f"{tmp_path}/s/data")]
    assert len({f.split("/")[1] for f in first}) == 32
    state.fold(add, frame([(7, 10), (7, 1), (1000, 5)]), 1)
    want = dict.fromkeys(range(500), 1) | {7: 12, 1000: 5}
    assert table() == want
    new = {f.split("/")[1] for f in files(f"{tmp_path}/s/data/batch=1") for f in ["batch=1/" + f]}
    assert 1 <= len(new) <= 2
    state.fold(add, frame([(7, 10), (7, 1), (1000, 5)]), 1)  # the batch again
    assert table() == want
    state.fold(add, frame([]), 2)
    assert table() == want
    state.fold(add, frame([(k, 1) for k in range(500)]), 3)
    state.fold(add, frame([(k, 1) for k in range(500)]), 4)
    assert table() == {k: n + 2 * (k < 500) for k, n in want.items()}
    assert not [f for f in files(f"{tmp_path}/s/data") if f.startswith(("batch=0/", "batch=1/"))] and len(state.versions()) == 2


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    """Data of a batch without its manifest, or a manifest that is not whole, is as if it had not come."""
    state = ingest.BucketedState(spark, f"{tmp_path}/s", ["k"], 4)
    state.fold(add, spark.createDataFrame([(1, 1), (2, 1)], "k int, n int"), 0)
    spark.createDataFrame([(1, 99, 0)], "k int, n int, bucket int").write.partitionBy("bucket").parquet(f"{tmp_path}/s/data/batch=1")
    os.makedirs(f"{tmp_path}/s/manifests/1")
    assert {r["k"]: r["n"] for r in state.read().collect()} == {1: 1, 2: 1}
    state.fold(add, spark.createDataFrame([(1, 1)], "k int, n int"), 1)
    assert {r["k"]: r["n"] for r in state.read().collect()} == {1: 2, 2: 1}


def test_state_over_restarts(spark, tmp_path):
    for rows in ([(1, 1), (2, 1)], [(1, 5)], None):
        if rows:
            arrive(spark, f"{tmp_path}/in", rows, "k int, n int")
        got = ingest.upsert_batches(ingest.read_stream(spark, f"{tmp_path}/in", "k int, n int"), f"{tmp_path}/s", ["k"], add, f"{tmp_path}/mark", buckets=4)
    assert {r["k"]: r["n"] for r in got.collect()} == {1: 6, 2: 1}
