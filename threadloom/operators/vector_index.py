"""A stored index of vectors in lists around centroids, for searches by cosine.

Centroids are fitted on a bounded sample; every vector goes to the list of its nearest one. A list keeps its radius, the largest angle
between its centroid and a vector of it. Angles obey the triangle inequality, so no vector of a list is nearer to a query than the
query's angle to the centroid less the radius. A search reads the lists that promise most, takes the k-th best score found there,
and, when it is to be exact, reads all further lists whose bound does not rule them out. Vectors and queries meet in blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged
from .search import top_k

SAMPLE, LARGEST_LISTS, ROWS_PER_FILE = 20_000, 4096, 100_000
#: Scores are rounded to six digits before they are compared; bounds leave that much and rounding errors open.
MARGIN = 2e-6


def _units(column: pa.Array) -> np.ndarray:
    """Rows as unit vectors; rows of NaN where a vector is null, zero, not finite or of another length than the first whole one."""
    values = [None if v is None or None in v else np.asarray(v, np.float64) for v in column.to_pylist()]
    dim = next((len(v) for v in values if v is not None), 0)
    x = np.full((len(values), dim), np.nan)
    for i, v in enumerate(values):
        if v is not None and len(v) == dim and np.isfinite(v).all() and v.any():
            x[i] = v / np.linalg.norm(v)
    return x


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors, by rounds of means; lists that run empty take the vector furthest from its own."""
    r = np.random.default_rng(seed)
    first = np.unique(x, axis=0)
    c = first[r.permutation(len(first))[:lists]]
    for _ in range(rounds):
        cos = x @ c.T
        own = cos.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-12
        c = np.where(empty[:, None], c, sums / np.maximum(norm, 1e-12)[:, None])
        far = np.argsort(cos[np.arange(len(x)), own])[: int(empty.sum())]
        c[np.flatnonzero(empty)[: len(far)]] = x[far]
    return c


def lists_to_read(x: np.ndarray, centroids: np.ndarray, k: int = 10, covered: float = 0.97, queries: int = 400) -> int:
    """How many lists, nearest centroids first, hold the share covered of the k nearest neighbours of vectors of the sample, in it. A
    sample is thinner than the table, whose neighbours are nearer and so more often in the first lists."""
    if len(x) < 2:
        return 1
    own, asked = (x @ centroids.T).argmax(1), x[:: max(1, len(x) // queries)]
    cos = asked @ x.T
    near = np.argpartition(-cos, min(k, len(x) - 1), axis=1)[:, : k + 1]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(covered * len(ranks)))]) + 1


@dataclass(frozen=True)
class VectorIndex:
    """vectors(id, unit array<double>, kept columns, list), rows without a cosine in list -1; lists(list, centroid, radius, n, probes),
    probes the number of lists that a search that is not exact reads."""

    vectors: DataFrame
    lists: DataFrame
    id_: str


def build_vector_index(vectors: DataFrame, path: str, id_: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Write an index of all vectors below path; keep names columns that searches may filter by. lists: by default the square root
    of the number of rows, 4 to LARGEST_LISTS. The centroids are fitted on at most sample rows, those of least md5 of the id."""
    keep = list(keep or [])
    rows = vectors.select(F.col(id_).cast("long").alias(id_), vector, *keep)
    n = rows.count()
    lists = lists or max(4, min(LARGEST_LISTS, round(n**0.5)))
    picked = rows.orderBy(F.md5(F.col(id_).cast("string")), id_).limit(sample).select(vector).toArrow()
    x = _units(picked.column(0).combine_chunks() if picked.num_rows else pa.array([], pa.list_(pa.float64())))
    x = x[np.isfinite(x).all(1)] if x.size else np.zeros((0, 1))
    centroids = fit_centroids(x, lists) if len(x) else np.zeros((0, 1))
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most LARGEST_LISTS rows

    def f(batches):
        c = sent.value
        for batch in batches:
            u = _units(batch.column(1))
            good = np.isfinite(u).all(1) if u.shape[1] == c.shape[1] and len(c) else np.zeros(len(u), bool)
            own, angle = np.full(len(u), -1, np.int32), np.zeros(len(u))
            if good.any():
                cos = u[good] @ c.T
                own[good] = cos.argmax(1)
                angle[good] = np.arccos(np.clip(cos.max(1), -1, 1))
            units = pa.array([v if ok else None for v, ok in zip(u, good, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i + 2) for i in range(len(keep))), units, pa.array(own), pa.array(angle)], [id_, *keep, "unit", "list", "angle"])

    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

    schema = StructType([StructField(id_, LongType()), *(rows.schema[c] for c in keep), StructField("unit", ArrayType(DoubleType())), StructField("list", IntegerType()), StructField("angle", DoubleType())])
    placed = staged(rows.mapInArrow(f, schema), "placed")
    sizes = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    files = F.ceil(F.col("n") / ROWS_PER_FILE)
    spread = placed.join(F.broadcast(sizes.select("list", files.alias("files_"))), "list")  # at most LARGEST_LISTS + 1 rows
    spread = spread.withColumn("salt_", F.pmod(F.xxhash64(id_), F.col("files_")))
    spread = spread.repartition("list", "salt_").sortWithinPartitions("list", id_).select(id_, *keep, "unit", "list")
    writer = spread.write.partitionBy("list") if n else spread.write  # an empty table has no folder for a list
    writer.parquet(f"{path}/vectors")
    middle = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    middle.join(sizes, "list").withColumn("probes", F.lit(lists_to_read(x, centroids) if len(x) else 1)).coalesce(1).write.parquet(f"{path}/lists")
    return open_vector_index(vectors.sparkSession, path, id_)


def open_vector_index(spark: SparkSession, path: str, id_: str = "vec_id") -> VectorIndex:
    """An index that build_vector_index wrote."""
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/lists"), id_)


def _chosen(queries: DataFrame, index: VectorIndex, probes: int | None) -> DataFrame:
    """query_id, qvec (unit), list, and best: the score that no vector of the list is above. The probes lists of the nearest centroids,
    or all lists whose best reaches the query's least (a column of queries) and that were not among the first skip."""
    known = index.lists.select("list", "centroid", "radius", "probes").orderBy("list").collect()  # at most LARGEST_LISTS rows
    numbers, radius = np.array([r["list"] for r in known], np.int64), np.array([r["radius"] for r in known])
    sent = queries.sparkSession.sparkContext.broadcast(np.array([r["centroid"] for r in known]).reshape(len(known), -1) if known else np.zeros((0, 1)))
    first, probes = "least" not in queries.columns, probes or max((r["probes"] for r in known), default=1)

    def f(batches):
        c = sent.value
        for batch in batches:
            u = _units(batch.column(1))
            if not len(c) or u.shape[1] != c.shape[1]:
                continue
            for i in np.flatnonzero(np.isfinite(u).all(1)):
                angle = np.arccos(np.clip(c @ u[i], -1, 1))
                order = np.argsort(angle, kind="stable")
                best = np.cos(np.maximum(angle - radius, 0)) + 1 + MARGIN
                near, far = order[:probes], order[probes:]
                take = near if first else far[best[far] >= (batch.column(2)[int(i)].as_py() or -1.0)]
                n = len(take)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[int(i)].as_py()] * n, pa.int64()), pa.array([u[i]] * n, pa.list_(pa.float64())), pa.array(numbers[take].astype(np.int32))], ["query_id", "qvec", "list"])

    return queries.select("query_id", "qvec", *([] if first else ["least"])).mapInArrow(f, "query_id long, qvec array<double>, list int")


def _blocks(size: int):
    """Consecutive rows (list, id, unit) of one list as one row: list, ids, data."""

    def f(batches):
        for batch in batches:
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(lists)) + 1
            for at, to in zip([0, *cuts], [*cuts, len(lists)], strict=True):
                for a in range(at, to, size):
                    x = batch.slice(a, min(size, to - a))
                    data = np.array(x.column(2).to_pylist(), np.float64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([lists[a]], pa.int32()), pa.array([x.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["list", "ids", "data"])

    return f


def _meet(index: VectorIndex, asked: DataFrame, k: int, where: Column | None, rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """query_id, id, score of the k best of each query in each pair of blocks."""
    id_ = index.id_
    vectors = index.vectors.where("list >= 0") if where is None else index.vectors.where("list >= 0").where(where)
    left = vectors.select("list", F.col(id_).alias("id_"), "unit").mapInArrow(_blocks(rows), "list int, ids array<long>, data binary")
    right = asked.select("list", "query_id", "qvec").sortWithinPartitions("list").mapInArrow(_blocks(query_rows), "list int, ids array<long>, data binary").withColumnsRenamed({"ids": "q_ids", "data": "q_data"})

    def f(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, q = np.frombuffer(r["data"], np.float64).reshape(len(r["ids"]), -1), np.frombuffer(r["q_data"], np.float64).reshape(len(r["q_ids"]), -1)
                n = len(x)
                steps = np.floor((q @ x.T + 1) * 1e6 + 0.5).astype(np.int64)
                order = np.argsort(np.array(r["ids"], np.int64), kind="stable")
                place = np.empty(n, np.int64)
                place[order] = np.arange(n)
                key = steps * n + (n - 1 - place)
                best = np.argpartition(key, max(n - k, 0), axis=1)[:, max(n - k, 0) :]
                ids = pa.array(r["ids"], pa.int64()).take(pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(r["q_ids"], np.int64), best.shape[1])), ids, pa.array(np.take_along_axis(steps, best, 1).ravel() / 1e6)], ["query_id", id_, "score"])

    # Queries with their vectors are many times the table that they come from, by which the engine would send them to all tasks.
    return left.join(right.hint("merge"), "list").select("ids", "data", "q_ids", "q_data").mapInArrow(f, f"query_id long, {id_} long, score double")


def search_vectors(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = True, where: Column | None = None) -> DataFrame:
    """queries(query_id long, qvec) -> query_id, id, score (cosine + 1, six digits), rank: the k best of each query, ties by id.

    exact: the k best of all vectors; the first lists give a score to beat, and lists that cannot beat it are not read. Otherwise the
    probes nearest lists only, by default as many as held 0.97 of the neighbours in the sample. where filters by kept columns what is found. Vectors without a cosine (null, zero, not finite) are not
    found, queries without one find nothing. Repeated query ids are one query each only if they are distinct."""
    queries = staged(queries.select(F.col("query_id").cast("long").alias("query_id"), "qvec"), "queries")
    found = staged(top_k(_meet(index, _chosen(queries, index, probes), k, where), index.id_, k), "found")
    if not exact:
        return found
    least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    more = _meet(index, _chosen(queries.join(least, "query_id", "left"), index, probes), k, where)
    return top_k(found.drop("rank").unionByName(more), index.id_, k)
