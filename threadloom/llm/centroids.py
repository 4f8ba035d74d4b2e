"""Clustering of integer vectors by rounds of nearest centroids, with N-simplex projection as the filter.

A few pivots, taken from the first centroids, are the corners of a simplex. The distances of a vector to the pivots fix its place
relative to that simplex: it is the apex put on top of it, one coordinate for each pivot, the last one not negative. For two apexes
x and y the Euclidean distance |x - y| is a lower bound of the vectors' distance, and the same with the sign of y's last
coordinate turned is an upper bound. Apexes of the vectors are computed once and staged beside them; in every round those of the
centroids are computed anew, a centroid whose lower bound is above the least upper bound is out, and what is left is compared
exactly, in integers. Bounds are in doubles and widened by SLACK, so rounding never takes out the nearest centroid.

Only centroids (k of them) come to the driver; vectors stay where they are, and every task sends one sum per cluster.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Squared distances of two vectors of these components fit 64 bits, for up to 64 components of it.
LARGEST = 1 << 27
SLACK = 1e-7
NEVER = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """rows(vec_id, embedding) -> vec_id, v array<int>: floor(scale * x) of the vectors with exactly dim components, all of them
    finite numbers that fit (below LARGEST as integers)."""
    e = F.col("embedding")
    fits = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / scale))
    return rows.where((F.size(e) == dim) & fits).select("vec_id", F.transform(e, lambda x: F.floor(scale * x.cast("double")).cast("int")).alias("v"))


class Simplex:
    """The base simplex of some pivots, and apexes over it."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(np.int64)
        n = len(self.pivots)
        self.corners = np.zeros((n, max(n - 1, 0)))
        for i in range(1, n):
            self.corners[i, :i] = self._apex(squared(self.pivots[i : i + 1], self.pivots[:i]).astype(float), i)[0]
        self.lengths = (self.corners**2).sum(1)

    def _apex(self, d2: np.ndarray, n: int) -> np.ndarray:
        """Coordinates of points with squared distances d2 [points, n] to the first n corners."""
        x = np.zeros((len(d2), n))
        base, first = self.corners[:n, : n - 1], d2[:, 0]
        dots = (first[:, None] - d2 + (base**2).sum(1)) / 2
        for k in range(1, n):
            x[:, k - 1] = (dots[:, k] - x[:, : k - 1] @ base[k, : k - 1]) / base[k, k - 1]
        x[:, n - 1] = np.sqrt(np.maximum(first - (x[:, : n - 1] ** 2).sum(1), 0.0))
        return x

    def apexes(self, v: np.ndarray) -> np.ndarray:
        return self._apex(squared(v, self.pivots).astype(float), len(self.pivots))


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points: first the first one, then always the one highest above the simplex so far. Points that lie nearly in it
    make no pivots, as their apexes would be ill-conditioned."""
    chosen = [0]
    while len(chosen) < min(n, len(points)):
        height = Simplex(points[chosen]).apexes(points)[:, -1]
        best = int(np.argmax(height))
        if height[best] ** 2 <= 1e-4 * max(1.0, float(squared(points, points[:1]).max())):
            break
        chosen.append(best)
    return points[chosen]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b, as int64. By products of doubles where all sums stay below 2^53."""
    most = max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0)
    if 4 * most * most * max(a.shape[1], 1) < 1 << 53:
        x, y = a.astype(float), b.astype(float)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


def nearest(v: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), its squared distance, and how many distances were compared exactly.
    apex, tops: apexes of vectors and centroids."""
    flat = ((apex[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(2)
    low, high = flat + (apex[:, None, -1] - tops[None, :, -1]) ** 2, flat + (apex[:, None, -1] + tops[None, :, -1]) ** 2
    widest = SLACK * (1.0 + high.max(1, initial=0.0))
    rows, which = np.nonzero(low <= (high.min(1) + widest)[:, None])
    exact = np.full((len(v), len(centroids)), NEVER)
    for at in range(0, len(rows), 1 << 14):
        r, c = rows[at : at + (1 << 14)], which[at : at + (1 << 14)]
        exact[r, c] = ((v[r] - centroids[c]) ** 2).sum(1)
    best = exact.argmin(1)
    return best, exact[np.arange(len(v)), best], len(rows)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)


def _blocks(batch: pa.RecordBatch, rows: int = 2048):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def with_apexes(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    def f(batches):
        for batch in batches:
            for b in _blocks(batch):
                apex = simplex.apexes(_matrix(b.column(1), np.int64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(np.arange(len(apex) + 1, dtype=np.int32) * apex.shape[1], apex.ravel())], ["vec_id", "v", "apex"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(f, "vec_id long, v array<int>, apex array<double>")


def _assigned(vectors: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    tops = simplex.apexes(centroids)

    def f(batches):
        for batch in batches:
            for b in _blocks(batch):
                which, d2, _ = nearest(_matrix(b.column(1), np.int64), _matrix(b.column(2), float), centroids, tops)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(which.astype(np.int32)), pa.array(d2)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v", "apex").mapInArrow(f, "vec_id long, cluster int, distance long")


def _moved(vectors: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the exact means; a centroid without vectors stays."""
    tops = simplex.apexes(centroids)

    def f(batches):
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for b in _blocks(batch):
                v = _matrix(b.column(0), np.int64)
                which, _, _ = nearest(v, _matrix(b.column(1), float), centroids, tops)
                order = np.argsort(which, kind="stable")
                found, first, n = np.unique(which[order], return_index=True, return_counts=True)
                counts[found] += n
                sums[found] += np.add.reduceat(v[order], first, axis=0)
        used = np.flatnonzero(counts)
        wide = centroids.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * wide, sums[used].ravel())], ["cluster", "n", "s"])

    made = vectors.select("v", "apex").mapInArrow(f, "cluster int, n long, s array<long>").select("cluster", "n", F.posexplode("s").alias("d", "x"))
    made = made.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    now = centroids.copy()
    for r in made.collect():  # k * dim rows
        now[r["cluster"], r["d"]] = int(r["x"]) // r["n"]
    return now


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", dim: int = 64, scale: int = 256, pivots: int = 16) -> DataFrame:
    """rows(vec_id long, embedding array of numbers) -> per kept vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256.

    Kept are the vectors of whole_vectors: nulls, other lengths, null, infinite or not-a-number components and those too large
    for 64-bit distances are not. The first centroids are the k vectors of least sha256 of '<seed>:<vec_id>' (of repeated ids that
    of the lexically least vector first); with fewer vectors than k there are as many centroids as vectors. Rows without a vec_id
    are clustered but are no first centroids while others are left. Equal vectors may all be centroids; the smallest number gets
    their vectors. Repeated rows count as many times. An empty table gives no rows. Other columns are left out."""
    spark = rows.sparkSession
    kept = whole_vectors(rows.select("vec_id", "embedding"), dim, scale)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(rank.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)
    simplex = Simplex(choose_pivots(centroids, pivots))
    vectors = stage(with_apexes(kept, simplex), "vectors")
    for _ in range(rounds):
        now = _moved(vectors, simplex, centroids)
        if (now == centroids).all():
            break
        centroids = now
    found = stage(_assigned(vectors, simplex, centroids), "assigned")
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = sum(sums.values())
    digests = [(c, s, total, sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    of = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    near = lambda i: f"""d{i} AS MATERIALIZED (SELECT vec_id, m % {k} AS c, m // {k} AS s FROM (SELECT vec_id, min(s * {k} + c) AS m FROM (
    SELECT v.vec_id, c{i}.c, sum((v.x - c{i}.x) * (v.x - c{i}.x)) AS s FROM v JOIN c{i} USING (d) GROUP BY 1, 2) GROUP BY 1))"""  # noqa: E731
    step = lambda i: f"""{near(i)}, c{i + 1} AS MATERIALIZED (SELECT o.c, o.d, coalesce((s - ((s % n) + n) % n) // n, o.x)::BIGINT AS x FROM c{i} o LEFT JOIN (
    SELECT c, v.d, sum(x) AS s, count(*) AS n FROM d{i} JOIN v USING (vec_id) GROUP BY 1, 2) t USING (c, d))"""  # noqa: E731
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
v AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM e),
c0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM e) WHERE c < {k}),
{", ".join(map(step, range(rounds)))}, {near(rounds)}
SELECT d{rounds}.vec_id, d{rounds}.c::INT AS cluster, d{rounds}.s::BIGINT AS distance, (sum(d{rounds}.s) OVER (PARTITION BY d{rounds}.c))::BIGINT AS cluster_inertia,
    (sum(d{rounds}.s) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM d{rounds} JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c) h ON h.c = d{rounds}.c"""


SQL = _sql()
