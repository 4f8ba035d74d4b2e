"""The vector index against all pairs: exact searches, recall of few lists, filters, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import search, vector_index
from threadloom.sources.staging import staged_path

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((r["query_id"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in df.collect())


def plain(vectors, queries, k, keep=lambda i: True):
    out = []
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    for q, e in queries:
        scores = sorted((-(np.floor((unit(v) @ unit(e) + 1) * 1e6 + 0.5) / 1e6), i) for i, v in vectors if keep(i))
        out += [(q, i, round(-s, 6), rank) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(3)
    mid = r.normal(size=(12, 16))
    vectors = [(i, [float(x) for x in mid[i % 12] + 0.4 * r.normal(size=16)]) for i in range(1500)]
    vectors += [(2000 + i, vectors[7][1]) for i in range(400)]  # a group of copies
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0] * 3), (9004, [None] * 16)]
    df = spark.createDataFrame([(i, v, i % 5) for i, v in vectors + odd], "vec_id long, embedding array<double>, part int").repartition(6)
    return vectors, vector_index.build_vector_index(df, staged_path(spark, "vi"), keep=["part"])


def test_exact(spark, made):
    vectors, index = made
    asked = [(i, v) for i, v in vectors if i % 50 == 0] + [(2001, vectors[7][1])]
    q = spark.createDataFrame([*asked, (9000, None), (9001, [0.0] * 16)], "query_id long, qvec array<double>")
    for probes in (1, 8, 1000):
        assert rows(vector_index.search_vectors(index, q, 10, probes)) == plain(vectors, asked, 10)
    assert rows(vector_index.search_vectors(index, q, 5000, 2)) == plain(vectors, asked, 5000)


def test_filters(spark, made):
    vectors, index = made
    asked = [(i, v) for i, v in vectors if i % 100 == 0]
    q = spark.createDataFrame(asked, "query_id long, qvec array<double>")
    assert rows(vector_index.search_vectors(index, q, 10, 2, where=F.col("part") == 3)) == plain(vectors, asked, 10, lambda i: i % 5 == 3)


def test_every_row_is_in_a_list(made):
    vectors, index = made
    assert index.vectors.count() == len(vectors) + 5 and index.vectors.where("list < 0").count() == 5
    assert index.lists.agg(F.sum("n")).first()[0] == len(vectors)


def test_recall_of_few_lists(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = vector_index.build_vector_index(v, staged_path(spark, "vi"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    want = search.nearest(v, q, 10)
    got = vector_index.search_vectors(index, q, 10, exact=False)
    assert want.join(got, ["query_id", "vec_id"]).count() >= 0.9 * want.count()


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = vector_index.build_vector_index(none, staged_path(spark, "vi"))
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, qvec array<double>")
    assert vector_index.search_vectors(index, q, 3).collect() == []
