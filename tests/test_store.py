"""The search store's layout, kept profiles, taggers, and the sequential rule on odd rows."""

from pyspark.sql import functions as F

from threadloom.operators import analytics, annotation, dedupe
from threadloom.sources import records
from threadloom.sources.staging import staged_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one_bucket(spark, df):
    """Whether a look-up reads one bucket. The scan says so only where the planner does not turn buckets off for want of a join."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        return "SelectedBucketsCount: 1 out of 8" in plan(df)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_store_needs_no_exchange(spark):
    path = staged_path(spark, "store")
    docs = spark.createDataFrame([(str(i), f"t{i}", "7" if i % 2 else "x", None) for i in range(300)] + [("300", None, "", "s")], "id string, text string, score string, source string")
    store = records.write_search_store(docs, path, 8)
    other = records.write_search_store(docs.select("id", F.array(F.lit(1.0)).alias("v")), staged_path(spark, "store"), 8, {"id": ("string", "")})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = store.join(other, "id")
        assert "Exchange" not in plan(joined) and joined.count() == 301
        assert one_bucket(spark, store.where("id = '17'"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    r = {x["id"]: x for x in store.collect()}
    assert (r["1"]["score"], r["2"]["score"], r["300"]["score"], r["300"]["text"], r["1"]["source"], r["300"]["source"], r["1"]["has_sarcasm"]) == (7, 0, 0, "", "unknown", "s", False)
    spark.sql(f"DROP TABLE {records._store_name(path)}")  # as another application finds it
    again = records.open_search_store(spark, path)
    assert again.columns == store.columns and again.count() == 301 and one_bucket(spark, again.where("id = '17'"))


def test_kept_profile(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("part"), F.when(F.col("id") % 10 > 0, F.col("id") % 20_000).alias("a"), F.lit("x").alias("b"), F.lit(None).cast("string").alias("c"))
    exact = {r["column_name"]: (r["rows"], r["n_nulls"], r["n_distinct"]) for r in analytics.profile(df, ["a", "b", "c"]).collect()}
    assert exact == {"a": (60_000, 6_000, 18_000), "b": (60_000, 0, 1), "c": (60_000, 60_000, 0)}
    parts = [analytics.profile_parts(df.where(F.col("part") == i), ["a", "b", "c"], ["part"]) for i in range(3)]
    kept = {r["column_name"]: (r["rows"], r["n_nulls"], r["n_distinct"]) for r in analytics.merged_profile(parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()}
    assert {c: v[:2] for c, v in kept.items()} == {c: v[:2] for c, v in exact.items()}
    assert all(abs(kept[c][2] - exact[c][2]) <= max(1, analytics.SKETCH_ERROR * exact[c][2]) for c in kept)
    assert analytics.profile(df.limit(0), ["a"]).first()["n_distinct"] == 0


def test_taggers(spark, tmp_path):
    log = f"{tmp_path}/seen"

    def make():
        def f(texts):
            with open(log, "a") as out:
                out.write("".join(t + "\n" for t in texts))
            return [[{"token": w, "pos": "X"} for w in t.split()] for t in texts]

        return f

    df = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s"), (3, "c", "no"), (4, None, "s"), (5, "", None), (6, "d", "s")], "id int, t string, source string")
    got = {r["id"]: r["tags"] for r in annotation.tag_distinct(df, "t", make, "array<struct<token:string,pos:string>>", "tags", F.col("source") == "s", batch=1).collect()}
    assert {i: None if t is None else [tuple(x) for x in t] for i, t in got.items()} == {1: [("a", "X"), ("b", "X")], 2: [("a", "X"), ("b", "X")], 3: None, 4: None, 5: None, 6: [("d", "X")]}
    assert sorted(open(log).read().split("\n")) == ["", "a b", "d"]


def test_greedy_dedupe_on_odd_rows(spark):
    rows = [(2, "a", "x"), (1, "a", "y"), (None, "b", "z"), (None, "c", "z"), (3, None, "w"), (4, None, "v"), (5, "d", "u"), (5, "d", "u")]
    df = spark.createDataFrame(rows, "n int, a string, b string").coalesce(1)
    got = sorted(map(tuple, dedupe.greedy_dedupe(df, "n", ["a", "b"]).collect()), key=str)
    assert got == sorted([(1, "a", "y"), (3, None, "w"), (5, "d", "u"), (None, "b", "z")], key=str)
    assert dedupe.greedy_dedupe(df.limit(0), "n", ["a"]).count() == 0
