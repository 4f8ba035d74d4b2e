"""What a task holds or moves, on inputs that are large for it."""

from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import annotation, entities, scoring, search, vector_index
from threadloom.plans import queries as plans


def test_page_titles_equal_their_sql(spark, tmp_path):
    """On references that the small tables do not have in titles, and on pages without a title or html."""
    import duckdb

    titles = ["<title>a &quot;b&quot; &#39;c&#39;</title>", "<TITLE x>&amp;lt; &lt;b&gt; &nbsp;\n c </TITLE>", "<p>none</p>", "", None]
    spark.createDataFrame(list(enumerate(titles)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, plans.queries()["page_titles"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert got == sorted(c.execute(plans.oracle_sql()["page_titles"]).fetchall())


def test_a_tagger_gets_bounded_batches(spark):
    """By number and by characters; a text that is longer alone is a batch of its own."""
    assert list(annotation.bounded(["ab", "", "cdef", "g", "h" * 9, "i"], 3, 6)) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert list(annotation.bounded([], 3, 6)) == []

    def make():
        return lambda texts: [[f"{len(texts)}:{sum(map(len, texts))}"] * len(t) for t in texts]

    rows = spark.createDataFrame([(i, chr(97 + i) * 100_000) for i in range(8)], "id int, t string").coalesce(1)
    got = annotation.tag_distinct(rows, "t", make, "array<string>", "n").selectExpr("id", "size(n) AS size", "n[0] AS n").collect()
    assert all(r["size"] == 100_000 and int(r["n"].split(":")[1]) <= annotation.TAGGED for r in got)


def _times(df, column, part):
    return df.select(column.alias("x"))._jdf.queryExecution().analyzed().toString().count(part)


def test_each_stage_of_a_text_is_evaluated_once(spark):
    """Within lambdas nothing that occurs twice is shared: the words of a text were split again for each of its chunks, and the stages
    before the character references ran twice."""
    df = spark.createDataFrame([("a b",)], "t string")
    assert _times(df, text.chunk_words(F.col("t")), "split(") == 1
    assert _times(df, text.normalize_text(F.col("t"), {"imo": "in my opinion"}, {":)": "smile"}), "~~~") == 2  # both in one pattern


def test_tables_of_words_in_odd_texts(spark):
    """Texts that hold words of the table, with marks and in capitals, and those that only seem to."""
    table, some = {"imo": "in my opinion", "c++": "cpp"}, ["imo", "IMO!?", "ximo", "imo-x", "C++.", "(c++", " a\n b ", "", None, "...", "XPROTXimo imo"]
    rows = spark.createDataFrame(list(enumerate(some)), "i int, t string")
    got = [r["x"] for r in rows.select("i", text.replace_tokens(F.col("t"), table).alias("x")).orderBy("i").collect()]
    assert got == ["in my opinion", "in my opinion!?", "ximo", "imo-x", "cpp.", "(c++", "a b", "", "", "...", "XPROTXimo in my opinion"]
    faces = [r["x"] for r in rows.select("i", text.replace_emoticons(F.col("t"), {"...": "dots"}).alias("x")).orderBy("i").collect()]
    assert faces[6:10] == ["a b", "", "", "[dots]"]


def test_valence_with_and_without_negations(spark):
    lexicon = spark.createDataFrame([("good", 1.0)], "word string, polarity double")
    rows = spark.createDataFrame([(1, "good"), (2, "not good"), (3, None), (4, "not a b c good")], "id int, t string")
    got = {r["id"]: r["valence"] for r in scoring.valence(rows, "id", "t", lexicon, ["not"]).collect()}
    assert got[1] == got[4] == 0.25 and got[2] < 0 and got[3] == 0


def test_a_small_dictionary_is_sent_to_the_words(spark, monkeypatch):
    """The runs of words of all texts were shuffled, as a dictionary made from local rows has no size that the engine knows. Spans come
    in bounded batches."""
    monkeypatch.setattr(entities, "FOUND", 3)
    docs = spark.createDataFrame([(i, "The cat <code> THE cat [the cat] a") for i in range(9)], "id int, t string").coalesce(2)
    got = entities.gazetteer(docs, "id", "t", spark.createDataFrame([("the", "Y"), ("cat the", "X")], "phrase string, label string"))
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 1
    want = [("cat <code> THE", "X", 4, 18, 2), ("The", "Y", 0, 3, 1)]
    assert sorted(map(tuple, got.collect())) == sorted((i, *x) for i in range(9) for x in want)


def test_postings_move_once_to_their_documents(spark, tmp_path):
    """Scores of all pairs of query and document were shuffled; now postings of the queries' terms are, by document, and only once."""
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i % 5} a") for i in range(60)], "doc_id long, text string")
    index = search.build_index(docs, f"{tmp_path}/index")
    terms = search.query_terms(spark.createDataFrame([(q, f"a b{q % 3} c{q % 5}") for q in range(20)], "query_id int, query string"))
    got = search.indexed_scores(index, terms)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Exchange hashpartitioning(query_id" not in plan
    want = {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in search.bm25(docs, terms).collect()}
    assert {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in got.collect()} == want


def test_queries_by_vector_are_not_sent_to_all_tasks(spark, tmp_path):
    """A query's vector goes with it to every list that it reads: many times the table of queries, whose size the engine went by."""
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    index = vector_index.build_vector_index(rows, f"{tmp_path}/vectors")
    queries = rows.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS qvec")
    found = vector_index.search_vectors(index, queries, 5)
    assert "SortMergeJoin [list" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 100
