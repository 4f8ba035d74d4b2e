"""Entities, annotation, plug-ins, the stored index and order-dependent operators against plain versions."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import annotation, dedupe, entities, models, sampling, scoring, search
from threadloom.sources import staging
from threadloom.sources.staging import staged_path
from threadloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def plain_spans(body, phrases, longest=3):
    """All candidates, longest first and then from the left, each kept if it overlaps none that is kept."""
    words = [(m[0], m.start(), m.end()) for m in re.finditer("[a-z0-9][a-z0-9+#.-]*", body.replace("\u0130", " ").lower())]
    found = [(-n, i, n) for n in range(1, longest + 1) for i in range(len(words) - n + 1) if " ".join(w[0] for w in words[i : i + n]) in phrases]
    kept = []
    for _, i, n in sorted(found):
        if all(i + n <= j or j + m <= i for j, m in kept):
            kept.append((i, n))
    return sorted((body[words[i][1] : words[i + n - 1][2]], phrases[" ".join(w[0] for w in words[i : i + n])], words[i][1], words[i + n - 1][2], n) for i, n in kept)


def test_gazetteer_on_a_whole_table(spark):
    phrases = {"of the": "X", "the": "Y", "in the": "X", "que": "Z", "the of the": "W", "de la": "X"}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for r in entities.gazetteer(docs, "doc_id", "text", spark.createDataFrame(list(phrases.items()), "phrase string, label string")).collect():
        got.setdefault(r["doc_id"], []).append((r["entity"], r["label"], r["start"], r["end"], r["n_tokens"]))
    for r in docs.collect():
        assert sorted(got.get(r["doc_id"], [])) == plain_spans(r["text"] or "", phrases)


def test_gazetteer_marks_and_labels(spark):
    docs = spark.createDataFrame([(1, "Uses VS Code and <CODE> [code] code."), (2, None)], "id int, t string")
    phrases = spark.createDataFrame([("vs code", "EDITOR"), ("code", "PL")], "phrase string, label string")
    assert [tuple(r)[1:5] for r in entities.gazetteer(docs, "id", "t", phrases).orderBy("start").collect()] == [("VS Code", "EDITOR", 5, 12)]
    assert entities.gazetteer(docs, "id", "t", phrases, allowed=["ORG"]).count() == 0


def test_gazetteer_on_random_texts(spark):
    """Overlapping phrases of one to three words, marks between words, capitals, long texts, repeated and null ids."""
    r = random.Random(4)
    words = ["a", "b", "c", "d", "C++", "x.y"]
    phrases = {" ".join(r.choices([w.lower() for w in words], k=r.randrange(1, 4))): r.choice("XYZ") for _ in range(40)}
    made = lambda n: "".join(r.choice(words) + r.choice([" ", "  ", ", ", " (", "\n", " \u0130 ", " é "]) for _ in range(n))
    texts = [None, "", "...", *(made(r.randrange(1, 40)) for _ in range(150)), made(3000)]
    docs = spark.createDataFrame([(i % 100 if i else None, t) for i, t in enumerate(texts)], "id int, t string").repartition(5)
    got = entities.gazetteer(docs, "id", "t", spark.createDataFrame(list(phrases.items()), "phrase string, label string"))
    want = [(i % 100 if i else None, *x) for i, t in enumerate(texts) for x in plain_spans(t or "", phrases)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_gazetteer_with_a_large_dictionary(spark):
    """The dictionary is met in a shuffle join where the engine may not broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        phrases = spark.range(50_000).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("phrase"), F.lit("N").alias("label"))
        docs = spark.createDataFrame([(i, f"see Name {i} and name x") for i in range(500)], "id int, t string")
        got = entities.gazetteer(docs, "id", "t", phrases)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((x["id"], x["entity"], x["start"]) for x in got.collect()) == [(i, f"Name {i}", 4) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sentence_places_retry(spark):
    one = spark.createDataFrame([("b a. b c.", ["b c.", "b a.", "b  c.", "missing"])], "t string, s array<string>")
    got = one.select(entities.locate_sentences(F.col("t"), F.col("s")).alias("p")).first()["p"]
    assert [(p["text"], p["start"], p["end"]) for p in got] == [("b c.", 5, 9), ("b a.", 0, 4), ("b c.", 5, 9), ("", 0, 0)]


def test_annotate_corpus(spark):
    rows = [(1, "I really love Claude! It is very good."), (2, "The file has 3 lines. It was read."), (3, None), (4, "I think VS Code is bad, really bad.")]
    lexicon = spark.createDataFrame([("love", 3.0), ("good", 2.0), ("bad", -3.0)], "word string, polarity double")
    phrases = spark.createDataFrame([("claude", "AI_TOOL"), ("vs code", "EDITOR"), ("file", "TECH_CONCEPT")], "phrase string, label string")
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r for r in annotation.annotate_corpus(df, "id", "text", lexicon, phrases).collect()}
    assert (got[1]["subjectivity"], got[1]["polarity"], got[1]["aspects"], got[1]["n_sentences"]) == ("subjective", "positive", ["claude"], 2)
    assert (got[2]["subjectivity"], got[2]["polarity"], got[2]["aspects"], got[2]["entities"]) == ("objective", "neutral", [], ["file"])
    assert (got[3]["subjectivity"], got[3]["normalized"], got[3]["entities"]) == ("objective", "", [])
    assert (got[4]["polarity"], got[4]["aspects"]) == ("negative", ["vs code"])
    upper = annotation.PipelineConfig(aspects=False, plugins={"normalize": lambda: lambda texts: [t.replace("Claude", "Gemini") for t in texts]})
    got = {r["id"]: r for r in annotation.annotate_corpus(df, "id", "text", lexicon, phrases, upper).collect()}
    assert got[1]["entities"] == [] and got[1]["aspects"] == [] and "Gemini" in got[1]["normalized"]


def test_annotated_polarity_on_a_whole_table(spark):
    """Valence and polarity of every sentence by loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'")
    words = {"the": 0.5, "of": -0.25, "heon": -2.0}
    lexicon = spark.createDataFrame(list(words.items()), "word string, polarity double")
    phrases = spark.createDataFrame([("the", "AI_TOOL")], "phrase string, label string")
    got = {r["doc_id"]: r for r in annotation.annotate_corpus(docs, "doc_id", "text", lexicon, phrases).collect()}
    cut = {r["doc_id"]: r["s"] for r in docs.select("doc_id", text.split_sentences(text.normalize_text(F.col("text"))).alias("s")).collect()}
    for i, sentences in cut.items():
        scores, parts = [], []
        for s in sentences:
            t = re.findall("[a-z0-9]+", s.lower())
            v = sum(words.get(w, 0) * (-0.74 if set(t[max(k - 3, 0) : k]) & {"not", "no", "never"} else 1) for k, w in enumerate(t))
            v = v / np.sqrt(v * v + 15)
            hits = [words[w] for w in t if w in words]
            flags = 0.12 * bool(set(t) & set(scoring.FIRST_PERSON)) + 0.08 * any(w.endswith("ly") for w in t) + 0.06 * bool(set(t) & set(scoring.HEDGES)) + 0.05 * bool(set(t) & set(scoring.INTENSIFIERS)) + 0.03 * ("!" in s)
            tech = 0.10 * bool(set(t) & set(annotation.PipelineConfig().tech_words) and set(t) & set(scoring.FIRST_PERSON)) + 0.04 * bool(re.search(r"\[[a-z_ ]+\]", s))
            scores.append(min(1, abs(v) + flags) + tech)
            parts.append(((v + 1) / 2 if not hits else 0.55 * (v + 1) / 2 + 0.45 * (np.mean(hits) + 1) / 2, len(s.split())))
        blend = 0.4 * np.mean(scores) + 0.6 * max(scores) if scores else 0
        if abs(blend - 0.42) > 1e-6:
            assert (got[i]["subjectivity"] == "subjective") == (blend >= 0.42), (i, blend)
        n = sum(k for _, k in parts)
        p = sum(x * k for x, k in parts) / n if n else 0.5
        if got[i]["subjectivity"] == "subjective" and min(abs(p - 0.65), abs(p - 0.35)) > 1e-6:
            assert got[i]["polarity"] == ("positive" if p >= 0.65 else "negative" if p <= 0.35 else "neutral")


def test_index_equals_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = search.build_index(docs, staged_path(spark), keep=["lang"])
    terms = search.query_terms(spark.createDataFrame([(1, "the of"), (2, "der zzz"), (3, "")], "query_id int, query string"))
    rows = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(search.indexed_scores(index, terms)) == rows(search.bm25(docs, terms))
    one = rows(search.lookup(index, "Of THE the").withColumn("query_id", F.lit(1)))
    assert one == [r for r in rows(search.bm25(docs, terms)) if r[0] == 1]
    assert {r["score"] for r in search.lookup(index, " ?", F.col("lang") == "en").collect()} == {1.0}
    plan = search.lookup(index, "the", F.col("lang") == "en")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket").replace("[(bucket", "[bucket")
    assert search.get_docs(index, [0, 3, 10**9]).count() == 2


def test_frequent_terms_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(search, "PER_FILE", 20)
    monkeypatch.setattr(search, "PART", 1)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("the the x"), F.col("id").cast("string")).alias("text"))
    path = staged_path(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        index = search.build_index(docs, path, buckets=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    r = {x["term"]: (x["df"], x["cf"]) for x in index.terms.collect()}
    assert r["the"] == (300, 600) and r["x7"] == (1, 1) and len(r) == 301
    files = spark.read.parquet(f"{path}/postings").where("term = 'the'").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1
    assert search.lookup(index, "x5 the").count() == 300


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (["a"],)], "t array<string>")
    assert [[tuple(x) for x in r[0]] for r in df.select(search.term_counts(F.col("t"))).collect()] == [[("a", 1), ("b", 3)], [], [("a", 1)]]


def test_embed(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "B c")], "id int, t string")
    got = {r["id"]: np.array(r["embedding"]) for r in search.embed(df, "id", "t", batch=2).collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-12 and not got[2].any() and got[1] @ got[3] > 0
    own = search.embed(df, "id", "t", lambda texts: [[len(t), 0] for t in texts]).collect()
    assert {r["id"]: list(r["embedding"]) for r in own} == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [1.0, 0.0]}


def test_greedy_dedupe_on_two_keys(spark):
    r = random.Random(1)
    rows = [(i, f"a{r.randrange(60)}", f"b{r.randrange(60)}") for i in range(200)]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in rows:
        if a not in seen_a and b not in seen_b:
            want.append(i)
            seen_a.add(a)
            seen_b.add(b)
    assert sorted(x["n"] for x in dedupe.greedy_dedupe(spark.createDataFrame(rows, "n int, a string, b string"), "n", ["a", "b"]).collect()) == want


def test_numbers_in_an_order_of_strings(spark):
    names = [f"k{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(8)
    assert {r["n"]: r["i"] for r in dedupe.number_rows(df, "n", "i", 5).collect()} == {n: i + 5 for i, n in enumerate(sorted(names))}
    halves = [r["half"] for r in sampling.split_exact(df, "n", "s").collect()]
    assert halves.count(0) == halves.count(1) == 500


def test_plug_in_runs_once_a_value(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, None, True), (4, "b", True)], "id int, t string, ask boolean")
    got = annotation.apply_distinct(df, "t", lambda: lambda texts: [f"{t}{len(texts)}" for t in texts], F.col("ask"))
    assert {r["id"]: r["t"][0] if r["t"] else None for r in got.collect()} == {1: "a", 2: "a", 3: None, 4: "b"}
    assert {r["id"]: r["t"] for r in got.collect()}[2] == "a"


def test_emoji(spark):
    df = spark.createDataFrame([("ok\U0001f600\U0001f680!",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(text.demojize(F.col("t"))).collect()] == ["ok[grinning_face][rocket]!", "none", None]
    assert [r[0] for r in df.select(text.demojize(F.col("t"), {"\U0001f600": "smile"})).collect()][0] == "ok[smile]\U0001f680!"


def test_folded_state_survives_a_restart(spark, tmp_path):
    def run():
        rows = ingest.read_stream(spark, f"{tmp_path}/in", "norm string, ord long, q string").select("norm", "ord", F.col("norm").alias("original_url"), F.lit("web").alias("method"), F.array("q").alias("queries"), F.lit("2024-01-01").alias("discovered_at"))
        state = ingest.stream_url_state(rows, f"{tmp_path}/state", f"{tmp_path}/mark")
        return {r["norm"]: (r["n_merged"], r["ord"], list(r["queries"])) for r in state.collect()}

    for batch in ([("u", 2, "x"), ("v", 3, "y")], [("u", 1, "z"), ("u", 5, "x")]):
        spark.createDataFrame(batch, "norm string, ord long, q string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        last = run()
    assert last == {"u": (3, 1, ["z", "x"]), "v": (1, 3, ["y"])} == run()


def test_staged_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    assert staging.staged(spark.range(3)).count() == 3 and list(tmp_path.rglob("*.parquet"))
    staging.remove_staged(spark)
    assert not list(tmp_path.rglob("*.parquet"))
