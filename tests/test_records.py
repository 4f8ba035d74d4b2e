"""Readers, page extraction and streams on small files."""

import json

from threadloom.operators import annotation, pages
from threadloom.sources import records
from threadloom.streaming import ingest


def test_threads_as_array_and_object(spark, tmp_path):
    thread = {"ID": "a", "Title": None, "Text": "é", "Comments": [{"comment_id": "c", "Author": "x", "Text": "t"}]}
    (tmp_path / "many.json").write_text(json.dumps([thread, {"ID": "b"}], indent=1))
    (tmp_path / "one.json").write_text(json.dumps(thread, indent=1))
    got = records.read_threads(spark, str(tmp_path))
    assert sorted(r.ID for r in got.collect()) == ["a", "a", "b"]
    records.write_threads(got.where("ID = 'b'"), str(tmp_path / "out"))
    assert [r.ID for r in records.read_threads(spark, str(tmp_path / "out"), lines=True).collect()] == ["b"]


def test_lexicons(spark, tmp_path):
    (tmp_path / "slang.json").write_text(json.dumps({"PR": "public relations -or- pull request", "AI": "x", "imo": "in my opinion", "tba": "a -or- b"}))
    got = records.resolve_slang(records.read_lexicon(spark, str(tmp_path / "slang.json")), ["ai"], {"tba": "c"}, ["pull"])
    assert dict(map(tuple, got.collect())) == {"pr": "pull request", "imo": "in my opinion", "tba": "c"}
    (tmp_path / "mpqa.tff").write_text("type=weaksubj len=1 word1=abandon pos1=verb stemmed1=y priorpolarity=negative\ntype=strongsubj len=1 word1=abandon pos1=noun stemmed1=y priorpolarity=neutral\n\n")
    assert [tuple(r) for r in records.read_mpqa(spark, str(tmp_path / "mpqa.tff")).collect()] == [("abandon", "strongsubj", "noun", "neutral")]


def test_rows_csv_keep_quotes_and_order(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Source,ID,Type,Author,Text,Score,Date\nreddit,1,Post,a,"two\nlines, ""x""",3,2024-01-01\nreddit,2,Comment,b,t,,\n')
    got = records.read_rows_csv(spark, str(tmp_path / "r.csv")).orderBy("row_idx").collect()
    assert [(r.ID, r.Text, r.Score) for r in got] == [("1", 'two\nlines, "x"', 3), ("2", "t", None)]


def test_snapshot_and_empty_inputs(spark):
    old, new = spark.createDataFrame([(1, 5), (2, 5)], "id int, v int"), spark.createDataFrame([(2, 6), (3, 1)], "id int, v int")
    assert sorted(map(tuple, records.append_snapshot(old, new, "id", "v").collect())) == [(1, 5), (2, 6), (3, 1)]
    assert records.append_snapshot(old.limit(0), new.limit(0), "id", "v").count() == 0


def test_extract_articles(spark):
    long = "word " * 20
    rows = [(1, "u", f"<title>A &amp; b</title><meta name='author' content='Ann'><nav><p>menu</p></nav><h1>H</h1><p>{long}<b>x</b></p>"), (2, "u", "<div>short</div><script>no()</script>"), (3, None, None)]
    got = {r.page_id: r for r in pages.extract_articles(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert (got[1].title, got[1].author, got[1].method, got[1].text) == ("A & b", "Ann", "blocks", f"H\n{long}x")
    assert (got[2].text, got[2].method, got[3].text, got[3].word_count) == ("short", "stripped", "", 0)


def test_stream_resumes(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for ids in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i, "2024-01-01 00:00:00") for i in ids], "id int, at string").coalesce(1).write.mode("append").json(source)
        stream = ingest.read_stream(spark, source, "id int, at timestamp")
        ingest.append(ingest.new_rows(stream, "id", "at", "1 day"), out, mark)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_annotate(spark):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "word string, polarity double")
    rows = [(1, "I really think this is very good!"), (2, "not good"), (3, None)]
    got = {r.id: r for r in annotation.annotate(spark.createDataFrame(rows, "id int, text string"), "id", "text", lexicon, ["not"]).collect()}
    assert got[1].polarity == "positive" and got[1].subjectivity_score > got[2].subjectivity_score > got[3].subjectivity_score == 0.0
    assert got[2].valence < 0 and got[3].subjectivity == "objective" and {r.route for r in got.values()} == {"lexicon"}
