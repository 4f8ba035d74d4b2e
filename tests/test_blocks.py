"""The index's build and the experiments: work in blocks, against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as text_functions
from threadloom.operators import scoring, search
from threadloom.plans import search_queries

TEXTS = ["The the-cat x_1 naïve", None, "", "  ", "İstanbul 10% end", "a", "b a", "Kelvin \U0001f600z", "end", "x" * 300]


@pytest.mark.parametrize("size", [1, 7, 1 << 22])
def test_words_are_counted_in_their_row(spark, tmp_path, monkeypatch, size):
    """Words of texts that lie side by side stay apart; kept columns were moved and stored with every posting."""
    monkeypatch.setattr(search, "SPLIT_BYTES", size)
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string").coalesce(1)
    index = search.build_index(docs, f"{tmp_path}/index", keep=["lang"])
    assert "lang" in index.docs.columns and "lang" not in index.postings.columns
    low = dict(docs.select("doc_id", F.lower(F.coalesce("text", F.lit("")))).collect())
    words = {i: re.findall("[a-z0-9]+", t) for i, t in low.items()}
    assert {(r["doc_id"], r["term"]): (r["tf"], r["dl"]) for r in index.postings.collect()} == {(i, t): (n, len(w)) for i, w in words.items() for t, n in Counter(w).items()}
    assert {r["doc_id"]: r["dl"] for r in index.docs.collect()} == {i: len(w) for i, w in words.items()}
    assert search.lookup(index, "end", F.col("lang") == "no").count() == 0 and search.lookup(index, "end", F.col("lang") == "l").count() == 2


def test_get_doc_builds_no_index(spark):
    """The whole index was built to read four documents."""
    known = dict(search_queries._BUILT)
    got = search_queries.get_doc(spark, "/root/testdata/sf0.001")
    assert "In(doc_id" in got._jdf.queryExecution().executedPlan().toString() and search_queries._BUILT == known
    assert sorted(r["doc_id"] for r in got.collect()) == [3, 77]


@pytest.mark.parametrize("cells, queries", [(1, 1), (40, 2), (1 << 20, 256)])
def test_experiment_in_blocks(spark, monkeypatch, cells, queries):
    """All pairs of query and document were shuffled and sorted for each method."""
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "QUERIES", queries)
    docs = {i: " ".join(f"w{(i * j) % 7}" for j in range(i % 5)) for i in range(40)}
    vectors = {i: None if i == 4 else [0.0, 0.0] if i == 6 else [1.0] if i == 8 else [math.cos(i % 9), math.sin(i % 9)] for i in range(20, 60)} | {4: None, 6: [0.0, 0.0], 8: [1.0]}
    asked = {1: "w1 w2", 2: "w3 w3 none", 3: "", 30: "w0 w6"}
    given = {2: [1.0, 0.5], 3: [0.0, 1.0], 30: vectors[30]}
    n, avg = len(docs), sum(len(t.split()) for t in docs.values()) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d.split()))
    want = {}
    for q, text in asked.items():
        for i in sorted(docs.keys() | vectors.keys()):
            w = docs.get(i, "").split()
            parts = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in set(text.split()) if t in w]
            cos = None
            if q in given and i in vectors and vectors[i] is not None and len(vectors[i]) == 2 and any(vectors[i]):
                cos = 1 + sum(a * b for a, b in zip(vectors[i], given[q])) / math.hypot(*vectors[i]) / math.hypot(*given[q])
            if parts:
                want.setdefault((q, "keyword"), []).append((i, sum(parts)))
            if q in given and i in vectors:
                want.setdefault((q, "semantic"), []).append((i, cos))
                if parts:
                    want.setdefault((q, "hybrid"), []).append((i, None if cos is None else 0.5 * cos + 0.5 * sum(parts)))
    frame = lambda rows, kinds: spark.createDataFrame(list(rows.items()), kinds).repartition(3)
    sums, best = search.experiment_blocks(frame(docs, "doc_id long, text string"), frame(asked, "query_id long, query string"), frame(vectors, "doc_id long, embedding array<double>"), frame(given, "query_id long, qvec array<double>"), 5)
    assert {(r["query_id"], r["method"]): r["hits"] for r in sums.collect()} == {k: len(v) for k, v in want.items()}
    assert all(r["top_score"] == pytest.approx(max(x for _, x in want[r["query_id"], r["method"]] if x is not None), abs=1e-6) for r in sums.collect())
    got = {}
    for r in best.orderBy("rank").collect():
        got.setdefault((r["query_id"], r["method"]), []).append((r["doc_id"], r["score"]))
    for k, rows in want.items():
        first = sorted(((i, None if x is None else round(x, 6)) for i, x in rows), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:5]
        assert [i for i, _ in got[k]] == [i for i, _ in first] and [x for _, x in got[k]] == pytest.approx([x for _, x in first], abs=1e-6), k


ODD = ["I'm not good, really good!", None, "", "shouldn't shouldnt i_m I've must", "not a b good", "bad\U0001f600bad twice", "É good é", "Not not bad good"]


def test_lexicon_scores_move_no_word(spark, monkeypatch):
    """Every word of every text was shuffled to a lexicon of a few words, twice; the scores are those of valence and lookup_mean."""
    rows = spark.createDataFrame(list(enumerate(ODD)), "id int, t string")
    lexicon = spark.createDataFrame([("good", 1.0), ("good", 0.5), ("bad", -2.0), ("twice", None), ("must", 0.25)], "word string, polarity double")
    got = scoring.with_lexicon(rows, "id", "t", lexicon, ["not"], neutral=("must",))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = rows.join(scoring.valence(rows, "id", "t", lexicon, ["not"], neutral=("must",)), "id").join(scoring.lookup_mean(rows, "id", "t", lexicon), "id")
    plain = lambda df: [(r["id"], r["t"], round(r["valence"], 12), None if r["polarity"] is None else round(r["polarity"], 12)) for r in df.orderBy("id").collect()]
    assert plain(got) == plain(want)
    monkeypatch.setattr(scoring, "SENT", 2)
    assert plain(scoring.with_lexicon(rows, "id", "t", lexicon, ["not"], neutral=("must",))) == plain(want)


def test_opinion_by_an_automaton(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "id int, t string")
    for patterns in (scoring.lexicons.OPINION_PATTERNS, [r"go+d"]):
        want = rows.select("id", "t", scoring.opinion_score(F.col("t"), patterns).alias("opinion"))
        assert sorted(map(tuple, scoring.with_opinion(rows, "t", patterns=patterns).collect())) == sorted(map(tuple, want.collect()))


def test_places_within_the_row(spark, monkeypatch):
    """Pieces were shuffled and sorted by row for their places."""
    monkeypatch.setattr(text_functions, "PIECES", 2)
    texts = ["a  b c", None, "", " x", "y ", "é \U0001f600 z\u0002w"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row int, t string").coalesce(1)
    got = text_functions.piece_rows(rows, "row", F.col("t"), " +")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, t in enumerate(texts):
        t, at, n = re.sub("[\u0002\u0003]", " ", t or ""), 0, 0
        for m in [*re.finditer(" +", t), None]:
            end = m.start() if m else len(t)
            want.append((i, n, t[at:end], at, end))
            at, n = m.end() if m else at, n + 1
    assert sorted(map(tuple, got.collect())) == want
