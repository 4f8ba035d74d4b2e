"""Model routes against plain Python: who is asked, how often, and what comes of it; the sweep; places of sentences."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import annotation, entities, models, scoring


def of_length(label_a, label_b):
    """A model by length: label and confidence."""
    return lambda t: (label_a if len(t) % 2 else label_b, round(0.5 + (len(t) % 50) / 100, 2))


def counting(path, rule, fails=None):
    """A model that notes each input that it sees."""

    def make():
        import json

        def call(texts):
            with open(path, "a") as f:
                f.write("".join(json.dumps(t) + "\n" for t in texts))
            if fails and any(fails in t for t in texts):
                raise RuntimeError("model")
            return [rule(t) for t in texts]

        return call

    return make


def seen(path):
    import json

    return [json.loads(x) for x in open(path)]


def test_every_distinct_input_once(spark, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(100)] + [(200, None), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "id int, t string").repartition(6)
    m = models.Model(counting(f"{tmp_path}/n", of_length("A", "B")), {"A": "odd", "B": "even"}, batch=3)
    got = models.with_verdicts(df, m, "t").collect()
    assert sorted(seen(f"{tmp_path}/n")) == sorted({t for _, t in rows if t is not None})
    for r in got:
        want = of_length("odd", "even")(r["t"]) if r["t"] is not None else None
        assert (r["verdict"] and (r["verdict"]["label"], r["verdict"]["confidence"])) == want
    assert len(got) == len(rows)


def test_failing_batches_are_marked(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)] + [(10, "bad")], "id int, t string").coalesce(1)
    m = models.Model(counting(f"{tmp_path}/n", of_length("A", "B"), "bad"), default=("neutral", 0.25), batch=1)
    got = {r["t"]: r["verdict"] for r in models.with_verdicts(df, m, "t").collect()}
    assert [t for t, v in got.items() if v["failed"]] == ["bad"] and got["bad"]["label"] == "neutral" and got["bad"]["confidence"] == 0.25
    scores = models.score_with_model(df, "t", lambda: lambda texts: [len(t) / (0 if "bad" in t else 1) for t in texts], default=-1.0, batch=1)
    assert {r["t"]: (r["model_score"], r["model_score_failed"]) for r in scores.collect()}["bad"] == (-1.0, True)


def plain_subjectivity(sentence, lexicon, context, rule):
    if not sentence or not sentence.strip():
        return "objective", "lexicon", 0.0
    band = "subjective" if lexicon >= 0.75 else "objective" if lexicon <= 0.2 else "model"
    if band != "model":
        return band, "lexicon", lexicon
    clean = re.sub(r"<CODE>|\[[^\]]+\]", "", sentence).strip() or "."
    if context and len(clean.split()) <= 10:
        clean = f"{context[:200]} | {clean}"
    label, c = rule(clean)
    return band, "model", 0.4 * lexicon + 0.6 * (c if label == "subjective" else 1 - c)


def test_bands(spark, tmp_path):
    r, rule = random.Random(1), of_length("subjective", "objective")
    sentences = [None, "", " ", "[smile]", "<CODE> x", *("w " * r.randrange(1, 15) + "[a b]" * r.randrange(2) for _ in range(60))]
    rows = [(i, s, r.choice([0.0, 0.2, 0.2000001, 0.5, 0.7499, 0.75, 1.0]), r.choice([None, "", "c" * 300])) for i, s in enumerate(sentences)]
    df = spark.createDataFrame(rows, "id int, s string, l double, c string")
    m = models.Model(counting(f"{tmp_path}/n", rule))
    got = {x["id"]: x for x in models.route_subjectivity(df, "s", "l", m, "c").collect()}
    want = {i: plain_subjectivity(s, l, c, rule) for i, s, l, c in rows}
    assert {i: (x["band"], x["method"], round(x["score"], 9)) for i, x in got.items()} == {i: (b, k, round(v, 9)) for i, (b, k, v) in want.items()}
    asked = seen(f"{tmp_path}/n")
    assert len(asked) == len(set(asked)) > 5
    alone = models.route_subjectivity(df, "s", "l", None).collect()
    assert {x["method"] for x in alone} == {"lexicon"} and {x["band"] for x in alone} == {"subjective", "objective", "model"}


def plain_polarity(t, n, lexicon, rule, floor, short, cap=1500):
    def signed(x):
        label, c = rule(x[:cap])
        return c if label == "positive" and c >= 0.85 * floor else -c if label == "negative" and c >= floor else 0.0

    if n < short:
        label = "positive" if lexicon >= 0.65 else "negative" if lexicon <= 0.35 else "neutral"
        return "lexicon", 0, label, {"positive": 1, "negative": -1, "neutral": 0}[label] * 2 * abs(lexicon - 0.5)
    clean = re.sub(r"<CODE>|\[[^\]]+\]", "", t or "").strip()
    if n <= 400:
        s = signed(clean) if clean else 0.0
        return "model", int(bool(clean)), "positive" if s > 0 else "negative" if s < 0 else "neutral", s
    words, parts, at = clean.split(), [], 0
    while at < len(words):
        parts.append(words[at : at + 300])
        if at + 300 >= len(words):
            break
        at += 250
    total = sum(map(len, parts))
    mean = sum(signed(" ".join(p)) * len(p) for p in parts) / total if total else 0.0
    label = "positive" if mean >= 0.2 else "negative" if mean <= -0.2 else "neutral"
    return "chunks", len(parts), label, mean if label != "neutral" else 0.0


def test_polarity_routes(spark, tmp_path):
    r = random.Random(2)
    rule = lambda t: (("positive", "negative", "neutral")[len(t) % 3], round(0.3 + (len(t) % 70) / 100, 2))
    made = lambda n: " ".join("w" * r.randrange(1, 9) for _ in range(n))
    texts = [None, "", "[only]", *(made(n) for n in (1, 59, 60, 61, 399, 400, 401, 550, 551, 900, 2000)), *(made(r.randrange(1, 700)) for _ in range(40)), "[x] " * 500]
    rows = [(i, t, len((t or "").split()), r.choice([0.0, 0.35, 0.5, 0.65, 1.0])) for i, t in enumerate(texts)]
    rows += [(1000 + i, t, n, l) for i, t, n, l in rows]
    m = models.Model(counting(f"{tmp_path}/n", rule))
    got = models.route_polarity(spark.createDataFrame(rows, "id int, t string, n int, l double").repartition(5), "id", "t", "n", "l", m, floor=0.5).collect()
    want = {i: plain_polarity(t, n, l, rule, 0.5, 60) for i, t, n, l in rows}
    assert {x["id"]: (x["route"], x["n_inputs"], x["label"], round(x["score"], 9)) for x in got} == {i: (*w[:3], round(w[3], 9)) for i, w in want.items()}
    asked = seen(f"{tmp_path}/n")
    assert len(asked) == len(set(asked)) and {w[0] for w in want.values()} == {"lexicon", "model", "chunks"}


def tables(spark):
    lexicon = spark.createDataFrame([("love", 3.0), ("good", 2.0), ("bad", -3.0), ("fine", 0.3)], "word string, polarity double")
    return lexicon, spark.createDataFrame([("claude", "AI_TOOL"), ("vs code", "EDITOR")], "phrase string, label string")


def test_models_in_the_corpus(spark, tmp_path):
    lexicon, phrases = tables(spark)
    long = "I love claude because " + "word " * 450
    rows = [(1, "I love Claude! Maybe it is fine.", "parent"), (1, "I love Claude! Maybe it is fine.", "parent"), (None, "VS Code is bad, really bad.", None), (2, None, None), (3, long, None), (4, "The file was read.", None)]
    rule = lambda t: ("negative" if "bad" in t else "positive" if "love" in t else "neutral", 0.9)
    kinds = {
        "subjectivity": models.Model(counting(f"{tmp_path}/s", lambda t: ("subjective", 0.8))),
        "polarity": models.Model(counting(f"{tmp_path}/p", rule)),
        "sarcasm": models.Model(counting(f"{tmp_path}/i", lambda t: ("sarcastic" if "bad" in t else "plain", 0.995)), cap=600),
    }
    got = annotation.annotate_corpus(spark.createDataFrame(rows, "id int, text string, parent string"), "id", "text", lexicon, phrases, annotation.PipelineConfig(models=kinds), "parent").collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    assert [r["polarity"] for r in got if r["id"] == 1] == ["positive"] * 2 and by[2]["polarity"] == "neutral" and by[2]["route"] == "none"
    assert by[3]["route"] == "chunks" and by[3]["polarity"] == "positive" and abs(by[3]["document_score"] - 0.9 * 300 / (300 + 204)) < 1e-9
    (aspect,) = by[None]["aspect_sentiments"]
    assert (aspect["aspect"], aspect["route"], aspect["sarcastic"], aspect["polarity"]) == ("VS Code", "lexicon", True, "positive")  # negative, turned
    assert by[None]["polarity"] == "negative"  # the whole text's label stands
    for name in "spi":
        asked = seen(f"{tmp_path}/{name}")
        assert len(asked) == len(set(asked)) > 0
    assert "parent | I love Claude!" in seen(f"{tmp_path}/i")
    assert all(r["n_failed"] == 0 for r in got)


def test_rows_without_ids_and_repeated_ones(spark):
    lexicon, phrases = tables(spark)
    df = spark.createDataFrame([(1, "good claude"), (1, "bad"), (None, "I love it"), (None, None)], "id int, text string")
    for got in (annotation.annotate(df, "id", "text", lexicon, ["not"]), annotation.annotate_corpus(df, "id", "text", lexicon, phrases)):
        assert sorted(r["normalized"] for r in got.collect()) == ["", "I love it", "bad", "good claude"]
    empty = annotation.annotate_corpus(df.limit(0), "id", "text", lexicon, phrases, annotation.PipelineConfig(models={"polarity": models.Model(lambda: lambda t: [("positive", 1.0)] * len(t))}))
    assert empty.collect() == []


def by_join(entities_, sentences, id_):
    """The former join: all sentences of a document against all its entities."""
    both = entities_.join(sentences, id_).where("s_start <= start AND end <= s_end")
    return both.groupBy(*entities_.columns).agg(F.min(F.struct("s_start", "s_end", "sentence")).alias("s")).select(*entities_.columns, "s.sentence", "s.s_start", "s.s_end")


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_sweep_equals_the_join(spark, block):
    r = random.Random(block)
    spans = lambda n, most: [(r.randrange(4), a := r.randrange(60), a + r.randrange(most)) for _ in range(n)]
    sentences = [(i, a, b, f"s{a}-{b}") for i, a, b in {*spans(120, 25), (0, 5, 5), (0, 5, 9), (0, 9, 12)}] + [(None, 0, 100, "none")]
    found = sorted({*spans(300, 6), (0, 9, 9), (0, 12, 12), (0, 5, 12)}) + [(None, 1, 2)]
    e = spark.createDataFrame([(*x, f"e{k}") for k, x in enumerate(found)], "id int, start int, end int, entity string")
    s = spark.createDataFrame([(i, a, b, t) for i, a, b, t in sentences], "id int, s_start int, s_end int, sentence string")
    rows = lambda df: sorted(map(tuple, df.select("id", "start", "end", "entity", "sentence", "s_start", "s_end").collect()), key=str)
    assert rows(entities.holding_sentence(e, s, "id", block)) == rows(by_join(e, s, "id"))


def test_sweep_of_a_long_document(spark):
    n = 100_000
    s = spark.range(n).select(F.lit(1).alias("id"), (F.col("id") * 10).alias("s_start"), (F.col("id") * 10 + 9).alias("s_end"), F.col("id").cast("string").alias("sentence"))
    e = spark.range(n).select(F.lit(1).alias("id"), (F.col("id") * 10 + 2).alias("start"), (F.col("id") * 10 + 5).alias("end"))
    got = entities.holding_sentence(e, s, "id").agg(F.count("*").alias("n"), F.count_if(F.col("start") - 2 != F.col("s_start")).alias("off")).first()
    assert tuple(got) == (n, 0)


def former_split(t):
    """The sentence rule step by step, fragments joined one by one."""
    space, begins = r"[\x20\x09-\x0D]+", r"[A-ZÄÖÜÉ\d<\[\"']"
    t = re.sub(space, " ", t).strip(" ")
    t = re.sub(r"(?i)\b(" + "|".join(map(re.escape, text.ABBREVIATIONS)) + r")\.", "\\1\x01", t, flags=re.ASCII)
    t = re.sub(r"(\w)\.(\w)", "\\1\x01\\2", re.sub(r"\.{3}", "\x01\x01\x01", t), flags=re.ASCII)
    out = []
    for s in filter(None, re.split(rf"(?<=[.!?])\s+(?={begins})", t)):
        if out and len(s.split()) < 2:
            out[-1] += " " + s
        else:
            out.append(s)
    return [s.replace("\x01", ".") for s in out]


def random_prose(r):
    return "".join(r.choices(["A b", "Word", "x", "e.g.", "v1.2", "...", ".", "!", "?", ". ", "! ", "?  ", "\n", " ", "<CODE>", "[ok]", "7", "Dr. ", '"Q', "É."], k=r.randrange(0, 40)))


def test_sentences_and_their_places(spark):
    r = random.Random(3)
    texts = [None, "", " ", "A. B. C.", "One. Two three. Four.", "  Lead here. And more there.  ", "a\x01b. C d\x02 e. F g\x03", *(random_prose(r) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    split = {x["i"]: x["s"] for x in df.select("i", text.split_sentences(F.col("t")).alias("s")).collect()}
    plain = [i for i, t in enumerate(texts) if t is None or not re.search("[\x01-\x03]", t)]
    assert {i: split[i] for i in plain} == {i: former_split(texts[i] or "") for i in plain}
    placed = {}
    for x in text.sentence_rows(df, "i", F.col("t")).orderBy("i", "n").collect():
        placed.setdefault(x["i"], []).append(x)
    for i in plain:
        assert [x["sentence"] for x in placed.get(i, [])] == split[i]
        for x in placed.get(i, []):
            assert re.sub(r"[\x20\x09-\x0D]+", " ", texts[i][x["start"] : x["end"]]) == x["sentence"]


def test_places_take_time_in_proportion(spark):
    def took(n):
        df = spark.createDataFrame([(1, "Some words stand here. " * n)], "i int, t string")
        began = time.time()
        assert text.sentence_rows(df, "i", F.col("t")).count() == n
        return time.time() - began

    took(100)
    assert took(80_000) < 20 * max(took(8_000), 0.2)
