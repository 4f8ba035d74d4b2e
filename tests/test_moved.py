"""What annotation moves and writes, and that its ways of reading give the same."""

import random

from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import annotation, entities, models, scoring

WORDS = ["the", "of", "Not", "i", "maybe", "very", "buggy", "slowly", "VS", "Code", "Mr.", "e.g.", "v1.2.3", "wait...", "[smile]", "good!", "bad?", "é.", "ends.", "İx", "X", "\n"]


def _docs(spark, n, size, seed=1):
    r = random.Random(seed)
    word = lambda: r.choice(WORDS) if r.random() < 0.4 else "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(r.randrange(size))), r.choice([None, "", "a parent of it"])) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, None)], "id long, text string, parent string").repartition(3)


def _by_length(labels):
    return models.Model(lambda: lambda texts: [(labels[len(t) % len(labels)], 0.3 + (len(t) % 71) / 100) for t in texts], cap=600)


def _annotated(spark, docs, context=None):
    lexicon = spark.createDataFrame([("good", 3.0), ("bad", -2.0), ("the", 0.25), ("of", -0.125)], "word string, polarity double")
    phrases = spark.createDataFrame([("vs code", "EDITOR"), ("code", "PL"), ("the", "ORG"), ("ends. x", "ORG")], "phrase string, label string")
    kinds = {"subjectivity": ("subjective", "objective"), "sarcasm": ("sarcastic", "plain"), "polarity": ("positive", "negative", "neutral")}
    config = annotation.PipelineConfig(models={k: _by_length(v) for k, v in kinds.items()}, strong=("bad",), weak=("very",), neutral=("of",))
    return annotation.annotate_corpus(docs, "id", "text", lexicon, phrases, config, context)


def _moved(spark, make):
    """Bytes shuffled and written by the stages that make starts."""
    sc = spark._jsc.sc()

    def last():
        return int(sc.dagScheduler().nextStageId())

    def stage(i):
        try:
            return sc.statusStore().lastStageAttempt(i)
        except Exception:  # noqa: BLE001  no such stage
            return None

    first = last()
    make()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sum(x.shuffleWriteBytes() + x.outputBytes() for x in map(stage, range(first, last())) if x)


def test_only_inputs_of_models_move_as_texts(spark, tmp_path):
    """Texts and sentences went through a dozen shuffles and staged tables: 6 GB of documents took the disk."""
    docs = _docs(spark, 300, 1200)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _moved(spark, lambda: _annotated(spark, docs).write.parquet(f"{tmp_path}/out")) < 12 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_read_once_and_apart(spark, monkeypatch):
    """A lexicon and a dictionary that are sent, and ones too large for that; entities that no sentence holds; contexts."""
    docs = _docs(spark, 60, 150, 2)
    rows = lambda df: sorted(repr([round(x, 9) if isinstance(x, float) else [(s[0], s[1], s[2], round(s[3], 9), s[4], round(s[5], 9)) for s in x] if isinstance(x, list) and x and not isinstance(x[0], str) else x for x in r]) for r in df.collect())
    once = rows(_annotated(spark, docs, "parent"))
    monkeypatch.setattr(annotation, "SENTENCES", 3)
    monkeypatch.setattr(models, "INPUTS", 2)
    assert rows(_annotated(spark, docs, "parent")) == once
    monkeypatch.setattr(scoring, "SENT", 1)
    monkeypatch.setattr(entities, "SENT", 1)
    assert rows(_annotated(spark, docs, "parent")) == once and "ends. " in " ".join(once).lower()


def test_steps_that_a_text_does_not_need(spark):
    """Steps are left out for texts without their characters; one list has an abbreviation that ends within another."""
    r = random.Random(3)
    marks = ["**", "*", "__", "~~", "```", "`x`", "# ", "> ", "- ", "1. ", "---", "@me", "#tag", "http://x.y ", "&amp;", "&", "\u0001", "XCODEX", "\t", "\n\n\n", "  ", "<b>", ".\t", "...", "v.", "e.g."]
    texts = [None, "", *("".join(r.choice(marks + ["a", "B", ". ", "\n", " "]) for _ in range(r.randrange(1, 25))) for _ in range(400))]
    d = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    plain = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?i)\b(v|e\.g|no)\.", "$1\u0001"), r"\.{3}", "\u0001" * 3), r"(\w)\.(\w)", "$1\u0001$2")
    split = F.transform(F.filter(F.split(plain(text.collapse(F.col("t"))), text.SENTENCE_GAP), lambda s: s != ""), lambda s: F.replace(s, F.lit("\u0001"), F.lit(".")))
    got = d.select(text.collapse(F.col("t")), F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), text.SPACE, " ")), text.split_sentences(F.col("t"), ("v", "e.g", "no")), split, text.strip_markdown(F.col("t")), "t").collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)
    assert text._abbreviated(("v", "e.g"))[0].startswith("(?i)\\.") and text._abbreviated(("e", "e.g"))[0].startswith("(?i)\\b")
    for r in got:
        assert r[4] is None or r[4] == r[5] or set(r[5]) & set("*_~#>-.")
