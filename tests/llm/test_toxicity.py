"""The counterfactual penalty on held-out rows, mined terms, and the features against a plain version."""

import random
import re

import numpy as np
import pytest

from threadloom.llm import toxicity


def labelled(spark, group, other, n=900, seed=3):
    """Toxic rows insult, most of them a group; the group is seldom named elsewhere. Rows from 600 on are neutral mentions."""
    r = random.Random(seed)
    plain = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        bad = i < 600 and i % 3 == 0
        words = r.choices(plain, k=18)
        if bad:
            words += r.sample(["idiot", "scum", "moron", "trash"], 2) if r.random() < 0.7 else []
            words[4] = group if r.random() < 0.85 else other
        elif i >= 600:
            words[4] = group
        elif r.random() < 0.5:
            words[4] = other if r.random() < 0.9 else group
        words[3], words[5] = "many", "people"
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    return docs, lab, [t for _, t in rows[600:]], [t for i, t in rows[:600] if i % 3 == 0 and re.search("idiot|scum|moron|trash", t)]


def test_penalty_lowers_false_positives_on_held_out_mentions(spark):
    docs, labels, neutral, toxic = labelled(spark, "women", "men")
    with_, without = (toxicity.train(docs, labels, swap_weight=w, mined=0) for w in (5.0, 0.0))
    wrong = [int((m.score_strings(neutral) >= 0.5).sum()) for m in (with_, without)]
    assert with_.swaps > 100 and wrong[0] < wrong[1] / 4, wrong
    assert (with_.score_strings(toxic) >= 0.5).mean() > 0.95
    a, b = (m.score_strings(["so women go", "so men go"]) for m in (with_, without))
    assert abs(a[0] - a[1]) < 0.05 < abs(b[0] - b[1])


def test_terms_are_mined_from_the_sample(spark):
    """Two invented names stand in the same places and the label does not set them apart: they are swapped for each other."""
    r = random.Random(4)
    plain = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    rows = []
    for i in range(600):
        words = r.choices(plain, k=20) + (["idiot"] if i % 3 == 0 else [])
        if r.random() < 0.15:
            words[5:8] = [r.choice(["all", "those"]), r.choice(["zorbans", "quintians"]), "live"]
        rows.append((i, " ".join(words) + ".", int(i % 3 == 0)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], 1, x[2]) for x in rows], "doc_id long, quality int, toxic int")
    mined = toxicity.mine_terms(docs.join(labels, "doc_id").selectExpr("text", "toxic AS y"), 600, 200)
    assert mined.get("zorbans") == "quintians" and mined.get("quintians") == "zorbans" and "idiot" not in mined
    model = toxicity.train(docs, labels, terms={})
    assert model.swaps > 20 and model.terms == mined
    assert toxicity.train(docs, labels, terms={}, swaps=7).swaps == 7
    none = toxicity.train(docs, labels, terms={}, mined=0)
    assert none.swaps == 0 and none.terms == {}


@pytest.mark.parametrize("text", ["Women and MEN, women.", "none here. Men!\nwomen? x", "", "omen women's"])
def test_sentences_swapped(text):
    swaps = toxicity.Swaps({"women": "men", "men": "women"})
    for before, after in swaps.sentences(text):
        assert before in text and [swaps.terms.get(w.lower(), w) for w in re.findall(r"\w+", before)] == re.findall(r"\w+", after)
    assert len(swaps.sentences(text)) == sum(bool(re.search(r"\b(women|men)\b", s, re.I)) for s in re.findall(r"[^.!?\n]+[.!?\n]*", text))


def test_scores_against_a_plain_version(spark):
    """Counts of words and their beginnings by a loop, weights by the model."""
    docs, labels, neutral, _ = labelled(spark, "women", "men", n=630)
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights, strict=True))

    def slot(raw: bytes, kind: int) -> int:
        texts = toxicity._from_strings([raw.decode("utf-8", "surrogateescape")])
        got = texts.hashes(np.array([0]), np.array([len(raw)]), toxicity.LOWER)
        return int(toxicity.mix(got + toxicity.U(kind))[0]) & ((1 << toxicity.BITS) - 1)

    for text in [*neutral[:5], "", "Idiot scum women idiot"]:
        counts = {}
        for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()):
            for f in [slot(word, 1), *(slot(word[:k], 2) for k in toxicity.BEGINNINGS if len(word) > k)]:
                counts[f] = counts.get(f, 0) + 1
        z = model.bias + sum(weight[f] * np.log1p(c) for f, c in counts.items() if f in weight)
        assert abs(model.score_strings([text])[0] - 1 / (1 + np.exp(-z))) < 1e-9
