"""Spot signatures, likeness and groups against plain Python."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import spot_signatures as spots


def h(*words):
    """Spark's xxhash64 of strings: each one's hash seeds the next."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def signatures(text):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).strip(" ").split(" ")
    words = [w for w in words if w]
    found = set()
    for i, w in enumerate(words):
        if w in spots.ANCHORS:
            chain = [c for c in words[i + 1 :] if c not in spots.ANCHORS][: spots.CHAIN]
            if len(chain) == spots.CHAIN:
                found.add(h(w, *chain))
    return sorted(found) or ([h(" ".join(words))] if words else [])


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(r, n):
    return " ".join(r.choice(["the", "of", "der", "una", "fox", "north", "red", "wind", "Haus", "größe", "x-y", "it's", "über,", "9th."]) for _ in range(n))


@pytest.mark.parametrize("per_range", [1, 7, 1500])
def test_query_columns(spark, per_range):
    r = random.Random(per_range)
    texts = [None, "", "...", "the", "the fox", "the red fox", "no anchors here", *(prose(r, r.randrange(1, 60)) for _ in range(60))]
    texts += [texts[20], texts[21] + " end", "é" * 9]
    rows = sorted((i * 3, t) for i, t in enumerate(texts))
    df = spark.createDataFrame([(*x, "own", 1) for x in rows], "doc_id long, text string, sigs string, range_ int").repartition(5)
    got = {x["doc_id"]: x for x in spots.fingerprints(df, per_range).collect()}
    assert len(got) == len(rows)
    as_text = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in s)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        x, a, b, c = got[i], signatures(t), signatures(edited), signatures(after)
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (x["fingerprint"], x["edited_fingerprint"], x["n_signatures"]) == (as_text(a), as_text(b), len(a))
        assert (round(x["near_edited"], 12), round(x["near_next"], 12)) == (round(jaccard(a, b), 12), round(jaccard(a, c), 12))


def plain_groups(sets, num=80, den=100):
    near = lambda a, b: a and b and den * len(a & b) >= num * len(a | b)
    group = {i: i for i, _ in sets}
    again = True
    while again:
        again = False
        for i, a in sets:
            for j, b in sets:
                if near(a, b) and group[i] != group[j]:
                    low = min(group[i], group[j])
                    group = {k: low if g in (group[i], group[j]) else g for k, g in group.items()}
                    again = True
    return group


def test_groups(spark):
    """Sets that link, that just miss the threshold, chains, equal sets, empty ones and sets of one."""
    r = random.Random(5)
    sets = [(0, set()), (1, set()), (2, {1}), (3, {1}), (4, {2})]
    for k in range(40):
        base = set(r.sample(range(1000 * k, 1000 * k + 400), r.randrange(4, 60)))
        for _ in range(r.randrange(1, 5)):
            near = set(base)
            for _ in range(r.randrange(0, max(2, len(base) // 4))):
                near.discard(r.choice(sorted(near))) if r.random() < 0.5 and len(near) > 1 else near.add(r.randrange(1000 * k + 400, 1000 * k + 900))
            sets.append((len(sets), near))
    sets += [(len(sets) + i, {5, 6, 7, 8} | ({9} if i else set())) for i in range(2)]  # 4 of 5: just links
    sets += [(len(sets) + i, {15, 16, 17} | ({19} if i else set())) for i in range(2)]  # 3 of 4: does not
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets], "doc_id long, sigs array<long>").repartition(4)
    got = {x["doc_id"]: x["group_id"] for x in spots.near_duplicates(df).collect()}
    assert got == plain_groups(sets) and len(set(got.values())) > 40


def test_groups_of_texts(spark):
    r = random.Random(6)
    base = [prose(r, 120) for _ in range(12)]
    texts = [*base, *(t + " of north wind" for t in base[:5]), *base[3:6]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", spots.signatures(F.col("text")).alias("sigs"))
    got = {x["doc_id"]: x["group_id"] for x in spots.near_duplicates(df).collect()}
    assert got == plain_groups([(i, set(signatures(t))) for i, t in enumerate(texts)])
