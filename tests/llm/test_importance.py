"""Importance resampling against plain Python; hashes against the libraries; the table under forced collisions; odd rows."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from threadloom.llm import importance
from threadloom.llm.textnum import Texts, U


def grams(text, n_max):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n_max + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, buckets, least_words, n_max=2):
    of = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(of(g) for x in texts for g in grams(x, n_max)[1]) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out, may = [], []
    for i, x in docs:
        n, found = grams(x, n_max)
        weight, score = sum(gain[of(g)] for g in found) // max(len(found), 1), None
        if i is not None:
            score = weight + math.floor(-1000 * math.log(-math.log((int(sha256(f"7:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32)))
            if n >= least_words:
                may.append((-score, i, -weight))
        out.append([i, n, len(found), weight, score])
    may.sort()
    ranks = {}
    for place, row in enumerate(may[: 25 * len(may) // 100], 1):
        ranks.setdefault(row, []).append(place)
    for r in out:
        places = ranks.get((-(r[4] or 0), r[0], -r[3])) if r[4] is not None and r[1] >= least_words else None
        r.append(places.pop(0) if places else None)
    return sorted(map(tuple, out), key=str)


def texts_of(texts):
    raw = [t.encode() for t in texts]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))


@pytest.mark.parametrize("size", [0, 1, 3, 4, 7, 8, 12, 31, 32, 33, 63, 64, 100, 257])
def test_hashes(size):
    rows = np.random.default_rng(size).integers(0, 256, (20, size), dtype=np.uint8)
    assert [int(x) for x in importance.xxhash64(rows)] == [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]
    assert [int(x) for x in importance.crc32(rows)] == [zlib.crc32(r.tobytes()) for r in rows]


def test_table_verifies_bytes_of_equal_keys():
    words = ["ab", "cd", "ab", "efg", "cd", "x" * 300, "y" * 300, "x" * 300]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    lengths = np.array([len(w) for w in words])
    spans = importance.Spans(data, np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    for hashes in (None, np.zeros(len(words), U), np.full(len(words), 2**64 - 1, U)):
        got = importance.Interned(spans, 1000, hashes)
        assert len(got.count) == 5 and [int(got.count[s]) for s in got.slot] == [words.count(w) for w in words]
        assert [int(got.bucket[s]) for s in got.slot] == [zlib.crc32(w.encode()) % 1000 for w in words]


def test_batches_end_inside_a_text(monkeypatch):
    monkeypatch.setattr(importance, "BATCH_WORDS", 3)
    texts = ["a b c d e f g", "", "--", "é 1x É", "h"]
    found = Counter()
    for interned, owner in importance.batches_of_grams(texts_of(texts), 2, 10**9):
        found.update((int(o), int(interned.bucket[s])) for o, s in zip(owner, interned.slot, strict=True))
    assert found == Counter((i, zlib.crc32(g.encode()) % 10**9) for i, t in enumerate(texts) for g in grams(t, 2)[1])


def rows():
    r = np.random.default_rng(4)
    pool = ["alpha", "Beta", "gamma9", "ÉTÉ", "été", "漢字", "x", "don't", "a-b", "Zeta", "q" * 400]
    out = [(i, " ".join(r.choice(pool, int(r.integers(0, 60))))) for i in range(120)]
    out += [(200, None), (201, ""), (202, " \n ... "), (203, " ".join(["hot"] * 50_000)), (204, "漢" * 30_000), (5, out[5][1]), (5, out[5][1]), (6, "other " * 30)]
    return [*out, *[(300 + i, "same text of twenty words " * 5) for i in range(60)], (None, "alpha Beta " * 20), (None, None)]


def test_equals_plain_python(spark):
    docs, target = rows(), ["alpha Beta gamma9 x x", None, "", "été don't a-b"]
    df = spark.createDataFrame([(*r, "own", 1) for r in docs], "doc_id long, text string, bucket string, score int").repartition(7)
    got = importance.resample(df, spark.createDataFrame([(t, "own") for t in target], "text string, n string"), buckets=500)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, 500, 20)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "w " * 30), (2, "v " * 30), (3, "w v " * 30), (4, "u " * 30)], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    assert sorted(map(tuple, importance.resample(some, none).collect()), key=str) == plain([tuple(r) for r in some.collect()], [], 10_000, 20)
