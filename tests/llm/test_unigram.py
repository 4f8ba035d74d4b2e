"""The max-plus scan against the library, for a small unigram model put together by hand."""

import random
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

from threadloom.llm import pieces, unigram


def field(number: int, value) -> bytes:
    if isinstance(value, int):
        return bytes([number << 3, value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    size, head = len(value), b""
    while size > 127:
        head, size = head + bytes([size & 127 | 128]), size >> 7
    return bytes([number << 3 | 2]) + head + bytes([size]) + value


def model_file(folder, seed: int, fallback: bool) -> str:
    r = random.Random(seed)
    words = {"▁", *"abcd", *("".join(r.choices("abcd▁", k=r.randrange(2, 7))) for _ in range(60))}
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(w, -r.uniform(1, 4) * len(w) ** 0.5, 1) for w in sorted(words)]
    if fallback:
        listed += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    raw = b"".join(field(1, field(1, w.encode()) + field(2, s) + field(3, k)) for w, s, k in listed)
    raw += field(2, field(3, 1) + (bytes([0x98, 0x02, 1]) if fallback else b""))  # byte_fallback is field 35
    raw += field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path = f"{folder}/m{seed}{fallback}.model"
    with open(path, "wb") as f:
        f.write(raw)
    return path


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_chunks_give_the_library_ids(tmp_path, seed, fallback):
    path, r = model_file(tmp_path, seed, fallback), random.Random(seed)
    library, lattice = sentencepiece.SentencePieceProcessor(model_file=path), unigram.Lattice(path)
    assert unigram.is_unigram(path)
    for limit in (1, 9, 40):
        for _ in range(30):
            text = "".join(r.choices("aaabbccdd  é漢", k=r.randrange(1, 160)))
            parts = list(unigram.chunks(lattice.normalize(text), limit, lattice.longest))
            states = unigram.best_states([lattice.transfer(s, before) for s, before in parts])
            ids = [i for (s, before), a, b in zip(parts, states, states[1:], strict=False) for i in lattice.trace(s, before, a, b)]
            if not fallback:
                ids = [x for k, x in enumerate(ids) if not (x == library.unk_id() and k and ids[k - 1] == x)]
            assert_best(library, ids, text)


def assert_best(library, ids, text):
    """The library's ids, or others of the same text and score: pieces in another order tie, and rounding decides."""
    want = library.encode(text)
    if ids != want:
        spelt = lambda x: "".join(map(library.id_to_piece, x))
        score = lambda x: sum(map(library.get_score, x))
        assert spelt(ids) == spelt(want) and abs(score(ids) - score(want)) < 1e-3


@pytest.mark.parametrize("fallback", [False, True])
def test_giants_of_a_unigram_model(spark, tmp_path, fallback):
    path, r = model_file(tmp_path, 7, fallback), random.Random(7)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", "ab", *("".join(r.choices("aabbccdd  é", k=n)) for n in (30, 31, 100, 700, 900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: x for x in pieces.encode_documents(docs, path, giant=30).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["ids"] is None and got[i]["round_trip"] is None
        else:
            assert_best(library, got[i]["ids"], t)
            assert got[i]["round_trip"] == (library.decode(library.encode(t)) == t)


def shuffled(docs):
    """The same rows after a scan, a round-robin shuffle and an aggregate."""
    return {"scan": docs, "dealt": docs.repartition(8), "aggregate": docs.groupBy("doc_id").agg(F.max("text").alias("text"))}


def test_giants_after_shuffles(spark, tmp_path):
    import threadloom.llm.chat as chat

    model = sentencepiece.SentencePieceProcessor(model_file=chat.vocabulary_path(pieces.MODEL))
    r = random.Random(3)
    texts = [" ".join(r.choices(["one", "two.", "three,", "vier"], k=200)) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    for docs in shuffled(spark.read.parquet(f"{tmp_path}/d")).values():
        got = {x["doc_id"]: (x["ids"], x["round_trip"]) for x in pieces.encode_documents(docs, giant=500).collect()}
        assert got == {i: (model.encode(t), True) for i, t in enumerate(texts)}
