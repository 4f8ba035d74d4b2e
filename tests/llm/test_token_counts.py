"""Token counts against the library: words, whole texts, chunks cut everywhere, and the query's operator on odd rows."""

import random

import pytest
from tokenizers import Tokenizer

from threadloom.llm import token_counts as tc
from threadloom.llm.chat import vocabulary_path

PATH = vocabulary_path(tc.MODEL)
ODD = ["'s", "'re", "''", "!'", "'", "’", "é", "É", "Σ", "ς", "İ", "ß", "漢字", "かな", "😂", "👍🏽", "̇", "​", "\x1c", "\xa0", "　", "\u0085", "٣", "Ⅷ", "²", "_", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "…", "\n\n", "  ", "ab1c2", "ﬁ", "가", "가", "Ᲊ", "͸"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return tc.Machine(PATH, tc.compile_characters(PATH))


def want(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def made(r, n):
    pool = [*ODD, *"abcdeghilmnorstuy", "the", "ing", "tion", "Haha", "aaaa", "!!!", "...", "123", " ", " "]
    return "".join(r.choices(pool, k=n))


def test_texts(library, machine):
    r = random.Random(1)
    texts = ["", " ", *ODD, *(made(r, r.randrange(1, 60)) for _ in range(4000))]
    got = machine.count(texts)
    assert [(t, int(n)) for t, n in zip(texts, got, strict=True)] == [(t, want(library, t)) for t in texts]


def test_words_of_few_letters(library, machine):
    r = random.Random(2)
    words = ["".join(r.choices(alphabet, k=r.randrange(1, 80))) for alphabet in ("a", "ab", "ha", "lo", "thein", "abcdefghijklmnopqrstuvwxyz", "!?", "😂", "😂👍", "漢字語", "-=", "é") for _ in range(300)]
    assert [int(x) for x in machine.count(words)] == [want(library, w) for w in words]


def test_borders_are_the_library_s(library, machine):
    r = random.Random(3)
    for _ in range(300):
        word = "".join(r.choices("abehinot", k=r.randrange(1, 50)))
        at, borders = 0, [0]
        for t in library.encode(word, add_special_tokens=False).tokens:
            at += len(t.removesuffix("</w>"))
            borders.append(at)
        assert machine.pieces.borders(word.encode(), True) == borders
        open_ = machine.pieces.borders(word.encode(), False)
        for more in ("", "t", "ing", "e" * 40):  # settled borders stay, however the word goes on
            if more:
                assert machine.pieces.borders((word + more).encode(), True)[: len(open_)] == open_


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 40])
def test_chunks_cut_everywhere(library, machine, limit):
    r = random.Random(limit)
    texts = [made(r, r.randrange(1, 80)) for _ in range(60)] + ["".join(r.choices(a, k=300)) for a in ("ab", "aeht", "!'s", "漢字", "😂", "a' ", "'re") for _ in range(3)]
    for t in texts:
        s, special = machine.normal(t)
        chunks = list(machine.cuts(s, limit))
        assert "".join(seen[at : at + size] for seen, at, size in chunks) == s
        maps = [machine.state_map(*c) for c in chunks]
        ends, counts = tc.compose(maps)
        assert (ends[0], counts[0] + special) == (0, want(library, t)), t
        half = len(maps) // 2  # in any grouping
        if half:
            ends, counts = tc.compose([tc.compose(maps[:half]), tc.compose(maps[half:])])
            assert (ends[0], counts[0] + special) == (0, want(library, t))


def test_little_ahead_is_never_wrong(library, machine):
    """With few characters to look ahead a chunk may stay unsettled, but gives no wrong number."""
    r, settled = random.Random(9), 0
    for ahead in (1, 2, 5, 20):
        for _ in range(60):
            t = "".join(r.choices(r.choice(["ab", "haha", "thein g", "漢字 "]), k=120))
            ends, counts = tc.compose(machine.state_map(*c, ahead) for c in machine.cuts(machine.normal(t)[0], 25, ahead))
            if ends[0] != -2:
                settled += 1
                assert (ends[0], counts[0]) == (0, want(library, t))
    assert settled > 20


def test_word_over_many_chunks(library, machine):
    r = random.Random(5)
    t = "".join(r.choices("abcdehinorst", k=20_000)) + "漢字" * 2000
    ends, counts = tc.compose(machine.state_map(*c) for c in machine.cuts(t, 6000))
    assert (ends[0], counts[0]) == (0, want(library, t))


def test_caches_may_be_emptied(library, monkeypatch):
    monkeypatch.setattr(tc, "CACHED_STATES", 50)
    monkeypatch.setattr(tc, "CACHED_WORDS", 10)
    machine, r = tc.Machine(PATH, tc.compile_characters(PATH)), random.Random(6)
    texts = [made(r, 30) for _ in range(200)]
    assert [int(x) for x in machine.count(texts)] == [want(library, t) for t in texts]


def test_rows(spark, library):
    r = random.Random(7)
    texts = [None, "", " \n", "one", *(made(r, 500) for _ in range(30)), "the cat " * 30_000, "a" * 5000 + " " + "b'll" * 2000, "漢" * 3000, "word " * 2048, "word " * 2049]
    rows = [*enumerate(texts), (3, "one"), (None, "the cat " * 3000), (None, None)]
    df = spark.createDataFrame([(*x, "own", 7) for x in rows], "doc_id long, text string, row_ string, n_tokens int").repartition(5)
    got = tc.count_tokens(df, giant=700)
    assert got.columns == ["doc_id", "row_", "n_bytes", "n_tokens", "over_limit"]
    found = sorted(((x["doc_id"], x["n_bytes"], x["n_tokens"], x["over_limit"], x["row_"]) for x in got.collect()), key=str)
    assert found == sorted(((i, len((t or "").encode()), n := want(library, t or ""), n > 2048, "own") for i, t in rows), key=str)


def test_unsettled_texts_are_counted_whole(spark, library):
    texts = ["haha" * 200 + " end", "the cat sat " * 300, "short"]
    machine = tc.Machine(PATH, tc.compile_characters(PATH))
    assert tc.compose(machine.state_map(*c, 1) for c in machine.cuts(texts[0], 101, 1))[0][0] == -2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in tc.count_tokens(df, giant=101, ahead=1).collect()) == [(i, want(library, t)) for i, t in enumerate(texts)]


def test_empty_table(spark):
    assert tc.count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
