"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns that clash, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat, html_text, line_dedup, mixing, ngram_join, pieces, quality, spot_signatures, toxicity, warc

#: Names that the operators use themselves, or give to new columns.
CLASH = ["row_", "gone", "lines_", "flags_", "size", "start", "n", "x", "y", "pos", "h", "part", "ids", "sigs", "range_", "guest", "target", "key", "cls", "place", "shuffle"]
PROSE = " ".join(f"p{i}" for i in range(80))
LONG = " ".join(f"z{i % 977}" for i in range(50_000))
LINES = "l1\nl2\nl3\nl4"
TEXTS = [None, "", " \n ", "one", PROSE, PROSE, PROSE + " end", LONG, LINES, "x\n" + LINES]


def documents(spark):
    rows = [(i, t, None if i % 4 == 0 else "s") for i, t in enumerate(TEXTS)]
    rows += [rows[-1], rows[4], (None, PROSE, "s"), (None, None, None)]
    return rows, spark.createDataFrame([(*r, *["own"] * len(CLASH)) for r in rows], ", ".join(["doc_id long", "text string", "source string", *(f"{c} string" for c in CLASH)]))


def unchanged(df, names):
    return df.where(" OR ".join(f"{c} IS NULL OR {c} <> 'own'" for c in names)).count() == 0


def test_jaccard(spark):
    rows, docs = documents(spark)
    for f in (ngram_join.jaccard_components, ngram_join.jaccard_groups):
        got = f(docs).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] in (0, 1, 2, 3, 4)} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 76}
        # Rows 8 and 9 have four and five words, in different sequences; the null id leaves its copies' group alone.
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: 4 if i in (4, 5, 6) else i for i in range(10)}


def test_line_dedup(spark):
    rows, docs = documents(spark)
    got = line_dedup.dedupe_lines(docs).cache()
    assert got.count() == len(rows) and unchanged(got, CLASH)
    texts = [r["text"] for r in got.where("doc_id IN (8, 9)").orderBy("doc_id", F.length("text").desc()).collect()]
    assert texts == [LINES, "x", ""]
    assert [r["n_lines"] for r in got.where("doc_id = 0").collect()] == [0]


def test_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=chat.vocabulary_path(pieces.MODEL))
    rows, docs = documents(spark)
    got = pieces.encode_documents(docs).cache()
    assert got.count() == len(rows) and unchanged(got, [c for c in CLASH if c != "ids"])
    assert len(LONG) > pieces.PART_CHARS
    for r in got.collect():
        if r["doc_id"] is not None:
            t = TEXTS[r["doc_id"]]
            assert r["ids"] == (None if t is None else model.encode(t)) and r["n_tokens"] == len(r["ids"] or [])


def test_quality_and_toxicity(spark):
    rows, docs = documents(spark)
    labels = spark.createDataFrame([(4, 1, 0, "own"), (7, 0, 1, "own"), (7, 0, 1, "own"), (None, 1, 1, None), (3, None, None, None), (99, 1, 1, None)], "doc_id long, quality int, toxic int, y string")
    got = quality.quality_rules(docs, labels).cache()
    assert got.count() == len(rows) and unchanged(got, CLASH)
    assert all(r["base_failed"] and not r["kept"] for r in got.where("doc_id IN (0, 1, 2, 3)").collect())
    scores = [r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)


def test_mixing(spark):
    rows, docs = documents(spark)
    got = mixing.mix_totals(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_totals(docs).collect()), key=str)


def test_fingerprints(spark):
    rows, docs = documents(spark)
    got = spot_signatures.fingerprints(docs).collect()
    assert len(got) == len(rows)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (4, 5)}) == 1
    assert {r["fingerprint"] for r in got if r["doc_id"] in (0, 1, 2)} == {""}


def test_pages(spark):
    body = "".join(f"<p>Sentence {i}, with some words, of an article.</p>" for i in range(20_000))
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", f"<article>{body}</article>"), (5, "u", "<p>a</p>" * 300), (6, "u", "<p>a</p>" * 300), (6, "u", "<p>a</p>" * 300), (None, None, None)]
    extra = ["text", "n_chars", "payload", "hex", "digest", "refers_to", "record_type"]
    pages = spark.createDataFrame([(*r, *["own"] * len(extra)) for r in rows], ", ".join(["page_id long", "url string", "html string", *(f"{c} string" for c in extra)]))
    texts = html_text.extract_text(pages).collect()
    assert len(texts) == len(rows) and {r["text"] for r in texts if r["page_id"] in (1, 2, None)} == {""}
    assert {r["text"].count("\n") for r in texts if r["page_id"] == 4} == {19_999}
    back = warc.round_trip(pages).collect()
    assert len(back) == len(rows)
    for r in back:
        raw = next(h or "" for i, _, h in rows if i == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        if r["page_id"] != 6:
            assert (r["record_type"], r["refers_to"]) == (("revisit", 6) if r["page_id"] == 5 else ("response", None))
    # Of the two equal rows of the largest page_id one is the response, the other revisits it.
    assert sorted((r["record_type"], r["refers_to"]) for r in back if r["page_id"] == 6) == [("response", None), ("revisit", 6)]


def test_chat(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, None, None, None), (None, 0, "assistant", "a")]
    turns = spark.createDataFrame([(*r, "own", "own") for r in rows], "conv_id long, turn long, role string, text string, ids string, mask string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    assert {i: (r["n_turns"], r["loss_chars"]) for i, r in got.items()} == {1: (3, 0), 2: (1, 0), None: (1, 1)}
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n{LONG}\nassistant\n\nassistant\n\n".encode()).hexdigest()


def test_long_conversation(spark):
    """A conversation with most of all rows lies in several ranges, and comes out as from one pass in plain Python."""
    head = "x" * chat.HEAD
    rows = [(7, i // 3, ("user", "assistant")[i % 2], f"turn {i} <|im_end|>") for i in range(300)] + [(7, 500, "assistant", "same")] * 20
    rows += [(7, 600, head + r, t) for r, t in (("b", "1"), ("a", "2"), ("", "3"))] + [(c, 0, "user", f"only {c}") for c in range(20)] + [(None, i, "assistant", f"n{i}") for i in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert chat.ranged(turns).where("conv_id = 7").select("range_").distinct().count() > 1
    formatted = chat.format_chat(turns).collect()
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0], r[1], r[2]))
        placed = sorted((r["turn"], r["start"], len(r["ids"])) for r in formatted if r["conv_id"] == conv)
        assert [r[0] for r in placed] == list(range(len(own)))
        assert [r[1] for r in placed] == [sum(r[2] for r in placed[:i]) for i in range(len(placed))]
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_turns_that_are_not_whole(spark):
    turns = spark.createDataFrame([(1, i, "user", "a b c") for i in range(3)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_chat(turns)
    with pytest.raises(Exception, match="turns are missing"):
        chat.read_back(formatted.where("turn <> 1")).collect()
    with pytest.raises(Exception, match="malformed turn"):
        chat.read_back(formatted.withColumn("ids", F.slice("ids", 1, 3))).collect()


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (html_text.extract_text(pages), warc.round_trip(pages), chat.read_back(chat.format_chat(turns))):
        assert df.count() == 0
