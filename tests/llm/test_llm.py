"""The corpus operators against brute force, round trips and held-out labels."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat, html_text, line_dedup, mixing, ngram_join, pieces, quality, spot_signatures, toxicity, warc
from threadloom.llm.textnum import runs

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, source string, n long, key string"


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "und"]
    base = [" ".join(r.choices(words, k=r.choice([1, 2, 8, 12, 25, 60, 300]))) for _ in range(30)]
    texts = [None, "", "  \n ", *base, *base[:5]]
    for t in base[5:25]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w).upper())
    return [(i, t, None if i % 9 == 0 else f"s{i % 3}", i, "k") for i, t in enumerate(texts)]


def brute_links(rows, k, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids, up, degree = sorted(sets), {i: i for i in sets}, Counter()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            o = len(sets[a] & sets[b])
            if a < b and o and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                degree[a] += 1
                degree[b] += 1
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), degree[i]) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard(spark, k, num):
    rows = corpus()
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), k, num, 100)
    want = brute_links(rows, k, num, 100)
    assert {r[0]: (r[1], r[2], r[3]) for r in got.collect()} == want
    groups = ngram_join.jaccard_groups(spark.createDataFrame(rows, DOCS), k, num, 100)
    assert {r[0]: (r[1], r[2]) for r in groups.collect()} == {i: w[:2] for i, w in want.items()}


def test_groups_of_chained_near_copies(spark):
    """Neighbours in a chain link, its ends do not; ids are mixed, so a list's least document is seldom a neighbour."""
    r = random.Random(8)
    words = [f"v{i}" for i in range(260)]
    rows = [(i, " ".join(words[at * 5 : at * 5 + 100]), "s", 0, "k") for i, at in enumerate(r.sample(range(30), 30))]
    rows += [(100 + i, " ".join(words[100:180] + [f"own{i}"]), "s", 0, "k") for i in range(40)]
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, DOCS))
    want = brute_links(rows, 5, 80, 100)
    assert {x[0]: (x[1], x[2]) for x in got.collect()} == {i: w[:2] for i, w in want.items()}


def test_groups_need_few_links(spark):
    """A group of near copies of one text, whose pairs link only in part, is connected by far fewer links than it has."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = base.copy()
        for _ in range(i % 4 + 1):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "s", i, "k"))
    want = brute_links(rows, 5, 80, 100)
    docs = spark.createDataFrame(rows, DOCS)
    assert {x[0]: (x[1], x[2]) for x in ngram_join.jaccard_groups(docs).collect()} == {i: w[:2] for i, w in want.items()}
    _, links = ngram_join.jaccard_links(docs, connect_only=True)
    assert 4 * links.count() < sum(w[2] for w in want.values()) / 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (ngram_join.jaccard_components(none), ngram_join.jaccard_groups(none), mixing.mix_totals(none), line_dedup.dedupe_lines(none), pieces.encode_documents(none), quality.quality_rules(none, labels), spot_signatures.fingerprints(none), toxicity.score(none, toxicity.train(none, labels))):
        assert df.count() == 0


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "a\nb"), (4, None), (5, "b\nc\nd"), (6, "")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a\nb\nc\nd", 2: "x", 3: "a\nb", 4: None, 5: "", 6: ""}


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), f"s{i % 4}", i, "k") for i in range(400)]
    got = mixing.mix_totals(spark.createDataFrame(rows, DOCS)).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source_size", as_index=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) <= 4 and len(by)


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}%", None if i == 3 else ("é" * 600 if i % 2 else f"p{i}")) for i in range(12)]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert got[i]["refers_to"] == (11 if len(raw) >= 1000 and i != 11 else None)
    record = warc.build_record(1, None, b"x", hashlib.sha1(b"x").digest(), None)
    assert warc.parse_record(record)["payload"] == b"x"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"\r\n\r\nx", b"\r\n\r\ny"))
    with pytest.raises(ValueError):
        warc.parse_record(record[:-5] + b"\r\n\r\n")


def test_html():
    page = '<nav><a href=x>menu</a></nav><div class="ad">buy</div><article><h1>T &amp; t</h1><p><b>one,\n two<br><p>three</p><script>"</p>"</script></article><div id="comments">no</div><footer>f</footer>'
    assert html_text.main_text(page) == "T & t\none, two\nthree"
    assert html_text.main_text(None) == html_text.main_text("<nav>x</nav>") == ""


LEAD, BODY = "A paragraph, with commas, of one section. " * 9, "Short text of a smaller section, with a comma."


@pytest.mark.parametrize("outer", ["article", "main", "div"])
@pytest.mark.parametrize("inner", ["section", "div", "blockquote", "ul", "table"])
def test_html_keeps_all_sections(outer, inner):
    """One section outscores all others together; lists, tables, short paragraphs and small headings stay too."""
    wrap = {"ul": "<li>{}</li>", "table": "<tr><td>{}</td></tr>"}.get(inner, "<p>{}</p>")
    long = "".join(wrap.format(LEAD) for _ in range(9))
    page = f"<nav><a href=x>menu</a></nav><{outer}><h1>T</h1><{inner}>{long}</{inner}><h4>small</h4><p>Few words.</p><{inner}>{wrap.format(BODY)}</{inner}></{outer}>"
    assert html_text.main_text(page).split("\n") == ["T", *[LEAD.strip()] * 9, "small", "Few words.", BODY]


@pytest.mark.parametrize("wrapper", ['class="content has-sidebar"', 'class="no-comments"', 'class="with-header"', 'id="search-methods"', 'class="sidebar"', 'role="search"'])
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_html_keeps_wrappers(wrapper, outer):
    """A junk word within another class leaves nothing out, and no class leaves out the article or most of the text."""
    page = f'<div class="site-header">head</div><section {wrapper}><{outer}><p>{LEAD}</p><p>{BODY}</p></{outer}></section><div class="ad-banner">buy</div>'
    assert html_text.main_text(page) == f"{LEAD.strip()}\n{BODY}"


def test_html_second_pass_and_comments():
    assert html_text.main_text('<div class="banner">Only text.</div>') == "Only text."
    comments = "".join(f'<article class="comment"><p>{LEAD}</p></article>' for _ in range(5))
    assert html_text.main_text(f'<article><p>{BODY}</p></article><section id="comments">{comments}</section>') == BODY


def test_html_leaves_out_mostly_links():
    links = "".join(f"<li><a href=x>another page {i}</a></li>" for i in range(5))
    page = f"<body><div><div><p>{LEAD}</p><p>{LEAD}</p></div><ul>{links}</ul><p>End.</p></div></body>"
    assert html_text.main_text(page).split("\n") == [LEAD.strip()] * 2 + ["End."]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = chat.vocabulary_path(pieces.MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "a  b ", " lead", "x\ny\t z", "naïve ﬁ 漢字 🙂", "one two. three " * 30, None]
    df = pieces.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), giant=40)
    got = {r["doc_id"]: r for r in df.collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == (None if t is None else model.encode(t)) and got[i]["round_trip"] in (None, True)
    assert " ".join(pieces.parts(texts[6], 40)) == texts[6]


def test_chat(spark):
    said = "<|im_end|><\\|im_start|>ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "assistant", None), (2, 0, None, "x")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["loss_chars"] == len(said)
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\nassistant\n\n".encode()).hexdigest()
    assert got[2]["n_turns"] == 1 and "<|" not in chat.escape(said)


def test_quality_counts():
    texts = ["a b c a b c", "x #* y\nx #* y\n\nz|", "", "one"]
    _, t = next(runs(pa.array(texts, pa.large_string())))
    c = {k: v.tolist() for k, v in quality.counts(t).items()}
    assert c["n_words"] == [6, 7, 0, 1] and c["n_repeat_words"] == [6, 6, 0, 0]
    assert c["n_dup_lines"] == [0, 1, 0, 0] and c["n_symbols"] == [0, 5, 0, 0] and c["word_chars"] == [6, 10, 0, 3]


def test_toxicity_swaps(spark):
    """A term that only occurs in toxic rows must not make a neutral mention toxic."""
    r = random.Random(1)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = r.choices(plain, k=20) + (["idiot", "scum"] + (["women"] if i % 6 == 0 else []) if bad else [])
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    good, bad, free = model.score_strings(["w1 women w2 w3", "w1 idiot scum w2", "w1 w2 w3"])
    assert bad > 0.7 > 0.3 > good and abs(good - free) < 0.2


def test_fingerprints(spark):
    texts = ["the red fox of the north", "the red fox of the north", None, "", "x"]
    got = spot_signatures.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    t = [x or "" for x in texts]
    for i, r in enumerate(got):
        n = len(t[i])
        assert r["edited_sha256"] == hashlib.sha256((t[i][: n - n // 2] + t[(i + 1) % 5][: n // 2]).encode()).hexdigest()
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1.0
    sets = [(i, sorted({j * 7 for j in range(i % 3, 20 + i % 3)})) for i in range(9)]
    pairs = {r[0]: r[1] for r in spot_signatures.near_duplicates(spark.createDataFrame(sets, "doc_id long, sigs array<long>")).collect()}
    assert set(pairs.values()) == {0}
