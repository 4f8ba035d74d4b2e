"""run() against brute force, with null ids and repeated rows. The verdicts of the quality rules are taken from their operator."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import sentencepiece
from test_llm import brute_links

import corpus_pipeline
from threadloom.llm import chat, pieces, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(11)
    vocabulary = ["the", "of", "and", "to", "was", "in", *("".join(r.choices("abcdefghilmnoprstu", k=r.randrange(3, 9))) for _ in range(900))]
    prose = [" ".join(r.choices(vocabulary, k=60 + 3 * i)) + "." for i in range(24)]
    block = "\n".join(" ".join(r.choices(vocabulary, k=12)) for _ in range(3))
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(prose[:14])]
    rows += [rows[3]] * 2 + [rows[4], (4, prose[14], "s1")]  # repeated rows; one id with two texts
    rows += [(50 + i, prose[i] + " tail", "s0") for i in (5, 6)]  # near copies
    rows += [(None, prose[i], "s2") for i in (15, 16, 16, 17)] + [(None, prose[7], "s0"), (None, prose[18], None)]  # clean, repeated, copy of an id
    rows += [(60, prose[19] + "\n" + block, "s0"), (61, prose[20] + "\n" + block, "s1"), (62, None, "s0"), (63, "", "s1")]
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]


def without_repeats(rows):
    seen, out = set(), []
    for i, text, source in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines, gone = text.split("\n"), set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if window in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(window)
        text = "\n".join(x for at, x in enumerate(lines) if at not in gone)
        if text.split():
            out.append((i, text, source))
    return out


def one_per_group(rows):
    rows = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    group = brute_links([(n, text) for n, (_, text, _) in enumerate(rows)], 5, 80, 100)
    return [x for n, x in enumerate(rows) if group[n][1] == n]


def first_words(text, n):
    """The text up to its n-th word."""
    return "".join(re.findall(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", text)[:n])


def mixed(rows):
    """The mix, its last document of each source cut at the source's whole target."""
    by = defaultdict(list)
    for i, text, source in rows:
        by[source].append((hashlib.md5(f"mix{'' if i is None else i}".encode()).hexdigest(), len(text.split()), (i, text, source)))
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(x[1] for x in by[s]) for s in sources}
    weight, target, left = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sources)}, {}, 1.5 * sum(size.values())
    while cut := [s for s in sources if s not in target and 2 * size[s] * sum(weight[x] for x in sources if x not in target) <= weight[s] * left]:
        target[cut[0]] = 2 * size[cut[0]]
        left -= target[cut[0]]
    free = [s for s in sources if s not in target]
    target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    out = []
    for s in sources:
        began = 0
        for _, words, row in sorted(by[s], key=lambda x: x[:2]) * 2:
            if began < int(target[s]) and words:
                i, text, source = row
                out.append((i, text if words <= int(target[s]) - began else first_words(text, int(target[s]) - began), source))
            began += words
    return out


def test_run(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    judged = quality.quality_rules(spark.createDataFrame(rows, SCHEMA), labels).where("kept").collect()
    kept = [(r["doc_id"], r["text"], r["source"]) for r in judged]
    assert len(kept) >= 28 and sum(r[0] is None for r in kept) == 6
    alone = one_per_group(without_repeats(kept))
    assert Counter(r[0] for r in alone)[3] == 1 and sum(r[0] is None for r in alone) == 4
    model = sentencepiece.SentencePieceProcessor(model_file=chat.vocabulary_path(pieces.MODEL))
    want = Counter((i, source, len(text), tuple(model.encode(text))) for i, text, source in mixed(alone))
    got = Counter((r["doc_id"], r["source"], r["n_chars"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and any(i is None for i, *_ in got)


CLASH = ["kept", "n_words", "n_lines", "row_", "gone", "component_id", "taken", "size", "round", "start", "kept_column_0"]


def test_every_stage_on_odd_rows(spark, tmp_path):
    """Columns that clash pass through; nulls, blanks, repeated rows and empty tables do no harm."""
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = documents() + [(None, None, None, None, None), (70, " \n\n ", None, "s1", 4)]
    schema = SCHEMA + "".join(f", {c} string" for c in CLASH)
    docs = spark.createDataFrame([(*r, *["own"] * len(CLASH)) for r in rows], schema)
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        got = f(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        some = got.collect()
        assert some and all(r[c] == "own" for r in some for c in CLASH), name
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in some), name
    mixed_words = sum(len(r["text"].split()) for r in corpus_pipeline.mixing_stage(spark, docs, "").collect())
    assert abs(mixed_words - 1.5 * sum(len((r[1] or "").split()) for r in rows)) <= 4
    last = corpus_pipeline.sentencepiece_stage(spark, docs, "")
    assert last.count() == len(rows) and corpus_pipeline.sentencepiece_stage(spark, docs.limit(0), "").count() == 0
    docs = docs.repartition(8)
    once = lambda: sorted(map(str, corpus_pipeline.line_dedup_stage(spark, docs, "").select("doc_id", "n_chars").collect()))
    assert once() == once()
