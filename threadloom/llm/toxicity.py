"""Toxicity: a logistic regression over hashed words and word beginnings, with counterfactual regularisation.

Fitted on a bounded sample of labelled rows. Features are chosen by their association (G squared) with the label, counted over the
sample as a Spark aggregate. In every labelled sentence that names a group, the identity terms are swapped for others of
the same kind; the squared change of the score under such swaps is a penalty in the fit, so mentions of a group by themselves
move the score little. Terms are given, and mined from the sample: pairs of words that stand between the same neighbours and that
the label does not set apart. Whole texts are scored in Arrow batches.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stage, string_column
from .linear import fit, labelled_sample, sigmoid
from .textnum import LOWER, U, Texts, mix, runs

#: Identity terms; those on one line are swapped for each other.
IDENTITIES = [
    line.split()
    for line in """
    muslim christian jewish hindu buddhist sikh atheist catholic
    muslims christians jews hindus buddhists sikhs atheists catholics
    black white asian latino african european arab
    gay straight lesbian bisexual queer heterosexual
    man woman
    men women
    boy girl
    male female
    immigrant citizen refugee native
    immigrants citizens refugees natives
    deaf blind disabled
    muslime christen juden hindus buddhisten atheisten
    mann frau
    männer frauen
    hombre mujer
    hombres mujeres
    musulmanes cristianos judíos ateos
    homme femme
    hommes femmes
    musulmans chrétiens juifs athées
    """.strip().splitlines()
]
SWAP = {w: group[(i + 1) % len(group)] for group in IDENTITIES for i, w in enumerate(group)}
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")

BITS = 22
BEGINNINGS = (3, 4, 5, 6)
#: Bytes inside words: ASCII letters and digits and all of other scripts.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Swaps:
    """Terms and what each is swapped for."""

    def __init__(self, terms: dict[str, str]):
        self.terms = terms
        self.any = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, terms), key=len, reverse=True)) + r")(?!\w)", re.I) if terms else None

    def sentences(self, text: str) -> list[tuple[str, str]]:
        """Sentences that hold a term, each with its terms swapped."""
        if self.any is None or not self.any.search(text):
            return []
        return [(s, self.any.sub(lambda m: self.terms[m[0].lower()], s)) for s in _SENTENCE.findall(text) if self.any.search(s)]


def mine_terms(texts: DataFrame, n: int, pos: int, pairs: int = 16, candidates: int = 200) -> dict[str, str]:
    """texts(text, y), n rows of which pos have y = 1 -> terms to swap, both ways, up to pairs pairs; none from small samples.

    Candidates are common words (in 20 texts or more, in a fifth of them at most) that occur in texts of both labels about as the
    label's share has it; they pair by the number of places, left and right neighbour, where either stands."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    rows = texts.select("y", words.alias("w"))
    expected = F.col("c") * (pos / max(n, 1))
    known = rows.select("y", F.explode(F.array_distinct("w")).alias("word")).where("length(word) >= 3").groupBy("word").agg(F.count("*").alias("c"), F.sum("y").alias("a"))
    known = known.where((F.col("c") >= 20) & (F.col("c") <= n / 5) & (F.col("a") >= 3) & ((F.col("a") - expected) ** 2 < expected))
    chosen = [r["word"] for r in known.orderBy(F.desc("c"), "word").limit(candidates).collect()]
    if len(chosen) < 2:
        return {}
    spot = lambda w, i: F.when(w.isin(chosen), F.struct(F.get("w", i - 1).alias("l"), F.get("w", i + 1).alias("r"), w.alias("word")))
    spots = rows.select(F.explode(F.filter(F.transform("w", spot), lambda s: s.isNotNull())).alias("s")).select("s.*").where("l IS NOT NULL AND r IS NOT NULL")
    shared = spots.groupBy("l", "r").agg(F.sort_array(F.collect_set("word")).alias("ws")).where("size(ws) > 1")
    both = shared.select("ws", F.explode("ws").alias("u")).select("u", F.explode("ws").alias("v")).where("u < v").groupBy("u", "v").count()
    terms: dict[str, str] = {}
    for r in both.where("count > 1").orderBy(F.desc("count"), "u", "v").collect():
        if r["u"] not in terms and r["v"] not in terms and len(terms) < 2 * pairs:
            terms |= {r["u"]: r["v"], r["v"]: r["u"]}
    return terms


def hashed(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and features of all words: the word, and its beginnings of BEGINNINGS bytes."""
    starts, ends, owner = texts.spans(LETTERS[texts.data])
    got, of = [mix(texts.hashes(starts, ends, LOWER) + U(1))], [owner]
    for k in BEGINNINGS:
        long = np.flatnonzero(ends - starts > k)
        got.append(mix(texts.hashes(starts[long], starts[long] + k, LOWER) + U(2)))
        of.append(owner[long])
    return np.concatenate(of), (np.concatenate(got) & U((1 << BITS) - 1)).astype(np.int64)


def _from_strings(strings: list[str]) -> Texts:
    column = pa.array(strings, pa.large_string())
    return next(runs(column, 1 << 62))[1]


def _tally(batch):
    """(feature, toxic texts with it, texts with it), summed within the run."""
    y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
    for first, texts in runs(string_column(batch, "text")):
        of, got = hashed(texts)
        pairs = np.unique(of << BITS | got)
        feature, text = pairs & ((1 << BITS) - 1), pairs >> BITS
        names, at = np.unique(feature, return_inverse=True)
        pos = np.bincount(at, weights=y[first + text])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(pos.astype(np.int64)), pa.array(np.bincount(at))], ["feature", "pos", "n"])


def _values(texts: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, chosen feature and value (log of 1 + count) of the features that a text has."""
    of, got = hashed(texts)
    chosen = table[got]
    hit = chosen >= 0
    size = int(table.max()) + 1
    keys, counts = np.unique(of[hit] * max(size, 1) + chosen[hit], return_counts=True)
    return keys // max(size, 1), keys % max(size, 1), np.log1p(counts)


class Model:
    """Weights of the chosen features; terms and the number of sentences that they were swapped in for the fit."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias
        self.terms: dict[str, str] = {}
        self.swaps = 0

    def table(self) -> np.ndarray:
        table = np.full(1 << BITS, -1, np.int32)
        table[self.features] = np.arange(len(self.features), dtype=np.int32)
        return table

    def scores(self, texts: Texts, table: np.ndarray) -> np.ndarray:
        of, at, value = _values(texts, table)
        return sigmoid(np.bincount(of, weights=self.weights[at] * value, minlength=texts.n) + self.bias)

    def score_strings(self, strings: list[str]) -> np.ndarray:
        return self.scores(_from_strings(strings), self.table())


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, features: int = 512, swap_weight: float = 5.0, l2: float = 3e-5, terms: dict[str, str] | None = None, mined: int = 16, swaps: int = 20_000) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic) -> Model. rows bounds the labelled rows of the fit, features the chosen features.

    swap_weight is the strength of the counterfactual penalty; terms are swapped for each other (default: IDENTITIES), and up to
    mined pairs of words found in the sample; swaps bounds the swapped sentences of the fit (those of least md5). The terms' own
    features count beside the chosen ones. Without labels every text scores the same. Rows without a doc_id or label are not
    used; a doc_id with several labels counts as toxic if any says so, and with several rows once for each of its texts; of ids
    and features that tie for a place, those of least md5 or number are used. Other columns are left out, whatever their names."""
    sample = labelled_sample(labels, "toxic", rows)
    texts = stage(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id"), "labelled")
    pos, n = texts.agg(F.sum("y"), F.count("*")).first()
    pos, n = int(pos or 0), int(n)
    tally = arrow_map(texts.select("text", "y"), _tally, "feature long, pos long, n long").groupBy("feature").agg(F.sum("pos").alias("a"), F.sum("n").alias("c"))
    tally = tally.where("c >= 4").withColumns({"b": F.col("c") - F.col("a"), "ea": F.col("c") * pos / max(n, 1), "eb": F.col("c") * (n - pos) / max(n, 1)})
    part = lambda o, e: f"CASE WHEN {o} > 0 AND {e} > 0 THEN {o} * ln({o} / {e}) ELSE 0D END"
    gain = F.expr(f"2 * ({part('a', 'ea')} + {part('b', 'eb')} + {part(f'({pos} - a)', f'({pos} - ea)')} + {part(f'({n - pos} - b)', f'({n - pos} - eb)')})")
    chosen = tally.select("feature", gain.alias("g")).orderBy(F.desc("g"), "feature").limit(features).toPandas()["feature"].to_numpy(np.int64)
    given = SWAP if terms is None else terms
    swap = Swaps(given | {u: v for u, v in (mine_terms(texts, n, pos, mined) if mined else {}).items() if u not in given and v not in given})
    named = hashed(_from_strings(sorted(swap.terms)))[1] if swap.terms else np.zeros(0, np.int64)
    model = Model(np.unique(np.concatenate([chosen, named])), np.zeros(0), 0.0)

    def rows_of(batch):
        """Sparse rows of texts."""
        table = model.table()
        y = batch.column(batch.schema.get_field_index("y"))
        for first, run in runs(string_column(batch, "text")):
            of, at, value = _values(run, table)
            offsets = pa.array(run.bounds(of).astype(np.int32))
            yield pa.RecordBatch.from_arrays([y.slice(first, run.n), pa.ListArray.from_arrays(offsets, pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(value))], ["y", "at", "value"])

    def swaps_of(batch):
        """What swaps change in the sparse rows of sentences, by the sentence's md5; swaps that change nothing are left out."""
        table, wide = model.table(), max(len(model.features), 1)
        pairs = [p for text in string_column(batch, "text") for p in swap.sentences(text.as_py())]
        for some in (pairs[i : i + 2000] for i in range(0, len(pairs), 2000)):
            of, at, value = _values(_from_strings([x for p in some for x in p]), table)
            cells, place = np.unique(of // 2 * wide + at, return_inverse=True)
            change = np.bincount(place, weights=np.where(of % 2 == 0, value, -value), minlength=len(cells))
            cells, change = cells[change != 0], change[change != 0]
            rows_, starts = np.unique(cells // wide, return_index=True)
            offsets = pa.array(np.append(starts, len(cells)).astype(np.int32))
            keys = [hashlib.md5(some[i][0].encode()).hexdigest() for i in rows_]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(cells % wide)), pa.ListArray.from_arrays(offsets, pa.array(change))], ["key", "at", "value"])

    plain = arrow_map(texts.select("text", "y"), rows_of, "y int, at array<long>, value array<double>").toArrow().to_pandas()
    changes = arrow_map(texts.select("text"), swaps_of, "key string, at array<long>, value array<double>").orderBy("key", "at", "value").limit(swaps).toArrow().to_pandas()

    def sparse(part):
        lengths = part["at"].map(len).to_numpy(np.int64) if len(part) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(part)), lengths)
        at = np.concatenate([*part["at"], np.zeros(0, np.int64)]).astype(np.int64)
        value = np.concatenate([*part["value"], np.zeros(0)])
        return lambda w: np.bincount(row, weights=value * w[at], minlength=len(part)), lambda r: np.bincount(at, weights=value * r[row], minlength=len(model.features))

    dot, back = sparse(plain)
    swap_dot, swap_back = sparse(changes)
    penalty = (lambda w: 2 * swap_weight * swap_back(swap_dot(w)) / len(changes)) if len(changes) else None
    model.weights, model.bias = fit(dot, back, plain["y"].to_numpy(float), len(model.features), l2, penalty=penalty)
    model.terms, model.swaps = swap.terms, len(changes)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score (0 to 1) of every whole text; null texts score as empty ones, equal texts alike. One row
    per row, repeated ones too; other columns are left out, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batch):
        table, out = shared.value.table(), []
        for _, texts in runs(string_column(batch, "text")):
            out.append(shared.value.scores(texts, table))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*out, np.zeros(0)]))], ["doc_id", "score"])

    return arrow_map(docs.select("doc_id", "text"), f, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows kept from the fit: crc32 of doc_id as text leaves 1 modulo 3. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
