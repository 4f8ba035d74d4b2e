"""Quality rules: fixed rules first, then a calibrated logistic regression over hashed words and character n-grams.

Counts of hashed words and of one to three characters are taken over the whole text, damped by a logarithm and scaled to unit length.
The regression is fitted on a bounded sample of labelled rows, of which a fifth is held back to calibrate its probabilities
(Platt). Texts are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, string_column
from .linear import fit, labelled_sample, platt, sigmoid
from .textnum import IS_SPACE, U, Texts, mix, runs, windows

WORD_SLOTS, GRAM_SLOTS = 1024, 3072
SLOTS = WORD_SLOTS + GRAM_SLOTS
LEAST_WORDS = 50
KEEP = 0.5
#: Odd factors that tell the characters of an n-gram apart by place.
STEP = mix(np.arange(201, 204, dtype=U)) | U(1)
#: Texts whose features are held at once.
RUN_TEXTS = 200
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def features(texts: Texts) -> np.ndarray:
    """One row of SLOTS values per text."""
    starts, ends, owner = texts.words()
    slots = [(owner, (texts.hashes(starts, ends) % U(WORD_SLOTS)).astype(np.int64))]
    # Characters: runs of bytes that begin with one that is no continuation byte.
    first = np.flatnonzero((texts.data & 0xC0) != 0x80)
    of = np.searchsorted(texts.offsets, first, side="right") - 1
    code = texts.hashes(first, np.append(first[1:], len(texts.data)))
    for k in (1, 2, 3):
        if len(first) < k:
            break
        total = np.full(len(first) - k + 1, k, U)
        for j in range(k):
            total += code[j : len(code) - k + 1 + j] * STEP[j]
        whole = of[: len(total)] == of[k - 1 :]
        slots.append((of[: len(total)][whole], (mix(total[whole]) % U(GRAM_SLOTS)).astype(np.int64) + WORD_SLOTS))
    out = np.zeros((texts.n, SLOTS), np.float32)
    for text, slot in slots:
        out += np.bincount(text * SLOTS + slot, minlength=texts.n * SLOTS).reshape(texts.n, SLOTS).astype(np.float32)
    out = np.log1p(out)
    for part in (out[:, :WORD_SLOTS], out[:, WORD_SLOTS:]):
        part /= np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9)
    return out


def counts(texts: Texts) -> dict[str, np.ndarray]:
    """The rules' counts of each text."""
    starts, ends, owner = texts.words()
    per_text = lambda marks: np.add.reduceat(np.append(marks, 0), texts.offsets[:-1]) * (np.diff(texts.offsets) > 0) if texts.n else np.zeros(0, int)
    letters = (~IS_SPACE[texts.data]) & ((texts.data & 0xC0) != 0x80)
    n_words = np.bincount(owner, minlength=texts.n)
    # Lines with a word, equal to an earlier one: all but one of each group of equal lines.
    ls, le, lo = texts.lines()
    worded = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, lo = ls[worded], le[worded], lo[worded]
    lines = np.unique(np.stack([lo.astype(U), texts.hashes(ls, le)], 1), axis=0) if len(lo) else np.zeros((0, 2), U)
    dup_lines = np.bincount(lo, minlength=texts.n) - np.bincount(lines[:, 0].astype(np.int64), minlength=texts.n)
    got, at, of = windows(texts.hashes(starts, ends), owner, 3, False)
    order = np.lexsort((got, of))
    same = np.zeros(len(order) + 1, bool)
    if len(order):
        same[1:-1] = (got[order][1:] == got[order][:-1]) & (of[order][1:] == of[order][:-1])
    again = order[same[:-1] | same[1:]]
    covered = np.zeros(len(starts) + 2, bool)
    for d in range(3):
        covered[at[again] + d] = True
    return {
        "n_words": n_words, "word_chars": per_text(letters.astype(np.int64)), "n_symbols": per_text(SYMBOLS[texts.data].astype(np.int64)),
        "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(owner[covered[: len(starts)]], minlength=texts.n),
    }


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (x @ self.weights + self.bias) + self.offset)


def _matrix(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and labels of the sample by doc_id, every fifth row moved behind the others for calibration, and the number of
    rows before those. One copy of the features is held, and the sample's own memory is given back."""
    got = sample.toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    back = np.arange(len(order)) % 5 == 4
    order = np.concatenate([order[~back], order[back]])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    y = got.column("y").to_numpy().astype(float)[order]
    x, done = np.empty((len(order), SLOTS), np.float32), 0
    for batch in got.to_batches():
        column = batch.column(2)
        raw = np.frombuffer(column.buffers()[2] or b"", np.float16).reshape(-1, SLOTS)[column.offset : column.offset + len(column)]
        x[place[done : done + len(column)]] = raw
        done += len(column)
    del got
    pa.default_memory_pool().release_unused()
    return x, y, int((~back).sum())


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, l2: float = 1e-4) -> Model:
    """docs(doc_id, text), labels(doc_id, quality) -> Model of the probability that quality is 1. rows bounds the labelled rows of
    the fit: the ids of least md5. Without labels, or with one label only, every text has the same probability, 0.5 or that
    label's. Of a doc_id with several labels the larger counts; one with several rows counts once for each. Rows without a
    doc_id or label are not used. Texts of any length count whole."""
    sample = labelled_sample(labels, "quality", rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def f(batch):
        x = np.concatenate([features(t).astype(np.float16) for _, t in runs(string_column(batch, "text"), rows=RUN_TEXTS)] or [np.zeros((0, SLOTS), np.float16)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("y")), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    x, y, fitted = _matrix(arrow_map(texts, f, "doc_id long, y int, x binary"))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(SLOTS, np.float32), 0.0, 1.0, float(np.clip((y.mean() - 0.5) * 10, -5, 5)) if len(y) else 0.0)
    a = x[:fitted]
    w, b = fit(lambda w: a @ w.astype(np.float32), lambda r: r.astype(np.float32) @ a, y[:fitted], SLOTS, l2, steps=200, rate=0.2)
    slope, offset = platt(x[fitted:] @ w.astype(np.float32) + b, y[fitted:])
    return Model(w.astype(np.float32), b, slope, offset)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """docs(doc_id, text, ...) -> all columns, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, quality_score,
    base_failed and kept. Columns of these names in docs are replaced. Null texts count as empty and fail."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [*COUNTS, "quality_score", "base_failed", "kept"]
    docs = docs.drop(*new)

    def f(batch):
        for first, texts in runs(string_column(batch, "text"), rows=RUN_TEXTS):
            c = counts(texts)
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            p = shared.value.probabilities(features(texts)).astype(float)
            part = batch.slice(first, texts.n)
            cols = [pa.array(c[k], pa.int64()) for k in COUNTS] + [pa.array(p), pa.array(failed), pa.array(~failed & (p >= keep))]
            yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *new])

    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

    kinds = [*[LongType()] * len(COUNTS), DoubleType(), BooleanType(), BooleanType()]
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(new, kinds, strict=True))])
    return arrow_map(docs, f, schema)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows of docs and judge all rows: one row per row, so repeated rows and rows of equal texts have equal
    verdicts. See train and judge for nulls and clashing columns; an empty table gives an empty one."""
    return judge(docs, train(docs, labels))


