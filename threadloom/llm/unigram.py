"""Giant documents under a unigram SentencePiece model, by a max-plus parallel scan.

The segmentation of largest score is a shortest-path problem over text positions. At a cut between two chunks the state is how many
characters before the cut the last piece border lies (0: a border at the cut itself); no piece is longer than the longest one of the
vocabulary, so the states are few. A chunk yields the matrix of best scores from each state at its start to each state at its
end. These matrices combine by max-plus products, which are associative: one row of products per document gives the best
state at every cut, and then every chunk is traced back between its two states on its own.

Scores are summed in double precision; the library sums in single precision, so near-ties of very long texts may differ from it.
Of segmentations that tie (pieces in another order, say) any one may come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage, string_column

UNIGRAM = 1
UNKNOWN_PENALTY = 10.0
NEVER = -np.inf


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message: ints for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift, more = at + 1, shift + 7, raw[at] & 128
            if not more:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


def is_unigram(path: str) -> bool:
    """Whether a model file is of unigram type (the format's default)."""
    with open(path, "rb") as f:
        spec = next((x for n, x in _fields(f.read()) if n == 2), b"")
    return next((x for n, x in _fields(spec) if n == 3), UNIGRAM) == UNIGRAM


class Lattice:
    """Pieces of a unigram model, and best paths over a normalised text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_unused(i) or m.is_byte(i))]
        self.pieces = {m.id_to_piece(i): (i, m.get_score(i)) for i in usable}
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(m.is_byte(i) for i in range(m.get_piece_size())) else None

    def normalize(self, text: str) -> str:
        return self.model.normalize(text)

    def steps(self, s: str, at: int) -> list[tuple[int, float, int]]:
        """(end, score, id) of the pieces that begin at a place; a character that is no piece is unknown (id -1)."""
        out = []
        for end in range(at + 1, min(at + self.longest, len(s)) + 1):
            if (hit := self.pieces.get(s[at:end])) is not None:
                out.append((end, hit[1], hit[0]))
        if not out or out[0][0] != at + 1:
            out.insert(0, (at + 1, self.unknown, -1))
        return out

    def transfer(self, s: str, before: int) -> np.ndarray:
        """Scores from state a at the chunk's start (before characters into s) to state b at its end: matrix [a, b]."""
        states = before + 1
        best = np.full((len(s) + 1, states), NEVER)
        for a in range(states):
            best[before - a, a] = 0.0
        for at in range(len(s)):
            here = best[at]
            if here.max() == NEVER:
                continue
            for end, score, _ in self.steps(s, at):
                if at >= before or end > before:  # a piece that begins before the cut goes on beyond it
                    np.maximum(best[end], here + score, out=best[end])
        return best[len(s) - np.arange(min(self.longest, len(s) - before))].T.copy()

    def trace(self, s: str, before: int, a: int, b: int) -> list[int]:
        """Ids of the best path from state a to state b; -1 for unknown characters."""
        first, last = before - a, len(s) - b
        best, back = [NEVER] * (len(s) + 1), [(0, 0)] * (len(s) + 1)
        best[first] = 0.0
        for at in range(first, last):
            if best[at] == NEVER or (first < at < before):
                continue
            for end, score, id_ in self.steps(s, at):
                if end <= last and (at >= before or end > before) and best[at] + score > best[end]:
                    best[end], back[end] = best[at] + score, (at, id_)
        ids, at = [], last
        while at > first:
            at, id_ = back[at]
            ids.append((at, id_))
        return self.coded(s, ids[::-1])

    def coded(self, s: str, path: list[tuple[int, int]]) -> list[int]:
        out = []
        for at, id_ in path:
            if id_ >= 0:
                out.append(id_)
            elif self.bytes:
                out.extend(self.bytes[x] for x in s[at].encode())
            else:
                out.append(self.model.unk_id())
        return out


def chunks(s: str, limit: int, longest: int) -> Iterator[tuple[str, int]]:
    """The text in chunks of limit characters (the last up to twice as many), each with up to longest - 1 characters before it
    and their number."""
    limit = max(limit, longest)
    n = max(1, len(s) // limit)
    for i in range(n):
        start, end = i * limit, (i + 1) * limit if i < n - 1 else len(s)
        before = min(start, longest - 1)
        yield s[start - before : end], before


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """State at every cut of the best path that begins and ends in state 0: max-plus products from the left, choices from the right."""
    ahead = [np.zeros(1)]
    for m in matrices:
        ahead.append((ahead[-1][: len(m), None] + m[: len(ahead[-1])]).max(0))
    states = [0]
    for k in range(len(matrices) - 1, -1, -1):
        m = matrices[k]
        states.append(int(np.argmax(ahead[k][: len(m)] + m[: len(ahead[k]), states[-1]])))
    return states[::-1]


def encode_giants(rows: DataFrame, path: str, limit: int) -> DataFrame:
    """rows(row_ long, text) -> row_, ids, round_trip (the pieces read as the text). One row per row; empty texts have no ids.

    A text's matrices meet in one group: at most 2 GB of text over limit characters a matrix, that is a few MB."""
    spark = rows.sparkSession

    def cut(batches):
        lattice = Lattice(path)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), string_column(batch, "text"), strict=True):
                text = text.as_py()
                s = lattice.normalize(text)
                same = s.replace("▁", " ").removeprefix(" ") == text.removeprefix(" ")
                for part, (piece, before) in enumerate(chunks(s, limit, lattice.longest)):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([part], pa.int32()), pa.array([piece], pa.string()), pa.array([before], pa.int32()), pa.array([same])], ["row_", "part", "s", "before", "same"])

    dealt = rows.select("row_", "text").mapInArrow(cut, "row_ long, part int, s string, before int, same boolean")
    dealt = stage(dealt.repartition(shuffle_partitions(spark), "row_", "part"), "chunks")

    def matrices(batches):
        lattice = Lattice(path)
        for batch in batches:
            made = [lattice.transfer(s, before) for s, before in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.shape[1] for m in made], pa.int32()), pa.array([m.tobytes() for m in made], pa.binary())], ["row_", "part", "wide", "m"])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        found = best_states([np.frombuffer(m, np.float64).reshape(-1, w) for m, w in zip(pdf["m"], pdf["wide"], strict=True)])
        return pd.DataFrame({"row_": pdf["row_"], "part": pdf["part"], "a": found[:-1], "b": found[1:]})

    at = dealt.mapInArrow(matrices, "row_ long, part int, wide int, m binary").groupBy("row_").applyInPandas(states, "row_ long, part int, a int, b int")

    def traced(batches):
        lattice = Lattice(path)
        for batch in batches:
            found = [lattice.trace(r["s"], r["before"], r["a"], r["b"]) for r in batch.select(["s", "before", "a", "b"]).to_pylist()]
            names = ["row_", "part", "same"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(found, pa.list_(pa.int32()))], [*names, "ids"])

    pieces = dealt.join(at, ["row_", "part"]).select("row_", "part", "same", "s", "before", "a", "b").mapInArrow(traced, "row_ long, part int, same boolean, ids array<int>")
    whole = pieces.groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p"), F.min("same").alias("round_trip"))
    whole = whole.select("row_", F.flatten(F.col("p.ids")).alias("ids"), "round_trip")
    lattice = Lattice(path)
    if lattice.bytes is None:  # unknown characters side by side are one
        unk = F.lit(lattice.model.unk_id())
        whole = whole.withColumn("round_trip", F.col("round_trip") & ~F.array_contains("ids", unk))
        ids = F.col("ids")
        whole = whole.withColumn("ids", F.filter(ids, lambda x, i: (x != unk) | (i == 0) | (F.get(ids, i - 1) != unk)))
    return whole
