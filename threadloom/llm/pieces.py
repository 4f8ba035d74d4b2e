"""SentencePiece encoding and decoding, documents in parallel and giant documents in parts.

Giant documents of a unigram model go through the max-plus scan of unigram.py. The model at hand is a BPE model: its merges follow
rank, not the largest sum of scores, so a scan over piece scores does not give its ids (README has figures). What a scan needs is a
boundary state between parts, and for this model the state is trivial at some places: no piece holds the space mark after another
character, so before a space that follows a non-space the segmentation is cut in any case. Texts are cut there into units, every
distinct unit is encoded once per task, and parts of a giant document are encoded, decoded and checked apart, then put
together by their numbers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat import vocabulary_path
from .common import arrow_map, shuffle_partitions, stage, string_column, unused
from .unigram import encode_giants, is_unigram

MODEL = "piece_bpe_32k.model"
PART_CHARS = 200_000
CACHE_UNITS = 150_000
_CUT = re.compile(r"(?<=[^ ▁]) (?!\Z)")


def units(text: str) -> list[str]:
    """The text cut before the spaces at which no piece can go on; the cut space is dropped, as the encoder adds one in front."""
    if not text:
        return []
    if "  " in text or "▁" in text or text[0] == " " or text[-1] == " ":
        return _CUT.split(text)
    return text.split(" ")


def parts(text: str, limit: int = PART_CHARS) -> list[str]:
    """The text in parts of about limit characters, cut like units. A stretch without such places stays whole."""
    out, at = [], 0
    while len(text) - at > limit and (m := _CUT.search(text, at + limit)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


class Encoder:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spread = any("▁" in p.lstrip("▁") for p in map(self.model.id_to_piece, range(self.model.get_piece_size())))
        #: Units are the library's way of cutting only for BPE whose pieces end before a space; other models encode whole texts.
        self.units = units if not spread and not is_unigram(path) else (lambda text: [text] if text else [])
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.pool, self.lengths = [], []
        self.flat = self.starts = self.counts = None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's."""
        split = [self.units(t) for t in texts]
        if len(self.place) > CACHE_UNITS:
            self.forget()
        known = len(self.place)
        place = self.place
        codes = np.fromiter((place.setdefault(u, len(place)) for s in split for u in s), np.int64, sum(map(len, split)))
        if len(place) > known:
            new = self.model.encode(list(place)[known:], num_threads=1)
            self.lengths.append(np.fromiter(map(len, new), np.int64, len(new)))
            self.pool.append(np.fromiter((i for ids in new for i in ids), np.int32, int(self.lengths[-1].sum())))
            self.lengths, self.pool = [np.concatenate(self.lengths)], [np.concatenate(self.pool)]
            self.starts = np.concatenate([[0], np.cumsum(self.lengths[0])])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        length = self.lengths[0][codes]
        to = np.cumsum(length)
        flat = self.pool[0][np.repeat(self.starts[codes] - (to - length), length) + np.arange(to[-1])]
        ends = np.concatenate([[0], to])[np.cumsum([0, *map(len, split)])]
        return flat, ends

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids) if ids else []


def encode_column(docs: DataFrame, model: str | None = None, text: str = "text", decode: bool = True) -> DataFrame:
    """Adds ids array<int> and round_trip (decoding the ids gives the text; null without decode) to docs. A null text has null ids."""
    path = model or vocabulary_path(MODEL)
    docs = docs.drop("ids", "round_trip")

    def run(batches):
        coder = Encoder(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
            at = 0
            while at < len(column):
                to, size = at, 0
                while to < len(column) and (to == at or size < 1 << 19):
                    size += len(column[to].as_py() or "")
                    to += 1
                values = column.slice(at, to - at).to_pylist()
                flat, ends = coder.encode([v or "" for v in values])
                back = coder.decode([flat[a:b].tolist() for a, b in zip(ends, ends[1:])]) if decode else values
                mask = pa.array([v is None for v in values])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=mask)
                same = pa.array([v == b if decode and v is not None else None for v, b in zip(values, back, strict=True)], pa.bool_())
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, ids, same], [*part.schema.names, "ids", "round_trip"])
                at = to

    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]))


def encode_documents(docs: DataFrame, model: str | None = None, giant: int = PART_CHARS, decode: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) -> all columns but text, with n_chars, n_tokens, ids and round_trip.

    Texts of up to giant characters are encoded where they are; longer ones are numbered, staged and dealt out in parts. An empty
    text has no ids; a null text has null ids, 0 tokens and a null round_trip. Repeated rows are encoded one by one. Columns of the
    new names are replaced. A text in which the space mark U+2581 stands decodes to a space there; round_trip is then false.
    decode: whether to decode again, for round_trip."""
    path = model or vocabulary_path(MODEL)
    docs = docs.drop("n_chars", "n_tokens", "ids", "round_trip")
    rest, (row,) = [c for c in docs.columns if c != "text"], unused(docs, "row_")
    n_tokens = F.when(F.col("ids").isNull(), F.lit(0)).otherwise(F.size("ids")).cast("long")
    last = [F.length("text").cast("long").alias("n_chars"), n_tokens.alias("n_tokens"), "ids", "round_trip"]
    short = encode_column(docs.where(F.coalesce(F.length("text") <= giant, F.lit(True))), path, decode=decode).select(*rest, *last)
    long = stage(docs.where(F.length("text") > giant).withColumn(row, F.monotonically_increasing_id()), "giants")
    texts = long.select(F.col(row).alias("row_"), "text")
    if is_unigram(path):
        whole = encode_giants(texts, path, giant)
    else:
        coded = encode_column(_dealt(texts, giant), path, decode=decode).groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p"), F.min("round_trip").alias("round_trip"))
        whole = coded.select("row_", F.flatten(F.col("p.ids")).alias("ids"), "round_trip")
    return short.unionByName(long.join(whole.withColumnRenamed("row_", row), row).select(*rest, *last))


def _dealt(texts: DataFrame, limit: int) -> DataFrame:
    """texts(row_, text) -> row_, part, text: the parts of each text, dealt out by number."""

    def cut(batch):
        column = string_column(batch, "text")
        for row in range(batch.num_rows):
            made = parts(column[row].as_py(), limit)
            for first in range(0, len(made), 16):
                some = made[first : first + 16]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(some), pa.int64()), pa.array(range(first, first + len(some)), pa.int32()), pa.array(some, pa.string())], ["row_", "part", "text"])

    return arrow_map(texts, cut, "row_ long, part int, text string").repartition(shuffle_partitions(texts.sparkSession), "row_", "part")
