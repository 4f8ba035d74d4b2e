"""Chat formatting at token level.

Template of a turn: <|im_start|> role <|im_sep|> text <|im_end|>. The marks are reserved ids beyond the vocabulary, spliced
between separately encoded segments, so no text can produce them. In the formatted string a text must not look like a mark
either: wherever a text has "<", any number of "\\" and "|", one more "\\" is put after the "<"; taking one away undoes it.
The loss mask covers the tokens of assistant texts; it comes from +1 and -1 at segment borders by a prefix sum.

Turns are sorted into ranges of even size, so a long conversation is encoded in as many tasks as it has ranges, and a prefix sum
over the ranges gives each turn its place. Reading back decodes turns where they lie; only the digest of a whole conversation,
which SHA-256 defines in order, is made in one task, which streams the decoded texts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage

MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURNS = "range_ int, conv_id long, turn long, start long, n long, ids array<int>, mask array<tinyint>"
READ = "conv_id long, turn long, start long, n long, chars long, said string, loss string"
#: Leading characters of role and text by which ranges are cut.
HEAD = 64


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def vocabulary_path(name: str) -> str:
    """A vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Byte-level BPE of a rank file, with the marks as the ids after its vocabulary."""

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.start, self.sep, self.end = (max(table.values()) + 2 + i for i in range(3))

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(list(ids)).decode("utf-8")


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """The codec of a rank file, once per Python worker."""
    return Codec(path)


def assemble(codec: Codec, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn."""
    segments = [[codec.start], codec.encode(escape(role)), [codec.sep], codec.encode(escape(text)), [codec.end]]
    borders = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    steps = np.zeros(borders[-1] + 1, np.int8)
    if role == "assistant":
        steps[borders[3]] += 1
        steps[borders[4]] -= 1
    return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(steps[:-1]).astype(np.int8)


def ranged(turns: DataFrame) -> DataFrame:
    """turns in ranges by conversation, turn, role and text, sorted within, with the range's number: range_. Ranges are cut by leading
    characters (the order that the bounds are in agrees with that of whole strings), as bounds go through the driver; so only
    rows that agree in all of them must lie in one range."""
    text = F.when(F.coalesce(F.length("role"), F.lit(0)) < HEAD, F.substring("text", 1, HEAD))
    cut = turns.repartitionByRange(shuffle_partitions(turns.sparkSession), "conv_id", "turn", F.substring("role", 1, HEAD), text)
    return cut.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("range_", F.spark_partition_id())


def format_chat(turns: DataFrame, ranks: str | None = None) -> DataFrame:
    """turns(conv_id, turn, role, text) -> one row per turn: conv_id, turn (0, 1, ... in order), start (first token's place in the
    conversation), ids, mask.

    Rows of a conversation come by turn, then role and text (nulls first); null roles and texts are empty. A null conv_id is a
    conversation. Other columns are left out; an empty table gives none. ranks: path of a rank file."""
    path = ranks or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batches):
        codec, last, turn, start = codec_of(path), (), 0, 0
        for batch in batches:
            rows = {"range_": [], "conv_id": [], "turn": [], "start": [], "n": [], "ids": [], "mask": []}
            for conv, role, text, at in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if last != (conv,):
                    last, turn, start = (conv,), 0, 0
                ids, mask = assemble(codec, role or "", text or "")
                for name, x in zip(rows, (at, conv, turn, start, len(ids), ids, mask), strict=True):
                    rows[name].append(x)
                turn, start = turn + 1, start + len(ids)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows.values(), kinds, strict=True)], list(rows))

    picked = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = stage(ranged(picked).mapInArrow(run, TURNS), "turns")
    # What a conversation has in ranges before: only the first conversation of a range can have any, so there is a row a range at most.
    before = Window.partitionBy("conv_id").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("range_", "conv_id").agg(F.count("*").alias("turns"), F.sum("n").alias("tokens"))
    ahead = totals.select(F.col("range_").alias("at_"), F.col("conv_id").alias("of_"), F.sum("turns").over(before).alias("turns"), F.sum("tokens").over(before).alias("tokens")).where("turns > 0")
    rows = rows.join(F.broadcast(ahead), (F.col("range_") == F.col("at_")) & F.col("conv_id").eqNullSafe(F.col("of_")), "left")
    zero = F.lit(0).cast("long")
    return rows.select("conv_id", (F.col("turn") + F.coalesce("turns", zero)).alias("turn"), (F.col("start") + F.coalesce("tokens", zero)).alias("start"), "ids", "mask")


def read_turns(formatted: DataFrame, ranks: str | None = None) -> DataFrame:
    """Output of format_chat -> per turn: conv_id, turn, start, n (tokens), chars (of the formatted turn, marks included), said (role,
    newline, text, newline, unescaped), loss (the unescaped text under the mask; null where the mask is empty). A turn whose marks
    are not in their places is an error. Turns are read where they lie, without a shuffle."""
    path = ranks or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            n, chars, said, loss = [], [], [], []
            for conv, turn, ids, mask in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                ids, mask = np.asarray(ids, np.int32), np.asarray(mask, bool)
                marks = np.flatnonzero(ids >= codec.start)
                if ids[marks].tolist() != [codec.start, codec.sep, codec.end] or marks[0] or marks[2] != len(ids) - 1:
                    raise ValueError(f"conversation {conv}: malformed turn {turn}")
                role, text = codec.decode(ids[1 : marks[1]]), codec.decode(ids[marks[1] + 1 : marks[2]])
                n.append(len(ids))
                chars.append(len(role) + len(text) + sum(map(len, MARKS)))
                said.append(f"{unescape(role)}\n{unescape(text)}\n")
                loss.append(unescape(codec.decode(ids[mask])) if mask.any() else None)
            columns = [batch.column(i).cast(pa.int64()) for i in (0, 1, 2)] + [pa.array(n, pa.int64()), pa.array(chars, pa.int64()), pa.array(said, pa.string()), pa.array(loss, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "start", "n", "chars", "said", "loss"])

    return formatted.select("conv_id", "turn", "start", "ids", "mask").mapInArrow(run, READ)


def read_back(formatted: DataFrame, ranks: str | None = None) -> DataFrame:
    """Output of format_chat -> per conversation: conv_id, n_turns, turns_sha256 (of role, newline, text, newline of every turn),
    loss_chars and loss_sha256 (characters under the mask, unescaped, nothing between), formatted_chars (of the whole formatted
    string, marks included), n_tokens. Everything comes from ids and mask."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        now = None

        def result(x):
            return x["conv"], x["turns"], x["all"].hexdigest(), x["loss_chars"], x["loss"].hexdigest(), x["chars"], x["tokens"]

        for batch in batches:
            done = []
            for conv, start, n, chars, said, loss in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        done.append(result(now))
                    now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0}
                if start != now["tokens"]:
                    raise ValueError(f"conversation {conv}: turns are missing before token {start}")
                loss = loss or ""
                now["turns"] += 1
                now["all"].update(said.encode())
                now["loss"].update(loss.encode())
                now["loss_chars"] += len(loss)
                now["chars"] += chars
                now["tokens"] += n
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(result(now), kinds, strict=True)], names)

    turns = read_turns(formatted, ranks)
    turns = turns.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn")
    return turns.mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True)))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 32 AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
