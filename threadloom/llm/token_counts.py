"""Token counts by a compiled finite-state machine for a byte-level BPE vocabulary with word ends.

The tokenizer file is compiled into two deterministic transducers.

- Words: characters have one of four classes (letter, number, other, space), and where a word begins follows from the classes of
  a few characters (a contraction such as 'll begins a word unless its apostrophe goes on a run of others).
- Pieces of a word: what BPE makes of a prefix changes with every further byte, but in a known way. Two pieces can stand side by side
  if no merge that joins their touching sides comes before the merges that build them; every text has one sequence of pieces in
  which all neighbours can. So the last piece of a prefix is the one suffix in the vocabulary that can stand after the last
  piece of what is before it. A state holds, for every place at which a piece may still be open, the open piece (a node of the
  vocabulary's trie), the last piece before it and the number of pieces up to there; a transition is annotated with how many
  pieces it adds. States are made when they are first reached. Counts add up along the path, the last byte's included.

Giant texts are cut anywhere (but within a contraction). The state at a cut is the distance to the next border of pieces, shorter than
the longest piece. From a border onwards pieces do not depend on what is before it, so a chunk maps every distance at its start to
a number of pieces and a distance at its end; where its last word goes on, the border after the end is read off the text that follows,
as soon as all ways to go on share one. Maps are composed in a tree, which is what a parallel prefix scan does, and the whole
text's map gives the count. A text with a stretch that never settles is counted in one go.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat import vocabulary_path
from .common import shuffle_partitions, stage, string_column, unused

MODEL = "word_bpe_49k.json"
GIANT = 1 << 15
AHEAD = 1 << 11
BEFORE = 5
FAN_IN = 64
NEVER = 1 << 60
LETTER, NUMBER, OTHER = 1, 2, 3
#: Bounds of caches that are emptied when full.
CACHED_WORDS, CACHED_STATES, CACHED_CHARS = 400_000, 1_000_000, 40


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it prints, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    later = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(later)) for b in range(256)]


class Pieces:
    """The transducer for words. A word's symbols are its bytes, the last one plus 256."""

    def __init__(self, merges: list[tuple[str, str]], word_end: str):
        spelt, ids = {}, {}
        for b, c in enumerate(byte_alphabet()):
            for name, symbol in ((c, b), (c + word_end, b + 256)):
                ids[name] = len(ids)
                spelt[name] = (symbol,)
        self.joined: dict[tuple[int, int], int] = {}
        right, left = [[(i, NEVER)] for i in range(512)], [[(i, NEVER)] for i in range(512)]
        for rank, (a, b) in enumerate(merges):
            name = a + b
            if name in ids or a not in ids or b not in ids:
                raise ValueError(f"merge {rank} makes no new piece of known ones: {a!r} {b!r}")
            i, x, y = len(ids), ids[a], ids[b]
            ids[name], spelt[name], self.joined[x, y] = i, spelt[a] + spelt[b], rank
            # Pieces at a piece's right and left side as it grows, with the rank of the merge that ends each.
            right.append([*right[y][:-1], (y, rank), (i, NEVER)])
            left.append([*left[x][:-1], (x, rank), (i, NEVER)])
        self.right, self.left = right, left
        self.child: list[dict[int, int]] = [{}]
        self.piece: list[int] = [-1]
        for name, symbols in spelt.items():
            node = 0
            for s in symbols:
                node = self.child[node].setdefault(s, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.piece.append(-1)
            self.piece[node] = ids[name]
        self.size = [len(x) for x in spelt.values()]
        self.longest = max(self.size)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Start again with the first state only."""
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int, int]]] = []
        self._state(((0, -1, 0),))

    def _state(self, key: tuple) -> int:
        at = self.states.setdefault(key, len(self.keys))
        if at == len(self.keys):
            self.keys.append(key)
            self.moves.append({})
        return at

    def can_follow(self, a: int, b: int) -> bool:
        """Whether piece b can stand after piece a: no merge joins the pieces at their sides while both are there. Of equal merges the
        left one comes first."""
        if a < 0:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            x, y, i, j, known = self.right[a], self.left[b], 0, 0, True
            while True:
                (p, p_ends), (q, q_ends) = x[i], y[j]
                rank = self.joined.get((p, q), NEVER)
                if rank < p_ends and rank <= q_ends and rank < NEVER:
                    known = False
                    break
                if p_ends == q_ends == NEVER:
                    break
                if p_ends <= q_ends:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = known
        return known

    def move(self, state: int, symbol: int) -> tuple[int, int, int]:
        """Next state, pieces added, and symbols of the last piece. Places further back come first in a state, by their distance."""
        found = self.moves[state].get(symbol)
        if found is None:
            key, now, items = self.keys[state], None, []
            for node, last, n in key:
                to = self.child[node].get(symbol, 0)
                if to:
                    if now is None and (piece := self.piece[to]) >= 0 and self.can_follow(last, piece):
                        now = (piece, n + 1, node)
                    items.append((to, last, n))
            if now is None:
                raise ValueError("no piece fits")
            piece, added, _ = now
            items = tuple((to, last, n - added) for to, last, n in items if self.child[to])
            found = self.moves[state][symbol] = (self._state((*items, (0, piece, 0))), added, self.size[piece])
        return found

    def count(self, word: bytes) -> int:
        """Pieces of a whole word."""
        if len(self.keys) > CACHED_STATES:
            self.forget()
        state, n, moves = 0, 0, self.moves
        for b in word[:-1]:
            state, added, _ = moves[state].get(b) or self.move(state, b)
            n += added
        return n + self.move(state, word[-1] + 256)[1] if word else 0

    def borders(self, word: bytes, ended: bool) -> list[int]:
        """Borders of pieces from 0 on, as far as they are settled: to the end of an ended word, else to the last border that every way
        to go on shares."""
        if len(self.keys) > CACHED_STATES:
            self.forget()
        back, state = [0], 0
        for i, b in enumerate(word):
            state, _, size = self.move(state, b + 256 if ended and i == len(word) - 1 else b)
            back.append(i + 1 - size)
        at = len(word)
        if not ended:
            # Some border lies among the last few places; go back from all of them until one is left.
            open_ = set(range(max(0, at - self.longest), at + 1))
            while len(open_) > 1:
                far = max(open_)
                open_.remove(far)
                open_.add(back[far])
            at = open_.pop()
        out = [at]
        while at:
            at = back[at]
            out.append(at)
        return out[::-1]


class WordCounts(dict):
    """Pieces of words seen before; others are counted when asked for."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, word: str) -> int:
        n = self.pieces.count(word.encode())
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


def compile_characters(path: str) -> dict:
    """What the file says of characters, as tables: their classes, lower-case forms that differ from Python's, and special strings.
    Classes are read off the library's own rule, applied to all characters once."""
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in split] != ["Split", "ByteLevel"] or not model["end_of_word_suffix"]:
        raise ValueError("only byte-level BPE with word ends, over NFC text in lower case, is compiled")
    alone = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": split[0]}))
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = np.full(0x110000, OTHER, np.uint8)
    for at in range(0, len(chars), 1 << 16):
        some = chars[at : at + (1 << 16)]
        words = alone.pre_tokenizer.pre_tokenize_str(" ".join(f"a{c}!" for c in some))
        spans, k = [s for _, s in words], 0
        for i, c in enumerate(some):
            start = 4 * i
            ends = []
            while k < len(spans) and spans[k][0] < start + 4:
                ends.append((spans[k][0] - start, spans[k][1] - start))
                k += 1
            table[ord(c)] = {((0, 2), (2, 3)): LETTER, ((0, 1), (1, 2), (2, 3)): NUMBER, ((0, 1), (1, 3)): OTHER, ((0, 1), (2, 3)): 0}[tuple(ends)]
    mine = [c for c in chars if c != "1" and table[ord(c)]]
    want = alone.normalizer.normalize_str("1".join(mine)).split("1")
    have = lower(unicodedata.normalize("NFC", "1".join(mine))).split("1")
    special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    return {"classes": table, "lower": {ord(c): w for c, w, h in zip(mine, want, have, strict=True) if w != h}, "special": special}


def lower(text: str) -> str:
    """Character by character, so a sigma at a word's end is like any other."""
    return text.replace("Σ", "σ").lower()


class Machine:
    """Both transducers of one file."""

    def __init__(self, path: str, characters: dict):
        spec = json.load(open(path, encoding="utf-8"))["model"]
        self.pieces = Pieces([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]], spec["end_of_word_suffix"])
        self.words = WordCounts(self.pieces)
        self.classes, self.other = characters["classes"], characters["lower"]
        self.has_other = re.compile("[" + "".join(map(re.escape, map(chr, self.other))) + "]").search if self.other else lambda _: None
        self.special = re.compile("|".join(map(re.escape, characters["special"]))) if characters["special"] else None

    def normal(self, text: str) -> tuple[str, int]:
        """The text as the word rule reads it, and how many special strings were in it (they are spaces now)."""
        parts = self.special.split(text) if self.special else [text]
        return " ".join(map(self._normal, parts)), len(parts) - 1

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return lower(text.translate(self.other) if self.has_other(text) else text)

    def spans(self, s: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words."""
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[c]
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]]) if len(kind) else kind
        start = (kind == NUMBER) | ((kind != before) & (kind != 0))
        for at in np.flatnonzero((c == 39) & (before != OTHER)):
            size = 2 if s[at + 1 : at + 2] in ("s", "t", "m", "d") and at + 1 < len(s) else 3 if s[at + 1 : at + 3] in ("re", "ve", "ll") else 0
            if size:
                start[at + 1] = False
                if at + size < len(s) and kind[at + size]:
                    start[at + size] = True
        border = np.flatnonzero(np.append(start | (kind == 0), True))
        first = np.flatnonzero(start)
        return first, border[np.searchsorted(border, first, side="right")]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        got = [self.normal(t) for t in texts]
        s = "\n".join(t for t, _ in got)
        first, last = self.spans(s)
        each = np.fromiter(map(self.words.__getitem__, [s[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]), np.int64, len(first))
        sizes = np.cumsum([len(t) + 1 for t, _ in got])
        return np.bincount(np.searchsorted(sizes, first, side="right"), each, len(texts)).astype(np.int64) + np.array([n for _, n in got], np.int64)

    def cuts(self, s: str, limit: int, ahead: int = AHEAD):
        """Chunks of a normalised text: what they can see, where they begin in it, and their length."""
        at = 0
        while True:
            to = at + limit
            while to < len(s) and self._in_contraction(s, to):
                to += 1
            to = min(to, len(s))
            low = max(0, at - BEFORE)
            yield s[low : to + ahead], at - low, to - at
            if to == len(s):
                return
            at = to

    def _in_contraction(self, s: str, at: int) -> bool:
        low = max(0, at - BEFORE)
        first, last = self.spans(s[low : at + 3])
        inside = (first < at - low) & (last > at - low)
        return bool(inside.any()) and s[low + int(first[inside][-1])] == "'" and bool(self.classes[ord(s[at])] == LETTER)

    def state_map(self, seen: str, at: int, size: int, ahead: int = AHEAD) -> tuple[np.ndarray, np.ndarray]:
        """For every distance at the chunk's start: distance at its end and pieces between (-1: no such state, -2: not settled)."""
        wide = self.pieces.longest
        ends, counts = np.full(wide, -1, np.int64), np.zeros(wide, np.int64)
        to, whole = at + size, len(seen)
        first, last = self.spans(seen)
        # A word that reaches the end of what is seen may go on, unless the text ends there too; cuts() sees less than ahead then.
        goes_on = whole - to >= ahead
        mine = (first >= at) & (first < to)
        inner = mine & (last <= to)
        n = sum(map(self.words.__getitem__, [seen[a:b] for a, b in zip(first[inner].tolist(), last[inner].tolist(), strict=True)]))
        tail = np.flatnonzero(mine & (last > to))
        out = 0
        if len(tail):
            out, more = self._to_edge(seen, int(first[tail[0]]), int(last[tail[0]]), to, goes_on)
            n += more
        head = np.flatnonzero((first < at) & (last > at))
        if not len(head):
            ends[0], counts[0] = out, n
            return ends, counts
        end = int(last[head[0]])
        if end <= to:
            word = seen[at:end].encode()
            for o in range(min(wide, len(word) + 1)):
                ends[o], counts[o] = out, n + self.pieces.count(word[o:])
        else:
            self._through(seen, at, end, to, goes_on, ends, counts)
        return ends, counts

    def _to_edge(self, seen: str, at: int, end: int, edge: int, goes_on: bool) -> tuple[int, int]:
        """Distance from the edge to the first border at or after it, and pieces to there, for a word seen from a border on."""
        borders = self.pieces.borders(seen[at:end].encode(), not (goes_on and end == len(seen)))
        far = len(seen[at:edge].encode())
        k = int(np.searchsorted(borders, far))
        return (borders[k] - far, k) if k < len(borders) else (-2, 0)

    def _through(self, seen: str, at: int, end: int, edge: int, goes_on: bool, ends: np.ndarray, counts: np.ndarray) -> None:
        """A word that covers the whole chunk. Sequences of pieces from two borders are one from the first border they share."""
        word, ended, far = seen[at:end].encode(), not (goes_on and end == len(seen)), len(seen[at:edge].encode())
        known: dict[int, tuple[int, int]] = {}  # border -> distance at the end, pieces to there
        near = 64 * self.pieces.longest
        for o in range(min(len(ends), far + 1)):
            found = None
            if known and len(word) > o + near:
                some = [o + b for b in self.pieces.borders(word[o : o + near], False)]
                found = next(((known[b][0], known[b][1] + k) for k, b in enumerate(some) if b in known), None)
            if found is None:
                all_ = [o + b for b in self.pieces.borders(word[o:], ended)]
                k = int(np.searchsorted(all_, far))
                if k == len(all_):
                    ends[o] = -2
                    continue
                for i, b in enumerate(all_[: k + 1]):
                    known.setdefault(b, (all_[k] - far, k - i))
                found = known[o]
            ends[o], counts[o] = found
        for o in range(far + 1, min(len(ends), len(word) + 1)):  # the piece reaches beyond the chunk
            ends[o] = o - far


def compose(maps) -> tuple[np.ndarray, np.ndarray]:
    """The map of consecutive chunks in order: (ends, counts) of each."""
    ends = counts = None
    for e, c in maps:
        e, c = np.asarray(e, np.int64), np.asarray(c, np.int64)
        if ends is None:
            ends, counts = e, c
            continue
        at = np.maximum(ends, 0)
        counts = np.where(ends >= 0, counts + c[at], counts)
        ends = np.where(ends >= 0, e[at], ends)
    return ends, counts


#: One machine for each file in a Python worker, and the tables of its characters on the driver.
_MACHINES: dict[str, Machine] = {}
_CHARACTERS: dict[str, dict] = {}


def _machine(path: str, characters) -> Machine:
    if path not in _MACHINES:
        _MACHINES[path] = Machine(path, characters.value)
    return _MACHINES[path]


def _counted(docs: DataFrame, text: str, path: str, characters) -> DataFrame:
    """Adds n_tokens to docs."""

    def f(batches):
        machine = _machine(path, characters)
        for batch in batches:
            column, at = string_column(batch, text), 0
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
            counts = []
            while at < len(column):
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 19, side="right")))
                counts.append(machine.count(column.slice(at, to - at).to_pylist()))
                at = to
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != text), pa.array(n, pa.int64())], [*(name for name in batch.schema.names if name != text), "n_tokens"])

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.mapInArrow(f, StructType([*(x for x in docs.schema.fields if x.name != text), StructField("n_tokens", LongType())]))


def _giants(rows: DataFrame, path: str, characters, limit: int, ahead: int) -> DataFrame:
    """rows(row_, text) -> row_, n_tokens, by maps of chunks; null where a stretch did not settle."""
    spark = rows.sparkSession

    def cut(batches):
        machine = _machine(path, characters)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), string_column(batch, "text"), strict=True):
                s, special = machine.normal(text.as_py())
                for part, (seen, at, size) in enumerate(machine.cuts(s, limit, ahead)):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([part], pa.int64()), pa.array([seen], pa.string()), pa.array([at]), pa.array([size]), pa.array([0 if part else special])], ["row_", "part", "seen", "at", "size", "special"])

    def mapped(batches):
        machine = _machine(path, characters)
        for batch in batches:
            for r in batch.to_pylist():
                ends, counts = machine.state_map(r["seen"], r["at"], r["size"], ahead)
                yield pa.RecordBatch.from_arrays([pa.array([r["row_"]]), pa.array([r["part"]]), pa.array([ends.tolist()]), pa.array([(counts + r["special"]).tolist()])], ["row_", "part", "ends", "counts"])

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        ends, counts = compose(zip(pdf["ends"], pdf["counts"], strict=True))
        return pd.DataFrame({"row_": pdf["row_"].iloc[:1], "part": [pdf["part"].iloc[0] // FAN_IN], "ends": [ends.tolist()], "counts": [counts.tolist()]})

    kinds = "row_ long, part long, ends array<long>, counts array<long>"
    dealt = rows.select("row_", "text").mapInArrow(cut, "row_ long, part long, seen string, at long, size long, special long")
    maps = stage(dealt.repartition(shuffle_partitions(spark), "row_", "part").mapInArrow(mapped, kinds), "maps")
    most = maps.agg(F.max("part")).first()[0] or 0
    while most > 0:  # one level of the tree, FAN_IN maps into one
        maps = maps.groupBy("row_", F.floor(F.col("part") / FAN_IN).alias("part_")).applyInPandas(composed, kinds)
        most //= FAN_IN
    return maps.select("row_", F.when(F.col("ends")[0] == 0, F.col("counts")[0]).alias("n_tokens"))


def count_tokens(docs: DataFrame, model: str | None = None, text: str = "text", limit: int = 2048, giant: int = GIANT, ahead: int = AHEAD) -> DataFrame:
    """All columns of docs but text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    model: path of a byte-level BPE file with word ends. Special strings in a text are one token each; none are added. Null and empty
    texts have 0 bytes and 0 tokens. Repeated rows are counted one by one. Texts of more than giant characters are numbered, staged,
    cut into chunks of about giant characters, which see ahead characters more, and counted by their maps; others, and those that do
    not settle within what chunks see, are counted where they are. Columns of the new names
    are replaced; others pass through, whatever their names. An empty table gives no rows."""
    path = model or vocabulary_path(MODEL)
    if path not in _CHARACTERS:
        _CHARACTERS[path] = compile_characters(path)
    characters = docs.sparkSession.sparkContext.broadcast(_CHARACTERS[path])
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    rest, (row,) = [c for c in docs.columns if c != text], unused(docs, "row_")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    long = F.coalesce(F.length(text) > giant, F.lit(False))
    short = _counted(docs.where(~long), text, path, characters)
    held = stage(docs.where(long).withColumn(row, F.monotonically_increasing_id()), "giants")
    found = stage(_giants(held.select(F.col(row).alias("row_"), F.col(text).alias("text")), path, characters, giant, ahead), "counts")
    slow = held.join(found.where("n_tokens IS NULL").select(F.col("row_").alias(row)), row, "left_semi")
    settled = held.drop(text).join(found.where("n_tokens IS NOT NULL").withColumnRenamed("row_", row), row)
    names = [*rest, "n_bytes", "n_tokens"]
    out = short.select(*names).unionByName(settled.select(*names)).unionByName(_counted(slow, text, path, characters).select(*names))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
