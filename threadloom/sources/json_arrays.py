"""Files of one JSON array, read in as many tasks as they have blocks.

A file is read as text cut at every closing brace, which Spark splits at any size. What a brace means depends on whether it stands in a
string and how deep, and that on all text before it. So a first pass says of every block how it changes both: for either way of
beginning, in a string or not, how it ends and how the depth changes. These changes are put together from the first block on,
one row for each block; then a second pass knows how every block begins, and cuts out the records. A record that crosses blocks comes
in pieces, which are put together by the block where it begins."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARKS = re.compile(r'\\.|["{\[\]]', re.S)


def _walk(piece: str, inside: bool, depth: int) -> tuple[bool, int, int, int]:
    """In a string or not and how deep after a piece and its closing brace, the least depth on the way, and the place where the depth
    first went up from there (-1: nowhere). An escaped character is no mark."""
    least, rise = depth, -1
    for m in MARKS.finditer(piece):
        c = m[0]
        if c == '"':
            inside = not inside
        elif len(c) == 1 and not inside:
            if c == "]":
                depth -= 1
                if depth < least:
                    least, rise = depth, -1
            else:
                depth += 1
                if rise < 0:
                    rise = m.start()
    if not inside:
        depth -= 1
    return inside, depth, min(least, depth), rise


def _blocks(batches):
    """The rows of each block: (file, block, iterator of pieces), in the order read."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)


def _changes(batches):
    now, state, root = None, None, ""

    def row():
        (a, da, la), (b, db, lb) = state
        return pa.RecordBatch.from_pylist([{"file": now[0], "block": now[1], "root": root, "out_end": a, "out_change": da, "out_least": la, "in_end": b, "in_change": db, "in_least": lb}], schema=_CHANGES)

    for file, block, piece in _blocks(batches):
        if (file, block) != now:
            if now:
                yield row()
            now, state, root = (file, block), [(False, 0, 0), (True, 0, 0)], ""
        root = root or piece.lstrip()[:1]
        for i, (inside, depth, least) in enumerate(state):
            inside, depth, low, _ = _walk(piece, inside, depth)
            state[i] = (inside, depth, min(least, low))
    if now:
        yield row()


_CHANGES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("root", pa.string()), *((f"{x}_{y}", t) for x in ("out", "in") for y, t in (("end", pa.bool_()), ("change", pa.int64()), ("least", pa.int64())))])


def _beginnings(pdf: pd.DataFrame) -> pd.DataFrame:
    """How each block of a file begins: in a string, depth, depth of the records, and the block where the open record begins (-1: none)."""
    pdf = pdf.sort_values("block")
    inside, depth, begun, out = False, 0, -1, []
    base = 1 if next((r for r in pdf["root"] if r), "") == "[" else 0
    for r in pdf.to_dict("records"):
        out.append((r["file"], r["block"], inside, depth, base, begun))
        kind = "in" if inside else "out"
        closed = depth + r[f"{kind}_least"] <= base
        inside, depth = bool(r[f"{kind}_end"]), depth + int(r[f"{kind}_change"])
        begun = -1 if depth <= base else int(r["block"]) if begun < 0 or closed else begun
    return pd.DataFrame(out, columns=["file", "block", "inside", "depth", "base", "begun"])


def _records(known):
    """Whole records, and the pieces of those that cross blocks: file, begun (the block where the record begins), block, text."""

    def f(batches):
        now, rows = None, []

        def put(begun, text):
            rows.append({"file": now[0], "begun": begun, "block": now[1], "text": text})

        for file, block, piece in _blocks(batches):
            if (file, block) != now:
                if now and open_:
                    put(begun, "".join(open_))
                now = (file, block)
                inside, depth, base, begun = known.value[now]
                open_, begun = [], begun if depth > base else None
            if depth > base:  # within a record
                inside, depth, least, _ = _walk(piece, inside, depth)
                open_.append(piece + "}")
            else:
                inside, depth, least, rise = _walk_to(piece, inside, depth, base)
                if rise >= 0:
                    open_, begun = [piece[rise:] + "}"], now[1]
            if depth <= base and open_:
                # A record that begins and ends in this block is whole; others are pieces.
                put(-1 if begun == now[1] else begun, "".join(open_))
                open_, begun = [], None
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=_PIECES)
                rows = []
        if now and open_:
            put(begun, "".join(open_))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_PIECES)

    return f


def _walk_to(piece: str, inside: bool, depth: int, base: int) -> tuple[bool, int, int, int]:
    """_walk from outside of records; the place is that of the object that begins a record at depth base."""
    start = -1
    for m in MARKS.finditer(piece):
        c = m[0]
        if c == '"':
            inside = not inside
        elif len(c) == 1 and not inside:
            if c == "{" and depth == base and start < 0:
                start = m.start()
            depth += -1 if c == "]" else 1
    if not inside:
        depth -= 1
    return inside, depth, depth, start


_PIECES = pa.schema([("file", pa.string()), ("begun", pa.int64()), ("block", pa.int64()), ("text", pa.string())])


def read_json_objects(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The objects of files that hold one array of objects each, or one object: columns by schema. Files are read in as many tasks as
    Spark cuts them into (spark.sql.files.maxPartitionBytes), whatever stands in their strings. Elements that are no objects are left
    out; an object that can't be read gives a row of nulls, as Spark's reader does. Empty files and arrays give nothing. One row for each
    block of a file comes to the driver."""
    text = spark.read.option("lineSep", "}").text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    kinds = "file string, block long, root string, out_end boolean, out_change long, out_least long, in_end boolean, in_change long, in_least long"
    begin = pieces.mapInArrow(_changes, kinds).groupBy("file").applyInPandas(_beginnings, "file string, block long, inside boolean, depth long, base long, begun long")
    known = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["inside"], r["depth"], r["base"], r["begun"]) for r in begin.collect()})
    found = pieces.mapInArrow(_records(known), "file string, begun long, block long, text string")
    whole = found.where("begun < 0").select("text")
    crossing = found.where("begun >= 0").groupBy("file", "begun").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return whole.unionByName(crossing.select("text")).select(F.from_json("text", kind).alias("r")).select("r.*")
