"""Importance resampling of documents towards a target: hashed n-gram features, log ratios per bucket, Gumbel noise, one draw.

Features are counted and looked up in batches. The n-grams of a batch (runs of words, joined by one space in a buffer of their own)
are interned in an open-addressed NumPy table: keys are xxhash64 of the bytes, equal keys are verified byte by byte, and every
different n-gram gets one slot with its bucket and its count. The occurrences keep their slot's number, so what a document needs
(the bucket's gain) is gathered through it. All steps are array operations over a batch; tables live as long as their batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage, string_column
from .textnum import LOWER, Texts, U, runs

#: Bytes of a word after lower-casing: digits, a to z, and all bytes of characters beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
#: Words whose n-grams are interned together.
BATCH_WORDS = 1 << 17
#: Longer n-grams are hashed one by one.
LONG = 256

# The primes of xxhash64.
P1, P2, P3, P4, P5 = map(U, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _lane(state, lane: np.ndarray) -> np.ndarray:
    return _rotl(state + lane * P2, 31) * P1


def xxhash64(rows: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of each row of a byte matrix."""
    n, size = rows.shape
    at, zero = 0, np.zeros(n, U)
    words = lambda a, b, kind: np.ascontiguousarray(rows[:, a:b]).view(kind)
    if size >= 32:
        v = [zero + P1 + P2, zero + P2, zero, zero - P1]
        for at in range(0, size - 31, 32):
            w = words(at, at + 32, "<u8")
            v = [_lane(s, w[:, i]) for i, s in enumerate(v)]
        at += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for s in v:
            h = (h ^ _lane(zero, s)) * P1 + P4
    else:
        h = zero + P5
    h = h + U(size)
    for at in range(at, size - 7, 8):
        h = _rotl(h ^ _lane(zero, words(at, at + 8, "<u8")[:, 0]), 27) * P1 + P4
    at = size - size % 8
    if size - at >= 4:
        h = _rotl(h ^ (words(at, at + 4, "<u4")[:, 0].astype(U) * P1), 23) * P2 + P3
        at += 4
    for i in range(at, size):
        h = _rotl(h ^ (rows[:, i].astype(U) * P5), 11) * P1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


CRC = _crc_table()


def crc32(rows: np.ndarray) -> np.ndarray:
    """crc32 of each row of a byte matrix."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for i in range(rows.shape[1]):
        crc = CRC[(crc ^ rows[:, i]) & 255] ^ (crc >> 8)
    return ~crc


def _by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions with it) of all lengths."""
    order = np.argsort(lengths, kind="stable")
    found, first = np.unique(lengths[order], return_index=True)
    for size, at, to in zip(found, first, np.append(first[1:], len(order)), strict=False):
        yield int(size), order[at:to]


class Spans:
    """Byte strings as spans of one buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.data, self.starts, self.lengths = data, starts, lengths

    def rows(self, which: np.ndarray, size: int) -> np.ndarray:
        return self.data[self.starts[which, None] + np.arange(size)]

    def each(self, which: np.ndarray, matrix, single, kind) -> np.ndarray:
        """A function of the bytes of the chosen spans: by matrices of equal length, or one by one for LONG ones."""
        out = np.zeros(len(which), kind)
        for size, at in _by_length(self.lengths[which]):
            if size > LONG:
                out[at] = [single(self.data[s : s + size].tobytes()) for s in self.starts[which[at]]]
            else:
                out[at] = matrix(self.rows(which[at], size))
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a and b, of equal lengths in pairs, have the same bytes."""
        out = np.zeros(len(a), bool)
        for size, at in _by_length(self.lengths[a]):
            if size > LONG:
                s = self.data
                out[at] = [np.array_equal(s[x : x + size], s[y : y + size]) for x, y in zip(self.starts[a[at]], self.starts[b[at]], strict=True)]
            else:
                out[at] = (self.rows(a[at], size) == self.rows(b[at], size)).all(1)
        return out


class Interned:
    """The different byte strings of a batch: slot (of every occurrence), and of every slot its bucket and its count."""

    def __init__(self, spans: Spans, buckets: int, hashes: np.ndarray | None = None):
        n = len(spans.starts)
        everything = np.arange(n)
        keys = spans.each(everything, xxhash64, xxhash.xxh64_intdigest, U) if hashes is None else hashes
        size = 1 << max(4, (2 * n).bit_length())
        table = np.full(size, -1, np.int64)
        place, owner, open_ = (keys & U(size - 1)).astype(np.int64), np.empty(n, np.int64), everything
        while len(open_):
            at = place[open_]
            free = table[at] < 0
            table[at[free]] = open_[free]  # of several that claim a place one has it
            holder = table[at]
            same = (keys[holder] == keys[open_]) & (spans.lengths[holder] == spans.lengths[open_])
            other = np.flatnonzero(same & (holder != open_))
            same[other] = spans.equal(holder[other], open_[other])
            owner[open_[same]] = holder[same]
            open_ = open_[~same]
            place[open_] = (place[open_] + 1) & (size - 1)
        first = np.flatnonzero(owner == everything)
        number = np.empty(n, np.int64)
        number[first] = np.arange(len(first))
        self.slot = number[owner]
        self.count = np.bincount(self.slot, minlength=len(first))
        self.bucket = (spans.each(first, crc32, zlib.crc32, np.uint32) % np.uint32(buckets)).astype(np.int64)


def joined_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of all words in lower case, one space after each; their starts and lengths in it, and their texts' numbers."""
    data = LOWER[texts.data]
    inside = IN_WORD[data]
    starts, ends, owner = texts.spans(inside)
    lengths = ends - starts
    out = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    at = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1].astype(np.int64)
    out[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[inside]
    return out, at, lengths, owner


def batches_of_grams(texts: Texts, n_max: int, buckets: int) -> Iterator[tuple[Interned, np.ndarray]]:
    """The n-grams of up to n_max words, BATCH_WORDS first words at a time: the interned batch, and the occurrences' texts."""
    data, starts, lengths, owner = joined_words(texts)
    for at in range(0, len(starts), BATCH_WORDS):
        to = min(at + BATCH_WORDS, len(starts))
        firsts, sizes, owners = [], [], []
        for k in range(n_max):
            first = np.arange(at, min(to, len(starts) - k))
            first = first[owner[first] == owner[first + k]]
            firsts.append(starts[first])
            sizes.append(starts[first + k] + lengths[first + k] - starts[first])
            owners.append(owner[first])
        yield Interned(Spans(data, np.concatenate(firsts), np.concatenate(sizes)), buckets), np.concatenate(owners)


def bucket_counts(docs: DataFrame, n_max: int = 2, buckets: int = 10_000) -> DataFrame:
    """docs(text) -> bucket, n: n-grams of all texts in each bucket that has any."""

    def f(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in runs(string_column(batch, "text")):
                for interned, _ in batches_of_grams(texts, n_max, buckets):
                    np.add.at(total, interned.bucket, interned.count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return docs.select("text").mapInArrow(f, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, n_max: int = 2, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln of (target's over source's share)) of every bucket, both counts with one more in each bucket."""

    def counted(docs):
        found = np.zeros(buckets, np.float64)
        for r in bucket_counts(docs, n_max, buckets).collect():  # one row a bucket
            found[r["bucket"]] = r["n"]
        return found

    s, t = counted(source), counted(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n_max: int = 2) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_features, weight: the floored mean gain of the text's n-grams, 0 without any."""
    given = docs.sparkSession.sparkContext.broadcast(gain)

    def f(batches):
        g = given.value
        for batch in batches:
            n = np.zeros((3, batch.num_rows), np.int64)
            for first, texts in runs(string_column(batch, "text")):
                mine = n[:, first : first + texts.n]
                mine[0] = np.bincount(texts.spans(IN_WORD[LOWER[texts.data]])[2], minlength=texts.n)
                for interned, owner in batches_of_grams(texts, n_max, len(g)):
                    got = g[interned.bucket][interned.slot]
                    mine[1] += np.bincount(owner, minlength=texts.n)
                    np.add.at(mine[2], owner, got)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n[0]), pa.array(n[1]), pa.array(n[2] // np.maximum(n[1], 1))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(f, "doc_id long, n_words long, n_features long, weight long")


def with_noise(weighed: DataFrame, seed: str = "7") -> DataFrame:
    """Adds score: weight and floored Gumbel noise, from the first 32 bits of sha256 of '<seed>:<doc_id>'; null without a doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def ranked(scored: DataFrame, least_words: int = 20, share: tuple[int, int] = (25, 100)) -> DataFrame:
    """Adds rank 1, 2, ... to the drawn rows, null to others. Rows are put in order by ranges and numbered within each; the ranges'
    counts are summed up before, so no task has more than its range."""
    spark = scored.sparkSession
    scored = stage(scored, "scores")
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").desc()]
    inside = scored.where(may).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    inside = stage(inside.withColumn("at_", F.monotonically_increasing_id()), "ordered")
    part, low = F.shiftright("at_", 33), F.col("at_").bitwiseAND((1 << 33) - 1)
    sizes = inside.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = sizes.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"), F.sum("n_").over(Window.partitionBy()).alias("all_"))
    place = F.col("base_") + low + 1
    drawn = inside.withColumn("part_", part).join(F.broadcast(sizes), "part_").withColumn("rank", F.when(place <= F.floor(share[0] * F.col("all_") / share[1]), place).cast("long"))
    rest = scored.where(~F.coalesce(may, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, n_max: int = 2, buckets: int = 10_000, seed: str = "7", least_words: int = 20, share: tuple[int, int] = (25, 100)) -> DataFrame:
    """docs(doc_id, text), target(text) -> per document: doc_id, n_words, n_features, weight, score, rank.

    Words are runs of ASCII digits, letters and characters beyond ASCII, A to Z lower-cased; features are all runs of 1 to n_max
    words of one text. Null and empty texts have no features and weight 0. rank numbers the drawn documents: of the N that have at
    least least_words words and an id, the floor(share * N) of highest score, ties to the smaller id; all others have null.
    Repeated rows are documents of their own (they tie, in any order); rows without an id count as source text, but have no score and
    are not drawn. An empty target or source counts as one feature in every bucket; an empty docs gives no rows. Other columns are
    left out. Only the buckets' counts come to the driver."""
    docs = docs.select("doc_id", "text")
    gain = gains(docs, target.select("text"), n_max, buckets)
    return ranked(with_noise(weigh(docs, gain, n_max), seed), least_words, share).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE b(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM b WHERE k < 8),
t AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
x AS (SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
d AS MATERIALIZED (SELECT own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT own, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d),
n AS MATERIALIZED (SELECT own, doc_id, g, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT g, hex(encode(g)) AS x FROM n GROUP BY g),
a AS MATERIALIZED (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, t),
s AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM n JOIN a USING (g) GROUP BY bucket),
k AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS gain FROM s),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM n JOIN a USING (g) JOIN k USING (bucket) WHERE own GROUP BY doc_id),
z AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
             ('0x' || sha256('7:' || d.doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN w USING (doc_id) WHERE own),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM z),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE n_words >= 20)
SELECT e.doc_id, n_words::BIGINT AS n_words, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END::BIGINT AS rank
FROM e LEFT JOIN r ON r.doc_id = e.doc_id
"""
