"""N-gram Jaccard self-join: a size-aware heavy-light join over sets of word shingles.

Sets are hashed once per text. Texts with equal sets form one class, and only classes are joined. Two classes link when
den * |A & B| >= num * |A | B|. With sizes n and m that means an overlap of at least c(n, m) shingles, so

- small sets (size up to a boundary) list all their subsets of the fixed sizes c(n, m): linked sets share one;
- large sets scan inverted lists: shingles are put in one global order, common ones last, and a set is listed under its first
  n - ceil(num n / den) + 1 shingles only: linked sets share one of them (small sets near the boundary are listed too);
- the boundary is the one of least cost: subsets listed against list entries times the length of the lists they meet.

List entries that nobody shares are dropped first. Pairs within a list then must pass size, position and odd-sketch bounds
(the Hamming distance of two odd sketches never exceeds the sets' symmetric difference), and are made only at their first
common shingle. What passes a longer sketch too is compared exactly on whole sets.
The order of shingles is a matter of speed only: any order finds every link, so the list of common shingles may be bounded.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, shuffle_partitions, stage, string_column, unstage
from .graph import connected_components
from .textnum import LOWER, U, mix, runs, windows

SKETCH, LONG_SKETCH = 512, 4096
HEAD = 16
LEADS, LONG_LIST = 4, 32


def overlap_needed(n, m, num: int, den: int):
    """Least overlap of linked sets of sizes n and m: ceil(num (n + m) / (num + den))."""
    return -((-num * (n + m)) // (num + den))


def listed(n: int, num: int, den: int) -> int:
    """Entries of a set of n shingles in the inverted lists."""
    return n - -((-num * n) // den) + 1


def subset_sizes(n: int, num: int, den: int) -> list[int]:
    """Sizes c(n, m) over all partner sizes m, without those that only equal sets reach."""
    sizes = set()
    for m in range(-((-num * n) // den), den * n // num + 1):
        c = overlap_needed(n, m, num, den)
        if c <= min(n, m) and not c == n == m:
            sizes.add(c)
    return sorted(sizes)


def largest_small(num: int, den: int) -> int:
    """Largest size whose subsets leave out two shingles at most."""
    n = 1
    while all(n + 1 - c <= 2 for c in subset_sizes(n + 1, num, den)):
        n += 1
    return n


def choose_boundary(counts: dict[int, int], list_length: float, num: int, den: int) -> int:
    """Sets up to the returned size are small. counts: sets by size; list_length: entries that an entry meets on average."""
    best, at = None, 0
    for x in range(largest_small(num, den) + 1):
        cost = 0.0
        for n, k in counts.items():
            if n and n <= x:
                cost += k * sum(comb(n, c) for c in subset_sizes(n, num, den))
            if n and n >= -((-num * (x + 1)) // den):
                cost += k * listed(n, num, den) * (1 + list_length)
        if best is None or cost < best:
            best, at = cost, x
    return at


def shingle_sets(texts, k: int):
    """The set of each text as sorted uint64 hashes."""
    starts, ends, owner = texts.words()
    got, _, of = windows(texts.hashes(starts, ends, LOWER), owner, k, True)
    cuts = texts.bounds(of)
    for d in range(texts.n):
        yield np.unique(got[cuts[d] : cuts[d + 1]])


def _sets(batch, k):
    for first, texts in runs(string_column(batch, "text")):
        for d, s in enumerate(shingle_sets(texts, k)):
            yield first + d, s


def _signatures(k):
    def f(batch):
        ids, n, d1, d2, sketches = batch.column(0), [], [], [], []
        for _, s in _sets(batch, k):
            n.append(len(s))
            d1.append(np.add.reduce(mix(s ^ U(0x1F83D9ABFB41BD6B))).astype(np.int64) if len(s) else 0)
            d2.append(np.add.reduce(mix(s ^ U(0x5BE0CD19137E2179))).astype(np.int64) if len(s) else 0)
            sketches.append(_odd(s, SKETCH))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
            ["doc_id", "n", "d1", "d2", "sketch"],
        )

    return f


def _first_shingles(k, num, den):
    """Half as many again as the listed shingles of each set and 8 more, in the order of their hashes, for counting."""

    def f(batch):
        got = [s[: 3 * listed(len(s), num, den) // 2 + 8] for _, s in _sets(batch, k) if len(s)]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], ["token"])

    return f


def _subset_keys(s: np.ndarray, num, den) -> np.ndarray:
    e = mix(s ^ U(0x6A09E667F3BCC909))
    total, keys = np.add.reduce(e), []
    for c in subset_sizes(len(s), num, den):
        if len(s) == c:
            left = np.array([total], U)
        elif len(s) - c == 1:
            left = total - e
        else:
            i, j = np.triu_indices(len(s), 1)
            left = total - e[i] - e[j]
        keys.append(mix(left + U(c)))
    return np.concatenate(keys) if keys else np.zeros(0, U)


def _entries(k, num, den, boundary, tokens, counts):
    """List entries (key, doc_id, n, pos) of all sets; pos is -1 for subset keys."""

    def f(batch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keys, rows, sizes, places = [], [], [], []

        def put(key, row, n, pos):
            keys.append(key.view(np.int64))
            rows.append(np.full(len(key), row))
            sizes.append(np.full(len(key), n))
            places.append(pos)

        tok = tokens.value
        cnt = counts.value
        for row, s in _sets(batch, k):
            n = len(s)
            if not n:
                continue
            if n <= boundary:
                key = _subset_keys(s, num, den)
                put(key, row, n, np.full(len(key), -1))
            if n >= -((-num * (boundary + 1)) // den):
                p = listed(n, num, den)
                at = np.searchsorted(tok, s)
                at[at == len(tok)] = 0
                often = np.where(tok[at] == s, cnt[at], 0) if len(tok) else np.zeros(n, np.int64)
                key = s[np.lexsort((s, often))[:p]] if often.any() else s[:p]
                put(key, row, n, np.arange(p))
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(ids[np.concatenate(rows)], pa.int64()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places).astype(np.int64))],
                ["key", "doc_id", "n", "pos"],
            )

    return f


def _whole_sets(k):
    """Whole sets, byte by byte of all shingles, as the leading bytes of sorted hashes compress; and an odd sketch long enough to tell
    near pairs from links."""

    def f(batch):
        sets, sketches = [], []
        for _, s in _sets(batch, k):
            sets.append(np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8).T).tobytes())
            sketches.append(_odd(s, LONG_SKETCH))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "sketch", "shingles"])

    return f


def _odd(s: np.ndarray, bits: int) -> np.ndarray:
    """Odd sketch: the parity of the number of shingles in each of bits slots."""
    odd = np.bincount((mix(s ^ U(0x3C6EF372FE94F82B)) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _exact(num, den):
    """Pairs whose whole sets link."""

    def unpack(raw: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()

    def f(batch):
        a, b, left, right = (batch.column(i) for i in range(4))
        links = []
        for x, y in zip(left, right, strict=True):
            x, y = unpack(x.as_py()), unpack(y.as_py())
            o = len(np.intersect1d(x, y, assume_unique=True))
            links.append(den * o >= num * (len(x) + len(y) - o))
        hit = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([a.take(pa.array(hit)), b.take(pa.array(hit))], ["a", "b"])

    return f


def _linked(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int, broadcast_rows: int) -> DataFrame:
    """Those of the staged pairs (doc_id_a, doc_id_b, n_a, n_b) whose whole sets link: a, b."""
    ids = pairs.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("doc_id")).distinct()
    if pairs.count() * 2 <= broadcast_rows:
        ids = F.broadcast(ids)
    sets = stage(arrow_map(docs.join(ids, "doc_id"), _whole_sets(k), "doc_id long, sketch array<long>, shingles binary"), "sets")
    # The entries' sketch tells small sets apart well; pairs with a larger set pass the long one first.
    large = pairs.where(F.greatest("n_a", "n_b") > SKETCH // 2)
    for x in "ab":
        large = large.join(sets.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("sketch").alias(f"sketch_{x}")), f"doc_id_{x}")
    apart = "aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    large = large.where(F.expr(f"{apart} <= n_a + n_b - 2 * {_need(num, den)}"))
    close = pairs.where(F.greatest("n_a", "n_b") <= SKETCH // 2).select("doc_id_a", "doc_id_b").unionByName(large.select("doc_id_a", "doc_id_b").distinct())
    for x in "ab":
        close = close.join(sets.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("shingles").alias(f"set_{x}")), f"doc_id_{x}")
    links = stage(arrow_map(close.select("doc_id_a", "doc_id_b", "set_a", "set_b"), _exact(num, den), "a long, b long").distinct(), "links")
    unstage(pairs, sets)
    return links


def _need(num: int, den: int) -> str:
    return f"int(ceil({num} * (n_a + n_b) / {num + den}D - 1e-9))"


def jaccard_links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, common: int = 500_000, broadcast_rows: int = 1_000_000, connect_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id long, text string) -> (signatures per row, links between classes).

    signatures: doc_id, n (set size), cls (least doc_id with the same set), cls_rows (rows of the class). A text without words,
    or null, has n = 0 and no links. links: a < b, class ids; every linked pair of classes once.
    Repeated rows are copies; where one doc_id has different texts, they count as one document that links if any of them does (of two
    such texts with equally many shingles, one counts); rows without a doc_id link with nothing.
    common bounds the list of shingles that are put last; broadcast_rows the ids sent to all tasks (beyond it a shuffle join).
    connect_only: links enough to connect all that links connect. First every entry meets its list's leading document only, or LEADS
    of them in lists of LONG_LIST entries or more: the least by as many hashes, which are the same in all lists of a group. Then
    all pairs are made whose documents these links have not connected yet."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sigs = stage(arrow_map(docs, _signatures(k), "doc_id long, n long, d1 long, d2 long, sketch array<long>"), "signatures")
    classes = sigs.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("cls"), F.count("*").alias("cls_rows"))
    known = docs.where("doc_id IS NOT NULL")

    tally = arrow_map(known, _first_shingles(k, num, den), "token long").groupBy("token").count()
    tally = stage(tally.where("count > 1"), "shingles")
    often = tally.where("count >= 16").orderBy(F.desc("count"), "token").limit(common).toPandas()
    order = np.argsort(often["token"].to_numpy(np.int64).view(U))
    tokens = spark.sparkContext.broadcast(often["token"].to_numpy(np.int64).view(U)[order])
    counts = spark.sparkContext.broadcast(often["count"].to_numpy(np.int64)[order])
    met = tally.where("count < 16").agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 1.0
    small = {r[0]: r[1] for r in sigs.where(F.col("n") <= 2 * largest_small(num, den)).groupBy("n").count().collect()}
    boundary = choose_boundary(small, float(met), num, den)

    unstage(tally)

    parts = shuffle_partitions(spark)
    entries = arrow_map(known, _entries(k, num, den, boundary, tokens, counts), "key long, doc_id long, n long, pos long").where("key IS NOT NULL").repartition(parts, "key")
    # Counted beside the entries, so that they are moved once: a count by key and a join would move them once more.
    entries = entries.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1").withColumn("long", F.col("c") >= LONG_LIST)
    lead = sigs.join(classes.withColumnRenamed("cls", "doc_id").select("doc_id", "n", "d1", "d2"), ["doc_id", "n", "d1", "d2"]).groupBy("doc_id", "n").agg(F.min_by("sketch", "d1").alias("sketch"))
    own = Window.partitionBy("doc_id", "n")
    listed_at = F.row_number().over(own.orderBy("pos", "key"))
    entries = (
        entries.join(lead, ["doc_id", "n"])
        .withColumn("place", F.when(F.col("pos") >= 0, listed_at))
        .withColumn("first_", F.min("place").over(own))
        .withColumn("head", F.collect_list(F.when(F.col("place") < F.col("first_") + HEAD, F.col("key"))).over(own.orderBy("pos", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("key", "doc_id", "n", "pos", "long", "sketch", "head")
    )
    entries = staged = stage(entries, "entries")
    apart = " + ".join(f"bit_count(sketch_a[{i}] ^ sketch_b[{i}])" for i in range(SKETCH // 64))
    near = f"""key_a = key_b AND n_a * {den} >= n_b * {num} AND n_b * {den} >= n_a * {num}
        AND (CASE WHEN pos_a < 0 THEN pos_b < 0 ELSE pos_b >= 0 AND greatest(n_a, n_b) > {boundary}
             AND least(pos_a, pos_b) + least(n_a - pos_a, n_b - pos_b) >= {_need(num, den)} END)
        AND {apart} <= n_a + n_b - 2 * {_need(num, den)}"""
    first = "(pos_a < 0 OR coalesce(try_element_at(array_intersect(head_a, head_b), 1), key_a) = key_a)"
    columns, both = ["key", "doc_id", "n", "pos", "sketch"], ["key", "doc_id", "n", "pos", "sketch", "head"]

    def side(df, names, x):
        return df.select(*(F.col(c).alias(f"{c}_{x}") for c in names))

    def pairs_of(a, b, on):
        ends = ("least({0}_a, {0}_b) {0}_a", "greatest({0}_a, {0}_b) {0}_b")
        sizes = ("if(doc_id_a < doc_id_b, n_{0}, n_{1}) n_{0}".format(*x) for x in ("ab", "ba"))
        return stage(a.join(b, F.expr(on)).selectExpr(*(e.format("doc_id") for e in ends), *sizes).distinct(), "pairs")

    if connect_only:
        entry = F.struct("doc_id", "n", "pos", "sketch")
        order = [F.struct(F.xxhash64("doc_id", F.lit(i)), "doc_id", "pos", "n") for i in range(LEADS)]
        least = [F.min_by(entry, order[0]), *(F.min_by(F.when(F.col("long"), entry), F.when(F.col("long"), o)) for o in order[1:])]
        leads = entries.groupBy("key").agg(F.array_distinct(F.array_compact(F.array(*least))).alias("leads")).select("key", F.inline("leads"))
        links = _linked(docs, pairs_of(side(leads, columns, "a"), side(entries, columns, "b"), f"{near} AND doc_id_a <> doc_id_b"), k, num, den, broadcast_rows)
        known_ = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "doc_id")
        entries = entries.join(known_, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
        pairs = pairs_of(side(entries, ["part", *both], "a"), side(entries, ["part", *both], "b"), f"part_a <> part_b AND doc_id_a < doc_id_b AND {near} AND {first}")
        links = links.unionByName(_linked(docs, pairs, k, num, den, broadcast_rows))
    else:
        links = _linked(docs, pairs_of(side(entries, both, "a"), side(entries, both, "b"), f"{near} AND doc_id_a < doc_id_b AND {first}"), k, num, den, broadcast_rows)
    unstage(staged)
    members = sigs.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("doc_id", "n", "cls", "cls_rows")
    return members, links


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "cls")


def _component_id():
    return F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "cls")).alias("component_id")


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """jaccard_components without n_links: the same components from fewer links, as large groups of near copies need not list all."""
    members, links = jaccard_links(docs, k, num, den, connect_only=True)
    return members.join(_components(links), "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), _component_id())


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs(doc_id long, text string) -> per row: doc_id, n_shingles, component_id, n_links.

    component_id is the least doc_id reachable by links, the document's own id included; n_links counts the other rows that the
    row links with. Empty and null texts have no shingles, their own id as component and no links. An empty table gives none.
    Other columns are left out, whatever their names."""
    members, links = jaccard_links(docs, k, num, den)
    comps = _components(links)
    ends = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    # A link counts once, and once more for every further row of the class at its other end.
    copied = members.where("n > 0 AND cls_rows > 1").select(F.col("cls").alias("other"), (F.col("cls_rows") - 1).alias("more")).distinct()
    far = ends.select("cls", F.lit(1).cast("long").alias("more")).unionByName(ends.join(copied, "other").select("cls", "more")).groupBy("cls").agg(F.sum("more").alias("far"))
    known = comps.join(far, "cls", "left")
    return members.join(known, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        _component_id(),
        F.when(F.col("n") == 0, F.lit(0)).otherwise(F.coalesce("far", F.lit(0)) + F.col("cls_rows") - 1).cast("long").alias("n_links"),
    )
