"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source's documents are shuffled (order of md5 of seed and doc_id) and may be taken twice, one whole round after the other.
A document's virtual finish time is the source's cumulative words at its end, divided by the source's target. A document that its
source is serving at virtual time 1 has a part that ends then and a part that ends later. All parts of both rounds are put in the
global order of virtual finish, and the mix is cut where the cumulative words of that order reach the total budget, the whole
words of all targets. So every source has come to its target there, to less than a word.

No source is gathered in one task: running sums are taken within short ranges of the order, over ranges within blocks of
ranges, and over blocks, all of which grow in number with the rows.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WORDS = r"[^\x20\x09-\x0D]+"
ROUNDS = 2
PER_RANGE = 2000


def word_count(text):
    """Words of a text column; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (150, 100)) -> DataFrame:
    """sizes(source, size long) -> source, source_size, weight, target: one row per source, null a source of its own.

    Sources by code point, null last, weigh as weights, repeating. They share share[0] / share[1] of all words by weight; a target
    stops at ROUNDS times its source's size, and the rest is shared anew by weight until no target is above that. A source that
    is cut off has a cap / weight below the others', so in that order one pass of running sums finds who is cut off."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").isNull(), "source")
    by = by.withColumn("place", F.row_number().over(everything) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", ROUNDS * F.col("source_size"))
    order = Window.orderBy((F.col("cap") * 60 / F.col("weight")), "place")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = (
        by.withColumn("budget", F.sum("source_size").over(whole) * share[0] / share[1])
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    cut = F.col("cap") * F.col("weights_left") <= F.col("weight") * F.col("left")
    by = by.withColumn("free_left", F.max(F.when(~cut, F.col("left"))).over(whole)).withColumn("free_weights", F.max(F.when(~cut, F.col("weights_left"))).over(whole))
    target = F.when(cut, F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("free_left") / F.col("free_weights")))
    return by.select("source", "source_size", "weight", target.alias("target"))


def carried(rows: DataFrame, group: list[str], at: str, block, amount: str) -> DataFrame:
    """Sums of amount over all ranges before each range: group, at, base. Ranges (column at) are summed up within their block (an
    expression of at that does not fall as at rises), and blocks one level higher, so that no task reads all ranges of a group."""
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, at).agg(F.sum(amount).alias("s")).withColumn("block_", block)
    inner = sums.withColumn("low", F.coalesce(F.sum("s").over(before([*group, "block_"], at)), F.lit(0)))
    outer = sums.groupBy(*group, "block_").agg(F.sum("s").alias("s"))
    outer = outer.select(*(F.col(c).alias(f"{c}_o") for c in (*group, "block_")), F.coalesce(F.sum("s").over(before(group, "block_")), F.lit(0)).alias("high"))
    on = F.col("block_") == F.col("block__o")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_o"))
    return inner.join(outer, on).select(*group, at, (F.col("low") + F.col("high")).alias("base"))


def shuffled_starts(items: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """items(source, doc_id, size, ...) -> with start: words of the source's documents before it in the shuffle order.
    Rows that tie in md5 and doc_id (repeated rows) come in order of size, then of the row's number."""
    digits = max(1, ceil(log(max(items.count() / per_range, 1), 16)))
    items = items.withColumn("range_", F.substring("shuffle", 1, digits))
    bases = carried(items, ["source"], "range_", F.substring("range_", 1, digits // 2), "size")
    within = Window.partitionBy("source", "range_").orderBy("shuffle", "doc_id", "size", "row_").rowsBetween(Window.unboundedPreceding, -1)
    return (
        items.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bases.select(F.col("source").alias("source_"), F.col("range_").alias("at_"), "base"), F.col("source").eqNullSafe(F.col("source_")) & (F.col("range_") == F.col("at_")))
        .withColumn("start", F.col("base") + F.col("own"))
        .drop("own", "base", "source_", "at_", "range_")
    )


def fair_mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (150, 100), row: str | None = None) -> DataFrame:
    """docs(doc_id, text, source) -> one row per document and round that the mix serves.

    Columns: row_, doc_id, source, size, source_size, target, round (0, 1), virtual_finish (0 to 1), taken (words served, all of
    them but for the document that a source is serving at the end), position (words of the mix before it). Documents of 0
    words are not served. Null texts have 0 words; a null source is a source; null doc_ids sort as ''; an empty table gives none.
    Documents that tie in the shuffle (repeated rows) come by size and number; those that finish at one time by source, round and
    place in it. Other columns of docs are left out, whatever their names. row names a column of unique longs that row_ is taken
    from; without it rows are numbered as they are read, and staged."""
    items, targets = mix_plan(docs, seed, weights, share, row)
    return served(items, targets)


def mix_plan(docs: DataFrame, seed: str, weights, share, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sized and ordered documents (row_, doc_id, source, size, start), and targets by source."""
    items = docs.select(
        (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row_"), "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffle"),
    )
    items = stage(items, "sizes")
    return stage(shuffled_starts(items), "starts"), stage(source_targets(items, weights, share), "targets")


def with_targets(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets by source; the staged table's size decides whether it is sent to all tasks."""
    return items.join(targets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def served(items: DataFrame, targets: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """Both rounds of the documents in parts, in the global order of virtual finish time, cut off at the budget."""
    budget = targets.agg(F.sum(F.floor("target"))).first()[0] or 0
    ranges = max(16, ROUNDS * items.count() // per_range)
    rows = with_targets(items.where("size > 0"), targets)
    rounds = rows.withColumn("round", F.explode(F.array(*map(F.lit, range(ROUNDS)))))
    began = F.col("start") + F.col("round") * F.col("source_size")
    first = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - began)).cast("long")
    finish = (began + F.col("size")) / F.col("target")
    parts = F.array(F.struct(first.alias("words"), F.least(F.lit(1.0), finish).alias("virtual_finish")), F.struct((F.col("size") - first).alias("words"), finish.alias("virtual_finish")))
    rounds = rounds.select("*", F.inline(parts)).where("words > 0")
    # Times up to 1 are dealt evenly to ranges, later ones by 2 - 1 / time, as documents may finish at any time after it.
    late = F.col("virtual_finish") > 1
    rounds = rounds.withColumn("span", F.floor(F.when(late, 2 - 1 / F.col("virtual_finish")).otherwise(F.col("virtual_finish")) * ranges))
    bases = carried(rounds, [], "span", F.floor(F.col("span") / F.lit(max(4, int(ranges**0.5)))), "words")
    within = Window.partitionBy("span").orderBy("virtual_finish", F.col("source").isNull(), "source", "round", "start", "row_").rowsBetween(Window.unboundedPreceding, -1)
    rounds = rounds.withColumn("own", F.coalesce(F.sum("words").over(within), F.lit(0))).join(bases, "span")
    rounds = rounds.withColumn("position", F.col("base") + F.col("own")).withColumn("taken", F.least(F.col("words"), F.lit(budget) - F.col("position")).cast("long"))
    return rounds.where("taken > 0").select("row_", "doc_id", "source", "size", "source_size", "target", "round", "virtual_finish", "taken", "position")


def mix_totals(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (150, 100)) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (words that the mix takes, both rounds together),
    first_position (words of the mix before its first round, null if it is not served). Every row is a document, repeated ones too."""
    items, targets = mix_plan(docs, seed, weights, share)
    took = served(items, targets).groupBy("row_").agg(F.sum("taken").alias("taken"), F.min("position").alias("first_position"))
    return with_targets(items, targets).join(took, "row_", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_position")


SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(concat('mix', coalesce(doc_id::VARCHAR, ''))) AS shuffle FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][(place % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM src),
r AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 150 / 100 - coalesce(sum(cap) OVER b, 0)::DOUBLE AS lft,
             (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS wl
      FROM w WINDOW b AS (ORDER BY (cap * 60)::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * wl <= weight * lft AS cut FROM r),
t AS (SELECT source, source_size,
             CASE WHEN cut THEN cap::DOUBLE ELSE weight * ((max(CASE WHEN NOT cut THEN lft END) OVER ()) / (max(CASE WHEN NOT cut THEN wl END) OVER ())) END AS target FROM f),
o AS (SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffle, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s),
e AS (SELECT doc_id, size, o.source, source_size, target, round, start + round * source_size AS began,
               greatest(0, least(size, floor(target)::BIGINT - start - round * source_size))::BIGINT AS taken
        FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS v(round)),
p AS (SELECT *, coalesce(sum(taken) OVER (ORDER BY least(1.0::DOUBLE, (began + size) / target), source IS NULL, source, round, began
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM e WHERE taken > 0),
d AS (SELECT doc_id, sum(taken)::BIGINT AS taken, min(position)::BIGINT AS first_position FROM p GROUP BY doc_id)
SELECT o.doc_id, o.size, t.source_size, t.target, coalesce(d.taken, 0)::BIGINT AS taken, d.first_position
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source LEFT JOIN d ON d.doc_id = o.doc_id
"""
