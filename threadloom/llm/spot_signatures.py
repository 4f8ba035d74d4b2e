"""Document fingerprints by spot signatures, in DataFrame operations only.

A signature is an anchor (a common function word) with the next CHAIN content words after it; content words are all words that
are no anchors. A text's fingerprint is the sorted set of its signatures, hashed. Texts of similar content share them though
their boilerplate differs. Sets are compared by Jaccard similarity, which the set lengths bound: candidates come only from
near length partitions, and an inverted list is scanned only as far as a set can still reach the threshold.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .graph import connected_components

#: Common words of English, German, Spanish and French.
ANCHORS = (
    "a an and are as at be by for from have in is it not of on or that the this to was were which with "
    "als auf aus das dem den der des die ein eine er es für ich im ist mit nicht sich sie sind und von zu "
    "con como de del el en esta la las los más no para pero por que se su un una y "
    "au aux avec ce dans du elle est et il je le les mais ne nous ou par pas pour qui sur une vous"
).split()
CHAIN = 2


def _bound(value: Column, f) -> Column:
    """f(value), with value evaluated once for all its uses in f."""
    return F.transform(F.array(value), f)[0]


def signatures(text: Column) -> Column:
    """Sorted distinct 64-bit signatures of a text column. A text with words but without a whole chain has one signature, of all
    its words; a text without words or null has none."""
    words = F.split(F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return _bound(words, _of_words)


def _of_words(words: Column) -> Column:
    anchor = lambda w: w.isin(ANCHORS)
    spots = F.filter(F.transform(words, lambda w, i: F.when(anchor(w), i)), lambda i: i.isNotNull())

    def made(r: Column) -> Column:
        # Before the j-th anchor, at word i, stand i - j content words.
        whole = F.filter(F.transform(r["s"], lambda i, j: F.struct(i.alias("i"), (i - j).alias("at"))), lambda x: x["at"] + CHAIN <= F.size(r["c"]))
        return F.transform(whole, lambda x: F.xxhash64(F.get(words, x["i"]), *(F.get(r["c"], x["at"] + d) for d in range(CHAIN))))

    found = _bound(F.struct(F.filter(words, lambda w: ~anchor(w)).alias("c"), spots.alias("s")), made)
    none = F.expr("array()").cast("array<bigint>")
    whole_text = F.when(F.array_join(words, " ") != "", F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(none)
    return _bound(found, lambda m: F.when(F.size(m) > 0, F.sort_array(F.array_distinct(m))).otherwise(whole_text))


def as_text(sigs: Column) -> Column:
    """A fingerprint as text: 16 hexadecimal digits a signature, in order."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints; of two empty ones 1, of an empty one and another 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def length_partition(n: Column, num: int = 80, den: int = 100) -> Column:
    """Number of the length partition: linked sets lie in the same one or in neighbours."""
    return F.when(n == 0, F.lit(-1)).otherwise(F.floor(F.log(n.cast("double")) / F.lit(-log(num / den)) + F.lit(1e-9))).cast("int")


def near_duplicates(prints: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """prints(doc_id, sigs array<long>) -> doc_id, group_id (least doc_id reachable by pairs with Jaccard of num / den or more).

    Equal sets are one class first. A class is listed under its n - ceil(num n / den) + 1 rarest signatures (lists that no other
    class is in are dropped); pairs come from the same or the next length partition and must pass the position bound before
    the whole sets are compared. Empty fingerprints link with nothing."""
    prints = prints.select("doc_id", "sigs", F.xxhash64("sigs").alias("x"), F.xxhash64(F.reverse("sigs"), F.lit(1)).alias("y"))
    classes = stage(prints.where("size(sigs) > 0").groupBy("x", "y").agg(F.min("doc_id").alias("cls"), F.first("sigs").alias("sigs")), "classes")
    entries = classes.select("cls", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rarity = entries.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    entries = entries.join(rarity, "sig")
    shared = entries.withColumn("back", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("df"), F.desc("sig"))))
    # Unshared signatures come first in the order, so places are counted from its end.
    listed = shared.where(f"n - back <= n - ceil({num}D * n / {den} - 1e-9)").select("sig", "cls", "n", (F.col("n") - F.col("back")).alias("pos"), length_partition(F.col("n"), num, den).alias("part"))
    listed = stage(listed, "lists")
    a, b = (listed.select(*(F.col(c).alias(f"{c}_{z}") for c in listed.columns)) for z in "ab")
    need = f"ceil({num}D * (n_a + n_b) / {num + den} - 1e-9)"
    pairs = a.join(b, F.expr(f"sig_a = sig_b AND cls_a < cls_b AND abs(part_a - part_b) <= 1 AND least(pos_a, pos_b) + least(n_a - pos_a, n_b - pos_b) >= {need}")).select("cls_a", "cls_b").distinct()
    sets = classes.select("cls", "sigs")
    both = pairs.join(sets.toDF("cls_a", "sigs_a"), "cls_a").join(sets.toDF("cls_b", "sigs_b"), "cls_b").withColumn("o", F.size(F.array_intersect("sigs_a", "sigs_b")))
    links = both.where(f"{den} * o >= {num} * (size(sigs_a) + size(sigs_b) - o)").select(F.col("cls_a").alias("u"), F.col("cls_b").alias("v"))
    comps = connected_components(links).withColumnRenamed("node", "cls")
    member = prints.join(classes.select("x", "y", "cls"), ["x", "y"], "left").join(comps, "cls", "left")
    return member.select("doc_id", F.coalesce("component", "cls", "doc_id").alias("group_id"))


def _bounds(docs: DataFrame, per_range: int, most: int = 65_536) -> list:
    """Ids that cut the table into even ranges: a range for each per_range rows, but most ranges at most (so 512 KB of bounds), which
    beyond that grow with the table. Cut by about 32 ids a range, picked by their hash; where they fall is a matter of speed only."""
    rows = docs.count()
    n = max(1, min(most, rows // per_range))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // (32 * n)))) == 0))
    ids = ids.agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    every = F.expr(f"CASE WHEN size(ids) > 0 AND {n} > 1 THEN array_distinct(transform(sequence(1, {n} - 1), i -> ids[int(bigint(i) * size(ids) div {n})])) ELSE slice(ids, 1, 0) END")
    return ids.select(every).first()[0]


def _range_of(bounds: list) -> Column:
    """Number of bounds at or below doc_id, by halving. The bounds are one constant of the plan."""
    if not bounds:
        return F.lit(0)
    constant = F.from_json(F.lit(str(bounds)), "array<bigint>")

    def step(at: Column, width: Column) -> Column:
        to = at + width
        return F.when((to <= len(bounds)) & (F.element_at(constant, F.least(to, F.lit(len(bounds)))) <= F.col("doc_id")), to).otherwise(at)

    widths = F.array(*(F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.aggregate(widths, F.lit(0), step))


def fingerprints(docs: DataFrame, per_range: int = 1500) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures,
    length_partition.

    Edited: the last floor(n_chars / 2) characters replaced by the first as many (or all) of the next document by ascending
    doc_id; after the last comes the first. Null texts count as empty; rows with equal doc_id follow each other by text, null
    doc_ids come first. A table of one row has itself as the next; an empty table gives none.

    The table is cut into ranges of doc_id, and the first row of each range also goes to the range before it, so that every row
    finds the next one in its own task and texts are moved once. Other columns are left out, whatever their names."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = docs.withColumn("range_", _range_of(_bounds(docs, per_range)))
    firsts = at.groupBy("range_").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("k"), "doc_id", "text")).alias("f"))
    firsts = stage(firsts.select("range_", "f.doc_id", "f.text"), "firsts")
    ranges = firsts.select("range_", F.coalesce(F.lag("range_").over(Window.orderBy("range_")), F.lit(-1)).alias("to"))
    last = firsts.agg(F.max("range_")).first()[0] or 0
    guests = firsts.join(ranges, "range_").select("doc_id", "text", F.when(F.col("to") < 0, F.lit(last)).otherwise(F.col("to")).alias("range_"), F.lit(True).alias("guest"))
    rows = at.withColumn("guest", F.lit(False)).select("doc_id", "text", "range_", "guest").unionByName(guests)
    rows = rows.repartition("range_").withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("range_").orderBy("guest", "doc_id", "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_sigs": F.lead("sigs").over(order)}).where("NOT guest")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), F.expr("substring(next_text, 1, int(floor(length(text) / 2)))"))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sigs", "next_sigs", signatures(F.col("edited")).alias("edited_sigs"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"), length_partition(F.size("sigs")).alias("length_partition"),
    )
