"""Threads: posts with comments, flat and nested."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from .dedupe import in_ranges

def flatten_threads(threads: DataFrame, min_chars: int = 11) -> DataFrame:
    """One row per post and comment with enough text; comments take title and post id from the post, the source if they lack one."""
    post = F.struct(F.col("ID").alias("id"), F.lit("post").alias("doc_type"), F.lit(0).alias("pos"), "Source", "Author", "Text", "Score", "Date")
    comments = F.transform(F.coalesce("Comments", F.array()), lambda c, i: F.struct(c["comment_id"].alias("id"), F.lit("comment").alias("doc_type"), (i + 1).alias("pos"), F.coalesce(F.nullif(c["Source"], F.lit("")), F.col("Source")).alias("Source"), c["Author"].alias("Author"), c["Text"].alias("Text"), c["Score"].alias("Score"), c["Date"].alias("Date")))
    rows = threads.select(F.col("ID").alias("post_id"), F.col("Title").alias("title"), F.explode(F.concat(F.array(post), comments)).alias("c"))
    return rows.select("post_id", "title", "c.*").where(F.length(F.trim("Text")) >= min_chars)


def nest_comments(posts: DataFrame, comments: DataFrame, post_key: str, parent_key: str, order: str) -> DataFrame:
    """Posts with comments array<struct> in order; [] without."""
    rest = [order, *(c for c in comments.columns if c not in (parent_key, order))]
    nested = comments.groupBy(F.col(parent_key).alias("parent_")).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("comments"))
    out = posts.join(nested, F.col(post_key) == F.col("parent_"), "left").drop("parent_")
    return out.withColumn("comments", F.coalesce("comments", F.array().cast(out.schema["comments"].dataType)))


def forward_fill_parent(rows: DataFrame, order: str, is_post, value: str, name: str = "parent_id", group: str | None = None) -> DataFrame:
    """The last post's value at or before each row. With group, within it. Without, by ranges of order: each range fills itself,
    and its leading rows take the last value of the ranges before it."""
    seen = F.when(is_post, F.col(value))
    if group:
        own = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.last(seen, ignorenulls=True).over(own))
    rows = in_ranges(rows, order)
    last = rows.where(is_post).groupBy("range_").agg(F.max_by(value, order).alias("v"))
    spans = rows.select("range_").distinct().join(last, "range_", "left")
    spans = spans.select("range_", F.last("v", ignorenulls=True).over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)).alias("carried_"))
    own = Window.partitionBy("range_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("own_", F.last(seen, ignorenulls=True).over(own)).join(spans, "range_").withColumn(name, F.coalesce("own_", "carried_")).drop("own_", "carried_", "range_")


def cap_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("place_", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place_") <= n).drop("place_")


def siblings(docs: DataFrame, key: str = "post_id", id_: str = "doc_id") -> DataFrame:
    """All documents with those of the same thread: (doc_id, sibling_id)."""
    other = docs.select(F.col(key), F.col(id_).alias("sibling_id"))
    return docs.select(key, id_).join(other, key).where(F.col(id_) != F.col("sibling_id"))


def thread_view(docs: DataFrame, id_: str, current, key: str = "post_id", kind: str = "doc_type", score: str = "score", size: int = 20) -> DataFrame:
    """The thread of one document: its documents by kind, then score from the highest, then id, with place, total and is_current;
    size rows at most. None for an unknown document or one without a thread."""
    own = docs.where((F.col(id_) == current) & F.col(key).isNotNull()).select(F.col(key).alias("key_")).limit(1)
    found = docs.join(own, F.col(key) == F.col("key_"), "left_semi")
    order = Window.partitionBy(key).orderBy(kind, F.desc(score), id_)
    view = found.withColumn("place", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy(key)))
    return view.where(F.col("place") <= size).withColumn("is_current", F.col(id_) == current)


def thread_views(docs: DataFrame, id_: str, key: str = "post_id", kind: str = "doc_type", score: str = "score") -> DataFrame:
    """The same order for every thread at once: place and total of each document within its thread; the flag of a current document
    is a comparison of ids. One row per document, not one per pair."""
    order = Window.partitionBy(key).orderBy(kind, F.desc(score), id_)
    return docs.where(F.col(key).isNotNull()).withColumn("place", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy(key)))


def parent_context(comments: DataFrame, posts: DataFrame, n: int = 200, short: int | None = None) -> DataFrame:
    """comments(post_id, text) with context: the first n characters of the post's text, ' | ', the comment's. With short: those of the
    post's title, and only for comments of up to short words; others stay as they are."""
    lead = F.substring("text" if short is None else "title", 1, n)
    p = posts.select(F.col("post_id"), lead.alias("context_"))
    if short is not None:
        comments = comments.join(p, "post_id", "left")
        few = (word_count(F.col("text")) <= short) & (F.coalesce("context_", F.lit("")) != "")
        return comments.withColumn("context", F.when(few, F.concat_ws(" | ", "context_", "text")).otherwise(F.col("text"))).drop("context_")
    return comments.join(p, "post_id", "left").withColumn("context", F.concat_ws(" | ", "context_", "text")).drop("context_")


def interleave(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Round-robin over groups: adds turn, 1 for each group's first row; sort by (turn, group)."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def effective_score(rows: DataFrame, key: str, parent: str, score: str, name: str = "effective") -> DataFrame:
    """A post's own score, and a comment's or its parent's if that is lower: at any threshold a comment is kept only with its post. A
    comment whose post is not there never is (null)."""
    posts = rows.where(F.col(parent).isNull()).select(F.col(key).alias("up_"), F.col(score).alias("up_score_"))
    both = rows.join(posts, F.col(parent) == F.col("up_"), "left")
    own = F.when(F.col(parent).isNull(), F.col(score)).otherwise(F.when(F.col("up_").isNotNull(), F.least(score, "up_score_")))
    return both.withColumn(name, own).drop("up_", "up_score_")


def threshold_sweep(df: DataFrame, score: str, size: str, lo: int = 10, hi: int = 40, step: int = 2, min_rows: int = 40_000, min_words: int = 100_000) -> DataFrame:
    """The highest threshold (percent, hi down to lo) whose rows with score at or above it are enough in number and words.
    One pass: rows are counted by the highest threshold that they reach, and the counts summed from the top."""
    reached = (F.least(F.floor(F.col(score) * 100 + 1e-9), F.lit(hi)) - lo) / step
    buckets = df.where(F.col(score) * 100 + 1e-9 >= lo).groupBy((F.floor(reached) * step + lo).cast("int").alias("percent")).agg(F.count("*").alias("r"), F.sum(size).alias("w"))
    w = Window.orderBy(F.desc("percent")).rowsBetween(Window.unboundedPreceding, 0)
    sums = buckets.select("percent", F.sum("r").over(w).alias("rows"), F.sum("w").over(w).alias("words"))
    return sums.where((F.col("rows") >= min_rows) & (F.col("words") >= min_words)).orderBy(F.desc("percent")).limit(1)
