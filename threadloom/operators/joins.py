"""Label alignment, set operations, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_label(irrelevant: Column, polarity: Column, fallback: Column) -> Column:
    return F.when(irrelevant, "irrelevant").otherwise(F.coalesce(F.nullif(polarity, F.lit("")), F.nullif(fallback, F.lit("")), F.lit("unknown")))


def align_labels(pred: DataFrame, truth: DataFrame, id_: str = "id", label: str = "label", parent: str | None = None) -> DataFrame:
    """Rows on both sides: id, y_true, y_pred. With parent, a row is irrelevant on a side where its parent is."""

    def side(df: DataFrame, name: str) -> DataFrame:
        if not parent:
            return df.select(id_, F.col(label).alias(name))
        up = df.where(F.col(label) == "irrelevant").select(F.col(id_).alias("up_")).distinct()
        return df.join(up, F.col(parent) == F.col("up_"), "left").select(id_, F.when(F.col("up_").isNotNull(), "irrelevant").otherwise(F.col(label)).alias(name))

    return side(truth, "y_true").join(side(pred, "y_pred"), id_)


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: key, side ('left' or 'right')."""
    left, right = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    both = left.join(right, key, "full_outer").where("l IS NULL OR r IS NULL")
    return both.select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def anti(df: DataFrame, done: DataFrame, on: str) -> DataFrame:
    return df.join(done.select(on), on, "left_anti")


def is_member(df: DataFrame, keys: DataFrame, on: str, name: str = "known") -> DataFrame:
    known = keys.select(F.col(on).alias("known_")).distinct()
    return df.join(known, F.col(on) == F.col("known_"), "left").withColumn(name, F.col("known_").isNotNull()).drop("known_")


def upsert(state: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Fields of updates win where they are not null; new keys are added."""
    fields = [c for c in state.columns if c != key]
    both = state.alias("s").join(updates.select(key, *(F.col(c).alias(f"{c}_new") for c in updates.columns if c != key)), key, "full_outer")
    return both.select(key, *(F.coalesce(f"{c}_new", c).alias(c) if f"{c}_new" in both.columns else F.col(c) for c in fields))


def with_verdict(df: DataFrame, cache: DataFrame, key: str, verdict: str) -> DataFrame:
    """Adds the cached verdict and status: relevant, dropped or pending."""
    known = cache.select(key, F.col(verdict).alias("verdict_"))
    status = F.when(F.col("verdict_").isNull(), "pending").when(F.col("verdict_") == "yes", "relevant").otherwise("dropped")
    return df.join(known, key, "left").withColumn("status", status).withColumnRenamed("verdict_", verdict)


def merge_distinct_ci(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values of both, the first spelling of each trimmed lower-case value; those of a come first."""
    rows = a.select(F.lit(0).alias("side"), column).unionByName(b.select(F.lit(1).alias("side"), column))
    return rows.where(F.trim(column) != "").groupBy(F.lower(F.trim(column)).alias("value_key")).agg(F.min(F.struct("side", column))[column].alias(column))


def add_new_keys(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Distinct trimmed keys of batch: key, is_new."""
    fresh = batch.select(F.trim(key).alias(key)).where(F.col(key) != "").distinct()
    return is_member(fresh, state, key, "old_").select(key, (~F.col("old_")).alias("is_new"))


def gate_diagnostic(pred: DataFrame, truth: DataFrame, id_: str, gate: str, label: str, values: list[str]) -> DataFrame:
    """Counts of true labels for each value of a predicted gate."""
    return pred.select(id_, gate).join(truth.select(id_, label), id_).groupBy(gate).pivot(label, values).count().na.fill(0)


def merge_url_state(urls: DataFrame, keep_order: bool = False, counts: str | None = None) -> DataFrame:
    """urls(norm, ord, original_url, method, queries array, discovered_at) -> per norm: fields of least ord, distinct queries in
    order, earliest discovered_at, and n_merged. keep_order: ord too, so that states merge again; counts: column to sum up."""
    queries = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "queries"))), lambda x: x["queries"])))
    n = F.count("*") if counts is None else F.sum(counts)
    out = [F.min_by("original_url", "ord").alias("original_url"), F.min_by("method", "ord").alias("method"), queries.alias("queries"), F.min("discovered_at").alias("discovered_at"), n.alias("n_merged")]
    return urls.groupBy("norm").agg(*([F.min("ord").alias("ord")] if keep_order else []), *out)


def align_labels_relevant(pred: DataFrame, truth: DataFrame, id_: str = "id", label: str = "label") -> DataFrame:
    """Rows on both sides whose true label is not irrelevant; nothing is inherited."""
    return align_labels(pred, truth.where(F.coalesce(F.col(label) != "irrelevant", F.lit(True))), id_, label)


def checked_updates(threads: DataFrame, updates: DataFrame, id_: str = "item_id") -> DataFrame:
    """threads(id, comment_ids array), updates(id, label, comment_labels map) -> the updates with reason: 'unknown id', 'comment without
    label' (a comment of the thread has none in the update), or null if the update can be applied."""
    known = updates.join(threads.select(F.col(id_).alias("known_"), "comment_ids"), F.col(id_) == F.col("known_"), "left")
    whole = F.forall(F.coalesce("comment_ids", F.array().cast("array<string>")), lambda c: F.coalesce(F.map_contains_key("comment_labels", c), F.lit(False)))
    return known.withColumn("reason", F.when(F.col("known_").isNull(), "unknown id").when(~whole, "comment without label")).drop("known_", "comment_ids")


def apply_checked(threads: DataFrame, updates: DataFrame, id_: str = "item_id", label: str = "label") -> DataFrame:
    """The threads with the labels of the updates that pass checked_updates; others keep theirs."""
    good = checked_updates(threads, updates, id_).where("reason IS NULL").select(F.col(id_).alias("new_"), F.col(label).alias("label_new_"))
    return threads.join(good, F.col(id_) == F.col("new_"), "left").withColumn(label, F.coalesce("label_new_", label)).drop("new_", "label_new_")


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the ids."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def record_verdicts(state: DataFrame, verdicts: DataFrame, articles: DataFrame, key: str = "article_id", at: str = "at") -> DataFrame:
    """state and verdicts(key, verdict, reason, at) -> of each key the last by at, verdicts over the state on ties; those of unknown
    articles go. A skip is a verdict 'skipped' with its reason; other verdicts have none. articles' columns are added."""
    rows = state.withColumn("side_", F.lit(0)).unionByName(verdicts.withColumn("side_", F.lit(1)))
    last = rows.groupBy(key).agg(F.max_by(F.struct("verdict", "reason", at), F.struct(at, "side_")).alias("v")).select(key, "v.*")
    return last.withColumn("reason", F.when(F.col("verdict") == "skipped", F.coalesce("reason", F.lit("no reason")))).join(articles, key)
