"""Confusion matrices, reports, agreement, rank metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, classes: list[str], normalise: bool = False) -> DataFrame:
    """Counts of y_true by y_pred over known rows, a row per class; shares of the row if normalise (0 for empty rows)."""
    known = df.where(F.col("y_true").isin(classes) & F.col("y_pred").isin(classes))
    names = df.sparkSession.createDataFrame([(c,) for c in classes], "y_true string")
    got = names.join(known.groupBy("y_true").pivot("y_pred", classes).count(), "y_true", "left").na.fill(0)
    if not normalise:
        return got
    total = sum(F.col(c) for c in classes)
    return got.select("y_true", *(F.round(F.coalesce(F.col(c) / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias(c) for c in classes))


def classification_report(df: DataFrame, classes: list[str], by: list[str] | None = None) -> DataFrame:
    """Per class (and group): precision, recall, f1, support. Divisions by zero give 0."""
    by = by or []
    both = df.where(F.col("y_true").isin(classes) & F.col("y_pred").isin(classes))
    hit = (F.col("y_true") == F.col("y_pred")).cast("long")
    sides = F.array(F.struct(F.col("y_true").alias("class"), hit.alias("tp"), F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("p")))
    agg = both.select(*by, F.inline(sides)).groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    safe = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    agg = agg.withColumns({"precision": safe("tp", "predicted"), "recall": safe("tp", "support")})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return agg.select(*by, "class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and weighted averages of a report."""
    return report.agg(*(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *(F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")))


def error_pairs(df: DataFrame, k: int = 10) -> DataFrame:
    wrong = df.where("y_true <> y_pred").groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "y_true", "y_pred").limit(k)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of equal labels and Cohen's kappa of two columns."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    pairs = pairs.withColumns({"total": F.sum("n").over(w), "ra": F.sum("n").over(Window.partitionBy("a")), "cb": F.sum("n").over(Window.partitionBy("b"))})
    got = pairs.agg(F.max("total").alias("total"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("equal"))
    ra, cb = pairs.groupBy("a").agg(F.max("ra").alias("r")), pairs.groupBy("b").agg(F.max("cb").alias("c"))
    chance = ra.join(cb, F.col("a") == F.col("b")).agg(F.sum(F.col("r") * F.col("c")).alias("rc"))
    both = got.crossJoin(F.broadcast(chance))
    po, pe = F.col("equal") / F.col("total"), F.coalesce(F.col("rc"), F.lit(0)) / (F.col("total") * F.col("total"))
    return both.select("total", F.round(po, 6).alias("agreement"), F.round((po - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))


def precision_recall_at(df: DataFrame, query: str = "query_id", rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """Per query and rank: precision, recall and f1 up to it."""
    run = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    cum, total = F.sum(relevant).over(run), F.sum(relevant).over(Window.partitionBy(query))
    out = df.select(query, rank, relevant, (cum / F.col(rank)).alias("precision"), F.coalesce(cum / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("recall"))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.select(query, rank, F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def review_stats(df: DataFrame, by: str, decision: str, predicted: str, final: str) -> DataFrame:
    """Per group: total, checked, accepted, rejected, label changed."""
    return df.groupBy(by).agg(F.count("*").alias("total"), F.count(decision).alias("checked"), F.count_if(F.col(decision) == "accept").alias("accepted"), F.count_if(F.col(decision) == "reject").alias("rejected"), F.count_if(F.col(decision).isNotNull() & ~F.col(final).eqNullSafe(F.col(predicted))).alias("changed"))


def rank_summary(ranked: DataFrame, k: int = 10, query: str = "query_id") -> DataFrame:
    """precision_recall_at -> per query: precision and recall at k (at the last rank if there are fewer), peak f1 and its rank, mean
    precision and recall over all ranks."""
    at_k = lambda c: F.max_by(F.when(F.col("rank") <= k, F.col(c)), F.when(F.col("rank") <= k, F.col("rank")))
    first_peak = F.struct("f1", (-F.col("rank")).alias("r"))
    agg = ranked.groupBy(query).agg(at_k("precision").alias("p_at_k"), at_k("recall").alias("r_at_k"), F.max(first_peak).alias("peak"), F.round(F.avg("precision"), 4).alias("mean_precision"), F.round(F.avg("recall"), 4).alias("mean_recall"))
    return agg.select(query, "p_at_k", "r_at_k", F.col("peak.f1").alias("peak_f1"), (-F.col("peak.r")).alias("peak_rank"), "mean_precision", "mean_recall")


def accuracy(df: DataFrame, classes: list[str]) -> DataFrame:
    """One row: rows with known labels and the share of those that are right."""
    known = df.where(F.col("y_true").isin(classes) & F.col("y_pred").isin(classes))
    return known.agg(F.count("*").alias("support"), F.round(F.coalesce(F.try_divide(F.count_if(F.col("y_true") == F.col("y_pred")), F.count("*")), F.lit(0.0)), 6).alias("accuracy"))
