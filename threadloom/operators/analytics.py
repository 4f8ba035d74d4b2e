"""Counts, facets, timelines and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facets(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Top values of each column: facet, value, n, place; count descending, value ascending. One scan by grouping sets."""
    fields = list(sizes)
    flat = df.select(*(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("Anonymous" if c == "author" else "unknown")).alias(c) for c in fields))
    sets = flat.groupingSets([[F.col(c)] for c in fields], *fields).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"g_{c}") for c in fields))
    facet = F.coalesce(*(F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in fields))
    rows = sets.select(facet.alias("facet"), F.coalesce(*fields).alias("value"), "n")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value")))
    limit = F.coalesce(*(F.when(F.col("facet") == c, F.lit(n)) for c, n in sizes.items()))
    # The largest size is a constant, so tasks drop all values beyond it before they meet.
    return rows.where(F.col("place") <= max(sizes.values())).where(F.col("place") <= limit)


def cross_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def top_counts(df: DataFrame, column: str, k: int, name: str = "n") -> DataFrame:
    """Most common values, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column).limit(k)


def top_values(df: DataFrame, fields: dict[str, Column], k: int) -> DataFrame:
    """facet, value, n, place: the k commonest values of each array column, ties by value. One scan; the values of a row are counted
    before the shuffle."""

    def named(name: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    pairs = F.flatten(F.array(*(named(name, values) for name, values in fields.items())))
    got = df.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))
    return got.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(F.col("place") <= k)


def timeline(df: DataFrame, when: Column) -> DataFrame:
    return df.select(when.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), digits)


def sentiment_trend(df: DataFrame, when: Column, label: str) -> DataFrame:
    """Per bucket: positive, negative, neutral (also where the label is missing), total and percentages."""
    rows = df.select(when.alias("bucket"), F.coalesce(F.col(label), F.lit("neutral")).alias("l")).where("bucket IS NOT NULL")
    agg = rows.groupBy("bucket").agg(*(F.count_if(F.col("l") == x).alias(x) for x in ("positive", "negative", "neutral")), F.count("*").alias("total"))
    return agg.select("*", *(percent(F.col(x), F.col("total")).alias(f"{x}_pct") for x in ("positive", "negative", "neutral")))


def tool_comparison(df: DataFrame, id_: str, tools: str, label: str, aliases: dict[str, str]) -> DataFrame:
    """Per tool: documents (rows, each id one row) with any of its aliases, counts and percentages by label. One row per tool with
    documents. Aliases are constants that are looked up within the row, so one shuffle of counts is left."""
    tool = F.create_map(*(F.lit(x) for kv in sorted(aliases.items()) for x in kv))
    named = F.array_distinct(F.transform(F.array_intersect(F.col(tools), F.array(*map(F.lit, sorted(aliases)))), lambda a: tool[a]))
    agg = df.select(label, F.explode(named).alias("tool")).groupBy("tool").agg(F.count("*").alias("total"), *(F.count_if(F.col(label) == x).alias(x) for x in ("positive", "negative", "neutral")))
    return agg.select("*", *(percent(F.col(x), F.col("total")).alias(f"{x}_pct") for x in ("positive", "negative", "neutral")))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value lists of columns: column_name, value (as string), n; nulls are left out. One shuffle of counts for all columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, nulls, distinct values, all exact. Long values are told apart by their sha256."""
    short = {c: F.when(F.length(F.col(c).cast("string")) > 64, F.sha2(F.col(c).cast("string"), 256)).otherwise(F.col(c).cast("string")) for c in columns}
    known = value_counts(df.select(*(v.alias(c) for c, v in short.items())), columns).groupBy("column_name").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_values"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string").join(df.agg(F.count("*").alias("rows")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return names.join(known, "column_name", "left").select("column_name", "rows", (F.col("rows") - zero("n_values")).alias("n_nulls"), zero("n_distinct").alias("n_distinct"))


#: Three standard errors of a sketch of 2^12 places, for more than a few thousand values.
SKETCH_BITS, SKETCH_ERROR = 12, 3 * 1.04 / 2**6


def profile_parts(df: DataFrame, columns: list[str], by: list[str | Column]) -> DataFrame:
    """A profile that can be kept and added to: for every part (by) and column the rows, nulls and a sketch of the distinct values.
    Parts of later days are appended; merged_profile reads any of them together."""
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
    flat = df.select(*by, F.inline(each))
    return flat.groupBy(*flat.columns[:-1]).agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("n_nulls"), F.hll_sketch_agg("value", SKETCH_BITS).alias("sketch"))


def merged_profile(parts: DataFrame) -> DataFrame:
    """profile_parts of any number of parts -> column_name, rows, n_nulls, n_distinct; the last within SKETCH_ERROR of the true number
    in nearly all cases."""
    distinct = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0))
    return parts.groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("n_nulls").alias("n_nulls"), distinct.alias("n_distinct"))


def class_distribution(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """Count and percent per class, absent classes as 0."""
    names = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    got = df.where(F.col(column).isin(classes)).groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    both = names.join(got, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))
    return both.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def step_report(df: DataFrame, reason: Column) -> DataFrame:
    """Rows by reason of removal (null reasons: kept) with their share."""
    got = df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return got.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy()), 2))


def term_cloud(terms: DataFrame, column: str, k: int = 60, lo: float = 10.0, hi: float = 50.0) -> DataFrame:
    """Top terms with counts scaled to [lo, hi]."""
    top = top_counts(terms, column, k)
    w = Window.partitionBy()
    span = F.max("n").over(w) - F.min("n").over(w)
    return top.withColumn("weight", F.round(F.when(span > 0, lo + (hi - lo) * (F.col("n") - F.min("n").over(w)) / span).otherwise(hi), 6))


def score_histogram(df: DataFrame, score: str, lo: float, hi: float, bins: int, by: list[str]) -> DataFrame:
    at = F.least(F.greatest(F.floor((F.col(score) - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("long")
    return df.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def blend_mean_max(df: DataFrame, group: str, score: str, a: float = 0.4, b: float = 0.6, least: float = 0.42) -> DataFrame:
    s = df.groupBy(group).agg((a * F.avg(score) + b * F.max(score)).alias("blend"))
    return s.select(group, F.round("blend", 6).alias("blend"), F.when(F.col("blend") >= least, "subjective").otherwise("objective").alias("label"))


def blend_mean_extreme(df: DataFrame, group: str, score: str, path: str) -> DataFrame:
    """0.6 mean + 0.4 the pole of larger magnitude (ties: the lower), labels at +-0.1, path of the strongest score."""
    s = df.groupBy(group).agg(F.avg(score).alias("m"), F.min(score).alias("lo"), F.max(score).alias("hi"), F.max_by(path, F.struct(F.abs(F.col(score)), F.col(path))).alias("path"))
    v = 0.6 * F.col("m") + 0.4 * F.when(F.abs(F.col("hi")) > F.abs(F.col("lo")), F.col("hi")).otherwise(F.col("lo"))
    return s.select(group, F.round(v, 6).alias("blend"), F.when(v > 0.1, "positive").when(v < -0.1, "negative").otherwise("neutral").alias("label"), "path")


def length_weighted_mean(df: DataFrame, group: str, score: str, size: str) -> DataFrame:
    s = df.groupBy(group).agg((F.sum(F.col(score) * F.col(size)) / F.nullif(F.sum(size), F.lit(0))).alias("v"))
    return s.select(group, (F.round("v", 6) + 0.0).alias("mean"), F.when(F.col("v") > 0.2, "positive").when(F.col("v") < -0.2, "negative").otherwise("neutral").alias("label"))


def retention(df: DataFrame, reason: Column) -> DataFrame:
    """One row on a filter step: input, removed by reason (map), output, retention in percent."""
    got = df.groupBy(reason.alias("r")).agg(F.count("*").alias("n"))
    removed = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "n")))))
    out = got.agg(F.sum("n").alias("input"), removed.alias("removed"), F.coalesce(F.sum(F.when(F.col("r").isNull(), F.col("n"))), F.lit(0)).alias("output"))
    return out.withColumn("retention", percent(F.col("output"), F.col("input"), 2))


def thread_totals(rows: DataFrame, kind: str, size: Column, author: str, day: Column) -> DataFrame:
    """One row: posts, comments, records, words, authors, first and last month, comments a post, words a comment and a record."""
    c, w = F.col(kind) == "comment", size.alias("w")
    agg = rows.select(c.alias("c"), w, F.col(author).alias("a"), F.substring(day, 1, 7).alias("m")).agg(
        F.count_if(~F.col("c")).alias("posts"), F.count_if("c").alias("comments"), F.count("*").alias("records"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"),
        F.count_distinct("a").alias("authors"), F.min("m").alias("first_month"), F.max("m").alias("last_month"), F.coalesce(F.sum(F.when(F.col("c"), F.col("w"))), F.lit(0)).alias("cw"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 2)
    return agg.select("*", ratio("comments", "posts").alias("comments_per_post"), ratio("cw", "comments").alias("words_per_comment"), ratio("words", "records").alias("words_per_record")).drop("cw")


def counts_of(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows of each of the values, 0 where there is none, beside those of values that are not listed."""
    names = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return names.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "full_outer").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def pipeline_summary(df: DataFrame, subjectivity: str, polarity: str, path: str) -> DataFrame:
    """One row on annotated records: totals by subjectivity and polarity, positives by route, share of subjective in percent."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    positive = lambda route: F.count_if((F.col(polarity) == "positive") & F.lower(path).contains(route))
    agg = df.agg(
        F.count("*").alias("total"), *(is_(subjectivity, v).alias(v.lower()) for v in ("subjective", "objective", "Irrelevant")), *(is_(polarity, v).alias(v) for v in ("positive", "negative", "neutral")),
        positive("lexicon").alias("positive_lexicon"), positive("model").alias("positive_model"),
    )
    return agg.withColumn("subjective_pct", percent(F.col("subjective"), F.col("total")))


def verdict_stats(df: DataFrame, verdict: str, opinion: str, skipped: str) -> DataFrame:
    """One row: total, classified, skipped, pending, relevant and opinionated ones and others, and those that are both."""
    yes = lambda c: F.coalesce(F.col(c) == "yes", F.lit(False))
    seen = F.col(verdict).isNotNull()
    return df.agg(
        F.count("*").alias("total"), F.count_if(seen).alias("classified"), F.count_if(~seen & F.col(skipped)).alias("skipped"), F.count_if(~seen & ~F.col(skipped)).alias("pending"),
        F.count_if(yes(verdict)).alias("relevant"), F.count_if(seen & ~yes(verdict)).alias("not_relevant"), F.count_if(seen & yes(opinion)).alias("with_opinion"),
        F.count_if(seen & ~yes(opinion)).alias("without_opinion"), F.count_if(yes(verdict) & yes(opinion)).alias("relevant_with_opinion"),
    )
