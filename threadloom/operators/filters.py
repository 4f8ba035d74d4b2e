"""Predicates and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.text import URL, any_of, stop_word_language, structural_clean, tokens


def _has(text: Column, terms: list[str]) -> Column:
    return F.coalesce(text.rlike(any_of(terms)), F.lit(False)) if terms else F.lit(False)


def keyword_relevant(text: Column, strong: list[str], ai: list[str], context: list[str]) -> Column:
    """Any strong term, or an AI term together with a context term."""
    return _has(text, strong) | (_has(text, ai) & _has(text, context))


def keyword_blacklist(df: DataFrame, text: str, terms: list[str] = lexicons.JOB_TERMS) -> DataFrame:
    """Rows without any of the terms; null texts stay."""
    return df.where(~_has(F.col(text), terms))


def is_advertisement(text: Column) -> Column:
    return _has(text, lexicons.ADVERT_TERMS) | F.coalesce(text.rlike("(?i)" + URL), F.lit(False))


def is_paywalled(text: Column, least: int = 200) -> Column:
    return F.coalesce(F.length(F.trim(text)) < least, F.lit(True)) | _has(text, lexicons.PAYWALL_TERMS)


def min_length(df: DataFrame, text: str, n: int) -> DataFrame:
    return df.where(F.length(F.trim(text)) >= n)


def language_filter(df: DataFrame, lang: str = "en", column: str | None = None, text: str = "text", profiles: dict | None = None) -> DataFrame:
    """Rows of one language: by a column, or by stop words of the text; empty texts stay, undetectable ones go."""
    if column:
        return df.where(F.col(column) == lang)
    found = stop_word_language(F.col(text), profiles or lexicons.STOP_WORDS)
    return df.where((F.coalesce(F.trim(text), F.lit("")) == "") | (found == lang))


def date_range(df: DataFrame, column: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Inclusive bounds, compared as strings."""
    return optional(df, F.col(column) >= first if first else None, F.col(column) <= last if last else None)


def period(df: DataFrame, column: str, year_month: str) -> DataFrame:
    return df.where(F.col(column).startswith(year_month))


def optional(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """All conditions that are given."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def optional_equals(df: DataFrame, **conditions) -> DataFrame:
    return optional(df, *(F.col(k) == v for k, v in conditions.items() if v not in (None, "")))


def entity_filter(df: DataFrame, column: str, entity: str) -> DataFrame:
    return df.where(F.array_contains(column, entity.lower()))


def match(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows with at least one term of the query; an empty query matches all."""
    terms = sorted(set(_query_terms(query)))
    return df.where(F.arrays_overlap(tokens(F.col(text)), F.array(*map(F.lit, terms)))) if terms else df


def _query_terms(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def score_gate(df: DataFrame, min_relevance: float = 0.15, min_opinion: float = 0.05) -> DataFrame:
    return df.withColumn("is_relevant", (F.col("relevance_score") >= min_relevance) & (F.col("opinion_score") >= min_opinion))


def violations(df: DataFrame, **allowed: list) -> DataFrame:
    """Adds violation: the first column whose value is not among those allowed, null if none."""
    return df.withColumn("violation", F.coalesce(*(F.when(~F.coalesce(F.col(k).isin(v), F.lit(False)), F.lit(k)) for k, v in allowed.items())))


def domain_gate(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Adds relevance: Relevant if a token is among the terms, else Irrelevant."""
    return df.withColumn("relevance", F.when(F.arrays_overlap(tokens(F.col(text)), F.array(*map(F.lit, terms))), "Relevant").otherwise("Irrelevant"))


def subjective_only(df: DataFrame, column: str, label: str = "subjectivity") -> DataFrame:
    """Empties an array column of rows that are not subjective."""
    return df.withColumn(column, F.when(F.col(label) == "subjective", F.col(column)).otherwise(F.slice(column, 1, 0)))


def language_threads(rows: DataFrame, lang: str, post: str = "post_id", is_post: str = "is_post", text: str = "text", profiles: dict | None = None) -> DataFrame:
    """Rows of one language by thread: a post of another, or of none that can be told, takes its whole thread with it; comments go one
    by one. Empty texts stay. The language is told from the text without URLs and markup."""
    clean = structural_clean(F.coalesce(text, F.lit("")))
    found = stop_word_language(clean, profiles or lexicons.STOP_WORDS)
    rows = rows.withColumn("ours_", (F.trim(clean) == "") | F.coalesce(found == lang, F.lit(False)))
    gone = rows.where(F.col(is_post) & ~F.col("ours_")).select(F.col(post).alias("gone_")).distinct()
    return rows.where("ours_").join(gone, F.col(post) == F.col("gone_"), "left_anti").drop("ours_")


def domain_gate_threads(rows: DataFrame, terms: list[str], post: str = "post_id", is_post: str = "is_post", text: str = "text") -> DataFrame:
    """Adds relevance of the thread: that of its post, which comments inherit."""
    posts = domain_gate(rows.where(F.col(is_post)), text, terms).select(F.col(post).alias("post_"), "relevance")
    return rows.join(posts, F.col(post) == F.col("post_"), "left").drop("post_").withColumn("relevance", F.coalesce("relevance", F.lit("Irrelevant")))
