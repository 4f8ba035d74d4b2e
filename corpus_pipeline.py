"""A training corpus from the documents table, in five stages. Each stage is written as Parquet and reread by the next.

All stages but the last return the columns that they are given; columns beside those of documents pass through, whatever
their names. Every row counts as a document of its own, also one without a doc_id or with that of another row. Null and empty
texts go in the first stage, as they fail its rules; an empty table gives an empty one in every stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import line_dedup, mixing, ngram_join, pieces, quality
from threadloom.llm.common import stage, unused

OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f(docs), with all columns that documents does not have under other names meanwhile."""
    other = {c: f"kept_column_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    out = f(docs.withColumnsRenamed(other)).select(*(other.get(c, c) for c in docs.columns))
    return out.withColumnsRenamed({v: k for k, v in other.items()})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; of repeated rows all or none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _apart(docs, lambda d: quality.quality_rules(d, labels).where("kept"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated stretches of lines; those of which no word is left go. Of a repeated row of
    three lines or more the first stays whole. n_chars is that of the text that is left."""
    has_word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _apart(docs, lambda d: line_dedup.dedupe_lines(d).where(has_word).withColumn("n_chars", F.length("text").cast("long")))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, staged, so that every read finds the same numbers; and that column's name."""
    (row,) = unused(docs, "row_")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least doc_id: five-word shingles, Jaccard of 0.8 or more.

    Every row counts as a document of its own: of repeated rows one stays, as do rows of one doc_id whose texts are no near copies.
    Rows without a doc_id are grouped by their texts like others and come after all ids in their group. Rows whose text has no
    word are in no group and stay."""
    rows, row = _numbered(docs)
    groups = ngram_join.jaccard_groups(rows.select(F.col(row).alias("doc_id"), "text"), k=5, num=80, den=100)
    groups = groups.select(F.col("doc_id").alias("row_number_"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col(row).alias("first_"))
    first = rows.select("doc_id", row).join(groups, F.col(row) == F.col("row_number_")).groupBy("component_id").agg(F.min(order).alias("least")).select(F.col("least.first_").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a document that it takes in both rounds is there twice, and one that it takes in part has the words
    taken only, so the words add up to the mix's budget. n_chars is that of the text that is left. Rows are told apart by number:
    one without a doc_id, or with that of another row, is there as often as it is taken itself. Rows without words are not taken."""
    rows, row = _numbered(docs)
    taken, size = unused(rows, "taken_", "size_")
    served = mixing.fair_mix(rows, row=row).groupBy("row_", "round").agg(F.sum("taken").alias(taken), F.max("size").alias(size))
    out = rows.join(served.drop("round").withColumnRenamed("row_", "row_number_"), F.col(row) == F.col("row_number_"))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col(taken) < F.col(size), F.array_join(F.slice(words, 1, F.col(taken).cast("int")), "")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with its other columns; columns named like the new ones are replaced."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing to target weights", mixing_stage),
    ("SentencePiece", sentencepiece_stage),
]

#: The classifier and the vocabulary can't be expressed in SQL; tests/llm/test_pipeline.py compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each staged in the shared folder but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, "stage")
    return docs
