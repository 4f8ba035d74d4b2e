"""The registered queries: name -> (query, SQL or None)."""

from __future__ import annotations

QUERIES: dict = {}


def query(sql: str | None = None):
    """Register f(spark, sf_dir) under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_docs(spark, sf_dir: str):
    """documents with label: toxic -> negative, quality -> positive, other labelled rows neutral, else unlabeled."""
    from pyspark.sql import functions as F

    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality").isNotNull(), "neutral").otherwise("unlabeled")
    return d.join(l, "doc_id", "left").select("doc_id", "text", "lang", "source", label.alias("label"))


#: The same in SQL.
DOCS = """docs AS (SELECT d.doc_id, text, lang, source, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
    WHEN quality IS NOT NULL THEN 'neutral' ELSE 'unlabeled' END AS label FROM documents d LEFT JOIN labels l USING (doc_id))"""
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
