"""Articles out of raw pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, unescape, unescape_all, word_count
from .elements import BOILERPLATE, TEXT_BLOCKS, page_blocks


def _meta(html: Column, names: str) -> Column:
    got = F.regexp_extract(html, rf"(?is)<meta[^>]+(?:name|property)=[\"'](?:{names})[\"'][^>]*?content=[\"']([^\"']*)[\"']", 1)
    return F.nullif(F.trim(unescape_all(got)), F.lit(""))


def raw_title(html: Column) -> Column:
    """What the title element holds, as it is in the page; empty without one, null for a null page."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def title(html: Column) -> Column:
    """Text of the title element; empty without one."""
    return collapse(unescape(raw_title(F.coalesce(html, F.lit("")))))


def with_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds blocks array<struct<element, text>>: the page's text by elements, in page order (elements.page_blocks), in Arrow batches. A
    null page has none."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(html))
            made = [[{"element": e, "text": t} for e, t in page_blocks(x.as_py() or "")] for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.struct([("element", pa.string()), ("text", pa.string())])))], [*batch.schema.names, "blocks"])

    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    kind = ArrayType(StructType([StructField("element", StringType()), StructField("text", StringType())]))
    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField("blocks", kind)]))


def extract_articles(pages: DataFrame, least: int = 50) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, title, author, date, text, method, excerpt, word_count. The text is that of
    headings, paragraphs, list items and table cells outside boilerplate, a line for each block, whatever they are nested in; if it
    has fewer than least characters, all text outside boilerplate, and method says which. Character references are decoded. Null
    pages give empty texts."""
    p = with_blocks(pages.select("page_id", "url", "html"))
    of = lambda wanted: F.transform(F.filter("blocks", wanted), lambda b: b["text"])
    first = F.array_join(of(lambda b: b["element"].isin(*sorted(TEXT_BLOCKS))), "\n")
    second = F.array_join(of(lambda b: b["element"] != "title"), " ")
    p = p.select("*", first.alias("first"), second.alias("second"))
    good = F.length("first") >= least
    p = p.select("page_id", "url", title(F.col("html")).alias("title"), _meta(F.col("html"), "author|article:author").alias("author"), _meta(F.col("html"), "date|article:published_time").alias("date"), F.when(good, F.col("first")).otherwise(F.col("second")).alias("text"), F.when(good, "blocks").otherwise("stripped").alias("method"))
    return p.select("*", F.substring("text", 1, 500).alias("excerpt"), word_count(F.col("text")).alias("word_count"))
