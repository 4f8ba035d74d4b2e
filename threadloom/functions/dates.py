"""Date functions over strings of several formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_month(text: Column) -> Column:
    """YYYY-MM of the first dddd-dd or else dddd/dd in the text; null without."""
    dash, slash = F.regexp_extract(text, r"(\d{4})-(\d{2})", 0), F.regexp_extract(text, r"(\d{4})/(\d{2})", 0)
    return F.coalesce(F.nullif(dash, F.lit("")), F.nullif(F.replace(slash, F.lit("/"), F.lit("-")), F.lit("")))


def tweet_date(text: Column) -> Column:
    """YYYY-MM-DD of 'Thu Feb 19 12:02:31 +0000 2026' or an ISO timestamp; other text stays."""
    at = F.coalesce(F.try_to_timestamp(F.substring(text, 5, 99), F.lit("MMM dd HH:mm:ss Z yyyy")), F.try_to_timestamp(text))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), text)


def iso_or_null(text: Column) -> Column:
    return F.try_to_timestamp(text)


def epoch_to_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")
