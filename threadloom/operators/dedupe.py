"""Keep-first, keep-last and greedy deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def dedupe_keep(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key: the first or last by order, which must be unique within a key for repeatable results.
    An aggregate of one struct, not a window, so a hot key is combined before the shuffle."""
    pick = F.min if keep == "first" else F.max
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*order, F.struct(*rest).alias("rest_")) if all(_ordered(df, c) for c in rest) else None
    if row is None:
        by = (F.min_by if keep == "first" else F.max_by)(F.struct(*df.columns), F.struct(*order))
        return df.groupBy(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys))).agg(by.alias("row_")).select("row_.*")
    return df.groupBy(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys))).agg(pick(row).alias("row_")).select(*(F.col(f"row_.{c}" if c in order else f"row_.rest_.{c}").alias(c) for c in df.columns))


def _ordered(df: DataFrame, column: str) -> bool:
    return not df.schema[column].dataType.simpleString().startswith(("map", "variant"))


def greedy_dedupe(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """The sequential rule: in order, a row is kept unless one of its keys equals that of a kept row before it.

    Rounds over the undecided rows: the first row of all its keys is kept; rows that share a key with it go. Rows whose keys
    are unique are kept in the first round. Each round is staged. Rows are numbered first and tie by number; rows without an order
    come last; null keys equal each other."""
    numbered = staged(df.withColumn("row_", F.monotonically_increasing_id()), "numbered")
    place = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("order"), F.col("row_").alias("row"))
    left, kept = staged(numbered.select("row_", place.alias("place_"), *(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)))), None
    names = [f"key_{i}" for i in range(len(keys))]
    while not left.isEmpty():
        first = left
        for k in names:
            least = left.groupBy(F.col(k).alias(f"same_{k}")).agg(F.min("place_").alias(f"least_{k}"))
            first = first.join(least, F.col(k).eqNullSafe(F.col(f"same_{k}"))).where(F.col("place_.row") == F.col(f"least_{k}.row")).select(*left.columns)
        won = staged(first)
        kept = won if kept is None else kept.unionByName(won)
        left = left.join(won.select("row_"), "row_", "left_anti")
        for k in names:
            taken = won.select(F.col(k).alias("taken_")).distinct()
            left = left.join(taken, F.col(k).eqNullSafe(F.col("taken_")), "left_anti")
        left = staged(left)
    return numbered.join(kept.select("row_"), "row_", "left_semi").drop("row_") if kept is not None else df


def in_ranges(df: DataFrame, order: str, range_: str = "range_") -> DataFrame:
    """The rows in ranges of order, staged with their range's number: as many ranges as the session shuffles to, even in rows whatever
    the type of order; nulls are in the first. Staged, so that all reads find the same ranges."""
    return staged(df.repartitionByRange(F.col(order)).withColumn(range_, F.spark_partition_id()), "ranges")


def number_rows(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """Adds 0, 1, ... in order without a global window: each range of the order counts its rows, one row a range is summed up."""
    df = in_ranges(df, order)
    ahead = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy("range_").count().select("range_", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base_"))
    place = F.row_number().over(Window.partitionBy("range_").orderBy(order))
    return df.withColumn("place_", place).join(base, "range_").withColumn(name, F.col("base_") + F.col("place_") - 1 + start).drop("range_", "base_", "place_")


def fallback_ids(df: DataFrame, id_: str, order: str, prefix: str) -> DataFrame:
    """Gives rows without an id (null or empty) prefix and their number in the whole order, from 0."""
    rows = number_rows(df, order, "number_")
    return rows.withColumn(id_, F.coalesce(F.nullif(F.col(id_), F.lit("")), F.concat(F.lit(prefix), F.col("number_").cast("string")))).drop("number_")
