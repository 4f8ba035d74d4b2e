"""Repeatable samples: rows are ordered by md5 of id and seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedupe import number_rows


def shuffle_key(id_: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(id_).cast("string"), F.lit("|" + seed)))


def sample_n(df: DataFrame, id_: str, n: int, seed: str, exclude: DataFrame | None = None) -> DataFrame:
    if exclude is not None:
        df = df.join(exclude.select(id_), id_, "left_anti")
    return df.orderBy(shuffle_key(id_, seed), id_).limit(n)


def stratified_sample(df: DataFrame, id_: str, level: str, targets: dict[str, int], seed: str) -> DataFrame:
    """Up to the target number of rows per level."""
    place = F.row_number().over(Window.partitionBy(level).orderBy(shuffle_key(id_, seed), id_))
    goal = F.coalesce(*(F.when(F.col(level) == k, F.lit(n)) for k, n in targets.items()), F.lit(0))
    return df.withColumn("place_", place).where(F.col("place_") <= goal).drop("place_")


def split_half(df: DataFrame, id_: str, seed: str) -> DataFrame:
    """Adds half, 0 or 1, by a hash bit of the id."""
    return df.withColumn("half", (F.conv(F.substring(shuffle_key(id_, seed), 1, 1), 16, 10).cast("int") % 2))


def level_targets(df: DataFrame, level: str, n: int, shares: dict[str, float], least: dict[str, int]) -> dict[str, int]:
    """Rows to take of each level: its share of n, at least its minimum, at most what there is. One row a level goes to the driver."""
    there = {r[0]: r[1] for r in df.where(F.col(level).isin(list(shares))).groupBy(level).count().collect()}
    return {k: min(max(int(n * s), least.get(k, 0)), there.get(k, 0)) for k, s in shares.items()}


def stratified_cut(df: DataFrame, id_: str, level: str, n: int, shares: dict[str, float], least: dict[str, int], seed: str) -> DataFrame:
    """stratified_sample to level_targets, then cut to n rows in shuffled order."""
    some = stratified_sample(df, id_, level, level_targets(df, level, n, shares, least), seed)
    return some.orderBy(shuffle_key(id_, seed + "|cut"), id_).limit(n)


def split_exact(df: DataFrame, id_: str, seed: str) -> DataFrame:
    """Adds half: 0 for the first half of the shuffled rows (the larger one of an odd number), 1 for the rest. Places come from
    number_rows, so no task sees all rows."""
    rows = number_rows(df.withColumn("order_", F.concat(shuffle_key(id_, seed), F.lit("|"), F.col(id_).cast("string"))), "order_", "among_")
    return rows.withColumn("half", F.when(F.col("among_") < (df.count() + 1) // 2, 0).otherwise(1)).drop("order_", "among_")


def examples(df: DataFrame, id_: str, label: Column, seed: str, k: int = 3) -> DataFrame:
    """Up to k rows of each class, in shuffled order: adds class and place; rows of no class go."""
    rows = df.withColumn("class", label).where("class IS NOT NULL")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(shuffle_key(id_, seed), id_))).where(F.col("place") <= k)
