"""Shared helpers: staged tables, names, Arrow plumbing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import staged as stage
from ..sources.staging import staged_path as shared_path

__all__ = ["arrow_map", "shared_path", "shuffle_partitions", "stage", "string_column", "unstage", "unused"]


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads: all that was made of them is staged itself."""
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to differ from all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow for f(pa.RecordBatch) -> iterable of pa.RecordBatch."""

    def run(batches):
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(run, schema)


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large_string, nulls as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")
