"""Line dedup over overlapping three-line windows, in DataFrame operations only.

Each run of three consecutive lines is hashed. Of every window that occurs more than once in the corpus the first occurrence,
by doc_id and line, stays; the lines that later occurrences cover are removed, overlapping windows merging into one stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unused

WINDOW = 3


def repeated_lines(docs: DataFrame) -> DataFrame:
    """docs(row_, doc_id, text) -> row_, gone: sorted 0-based numbers of the lines to remove, for rows that have any."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    part = docs.select("row_", "doc_id", lines.alias("lines"))
    wins = part.where(F.size("lines") >= WINDOW).select(
        "row_", "doc_id",
        F.posexplode(
            F.expr(
                f"transform(sequence(0, size(lines) - {WINDOW}), i -> CASE WHEN length(btrim(concat(lines[i], lines[i + 1], lines[i + 2]), ' \\t\\r\\f\\u000b')) > 0"
                " THEN struct(xxhash64(lines[i], lines[i + 1], lines[i + 2]) AS x, xxhash64(1, lines[i + 2], lines[i], lines[i + 1]) AS y) END)"
            )
        ).alias("pos", "h"),
    )
    wins = stage(wins.where("h IS NOT NULL").select("row_", "doc_id", "pos", "h.x", "h.y"), "windows")
    first = wins.groupBy("x", "y").agg(F.min(F.struct("doc_id", "row_", "pos")).alias("first"), F.count("*").alias("c")).where("c > 1").select("x", "y", "first")
    later = wins.join(first, ["x", "y"]).where("struct(doc_id, row_, pos) > first")
    return later.groupBy("row_").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr(f"sequence(pos, pos + {WINDOW - 1})"))))).alias("gone"))


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> all columns with the text without repeated lines, and n_lines, n_removed.

    The rows are numbered and staged first, so that both of their uses find the same numbers however docs came about.

    Lines are what \n separates, compared exactly; a window of blank lines only is no window, and texts of fewer than three lines
    have none. A null text stays null and has 0 lines; a text that loses all its lines becomes empty. Rows sharing a doc_id come
    in the order in which they were read; null doc_ids come first, and repeated rows lose all repeated windows but the first row's. Columns of the same names as the new ones are replaced."""
    docs = docs.drop("n_lines", "n_removed")
    row, gone, lines, flags = unused(docs, "row_", "gone", "lines_", "flags_")
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    repeated = repeated_lines(docs.select(F.col(row).alias("row_"), "doc_id", "text"))
    out = docs.join(repeated.withColumnsRenamed({"row_": row, "gone": gone}), row, "left").withColumn(lines, F.split("text", "\n", -1)).drop(row)
    out = out.withColumn(flags, F.expr(f"map_from_entries(transform({gone}, i -> struct(i, true)))"))
    kept = F.expr(f"array_join(filter({lines}, (x, i) -> NOT map_contains_key({flags}, i)), '\n')")
    return (
        out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
        .withColumn("n_lines", F.when(F.col(lines).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_removed", F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"))
        .drop(gone, lines, flags)
    )


SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i AS pos, lines[i + 1] AS a, lines[i + 2] AS b, lines[i + 3] AS c
      FROM l, unnest(range(0, greatest(len(lines) - 2, 0))) AS r(i)),
n AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w
      WHERE length(trim(a || b || c, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) > 0),
g AS (SELECT DISTINCT doc_id, pos + d AS line FROM n, (VALUES (0), (1), (2)) AS v(d) WHERE k > 1),
s AS (SELECT l.doc_id, i, lines[i + 1] AS line, g.line IS NULL AS stays
      FROM l CROSS JOIN unnest(range(0, len(lines))) AS r(i) LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = i)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS text FROM s GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
