"""Line de-duplication over all documents, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import BLANKS, KEY, ascii_lower, row_key, text_or_empty


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _digest(line: Column) -> Column:
    """128 bits of a key, so that different lines do not meet at any corpus size."""
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """Drop lines found in many documents, except in the document with the largest id.

    Returns all columns of ``docs`` with ``text_col`` reassembled by position, plus
    ``n_lines`` and ``n_dropped`` (long; columns of these names are replaced).

    A line counts once for a document, and each row is a document. Keys shorter than
    ``min_chars`` are never dropped. A NULL or empty text is one empty line and
    comes back empty. A NULL id is smaller than any other; if rows share the largest
    id, all of them keep the line. An empty table gives an empty table.

    Keys are made distinct inside their row, counted with map-side combining, and
    met again by hash, so a line that a third of all documents hold reaches its reducer
    as one row per task; the join that brings the answer back can be split.
    """
    lines = F.split(text_or_empty(text_col), "\n", -1)
    keyed = docs.select(*row_key(id_col, text_col), lines.alias("lines"))
    long_enough = lambda x: F.length(line_key(x)) >= min_chars
    held = keyed.select(
        "_id",
        F.explode(
            F.array_distinct(F.transform(F.filter("lines", long_enough), _digest))
        ).alias("key"),
    )
    repeated = (
        held.groupBy(F.col("key.h").alias("h"), F.col("key.g").alias("g"))
        .agg(F.count("*").alias("n"), F.max("_id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .drop("n")
    )
    placed = (
        keyed.select(*KEY, F.posexplode("lines").alias("pos", "line"))
        .filter(long_enough(F.col("line")))
        .select(*KEY, "pos", _digest(F.col("line")).alias("key"))
        .select(*KEY, "pos", F.col("key.h").alias("h"), F.col("key.g").alias("g"))
    )
    dropped = (
        placed.join(repeated, ["h", "g"])
        .filter(F.col("_id") != F.col("keeper"))
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_set("pos")).alias("_dropped"))
    )
    columns = [c for c in docs.columns if c not in {"n_lines", "n_dropped"}]
    inner = docs.select(F.struct(*columns).alias("_row"), *row_key(id_col, text_col))
    gone, count = F.col("_dropped"), F.size("_dropped")
    # What stays are the stretches between dropped positions; -1 and the end are its borders.
    borders = F.concat(F.array(F.lit(-1)), gone, F.array(F.size("_lines")))
    stretches = F.transform(
        F.sequence(F.lit(1), count + 1),
        lambda i: F.slice(
            F.col("_lines"),
            F.get(F.col("_borders"), i - 1) + 2,
            F.get(F.col("_borders"), i) - F.get(F.col("_borders"), i - 1) - 1,
        ),
    )
    whole = text_or_empty(f"_row.{text_col}")
    joined = (
        inner.join(dropped, KEY, "left")
        .withColumn("_lines", F.when(gone.isNotNull(), F.split(whole, "\n", -1)))
        .withColumn("_borders", F.when(gone.isNotNull(), borders))
    )
    kept = F.when(gone.isNull(), whole).otherwise(F.array_join(F.flatten(stretches), "\n"))
    n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(f"_row.{c}").alias(c) for c in columns],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(count, F.lit(0)).cast("long").alias("n_dropped"),
    )
