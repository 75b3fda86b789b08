"""Input order (G11, J2, W7, W8): ordinals of rows as they stand in their
files, and positions that are columns.

A table of a cluster has no order of its own, but its files have: file by
name, then row by row. ``with_ordinal`` keeps that place beside each row, so
"the first match" and "in order of appearance" are aggregates over it, whatever
tasks read the rows. ``numbered`` gives sorted rows their position, without a
single task that sees them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import prefix_counts

ORDINAL = "_ordinal"


def with_ordinal(df: DataFrame, name: str = ORDINAL) -> DataFrame:
    """``df``, read from Parquet files and not shuffled since, with each row's
    place: struct<file, row>. Files go by path."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))


def first_in_order(df: DataFrame, keys: Sequence[str], ordinal: str = ORDINAL) -> DataFrame:
    """Per key (NULLs are a key) the row that comes first, with its
    ordinal; an aggregate with partial results, so a key with very many rows
    never lands in one task."""
    rest = [c for c in df.columns if c not in (*keys, ordinal)]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(ordinal)).alias("_first") if rest else None
    out = df.groupBy(*keys).agg(F.min(ordinal).alias(ordinal), *([first] if rest else []))
    return out.select(*keys, *(["_first.*"] if rest else []), ordinal)


def numbered(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with each row's position, from 0, when sorted by the
    columns ``order`` (NULLs first), which must tell all rows apart. Rows are
    range-partitioned and counted per partition."""
    line = df.select("*", F.lit(0).alias("_line"), F.struct(*[F.col(c) for c in order]).alias("_at"), F.lit(1).alias("_one"))
    return (prefix_counts(line, ["_line"], "_at", ["_one"]).withColumn(name, F.col("_below__one").cast("long"))
            .drop("_line", "_at", "_one", "_below__one", "_total__one"))


def in_order_of_appearance(df: DataFrame, keys: Sequence[str], ordinal: str = ORDINAL, name: str = "position") -> DataFrame:
    """The distinct keys with their first row's other columns, numbered in
    order of appearance."""
    return numbered(first_in_order(df, keys, ordinal), [ordinal], name).drop(ordinal)
