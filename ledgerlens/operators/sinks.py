"""Sinks (K1, K2) and skip-if-materialised work selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C


def write_csv(df: DataFrame, path: str) -> None:
    """K1: header CSV, overwrite (one directory of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Stage tables between flows."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def spread_by_bytes(df: DataFrame, by: str, size: str, keys: Sequence[str], file_bytes: int) -> DataFrame:
    """``df`` dealt out for a write that is partitioned by ``by``: each value's
    rows go to as many tasks as their bytes (column ``size``) fill files of
    ``file_bytes``, by a hash of ``keys``. A value that holds most rows is
    spread, small values are one file each. ``df`` is read twice: pass a
    staged table."""
    parts = df.groupBy(by).agg(F.greatest(F.ceil(F.sum(size) / file_bytes), F.lit(1)).cast("int").alias("_parts"))
    tasks = parts.agg(F.sum("_parts")).first()[0] or 1
    named = parts.withColumnRenamed(by, "_by")
    salted = df.join(named, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_salt", F.pmod(F.xxhash64(*keys), F.col("_parts")))
    return salted.repartition(int(tasks), by, "_salt").drop("_by", "_parts", "_salt")


def write_sections(df: DataFrame, path: str, mode: str = "append", file_bytes: int = 128 << 20) -> None:
    """K2: one row per (ticker, fiscal_year, section), partitioned by year, in
    files of about ``file_bytes`` of text. Adds ``n_bytes``, the bytes of each
    section, so that later runs need not read the texts back."""
    rows = stage_table(df.withColumn("n_bytes", F.octet_length("section_text")), "sections")
    out = spread_by_bytes(rows, "fiscal_year", "n_bytes", ["ticker", "section"], file_bytes)
    out.write.mode(mode).partitionBy("fiscal_year").parquet(path)


def materialised_keys(done: DataFrame, keys: Sequence[str], text: str = "section_text",
                      min_bytes: int = C.SECTION_MIN_CHARS) -> DataFrame:
    """Keys whose stored section is larger than ``min_bytes`` bytes."""
    return done.where(F.octet_length(F.col(text)) > min_bytes).select(*keys).distinct()


def pending_work(scaffold: DataFrame, done: DataFrame, keys: Sequence[str], text: str = "section_text",
                 min_bytes: int = C.SECTION_MIN_CHARS) -> DataFrame:
    """Scaffold keys still to compute (left anti join)."""
    return scaffold.join(materialised_keys(done, keys, text, min_bytes), on=list(keys), how="left_anti")


def work_status(scaffold: DataFrame, done: DataFrame, keys: Sequence[str], text: str = "section_text",
                min_bytes: int = C.SECTION_MIN_CHARS) -> DataFrame:
    """Scaffold keys with status 'cached' or 'pending'."""
    m = materialised_keys(done, keys, text, min_bytes).withColumn("_cached", F.lit(True))
    j = scaffold.join(m, on=list(keys), how="left")
    return j.select(*scaffold.columns, F.when(F.col("_cached"), "cached").otherwise("pending").alias("status"))


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result as parquet under the shared checkpoint
    folder (``spark.checkpoint.dir``) and read it back: the lineage is cut,
    and a lost executor costs a re-read of the table instead of a
    recomputation of everything upstream."""
    from ..session import scratch_path
    path = scratch_path(df.sparkSession, f"stage-{name}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
