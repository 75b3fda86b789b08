"""Incremental section extraction as a Structured Streaming job (K2, K3).

The study re-runs extraction over a folder of filing HTML and skips any
section already written with more than 500 bytes. Here that becomes a file
stream: new HTML files are picked up per micro-batch (at most ``max_files``, so
that a backlog is worked off in batches of a known size), sections are
extracted, sections already materialised (by key, with enough bytes) are
skipped by a left-anti join against the output table, and the rest is
written, partitioned by year in files bounded by bytes.

Each batch owns a directory of the output and is entered in a ledger once it
is written. Readers and later batches see entered batches only; a batch that
comes again after a failure overwrites its own directory, and one that is
entered already does nothing. So a restarted job (or a lost executor) neither
repeats nor drops rows. Progress is kept in a checkpoint under the cluster's
shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.text import html_to_text_section
from ..operators.extract import extract_sections
from ..operators.sinks import write_sections
from ..session import checkpoint_dir
from ..sources.panels import html_rows

KEYS = ["ticker", "fiscal_year", "section"]
OUT_SCHEMA = T.StructType([
    T.StructField("section_text", T.StringType()), T.StructField("n_bytes", T.IntegerType()),
    T.StructField("section", T.StringType()), T.StructField("ticker", T.StringType()), T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("batch", T.StringType()),
])


LEDGER = T.StructType([T.StructField("batch", T.StringType()), T.StructField("n_sections", T.LongType()),
                       T.StructField("n_bytes", T.LongType())])


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What is written so far; any path that Spark reads will do."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _ledger_path(out_path: str) -> str:
    return out_path.rstrip("/") + "_ledger"


def ledger(spark: SparkSession, out_path: str) -> DataFrame:
    """The batches that are written in full: batch, n_sections, n_bytes."""
    return _table(spark, _ledger_path(out_path), LEDGER)


def read_sections(spark: SparkSession, out_path: str) -> DataFrame:
    """The sections of all entered batches."""
    return _table(spark, out_path, OUT_SCHEMA).join(ledger(spark, out_path).select("batch"), "batch", "left_semi")


def _enter(spark: SparkSession, out_path: str, batch: str, n: int, size: int) -> None:
    row = spark.createDataFrame([(batch, n, size)], LEDGER)
    row.coalesce(1).write.mode("overwrite").parquet(os.path.join(_ledger_path(out_path), f"batch={batch}"))


def process_batch(batch: DataFrame, out_path: str, sections=C.SECTIONS, batch_id: int | str | None = None,
                  file_bytes: int = 128 << 20) -> None:
    """One micro-batch: HTML -> text once -> sections -> skip materialised ->
    write -> enter. Of several files of one key the longest section is
    written. Only the byte length that is stored beside the text is read back,
    of the batch's years. Without ``batch_id`` the batch is a new one."""
    spark = batch.sparkSession
    name = uuid.uuid4().hex if batch_id is None else str(batch_id)
    if not ledger(spark, out_path).where(F.col("batch") == name).isEmpty():
        return
    docs = batch.select("ticker", "fiscal_year", html_to_text_section(F.col("html")).alias("text"))
    secs = extract_sections(docs, "text", sections, keep=["ticker", "fiscal_year"])
    secs = secs.where(F.col("section_text").isNotNull())
    secs = secs.groupBy(*KEYS).agg(F.max_by("section_text", F.struct(F.length("section_text"), "section_text"))
                                   .alias("section_text"))
    years = [r.fiscal_year for r in batch.select("fiscal_year").distinct().collect()]
    existing = read_sections(spark, out_path).where(F.col("fiscal_year").isin([y for y in years if y is not None])
                                                    | F.col("fiscal_year").isNull())
    done = existing.where(F.col("n_bytes") > C.SECTION_MIN_CHARS).select(*KEYS).distinct()
    todo = secs.join(done, KEYS, "left_anti").select("section_text", "section", "ticker", "fiscal_year")
    own = os.path.join(out_path, f"batch={name}")
    write_sections(todo, own, "overwrite", file_bytes)
    written = spark.read.schema(T.StructType([f for f in OUT_SCHEMA if f.name != "batch"])).parquet(own)
    n, size = written.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    _enter(spark, out_path, name, n, size or 0)


def html_stream(spark: SparkSession, html_dir: str, max_files: int = 10_000) -> DataFrame:
    """New ``{ticker}_{year}.html`` files as rows (ticker, fiscal_year, html),
    at most ``max_files`` a batch, oldest first."""
    return html_rows(spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", max_files).text(html_dir))


def run(spark: SparkSession, html_dir: str, out_path: str, name: str | None = None,
        available_now: bool = True, max_files: int = 10_000, file_bytes: int = 128 << 20):
    """Start (and with ``available_now`` finish) the incremental job. The
    checkpoint is named after the job (by default after its input and
    output paths), so reruns resume and different jobs never share one."""
    import hashlib
    name = name or "sections-" + hashlib.sha1(f"{html_dir}|{out_path}".encode()).hexdigest()[:16]
    ckpt = os.path.join(checkpoint_dir(spark), f"stream-{name}")
    # a batch's name holds the job's: several jobs may write to one table
    q = (html_stream(spark, html_dir, max_files).writeStream
         .foreachBatch(lambda b, i: process_batch(b, out_path, batch_id=f"{name}-{i}", file_bytes=file_bytes))
         .option("checkpointLocation", ckpt))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    handle = q.start()
    if available_now:
        handle.awaitTermination()
    return handle
