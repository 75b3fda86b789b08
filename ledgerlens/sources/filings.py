"""Filing-index sources (S1, S3 inputs) with explicit nested schemas.

A submission document holds a ``recent`` block of parallel arrays and a
list of older page files; a page file is a bare block. Both are read with
``multiLine`` JSON and a fixed schema, one file per company, so the scan
parallelises over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARR = T.ArrayType(T.StringType())
BLOCK_FIELDS = ["form", "filingDate", "accessionNumber", "primaryDocument", "reportDate"]
BLOCK_SCHEMA = T.StructType([T.StructField(f, _ARR, True) for f in BLOCK_FIELDS])
SUBMISSION_SCHEMA = T.StructType([
    T.StructField("cik", T.StringType(), True),
    T.StructField("filings", T.StructType([
        T.StructField("recent", BLOCK_SCHEMA, True),
        T.StructField("files", T.ArrayType(T.StructType([T.StructField("name", T.StringType(), True)])), True),
    ]), True),
])


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submission JSON files -> (cik, recent, files). The CIK is taken
    from the document when present, else from the file's name
    (``{cik}.json`` or ``CIK{cik}.json``), as ten digits."""
    df = spark.read.schema(SUBMISSION_SCHEMA).option("multiLine", True).json(path)
    name_cik = F.regexp_extract(F.input_file_name(), r"(?:^|/)(?:CIK)?(\d{1,10})\.json$", 1)
    cik = F.coalesce(F.col("cik"), F.nullif(name_cik, F.lit("")))
    return df.select(
        F.when(cik.rlike(r"^\d{1,10}$"), F.lpad(cik, 10, "0")).otherwise(cik).alias("cik"),
        F.col("filings.recent").alias("recent"),
        F.col("filings.files").alias("files"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files (bare blocks) -> (cik, name, block). A page is stored as
    ``{cik}_{page name}`` or under its own name, which holds the CIK
    (``CIK{cik}-submissions-001.json``); ``name`` is the page name that the
    listing of its company has."""
    df = spark.read.schema(BLOCK_SCHEMA).option("multiLine", True).json(path)
    file = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    name = F.regexp_replace(file, r"^\d{1,10}_", "")
    cik = F.coalesce(F.nullif(F.regexp_extract(file, r"^(\d{1,10})_", 1), F.lit("")),
                     F.nullif(F.regexp_extract(file, r"^CIK(\d{10})", 1), F.lit("")))
    return df.select(F.lpad(cik, 10, "0").alias("cik"), name.alias("name"), F.struct(*BLOCK_FIELDS).alias("block"))
