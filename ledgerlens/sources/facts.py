"""Structured-fact JSON (S10 input): one file per (company, tag) with an
explicit nested schema, flattened with ``explode(units.USD)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = T.StructType([
    T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
    T.StructField("val", T.LongType()), T.StructField("accn", T.StringType()),
    T.StructField("fy", T.LongType()), T.StructField("fp", T.StringType()),
    T.StructField("form", T.StringType()), T.StructField("filed", T.StringType()),
    T.StructField("frame", T.StringType()),
])
FACT_FILE_SCHEMA = T.StructType([
    T.StructField("cik", T.LongType()), T.StructField("taxonomy", T.StringType()),
    T.StructField("tag", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("entityName", T.StringType()),
    T.StructField("units", T.StructType([T.StructField("USD", T.ArrayType(FACT))])),
])


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(FACT_FILE_SCHEMA).option("multiLine", True).json(path)
    return df.select("cik", "taxonomy", "tag", "entityName", F.explode("units.USD").alias("f")).select(
        "cik", "taxonomy", "tag", "entityName", "f.*")
