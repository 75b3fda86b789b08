"""CSV panels, reference seed, filing HTML and section-text scans
(S4-S7) with explicit schemas."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

_D, _S, _I = T.DoubleType(), T.StringType(), T.IntegerType()


def _fields(*pairs) -> list[T.StructField]:
    return [T.StructField(n, t, True) for n, t in pairs]


MEASURE_FIELDS = _fields(*[(m, _D) for m in C.MEASURES])
SCRAPED_SCHEMA = T.StructType(_fields(("firm", _S), ("ticker", _S), ("status", _S), ("fiscal_year", _I),
                                      ("filing_date", _S), ("accession", _S)) + MEASURE_FIELDS)
VALIDATED_SCHEMA = T.StructType(_fields(("firm", _S), ("ticker", _S), ("status", _S), ("fiscal_year", _I))
                                + MEASURE_FIELDS)
REFERENCE_SCHEMA = VALIDATED_SCHEMA


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with an explicit schema (an all-empty column stays
    DOUBLE instead of being inferred as STRING)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_reference(spark: SparkSession, path: str | None = None, scaled: bool = True) -> DataFrame:
    """The reference panel (millions), scaled to units when asked."""
    path = path or os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "reference_panel.csv")
    df = read_csv(spark, path, REFERENCE_SCHEMA)
    if scaled:
        for m in C.MEASURES:
            df = df.withColumn(m, F.col(m) * F.lit(float(C.REFERENCE_UNIT)))
    return df


def firm_dimension(spark: SparkSession, firms=C.FIRMS) -> DataFrame:
    """(firm, cik, ticker, status)."""
    return spark.createDataFrame(list(firms), "firm string, cik string, ticker string, status string")


def lexicon_table(spark: SparkSession, lexicon=C.CRISIS_TERMS) -> DataFrame:
    """(category, term) rows."""
    return spark.createDataFrame([(c, t) for c, ts in lexicon.items() for t in ts], "category string, term string")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """One row per filing document ``{ticker}_{year}.html``; malformed
    UTF-8 is replaced, as with ``errors='replace'``."""
    return html_rows(spark.read.option("wholetext", True).text(path))


def file_name() -> Column:
    """The name of the file that a row comes from, without URI escapes."""
    return F.regexp_extract(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), r"([^/]+)$", 1)


def html_rows(raw: DataFrame) -> DataFrame:
    """(ticker, fiscal_year, html) of whole-text rows, batch or stream; a name
    without a year gives NULL."""
    name = file_name()
    pattern = r"^(.+)_(\d{4})\.html?$"
    return raw.select(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).alias("ticker"),
                      F.regexp_extract(name, pattern, 2).try_cast("int").alias("fiscal_year"),
                      F.make_valid_utf8("value").alias("html"))


def read_section_texts(spark: SparkSession, root: str) -> DataFrame:
    """``{root}/{TICKER}/{year}_{section}.txt`` -> (ticker, fiscal_year,
    section, text)."""
    df = spark.read.option("wholetext", True).text(os.path.join(root, "*", "*.txt"))
    path = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    pat = r"([^/]+)/(\d{4})_(\w+)\.txt$"
    return df.select(F.regexp_extract(path, pat, 1).alias("ticker"),
                     F.regexp_extract(path, pat, 2).try_cast("int").alias("fiscal_year"),
                     F.regexp_extract(path, pat, 3).alias("section"),
                     F.make_valid_utf8("value").alias("text"))


def scaffold(spark: SparkSession, firms: DataFrame, start_year: int = C.START_YEAR,
             end_year: int = C.END_YEAR, sections=C.SECTIONS) -> DataFrame:
    """Firm x year (x section) rows, each yielding a row even with no
    document. Years and sections are small literal arrays exploded per firm
    (no join)."""
    out = firms.withColumn("fiscal_year", F.explode(F.sequence(F.lit(start_year), F.lit(end_year))))
    if sections:
        out = out.withColumn("section", F.explode(F.array(*[F.lit(s) for s in sections])))
    return out
