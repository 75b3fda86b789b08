"""Filing selection: index blocks to records (S2), paginated history (S3),
annual-report selection (P1-P3, P5), locator URLs (P4), column order (P6).

Blocks are bounded (one index page each), so exploding them is a narrow
per-row operation; paging joins are equi-joins on (cik, page name).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.filings import BLOCK_FIELDS


def index_records(df: DataFrame, block: str = "block", keep: Sequence[str] = ("cik",)) -> DataFrame:
    """One record per ``form`` entry; shorter arrays pad with ''.
    (``arrays_zip`` would pad to the longest array instead.)"""
    fields = ", ".join(f"'{f}', coalesce(get(`{block}`.`{f}`, i), '')" for f in BLOCK_FIELDS)
    # structs first, then one explode: no record carries the block's arrays
    records = F.expr(f"transform(`{block}`.form, (x, i) -> named_struct('entry_no', i, {fields}))")
    return df.select(*keep, F.inline(records))


def file_listing(submissions: DataFrame) -> DataFrame:
    """The ``files`` list of each submission as rows (cik, name)."""
    return (submissions.select("cik", F.explode("files").alias("f"))
            .select("cik", F.col("f.name").alias("name")))


def history_records(recent: DataFrame, listing: DataFrame, pages: DataFrame) -> DataFrame:
    """S3: records of the recent block, then of every listed page that has a
    name and is available (semi-join on (cik, name)); UNION ALL, no dedupe.

    ``recent``: (cik, block); ``listing``: (cik, name); ``pages``: (cik, name, block)."""
    rec = index_records(recent.select("cik", "block"), "block", ["cik"]).withColumn("page", F.lit(""))
    named = listing.where(F.col("name").isNotNull() & (F.col("name") != ""))
    avail = pages.join(named, on=["cik", "name"], how="left_semi")
    older = index_records(avail, "block", ["cik", "name"]).withColumnRenamed("name", "page")
    return rec.unionByName(older)


def fiscal_year(filing_date: Column, report_date: Column) -> Column:
    """Report year when the report date has >= 4 chars, else the filing
    year, minus one when the filing month is January-April."""
    fy_filing = F.substring(filing_date, 1, 4).cast("int")
    month = F.substring(filing_date, 6, 2).cast("int")
    fallback = F.when(month <= 4, fy_filing - 1).otherwise(fy_filing)
    return F.when(F.length(report_date) >= 4, F.substring(report_date, 1, 4).cast("int")).otherwise(fallback)


def select_annual(records: DataFrame, start_year: int, end_year: int, form: str = "10-K",
                  keep: Sequence[str] = ("cik",)) -> DataFrame:
    """Exact form match, non-empty filing date, fiscal year in the
    inclusive range; renamed columns. Duplicates per year are kept."""
    x = records.where((F.col("form") == form) & (F.col("filingDate") != ""))
    x = x.withColumn("fiscal_year", fiscal_year(F.col("filingDate"), F.col("reportDate")))
    x = x.where(F.col("fiscal_year").between(start_year, end_year))
    return x.select(*keep, F.col("accessionNumber").alias("accession"),
                    F.col("filingDate").alias("filing_date"),
                    F.col("primaryDocument").alias("primary_doc"), "fiscal_year")


def filing_locator(df: DataFrame, cik: str = "cik", accession: str = "accession",
                   primary_doc: str = "primary_doc",
                   hosts: Sequence[str] = ("https://www.sec.gov", "https://data.sec.gov")) -> DataFrame:
    """Accession without '-', CIK without leading zeros ('0' if none
    remain), and the ordered candidate URLs."""
    acc = F.regexp_replace(F.col(accession), "-", "")
    stripped = F.regexp_replace(F.col(cik), "^0+", "")
    cik_nz = F.when(stripped == "", F.lit("0")).otherwise(stripped)
    out = df.withColumn("accession_nodash", acc).withColumn("cik_nodash", cik_nz)
    for i, h in enumerate(hosts, start=1):
        out = out.withColumn(f"url_{i}", F.concat_ws("/", F.lit(h + "/Archives/edgar/data"),
                                                      cik_nz, acc, F.col(primary_doc)))
    return out


def order_columns(df: DataFrame, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Ids first, then the measures that exist."""
    return df.select(*ids, *[m for m in measures if m in df.columns])
