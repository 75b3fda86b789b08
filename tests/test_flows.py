"""End-to-end flows on the study's shipped files and a hand-made filing."""

import os

from pyspark.sql import functions as F

from conftest import REF_DATA, needs_reference
from ledgerlens.plans import flows
from ledgerlens.sources import panels

PROC = os.path.join(REF_DATA, "processed")
BODY = " ".join(["Subprime exposure and liquidity risk may rise; write-down of conduit assets."] * 15)


@needs_reference
def test_validate_and_findings_flows(spark):
    scraped = panels.read_csv(spark, os.path.join(PROC, "financials.csv"), panels.SCRAPED_SCHEMA)
    out = flows.validate(scraped, panels.read_reference(spark))
    assert out["validated"].count() == 18
    assert out["flagged"].count() == 3
    firms = panels.firm_dimension(spark)
    sc = panels.scaffold(spark, firms.select("firm", "ticker", "status"))
    texts = panels.read_section_texts(spark, os.path.join(REF_DATA, "texts"))
    comb = flows.combined_features(out["validated"], texts, sc)
    assert comb.count() == 20
    f = flows.findings(comb)
    assert f["tests"].count() == 7
    assert f["spearman"].where(F.col("label_x").isNotNull()).count() > 0
    s = flows.sentiment(texts, sc)
    assert s.count() == 40


def test_sections_from_html_staged(spark):
    html = ("<html><p>Table of contents</p><p>Item 1A. Risk Factors 5</p><p>Item 1A. Risk Factors</p>"
            f"<p>{BODY}</p><p>Item 1B. Unresolved</p><p>Item 7. Management's Discussion</p><p>{BODY}</p>"
            "<p>Item 8. Financial</p></html>")
    df = spark.createDataFrame([("ZZZ", 2007, html)], "ticker string, fiscal_year int, html string")
    secs = flows.sections_from_html(df)
    got = {r.section: r.text for r in secs.collect()}
    assert got["risk_factors"].startswith("Item 1A. Risk Factors Subprime")
    assert got["mda"].startswith("Item 7. Management's Discussion")


def test_filings_to_panel_and_csv_sink(spark):
    """Flow 1 on a hand-made index + filing: records -> annual filing ->
    HTML by accession -> line items; a filing without HTML keeps its ids
    with NULL measures (V10). Then the CSV sink round-trips the panel."""
    import tempfile

    from ledgerlens.operators import sinks
    idx = {"form": ["10-K", "10-K"], "filingDate": ["2008-02-15", "2007-02-15"],
           "accessionNumber": ["A-1", "A-2"], "primaryDocument": ["a.htm", "b.htm"],
           "reportDate": ["2007-12-31", "2006-12-31"]}
    recent = spark.createDataFrame([("0000000042", idx)],
                                   "cik string, block struct<form:array<string>, filingDate:array<string>, "
                                   "accessionNumber:array<string>, primaryDocument:array<string>, "
                                   "reportDate:array<string>>")
    listing = spark.createDataFrame([], "cik string, name string")
    pages = spark.createDataFrame([], recent.schema.add("name", "string"))
    html = ("<p>(in millions)</p><table><tr><td>Total assets</td><td>$ 1,500</td></tr>"
            "<tr><td>Total liabilities</td><td>1,400</td></tr>"
            "<tr><td>Total stockholders' equity</td><td>100</td></tr>"
            "<tr><td>Net income<br/>(25)</td></tr></table>")
    docs = spark.createDataFrame([("A-1", html)], "accession string, html string")
    firms = spark.createDataFrame([("Example Co", "0000000042", "EXC", "survived")],
                                  "firm string, cik string, ticker string, status string")
    panel = flows.filings_to_panel(recent, listing, pages.select("cik", "name", "block"), docs, firms,
                                   2005, 2008)
    rows = {r.fiscal_year: r for r in panel.collect()}
    assert set(rows) == {2006, 2007}
    r = rows[2007]
    assert r.total_assets == 1.5e9 and r.total_liabilities == 1.4e9 and r.stockholders_equity == 1e8
    assert r.net_income == -2.5e7 and r.cash_and_equivalents is None
    assert rows[2006].total_assets is None and rows[2006].accession == "A-2"
    out = tempfile.mkdtemp(prefix="ll-csv-") + "/panel"
    sinks.write_csv(panel, out)
    back = panels.read_csv(spark, out, panels.SCRAPED_SCHEMA)
    assert back.count() == 2
