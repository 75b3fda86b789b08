"""Filing selection, paging, quality rules and W1/W2/W3 edge cases."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import approx_equal
from ledgerlens.operators import features as feat
from ledgerlens.operators import filings as fil
from ledgerlens.operators import quality as qual
from ledgerlens.operators import stats as st
from ledgerlens.sources import filings as src


def _block(forms, dates, accs, docs, reps):
    return {"form": forms, "filingDate": dates, "accessionNumber": accs, "primaryDocument": docs,
            "reportDate": reps}


def test_json_index_paging_and_selection(spark):
    d = tempfile.mkdtemp(prefix="ll-idx-")
    sub = {"cik": "0000012345", "filings": {
        "recent": _block(["10-K", "10-K/A", "10-K", "10-K", "10-K"],
                         ["2008-02-01", "2008-03-01", "2007-04-30", "2007-05-01", ""],
                         ["0001-08-1", "0001-08-2", "0001-07-3", "0001-07-4", "0001-07-5"],
                         ["a.htm", "b.htm", "c.htm", "d.htm", "e.htm"],
                         ["2007-12-31", "", ""]),      # ragged: pads with ''
        "files": [{"name": "CIK0000012345-submissions-001.json"}, {"name": ""},
                  {"name": "CIK0000012345-submissions-002.json"}]}}
    os.makedirs(os.path.join(d, "subs"))
    os.makedirs(os.path.join(d, "pages"))
    with open(os.path.join(d, "subs", "CIK0000012345.json"), "w") as f:
        json.dump(sub, f, indent=2)
    with open(os.path.join(d, "pages", "CIK0000012345-submissions-001.json"), "w") as f:
        json.dump(_block(["10-K"], ["2005-03-01"], ["0001-05-9"], ["z.htm"], ["2004-12-31"]), f, indent=2)
    subs = src.read_submissions(spark, os.path.join(d, "subs"))
    pages = src.read_pages(spark, os.path.join(d, "pages")).withColumn("cik", F.lit("0000012345"))
    recs = fil.history_records(subs.select("cik", F.col("recent").alias("block")),
                               fil.file_listing(subs), pages)
    rows = recs.orderBy("page", "entry_no").collect()
    assert len(rows) == 6                                   # page 002 unavailable, '' skipped
    assert rows[2].reportDate == "" and rows[4].reportDate == ""
    sel = {r.accession: r.fiscal_year for r in fil.select_annual(recs, 2004, 2008).collect()}
    # report year; filing month 4 -> previous year; month 5 -> same year; empty date dropped; 10-K/A dropped
    assert sel == {"0001-08-1": 2007, "0001-07-3": 2006, "0001-07-4": 2007, "0001-05-9": 2004}
    loc = fil.filing_locator(fil.select_annual(recs, 2004, 2008)).where("accession = '0001-08-1'").collect()[0]
    assert loc.url_1 == "https://www.sec.gov/Archives/edgar/data/12345/0001081/a.htm"
    assert loc.url_2.startswith("https://data.sec.gov/Archives/edgar/data/12345/")
    zero = spark.createDataFrame([("0000000000", "1-2", "x.htm")], "cik string, accession string, primary_doc string")
    assert fil.filing_locator(zero).collect()[0].cik_nodash == "0"


def test_unit_jump_rules(spark):
    rows = [  # firm, year, assets, equity, net income
        ("A", 2005, 100.0, 10.0, 1.0), ("A", 2006, 10000.0, 10.0, 1.0),      # exactly 100x: no flag
        ("B", 2005, 100.0, 10.0, 1.0), ("B", 2006, None, 10.0, 1.0), ("B", 2007, 10001.0, 10.0, 1.0),  # gap
        ("C", 2005, 1e9, 10.0, 1.0), ("C", 2006, 1e6, 10.0, 1.0),             # 1000x drop: missed
        ("D", 2005, 0.0, 10.0, 1.0), ("D", 2006, 5.0, 10.0, 1.0),             # prev 0: skipped
        ("E", 2005, 1.0, 1.0, 1.0),                                          # one row
    ]
    df = spark.createDataFrame(rows, "firm string, fiscal_year int, total_assets double, "
                                     "stockholders_equity double, net_income double")
    got = {(r.firm, r.fiscal_year): r.jump_total_assets for r in qual.unit_jumps(df).collect()}
    assert not got[("A", 2005)] and not got[("A", 2006)]
    assert got[("B", 2005)] and got[("B", 2006)] and got[("B", 2007)]
    assert not any(got[k] for k in got if k[0] in "CDE")


def test_balance_off_rounds_half_to_even(spark):
    df = spark.createDataFrame([("X", 2005, 100.0, 80.0, 7.5, 1.0), ("Y", 2005, 100.0, 80.0, 8.5, 1.0)],
                               "firm string, fiscal_year int, total_assets double, total_liabilities double, "
                               "stockholders_equity double, net_income double")
    got = {r.firm: r._flags for r in qual.sanity_flags(df).collect()}
    assert got == {"X": "balance_off_12%", "Y": "balance_off_12%"}      # 12.5 -> 12, 11.5 -> 12


def test_yoy_previous_row_no_fill(spark):
    df = spark.createDataFrame([("A", 2005, 10.0), ("A", 2006, None), ("A", 2007, 20.0), ("A", 2008, 0.0),
                                ("A", 2009, 5.0)], "firm string, fiscal_year int, x double")
    got = {r.fiscal_year: r.x_yoy_pct for r in feat.yoy(df, ["x"]).collect()}
    assert got[2005] is None and got[2006] is None and got[2007] is None
    assert approx_equal(got[2008], -100.0) and got[2009] is None            # prev 0 -> missing


def test_lead_lag_directions(spark):
    df = spark.createDataFrame([("A", 2005, 1.0, 10.0), ("A", 2006, 2.0, None), ("A", 2007, 1.5, 12.0),
                                ("B", 2005, None, 1.0), ("B", 2006, None, 2.0), ("C", 2005, 1.0, 1.0)],
                               "firm string, fiscal_year int, d double, lev double")
    rows = sorted((r.firm, r.to_year, r.nlp_dir, r.fin_dir) for r in st.lead_lag(df, "d", "lev").collect())
    assert rows == [("A", 2006, "UP", "DOWN"), ("A", 2007, "DOWN", "DOWN")]


def test_compare_and_validate_zero_reference(spark):
    s = spark.createDataFrame([("A", 2005, 5.0, None), ("A", 2006, 100.0, 3.0)],
                              "firm string, fiscal_year int, total_assets double, net_income double")
    r = spark.createDataFrame([("A", 2005, 0.0, 2.0), ("A", 2006, 104.0, None), ("A", 2007, 1.0, 1.0)],
                              "firm string, fiscal_year int, total_assets double, net_income double")
    ms = ["total_assets", "net_income"]
    cells = {(c.fiscal_year, c.measure): c.result for c in qual.compare_cells(s, r, ms).collect()}
    assert cells == {(2005, "total_assets"): "MATCH", (2005, "net_income"): "MISSING",
                     (2006, "total_assets"): "MATCH", (2007, "total_assets"): "MISSING",
                     (2007, "net_income"): "MISSING"}
    v = {x.fiscal_year: x for x in qual.validated_panel(s, r, ms).collect()}
    assert v[2005].total_assets == 0.0 and v[2005]._overridden == 1 and v[2005]._filled == 1
    assert v[2006].total_assets == 100.0 and v[2006].net_income == 3.0
    assert v[2007]._filled == 2
