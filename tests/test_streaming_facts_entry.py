"""Streaming incremental extraction, structured facts, driver contract."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import REF_DATA, SF_SMALL, needs_reference, needs_testdata

BODY = " ".join(["Credit conditions could deteriorate and losses may rise."] * 20)


def _html(title):
    return (f"<html><body><p>Item 1A. Risk Factors</p><p>{title} {BODY}</p><p>Item 1B. Staff</p>"
            f"<p>Item 7. Management's Discussion and Analysis</p><p>{BODY}</p><p>Item 8. Statements</p>"
            "</body></html>")


def test_incremental_stream_skips_materialised(spark):
    from ledgerlens.streaming import incremental as inc
    root = tempfile.mkdtemp(prefix="ll-stream-")
    src, out = os.path.join(root, "html"), os.path.join(root, "sections")
    os.makedirs(src)
    with open(os.path.join(src, "AAA_2006.html"), "w") as f:
        f.write(_html("first"))
    inc.run(spark, src, out)
    first = spark.read.parquet(out)
    assert first.count() == 2
    # a new file is picked up; the already written keys are not written again
    with open(os.path.join(src, "BBB_2007.html"), "w") as f:
        f.write(_html("second"))
    inc.run(spark, src, out)
    allr = spark.read.parquet(out)
    assert allr.count() == 4
    assert allr.groupBy("ticker", "fiscal_year", "section").count().where("count > 1").count() == 0
    # a batch re-delivering the first file skips its sections
    again = spark.createDataFrame([("AAA", 2006, _html("first"))], "ticker string, fiscal_year int, html string")
    inc.process_batch(again, out)
    assert spark.read.parquet(out).count() == 4


def _sections(spark, inc, out):
    return sorted((r.ticker, r.fiscal_year, r.section) for r in inc.read_sections(spark, out).collect())


def test_a_backlog_of_one_year_is_dealt_out_and_admitted_in_batches(spark):
    from ledgerlens.streaming import incremental as inc
    root = tempfile.mkdtemp(prefix="ll-stream-")
    src, out = os.path.join(root, "html"), os.path.join(root, "sections")
    os.makedirs(src)
    for i in range(7):
        with open(os.path.join(src, f"F{i}_2006.html"), "w") as f:
            f.write(_html(f"firm {i}"))
    inc.run(spark, src, out, max_files=4, file_bytes=3000)
    assert _sections(spark, inc, out) == sorted((f"F{i}", 2006, s) for i in range(7) for s in ("risk_factors", "mda"))
    rows = inc.ledger(spark, out).collect()
    assert len(rows) == 2 and sum(r.n_sections for r in rows) == 14
    assert sum(r.n_bytes for r in rows) == inc.read_sections(spark, out).agg(F.sum("n_bytes")).first()[0]
    # the first batch: 8 sections of some 1,200 bytes of one year, in several tasks and files
    year = os.path.join(out, f"batch={min(r.batch for r in rows)}", "fiscal_year=2006")
    assert 2 <= sum(f.endswith(".parquet") for f in os.listdir(year)) <= 4


def test_a_replayed_batch_leaves_no_double_rows(spark, monkeypatch):
    import pytest

    from ledgerlens.streaming import incremental as inc
    out = os.path.join(tempfile.mkdtemp(prefix="ll-stream-"), "sections")
    schema = "ticker string, fiscal_year int, html string"
    one = spark.createDataFrame([("AAA", 2006, _html("a")), ("BBB", None, _html("b"))], schema)
    # the job ends after the write, before the batch is entered
    enter = inc._enter
    monkeypatch.setattr(inc, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        inc.process_batch(one, out, batch_id=0)
    monkeypatch.setattr(inc, "_enter", enter)
    assert _sections(spark, inc, out) == []
    for _ in range(2):  # replayed, and delivered once more after it was entered
        inc.process_batch(one, out, batch_id=0)
        assert inc.read_sections(spark, out).count() == 4
    # another batch with a known file and a new one writes the new one only
    inc.process_batch(one.union(spark.createDataFrame([("CCC", 2006, _html("c"))], schema)).where("ticker <> 'BBB'"), out, batch_id=1)
    assert [r.n_sections for r in inc.ledger(spark, out).orderBy("batch").collect()] == [4, 2]
    # nothing new: the batch is entered, with no rows
    inc.process_batch(one.where("ticker = 'AAA'"), out, batch_id=2)
    assert inc.read_sections(spark, out).count() == 6 and inc.ledger(spark, out).count() == 3


@needs_reference
def test_structured_facts_latest_and_fallback(spark):
    from ledgerlens.operators import facts as fct
    from ledgerlens.sources.facts import read_facts
    facts = read_facts(spark, os.path.join(REF_DATA, "raw", "*.json"))
    assert facts.count() == 918
    latest = fct.latest_facts(facts)
    # one fact per (cik, tag, end), the latest filing
    assert latest.groupBy("cik", "tag", "end").count().where("count > 1").count() == 0
    out = fct.facts_by_field(latest, fct.tag_priorities(spark))
    f = {(r.cik, r.field, r.end): r.tag for r in out.collect()}
    # JPMorgan lists both ShortTermBorrowings and CommercialPaper: the first tag wins where present
    jpm = [v for (c, fld, _e), v in f.items() if c == 19617 and fld == "short_term_borrowings"]
    assert jpm and set(jpm) <= {"ShortTermBorrowings", "CommercialPaper"}
    assert "ShortTermBorrowings" in jpm


def test_facts_as_filed_with_durations_and_restatements(spark):
    import datetime as dt

    from ledgerlens.operators import facts as fct
    d = dt.date.fromisoformat
    rows = [(1, "A", "2007-10-01", "2007-12-31", 10, "a1", "2008-02-01"),   # the quarter
            (1, "A", "2007-01-01", "2007-12-31", 40, "a1", "2008-02-01"),   # the year, same end
            (1, "A", "2007-01-01", "2007-12-31", 44, "a2", "2008-08-15"),   # restated
            (1, "A", "2007-01-01", "2007-12-31", 45, "a3", "2008-08-15"),   # twice that day
            (1, "A", None, "2007-12-31", 7, "a1", "2008-02-01"), (1, "A", "2007-12-01", "2007-12-31", 3, "a1", "2008-02-01"),
            (2, "A", "2007-01-01", "2007-12-31", 99, "b1", "2009-01-01"), (2, "A", "2007-01-01", "2007-12-31", 98, "b0", None),
            (3, "A", "2007-01-01", "2007-12-31", 5, "c1", "2000-01-01")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "cik int, tag string, start string, end string, val int, accn string, filed string, _last string")
    df = df.withColumn("period", fct.period_class())
    assert {r.period for r in df.collect()} == {"quarter", "year", "instant", "other"}
    days = [(1, d(x)) for x in ("2008-01-31", "2008-02-01", "2008-08-14", "2008-08-15", "2030-01-01", "2030-01-01")] + [
        (2, d("2008-12-31")), (2, d("2009-01-31")), (2, None), (4, d("2009-01-01"))]
    got = fct.as_filed(df.drop("_last"), spark.createDataFrame(days, "cik int, as_of date"))
    year = {(r.cik, str(r.as_of)): r.val for r in got.where("period = 'year'").collect()}
    assert year == {(1, "2008-02-01"): 40, (1, "2008-08-14"): 40, (1, "2008-08-15"): 45, (1, "2030-01-01"): 45, (2, "2009-01-31"): 99}
    assert got.where("period = 'quarter'").count() == 4 and got.where("period = 'instant' and val = 7").count() == 4
    assert fct.as_filed(df.drop("_last").limit(0), spark.createDataFrame(days, "cik int, as_of date")).count() == 0


@needs_testdata
def test_driver_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "leverage_ratio" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


@needs_testdata
def test_oracle_agreement_small(spark):
    """A handful of registered queries against DuckDB at sf0.001."""
    import duckdb

    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name in ("ratio_features", "nlp_wide", "quality_flags", "validated_panel", "sentences",
                 "section_sentiment", "mann_whitney_u"):
        s = E.queries()[name](spark, SF_SMALL).toPandas()
        d = con.execute(E.oracle_sql()[name]).fetchdf()
        assert sorted(s.columns) == sorted(d.columns), name
        assert len(s) == len(d), name
        cols = sorted(s.columns)
        key = lambda r: tuple(str(x) for x in r)

        def rows(p):
            out = []
            for rec in p[cols].itertuples(index=False):
                out.append(tuple(round(x, 6) if isinstance(x, float) and x == x else (None if isinstance(x, float) else x)
                                 for x in rec))
            return sorted(out, key=key)
        assert rows(s) == rows(d), name
