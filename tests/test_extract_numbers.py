"""Amount extraction (T6-T9): worked examples."""

from pyspark.sql import functions as F

from conftest import SF_SMALL, needs_testdata
from ledgerlens import config as C
from ledgerlens.operators import extract as ex
from ledgerlens.plans import shapes as S

#: text, label, and per match: number, value, token, context, offset
CASES = [
    ("(in thousands)\nTotal assets (1) $ 1,234.5\nTotal liabilities 500", r"total\s+assets",
     [(0, 1234.5, "$ 1,234.5", "Total assets (1) $ 1,234.5 Total liabilities 500", 15)]),
    ("Total assets\n(12,345)\n", r"total\s+assets", [(0, -12345.0, "(12,345)", "Total assets (12,345)", 0)]),
    ("total assets 5 3 December 31, 2007 888", r"total\s+assets",
     [(0, 31.0, "31", "total assets 5 3 December 31, 2007 888", 0)]),
    ("x total assets none\nTOTAL  ASSETS 20 and total assets 40", r"total\s+assets",
     [(0, 20.0, "20", "total assets none TOTAL  ASSETS 20 and total assets 40", 2),
      (1, 20.0, "20", "TOTAL  ASSETS 20 and total assets 40", 20), (2, 40.0, "40", "total assets 40", 41)]),
    ("Total assets" + " " * 499 + "12", r"total\s+assets", []),
    ("total liabilities and equity 99\ntotal liabilities 55", C.FIELD_PATTERNS["total_liabilities"][0],
     [(0, 55.0, "55", "total liabilities 55", 32)]),
    (" total assets 77 ", r"total\s+assets", [(0, 77.0, "77", "total assets 77 ", 2)]),
    ("", r"total\s+assets", []),
]


def test_numbers_near_labels(spark):
    for text, label, want in CASES:
        df = spark.createDataFrame([(text,)], "t string")
        got = df.select(ex.numbers_near_label(F.col("t"), label).alias("m")).collect()[0].m
        assert [(x.match_no, x.value, x.raw, x.context, x.position) for x in got] == want, text
    # the study's context limit is an argument
    df = spark.createDataFrame([("total assets " + "9" * 90,)], "t string")
    m = df.select(ex.numbers_near_label(F.col("t"), r"total\s+assets", context_max=20).alias("m")).collect()[0].m
    assert m[0].context == "total assets 9999999"


def test_best_value_takes_the_largest_and_the_earliest(spark):
    rows = [("total equity 70 and Total shareholders' equity 70",), ("total equity 900 total stockholders equity (1,000)",),
            ("no such line",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.b for r in df.select(ex.best_value(F.col("t"), C.FIELD_PATTERNS["stockholders_equity"]).alias("b")).collect()]
    assert (got[0].pattern_no, got[0].value) == (0, 70.0)
    assert (got[1].pattern_no, got[1].value) == (0, -1000.0)
    assert got[2] is None


def test_unit_multiplier_reads_whole_texts(spark):
    far = "y" * 60_000
    rows = [("amounts (In Thousands) and in millions", 1_000_000), ("IN  THOUSANDS", 1000), ("in billions", 10 ** 9),
            (far + " in thousands", 1000), ("nothing", 1), (None, 1)]
    df = spark.createDataFrame(rows, "t string, want long")
    assert all(r.u == r.want for r in df.select("want", ex.unit_multiplier(F.col("t")).alias("u")).collect())
    # with the study's two prefixes the far note is not seen, a near one comes first
    study = df.select("want", ex.unit_multiplier(F.col("t"), scans=C.UNIT_SCAN_CHARS).alias("u")).collect()
    assert [r.u for r in study] == [1_000_000, 1000, 10 ** 9, 1, 1, 1]


def test_scraped_row_with_every_pattern(spark):
    html = ("<p>(Dollars in millions)</p><table><tr><td>Total assets</td><td>2,000</td></tr><tr><td>Total assets</td>"
            "<td>(3,000)</td></tr><tr><td>Commercial paper and other short-term borrowings</td><td>45</td></tr>"
            "<tr><td>Cash and due from banks</td><td>12</td></tr><tr><td>Net income (loss) attributable</td><td>(17)</td></tr>"
            "<tr><td>Provision for loan, lease</td><td>18.5</td></tr><tr><td>Total equity</td><td>300</td></tr></table>")
    df = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    got = {r.id: r for r in ex.scrape_filing(df, "html", keep=["id"]).collect()}
    r = got[1]
    assert (r.total_assets, r.short_term_borrowings, r.cash_and_equivalents, r.net_income, r.provision_for_loan_losses,
            r.stockholders_equity, r.total_liabilities) == (-3e9, 45e6, 12e6, -17e6, 18.5e6, 300e6, None)
    assert all(got[2][f] is None for f in C.FIELD_PATTERNS)


@needs_testdata
def test_scraped_statements_hold_the_table_values(spark):
    orders = {r.o_orderkey: r for r in spark.read.parquet(f"{SF_SMALL}/orders.parquet").collect()}
    unit = {"1-URGENT": 1000, "2-HIGH": 10 ** 6, "5-LOW": 10 ** 6}
    for g in ex.scrape_filing(S.statements(spark, SF_SMALL), "html", keep=["doc_id"]).collect():
        o = orders[g.doc_id]
        k = unit.get(o.o_orderpriority, 1)
        assert g.unit_multiplier == k and abs(g.total_assets - round(o.o_totalprice, 2) * k) < 1e-3 * k
        assert (g.short_term_borrowings is None) == (o.o_orderstatus == "P")
