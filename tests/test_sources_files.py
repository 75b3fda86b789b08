"""File sources, staging and the streaming job on awkward layouts."""

import json
import os
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from conftest import ROOT
from ledgerlens.operators import filings as fil
from ledgerlens.operators import quality as qual
from ledgerlens.operators import sentiment as sen
from ledgerlens.operators import sinks
from ledgerlens.plans import flows
from ledgerlens.sources import filings as sf
from ledgerlens.sources import panels
from ledgerlens.streaming import incremental as inc

BODY = " ".join(["Credit conditions could deteriorate and losses may rise."] * 20)
HTML = f"<p>Item 1A. Risk Factors</p><p>{BODY}</p><p>Item 1B. Staff</p>"


def _block(n, year):
    return {"form": ["10-K"] * n, "filingDate": [f"{year}-03-0{i + 1}" for i in range(n)],
            "accessionNumber": [f"{year}-{i}" for i in range(n)], "primaryDocument": ["d.htm"] * n,
            "reportDate": [f"{year - 1}-12-31"] * n}


def test_index_files_by_cik_name(spark, tmp_path):
    (tmp_path / "subs").mkdir()
    (tmp_path / "pages").mkdir()
    doc = {"filings": {"recent": _block(1, 2009), "files": [{"name": "CIK0000000042-submissions-001.json"}]}}
    (tmp_path / "subs" / "42.json").write_text(json.dumps(doc))
    (tmp_path / "pages" / "42_CIK0000000042-submissions-001.json").write_text(json.dumps(_block(2, 2005)))
    subs, pages = sf.read_submissions(spark, str(tmp_path / "subs")), sf.read_pages(spark, str(tmp_path / "pages"))
    assert [r.cik for r in subs.collect()] == ["0000000042"]
    assert [(r.cik, r.name) for r in pages.collect()] == [("0000000042", "CIK0000000042-submissions-001.json")]
    recs = fil.history_records(subs.select("cik", F.col("recent").alias("block")), fil.file_listing(subs), pages)
    assert sorted(r.accessionNumber for r in recs.collect()) == ["2005-0", "2005-1", "2009-0"]


def test_html_names_and_bytes(spark, tmp_path):
    for name in ("BRK.B_2007.html", "C3AI_2006.html", "BF-A_2008.htm", "odd.html"):
        (tmp_path / name).write_bytes(b"<p>ok \xff\xfe end</p>")
    got = {(r.ticker, r.fiscal_year) for r in panels.read_html(spark, str(tmp_path)).collect()}
    assert got == {("BRK.B", 2007), ("C3AI", 2006), ("BF-A", 2008), (None, None)}
    ok = panels.read_html(spark, str(tmp_path)).select(F.is_valid_utf8("html").alias("v"), "html").collect()
    assert all(r.v and "�" in r.html for r in ok)


def test_section_text_folders(spark, tmp_path):
    for t in ("BRK.B", "C3AI"):
        (tmp_path / t).mkdir()
        (tmp_path / t / "2007_mda.txt").write_bytes(b"text \xff")
    rows = panels.read_section_texts(spark, str(tmp_path)).collect()
    assert sorted((r.ticker, r.fiscal_year, r.section) for r in rows) == [("BRK.B", 2007, "mda"), ("C3AI", 2007, "mda")]


def test_incremental_output_by_uri(spark, tmp_path):
    out = f"file:{tmp_path}/sections"
    batch = spark.createDataFrame([("AAA", 2006, HTML), ("AAA", 2006, HTML + " again"), (None, None, HTML)],
                                  "ticker string, fiscal_year int, html string")
    inc.process_batch(batch, out)
    inc.process_batch(batch.where("ticker is not null"), out)
    rows = spark.read.parquet(out)
    assert rows.where("ticker = 'AAA'").count() == 1
    assert rows.select((F.col("n_bytes") == F.octet_length("section_text")).alias("x")).distinct().collect()[0].x


def test_staged_tables_do_not_share_a_place(spark):
    a = sinks.stage_table(spark.range(3).toDF("x"), "same")
    b = sinks.stage_table(spark.range(5).toDF("x"), "same")
    assert (a.count(), b.count()) == (3, 5)


def test_pending_work_and_statuses(spark):
    keys = ["ticker", "section"]
    scaffold = spark.createDataFrame([("A", "mda"), ("B", "mda"), ("C", "mda")], "ticker string, section string")
    done = spark.createDataFrame([("A", "mda", "x" * 501), ("B", "mda", "x" * 500)], "ticker string, section string, section_text string")
    assert sorted(r.ticker for r in sinks.pending_work(scaffold, done, keys).collect()) == ["B", "C"]


def test_python_functions_need_no_package_on_workers(tmp_path):
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from ledgerlens.session import build_session\n"
            "from pyspark.sql import functions as F\n"
            "from ledgerlens.functions.distributions import welch_p_udf\n"
            "s = build_session('local[1]')\n"
            "print('P', s.range(1).select(welch_p_udf(F.lit(1.0), F.lit(1.0)).alias('p')).collect()[0].p)\n" % ROOT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "P 0.5" in out.stdout, out.stderr[-2000:]


def test_model_scorer_batches(spark):
    def predict(texts):
        assert len(texts) <= 3
        return [("negative" if "loss" in t else "positive", len(t) / 100) for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a loss", "gain", None, "b", "loss loss", "c", "d"])],
                               "sentence_no int, sentence string")
    got = {r.sentence_no: (r.label, r.score) for r in sen.score_sentences(df, sen.model_scorer(predict, 3)).collect()}
    assert got[0] == ("negative", 0.06) and got[2] == ("positive", 0.0) and got[4][0] == "negative" and len(got) == 7


def test_model_is_loaded_once_per_worker_and_texts_are_cut(spark):
    import pathlib
    import uuid

    loads = tempfile.mkdtemp(prefix="ll-loads-")

    def load():
        pathlib.Path(loads, f"{os.getpid()}-{uuid.uuid4().hex}").touch()

        def predict(texts):  # a model that takes 512 tokens and no more
            assert all(len(t.split()) <= 512 for t in texts)
            return [("negative" if "loss" in t.split() else "positive", float(len(t.split()))) for t in texts]
        return predict

    rows = [(i, " ".join(["gain"] * (i * 37 % 900) + ["loss"] + ["gain"] * (i * 11 % 300))) for i in range(120)] + [(-1, None), (-2, "  ")]
    df = spark.createDataFrame(rows, "sentence_no int, sentence string").repartition(12)
    want = {i: ("negative" if "loss" in (t or "").split()[:512] else "positive", float(min(512, len((t or "").split())))) for i, t in rows}
    for size in (1, 7, 32):
        scorer = sen.model_scorer(load=load, batch_size=size, max_tokens=512)
        assert {r.sentence_no: (r.label, r.score) for r in sen.score_sentences(df, scorer).collect()} == want
        made = [f.split("-")[0] for f in os.listdir(loads)]
        assert max(map(made.count, made)) <= {1: 1, 7: 2, 32: 3}[size]


def test_most_negative_needs_enough_sentences(spark):
    rows = [("a", 1, i, "negative", 0.5 + i / 100, f"s{i}") for i in range(10)]
    rows += [("b", 2, 0, "negative", 0.9, "few")] + [("c", 3, i, "neutral", 0.5, "x") for i in range(12)]
    df = spark.createDataFrame(rows, "firm string, doc_id int, sentence_no int, label string, score double, text string")
    assert [(r.firm, r.text) for r in sen.most_negative(df, ["firm"]).collect()] == [("a", "s9")]
    assert sen.most_negative(df, ["firm"], min_sentences=1).count() == 2


def test_absent_columns_are_not_compared(spark):
    s = spark.createDataFrame([("f", 2001, 1.0)], "firm string, fiscal_year int, total_assets double")
    r = spark.createDataFrame([("f", 2001, 1.0, 5.0)], "firm string, fiscal_year int, total_assets double, net_income double")
    cells = qual.compare_cells(s, r, ["total_assets", "net_income"]).collect()
    assert [(c.measure, c.result) for c in cells] == [("total_assets", "MATCH")]


def test_pivot_has_status_and_only_years_with_values(spark):
    df = spark.createDataFrame([("z", "failed", 2001, 1.0), ("a", "survived", 2002, 2.0), ("a", "survived", 2003, None)],
                               "firm string, status string, fiscal_year int, v double")
    wide = sen.pivot_by_year(df, "v")
    assert wide.columns == ["firm", "status", "2001", "2002"]
    assert [(r.firm, r["2001"], r["2002"]) for r in wide.collect()] == [("z", 1.0, None), ("a", None, 2.0)]


def test_flow_keeps_filings_without_html(spark):
    recent = spark.createDataFrame([("0000000001", (["10-K"] * 2, ["2009-03-01", "2010-03-01"], ["x-1", "x-2"], ["d"] * 2,
                                                      ["2008-12-31", "2009-12-31"]))],
                                   "cik string, block struct<form:array<string>,filingDate:array<string>,"
                                   "accessionNumber:array<string>,primaryDocument:array<string>,reportDate:array<string>>")
    listing = spark.createDataFrame([], "cik string, name string")
    pages = spark.createDataFrame([], f"cik string, name string, block {recent.schema['block'].dataType.simpleString()}")
    html = spark.createDataFrame([("x-1", "<td>Total assets</td><td>50</td>")], "accession string, html string")
    firms = spark.createDataFrame([("F", "0000000001", "T", "failed")], "firm string, cik string, ticker string, status string")
    got = {r.accession: r for r in flows.filings_to_panel(recent, listing, pages, html, firms, 2000, 2020).collect()}
    assert got["x-1"].total_assets == 50.0 and got["x-2"].total_assets is None and got["x-2"].firm == "F"
