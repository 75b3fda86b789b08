"""Golden replays: the study's shipped inputs -> its shipped outputs."""

import csv
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import REF_DATA, approx_equal, needs_reference
from ledgerlens import config as C
from ledgerlens.operators import features as feat
from ledgerlens.operators import quality as qual
from ledgerlens.operators import sentiment as sen
from ledgerlens.operators import stats as st
from ledgerlens.sources import panels

PROC = os.path.join(REF_DATA, "processed")
TEXTS = os.path.join(REF_DATA, "texts")


def _csv_schema(path, strings=("firm", "status", "ticker", "section", "Feature", "Significant")):
    with open(path) as f:
        header = next(csv.reader(f))
    return T.StructType([T.StructField(h, T.StringType() if h in strings else T.DoubleType()) for h in header])


def _read(spark, name):
    p = os.path.join(PROC, name)
    return spark.read.schema(_csv_schema(p)).option("header", True).csv(p)


def _by_key(rows, key):
    return {tuple(r[k] for k in key): r for r in rows}


@needs_reference
def test_flags_on_scraped_panel(spark):
    scraped = panels.read_csv(spark, os.path.join(PROC, "financials.csv"), panels.SCRAPED_SCHEMA)
    got = {(r.firm, r.fiscal_year): r._flags for r in qual.all_flags(scraped).collect()}
    assert got[("AIG", 2005)] == "liabilities=assets; balance_off_10%"
    assert got[("AIG", 2006)] == "liabilities=assets; balance_off_10%; net_income_suspicious"
    assert got[("AIG", 2007)] == "liabilities=assets; net_income_suspicious"
    others = {k: v for k, v in got.items() if k[0] != "AIG" or k[1] not in (2005, 2006, 2007)}
    assert all(v == "" for v in others.values()), others


@needs_reference
def test_comparison_counts(spark):
    scraped = panels.read_csv(spark, os.path.join(PROC, "financials.csv"), panels.SCRAPED_SCHEMA)
    ref = panels.read_reference(spark)
    s = qual.comparison_summary(qual.compare_cells(scraped, ref)).collect()[0]
    assert (s.matched, s.mismatched, s.missing, s.total_checks) == (7, 74, 39, 120)


@needs_reference
def test_validated_panel_golden(spark):
    scraped = panels.read_csv(spark, os.path.join(PROC, "financials.csv"), panels.SCRAPED_SCHEMA)
    ref = panels.read_reference(spark)
    got = qual.validated_panel(scraped, ref)
    gold = panels.read_csv(spark, os.path.join(PROC, "financials_validated.csv"), panels.VALIDATED_SCHEMA)
    g = _by_key(gold.collect(), ("firm", "fiscal_year"))
    rows = got.collect()
    assert len(rows) == len(g) == 18
    for r in rows:
        e = g[(r.firm, r.fiscal_year)]
        for m in C.MEASURES:
            assert approx_equal(r[m], e[m]), (r.firm, r.fiscal_year, m, r[m], e[m])
    cnt = qual.override_counts(got).collect()[0]
    assert cnt.overridden == 74


@needs_reference
def test_quantitative_features_golden(spark):
    validated = panels.read_csv(spark, os.path.join(PROC, "financials_validated.csv"), panels.VALIDATED_SCHEMA)
    got = feat.quantitative_features(validated).collect()
    gold = _by_key(_read(spark, "features_quantitative.csv").collect(), ("firm", "fiscal_year"))
    assert len(got) == 18
    for r in got:
        e = gold[(r.firm, float(r.fiscal_year))]
        for c in ["leverage_ratio", "cash_coverage", "level3_pct", "provision_for_losses", "net_income",
                  "provision_for_losses_yoy_pct", "net_income_yoy_pct", "equity_to_assets_pct"]:
            assert approx_equal(r[c], e[c], rel=1e-12), (r.firm, r.fiscal_year, c, r[c], e[c])


def _texts_scaffold(spark):
    firms = panels.firm_dimension(spark)
    sc = panels.scaffold(spark, firms.select("firm", "ticker", "status"))
    texts = panels.read_section_texts(spark, TEXTS)
    return sc.join(texts, ["ticker", "fiscal_year", "section"], "left"), texts


@needs_reference
def test_section_text_scan(spark):
    texts = panels.read_section_texts(spark, TEXTS)
    assert texts.count() == 17
    assert texts.where("ticker = 'BSC' AND fiscal_year = 2007 AND section = 'risk_factors'").count() == 1


@needs_reference
def test_nlp_features_golden(spark):
    sc, texts = _texts_scaffold(spark)
    keys = ["firm", "ticker", "status", "fiscal_year", "section"]
    m = feat.section_metrics(sc, "text", keep=keys)
    wide = feat.nlp_wide(m, ["firm", "ticker", "status", "fiscal_year"]).collect()
    gold = _by_key(_read(spark, "features_nlp.csv").collect(), ("ticker", "year"))
    have = {(r.ticker, r.fiscal_year, r.section) for r in texts.select("ticker", "fiscal_year", "section").collect()}
    checked = 0
    for r in wide:
        e = gold[(r.ticker, float(r.fiscal_year))]
        for sec, pre in (("risk_factors", "risk"), ("mda", "mda")):
            if (r.ticker, r.fiscal_year, sec) not in have:
                assert r[f"{pre}_section_wc"] is None
                continue
            cols = [f"{pre}_section_wc"] + [f"{pre}_{c}_{k}" for c in C.CRISIS_TERMS for k in ("count", "density")]
            if sec == "mda":
                cols.append("hedging_language_pct")
            for c in cols:
                assert approx_equal(r[c], e[c], rel=1e-12), (r.ticker, r.fiscal_year, c, r[c], e[c])
                checked += 1
            assert approx_equal(r[f"{pre}_total_crisis_density"], e[f"{pre}_total_crisis_density"], rel=1e-12)
    assert checked > 200
    # firms without any text: NULL features, total density 0.0
    aig = [r for r in wide if r.ticker == "AIG"]
    assert all(r.risk_section_wc is None and r.risk_total_crisis_density == 0.0 for r in aig)


@needs_reference
def test_sentence_counts_golden(spark):
    sc, texts = _texts_scaffold(spark)
    keys = ["firm", "ticker", "status", "fiscal_year", "section"]
    present = sc.where(F.col("text").isNotNull())
    q = sen.quality_sentences(present, "text", keys)
    agg = sen.section_sentiment(sen.score_sentences(q), keys)
    got = sen.with_scaffold(agg, sc.select(*keys), keys)
    gold = _by_key(_read(spark, "sentiment_scores.csv").collect(), ("ticker", "fiscal_year", "section"))
    have = {(r.ticker, r.fiscal_year, r.section) for r in texts.select("ticker", "fiscal_year", "section").collect()}
    n = 0
    for r in got.collect():
        e = gold[(r.ticker, float(r.fiscal_year), r.section)]
        if (r.ticker, r.fiscal_year, r.section) in have:
            assert r.n_sentences == int(e.n_sentences), (r.ticker, r.fiscal_year, r.section)
            n += 1
        else:
            assert r.n_sentences == 0
    assert n == 17


def _combined(spark):
    df = _read(spark, "features_combined.csv")
    return df.withColumn("fiscal_year", F.col("fiscal_year").cast("int"))


@needs_reference
def test_statistics_golden(spark):
    got = {r.Feature: r for r in st.test_table(_combined(spark)).collect()}
    gold = _read(spark, "statistical_tests.csv").collect()
    assert len(got) == len(gold) == 7
    for e in gold:
        r = got[e.Feature]
        assert approx_equal(r["Failed Mean"], e["Failed Mean"], rel=1e-12)
        assert approx_equal(r["Survived Mean"], e["Survived Mean"], rel=1e-12)
        assert approx_equal(r["t-stat"], e["t-stat"], rel=1e-10)
        assert approx_equal(r["Cohen's d"], e["Cohen's d"], rel=1e-10)
        assert approx_equal(r["p-value"], e["p-value"], rel=1e-9)
        assert (r["Significant"] or "") == (e["Significant"] or "")


@needs_reference
def test_welch_df_and_mann_whitney_u(spark):
    comb = _combined(spark)
    cols = [c for c, _ in C.TEST_FEATURES]
    long = st.melt(comb, cols, ["status"])
    w = {r.feature: r for r in st.welch(st.group_moments(long)).collect()}
    dfs = [9.142266, 9.927357, 9.985878, 17.179346, 7.481593, 15.903577, 12.197240]
    sizes = [(10, 8), (10, 8), (10, 8), (12, 8), (12, 8), (10, 8), (10, 8)]
    for c, d, (n1, n2) in zip(cols, dfs, sizes):
        assert abs(w[c].welch_df - d) < 1e-5
        assert (w[c].n1, w[c].n2) == (n1, n2)
    mw = {r.feature: r for r in st.mann_whitney_with_p(long, exact_max_n=C.MW_EXACT_MAX_N).collect()}
    for c, u in zip(cols, [75, 13, 5, 61, 45, 31, 25.5]):
        assert mw[c].u_stat == u
        assert 0.0 <= mw[c].u_p_value <= 1.0


@needs_reference
def test_spearman_golden(spark):
    comb = _combined(spark)
    feats = [c for c in C.CORR_FEATURES if c in comb.columns]
    got = {(r.feature_x, r.feature_y): r.rho for r in st.spearman_pairs(comb, feats, C.CORR_MIN_NONNULL, lower_only=False).collect()}
    assert abs(got[("leverage_ratio", "risk_total_crisis_density")] - 0.0505675954592363) < 1e-12
    assert abs(got[("provision_for_losses", "hedging_language_pct")] - 0.3873335483621992) < 1e-12
