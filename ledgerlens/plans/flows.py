"""The three end-to-end flows of the study, as compositions of operators.

1. filings to validated panel: index -> annual filings -> HTML -> line
   items -> flags -> comparison -> validated panel;
2. filings to combined features: HTML -> sections; validated panel ->
   ratios; sections -> text features; outer merge;
3. combined features to findings: two-group tests, Spearman pairs,
   lead/lag; sections -> sentences -> sentiment.

Each flow returns DataFrames; callers decide where to write them
(``operators.sinks``). Stage outputs that feed several consumers should be
written (or ``checkpoint()``-ed into the shared checkpoint folder) rather
than recomputed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import extract as ex
from ..operators import features as feat
from ..operators import filings as fil
from ..operators import quality as qual
from ..operators import sentiment as sen
from ..operators import stats as st


def filings_to_panel(recent: DataFrame, listing: DataFrame, pages: DataFrame, html: DataFrame,
                     firms: DataFrame, start_year: int = C.START_YEAR, end_year: int = C.END_YEAR) -> DataFrame:
    """Flow 1a: scraped panel. ``html`` is (accession, html); ``firms`` is
    (firm, cik, ticker, status). A filing without HTML keeps its ids with
    NULL measures (V10)."""
    recs = fil.history_records(recent, listing, pages)
    annual = fil.select_annual(recs, start_year, end_year)
    # line items are read where the HTML is; only they meet the index
    items = ex.scrape_filing(html, "html", keep=["accession"]).drop("unit_multiplier")
    j = annual.join(firms, "cik").join(items, "accession", "left")
    return j.select("firm", "ticker", "status", "fiscal_year", "filing_date", "accession",
                    *[c for c in items.columns if c != "accession"])


def validate(scraped: DataFrame, reference_scaled: DataFrame, stage: bool = True) -> dict[str, DataFrame]:
    """Flow 1b: flags, comparison cells and summary, validated panel and
    override counts, identity check. The scraped panel and what several frames
    are made from are staged, so that filings are scraped once."""
    from ..operators.sinks import stage_table
    kept = stage_table if stage else (lambda df, _name: df)
    scraped = kept(scraped, "scraped")
    flags = kept(qual.all_flags(scraped), "flags")
    cells = kept(qual.compare_cells(scraped, reference_scaled), "cells")
    validated = kept(qual.validated_panel(scraped, reference_scaled), "validated")
    return {
        "flags": flags,
        "flagged": qual.flagged_rows(flags),
        "cells": cells,
        "summary": qual.comparison_summary(cells),
        "validated": validated.drop("_overridden", "_filled"),
        "overrides": qual.override_counts(validated),
        "identity": qual.identity_check(validated.drop("_overridden", "_filled")),
    }


def sections_from_html(html: DataFrame, keys: Sequence[str] = ("ticker", "fiscal_year"),
                       stage: bool = True) -> DataFrame:
    """Flow 2a: HTML converted once, both sections extracted (long form).
    The result feeds both text features and sentiment, so by default it is
    written once to the shared checkpoint folder and read back."""
    from ..functions.text import html_to_text_section
    from ..operators.sinks import stage_table
    docs = html.select(*keys, html_to_text_section(F.col("html")).alias("text"))
    secs = ex.extract_sections(docs, "text", keep=list(keys)).withColumnRenamed("section_text", "text")
    return stage_table(secs, "sections") if stage else secs


def combined_features(validated: DataFrame, sections: DataFrame, scaffold: DataFrame) -> DataFrame:
    """Flow 2b: quantitative + NLP features, full outer merge.
    ``scaffold`` is (firm, ticker, status, fiscal_year, section)."""
    quant = feat.quantitative_features(validated)
    keys = ["firm", "ticker", "status", "fiscal_year", "section"]
    # counted where the text is; only the counts meet the scaffold
    counts = feat.section_metrics(sections.select("ticker", "fiscal_year", "section", "text"), "text")
    m = scaffold.select(*keys).join(counts, ["ticker", "fiscal_year", "section"], "left")
    nlp = feat.nlp_wide(m, ["firm", "ticker", "status", "fiscal_year"])
    return feat.combine_outer(quant, nlp)


def findings(combined: DataFrame, stage: bool = True) -> dict[str, DataFrame]:
    """Flow 3a: test table, Spearman pairs (labelled), lead/lag, from features
    that are staged once."""
    from ..operators.sinks import stage_table
    combined = stage_table(combined, "combined") if stage else combined
    corr_cols = [c for c in C.CORR_FEATURES if c in combined.columns]
    return {
        "tests": st.test_table(combined),
        "mann_whitney": st.mann_whitney_with_p(st.melt(combined, [c for c, _ in C.TEST_FEATURES], ["status"]),
                                               exact_max_n=C.MW_EXACT_MAX_N),
        "spearman": st.spearman_pairs(combined, corr_cols, C.CORR_MIN_NONNULL, labels=C.CORR_LABELS),
        "lead_lag": st.lead_lag(combined, "risk_total_crisis_density", "leverage_ratio"),
    }


def sentiment(sections: DataFrame, scaffold: DataFrame, scorer=None) -> DataFrame:
    """Flow 3b: sentences -> scores -> section aggregates over the scaffold."""
    keys = ["ticker", "fiscal_year", "section"]
    # sentences are scored and added up where the text is; only the sums
    # meet the scaffold
    q = sen.quality_sentences(sections.select(*keys, "text"), "text", keys)
    sums = sen.section_sentiment(sen.score_sentences(q, scorer), keys)
    return sen.with_scaffold(sums, scaffold.select("firm", "ticker", "status", "fiscal_year", "section"), keys)
