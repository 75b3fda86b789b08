"""Feature operators: ratios (F1-F6), year-over-year (W1), text metrics
(T10-T13), row totals (F7) and the outer merge of panels (J3).

Scale notes: every window is ``partitionBy(firm).orderBy(year)``; a firm
holds one row per fiscal year, so a window partition is bounded by the
number of years whatever the number of firms. Text metrics are computed in
the projection that reads the text, so only small numeric columns ever
reach a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import null_double, pct_change, safe_divide
from ..functions.text import density, term_count, word_count


def _col_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else null_double()


def yoy(df: DataFrame, cols: Sequence[str], by: Sequence[str] | str = "firm",
        order: str = "fiscal_year", suffix: str = "_yoy_pct") -> DataFrame:
    """Change against the previous row of the same firm (not the
    previous calendar year); gaps are not filled."""
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(order)
    for c in cols:
        df = df.withColumn(c + suffix, pct_change(F.col(c), F.lag(c).over(w)))
    return df


def quantitative_features(panel: DataFrame,
                          ids: Sequence[str] = ("fiscal_year", "firm", "status", "ticker"),
                          firm: str = "firm", year: str = "fiscal_year") -> DataFrame:
    """F2-F6 + W1 over a validated panel (one row per firm-year)."""
    level3 = (safe_divide("fair_value_level3_assets", "total_assets") * 100
              if "fair_value_level3_assets" in panel.columns else null_double())
    feat = panel.select(
        *ids,
        safe_divide("total_assets", "stockholders_equity").alias("leverage_ratio"),
        safe_divide("cash_and_equivalents", "short_term_borrowings").alias("cash_coverage"),
        level3.alias("level3_pct"),
        _col_or_null(panel, "provision_for_loan_losses").alias("provision_for_losses"),
        F.col("net_income").cast("double").alias("net_income"),
        (safe_divide("stockholders_equity", "total_assets") * 100).alias("equity_to_assets_pct"),
    )
    feat = yoy(feat, ["provision_for_losses", "net_income"], by=firm, order=year)
    return feat.select(*ids, "leverage_ratio", "cash_coverage", "level3_pct",
                       "provision_for_losses", "net_income",
                       "provision_for_losses_yoy_pct", "net_income_yoy_pct",
                       "equity_to_assets_pct")


# ------------------------------------------------------------------ text
def section_metrics(sections: DataFrame, text_col: str = "text",
                    lexicon: Mapping[str, Sequence[str]] = C.CRISIS_TERMS,
                    hedging: Sequence[str] = C.HEDGING_WORDS,
                    keep: Sequence[str] | None = None) -> DataFrame:
    """T10-T13 in the long form: one row per input text with ``wc``,
    ``{category}_count`` and ``hedge_count``. The text column is dropped
    here, so downstream shuffles carry numbers only."""
    keep = [c for c in (keep or sections.columns) if c != text_col]
    # lower-case once per row; every term count reads the staged column
    x = sections.select(*keep, F.col(text_col).alias("_t"), F.lower(F.col(text_col)).alias("_lt"))
    t, lt = F.col("_t"), F.col("_lt")
    present = t.isNotNull() & (t != F.lit(""))
    cols = [word_count(t).alias("wc")]
    for cat, terms in lexicon.items():
        cols.append(F.when(present, term_count(lt, terms, lowered=True)).alias(f"{cat}_count"))
    cols.append(F.when(present, term_count(lt, hedging, lowered=True)).alias("hedge_count"))
    return x.select(*keep, *cols)


def add_densities(df: DataFrame, lexicon: Mapping[str, Sequence[str]] = C.CRISIS_TERMS,
                  wc: str = "wc") -> DataFrame:
    """Densities per 1000 words and hedging per 100 words."""
    w = F.col(wc)
    out = df
    for cat in lexicon:
        out = out.withColumn(f"{cat}_density",
                             F.when(w.isNotNull(), density(F.col(f"{cat}_count"), w, 1000.0)))
    if "hedge_count" in df.columns:
        out = out.withColumn("hedge_pct",
                             F.when(w.isNotNull(), density(F.col("hedge_count"), w, 100.0)))
    return out


def nlp_wide(metrics: DataFrame, keys: Sequence[str], section_col: str = "section",
             lexicon: Mapping[str, Sequence[str]] = C.CRISIS_TERMS,
             prefixes: Mapping[str, str] | None = None,
             hedging_section: str = "mda",
             firm: str = "firm", year: str = "fiscal_year") -> DataFrame:
    """Long per-section metrics (counts already summed per key and section)
    -> one wide row per key, with row totals (F7) and word-count YoY (W1).

    The pivot is a conditional aggregation over the small numeric columns;
    a missing section gives NULL features and a 0.0 total density."""
    prefixes = dict(prefixes or {"risk_factors": "risk", "mda": "mda"})
    m = add_densities(metrics, lexicon)
    aggs = []
    out_cols = []
    for sec, pre in prefixes.items():
        is_sec = F.col(section_col) == F.lit(sec)
        aggs.append(F.max(F.when(is_sec, F.col("wc").cast("double"))).alias(f"{pre}_section_wc"))
        out_cols.append(f"{pre}_section_wc")
        for cat in lexicon:
            aggs.append(F.max(F.when(is_sec, F.col(f"{cat}_count").cast("double")))
                        .alias(f"{pre}_{cat}_count"))
            aggs.append(F.max(F.when(is_sec, F.col(f"{cat}_density"))).alias(f"{pre}_{cat}_density"))
            out_cols += [f"{pre}_{cat}_count", f"{pre}_{cat}_density"]
        if sec == hedging_section:
            aggs.append(F.max(F.when(is_sec, F.col("hedge_pct"))).alias("hedging_language_pct"))
            out_cols.append("hedging_language_pct")
    wide = m.groupBy(*keys).agg(*aggs)
    first_pre = next(iter(prefixes.values()))
    wide = yoy(wide, [f"{first_pre}_section_wc"], by=firm, order=year)
    for pre in prefixes.values():
        total = None
        for cat in lexicon:
            term = F.coalesce(F.col(f"{pre}_{cat}_density"), F.lit(0.0))
            total = term if total is None else total + term
        wide = wide.withColumn(f"{pre}_total_crisis_density", total)
    tail = [f"{first_pre}_section_wc_yoy_pct"] + [f"{p}_total_crisis_density" for p in prefixes.values()]
    return wide.select(*keys, *out_cols, *tail)


def sum_metrics(metrics: DataFrame, keys: Sequence[str],
                lexicon: Mapping[str, Sequence[str]] = C.CRISIS_TERMS) -> DataFrame:
    """Several texts under one key (exhibits of one filing section): word and
    term counts are additive, so they are summed with a map-side partial
    aggregate; densities are derived afterwards."""
    aggs = [F.sum("wc").alias("wc")]
    aggs += [F.sum(f"{cat}_count").alias(f"{cat}_count") for cat in lexicon]
    aggs.append(F.sum("hedge_count").alias("hedge_count"))
    return metrics.groupBy(*keys).agg(*aggs)


def combine_outer(quant: DataFrame, nlp: DataFrame,
                  keys: Sequence[str] = ("firm", "fiscal_year", "status", "ticker")) -> DataFrame:
    """Full outer merge; USING columns coalesce the keys."""
    return quant.join(nlp, on=list(keys), how="full")
