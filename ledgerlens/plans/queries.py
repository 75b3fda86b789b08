"""Registered queries over the benchmark tables.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, duckdb_sql or None)``.
Every query reads whole tables (no sampling, caps or id subsets); the SQL
repeats the same shaping so the two sides can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as feat
from . import oracle as O
from . import shapes as S

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# ======================================================================
# Ratio features over the firm-year panel
# ======================================================================
RATIO_SQL = _with(O.PANEL_CTE) + """
SELECT fiscal_year, firm, status, ticker,
  total_assets / NULLIF(stockholders_equity, 0) AS leverage_ratio,
  cash_and_equivalents / NULLIF(short_term_borrowings, 0) AS cash_coverage,
  CAST(NULL AS DOUBLE) AS level3_pct,
  provision_for_loan_losses AS provision_for_losses,
  net_income,
  (provision_for_loan_losses / NULLIF(lag(provision_for_loan_losses) OVER w, 0) - 1.0) * 100.0
    AS provision_for_losses_yoy_pct,
  (net_income / NULLIF(lag(net_income) OVER w, 0) - 1.0) * 100.0 AS net_income_yoy_pct,
  stockholders_equity / NULLIF(total_assets, 0) * 100 AS equity_to_assets_pct
FROM panel
WINDOW w AS (PARTITION BY firm ORDER BY fiscal_year)
"""


@register("ratio_features", RATIO_SQL)
def ratio_features(spark, sf_dir):
    return feat.quantitative_features(S.panel(spark, sf_dir))


# ======================================================================
# Text features over documents as filing sections
# ======================================================================
def _doc_metrics(spark, sf_dir):
    secs = S.doc_sections(spark, sf_dir)
    m = feat.section_metrics(secs, "text", S.DOC_LEXICON, S.DOC_HEDGING,
                             keep=["firm", "ticker", "status", "fiscal_year", "section"])
    return feat.sum_metrics(m, ["firm", "ticker", "status", "fiscal_year", "section"], S.DOC_LEXICON)


WORD_COUNTS_SQL = f"""
SELECT doc_id, {O.word_count_sql('text')} AS words FROM documents
"""


@register("word_counts", WORD_COUNTS_SQL)
def word_counts(spark, sf_dir):
    from ..functions.text import word_count
    from ..sources.tables import table
    return table(spark, sf_dir, "documents", balance=True).select("doc_id", word_count("text").alias("words"))


def _term_density_sql() -> str:
    unions = []
    for cat in S.DOC_LEXICON:
        unions.append(
            f"SELECT firm, fiscal_year, section, '{cat}' AS category, {cat}_count AS term_count, "
            f"{O.density_sql(cat + '_count', 'wc', '1000.0')} AS density FROM doc_metrics")
    return _with(O.DOC_SECTIONS_CTE, O.doc_metrics_cte()) + "\nUNION ALL\n".join(unions)


@register("term_density", _term_density_sql())
def term_density(spark, sf_dir):
    m = feat.add_densities(_doc_metrics(spark, sf_dir), S.DOC_LEXICON)
    cats = list(S.DOC_LEXICON)
    stack = ", ".join(f"'{c}', {c}_count, {c}_density" for c in cats)
    return m.selectExpr("firm", "fiscal_year", "section",
                        f"stack({len(cats)}, {stack}) AS (category, term_count, density)")


HEDGING_SQL = _with(O.DOC_SECTIONS_CTE, O.doc_metrics_cte()) + f"""
SELECT firm, fiscal_year, wc AS words, hedge_count,
  {O.density_sql('hedge_count', 'wc', '100.0')} AS hedging_language_pct
FROM doc_metrics WHERE section = 'mda'
"""


@register("hedging_pct", HEDGING_SQL)
def hedging_pct(spark, sf_dir):
    m = feat.add_densities(_doc_metrics(spark, sf_dir), S.DOC_LEXICON)
    return m.where(F.col("section") == "mda").select(
        "firm", "fiscal_year", F.col("wc").alias("words"), "hedge_count",
        F.col("hedge_pct").alias("hedging_language_pct"))


def _nlp_wide_sql() -> str:
    cols = []
    for sec, pre in (("risk_factors", "risk"), ("mda", "mda")):
        cols.append(f"max(CASE WHEN section = '{sec}' THEN CAST(wc AS DOUBLE) END) AS {pre}_section_wc")
        for cat in S.DOC_LEXICON:
            cols.append(f"max(CASE WHEN section = '{sec}' THEN CAST({cat}_count AS DOUBLE) END) AS {pre}_{cat}_count")
            cols.append(f"max(CASE WHEN section = '{sec}' THEN {O.density_sql(cat + '_count', 'wc', '1000.0')} END) AS {pre}_{cat}_density")
        if sec == "mda":
            cols.append(f"max(CASE WHEN section = 'mda' THEN {O.density_sql('hedge_count', 'wc', '100.0')} END) AS hedging_language_pct")
    wide = ("wide AS (SELECT firm, ticker, status, fiscal_year,\n  " + ",\n  ".join(cols)
            + "\nFROM doc_metrics GROUP BY ALL)")
    tot = {pre: " + ".join(f"coalesce({pre}_{c}_density, 0.0)" for c in S.DOC_LEXICON)
           for pre in ("risk", "mda")}
    return _with(O.DOC_SECTIONS_CTE, O.doc_metrics_cte(), wide) + f"""
SELECT *,
  (risk_section_wc / NULLIF(lag(risk_section_wc) OVER (PARTITION BY firm ORDER BY fiscal_year), 0) - 1.0) * 100.0
    AS risk_section_wc_yoy_pct,
  {tot['risk']} AS risk_total_crisis_density,
  {tot['mda']} AS mda_total_crisis_density
FROM wide
"""


NLP_WIDE_SQL = _nlp_wide_sql()


def _nlp_wide_df(spark, sf_dir):
    return feat.nlp_wide(_doc_metrics(spark, sf_dir), ["firm", "ticker", "status", "fiscal_year"],
                         lexicon=S.DOC_LEXICON)


@register("nlp_wide", NLP_WIDE_SQL)
def nlp_wide(spark, sf_dir):
    return _nlp_wide_df(spark, sf_dir)


YOY_WORDS_SQL = _with(O.DOC_SECTIONS_CTE, O.doc_metrics_cte()) + """
, risk AS (SELECT firm, fiscal_year, CAST(wc AS DOUBLE) AS risk_section_wc FROM doc_metrics WHERE section = 'risk_factors')
SELECT firm, fiscal_year, risk_section_wc,
  (risk_section_wc / NULLIF(lag(risk_section_wc) OVER (PARTITION BY firm ORDER BY fiscal_year), 0) - 1.0) * 100.0
    AS risk_section_wc_yoy_pct
FROM risk
"""


@register("yoy_words", YOY_WORDS_SQL)
def yoy_words(spark, sf_dir):
    m = _doc_metrics(spark, sf_dir).where(F.col("section") == "risk_factors")
    r = m.select("firm", "fiscal_year", F.col("wc").cast("double").alias("risk_section_wc"))
    return feat.yoy(r, ["risk_section_wc"], by="firm", order="fiscal_year")


# ======================================================================
# Sanity flags and unit jumps over the distorted panel
# ======================================================================
from ..operators import quality as qual  # noqa: E402

_JUMP_MEASURES = ["total_assets", "stockholders_equity", "net_income"]


def _flags_sql() -> str:
    # window inside window is not allowed: compute per-row hits first
    hits = ",\n  ".join(f"{O.jump_sql(m, 'd')} AS hit_{m}" for m in _JUMP_MEASURES)
    return _with(O.PANEL_CTE, O.DISTORTED_CTE) + f"""
, hits AS (SELECT *, {O.sanity_flags_sql()} AS base, {hits} FROM distorted)
, firm_jumps AS (SELECT *, {', '.join(f"coalesce(bool_or(hit_{m}) OVER (PARTITION BY firm), false) AS jump_{m}" for m in _JUMP_MEASURES)} FROM hits)
"""


FLAGS_BASE_SQL = _flags_sql()
QUALITY_FLAGS_SQL = FLAGS_BASE_SQL + f"""
SELECT firm, fiscal_year,
  concat_ws('; ', CASE WHEN base <> '' THEN base END,
    {', '.join(f"CASE WHEN jump_{m} THEN 'unit_jump_{m}' END" for m in _JUMP_MEASURES)}) AS flags
FROM firm_jumps
"""


def _flags_df(spark, sf_dir):
    d = S.distorted_panel(S.panel(spark, sf_dir))
    return qual.all_flags(d, _JUMP_MEASURES)


@register("quality_flags", QUALITY_FLAGS_SQL)
def quality_flags(spark, sf_dir):
    return _flags_df(spark, sf_dir).select("firm", "fiscal_year", F.col("_flags").alias("flags"))


FLAGGED_ROWS_SQL = f"SELECT * FROM ({QUALITY_FLAGS_SQL}) WHERE flags <> ''"


@register("flagged_rows", FLAGGED_ROWS_SQL)
def flagged_rows(spark, sf_dir):
    return qual.flagged_rows(_flags_df(spark, sf_dir)).select(
        "firm", "fiscal_year", F.col("_flags").alias("flags"))


UNIT_JUMP_SQL = FLAGS_BASE_SQL + """
SELECT DISTINCT firm, measure FROM (
""" + "\nUNION ALL\n".join(
    f"  SELECT firm, '{m}' AS measure FROM firm_jumps WHERE jump_{m}" for m in _JUMP_MEASURES) + "\n)"


@register("unit_jump", UNIT_JUMP_SQL)
def unit_jump(spark, sf_dir):
    d = S.distorted_panel(S.panel(spark, sf_dir)).select("firm", "fiscal_year", *_JUMP_MEASURES)
    j = qual.unit_jumps(d, _JUMP_MEASURES)
    stack = ", ".join(f"'{m}', jump_{m}" for m in _JUMP_MEASURES)
    long = j.selectExpr("firm", f"stack({len(_JUMP_MEASURES)}, {stack}) AS (measure, jumped)")
    return long.where("jumped").select("firm", "measure").distinct()


# ======================================================================
# Comparison with a reference panel, validated panel
# ======================================================================
_MEASURES = list(qual.C.MEASURES)


def _validation_inputs(spark, sf_dir):
    scraped = S.scraped_for_validation(S.panel(spark, sf_dir))
    ref = qual.scale_reference(S.reference_for_validation(S.supplier_panel(spark, sf_dir)))
    return scraped, ref


def _compare_cells_sql() -> str:
    unions = "\nUNION ALL\n".join(
        f"  SELECT coalesce(s.firm, r.firm) AS firm, coalesce(s.fiscal_year, r.fiscal_year) AS fiscal_year, "
        f"'{m}' AS measure, s.{m} AS scraped, r.{m} AS reference "
        f"FROM scraped s FULL OUTER JOIN reference r ON s.firm = r.firm AND s.fiscal_year = r.fiscal_year"
        for m in _MEASURES)
    return _with(O.PANEL_CTE, O.SUPPLIER_PANEL_CTE, O.DISTORTED_CTE, O.VALIDATION_INPUT_CTE) + f"""
, cells AS (
{unions}
)
, compared AS (
  SELECT *, CASE WHEN scraped IS NULL THEN 'MISSING'
    WHEN reference <> 0 AND abs(scraped - reference) / abs(reference) > 0.05 THEN 'MISMATCH'
    ELSE 'MATCH' END AS result
  FROM cells WHERE reference IS NOT NULL
)
"""


COMPARE_CELLS_BASE = _compare_cells_sql()


@register("compare_reference", COMPARE_CELLS_BASE + "SELECT * FROM compared")
def compare_reference(spark, sf_dir):
    s, r = _validation_inputs(spark, sf_dir)
    return qual.compare_cells(s, r)


@register("compare_summary", COMPARE_CELLS_BASE + """
SELECT CAST(sum(CASE WHEN result = 'MATCH' THEN 1 ELSE 0 END) AS BIGINT) AS matched,
  CAST(sum(CASE WHEN result = 'MISMATCH' THEN 1 ELSE 0 END) AS BIGINT) AS mismatched,
  CAST(sum(CASE WHEN result = 'MISSING' THEN 1 ELSE 0 END) AS BIGINT) AS missing,
  count(*) AS total_checks
FROM compared
""")
def compare_summary(spark, sf_dir):
    s, r = _validation_inputs(spark, sf_dir)
    return qual.comparison_summary(qual.compare_cells(s, r))


def _validated_sql() -> str:
    cols, over, fill = [], [], []
    for m in _MEASURES:
        within = f"(r.{m} <> 0 AND abs(s.{m} - r.{m}) / abs(r.{m}) <= 0.05)"
        cols.append(f"CASE WHEN s.firm IS NULL THEN r.{m} WHEN r.{m} IS NULL THEN s.{m} "
                    f"WHEN s.{m} IS NULL THEN r.{m} WHEN {within} THEN s.{m} ELSE r.{m} END AS {m}")
        over.append(f"CASE WHEN s.firm IS NOT NULL AND r.{m} IS NOT NULL AND s.{m} IS NOT NULL "
                    f"AND NOT coalesce({within}, false) THEN 1 ELSE 0 END")
        fill.append(f"CASE WHEN s.firm IS NOT NULL AND r.{m} IS NOT NULL AND s.{m} IS NULL THEN 1 ELSE 0 END")
    return _with(O.PANEL_CTE, O.SUPPLIER_PANEL_CTE, O.DISTORTED_CTE, O.VALIDATION_INPUT_CTE) + f"""
, validated AS (
  SELECT r.firm, r.ticker, r.status, r.fiscal_year,
    {', '.join(cols)},
    {' + '.join(over)} AS _overridden,
    CASE WHEN s.firm IS NULL THEN {len(_MEASURES)} ELSE {' + '.join(fill)} END AS _filled
  FROM reference r LEFT JOIN scraped s ON r.firm = s.firm AND r.fiscal_year = s.fiscal_year
)
"""


VALIDATED_BASE = _validated_sql()


def _validated_df(spark, sf_dir):
    s, r = _validation_inputs(spark, sf_dir)
    return qual.validated_panel(s, r)


@register("validated_panel", VALIDATED_BASE + f"SELECT firm, ticker, status, fiscal_year, {', '.join(_MEASURES)} FROM validated")
def validated_panel(spark, sf_dir):
    return _validated_df(spark, sf_dir).select("firm", "ticker", "status", "fiscal_year", *_MEASURES)


@register("override_counts", VALIDATED_BASE + """
SELECT CAST(sum(_overridden) AS BIGINT) AS overridden, CAST(sum(_filled) AS BIGINT) AS filled_from_reference
FROM validated
""")
def override_counts(spark, sf_dir):
    return qual.override_counts(_validated_df(spark, sf_dir))


@register("identity_check", VALIDATED_BASE + """
SELECT firm, fiscal_year,
  CASE WHEN total_assets IS NOT NULL AND total_liabilities IS NOT NULL AND stockholders_equity IS NOT NULL
    AND total_assets > 0 THEN abs(total_assets - (total_liabilities + stockholders_equity)) / total_assets * 100 END
    AS identity_diff_pct,
  CASE WHEN total_assets IS NOT NULL AND total_liabilities IS NOT NULL AND stockholders_equity IS NOT NULL
    AND total_assets > 0 THEN abs(total_assets - (total_liabilities + stockholders_equity)) / total_assets * 100 < 5 END
    AS identity_ok
FROM validated
""")
def identity_check(spark, sf_dir):
    return qual.identity_check(_validated_df(spark, sf_dir)).select(
        "firm", "fiscal_year", "identity_diff_pct", "identity_ok")


# ======================================================================
# Coverage, completeness, missing fields over the gappy panel
# ======================================================================
def _coverage_sql() -> str:
    unions = "\nUNION ALL\n".join(
        f"  SELECT firm, '{m}' AS measure, count({m}) AS found, count(*) AS total, "
        f"min(fiscal_year) AS min_year, max(fiscal_year) AS max_year FROM gappy GROUP BY firm"
        for m in _MEASURES)
    return _with(O.PANEL_CTE, O.GAPPY_CTE) + f"""
SELECT *, CASE WHEN found = total THEN 'all' WHEN found > 0 THEN 'some' ELSE 'none' END AS coverage
FROM (
{unions}
)"""


@register("coverage", _coverage_sql())
def coverage(spark, sf_dir):
    return qual.coverage(S.gappy_panel(S.panel(spark, sf_dir)))


@register("missing_fields", _with(O.PANEL_CTE, O.GAPPY_CTE) + f"""
SELECT * FROM (
  SELECT firm, fiscal_year,
    concat_ws(', ', {', '.join(f"CASE WHEN {m} IS NULL THEN '{m}' END" for m in _MEASURES)}) AS missing,
    {' + '.join(f"CASE WHEN {m} IS NULL THEN 1 ELSE 0 END" for m in _MEASURES)} AS n_missing
  FROM gappy
) WHERE n_missing > 0
""")
def missing_fields(spark, sf_dir):
    return qual.missing_fields(S.gappy_panel(S.panel(spark, sf_dir)))


_RATIO_COLS = ["leverage_ratio", "cash_coverage", "level3_pct", "provision_for_losses", "net_income",
               "provision_for_losses_yoy_pct", "net_income_yoy_pct", "equity_to_assets_pct"]


@register("completeness", f"""
WITH rf AS ({RATIO_SQL})
SELECT total, feature, non_null FROM (
  SELECT count(*) AS total, {', '.join(f'count({c}) AS n__{c}' for c in _RATIO_COLS)} FROM rf
) UNPIVOT (non_null FOR feature IN ({', '.join(f'n__{c} AS {O.sql_literal(c)}' for c in _RATIO_COLS)}))
""")
def completeness(spark, sf_dir):
    return qual.completeness(ratio_features(spark, sf_dir), _RATIO_COLS)


# ======================================================================
# Filing index -> records -> annual filings -> locators
# ======================================================================
from ..operators import filings as fil  # noqa: E402

FILING_YEARS = (1996, 2000)


def _records_df(spark, sf_dir):
    recent, listing, pages = S.filing_index(spark, sf_dir)
    return fil.history_records(recent, listing, pages)


@register("history_union", _with(O.FILING_INDEX_CTE) + "SELECT * FROM records")
def history_union(spark, sf_dir):
    return _records_df(spark, sf_dir)


_ANNUAL_BASE = _with(O.FILING_INDEX_CTE, O.ANNUAL_SQL)


@register("filing_select", _ANNUAL_BASE + f"""
SELECT * FROM annual WHERE fiscal_year BETWEEN {FILING_YEARS[0]} AND {FILING_YEARS[1]}
""")
def filing_select(spark, sf_dir):
    return fil.select_annual(_records_df(spark, sf_dir), *FILING_YEARS)


@register("filing_locator", _ANNUAL_BASE + f"""
, sel AS (SELECT * FROM annual WHERE fiscal_year BETWEEN {FILING_YEARS[0]} AND {FILING_YEARS[1]})
, loc AS (SELECT *, replace(accession, '-', '') AS accession_nodash,
    CASE WHEN regexp_replace(cik, '^0+', '') = '' THEN '0' ELSE regexp_replace(cik, '^0+', '') END AS cik_nodash
  FROM sel)
SELECT cik, accession, fiscal_year, accession_nodash, cik_nodash,
  'https://www.sec.gov/Archives/edgar/data/' || cik_nodash || '/' || accession_nodash || '/' || primary_doc AS url_1,
  'https://data.sec.gov/Archives/edgar/data/' || cik_nodash || '/' || accession_nodash || '/' || primary_doc AS url_2
FROM loc
""")
def filing_locator(spark, sf_dir):
    sel = fil.select_annual(_records_df(spark, sf_dir), *FILING_YEARS)
    return fil.filing_locator(sel).select("cik", "accession", "fiscal_year", "accession_nodash",
                                          "cik_nodash", "url_1", "url_2")


# ======================================================================
# HTML to text over pages
# ======================================================================
from ..functions import text as TX  # noqa: E402
from ..operators import extract as ex  # noqa: E402
from ..sources.tables import table as _table  # noqa: E402


@register("html_to_text_fin", f"SELECT page_id, {O.html_sql('html', TX.FIN_BLOCK_TAGS, False)} AS text FROM pages")
def html_to_text_fin(spark, sf_dir):
    return _table(spark, sf_dir, "pages", balance=True).select("page_id", TX.html_to_text_financial("html").alias("text"))


@register("html_to_text_section", f"SELECT page_id, {O.html_sql('html', TX.SECTION_BLOCK_TAGS, True)} AS text FROM pages")
def html_to_text_section(spark, sf_dir):
    return _table(spark, sf_dir, "pages", balance=True).select("page_id", TX.html_to_text_section("html").alias("text"))


# ======================================================================
# Section extraction over documents wrapped as filings
# ======================================================================
_SEC = qual.C.SECTION_PATTERNS


def _sections_sql() -> str:
    parts = []
    for s in qual.C.SECTIONS:
        parts.append(f"SELECT doc_id, '{s}' AS section, "
                     f"{O.section_sql('filing', _SEC[s]['start'], _SEC[s]['end'])} AS section_text FROM doc_filings")
    return _with(O.DOC_FILINGS_CTE) + ", secs AS (\n" + "\nUNION ALL\n".join(parts) + "\n)\n"


SECTIONS_BASE = _sections_sql()


def _sections_df(spark, sf_dir):
    f = S.doc_filings(spark, sf_dir)
    return ex.extract_sections(f, "filing", keep=["doc_id"])


@register("section_extract", SECTIONS_BASE + """
SELECT doc_id, section, section_text, CAST(length(section_text) AS INTEGER) AS n_chars FROM secs
""")
def section_extract(spark, sf_dir):
    s = _sections_df(spark, sf_dir)
    return s.select("doc_id", "section", "section_text", F.length("section_text").alias("n_chars"))


@register("extraction_status", SECTIONS_BASE + """
SELECT section, CASE WHEN section_text IS NULL THEN 'failed' ELSE 'ok' END AS status, count(*) AS n
FROM secs GROUP BY ALL
""")
def extraction_status(spark, sf_dir):
    s = _sections_df(spark, sf_dir).withColumn("has_text", F.lit(True))
    return ex.extraction_status(s).groupBy("section", "status").agg(F.count(F.lit(1)).alias("n"))


def _headers_sql() -> str:
    pat = O.py_pattern_sql(qual.C.HEADER_PATTERN)
    return _with(O.DOC_FILINGS_CTE) + f"""
, h AS (SELECT doc_id, regexp_extract_all(filing, {pat}) AS hits FROM doc_filings)
SELECT doc_id, array_to_string(list_filter(hits, lambda x, i: list_position(hits, x) = i), ' | ') AS headers
FROM h
"""


@register("headers_found", _headers_sql())
def headers_found_q(spark, sf_dir):
    f = S.doc_filings(spark, sf_dir)
    return f.select("doc_id", F.array_join(ex.headers_found("filing"), " | ").alias("headers"))


# ======================================================================
# Sentences and sentiment over documents
# ======================================================================
from ..operators import sentiment as sen  # noqa: E402

_SCORER = sen.lexicon_scorer(S.DOC_POSITIVE, S.DOC_NEGATIVE)
_SENT_BASE = _with(O.SENTENCES_CTE)
_SCORED_BASE = _with(O.SENTENCES_CTE, O.scored_cte(S.DOC_POSITIVE, S.DOC_NEGATIVE))
_SKEYS = ["firm", "fiscal_year", "section"]


@register("sentences", _SENT_BASE + "SELECT * FROM sentences")
def sentences_q(spark, sf_dir):
    return sen.sentences(_table(spark, sf_dir, "documents", balance=True).select("doc_id", "text"), "text", ["doc_id"])


@register("quality_sentences", _SENT_BASE + f"SELECT * FROM sentences WHERE {O.quality_sql('sentence')}")
def quality_sentences_q(spark, sf_dir):
    return sen.quality_sentences(_table(spark, sf_dir, "documents", balance=True).select("doc_id", "text"), "text", ["doc_id"])


def _scored_df(spark, sf_dir, keys=("doc_id",)):
    d = S.doc_sections(spark, sf_dir).select(*dict.fromkeys(["doc_id", *keys]), "text")
    q = sen.quality_sentences(d, "text")
    return sen.score_sentences(q, _SCORER)


@register("sentence_scores", _SCORED_BASE + "SELECT * FROM scored")
def sentence_scores(spark, sf_dir):
    return _scored_df(spark, sf_dir)


_SECTION_SENT_SQL = _with(O.DOC_SECTIONS_CTE, O.SENTENCES_CTE, O.scored_cte(S.DOC_POSITIVE, S.DOC_NEGATIVE)) + """
, keyed AS (SELECT d.firm, d.fiscal_year, d.section, s.* FROM scored s JOIN doc_sections d USING (doc_id))
, agg AS (
  SELECT firm, fiscal_year, section, count(*) AS n,
    count(CASE WHEN label = 'positive' THEN 1 END) / count(*) AS pr,
    count(CASE WHEN label = 'negative' THEN 1 END) / count(*) AS nr,
    count(CASE WHEN label = 'neutral' THEN 1 END) / count(*) AS ur,
    coalesce(avg(CASE WHEN label = 'positive' THEN score END), 0.0) AS pc,
    coalesce(avg(CASE WHEN label = 'negative' THEN score END), 0.0) AS nc
  FROM keyed GROUP BY ALL
)
, scaffold AS (SELECT DISTINCT firm, fiscal_year, section FROM doc_sections)
, section_sentiment AS (
  SELECT s.firm, s.fiscal_year, s.section, CAST(coalesce(a.n, 0) AS INTEGER) AS n_sentences,
    CASE WHEN a.n >= 10 THEN pr END AS positive_ratio,
    CASE WHEN a.n >= 10 THEN nr END AS negative_ratio,
    CASE WHEN a.n >= 10 THEN ur END AS neutral_ratio,
    CASE WHEN a.n >= 10 THEN pc END AS avg_positive_conf,
    CASE WHEN a.n >= 10 THEN nc END AS avg_negative_conf,
    CASE WHEN a.n >= 10 THEN pr END - CASE WHEN a.n >= 10 THEN nr END AS sentiment_score
  FROM scaffold s LEFT JOIN agg a USING (firm, fiscal_year, section)
)
"""


def _section_sentiment_df(spark, sf_dir):
    scored = _scored_df(spark, sf_dir, ["doc_id", *_SKEYS])
    agg = sen.section_sentiment(scored, _SKEYS)
    scaffold = S.doc_sections(spark, sf_dir).select(*_SKEYS).distinct()
    return sen.with_scaffold(agg, scaffold, _SKEYS)


@register("section_sentiment", _SECTION_SENT_SQL + "SELECT * FROM section_sentiment")
def section_sentiment_q(spark, sf_dir):
    return _section_sentiment_df(spark, sf_dir).select(
        *_SKEYS, "n_sentences", "positive_ratio", "negative_ratio", "neutral_ratio",
        "avg_positive_conf", "avg_negative_conf", "sentiment_score")


@register("most_negative", _SECTION_SENT_SQL + """
SELECT firm, fiscal_year, section, text, score FROM (
  SELECT *, row_number() OVER (PARTITION BY firm, fiscal_year, section
                               ORDER BY score DESC, doc_id, sentence_no) AS rn
  FROM keyed JOIN agg USING (firm, fiscal_year, section) WHERE label = 'negative' AND n >= 10
) WHERE rn = 1
""")
def most_negative_q(spark, sf_dir):
    return sen.most_negative(_scored_df(spark, sf_dir, ["doc_id", *_SKEYS]), _SKEYS)


# the three pivots of each section as rows: the years come from the data
_PIVOT_VALUES = ["sentiment_score", "negative_ratio", "n_sentences"]


@register("sentiment_pivot", _SECTION_SENT_SQL + "\nUNION ALL\n".join(f"""
SELECT '{v}' AS measure, section, firm, fiscal_year, CAST(min({v}) AS DOUBLE) AS value
FROM section_sentiment WHERE {v} IS NOT NULL GROUP BY section, firm, fiscal_year""" for v in _PIVOT_VALUES))
def sentiment_pivot(spark, sf_dir):
    s = _section_sentiment_df(spark, sf_dir)
    keys = ["section", "firm", "fiscal_year"]
    long = s.select(*keys, *[F.col(v).cast("double").alias(v) for v in _PIVOT_VALUES]).unpivot(
        keys, _PIVOT_VALUES, "measure", "value")
    return sen.firm_year_cells(long, "value", ["measure", "section", "firm"])


# ======================================================================
# Two-group statistics, ranks, Spearman, lead/lag
# ======================================================================
from ..operators import stats as st  # noqa: E402

_STAT_FEATURES = ["n_chars", "words", "article_density", "toxic", "marks"]


def _long_labelled(spark, sf_dir):
    return st.melt(S.labelled_features(spark, sf_dir), _STAT_FEATURES, ["status"])


_MOMENTS_SQL = _with(O.LABELLED_CTE) + """
, m AS (
  SELECT feature,
    count(CASE WHEN status = 'failed' THEN value END) AS n1,
    avg(CASE WHEN status = 'failed' THEN value END) AS mean1,
    stddev_samp(CASE WHEN status = 'failed' THEN value END) AS sd1,
    count(CASE WHEN status = 'survived' THEN value END) AS n2,
    avg(CASE WHEN status = 'survived' THEN value END) AS mean2,
    stddev_samp(CASE WHEN status = 'survived' THEN value END) AS sd2
  FROM long GROUP BY feature
)
"""


@register("welch_cohen", _MOMENTS_SQL + """
SELECT feature, n1, n2, mean1, mean2, sd1, sd2,
  (mean1 - mean2) / sqrt(sd1 * sd1 / n1 + sd2 * sd2 / n2) AS t_stat,
  (sd1 * sd1 / n1 + sd2 * sd2 / n2) * (sd1 * sd1 / n1 + sd2 * sd2 / n2)
    / ((sd1 * sd1 / n1) * (sd1 * sd1 / n1) / (n1 - 1) + (sd2 * sd2 / n2) * (sd2 * sd2 / n2) / (n2 - 1)) AS welch_df,
  CASE WHEN sqrt((sd1 * sd1 + sd2 * sd2) / 2) > 0 THEN (mean1 - mean2) / sqrt((sd1 * sd1 + sd2 * sd2) / 2) ELSE 0.0 END
    AS cohens_d
FROM m WHERE n1 >= 2 AND n2 >= 2
""")
def welch_cohen(spark, sf_dir):
    return st.welch(st.group_moments(_long_labelled(spark, sf_dir)))


def _p_values_sql() -> str:
    moments = _MOMENTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    step = """
    SELECT feature, t_stat, welch_df, a0, b0, x0, direct, a, b, x, it + 1 AS it,
      c2, d2, h * d1 * c1 * d2 * c2 AS h
    FROM (
      SELECT *,
        1.0 / (CASE WHEN abs(1.0 + aa2 * d1) < 1e-300 THEN 1e-300 ELSE 1.0 + aa2 * d1 END) AS d2,
        CASE WHEN abs(1.0 + aa2 / c1) < 1e-300 THEN 1e-300 ELSE 1.0 + aa2 / c1 END AS c2
      FROM (
        SELECT *,
          1.0 / (CASE WHEN abs(1.0 + aa1 * d) < 1e-300 THEN 1e-300 ELSE 1.0 + aa1 * d END) AS d1,
          CASE WHEN abs(1.0 + aa1 / c) < 1e-300 THEN 1e-300 ELSE 1.0 + aa1 / c END AS c1,
          -(a + (it + 1)) * (a + b + (it + 1)) * x / ((a + 2.0 * (it + 1)) * (a + 1.0 + 2.0 * (it + 1))) AS aa2
        FROM (
          SELECT *, (it + 1) * (b - (it + 1)) * x / ((a - 1.0 + 2.0 * (it + 1)) * (a + 2.0 * (it + 1))) AS aa1
          FROM cf WHERE it < 300
        )
      )
    )"""
    return moments + f"""
, w AS (
  SELECT feature,
    (mean1 - mean2) / sqrt(sd1 * sd1 / n1 + sd2 * sd2 / n2) AS t_stat,
    (sd1 * sd1 / n1 + sd2 * sd2 / n2) * (sd1 * sd1 / n1 + sd2 * sd2 / n2)
      / ((sd1 * sd1 / n1) * (sd1 * sd1 / n1) / (n1 - 1) + (sd2 * sd2 / n2) * (sd2 * sd2 / n2) / (n2 - 1)) AS welch_df
  FROM m WHERE n1 >= 2 AND n2 >= 2
)
, prm AS (
  SELECT feature, t_stat, welch_df, welch_df / 2.0 AS a0, 0.5 AS b0,
    welch_df / (welch_df + t_stat * t_stat) AS x0 FROM w
)
, br AS (
  SELECT *, x0 < (a0 + 1.0) / (a0 + b0 + 2.0) AS direct,
    CASE WHEN x0 < (a0 + 1.0) / (a0 + b0 + 2.0) THEN a0 ELSE b0 END AS a,
    CASE WHEN x0 < (a0 + 1.0) / (a0 + b0 + 2.0) THEN b0 ELSE a0 END AS b,
    CASE WHEN x0 < (a0 + 1.0) / (a0 + b0 + 2.0) THEN x0 ELSE 1.0 - x0 END AS x
  FROM prm
)
, cf AS (
  SELECT feature, t_stat, welch_df, a0, b0, x0, direct, a, b, x, 0 AS it, CAST(1.0 AS DOUBLE) AS c,
    1.0 / (CASE WHEN abs(1.0 - (a + b) * x / (a + 1.0)) < 1e-300 THEN 1e-300 ELSE 1.0 - (a + b) * x / (a + 1.0) END) AS d,
    1.0 / (CASE WHEN abs(1.0 - (a + b) * x / (a + 1.0)) < 1e-300 THEN 1e-300 ELSE 1.0 - (a + b) * x / (a + 1.0) END) AS h
  FROM br
  UNION ALL
  {step.strip()}
)
, fin AS (
  SELECT *, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1.0 - x)) * h / a AS frac
  FROM cf WHERE it = 300
)
, pv AS (
  SELECT feature, t_stat, welch_df, CASE WHEN direct THEN frac ELSE 1.0 - frac END AS p_value FROM fin
)
SELECT feature, t_stat, welch_df, p_value,
  CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.1 THEN '*' ELSE '' END
    AS significant,
  CASE WHEN p_value >= 0.001 THEN printf('p=%.3f', p_value) ELSE 'p<0.001' END AS p_label
FROM pv
"""


@register("p_values", _p_values_sql())
def p_values(spark, sf_dir):
    w = st.with_welch_p(st.welch(st.group_moments(_long_labelled(spark, sf_dir))))
    return w.select("feature", "t_stat", "welch_df", "p_value", "significant",
                    st.p_label(F.col("p_value")).alias("p_label"))


@register("mann_whitney_u", _with(O.LABELLED_CTE) + """
, ranked AS (
  SELECT *, rank() OVER (PARTITION BY feature ORDER BY value)
    + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS avg_rank
  FROM long
)
, ties AS (SELECT feature, value, count(*) AS c FROM long GROUP BY ALL)
, agg AS (
  SELECT feature, sum(CASE WHEN status = 'failed' THEN avg_rank ELSE 0 END) AS r1,
    count(CASE WHEN status = 'failed' THEN 1 END) AS n1, count(CASE WHEN status <> 'failed' THEN 1 END) AS n2
  FROM ranked GROUP BY feature
)
SELECT a.feature, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, r1 - n1 * (n1 + 1) / 2.0 AS u_stat,
  CAST((SELECT sum(c * c * c - c) FROM ties t WHERE t.feature = a.feature) AS DOUBLE) AS tie_term
FROM agg a WHERE n1 >= 2 AND n2 >= 2
""")
def mann_whitney_u(spark, sf_dir):
    return st.mann_whitney(_long_labelled(spark, sf_dir))


# p by the normal tail; erfc by its Taylor series (z up to 3) or its
# continued fraction beyond, 150 terms either way
@register("mann_whitney_p", _with(O.LABELLED_CTE) + """
, vc AS (
  SELECT feature, value, count(*) AS cnt, count(CASE WHEN status = 'failed' THEN 1 END) AS c1
  FROM long WHERE status IN ('failed', 'survived') GROUP BY ALL),
rk AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + (cnt + 1) / 2.0 AS r FROM vc),
u AS (
  SELECT feature, CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(cnt) - sum(c1) AS BIGINT) AS n2,
    CAST(sum(c1 * r) - sum(c1) * (sum(c1) + 1) / 2.0 AS DOUBLE) AS u_stat,
    sum(CAST(cnt AS DOUBLE) * cnt * cnt - cnt) AS tie_term
  FROM rk GROUP BY feature),
z AS (
  SELECT *, (greatest(u_stat, n1 * n2 - u_stat) - n1 * n2 / 2.0 - 0.5)
    / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie_term / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) / sqrt(2.0) AS x
  FROM u WHERE n1 >= 2 AND n2 >= 2),
series AS (
  SELECT feature, list_sum(list_transform(range(0, 150), lambda k: CASE WHEN k = 0 THEN x ELSE
    list_product([x] || list_transform(range(1, k + 1), lambda j: -x * x / j)) / (2 * k + 1) END)) AS s FROM z),
fraction AS (SELECT feature, list_reduce(list_transform([0.0] || list_transform(range(0, 150), lambda k: 150.0 - k), lambda v: CAST(v AS DOUBLE)),
    lambda acc, k: k / 2 / (x + acc)) AS f FROM z WHERE x > 2)
SELECT z.feature, n1, n2, u_stat, tie_term, least(1.0, CASE WHEN x <= 2 THEN 1 - 2 / sqrt(pi()) * s
  ELSE exp(-x * x) / sqrt(pi()) / (x + f) END) AS u_p_value
FROM z JOIN series USING (feature) LEFT JOIN fraction USING (feature)
""")
def mann_whitney_p(spark, sf_dir):
    return st.mann_whitney_with_p(_long_labelled(spark, sf_dir))


@register("group_sem", _with(O.LABELLED_CTE) + """
SELECT feature, status, count(*) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS sem
FROM long GROUP BY ALL
""")
def group_sem(spark, sf_dir):
    return st.group_sem(_long_labelled(spark, sf_dir))


_CORR = ["leverage_ratio", "cash_coverage", "equity_to_assets_pct", "net_income",
         "provision_for_losses", "net_income_yoy_pct"]


def _spearman_sql() -> str:
    pairs = [(i, j) for i in range(len(_CORR)) for j in range(len(_CORR)) if i > j]
    unions = "\nUNION ALL\n".join(
        f"  SELECT '{_CORR[i]}' AS feature_x, '{_CORR[j]}' AS feature_y, {_CORR[i]} AS x, {_CORR[j]} AS y FROM base"
        for i, j in pairs)
    nn = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS nn FROM base" for c in _CORR)
    return f"""
WITH rf AS ({RATIO_SQL}),
base AS (SELECT * FROM rf WHERE NOT ({' AND '.join(f'{c} IS NULL' for c in _CORR)})),
okf AS (SELECT feature FROM ({nn}) WHERE nn > 0),
pairs AS (
{unions}
),
pp AS (SELECT * FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL
       AND feature_x IN (SELECT feature FROM okf) AND feature_y IN (SELECT feature FROM okf)),
r AS (
  SELECT feature_x, feature_y,
    rank() OVER (PARTITION BY feature_x, feature_y ORDER BY x) + (count(*) OVER (PARTITION BY feature_x, feature_y, x) - 1) / 2.0 AS rank_x,
    rank() OVER (PARTITION BY feature_x, feature_y ORDER BY y) + (count(*) OVER (PARTITION BY feature_x, feature_y, y) - 1) / 2.0 AS rank_y
  FROM pp
)
SELECT feature_x, feature_y, count(*) AS n, corr(rank_x, rank_y) AS rho FROM r GROUP BY ALL
"""


@register("spearman_pairs", _spearman_sql())
def spearman_pairs_q(spark, sf_dir):
    return st.spearman_pairs(ratio_features(spark, sf_dir), _CORR)


@register("lead_lag", f"""
WITH rf AS ({RATIO_SQL}),
x AS (
  SELECT firm, fiscal_year, provision_for_losses AS n_, leverage_ratio AS f_,
    count(*) OVER (PARTITION BY firm) AS rows_, count(provision_for_losses) OVER (PARTITION BY firm) AS nn,
    count(leverage_ratio) OVER (PARTITION BY firm) AS fn,
    lag(fiscal_year) OVER (PARTITION BY firm ORDER BY fiscal_year) AS from_year,
    provision_for_losses - lag(provision_for_losses) OVER (PARTITION BY firm ORDER BY fiscal_year) AS nlp_change,
    leverage_ratio - lag(leverage_ratio) OVER (PARTITION BY firm ORDER BY fiscal_year) AS fin_change
  FROM rf
)
SELECT firm, from_year, fiscal_year AS to_year, nlp_change,
  CASE WHEN nlp_change > 0 THEN 'UP' ELSE 'DOWN' END AS nlp_dir, fin_change,
  CASE WHEN fin_change > 0 THEN 'UP' ELSE 'DOWN' END AS fin_dir
FROM x WHERE rows_ >= 2 AND nn > 0 AND fn > 0 AND from_year IS NOT NULL
""")
def lead_lag(spark, sf_dir):
    return st.lead_lag(ratio_features(spark, sf_dir), "provision_for_losses", "leverage_ratio")


# ======================================================================
# Chart frames, pivots, outer merge
# ======================================================================
from ..operators import frames as fr  # noqa: E402

_PANEL_SERIES = ["leverage_ratio", "cash_coverage", "net_income", "provision_for_losses"]


@register("pivot_first", f"""
WITH rf AS ({RATIO_SQL})
SELECT firm, status, fiscal_year, min(leverage_ratio) AS leverage_ratio
FROM rf WHERE leverage_ratio IS NOT NULL GROUP BY firm, status, fiscal_year
""")
def pivot_first(spark, sf_dir):
    return sen.firm_year_cells(ratio_features(spark, sf_dir), "leverage_ratio").orderBy("status", "firm", "fiscal_year")


_SERIES_UNION = "\nUNION ALL\n".join(
    f"SELECT firm, fiscal_year, status, '{f}' AS feature, {f} AS value FROM rf" for f in _PANEL_SERIES)


@register("series_long", f"""
WITH rf AS ({RATIO_SQL}), s AS ({_SERIES_UNION})
SELECT * FROM s WHERE feature <> 'provision_for_losses' OR value IS NOT NULL
""")
def series_long(spark, sf_dir):
    return fr.series_long(ratio_features(spark, sf_dir), _PANEL_SERIES)


@register("dashboard_long", f"""
WITH rf AS ({RATIO_SQL}), s AS ({_SERIES_UNION})
SELECT firm, fiscal_year, status, feature, value FROM (
  SELECT *, count(value) OVER (PARTITION BY firm, feature) AS nn FROM s) WHERE nn > 0
""")
def dashboard_long(spark, sf_dir):
    return fr.dashboard_long(ratio_features(spark, sf_dir), _PANEL_SERIES)


@register("value_labels", f"""
WITH rf AS ({RATIO_SQL})
SELECT firm, fiscal_year,
  printf('$%.0fB', net_income / 1e9) AS net_income_label,
  printf('%.1f%%', equity_to_assets_pct) AS equity_pct_label
FROM rf
""")
def value_labels(spark, sf_dir):
    rf = ratio_features(spark, sf_dir)
    return rf.select("firm", "fiscal_year", fr.billions_label(F.col("net_income")).alias("net_income_label"),
                     fr.pct_label(F.col("equity_to_assets_pct")).alias("equity_pct_label"))


@register("event_annotations", f"""
WITH rf AS ({RATIO_SQL}),
mx AS (SELECT {', '.join(f'max({f}) AS {f}' for f in _PANEL_SERIES)} FROM rf),
h AS (SELECT feature, max_value, max_value * 0.9 AS y_pos FROM mx
      UNPIVOT (max_value FOR feature IN ({', '.join(_PANEL_SERIES)})))
SELECT feature, max_value, y_pos, event_year, label FROM h,
  (VALUES {', '.join(f"({y}, {O.sql_literal(lab)})" for y, lab in sorted(qual.C.CHART_EVENTS.items()))}) ev(event_year, label)
""")
def event_annotations(spark, sf_dir):
    return fr.event_annotations(ratio_features(spark, sf_dir), _PANEL_SERIES)


@register("distinct_firms", f"""
WITH p AS (SELECT * FROM ({_with(O.PANEL_CTE)} SELECT * FROM panel))
SELECT firm, min(fiscal_year) AS first_year FROM p GROUP BY firm
""")
def distinct_firms(spark, sf_dir):
    return fr.distinct_firms(S.panel(spark, sf_dir))


# ======================================================================
# Merged states: the tests over two batches of documents, no text read twice
# ======================================================================
from ..operators import state as sta  # noqa: E402
from ..session import scratch_path  # noqa: E402


def _two_batches(spark, sf_dir, reduce, merge):
    """The state after the labelled documents in English and then the others."""
    path = scratch_path(spark, "state")
    docs = S.labelled_features(spark, sf_dir, keep=["lang"])
    for i, part in enumerate((F.col("lang") == "en", ~F.coalesce(F.col("lang") == "en", F.lit(False)))):
        new = reduce(st.melt(docs.where(part), _STAT_FEATURES, ["status"]))
        state = sta.update(spark, path, i, new, merge)
    return state


@register("welch_merged", REGISTRY["welch_cohen"][1])
def welch_merged(spark, sf_dir):
    return st.welch(sta.group_moments(_two_batches(spark, sf_dir, sta.moments, sta.merge_moments)))


@register("mann_whitney_merged", REGISTRY["mann_whitney_u"][1])
def mann_whitney_merged(spark, sf_dir):
    state = _two_batches(spark, sf_dir, sta.counted, lambda a, b: sta.merge_counts(a, b, ["_cnt", "_c1"]))
    return st.mann_whitney_from_counts(state)


# ======================================================================
# Input order: first matches, order of appearance, sorted positions
# ======================================================================
from ..operators import order as od  # noqa: E402

_SEEN = "seen AS (SELECT *, row_number() OVER () AS r FROM {})"


@register("firms_by_appearance", f"""
WITH {_SEEN.format("orders")},
firsts AS (SELECT o_custkey AS cik, min(r) AS r FROM seen GROUP BY o_custkey)
SELECT f.cik, s.o_orderkey AS first_order, s.o_totalprice AS first_price,
  CAST(row_number() OVER (ORDER BY f.r) - 1 AS BIGINT) AS position
FROM firsts f JOIN seen s ON s.r = f.r
""")
def firms_by_appearance(spark, sf_dir):
    o = od.with_ordinal(_table(spark, sf_dir, "orders")).select(
        F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("first_order"), F.col("o_totalprice").alias("first_price"), od.ORDINAL)
    return od.in_order_of_appearance(o, ["cik"])


# The first line in file order of each order, looked up from the orders
@register("first_match_lookup", f"""
WITH {_SEEN.format("lineitem")},
firsts AS (SELECT l_orderkey, min(r) AS r FROM seen GROUP BY l_orderkey)
SELECT o.o_orderkey, s.l_partkey, s.l_suppkey, s.l_extendedprice
FROM orders o LEFT JOIN firsts f ON f.l_orderkey = o.o_orderkey LEFT JOIN seen s ON s.r = f.r
""")
def first_match_lookup(spark, sf_dir):
    li = od.with_ordinal(_table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", od.ORDINAL)
    first = od.first_in_order(li, ["l_orderkey"]).drop(od.ORDINAL)
    o = _table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


# Firms by status and name, each firm's years in order
@register("panel_positions", f"""
WITH p AS (SELECT * FROM ({_with(O.PANEL_CTE)} SELECT * FROM panel))
SELECT status, firm, fiscal_year,
  CAST(row_number() OVER (ORDER BY status NULLS FIRST, firm NULLS FIRST, fiscal_year NULLS FIRST) - 1 AS BIGINT) AS position FROM p
""")
def panel_positions(spark, sf_dir):
    p = S.panel(spark, sf_dir).select("status", "firm", "fiscal_year")
    return od.numbered(p, ["status", "firm", "fiscal_year"])


@register("sentiment_series", _SECTION_SENT_SQL + """
SELECT firm, fiscal_year, section, status, score, negative_pct FROM (
  SELECT s.firm, s.fiscal_year, s.section, d.status, s.sentiment_score AS score, s.negative_ratio * 100 AS negative_pct,
    count(s.sentiment_score) OVER (PARTITION BY s.firm, s.section) AS n1
  FROM section_sentiment s JOIN (SELECT DISTINCT firm, status FROM doc_sections) d USING (firm)
) WHERE n1 > 0
""")
def sentiment_series(spark, sf_dir):
    s = _section_sentiment_df(spark, sf_dir)
    st_ = S.doc_sections(spark, sf_dir).select("firm", "status").distinct()
    return fr.sentiment_series(s.join(st_, "firm"))


def _nations_nlp(spark, sf_dir):
    w = _nlp_wide_df(spark, sf_dir).drop("status", "ticker")
    # 12 years earlier, so that some firm-years match the panel and some do not
    return w.withColumn("firm", F.concat(F.lit("NATION_"), F.substring("firm", 4, 10))).withColumn(
        "fiscal_year", F.col("fiscal_year") - 12)


@register("combine_outer", f"""
WITH rf AS ({RATIO_SQL}),
nlp AS (SELECT * EXCLUDE (firm, status, ticker) REPLACE (fiscal_year - 12 AS fiscal_year), 'NATION_' || substring(firm, 4, 10) AS firm FROM ({NLP_WIDE_SQL}))
SELECT firm, fiscal_year, rf.leverage_ratio, rf.net_income, nlp.risk_section_wc, nlp.risk_total_crisis_density,
  nlp.hedging_language_pct
FROM rf FULL OUTER JOIN nlp USING (firm, fiscal_year)
""")
def combine_outer(spark, sf_dir):
    q = ratio_features(spark, sf_dir).select("firm", "fiscal_year", "leverage_ratio", "net_income")
    n = _nations_nlp(spark, sf_dir).select("firm", "fiscal_year", "risk_section_wc",
                                             "risk_total_crisis_density", "hedging_language_pct")
    return feat.combine_outer(q, n, ["firm", "fiscal_year"])


# ======================================================================
# Skip work already materialised
# ======================================================================
from ..operators import sinks as snk  # noqa: E402


@register("incremental_sections", f"""
WITH scaffold AS (SELECT doc_id, s.section FROM documents, (VALUES ('risk_factors'), ('mda')) s(section)),
done AS (SELECT DISTINCT doc_id, 'risk_factors' AS section FROM documents
         WHERE lang IN ('en', 'de') AND octet_length(encode(text)) > 500)
SELECT sc.doc_id, sc.section, CASE WHEN d.doc_id IS NOT NULL THEN 'cached' ELSE 'pending' END AS status
FROM scaffold sc LEFT JOIN done d ON sc.doc_id = d.doc_id AND sc.section = d.section
""")
def incremental_sections(spark, sf_dir):
    d = _table(spark, sf_dir, "documents", balance=True)
    scaffold = d.select("doc_id", F.explode(F.array(F.lit("risk_factors"), F.lit("mda"))).alias("section"))
    done = d.where(F.col("lang").isin("en", "de")).select(
        "doc_id", F.lit("risk_factors").alias("section"), F.col("text").alias("section_text"))
    return snk.work_status(scaffold, done, ["doc_id", "section"])


# ======================================================================
# Amounts near labels, unit multiplier, scraped rows, KWIC
# ======================================================================
def _statement_text(spark, sf_dir):
    s = S.statements(spark, sf_dir).drop("accession")
    return s.select("doc_id", TX.html_to_text_financial("html").alias("text"))


_STMT_BASE = (_with(O.STATEMENTS_CTE) + f", tx AS (SELECT doc_id, {O.html_sql('html', TX.FIN_BLOCK_TAGS, False)} "
              f"AS text FROM st),\n" + O.numbers_near_label_sql("tx").strip() + "\n")


def _label_numbers(t):
    """T6 rows of a text table, for the labels of all fields."""
    labels = [(field, k, p) for field, pats in qual.C.FIELD_PATTERNS.items() for k, p in enumerate(pats)]
    names = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("pattern_no")) for f, k, _ in labels])
    out = ex.number_rows(t, "text", [p for *_, p in labels], keep=["doc_id"]).withColumn("of", F.get(names, F.col("pattern_no")))
    return out.select("doc_id", "of.field", "of.pattern_no", "match_no", "value", "raw", "context", "position")


@register("numbers_near_label", _STMT_BASE + "SELECT * FROM nums")
def numbers_near_label(spark, sf_dir):
    return _label_numbers(_statement_text(spark, sf_dir))


# long statements: all 13 label patterns, several amounts per label
_FULL_BASE = (_with(O.full_statements_cte()) + f", tx AS (SELECT doc_id, {O.html_sql('html', TX.FIN_BLOCK_TAGS, False)} "
              f"AS text FROM st),\n" + O.numbers_near_label_sql("tx").strip() + "\n")


@register("numbers_all_labels", _FULL_BASE + "SELECT * FROM nums")
def numbers_all_labels(spark, sf_dir):
    s = S.full_statements(spark, sf_dir)
    return _label_numbers(s.select("doc_id", TX.html_to_text_financial("html").alias("text")))


@register("unit_multiplier", _with(O.STATEMENTS_CTE) + f""", tx AS (
  SELECT doc_id, {O.html_sql('html', TX.FIN_BLOCK_TAGS, False)} AS text FROM st)
SELECT doc_id, {O.unit_multiplier_sql('text')} AS unit_multiplier FROM tx
""")
def unit_multiplier_q(spark, sf_dir):
    t = _statement_text(spark, sf_dir)
    return t.select("doc_id", ex.unit_multiplier(F.col("text")).alias("unit_multiplier"))


# documents with a unit note before or after the text, by language
@register("unit_multiplier_docs", f"""
WITH noted AS (SELECT doc_id, CASE lang WHEN 'en' THEN text || chr(10) || '(Dollars in  millions)'
  WHEN 'fr' THEN 'Amounts in thousands' || chr(10) || text WHEN 'de' THEN text || ' IN BILLIONS' ELSE text END AS text
  FROM documents)
SELECT doc_id, {O.unit_multiplier_sql('text')} AS unit_multiplier FROM noted""")
def unit_multiplier_docs(spark, sf_dir):
    d = _table(spark, sf_dir, "documents", balance=True)
    lang, t = F.col("lang"), F.col("text")
    noted = (F.when(lang == "en", F.concat(t, F.lit("\n(Dollars in  millions)")))
             .when(lang == "fr", F.concat(F.lit("Amounts in thousands\n"), t))
             .when(lang == "de", F.concat(t, F.lit(" IN BILLIONS"))).otherwise(t))
    return d.select("doc_id", ex.unit_multiplier(noted).alias("unit_multiplier"))


def _scraped_row_sql(base: str) -> str:
    fields = list(qual.C.FIELD_PATTERNS)
    cols = ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) * unit_multiplier AS {f}" for f in fields)
    return base + f"""
, best AS (
  SELECT doc_id, field, value FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY abs(value) DESC, pattern_no, match_no) AS rn
    FROM nums) WHERE rn = 1
)
, units AS (SELECT doc_id, {O.unit_multiplier_sql('text')} AS unit_multiplier FROM tx)
SELECT u.doc_id, u.unit_multiplier, {cols}
FROM units u LEFT JOIN best b ON u.doc_id = b.doc_id
GROUP BY u.doc_id, u.unit_multiplier
"""


@register("scraped_row", _scraped_row_sql(_STMT_BASE))
def scraped_row(spark, sf_dir):
    return ex.scrape_filing(S.statements(spark, sf_dir).drop("accession"), "html", keep=["doc_id"])


@register("scraped_row_full", _scraped_row_sql(_FULL_BASE))
def scraped_row_full(spark, sf_dir):
    return ex.scrape_filing(S.full_statements(spark, sf_dir), "html", keep=["doc_id"])


KWIC_TERMS = ["the", "und", "que"]


@register("kwic_counts", "\nUNION ALL\n".join(
    f"SELECT doc_id, '{t}' AS term, CAST(len(regexp_extract_all(text, '(?i){t}')) AS INTEGER) AS n_matches FROM documents"
    for t in KWIC_TERMS))
def kwic_counts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents", balance=True)
    counts = [F.struct(F.lit(t).alias("term"), ex.keyword_in_context(F.col("text"), t)[0].alias("n_matches"))
              for t in KWIC_TERMS]
    return d.select("doc_id", F.explode(F.array(*counts)).alias("c")).select("doc_id", "c.*")


@register("kwic", O.kwic_sql(KWIC_TERMS))
def kwic(spark, sf_dir):
    d = _table(spark, sf_dir, "documents", balance=True)
    found = ex.keywords_in_context("text", KWIC_TERMS)
    return d.select("doc_id", F.inline(found)).select(
        "doc_id", "term", "n_matches", F.posexplode("snippets").alias("k", "snippet"))


# ======================================================================
# Structured facts with tag fallback (events as facts)
# ======================================================================
from ..operators import facts as fct  # noqa: E402

_PRIO_VALUES = ", ".join(f"('{f}', '{t}', {i})" for f, tags in S.EVENT_FIELD_TAGS.items()
                         for i, t in enumerate(tags))


@register("fact_tag_fallback", f"""
WITH facts AS (
  SELECT user_id AS cik, event_type AS tag, strftime(ts, '%Y-%m-%d') AS "end", value AS val,
    printf('%010d', event_id) AS accn, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS filed
  FROM events
),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, "end" ORDER BY filed DESC, accn DESC) AS rn
                 FROM facts) WHERE rn = 1
),
prio AS (SELECT * FROM (VALUES {_PRIO_VALUES}) p(field, tag, priority)),
ranked AS (
  SELECT l.cik, l."end", p.field, l.tag, l.val, l.accn, l.filed,
    row_number() OVER (PARTITION BY l.cik, l."end", p.field ORDER BY p.priority) AS rn2
  FROM latest l JOIN prio p ON l.tag = p.tag
)
SELECT cik, "end", field, tag, val, accn, filed FROM ranked WHERE rn2 = 1
""")
def fact_tag_fallback(spark, sf_dir):
    f = S.event_facts(spark, sf_dir)
    latest = fct.latest_facts(f)
    out = fct.facts_by_field(latest, fct.tag_priorities(spark, S.EVENT_FIELD_TAGS))
    return out.select("cik", "end", "field", "tag", "val", "accn", "filed")


# the same over durations, as filed by given days
_SHIP_PRIO = ", ".join(f"('{f}', '{t}', {i})" for f, tags in S.SHIP_FIELD_TAGS.items() for i, t in enumerate(tags))


@register("facts_as_filed", f"""
WITH line AS (
  SELECT l_suppkey AS cik, l_returnflag || l_linestatus AS tag,
    CAST(date_trunc('month', CAST(l_shipdate AS DATE) + CAST(l_linenumber * 40 AS INTEGER)) AS DATE) AS filed,
    CAST(l_quantity AS BIGINT) AS q, CAST(l_shipdate AS DATE) AS ship FROM lineitem),
facts AS (
  SELECT cik, tag, start, "end", filed, CAST(sum(q) AS BIGINT) AS val FROM (
    SELECT cik, tag, filed, q, CAST(date_trunc('quarter', ship) AS DATE) AS start,
      CAST(date_trunc('quarter', ship) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end" FROM line
    UNION ALL
    SELECT cik, tag, filed, q, CAST(date_trunc('year', ship) AS DATE),
      CAST(date_trunc('year', ship) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) FROM line)
  GROUP BY cik, tag, start, "end", filed),
spans AS (
  SELECT *, CASE WHEN "end" - start + 1 BETWEEN 80 AND 100 THEN 'quarter' WHEN "end" - start + 1 BETWEEN 350 AND 380 THEN 'year'
      ELSE 'other' END AS period FROM facts),
days AS (
  SELECT s_suppkey AS cik, CAST(d AS DATE) + CAST(s_suppkey % 97 AS INTEGER) AS as_of
  FROM supplier, (VALUES ('1996-05-31'), ('1998-02-01'), ('2001-02-01')) t(d)),
known AS (
  SELECT d.as_of, s.*, row_number() OVER (PARTITION BY s.cik, d.as_of, s.tag, s."end", s.period ORDER BY s.filed DESC) AS rn
  FROM spans s JOIN days d ON d.cik = s.cik AND s.filed <= d.as_of),
prio AS (SELECT * FROM (VALUES {_SHIP_PRIO}) p(field, tag, priority)),
best AS (
  SELECT k.*, p.field, row_number() OVER (PARTITION BY k.cik, k.as_of, k."end", k.period, p.field ORDER BY p.priority) AS rn2
  FROM known k JOIN prio p ON k.tag = p.tag WHERE k.rn = 1)
SELECT cik, CAST(as_of AS VARCHAR) AS as_of, field, period, CAST("end" AS VARCHAR) AS "end", tag, val, CAST(filed AS VARCHAR) AS filed
FROM best WHERE rn2 = 1
""")
def facts_as_filed(spark, sf_dir):
    f = S.ship_facts(spark, sf_dir).withColumn("period", fct.period_class())
    known = fct.as_filed(f, S.supplier_days(spark, sf_dir))
    out = fct.facts_by_field(known, fct.tag_priorities(spark, S.SHIP_FIELD_TAGS), keys=("cik", "as_of", "end", "period"))
    text = [F.col(c).cast("string").alias(c) for c in ("as_of", "end", "filed")]
    return out.select("cik", "field", "period", "tag", "val", *text)


# ======================================================================
# Flow 1 end to end: index -> annual filings -> firms -> HTML -> line items
# ======================================================================
from . import flows as fl  # noqa: E402

_MEAS = list(qual.C.MEASURES)


def _scraped_panel_sql() -> str:
    fields = list(qual.C.FIELD_PATTERNS)
    cols = ", ".join(f"max(CASE WHEN b.field = '{f}' THEN b.value END) * u.unit_multiplier AS {f}" for f in fields)
    return (_with(O.FILING_INDEX_CTE, O.ANNUAL_SQL, O.STATEMENTS_CTE)
            + f", tx AS (SELECT doc_id, accession, {O.html_sql('html', TX.FIN_BLOCK_TAGS, False)} AS text FROM st),\n"
            + O.numbers_near_label_sql("tx").strip() + f"""
, best AS (
  SELECT doc_id, field, value FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY abs(value) DESC, pattern_no, match_no) AS rn
    FROM nums) WHERE rn = 1
)
, units AS (SELECT doc_id, accession, {O.unit_multiplier_sql('text')} AS unit_multiplier FROM tx)
, scraped AS (
  SELECT u.accession, {cols}
  FROM units u LEFT JOIN best b ON u.doc_id = b.doc_id GROUP BY u.accession, u.unit_multiplier
)
, firms AS (
  SELECT c_name AS firm, printf('%010d', c_custkey) AS cik, 'C' || CAST(c_custkey AS VARCHAR) AS ticker,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'failed' ELSE 'survived' END AS status
  FROM customer
)
SELECT f.firm, f.ticker, f.status, a.fiscal_year, a.filing_date, a.accession, {', '.join('s.' + m for m in _MEAS)}
FROM annual a JOIN firms f ON a.cik = f.cik LEFT JOIN scraped s ON a.accession = s.accession
WHERE a.fiscal_year BETWEEN {FILING_YEARS[0]} AND {FILING_YEARS[1]}
""")


@register("scraped_panel", _scraped_panel_sql())
def scraped_panel(spark, sf_dir):
    recent, listing, pages = S.filing_index(spark, sf_dir)
    html = S.statements(spark, sf_dir).select("accession", "html")
    return fl.filings_to_panel(recent, listing, pages, html, S.customer_firms(spark, sf_dir), *FILING_YEARS)


# ======================================================================
# A7 test table, labelled triangle, F4 level-3 share, G7 all statuses,
# K3/J7 anti join, N1 model scorer, six series, page text
# ======================================================================
_TEST_LABELS = [("words", "Word Count"), ("marks", "Junk Marks"), ("n_chars", "Characters"), ("article_density", "Articles")]


@register("test_table", f"""
SELECT l.label AS "Feature", m.mean1 AS "Failed Mean", m.mean2 AS "Survived Mean", p.t_stat AS "t-stat",
  p.p_value AS "p-value",
  CASE WHEN sqrt((m.sd1 * m.sd1 + m.sd2 * m.sd2) / 2) > 0
    THEN (m.mean1 - m.mean2) / sqrt((m.sd1 * m.sd1 + m.sd2 * m.sd2) / 2) ELSE 0.0 END AS "Cohen's d",
  p.significant AS "Significant"
FROM ({_p_values_sql()}) p JOIN ({_MOMENTS_SQL} SELECT * FROM m) m USING (feature)
JOIN (VALUES {', '.join(f"('{f}', '{lab}')" for f, lab in _TEST_LABELS)}) l(feature, label) USING (feature)
""")
def test_table_q(spark, sf_dir):
    return st.test_table(S.labelled_features(spark, sf_dir), _TEST_LABELS)


_CORR_NAMES = {"leverage_ratio": "Leverage", "net_income": "Net Income", "cash_coverage": "Cash Coverage"}


@register("spearman_labelled", f"""
SELECT *, {', '.join(f"CASE {side} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _CORR_NAMES.items())} ELSE {side} END AS label_{side[-1]}"
                     for side in ('feature_x', 'feature_y'))}
FROM ({_spearman_sql()})
""")
def spearman_labelled(spark, sf_dir):
    return st.spearman_pairs(ratio_features(spark, sf_dir), _CORR, labels=_CORR_NAMES)


@register("level3_share", _with(O.PANEL_CTE) + """
SELECT firm, fiscal_year, cash_and_equivalents / 10 / NULLIF(total_assets, 0) * 100 AS level3_pct FROM panel
""")
def level3_share(spark, sf_dir):
    p = S.panel(spark, sf_dir).withColumn("fair_value_level3_assets", F.col("cash_and_equivalents") / 10)
    return feat.quantitative_features(p).select("firm", "fiscal_year", "level3_pct")


@register("extraction_statuses", SECTIONS_BASE + """
SELECT section, CASE WHEN doc_id % 5 = 0 THEN 'cached' WHEN doc_id % 7 = 0 THEN 'no_html'
  WHEN section_text IS NULL OR doc_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n
FROM secs GROUP BY ALL
""")
def extraction_statuses(spark, sf_dir):
    f = S.doc_filings(spark, sf_dir).withColumn(
        # every third filing has no item headers, every seventh no text
        "filing", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, F.lit("no items"))
        .otherwise(F.col("filing")))
    s = ex.extract_sections(f.withColumn("has_text", F.col("filing").isNotNull()), "filing", keep=["doc_id", "has_text"])
    s = s.withColumn("written", F.col("doc_id") % 5 == 0)
    return ex.extraction_status(s, cached="written").groupBy("section", "status").agg(F.count(F.lit(1)).alias("n"))


@register("pending_sections", """
SELECT doc_id, s.section FROM documents, (VALUES ('risk_factors'), ('mda')) s(section)
WHERE NOT (s.section = 'mda' AND lang IN ('fr', 'en') AND octet_length(encode(text)) > 500)
""")
def pending_sections(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    work = d.select("doc_id", F.explode(F.array(F.lit("risk_factors"), F.lit("mda"))).alias("section"))
    done = d.where(F.col("lang").isin("fr", "en")).select(
        "doc_id", F.lit("mda").alias("section"), F.col("text").alias("section_text"))
    return snk.pending_work(work, done, ["doc_id", "section"])


def _length_model(texts):
    """A fixed batch predictor: the share of a letter decides."""
    out = []
    for t in texts:
        share = t.count("e") / max(1, len(t))
        out.append(("positive" if share > 0.13 else "negative" if share < 0.1 else "neutral", share))
    return out


@register("model_scores", _SENT_BASE + f"""
, q AS (SELECT *, (length(sentence) - length(replace(sentence, 'e', ''))) / length(sentence) AS share
  FROM sentences WHERE {O.quality_sql('sentence')})
SELECT doc_id, sentence_no, CASE WHEN share > 0.13 THEN 'positive' WHEN share < 0.1 THEN 'negative' ELSE 'neutral' END AS label,
  share AS score FROM q
""")
def model_scores(spark, sf_dir):
    q = sen.quality_sentences(_table(spark, sf_dir, "documents", balance=True).select("doc_id", "text"), "text", ["doc_id"])
    return sen.score_sentences(q, sen.model_scorer(_length_model)).drop("text")


# the same model, made by a loader in each worker, on the first 15 tokens
CUT_TOKENS = 15


@register("model_scores_cut", _SENT_BASE + f"""
, c AS (SELECT doc_id, sentence_no, regexp_extract(sentence, '^{TX.WS}*(?:{TX.NON_WS}+{TX.WS}+){{0,{CUT_TOKENS - 1}}}{TX.NON_WS}+') AS cut
  FROM sentences WHERE {O.quality_sql('sentence')})
, q AS (SELECT *, (length(cut) - length(replace(cut, 'e', ''))) / length(cut) AS share FROM c)
SELECT doc_id, sentence_no, CASE WHEN share > 0.13 THEN 'positive' WHEN share < 0.1 THEN 'negative' ELSE 'neutral' END AS label,
  share AS score FROM q
""")
def model_scores_cut(spark, sf_dir):
    q = sen.quality_sentences(_table(spark, sf_dir, "documents", balance=True).select("doc_id", "text"), "text", ["doc_id"])
    scorer = sen.model_scorer(load=lambda: _length_model, max_tokens=CUT_TOKENS)
    return sen.score_sentences(q, scorer).drop("text")


_SIX = ["leverage_ratio", "cash_coverage", "net_income", "provision_for_losses", "risk_total_crisis_density", "risk_section_wc"]
_SIX_BASE = f"""
WITH rf AS ({RATIO_SQL}),
nlp AS (SELECT * EXCLUDE (firm, status, ticker) REPLACE (fiscal_year - 12 AS fiscal_year), 'NATION_' || substring(firm, 4, 10) AS firm
        FROM ({NLP_WIDE_SQL})),
six AS (SELECT firm, fiscal_year, rf.status, leverage_ratio, cash_coverage, net_income, provision_for_losses,
  risk_total_crisis_density, CAST(risk_section_wc AS DOUBLE) AS risk_section_wc
  FROM rf FULL OUTER JOIN nlp USING (firm, fiscal_year)),
s AS ({" UNION ALL ".join(f"SELECT firm, fiscal_year, status, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM six" for f in _SIX)})
"""


def _six_df(spark, sf_dir):
    q = ratio_features(spark, sf_dir).drop("ticker")
    n = _nations_nlp(spark, sf_dir).select("firm", "fiscal_year", "risk_total_crisis_density", "risk_section_wc")
    return feat.combine_outer(q, n, ["firm", "fiscal_year"])


@register("six_series", _SIX_BASE + "SELECT * FROM s WHERE feature <> 'provision_for_losses' OR value IS NOT NULL")
def six_series(spark, sf_dir):
    return fr.series_long(_six_df(spark, sf_dir), _SIX)


@register("six_dashboard", _SIX_BASE + """
SELECT firm, fiscal_year, status, feature, value FROM (
  SELECT *, count(value) OVER (PARTITION BY firm, feature) AS nn FROM s) WHERE nn > 0
""")
def six_dashboard(spark, sf_dir):
    return fr.dashboard_long(_six_df(spark, sf_dir), _SIX)


@register("page_metrics", f"""
WITH t AS (SELECT page_id, {O.html_sql('html', TX.SECTION_BLOCK_TAGS, True)} AS text FROM pages)
SELECT page_id, {O.word_count_sql('text')} AS words, CAST(length(text) AS INTEGER) AS n_chars,
  {O.unit_multiplier_sql('text')} AS unit_multiplier,
  CAST(len(regexp_extract_all(text, '(?i)the')) AS INTEGER) AS n_the FROM t
""")
def page_metrics(spark, sf_dir):
    t = _table(spark, sf_dir, "pages", balance=True).select("page_id", TX.html_to_text_section("html").alias("text"))
    return t.select("page_id", TX.word_count("text").alias("words"), F.length("text").alias("n_chars"),
                    ex.unit_multiplier("text").alias("unit_multiplier"),
                    ex.keyword_in_context("text", "the")[0].alias("n_the"))
