"""DuckDB SQL for the registered queries (the correctness oracle).

Each query repeats the shaping of ``shapes.py`` in SQL. DuckDB's regex is
RE2 (no look-around), so a few text queries are phrased with marker
characters instead. Python-whitespace class ``WS`` is shared with the
Spark side (both RE2 and Java accept it).
"""

from __future__ import annotations

from ..functions.text import NON_WS, WS
from .shapes import DOC_HEDGING, DOC_LEXICON

PANEL_CTE = """
per_order AS (
  SELECT l_orderkey,
    SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS assets,
    SUM(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS equity,
    SUM(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT)) AS cash,
    SUM(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS stb,
    SUM(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_extendedprice * 100) AS BIGINT)
             WHEN l_returnflag = 'N' THEN -CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS income,
    SUM(CASE WHEN l_linestatus = 'F' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS prov
  FROM lineitem GROUP BY l_orderkey
),
panel_g AS (
  SELECT n_name, n_nationkey, r_name, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
    SUM(assets) AS assets, SUM(equity) AS equity, SUM(cash) AS cash, SUM(stb) AS stb,
    SUM(income) AS income, SUM(prov) AS prov
  FROM per_order
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
),
panel AS (
  SELECT n_name AS firm, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ticker,
    CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN 'failed' ELSE 'survived' END AS status,
    fiscal_year,
    CAST(assets AS DOUBLE) / 100.0 AS total_assets,
    CAST(assets * 100 - equity AS DOUBLE) / 10000.0 AS total_liabilities,
    CAST(equity AS DOUBLE) / 10000.0 AS stockholders_equity,
    CAST(cash AS DOUBLE) / 10000.0 AS cash_and_equivalents,
    CAST(stb AS DOUBLE) / 100.0 AS short_term_borrowings,
    CAST(income AS DOUBLE) / 100.0 AS net_income,
    CASE WHEN r_name = 'EUROPE' THEN NULL ELSE CAST(prov AS DOUBLE) / 100.0 END AS provision_for_loan_losses
  FROM panel_g
)"""

SUPPLIER_PANEL_CTE = """
per_supp AS (
  SELECT l_suppkey, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
    SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS assets,
    SUM(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS equity,
    SUM(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT)) AS cash,
    SUM(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS stb,
    SUM(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_extendedprice * 100) AS BIGINT)
             WHEN l_returnflag = 'N' THEN -CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS income,
    SUM(CASE WHEN l_linestatus = 'F' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS prov
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY ALL
),
ref_g AS (
  SELECT n_name, n_nationkey, r_name, fiscal_year,
    SUM(assets) AS assets, SUM(equity) AS equity, SUM(cash) AS cash, SUM(stb) AS stb,
    SUM(income) AS income, SUM(prov) AS prov
  FROM per_supp
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
),
ref_panel AS (
  SELECT n_name AS firm, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ticker,
    CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN 'failed' ELSE 'survived' END AS status,
    fiscal_year,
    CAST(assets AS DOUBLE) / (100.0 * 1000000.0) AS total_assets,
    CAST(assets * 100 - equity AS DOUBLE) / (10000.0 * 1000000.0) AS total_liabilities,
    CAST(equity AS DOUBLE) / (10000.0 * 1000000.0) AS stockholders_equity,
    CAST(cash AS DOUBLE) / (10000.0 * 1000000.0) AS cash_and_equivalents,
    CAST(stb AS DOUBLE) / (100.0 * 1000000.0) AS short_term_borrowings,
    CAST(income AS DOUBLE) / (100.0 * 1000000.0) AS net_income,
    CASE WHEN r_name = 'MIDDLE EAST' THEN NULL ELSE CAST(prov AS DOUBLE) / (100.0 * 1000000.0) END
      AS provision_for_loan_losses
  FROM ref_g
)"""

DOC_SECTIONS_CTE = """
doc_sections AS (
  SELECT doc_id, source AS firm, upper(source) AS ticker,
    CASE WHEN length(source) = 4 THEN 'failed' ELSE 'survived' END AS status,
    2000 + CAST(floor(log2(n_chars + 1)) AS INTEGER) AS fiscal_year,
    CASE WHEN lang IN ('en', 'de') THEN 'risk_factors' ELSE 'mda' END AS section,
    text
  FROM documents
)"""


def sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def term_count_sql(text: str, terms) -> str:
    lt = f"lower({text})"
    parts = [f"((length({lt}) - length(replace({lt}, {sql_literal(t.lower())}, ''))) "
             f"// {len(t)})" for t in terms]
    return "(" + " + ".join(parts) + ")"


def word_count_sql(text: str) -> str:
    return (f"CASE WHEN {text} IS NULL OR {text} = '' THEN NULL "
            f"ELSE CAST(len(regexp_extract_all({text}, '{NON_WS}+')) AS BIGINT) END")


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def doc_metrics_cte(lexicon=DOC_LEXICON, hedging=DOC_HEDGING) -> str:
    """Per-key summed counts (the Spark ``section_metrics`` + ``sum_metrics``)."""
    cols = [f"CAST(SUM({word_count_sql('text')}) AS BIGINT) AS wc"]
    for cat, terms in lexicon.items():
        cols.append(f"CAST(SUM(CASE WHEN text IS NULL OR text = '' THEN NULL ELSE {term_count_sql('text', terms)} END) AS BIGINT) AS {cat}_count")
    cols.append(f"CAST(SUM(CASE WHEN text IS NULL OR text = '' THEN NULL ELSE {term_count_sql('text', hedging)} END) AS BIGINT) AS hedge_count")
    return ("doc_metrics AS (\n  SELECT firm, ticker, status, fiscal_year, section,\n    "
            + ",\n    ".join(cols) + "\n  FROM doc_sections GROUP BY ALL\n)")


def density_sql(count: str, wc: str, per: str) -> str:
    return f"CASE WHEN {wc} IS NULL THEN NULL WHEN {wc} > 0 THEN {count} / {wc} * {per} ELSE 0.0 END"

DISTORTED_CTE = """
distorted AS (
  SELECT firm, ticker, status, fiscal_year,
    CASE WHEN fiscal_year = 2001 AND status = 'survived' THEN total_assets * 1000.0 ELSE total_assets END AS total_assets,
    CASE WHEN fiscal_year = 1996 THEN total_assets ELSE total_liabilities END AS total_liabilities,
    CASE WHEN fiscal_year = 1998 AND status = 'failed' THEN stockholders_equity * 100.0 ELSE stockholders_equity END AS stockholders_equity,
    cash_and_equivalents, short_term_borrowings,
    CASE WHEN fiscal_year = 2000 THEN total_assets ELSE net_income END AS net_income,
    provision_for_loan_losses
  FROM panel
)"""

GAPPY_CTE = """
gappy AS (
  SELECT firm, ticker, status, fiscal_year, total_assets, total_liabilities, stockholders_equity,
    CASE WHEN fiscal_year = 1995 THEN NULL ELSE cash_and_equivalents END AS cash_and_equivalents,
    short_term_borrowings,
    CASE WHEN fiscal_year = 2001 AND status = 'failed' THEN NULL ELSE net_income END AS net_income,
    provision_for_loan_losses
  FROM panel
)"""

VALIDATION_INPUT_CTE = """
scraped AS (
  SELECT * REPLACE (CASE WHEN fiscal_year = 1995 AND status = 'survived' THEN firm || ' (former)' ELSE firm END AS firm)
  FROM distorted
),
reference AS (
  SELECT CASE WHEN fiscal_year = 2001 THEN firm || ' (restated)' ELSE firm END AS firm, ticker, status, fiscal_year,
    total_assets * 1000000.0 AS total_assets, total_liabilities * 1000000.0 AS total_liabilities,
    stockholders_equity * 1000000.0 AS stockholders_equity,
    cash_and_equivalents * 1000000.0 AS cash_and_equivalents,
    short_term_borrowings * 1000000.0 AS short_term_borrowings,
    net_income * 1000000.0 AS net_income,
    provision_for_loan_losses * 1000000.0 AS provision_for_loan_losses
  FROM ref_panel
)"""


def sanity_flags_sql(prefix: str = "") -> str:
    ta, tl, se, ni = (f"{prefix}total_assets", f"{prefix}total_liabilities",
                      f"{prefix}stockholders_equity", f"{prefix}net_income")
    diff = f"(abs({ta} - ({tl} + {se})) / {ta} * 100)"
    f1 = (f"CASE WHEN {ta} IS NOT NULL AND {ta} > 0 AND {tl} IS NOT NULL "
          f"AND abs({tl} - {ta}) / {ta} < 0.01 THEN 'liabilities=assets' END")
    f2 = (f"CASE WHEN {ta} IS NOT NULL AND {ta} > 0 AND {tl} IS NOT NULL AND {se} IS NOT NULL "
          f"AND {diff} > 10 THEN 'balance_off_' || CAST(CAST(round_even({diff}, 0) AS BIGINT) AS VARCHAR) || '%' END")
    f3 = (f"CASE WHEN {ta} IS NOT NULL AND {ta} > 0 AND {ni} IS NOT NULL "
          f"AND abs({ni}) / {ta} > 0.5 THEN 'net_income_suspicious' END")
    return f"concat_ws('; ', {f1}, {f2}, {f3})"


def jump_sql(col: str, src: str) -> str:
    prev = (f"last_value({col} IGNORE NULLS) OVER (PARTITION BY firm ORDER BY fiscal_year "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return f"({col} IS NOT NULL AND {prev} IS NOT NULL AND {prev} <> 0 AND abs({col} / NULLIF({prev}, 0)) > 100)"

FILING_INDEX_CTE = """
entries AS (
  SELECT printf('%010d', o_custkey) AS cik, o_orderkey, o_orderpriority, o_orderstatus,
    CAST(floor(o_orderkey / 64) AS BIGINT) AS page_no,
    CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-K/A'
      WHEN '3-MEDIUM' THEN '10-Q' WHEN '4-NOT SPECIFIED' THEN '10-K' ELSE '8-K' END AS form,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS filingDate,
    printf('%010d', o_custkey) || '-' || strftime(o_orderdate, '%y') || '-'
      || printf('%010d', o_orderkey) AS accessionNumber,
    'd' || CAST(o_orderkey AS VARCHAR) || '.htm' AS primaryDocument,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(CAST(o_orderdate AS DATE) - INTERVAL 2 MONTH, '%Y-%m-%d') END AS reportDate
  FROM orders
),
packed0 AS (
  SELECT cik, page_no,
    list(form ORDER BY o_orderkey) AS form, list(filingDate ORDER BY o_orderkey) AS filingDate,
    list(accessionNumber ORDER BY o_orderkey) AS accessionNumber,
    list(primaryDocument ORDER BY o_orderkey) AS primaryDocument,
    list(reportDate ORDER BY o_orderkey) AS reportDate,
    arg_min(o_orderpriority, o_orderkey) AS prio, arg_min(o_orderstatus, o_orderkey) AS status
  FROM entries GROUP BY ALL
),
packed AS (
  SELECT cik, page_no, prio, status, form, filingDate, accessionNumber, primaryDocument,
    CASE WHEN status = 'F' THEN reportDate[1:len(reportDate) - 1] ELSE reportDate END AS reportDate,
    'CIK' || cik || '-submissions-' || printf('%010d', page_no) || '.json' AS name,
    page_no = min(page_no) OVER (PARTITION BY cik) AS is_recent
  FROM packed0
),
blocks AS (
  SELECT cik, '' AS page, form, filingDate, accessionNumber, primaryDocument, reportDate FROM packed WHERE is_recent
  UNION ALL
  SELECT cik, name AS page, form, filingDate, accessionNumber, primaryDocument, reportDate
  FROM packed WHERE NOT is_recent AND prio <> '5-LOW' AND status <> 'P'
),
records AS (
  SELECT cik, page, CAST(i - 1 AS INTEGER) AS entry_no,
    coalesce(form[i], '') AS form, coalesce(filingDate[i], '') AS filingDate,
    coalesce(accessionNumber[i], '') AS accessionNumber, coalesce(primaryDocument[i], '') AS primaryDocument,
    coalesce(reportDate[i], '') AS reportDate
  FROM (SELECT *, unnest(generate_series(1, len(form))) AS i FROM blocks)
)"""

ANNUAL_SQL = """
annual AS (
  SELECT cik, accessionNumber AS accession, filingDate AS filing_date, primaryDocument AS primary_doc,
    CASE WHEN length(reportDate) >= 4 THEN CAST(substr(reportDate, 1, 4) AS INTEGER)
         WHEN CAST(substr(filingDate, 6, 2) AS INTEGER) <= 4 THEN CAST(substr(filingDate, 1, 4) AS INTEGER) - 1
         ELSE CAST(substr(filingDate, 1, 4) AS INTEGER) END AS fiscal_year
  FROM records WHERE form = '10-K' AND filingDate <> ''
)"""

M1_SQL, M2_SQL = "chr(57344)", "chr(57345)"


def py_pattern_sql(p: str, ci: bool = True) -> str:
    from ..functions.text import py_regex
    return sql_literal(("(?i)" if ci else "") + py_regex(p, "re2"))


def normalize_ws_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def html_sql(text: str, block_tags: str, section: bool) -> str:
    from ..functions.text import html_steps
    x = text
    for pat, rep, ci in html_steps(block_tags, "re2"):
        rep_sql = "chr(10)" if rep == "\n" else sql_literal(rep)
        pat_sql = "chr(160)" if pat == " " else sql_literal(("(?i)" if ci else "") + pat)
        x = f"regexp_replace({x}, {pat_sql}, {rep_sql}, 'g')"
    if section:
        x = f"regexp_replace({x}, chr(10) || '{WS}*' || chr(10), chr(10) || chr(10), 'g')"
        x = strip_sql(x)
    return x


def section_sql(text: str, starts, ends, min_chars: int = 500) -> str:
    """T4 in DuckDB with the same marker technique as the Spark side."""
    cands = []
    for sp in starts:
        marked = f"regexp_replace({text}, {py_pattern_sql(sp)}, {M1_SQL} || '\\0' || {M2_SQL}, 'g')"
        tail = f"string_split({marked}, {M1_SQL})[-1]"
        found = f"contains({marked}, {M1_SQL})"
        match = f"string_split({tail}, {M2_SQL})[1]"
        rest = f"coalesce(string_split({tail}, {M2_SQL})[2], '')"
        for ep in ends:
            parts = f"string_split_regex({rest}, {py_pattern_sql(ep)})"
            sec = normalize_ws_sql(f"({match} || {parts}[1])")
            cands.append(f"CASE WHEN {found} AND len({parts}) >= 2 AND length({sec}) > {min_chars} THEN {sec} END")
        fb = normalize_ws_sql(f"({match} || {rest})")
        cands.append(f"CASE WHEN {found} AND length({fb}) > {min_chars} THEN {fb} END")
    return "coalesce(" + ",\n    ".join(cands) + ")"


DOC_FILINGS_CTE = """
doc_filings AS (
  SELECT doc_id, lang,
    'TABLE OF CONTENTS' || chr(10) || 'Item 1A. Risk Factors 12' || chr(10) || 'Item 1B. Unresolved Staff Comments 20' || chr(10)
    || 'Item 7. Management''s Discussion and Analysis 31' || chr(10) || 'Item 8. Financial Statements 55' || chr(10) || chr(10)
    || CASE WHEN lang = 'fr' THEN 'ITEM 1A (continued) - RISK FACTORS' || chr(10)
            WHEN lang = 'es' THEN 'Risk Factors' || chr(10)
            ELSE 'Item 1A. Risk Factors' || chr(10) END
    || coalesce(text, '')
    || CASE WHEN lang = 'fr' THEN chr(10) || 'Item 2. Properties' || chr(10) || 'None.' || chr(10)
            WHEN lang = 'es' THEN chr(10)
            ELSE chr(10) || 'Item 1B. Unresolved Staff Comments' || chr(10) || 'None.' || chr(10) END
    || CASE WHEN lang = 'de' THEN 'Management' || chr(8217) || 's Discussion and Analysis' || chr(10)
            ELSE 'Item 7. Management''s Discussion and Analysis' || chr(10) END
    || coalesce(text, '')
    || CASE WHEN lang = 'de' THEN chr(10) || 'Item 7A. Market Risk' || chr(10)
            WHEN lang = 'es' THEN chr(10)
            ELSE chr(10) || 'Item 8. Financial Statements' || chr(10) END AS filing
  FROM documents
)"""

SENTENCES_CTE = f"""
sent_raw AS (
  SELECT doc_id, list_filter(list_transform(
      string_split(regexp_replace(text, '([.!?]){WS}+([A-Z])', '\\1' || chr(57344) || '\\2', 'g'), chr(57344)),
      lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: s <> '') AS ss
  FROM documents
),
sentences AS (
  SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS sentence_no, unnest(ss) AS sentence FROM sent_raw
)"""


def quality_sql(s: str) -> str:
    from .. import config as C
    from ..functions.text import NON_WS, py_regex
    bp = "(?i)^(?:" + "|".join(py_regex(p, "re2") for p in C.BOILERPLATE_PREFIXES) + ")"
    nw = f"len(regexp_extract_all({s}, '{NON_WS}+'))"
    alpha = f"length(regexp_replace({s}, '[^\\pL]', '', 'g'))"
    return (f"({nw} BETWEEN {C.SENTENCE_MIN_WORDS} AND {C.SENTENCE_MAX_WORDS} "
            f"AND (length({s}) = 0 OR {alpha} / length({s}) >= {C.SENTENCE_MIN_ALPHA}) "
            f"AND NOT regexp_matches({s}, {sql_literal(bp)}))")


def scored_cte(pos, neg) -> str:
    p, n = term_count_sql("sentence", pos), term_count_sql("sentence", neg)
    return f"""
qsent AS (SELECT * FROM sentences WHERE {quality_sql('sentence')}),
counted AS (SELECT doc_id, sentence_no, sentence AS text, {p} AS pos, {n} AS neg FROM qsent),
scored AS (
  SELECT doc_id, sentence_no, text,
    CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS label,
    0.5 + 0.5 * abs(pos - neg) / (pos + neg + 1) AS score
  FROM counted
)"""

LABELLED_CTE = f"""
labelled AS (
  SELECT d.doc_id, CASE WHEN quality = 0 THEN 'failed' ELSE 'survived' END AS status,
    CAST(n_chars AS DOUBLE) AS n_chars,
    CAST({word_count_sql('text')} AS DOUBLE) AS words,
    CAST({term_count_sql('text', ['the'])} / NULLIF({word_count_sql('text')}, 0) AS DOUBLE) * 1000.0 AS article_density,
    CAST(toxic AS DOUBLE) AS toxic,
    CAST(length(regexp_replace(text, '[^#|*!&%$]', '', 'g')) AS DOUBLE) AS marks
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
long AS (
  SELECT status, feature, value FROM labelled
  UNPIVOT (value FOR feature IN (n_chars, words, article_density, toxic, marks))
)"""

STATEMENTS_CTE = """
st AS (
  SELECT o_orderkey AS doc_id,
    printf('%010d', o_custkey) || '-' || strftime(o_orderdate, '%y') || '-' || printf('%010d', o_orderkey) AS accession,
    '<html><body><h2>Consolidated Statement of Condition</h2><p>'
    || CASE o_orderpriority WHEN '1-URGENT' THEN '(in thousands)' WHEN '2-HIGH' THEN '(Dollars in millions)'
         WHEN '5-LOW' THEN 'in millions, except in thousands' ELSE '' END
    || '</p><table>'
    || '<tr><td>Total assets</td><td>$ ' || format('{:,.2f}', o_totalprice) || '</td></tr>'
    || '<tr><td>Total liabilities (1)</td><td>' || format('{:,}', CAST(floor(o_totalprice * 11 / 12) AS BIGINT)) || '</td></tr>'
    || '<tr><td>Total liabilities and equity</td><td>' || format('{:,.2f}', o_totalprice) || '</td></tr>'
    || '<tr><td>Total stockholders&#8217; equity</td><td>'
    || CASE WHEN o_orderstatus = 'F' THEN '(' || format('{:,}', CAST(floor(o_totalprice / 12) AS BIGINT)) || ')'
            ELSE format('{:,}', CAST(floor(o_totalprice / 12) AS BIGINT)) END || '</td></tr>'
    || '<tr><td>Cash and cash equivalents</td><td>'
    || CASE WHEN o_orderstatus = 'O' THEN 'December 31, ' ELSE '' END || format('{:,}', o_custkey * 3) || '</td></tr>'
    || CASE WHEN o_orderstatus <> 'P' THEN '<tr><td>Short-term borrowings</td><td>' || format('{:,}', o_orderkey)
            || '</td></tr>' ELSE '' END
    || '<tr><td>Net income<br/>' || format('{:,}', CAST(floor(o_totalprice / 40) AS BIGINT)) || '</td></tr>'
    || '</table></body></html>' AS html
  FROM orders
)"""


def full_statements_cte() -> str:
    """The long statements of ``shapes.full_statements`` as the CTE ``st``."""
    from .shapes import FULL_LINES
    parts = []
    for i, (label, first, second) in enumerate(FULL_LINES):
        amount = f"format('{{:,}}', CAST({first} AS BIGINT))"
        parts.append(sql_literal(f"<tr><td>{label}</td><td>"))
        parts.append(f"CASE WHEN (n + {i}) % 6 = 0 THEN '(' || {amount} || ')' ELSE {amount} END || '</td>'")
        if second:
            parts.append(f"'<td>' || format('{{:,}}', CAST({second} AS BIGINT)) || '</td>'")
        parts.append("'</tr>'")
    return f"""
cust AS (SELECT c_custkey AS n, CAST(floor(abs(c_acctbal)) AS BIGINT) AS v, c_mktsegment FROM customer),
st AS (
  SELECT n AS doc_id, '<html><body><p>' || CASE c_mktsegment WHEN 'BUILDING' THEN '(Amounts in millions, except shares)'
      WHEN 'MACHINERY' THEN 'in thousands of dollars' WHEN 'FURNITURE' THEN '(in billions)' ELSE '' END || '</p><table>'
    || {" || ".join(parts)} || '</table></body></html>' AS html
  FROM cust
)"""


def _label_matches_sql(field: str, pno: int, pattern: str, text_cte: str) -> str:
    """Label matches of one pattern with their windows, by marker positions.
    A trailing negative look-ahead ``(?!X)`` (RE2 has none) is applied as a
    filter on the text after the match: a rejected candidate cannot hide
    another match, since every match starts with the pattern's first word."""
    from .. import config as C
    look = None
    core = pattern
    if pattern.endswith(")") and "(?!" in pattern:
        i = pattern.rindex("(?!")
        core, look = pattern[:i], pattern[i + 3:-1]
    pat = py_pattern_sql(core).replace("'(?i)", "'(?im)", 1)
    keep = "TRUE" if look is None else f"NOT regexp_matches(after, {py_pattern_sql('^' + look)})"
    return f"""
SELECT doc_id, '{field}' AS field, {pno} AS pattern_no, k, label, win, pos FROM (
  SELECT doc_id, k, label, pos, substring(text, pos + length(label) + 1, {C.NUMBER_WINDOW}) AS win,
    substring(text, pos + length(label) + 1) AS after
  FROM (
    SELECT doc_id, text, k, string_split(segs[k], {M2_SQL})[1] AS label,
      CAST(length(segs[1]) + coalesce(list_sum(list_transform(segs[2:k - 1], lambda s: length(s) - 1)), 0) AS BIGINT) AS pos
    FROM (SELECT doc_id, text, string_split(regexp_replace(text, {pat}, {M1_SQL} || '\\0' || {M2_SQL}, 'g'), {M1_SQL}) AS segs
          FROM {text_cte}),
      LATERAL (SELECT unnest(generate_series(2, len(segs))) AS k)
  )
) WHERE {keep}"""


def numbers_near_label_sql(text_cte: str = "tx") -> str:
    """T6 for every field pattern, as rows (doc_id, field, pattern_no,
    match_no, value, raw, context)."""
    from .. import config as C
    from ..functions.text import py_regex
    num = sql_literal(py_regex(C.NUMBER_PATTERN, "re2"))
    parts = []
    for field, pats in C.FIELD_PATTERNS.items():
        for pno, p in enumerate(pats):
            parts.append(_label_matches_sql(field, pno, p, text_cte))
    labels = "\nUNION ALL\n".join(parts)
    return f"""
lm AS ({labels}),
lmn AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, field, pattern_no ORDER BY k) - 1 AS INTEGER) AS match_no,
    regexp_extract_all(win, {num}, 0) AS toks0, regexp_extract_all(win, {num}, 1) AS toks1
  FROM lm
),
firsts AS (
  SELECT *, list_filter(range(1, len(toks1) + 1),
                        lambda i: TRY_CAST(replace(toks1[i], ',', '') AS DOUBLE) >= {float(C.NUMBER_MIN_VALUE)})[1] AS idx
  FROM lmn
),
nums AS (
  SELECT doc_id, field, pattern_no, match_no,
    CASE WHEN contains(toks0[idx], '(') AND contains(toks0[idx], ')')
         THEN -TRY_CAST(replace(toks1[idx], ',', '') AS DOUBLE)
         ELSE TRY_CAST(replace(toks1[idx], ',', '') AS DOUBLE) END AS value,
    {strip_sql('toks0[idx]')} AS raw,
    {strip_sql("replace(label || substring(win, 1, " + str(C.CONTEXT_AFTER) + "), chr(10), ' ')")} AS context,
    CAST(pos AS INTEGER) AS position
  FROM firsts WHERE idx IS NOT NULL
)"""


def unit_multiplier_sql(text: str) -> str:
    from .. import config as C
    whens = " ".join(f"WHEN regexp_matches(lower({text}), {py_pattern_sql(p, ci=False)}) THEN {m}"
                     for p, m in C.UNIT_PATTERNS)
    return f"CAST(CASE {whens} ELSE 1 END AS BIGINT)"


def kwic_sql(terms, before: int = 20, after: int = 50) -> str:
    """T17 snippets by marker positions: text[max(0, start-20) : end+50],
    stripped, all matches per (doc, term)."""
    parts = []
    for t in terms:
        pat = py_pattern_sql(t)
        parts.append(f"""
SELECT doc_id, '{t}' AS term, n_matches, CAST(k - 2 AS INTEGER) AS k,
  {strip_sql(f"substring(text, greatest(pos - {before}, 0) + 1, pos - greatest(pos - {before}, 0) + length(hit) + {after})")} AS snippet
FROM (
  SELECT doc_id, text, k, n_matches, string_split(segs[k], {M2_SQL})[1] AS hit,
    CAST(length(segs[1]) + coalesce(list_sum(list_transform(segs[2:k - 1], lambda s: length(s) - 1)), 0) AS BIGINT) AS pos
  FROM (SELECT doc_id, text, CAST(len(segs) - 1 AS INTEGER) AS n_matches, segs FROM (
          SELECT doc_id, text, string_split(regexp_replace(text, {pat}, {M1_SQL} || '\\0' || {M2_SQL}, 'g'), {M1_SQL}) AS segs
          FROM documents)),
    LATERAL (SELECT unnest(generate_series(2, len(segs))) AS k)
)""")
    return "\nUNION ALL\n".join(parts)
