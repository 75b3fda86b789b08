"""Shape the benchmark tables into the study's inputs.

The benchmark tables hold no filings, so each registered query first
derives a firm-year panel or a set of filing sections from them. The same
derivations are written in SQL in ``oracle.py``.

* panel: lineitem -> orders -> customer -> nation -> region, one row per
  (nation, order year). Amounts are summed as exact integers (cents) so the
  totals are independent of summation order.
* doc_sections: documents as filing sections; firm = source, fiscal year =
  a size class of the document, section by language. Several documents
  under one key are exhibits of one section; their counts add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread, table


# Lexicon and hedging list used on the benchmark documents (the study's
# crisis lexicon never occurs in them); both are plain operator parameters.
DOC_LEXICON = {
    "articles": ["the", "der", "die", "le", "la", "el"],
    "connectors": ["and", "und", "et ", "y "],
    "suffixes": ["tion", "ment", "ing", "eau"],
    "acronyms": ["VIE", "SIV"],
}
DOC_HEDGING = ["que", "qui", "may", "ou"]


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def _line_sums():
    """Exact per-line amounts as integers: cents, and cents x hundredths
    (units of 1e-4) for price x discount / tax. Integer sums are exact,
    order-independent and far cheaper than DECIMAL(38, s) sums; values are
    divided once at the end. Bounds: even at 100 TB a (nation, year) total
    stays below 2^62 in 1e-4 units, and ANSI mode raises on overflow."""
    price = _cents("l_extendedprice")
    zero = F.lit(0).cast("long")
    return [
        F.sum(price).alias("assets"),
        F.sum(price * _cents("l_discount")).alias("equity"),
        F.sum(price * _cents("l_tax")).alias("cash"),
        F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(zero)).alias("stb"),
        F.sum(F.when(F.col("l_returnflag") == "A", price)
              .when(F.col("l_returnflag") == "N", -price).otherwise(zero)).alias("income"),
        F.sum(F.when(F.col("l_linestatus") == "F", price).otherwise(zero)).alias("prov"),
    ]


def _measures(scale: float = 1.0):
    """Integer sums -> the seven measures (DOUBLE), divided by ``scale``."""
    c2, c4 = F.lit(100.0 * scale), F.lit(10000.0 * scale)
    return [
        (F.col("assets").cast("double") / c2).alias("total_assets"),
        ((F.col("assets") * 100 - F.col("equity")).cast("double") / c4).alias("total_liabilities"),
        (F.col("equity").cast("double") / c4).alias("stockholders_equity"),
        (F.col("cash").cast("double") / c4).alias("cash_and_equivalents"),
        (F.col("stb").cast("double") / c2).alias("short_term_borrowings"),
        (F.col("income").cast("double") / c2).alias("net_income"),
    ]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firm-year panel with the seven measures (DOUBLE)."""
    li = table(spark, sf_dir, "lineitem", balance=True)
    # partial totals per order: the shuffle on l_orderkey is reused by the
    # join with orders, and it cuts rows ~4x before that join
    per_order = li.groupBy("l_orderkey").agg(*_line_sums())
    orders = table(spark, sf_dir, "orders", balance=True).select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation and region are fixed-size dimensions (25 and 5 rows)
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    region = F.broadcast(table(spark, sf_dir, "region"))
    sums = ("assets", "equity", "cash", "stb", "income", "prov")
    # second partial total per (customer, year): a customer holding a large
    # share of all orders reaches the customer join as one row per year
    per_cust = (per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
                .groupBy("o_custkey", "fiscal_year").agg(*[F.sum(c).alias(c) for c in sums]))
    j = (per_cust.join(cust, F.col("o_custkey") == F.col("c_custkey"))
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    g = j.groupBy("n_name", "n_nationkey", "r_name", "fiscal_year").agg(
        *[F.sum(c).alias(c) for c in sums])
    return g.select(
        F.col("n_name").alias("firm"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("ticker"),
        F.when(F.col("r_name").isin("ASIA", "AFRICA"), "failed").otherwise("survived").alias("status"),
        F.col("fiscal_year").cast("int").alias("fiscal_year"),
        *_measures(),
        F.when(F.col("r_name") == "EUROPE", F.lit(None).cast("double"))
         .otherwise(F.col("prov").cast("double") / F.lit(100.0)).alias("provision_for_loan_losses"),
    )


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second panel of the same shape, from the supplier side, used as the
    'reference' that the customer-side panel is checked against (in
    millions, like the study's reference table)."""
    li = table(spark, sf_dir, "lineitem", balance=True)
    orders = table(spark, sf_dir, "orders", balance=True).select(
        "o_orderkey", F.year("o_orderdate").alias("fiscal_year"))
    # supplier is not size-bounded: no broadcast hint (AQE may still pick a
    # broadcast from runtime sizes). Pre-aggregate per (supplier, year) so
    # the supplier join sees one row per supplier-year instead of per line.
    per_supp = (li.join(orders, li.l_orderkey == orders.o_orderkey)
                .groupBy("l_suppkey", "fiscal_year").agg(*_line_sums()))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    region = F.broadcast(table(spark, sf_dir, "region"))
    j = (per_supp.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
         .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    g = j.groupBy("n_name", "n_nationkey", "r_name", "fiscal_year").agg(
        *[F.sum(c).alias(c) for c in ("assets", "equity", "cash", "stb", "income", "prov")])
    return g.select(
        F.col("n_name").alias("firm"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("ticker"),
        F.when(F.col("r_name").isin("ASIA", "AFRICA"), "failed").otherwise("survived").alias("status"),
        F.col("fiscal_year").cast("int").alias("fiscal_year"),
        *_measures(1_000_000.0),
        F.when(F.col("r_name") == "MIDDLE EAST", F.lit(None).cast("double"))
         .otherwise(F.col("prov").cast("double") / F.lit(100.0 * 1_000_000.0)).alias("provision_for_loan_losses"),
    )


def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (doc_id, firm, ticker, status, fiscal_year, section, text)."""
    d = table(spark, sf_dir, "documents", balance=True)
    return d.select(
        "doc_id",
        F.col("source").alias("firm"),
        F.upper(F.col("source")).alias("ticker"),
        F.when(F.length("source") == 4, "failed").otherwise("survived").alias("status"),
        (F.lit(2000) + F.floor(F.log2(F.col("n_chars") + 1)).cast("int")).alias("fiscal_year"),
        F.when(F.col("lang").isin("en", "de"), "risk_factors").otherwise("mda").alias("section"),
        "text",
    )


def distorted_panel(p: DataFrame) -> DataFrame:
    """Deterministic distortions by key that trip each sanity rule:
    1996 liabilities copy assets; failed firms in 1998 report equity in the
    wrong unit (x100); 2000 net income copies assets; surviving firms in
    2001 report assets x1000."""
    y, st = F.col("fiscal_year"), F.col("status")
    ta, tl = F.col("total_assets"), F.col("total_liabilities")
    se, ni = F.col("stockholders_equity"), F.col("net_income")
    return p.select(
        "firm", "ticker", "status", "fiscal_year",
        F.when((y == 2001) & (st == "survived"), ta * 1000.0).otherwise(ta).alias("total_assets"),
        F.when(y == 1996, ta).otherwise(tl).alias("total_liabilities"),
        F.when((y == 1998) & (st == "failed"), se * 100.0).otherwise(se).alias("stockholders_equity"),
        "cash_and_equivalents", "short_term_borrowings",
        F.when(y == 2000, ta).otherwise(ni).alias("net_income"),
        "provision_for_loan_losses",
    )


def gappy_panel(p: DataFrame) -> DataFrame:
    """NULLs by key rule: no cash in 1995, no net income for failed firms in
    2001 (and no provisions for EUROPE, from the panel itself)."""
    y, st = F.col("fiscal_year"), F.col("status")
    return p.select(
        "firm", "ticker", "status", "fiscal_year", "total_assets", "total_liabilities",
        "stockholders_equity",
        F.when(y == 1995, F.lit(None).cast("double")).otherwise(F.col("cash_and_equivalents"))
         .alias("cash_and_equivalents"),
        "short_term_borrowings",
        F.when((y == 2001) & (st == "failed"), F.lit(None).cast("double")).otherwise(F.col("net_income"))
         .alias("net_income"),
        "provision_for_loan_losses",
    )


def scraped_for_validation(p: DataFrame) -> DataFrame:
    """The scraped side: distorted panel; surviving firms' 1995 rows stand
    under a former name, so that they match nothing."""
    former = (F.col("fiscal_year") == 1995) & (F.col("status") == "survived")
    return distorted_panel(p).withColumn("firm", F.when(former, F.concat("firm", F.lit(" (former)"))).otherwise(F.col("firm")))


def reference_for_validation(r: DataFrame) -> DataFrame:
    """The reference side (millions): 2001 rows stand under another name."""
    return r.withColumn("firm", F.when(F.col("fiscal_year") == 2001, F.concat("firm", F.lit(" (restated)")))
                        .otherwise(F.col("firm")))


# ---------------------------------------------------------------- filing index
PAGE_SPAN = 64   # order keys per index page: a page holds at most this many entries
FORM_BY_PRIORITY = [("1-URGENT", "10-K"), ("2-HIGH", "10-K/A"), ("3-MEDIUM", "10-Q"),
                    ("4-NOT SPECIFIED", "10-K")]


def _form_col():
    c = F.col("o_orderpriority")
    expr = None
    for prio, form in FORM_BY_PRIORITY:
        expr = (F.when(c == prio, form) if expr is None else expr.when(c == prio, form))
    return expr.otherwise("8-K")


def filing_index(spark: SparkSession, sf_dir: str):
    """Orders as filing-index entries packed into pages of parallel arrays.

    A page is (customer, order-key span of ``PAGE_SPAN``), so a page never
    holds more than ``PAGE_SPAN`` entries however many orders a customer
    has (no per-customer window or list). The customer's first page is its
    ``recent`` block; the other pages are listed by name, except that a page
    whose first entry has priority '5-LOW' is listed without a name, and a
    page whose first entry has status 'P' is listed but not available. Pages
    whose first entry has status 'F' carry a ``reportDate`` array one entry
    short (ragged arrays).

    Returns (recent, listing, pages) DataFrames."""
    o = table(spark, sf_dir, "orders")
    # zero-padded to at least 10 digits (format, not lpad: never truncates)
    cik = F.format_string("%010d", F.col("o_custkey"))
    e = o.select(
        cik.alias("cik"), "o_orderkey", "o_orderpriority", "o_orderstatus",
        F.floor(F.col("o_orderkey") / PAGE_SPAN).cast("long").alias("page_no"),
        _form_col().alias("form"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"), F.lit(""))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("filingDate"),
        F.concat(cik, F.lit("-"), F.date_format("o_orderdate", "yy"), F.lit("-"),
                 F.format_string("%010d", F.col("o_orderkey"))).alias("accessionNumber"),
        F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primaryDocument"),
        F.when(F.col("o_orderstatus") == "P", F.lit(""))
         .otherwise(F.date_format(F.add_months(F.to_date("o_orderdate"), -2), "yyyy-MM-dd")).alias("reportDate"),
    )
    fields = ["form", "filingDate", "accessionNumber", "primaryDocument", "reportDate"]
    packed = e.groupBy("cik", "page_no").agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", *fields))).alias("_entries"),
        F.min_by("o_orderpriority", "o_orderkey").alias("_prio"),
        F.min_by("o_orderstatus", "o_orderkey").alias("_status"))

    def field_of(f):
        return lambda x: x.getField(f)
    arrays = [F.transform("_entries", field_of(f)).alias(f) for f in fields]
    packed = packed.select("cik", "page_no", "_prio", "_status", *arrays)
    packed = packed.withColumn(
        "reportDate", F.when(F.col("_status") == "F", F.slice("reportDate", 1, F.size("reportDate") - 1))
                       .otherwise(F.col("reportDate")))
    # first page per customer: an aggregate joined back (AQE splits a hot customer)
    first = packed.groupBy("cik").agg(F.min("page_no").alias("_first"))
    packed = packed.join(first, "cik").withColumn("_recent", F.col("page_no") == F.col("_first"))
    block = F.struct(*fields).alias("block")
    name = F.concat(F.lit("CIK"), F.col("cik"), F.lit("-submissions-"),
                    F.format_string("%010d", F.col("page_no")), F.lit(".json"))
    recent = packed.where(F.col("_recent")).select("cik", block)
    older = packed.where(~F.col("_recent"))
    listing = older.select("cik", F.when(F.col("_prio") == "5-LOW", F.lit("")).otherwise(name).alias("name"))
    pages = older.where(F.col("_status") != "P").select("cik", name.alias("name"), block)
    return recent, listing, pages


# ---------------------------------------------------------------- filings text
_TOC = ("TABLE OF CONTENTS\nItem 1A. Risk Factors 12\nItem 1B. Unresolved Staff Comments 20\n"
        "Item 7. Management's Discussion and Analysis 31\nItem 8. Financial Statements 55\n\n")


def doc_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (doc_id, lang, filing): each document wrapped as a
    filing with a table of contents, a risk-factor section and an MD&A
    section (both bodies are the document text). Header styles vary by
    language so that every start/end pattern and the fallback are used:
    en standard; fr 'ITEM 1A (continued) - RISK FACTORS' and no Item 1B;
    es a bare 'Risk Factors' line and no end marker; de the MD&A opens
    with a bare title and ends at Item 7A."""
    d = table(spark, sf_dir, "documents", balance=True)
    lang, t = F.col("lang"), F.col("text")
    risk_head = (F.when(lang == "fr", F.lit("ITEM 1A (continued) - RISK FACTORS\n"))
                 .when(lang == "es", F.lit("Risk Factors\n"))
                 .otherwise(F.lit("Item 1A. Risk Factors\n")))
    risk_end = (F.when(lang == "fr", F.lit("\nItem 2. Properties\nNone.\n"))
                .when(lang == "es", F.lit("\n"))
                .otherwise(F.lit("\nItem 1B. Unresolved Staff Comments\nNone.\n")))
    mda_head = (F.when(lang == "de", F.lit("Management’s Discussion and Analysis\n"))
                .otherwise(F.lit("Item 7. Management's Discussion and Analysis\n")))
    mda_end = (F.when(lang == "de", F.lit("\nItem 7A. Market Risk\n"))
               .when(lang == "es", F.lit("\n"))
               .otherwise(F.lit("\nItem 8. Financial Statements\n")))
    filing = F.concat(F.lit(_TOC), risk_head, F.coalesce(t, F.lit("")), risk_end, mda_head,
                      F.coalesce(t, F.lit("")), mda_end)
    return d.select("doc_id", "lang", filing.alias("filing"))


# scorer vocabulary for the benchmark documents (frequent fragments of the
# invented prose, so every label occurs); a plain operator parameter
DOC_POSITIVE = ["an", "en"]
DOC_NEGATIVE = ["ou", "re"]


def labelled_features(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """documents joined to labels: status 'failed' for quality 0, else
    'survived'; features n_chars, words, article_density (per 1000 words),
    toxic."""
    from ..functions.text import term_count, word_count
    d = table(spark, sf_dir, "documents", balance=True)
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    words = word_count(F.col("text"))
    return j.select(
        "doc_id", *(keep or []),
        F.when(F.col("quality") == 0, "failed").otherwise("survived").alias("status"),
        F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("words"),
        F.try_divide(term_count(F.col("text"), ["the"]), words).cast("double").alias("_d"),
        F.col("toxic").cast("double").alias("toxic"),
        F.length(F.regexp_replace("text", "[^#|*!&%$]", "")).cast("double").alias("marks"),
    ).withColumn("article_density", F.col("_d") * 1000.0).drop("_d")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> small HTML balance-sheet filings, one per order, with the
    quirks line-item search has to cope with: a unit header by priority, a
    footnote marker before an amount, 'Total liabilities and equity',
    amounts in parentheses, a value on the next line, a date before an
    amount, and a missing line."""
    o = spread(table(spark, sf_dir, "orders", balance=True))
    pr, stt = F.col("o_orderpriority"), F.col("o_orderstatus")
    price = F.col("o_totalprice")
    unit = (F.when(pr == "1-URGENT", F.lit("(in thousands)"))
            .when(pr == "2-HIGH", F.lit("(Dollars in millions)"))
            .when(pr == "5-LOW", F.lit("in millions, except in thousands"))
            .otherwise(F.lit("")))

    def row(label, amount):
        return F.concat(F.lit("<tr><td>"), F.lit(label), F.lit("</td><td>"), amount, F.lit("</td></tr>"))

    def whole(x):
        # whole-unit amounts (floor), formatted with thousands separators
        return F.format_number(F.floor(x), 0)
    eq = whole(price / 12)
    html = F.concat(
        F.lit("<html><body><h2>Consolidated Statement of Condition</h2><p>"), unit, F.lit("</p><table>"),
        row("Total assets", F.concat(F.lit("$ "), F.format_number(price, 2))),
        row("Total liabilities (1)", whole(price * 11 / 12)),
        row("Total liabilities and equity", F.format_number(price, 2)),
        row("Total stockholders&#8217; equity",
            F.when(stt == "F", F.concat(F.lit("("), eq, F.lit(")"))).otherwise(eq)),
        row("Cash and cash equivalents",
            F.when(stt == "O", F.concat(F.lit("December 31, "), F.format_number(F.col("o_custkey") * 3, 0)))
             .otherwise(F.format_number(F.col("o_custkey") * 3, 0))),
        F.when(stt != "P", row("Short-term borrowings", F.format_number(F.col("o_orderkey"), 0)))
         .otherwise(F.lit("")),
        F.lit("<tr><td>Net income<br/>"), whole(price / 40), F.lit("</td></tr>"),
        F.lit("</table></body></html>"),
    )
    accession = F.concat(F.format_string("%010d", F.col("o_custkey")), F.lit("-"),
                         F.date_format("o_orderdate", "yy"), F.lit("-"),
                         F.format_string("%010d", F.col("o_orderkey")))
    return o.select(F.col("o_orderkey").alias("doc_id"), accession.alias("accession"), html.alias("html"))


# a long statement as (label, amount, second amount or None) over v (whole
# account balance) and n (customer number): every label pattern occurs, labels
# come back with other amounts, and which of them is largest varies by row
FULL_LINES = [
    ("Total assets", "v + 10", "v * 2 + 5"), ("Net income attributable to common shareholders", "v + 19 + n % 5", None),
    ("Total liabilities", "v * 3 + 20", "v * 3 + n"), ("Total liabilities and shareholders&rsquo; equity", "v * 9 + 31", None),
    ("Total shareholders' equity", "v + 11", "v * (n % 2) + 40"), ("Total equity", "v * (n % 4) + 12", None),
    ("Cash and cash equivalents", "n + 13", "n * 3"), ("Cash and due from banks", "n % 7 * v + 14", None),
    ("Commercial paper and other short-term borrowings", "v + 15", None), ("Short term borrowings (2)", "n * 7 + 16", None),
    ("Net income (loss)<br/>", "v + 17", "n"), ("Net loss<br/>", "v % 50 * 900 + 18", None),
    ("Provision for credit losses", "n % 9", "v + 20"), ("Provision for loan, lease and other losses", "v % 40 * 700 + 21", None),
    ("Total assets", "v * (n % 3) + 22", None), ("Total stockholders equity", "n * 2 + 23", None),
]


def full_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> one long HTML statement each (doc_id, html), with the lines
    ``FULL_LINES``; amounts in parentheses by customer and line, the unit note
    by market segment."""
    c = spread(table(spark, sf_dir, "customer", balance=True).select("c_custkey", "c_acctbal", "c_mktsegment"))
    x = c.select(F.col("c_custkey").alias("n"), F.floor(F.abs("c_acctbal")).cast("bigint").alias("v"), "c_mktsegment")
    seg = F.col("c_mktsegment")
    unit = (F.when(seg == "BUILDING", "(Amounts in millions, except shares)").when(seg == "MACHINERY", "in thousands of dollars")
            .when(seg == "FURNITURE", "(in billions)").otherwise(""))
    parts = [F.lit("<html><body><p>"), unit, F.lit("</p><table>")]
    for i, (label, first, second) in enumerate(FULL_LINES):
        amount = F.format_number(F.expr(first), 0)
        parts += [F.lit(f"<tr><td>{label}</td><td>"),
                  F.when((F.col("n") + i) % 6 == 0, F.concat(F.lit("("), amount, F.lit(")"))).otherwise(amount), F.lit("</td>")]
        if second:
            parts += [F.lit("<td>"), F.format_number(F.expr(second), 0), F.lit("</td>")]
        parts.append(F.lit("</tr>"))
    return x.select(F.col("n").alias("doc_id"), F.concat(*parts, F.lit("</table></body></html>")).alias("html"))


def customer_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as the firm dimension: (firm, cik, ticker, status); status
    'failed' for the BUILDING and MACHINERY segments."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_name").alias("firm"), F.format_string("%010d", F.col("c_custkey")).alias("cik"),
                    F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"),
                    F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "failed")
                     .otherwise("survived").alias("status"))


# structured facts from events: each event type is a tag with fallbacks
EVENT_FIELD_TAGS = {
    "activity": ["purchase", "click"],
    "attention": ["view", "signup"],
    "faults": ["error"],
}


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as facts: company = user, tag = event type, period end = the
    event day, filed = event time; all annual 10-K facts."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("cik"), F.col("event_type").alias("tag"),
                    F.date_format("ts", "yyyy-MM-dd").alias("end"), F.col("value").alias("val"),
                    F.format_string("%010d", F.col("event_id")).alias("accn"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("filed"),
                    F.lit("10-K").alias("form"), F.lit("FY").alias("fp"))


# flag and status of a line as tags, some of them fallbacks of others
SHIP_FIELD_TAGS = {"returned": ["RF", "RO"], "kept": ["AF", "AO"], "open": ["NO", "NF"]}


def ship_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as duration facts: company = supplier, tag = flag and status,
    value = quantity shipped in a quarter or a year (both end on the same day
    once a year), as of the filing; lines are filed 40 days times their number
    after shipping, at the start of the month, so facts are restated."""
    li = table(spark, sf_dir, "lineitem", balance=True)
    ship = F.col("l_shipdate").cast("date")
    filed = F.trunc(F.date_add(ship, F.col("l_linenumber") * 40), "MM")

    def spans(unit, months):
        start = F.trunc(ship, unit)
        return F.struct(start.alias("start"), F.date_sub(F.add_months(start, months), 1).alias("end"))
    x = li.select(F.col("l_suppkey").alias("cik"), F.concat("l_returnflag", "l_linestatus").alias("tag"), filed.alias("filed"),
                  F.col("l_quantity").cast("bigint").alias("q"), F.explode(F.array(spans("QUARTER", 3), spans("YEAR", 12))).alias("s"))
    x = x.groupBy("cik", "tag", "s.start", "s.end", "filed").agg(F.sum("q").alias("val"))
    return x.withColumn("accn", F.concat_ws("-", F.lpad(F.col("cik").cast("string"), 10, "0"), F.date_format("filed", "yy-MM")))


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> (cik, as_of): three days each, shifted by supplier."""
    s = table(spark, sf_dir, "supplier")
    day = F.explode(F.array(*[F.to_date(F.lit(d)) for d in ("1996-05-31", "1998-02-01", "2001-02-01")]))
    return s.select(F.col("s_suppkey").alias("cik"), F.pmod(F.col("s_suppkey"), F.lit(97)).cast("int").alias("_k"), day.alias("_d")).select(
        "cik", F.date_add("_d", F.col("_k")).alias("as_of"))
