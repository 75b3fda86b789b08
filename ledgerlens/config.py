"""Default parameters of the operators.

Every operator takes these as arguments; the module only supplies defaults.
The blocks marked FIXED VALUES must equal the original study's values for
its results to be reproduced; they are stated plainly and in their natural
order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: firm dimension and study window
# ---------------------------------------------------------------------------
FIRMS = [
    # (firm, cik, ticker, status)
    ("Lehman Brothers", "0000806085", "LEH", "failed"),
    ("Bear Stearns", "0000777001", "BSC", "failed"),
    ("AIG", "0000005272", "AIG", "failed"),
    ("JPMorgan Chase", "0000019617", "JPM", "survived"),
    ("Wells Fargo", "0000072971", "WFC", "survived"),
]
START_YEAR = 2005
END_YEAR = 2008

# ---------------------------------------------------------------------------
# FIXED VALUES: measures of the financial panel, in output order
# ---------------------------------------------------------------------------
MEASURES = [
    "total_assets",
    "total_liabilities",
    "stockholders_equity",
    "cash_and_equivalents",
    "short_term_borrowings",
    "net_income",
    "provision_for_loan_losses",
]
PANEL_IDS = ["firm", "ticker", "status", "fiscal_year", "filing_date", "accession"]

# ---------------------------------------------------------------------------
# FIXED VALUES: crisis lexicon (category -> terms) and hedging words
# ---------------------------------------------------------------------------
CRISIS_TERMS = {
    "subprime": ["subprime", "sub-prime", "sub prime"],
    "liquidity_risk": [
        "liquidity risk", "funding pressure", "liquidity facility",
        "liquidity position", "funding liquidity",
    ],
    "defaults": [
        "default", "delinquency", "delinquent",
        "nonperforming", "non-performing", "foreclosure",
    ],
    "counterparty": ["counterparty risk", "counterparty exposure", "counterparty credit"],
    "writedown": ["write-down", "writedown", "write down", "impairment", "impaired"],
    "off_balance_sheet": [
        "off-balance sheet", "off balance sheet",
        "variable interest entity", "variable interest entities",
        "VIE", "special purpose entity", "special purpose entities",
        "structured investment vehicle", "SIV", "conduit",
    ],
}

HEDGING_WORDS = [
    "may", "might", "could", "would", "should",
    "uncertain", "uncertainty", "no assurance",
    "potentially", "possible", "possibly",
    "approximate", "approximately", "estimate", "estimated",
    "subject to", "not guaranteed", "cannot predict",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: HTML cleanup as (pattern, replacement, ignore case), in order;
# BLOCK stands for the tags that end a line
# ---------------------------------------------------------------------------
FIN_BLOCK_TAGS = r"p|div|tr|li|h\d|td"
SECTION_BLOCK_TAGS = r"p|div|tr|li|h\d"
HTML_STEPS = [
    (r"<br\s*/?>", "\n", True),
    (r"</(BLOCK)>", "\n", True),
    (r"<[^>]+>", " ", False),
    (r"&nbsp;", " ", True),
    (r"&amp;", "&", True),
    (r"&[a-zA-Z]+;", " ", False),
    (r"&#\d+;", " ", False),
    ("\u00a0", " ", False),
    (r"[ \t]+", " ", False),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: section boundary patterns (Python/Java regex syntax; order
# is priority). Matching is case-insensitive.
# ---------------------------------------------------------------------------
SECTION_PATTERNS = {
    "risk_factors": {
        "start": [
            r"item\s+1a[\.\s\-—:]+risk\s+factors",
            r"item\s*1a\b.*?risk\s+factors",
            r"risk\s+factors\s*\n",
        ],
        "end": [
            r"item\s+1b[\.\s\-—:]",
            r"item\s+2[\.\s\-—:]+prop",
            r"item\s+2[\.\s\-—:]",
        ],
    },
    "mda": {
        "start": [
            r"item\s+7[\.\s\-—:]+management",
            r"item\s*7\b.*?management.*?discussion",
            r"management\s*['’]?\s*s?\s+discussion\s+and\s+analysis",
        ],
        "end": [
            r"item\s+7a[\.\s\-—:]",
            r"item\s+8[\.\s\-—:]",
            r"item\s+8\b",
        ],
    },
}
SECTIONS = ["risk_factors", "mda"]
SECTION_MIN_CHARS = 500          # a section must be longer than this
SECTION_FALLBACK_CHARS = 200_000  # chunk taken when no end boundary works
HEADER_PATTERN = r"item\s+\d+[a-z]?[\.\s\-—:]+\w+"
HEADER_SCAN_CHARS = 50_000
HEADER_FIRST_HITS = 15
HEADER_SHOWN = 8

# ---------------------------------------------------------------------------
# FIXED VALUES: line-item label patterns (field -> ordered patterns),
# matched case-insensitively with MULTILINE anchors
# ---------------------------------------------------------------------------
FIELD_PATTERNS = {
    "total_assets": [
        r"total\s+assets",
    ],
    "total_liabilities": [
        r"total\s+liabilities\b(?!\s+and)",
    ],
    "stockholders_equity": [
        r"total\s+(?:stockholders|shareholders)['’]?\s*equity",
        r"total\s+equity",
    ],
    "cash_and_equivalents": [
        r"cash\s+and\s+(?:cash\s+)?equivalents",
        r"cash\s+and\s+due\s+from\s+banks",
    ],
    "short_term_borrowings": [
        r"short[\s-]*term\s+borrowings",
        r"commercial\s+paper\s+and\s+other\s+short[\s-]*term\s+borrowings",
    ],
    "net_income": [
        r"net\s+income\s*(?:\(loss\))?\s*$",
        r"net\s+income\s*(?:\(loss\))?\s+attributable",
        r"net\s+(?:income|loss)\s*$",
    ],
    "provision_for_loan_losses": [
        r"provision\s+for\s+(?:credit|loan)\s+loss",
        r"provision\s+for\s+loan[\s,]+lease",
    ],
}
# amount token: optional "(" or "$", grouped or plain digits, optional ")"
NUMBER_PATTERN = r"[\($]?\s*\$?\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*\)?"
NUMBER_START = r"[\($\s\d]"   # what a token can start with: other places are passed over
NUMBER_WINDOW = 500     # chars searched after a label
NUMBER_MIN_VALUE = 10   # smaller values are footnotes / percentages
CONTEXT_AFTER = 80
CONTEXT_MAX = 100

# unit detection: (pattern, multiplier) in priority order, over two prefixes
UNIT_PATTERNS = [
    (r"in\s+millions", 1_000_000),
    (r"\(?\s*in\s+millions\s*\)?", 1_000_000),
    (r"dollars\s+in\s+millions", 1_000_000),
    (r"amounts?\s+in\s+millions", 1_000_000),
    (r"in\s+thousands", 1_000),
    (r"\(?\s*in\s+thousands\s*\)?", 1_000),
    (r"in\s+billions", 1_000_000_000),
]
UNIT_SCAN_CHARS = (10_000, 50_000)

# ---------------------------------------------------------------------------
# FIXED VALUES: validation thresholds
# ---------------------------------------------------------------------------
LIAB_EQ_ASSETS_TOL = 0.01      # |tl - ta| / ta below this -> liabilities=assets
BALANCE_OFF_PCT = 10           # |ta - (tl + se)| / ta * 100 above this
NET_INCOME_SHARE = 0.5         # |ni| / ta above this
UNIT_JUMP_RATIO = 100          # |cur / prev| above this between consecutive values
UNIT_JUMP_MEASURES = ["total_assets", "stockholders_equity", "net_income"]
MATCH_TOLERANCE = 0.05         # relative difference accepted as a match
IDENTITY_OK_PCT = 5            # final identity check
REFERENCE_UNIT = 1_000_000     # reference table is in millions

# ---------------------------------------------------------------------------
# FIXED VALUES: sentences
# ---------------------------------------------------------------------------
SENTENCE_SPLIT = r"(?<=[.!?])\s+(?=[A-Z])"
SENTENCE_MIN_WORDS = 8
SENTENCE_MAX_WORDS = 200
SENTENCE_MIN_ALPHA = 0.5
BOILERPLATE_PREFIXES = [
    r"item\s+\d",
    r"table of contents",
    r"see\s+note",
    r"page\s+\d",
    r"\(\d+\)\s*$",
    r"the\s+following\s+table",
    r"in\s+millions",
    r"dollars\s+in",
]
MIN_SENTENCES = 10
SENTENCE_TEXT_CHARS = 120
SENTIMENT_LABELS = ["positive", "negative", "neutral"]

# ---------------------------------------------------------------------------
# FIXED VALUES: statistics
# ---------------------------------------------------------------------------
TEST_FEATURES = [
    ("leverage_ratio", "Leverage Ratio"),
    ("cash_coverage", "Cash Coverage"),
    ("equity_to_assets_pct", "Equity / Assets %"),
    ("risk_total_crisis_density", "Crisis Keyword Density (Risk Factors)"),
    ("mda_total_crisis_density", "Crisis Keyword Density (MD&A)"),
    ("risk_section_wc", "Risk Section Word Count"),
    ("hedging_language_pct", "Hedging Language %"),
]
CORR_FEATURES = [
    "leverage_ratio", "cash_coverage", "equity_to_assets_pct",
    "risk_total_crisis_density", "mda_total_crisis_density",
    "risk_section_wc", "hedging_language_pct",
    "net_income", "provision_for_losses",
]
CORR_LABELS = {
    "leverage_ratio": "Leverage",
    "cash_coverage": "Cash Coverage",
    "equity_to_assets_pct": "Equity/Assets",
    "risk_total_crisis_density": "Crisis Keywords\n(Risk)",
    "mda_total_crisis_density": "Crisis Keywords\n(MD&A)",
    "risk_section_wc": "Risk Section\nLength",
    "hedging_language_pct": "Hedging\nLanguage",
    "net_income": "Net Income",
    "provision_for_losses": "Loan Loss\nProvisions",
}
CORR_MIN_NONNULL = 3           # a column needs more than this many values
SIGNIFICANCE = [(0.01, "***"), (0.05, "**"), (0.1, "*")]
MW_EXACT_MAX_N = 8             # exact Mann-Whitney p when min(n) <= this, no ties

# ---------------------------------------------------------------------------
# FIXED VALUES: chart events (year -> label)
# ---------------------------------------------------------------------------
CHART_EVENTS = {
    2007: "BNP Paribas\nfreezes funds\n(Aug '07)",
    2008: "Lehman\nbankruptcy\n(Sep '08)",
}
ANNOTATION_SHARE = 0.9

# ---------------------------------------------------------------------------
# FIXED VALUES: structured-fact tags per field, in fallback order
# ---------------------------------------------------------------------------
FACT_TAGS = {
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "stockholders_equity": [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
    "cash_and_equivalents": ["CashAndCashEquivalentsAtCarryingValue", "Cash"],
    "short_term_borrowings": ["ShortTermBorrowings", "CommercialPaper"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "provision_for_loan_losses": [
        "ProvisionForLoanAndLeaseLosses",
        "ProvisionForLoanLeaseAndOtherLosses",
        "ProvisionForCreditLosses",
    ],
    "fair_value_level3_assets": [
        "FairValueMeasuredOnRecurringBasisAssetsLevel3",
        "AssetsLevel3",
        "FairValueAssetsMeasuredOnRecurringBasisUnobservableInputReconciliationByAssetClassDomain",
    ],
}
