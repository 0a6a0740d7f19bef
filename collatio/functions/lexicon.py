"""Lexicons of the comparison operators. Sizes are those of this file, so they may be broadcast.

``Lexicon`` is a parameter of the operators that use it; names of companies are a parameter too.
"""

from __future__ import annotations

from dataclasses import dataclass

# The patterns and word lists that decide results.
TOKEN = r"\d[\d,]*(?:\.\d+)?%?|\.\d+%?|[A-Za-z]+(?:[’'\-][A-Za-z]+)*"
NUMBER = r"(?:\([+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)\)|[+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+))%?"
SYMBOLS = "$€£¥"
DATE = (
    r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
    r"Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},\s+\d{4}\b"
)
PHONE = r"\b\d{3}-\d{3}-\d{4}\b"
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
CONTACT_LABELS = {"investor contact": "investor_contact", "editorial contact": "editorial_contact"}
HEADER_MARKERS = (
    "low", "high", "three months ended", "range for three months ending", "range for fiscal year ending", "january 31", "april 30",
    "july 31", "october 31", "fiscal year ending", "in millions", "in thousands", "except per share amounts",
)
STRICT_ROLES = (
    "table_title", "table_subtitle", "table_column_header", "table_row_label", "table_data_cell", "table_data_label", "section_header", "section_lead",
)
CURRENCY_ROWS = (" eps", "gaap eps", "non-gaap eps", "per diluted share", "earnings per diluted share", "net income per diluted share")
SHARE_ROWS = ("shares used in computing", "outstanding shares", "shares outstanding", "common stock")
RATE_ROWS = ("shares used in computing", "outstanding shares", "shares outstanding", "tax rate", "effective tax rate", "% of total", "operating margin")
FINANCE_ROWS = (
    "revenue", "expense", "expenses", "income", "loss", "amortization", "compensation", "charges", "acquisition/divestiture", "adjustment",
    "cash flow", "capital expenditures", "debt", "liabilities", "assets", "equity",
)
SECTIONS = (
    ("results_summary", "results_summary", ("results summary",)),
    ("gaap_results", "gaap_results", ("gaap results",)),
    ("non_gaap_results", "non_gaap_results", ("non gaap results",)),
    ("business_segments", "business_segments", ("business segments",)),
    ("financial_targets", "financial_targets", ("financial targets",)),
    ("earnings_call_open_to_investors", "earnings_call", ("earnings call open to investors", "earnings call open to investor")),
    ("availability_of_final_financial_statements", "availability", ("availability of final financial statements",)),
    ("reconciliation_quarter_results", "reconciliation", (r"reconciliation of (?:first|second|third|fourth) quarter fiscal year \d{4} results",)),
    ("reconciliation_targets", "reconciliation", (r"reconciliation of \d{4} targets",)),
    ("forward_looking_statements", "forward_looking", ("forward looking statements",)),
    ("segment_information", "segment_information", ("segment information",)),
    ("gaap_to_non_gaap_reconciliation", "gaap_to_non_gaap_reconciliation", ("gaap to non gaap reconciliation",)),
    ("investor_contact", "investor_contact", ("investor contact",)),
    ("editorial_contact", "editorial_contact", ("editorial contact",)),
)
#: The order of the sections decides: the first whose pattern a header has; those with the company's name come last.
#: Sections whose headers carry the company's name; {} stands for it.
COMPANY_SECTIONS = (
    ("income_statement", "statement_table", "{} inc unaudited condensed consolidated statements of income"),
    ("balance_sheets", "statement_table", "{} inc unaudited condensed consolidated balance sheets"),
    ("cash_flows", "statement_table", "{} inc unaudited condensed consolidated statements of cash flows"),
    ("about_company", "about_company", "about {}"),
)
#: Short labels that may repeat in a table whatever their length.
REPEATED_LABELS = ("low", "high", "gaap eps", "non gaap eps")


@dataclass(frozen=True)
class Lexicon:
    company: str = "example"
    wire_service: str = "PRNewswire"
    sections: tuple = SECTIONS
    #: Firms whose names mark lines that filing agents put on pages.
    filing_agents: tuple = ()

    @property
    def schemas(self) -> list[tuple[str, str, str]]:
        """(schema key, family type, pattern)."""
        own = [(k, f, p) for k, f, patterns in self.sections for p in patterns]
        return own + [(k, f, p.format(self.company.lower())) for k, f, p in COMPANY_SECTIONS]

    @property
    def company_pattern(self) -> str:
        return rf"(?i)\b{self.company},\s*Inc\.?\b"


DEFAULT = Lexicon()
