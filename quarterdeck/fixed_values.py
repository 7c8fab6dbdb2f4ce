"""Values that results depend on, kept together as plain text.

Nothing here is logic: codes, tables, phrases and patterns that decide what a
row looks like. Patterns are written for both Java and RE2 (no look-around, no
backreference), so that a query and its SQL counterpart share one text.
"""

# --- Form 8-K item codes -> description (fixed values) ---------------------
ITEM_DESCRIPTIONS = {
    "1.01": "Entry into a Material Agreement",
    "1.02": "Termination of a Material Agreement",
    "1.03": "Bankruptcy or Receivership",
    "2.01": "Completion of Acquisition or Disposition",
    "2.02": "Results of Operations and Financial Condition",
    "2.03": "Creation of a Direct Financial Obligation",
    "2.04": "Triggering Events That Accelerate Obligations",
    "2.05": "Costs Associated with Exit or Disposal",
    "2.06": "Material Impairments",
    "3.01": "Notice of Delisting",
    "3.02": "Unregistered Sales of Equity Securities",
    "3.03": "Material Modification to Rights of Security Holders",
    "4.01": "Changes in Registrant's Certifying Accountant",
    "4.02": "Non-Reliance on Previously Issued Financials",
    "5.01": "Changes in Control of Registrant",
    "5.02": "Departure/Election of Directors or Officers",
    "5.03": "Amendments to Articles or Bylaws",
    "5.07": "Submission of Matters to a Vote of Security Holders",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Events",
    "9.01": "Financial Statements and Exhibits",
}
EVENT_TAGS = ["8-K", "SEC Filing"]
EVENT_SOURCE = "SEC EDGAR (8-K)"
QUARTERLY_SOURCE = "SEC 10-Q"
CALL_SOURCE = "earningscall"

# --- month in which the fiscal year ends (fixed values) --------------------
FISCAL_YEAR_END_MONTH = {"NVDA": 1, "AAPL": 9, "MSFT": 6, "ORCL": 5, "WMT": 1}

# --- default sizes (fixed values) ------------------------------------------
QUARTERS = 8
ANNUALS = 3
EVENTS = 6
HITS_PER_QUARTER = 6
HITS_PER_NEWS = 8
HITS_PER_PAGE_SEARCH = 8
MIN_PAGE_TEXT = 500
CLIP_SNIPPETS = 4000
CLIP_NEWS = 3000
CLIP_PAGE = 8000
CHUNK_BEFORE = 200
CHUNK_LENGTH = 3000
INTRO_LENGTH = 3000
EPS_SEARCH_LENGTH = 5000
MAX_NAME_LENGTH = 40
RETRIES = 2
RETRY_WAIT_SECONDS = 3.0

# --- labels of income-statement rows (fixed values) ------------------------
REVENUE_WORDS = ["net sales", "revenue", "total revenue", "net revenue"]
NET_INCOME_LABELS = ["net income", "net income:"]
DILUTED_EPS_WORDS = ["diluted", "per share", "dollar"]

# --- markers (fixed values) ------------------------------------------------
TRANSCRIPT_ID = "article-body-transcript"
TRANSCRIPT_CLASS = "article-body"
TRANSCRIPT_SITE = "fool.com"
FAILED_SEARCH = "[Search failed"
PARSE_ERROR = "LLM parse failed"

# --- patterns over call texts (fixed values) -------------------------------
HANDED_OVER_TO = r"turn (?:the call|it) over to ([A-Z][a-z]+ [A-Z][a-z]+)"
THANKED = r"(?:Thank you|Thanks),? ([A-Z][a-z]+ [A-Z]?[a-z]*)"
TITLES = [
    r"(?:Chief Executive Officer|CEO)",
    r"(?:Chief Financial Officer|CFO)",
    r"(?:Chief Operating Officer|COO)",
    r"(?:Chief Technology Officer|CTO)",
    r"(?:President)",
    r"(?:Director of Investor Relations|VP.{0,20}Investor Relations|IR)",
    r"(?:Senior Vice President|SVP|Executive Vice President|EVP)",
    r"(?:Vice President|VP)",
    r"(?:Analyst|Managing Director)",
]
NAME_AND_TITLE = r"([A-Z][a-z]+ (?:[A-Z]\. )?[A-Z][a-z]+)(?:,| —| -) (?:" + "|".join(TITLES) + ")"
CALL_QUESTIONS_START = "|".join([
    r"(?:we(?:'ll| will) (?:now )?(?:open|begin|take|move to).*(?:question|Q&A|Q & A))",
    r"(?:open (?:the )?(?:call|floor|line).*(?:question|Q&A))",
    r"(?:question.and.answer (?:session|portion|segment))",
    r"(?:Q&A (?:session|portion|segment))",
    r"(?:first question)",
    r"(?:Operator.*(?:first question|question comes from))",
])
REVENUE_FIGURE = r"revenue of \$?([\d,.]+)\s*(billion|million|B|M)"
EPS_FIGURE = r"(?:earnings per share|EPS|diluted earnings).*?\$?([\d.]+)"

# capitals of which a text must have one before a pattern can match (fixed values)
QUESTIONS_NEED = ["QUEST", "Q&A", "Q & A"]
REVENUE_NEEDS = ["REVENUE OF "]
EPS_NEEDS = ["EARN", "EPS"]

# --- patterns over transcript pages (fixed values) -------------------------
PARTICIPANTS_BLOCK = (
    r"(?:CALL PARTICIPANTS|Call Participants)((?s:.*?))"
    r"(?:PREPARED REMARKS|Prepared Remarks|KEY|RISKS|TAKEAWAYS|\n\n\n)"
)
PAGE_NAME = r"([A-Z][a-z]+ (?:[A-Z]\.\s)?[A-Z][a-z]+)"
NAME_AFTER_DASH = r"(?:—|--|–)\s*" + PAGE_NAME
NAME_BEFORE_DASH = PAGE_NAME + r"\s*(?:—|--|–)"
NAME_DASH_WORD = PAGE_NAME + r"\s*--\s*\w"
PAGE_QUESTIONS_START = "|".join([
    r"(?:Questions? (?:and|&) Answers?)",
    r"(?:Q&A Session)",
    r"(?:we(?:'ll| will) (?:now )?(?:open|begin|take).*question)",
    r"(?:Operator.*first question)",
])
CALL_DATE = r"(?:DATE|Date)[:\s]+\w+day,?\s+(\w+ \d{1,2},?\s+\d{4})"
FINANCIALS_MARKERS = [
    r"[Cc]onsolidated [Rr]evenue",
    r"[Tt]otal [Rr]evenue[s]? ",
    r"[Rr]evenue of \$",
    r"earnings per share",
    r"Chief Financial Officer",
]

# --- patterns over replies (fixed values) ----------------------------------
FENCE_OPEN = r"^```(?:json)?\s*"
FENCE_CLOSE = r"\s*```$"
