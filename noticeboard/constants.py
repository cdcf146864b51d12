"""Limits, weights, patterns and word lists that decide results."""

# -- fixed values: limits -------------------------------------------------
DEFAULT_LIMIT = 5
MAX_LIMIT = 50
MAX_QUERY_CHARS = 100
MAX_CHAT_CHARS = 500
CHAT_HISTORY_KEPT = 40
CHAT_TOKEN_LIMIT = 100_000
SUMMARY_TOKEN_LIMIT = 80_000
PRE_LIMIT_FLOOR = 50
PRE_LIMIT_FACTOR = 1.5
PRE_LIMIT_OFFSET = 20
RETRY_FACTOR = 1.5
PRE_MERGE_FACTOR = 2.5
SEARCH_ROUNDS = 2
# Largest values the formulas above can give for a limit of MAX_LIMIT; window
# filters repeat them as literals so that Spark cuts groups before the shuffle.
MAX_PRE_LIMIT = 142
MAX_PRE_MERGE = 125

# -- fixed values: scoring ------------------------------------------------
MISS_PENALTY = 0.15
HIT_BOOST = 0.60
DEFAULT_SEMANTIC_RATIO = 0.5
SCORE_THRESHOLD_PERCENT = 81
HEADING_MIN_COSINE = 0.4
KEYWORD_WEIGHTS = {
    "words": 0.60,
    "typo": 0.15,
    "proximity": 0.10,
    "attribute": 0.10,
    "exactness": 0.05,
}
PROXIMITY_CAP = 8
BM25_K1 = 1.2
BM25_B = 0.75
# Searched attributes, most important first.
SEARCH_ATTRIBUTES = ["title", "cleaned_content", "content", "main_title"]

# -- fixed values: sync ---------------------------------------------------
CHUNK_SIZE = 1500
CHUNK_OVERLAP = 300
CHUNK_TOLERANCE = 200
# A chunk may end early in its last quarter, but not more than so many characters early.
CHUNK_TAIL_SHARE = 4
CHUNK_TAIL = 300
OVERSIZE_TOKENS = 1800
SNAPSHOTS_KEPT = 4
BREAKER_MIN_DELETIONS = 5
BREAKER_SHARE = 3
MIN_CHUNK_CHARS = 30
DETAILS_MIN_CHARS = 3000
CONTENT_SEPARATOR = "\n\n --- \n\n"

# -- fixed values: text ---------------------------------------------------
# Characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CJK_RANGE = "[一-龥]"
EMBEDDING_RETRIES = 3
RETRY_STRIPPED_CHARS = ",. '’\"，。"
# Separators tried in order when a chunk end is moved to a natural break.
CHUNK_SEPARATORS = ["\n\n", "\n", "。", "！", "？", "!", "?", "；", ";", "：", ":", "，", ",", "、"]
METADATA_LABELS = ["日期", "工作區", "受影響的群體"]
TEMPLATE_HEADINGS = ["現已推出", "即將到來的事項", "提醒", "後續步驟"]
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
STATUS_BUCKETS = {
    "in development": "in_development",
    "rolling out": "rolling_out",
    "launched": "launched",
}
# Words that carry no meaning in a query, and words too general to be required.
NOISE_TERMS = ["announcement", "article", "data", "details", "query", "公告", "文章", "資料", "細節", "查詢"]
GENERIC_TERMS = [
    "pricing", "announcement", "article", "update", "security", "summary",
    "價格", "公告", "文章", "更新", "安全性", "總報",
]
NAV_LABELS = ["ANNOUNCEMENTS", "DEVELOPERS", "FEATURES", "LEARN MORE", "READ MORE"]
ERROR_TITLES = ["Page not found", "Error", "Access Denied", "Just a moment..."]
DEFAULT_SUGGESTIONS = ["如何搜尋？", "最新公告", "Copilot"]
