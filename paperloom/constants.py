"""Fixed values.  They decide results and are stated here once."""

# --- routing -------------------------------------------------------------
AUTO_ASSIGN_THRESHOLD = 0.7
REVIEW_THRESHOLD = 0.4
SEGMENT_MARGIN = 0.03            # segments are searched at review - margin
HITS_PER_SOURCE = 20
CANDIDATES_FOR_REVIEW = 4
MAX_WEIGHT, AVG_WEIGHT = 0.7, 0.3

ROUTE_ASSIGN = "AUTO_ASSIGN"
ROUTE_REVIEW = "REVIEW_BY_AGENT"
ROUTE_CREATE = "CREATE_NEW_GROUP"

# --- retrieval -----------------------------------------------------------
SHORTLIST_SIZE = 5
SHORTLIST_THRESHOLD = 0.55
SHORTLIST_FALLBACK = 2
CHUNKS_FETCHED = 40
CHUNKS_RETURNED = 7
CHUNKS_PER_PATH = 2
MAX_SOURCES = 5
PROTO_HIGH, RERANK_HIGH, SOURCES_HIGH = 0.72, 0.80, 2
PROTO_MEDIUM, RERANK_MEDIUM = 0.55, 0.55
TIER_DROP, TIER_PENALTY = 0.20, 15
SCORE_HIGH, SCORE_MEDIUM, SCORE_LOW, SCORE_EMPTY = 90, 70, 30, 15

# --- text ----------------------------------------------------------------
SHORT_DOC_WORDS = 150
BULLET_SHARE, CODE_SHARE, MIN_HEADINGS = 0.4, 0.3, 2
TOKENS_PER_WORD = 0.75
CHUNK_RULES = {                  # struct_type -> (size, overlap)
    "prose": (512, 64),
    "report": (1024, 128),
    "code": (384, 48),
    "list": (256, 32),
}
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", " "]
LONG_WORD = 24                   # characters; a longer word counts once per so many
DOC_PREFIX = "search_document: "
QUERY_PREFIX = "search_query: "
SEMANTIC_TYPES = ["troubleshooting", "design", "requirements", "runbook", "reference"]
DEFAULT_TYPE = "reference"

# --- vectors and groups ----------------------------------------------------
KMEANS_ITERATIONS = 30
SEGMENT_STEPS = [(4, 1), (12, 2), (24, 3)]   # chunk count up to -> segments
CLUSTERED_SEGMENTS = 5
MAX_PROTOTYPES = 20
PROTOTYPE_RATIO = 20
BUFFER_TRIGGER = 20

# --- events ----------------------------------------------------------------
SOURCES = ["github", "jira", "confluence", "miro"]
DEBOUNCE_GAP = "5 seconds"
DEBOUNCE_MS = 5_000
DECISIONS = ["ASSIGN", "CREATE_NEW"]

# --- patterns ----------------------------------------------------------------
SPACE = r"\s\x1c-\x1f"           # inside a character class, with (?U)
SPACES = (                       # the same characters, to trim
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BULLET_LINE = r"(?U)^(?:[-*+]\s+|\d+[.)]\s+)"
HEADING_LINE = r"(?U)^#+\s+"
CODE_LINE = r"(?U)[;{}()<>]|def\s+|class\s+|function\s+|=>"
FENCE = "```"
FENCED_CODE = r"(?s)```[^\n]*\n.*?```"
CITATION = r"\[(\d+)\]"
SLUG_LENGTH = 60
TITLE_WORDS = 12
CAPS_TITLE_LENGTH, COLON_TITLE_LENGTH = 60, 80
SUMMARY_LENGTH = 200
# entity -> character; the ampersand comes last
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"), ("&euro;", "€"), ("&trade;", "™"),
    ("&reg;", "®"), ("&deg;", "°"), ("&times;", "×"), ("&rarr;", "→"), ("&larr;", "←"), ("&amp;", "&"),
]

# --- texts of results ----------------------------------------------------------
MISSING_FIELDS = "Normalization error: missing required fields"
UNKNOWN_SOURCE = 'No normalizer registered for source: "%s"'
REQUIRED_FIELDS = ["doc_id", "source", "content", "metadata"]
REQUIRED_MESSAGE = "Missing required fields: "
EMPTY_CONTENT = "Content field is empty"
DEFAULT_TITLE = "Untitled"
DEFAULT_TITLES = {"github": "GitHub Repository", "jira": "Jira Issue", "miro": "Board "}
UNKNOWN_REPO = "unknown-repo"
UNKNOWN_DOC_SOURCE = "unknown-source"
NEW_GROUP = "new-group"
GROUP_DESCRIPTION = "Document group for %s."
UNKNOWN_PROJECT = "unknown project"
FINGERPRINT_LABELS = [           # field, label, is a list
    ("project_identity", "Project Identity", False),
    ("functional_domain", "Functional Domain", False),
    ("doc_intent", "Document Intent", False),
    ("lifecycle_stage", "Lifecycle Stage", False),
    ("technical_concepts", "Technical Concepts", True),
    ("key_entities", "Key Entities", True),
    ("cross_tool_aliases", "Cross-Tool Aliases", True),
]
FINGERPRINT_SUMMARY = "Summary"
REVIEW_FALLBACK = "Defaulted to CREATE_NEW due to error in agent review process."
NO_CANDIDATES = "No candidate groups found."
REASON_EMPTY = "No relevant chunks found."
REASON_HIGH = "Strong prototype match, %d corroborating sources"
REASON_MEDIUM = "Moderate matches found, relevance may vary"
REASON_WEAK_GROUP = "Weak prototype match — query may not align with any group topic"
REASON_WEAK_CHUNKS = "Weak evidence returned at the chunk level"
BANNER = "**Retrieval Confidence: %s (%d%%)** — %s"
SEED_CONTENT = "Title: %s\nGroup: %s\nSource: %s\n\n%s\n"
SEED_SUMMARY = "Seed group for %s"
