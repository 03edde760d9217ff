"""Lists and patterns that results depend on and that must not be changed."""

COMPARISONS = ("scalar", "ordered", "ordered_values", "unordered", "keyed")
OUTCOMES = ("answer", "ambiguity", "rejection")
SUITE_KINDS = ("regression", "capability")
TRIALS = (1, 20)
AGENT_NAME = r"^[a-z][a-z0-9_-]*$"

RESOURCE_COLLECTIONS = ("nodes", "sources", "exposures", "metrics", "semantic_models")
QUERYABLE_TYPES = ("model", "seed", "snapshot", "source")
SELECTOR_KINDS = ("group", "tag", "model", "source", "path", "package")

# Statement kinds a governed query must not contain.
WRITE_KINDS = (
    "insert",
    "update",
    "delete",
    "create",
    "drop",
    "alter",
    "command",
    "merge",
    "truncate",
    "grant",
    "revoke",
)
QUERY_KINDS = ("select", "union", "intersect", "except")
FORBIDDEN_FUNCTIONS = (
    "load_extension",
    "nextval",
    "pg_read_file",
    "pg_ls_dir",
    "read_csv",
    "read_csv_auto",
    "read_json",
    "read_parquet",
    "setval",
    "write_csv",
)

# Dates are taken out of a claim before its numbers are read.
ISO_DATE = r"(?U)\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
WRITTEN_DATE = (
    r"(?iU)\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
    r"|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+[0-9]{1,2}(?:,\s*[0-9]{4})?\b"
)
# A number of a claim: optional currency sign, thousands separators, optional percent sign.
CLAIM_NUMBER = (
    r"(?<![\p{L}\p{N}_-])\$?(-?[0-9][0-9,]*(?:\.[0-9]+)?)(%)?(?![0-9,]|\.[0-9]|-[A-Za-z])"
)
QUESTION_NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
DATE_VALUE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T].*)?$"
WHOLE_NUMBER_TOLERANCE = 1e-9
ROUNDING_SLACK = 1e-12

# Claim coverage: words without weight, and words counted as another.
STOP_WORDS = (
    "a",
    "an",
    "and",
    "as",
    "at",
    "had",
    "has",
    "have",
    "in",
    "of",
    "the",
    "their",
    "they",
    "total",
    "to",
    "was",
    "were",
    "with",
)
WORD_ALIASES = {"games": "game", "wins": "win", "won": "win"}
SIMILAR = 0.9
SHARED_WORDS = 0.5

# Template reference of a reference query.
REF_CALL = r"\{\{\s*ref\(['\"]([^'\"]+)['\"]\)\s*\}\}"

PARAPHRASE_PREFIX = "Please answer this another way: "
AMBIGUOUS_QUESTION = "Revenue?"
OUT_OF_SCOPE_QUESTION = "Show data from a resource outside this agent's dbt scope."
