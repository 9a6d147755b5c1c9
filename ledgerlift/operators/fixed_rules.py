"""Dialect audit rules and rewrite patterns, as plain text."""

# Id, category, severity, targets the rule is for, pattern.
# Targets: "all", a list, or "not" a list of families or stores.
RULES = [
    ("backtick_name", "quote", "error", "not mysql", r"`[^`\n]+`"),
    ("bracket_name", "quote", "warning", "not mssql", r"\[[A-Za-z_][\w$#@ ]*\]"),
    ("limit_mssql", "pagination", "error", "mssql", r"\bLIMIT\s+\d+"),
    ("limit_dameng", "pagination", "warning", "dameng", r"\bLIMIT\s+\d+"),
    ("top", "pagination", "error", "not mssql dameng", r"\bTOP\s+\d+"),
    ("limit_pair", "pagination", "error", "not mysql", r"\bLIMIT\s+\d+\s*,\s*\d+"),
    ("getdate", "function", "error", "not mssql", r"\bGETDATE\s*\(\s*\)"),
    ("last_identity", "function", "error", "not mssql", r"\bSCOPE_IDENTITY\s*\(\s*\)|@@IDENTITY\b|@@ROWCOUNT\b"),
    ("datediff", "function", "warning", "not mssql", r"\bDATEDIFF\s*\("),
    ("charindex", "function", "warning", "not mssql", r"\bCHARINDEX\s*\("),
    ("isnull", "function", "warning", "not mssql", r"\bISNULL\s*\(\s*[^)]+,"),
    ("last_insert_id", "function", "error", "not mysql", r"\bLAST_INSERT_ID\s*\(\s*\)"),
    ("on_duplicate_key", "function", "error", "not mysql", r"\bON\s+DUPLICATE\s+KEY\s+UPDATE\b"),
    ("replace_into", "function", "error", "not mysql", r"\bREPLACE\s+INTO\b"),
    ("group_concat", "function", "warning", "not mysql", r"\bGROUP_CONCAT\s*\("),
    ("date_format", "function", "warning", "not mysql", r"\bDATE_FORMAT\s*\("),
    ("if_call", "function", "warning", "not mysql", r"\bIF\s*\(\s*[^)]*,"),
    ("ifnull", "function", "warning", "not mysql", r"\bCONCAT_WS\s*\(|\bIFNULL\s*\("),
    ("returning", "function", "error", "not postgres", r"\bRETURNING\b"),
    ("on_conflict_mssql", "function", "error", "mssql", r"\bON\s+CONFLICT\b"),
    ("nvl", "function", "warning", "not dameng", r"\bNVL\s*\("),
    ("merge", "upsert", "warning", "not mssql dameng", r'\bMERGE\s+(?:INTO\s+)?[`"\[\w.]+'),
    ("on_conflict_mysql", "upsert", "error", "mysql", r"\bON\s+CONFLICT\b"),
    ("identity_query", "identity", "warning", "all", r"SELECT\s+@@IDENTITY|SELECT\s+SCOPE_IDENTITY"),
    ("call", "routine", "error", "not mysql", r'\bCALL\s+[`"\[\w]+'),
    ("exec", "routine", "error", "not mssql", r"\bEXEC(?:UTE)?\s+(?:\[[^\]]+\]|(?:sp|usp|xp|dbo)_?\w+|dbo\.\w+)"),
    ("dollar_parameter", "placeholder", "info", "mysql", r"\$\d+\b"),
    ("at_parameter", "placeholder", "info", "postgres", r"@p\d+"),
]

# What to write instead, per rule.
ADVICE = {
    "backtick_name": "quote names the target's way or not at all",
    "bracket_name": "quote names the target's way or not at all",
    "limit_mssql": "SELECT TOP n, or ORDER BY with OFFSET and FETCH",
    "limit_dameng": "ROWNUM, or OFFSET with FETCH",
    "top": "LIMIT n",
    "limit_pair": "LIMIT count OFFSET start",
    "getdate": "CURRENT_TIMESTAMP or NOW()",
    "last_identity": "LAST_INSERT_ID(), or INSERT with RETURNING",
    "datediff": "check units and argument order; subtract dates",
    "charindex": "LOCATE, POSITION or STRPOS",
    "isnull": "COALESCE",
    "last_insert_id": "SCOPE_IDENTITY(), or INSERT with RETURNING",
    "on_duplicate_key": "ON CONFLICT, or MERGE",
    "replace_into": "ON CONFLICT; it deletes and inserts",
    "group_concat": "STRING_AGG",
    "date_format": "TO_CHAR with its own format letters",
    "if_call": "CASE WHEN",
    "ifnull": "COALESCE, or join with ||",
    "returning": "read the id after the insert, or use OUTPUT",
    "on_conflict_mssql": "MERGE",
    "nvl": "COALESCE",
    "merge": "the target's upsert form",
    "on_conflict_mysql": "ON DUPLICATE KEY UPDATE",
    "identity_query": "read new ids the target's way",
    "call": "EXEC, or SELECT of a function",
    "exec": "CALL, or SELECT of a function",
    "dollar_parameter": "?",
    "at_parameter": "$n",
}

SNIPPET_LIMIT = 60
SNIPPET_KEEP = 57

# Rewrite patterns.
TOP_NUMBER = r"\bTOP\s+(\d+)\b"
TOP_UNSAFE = r"\bTOP\s+\d+\s+(?:PERCENT|WITH\s+TIES)"
GETDATE = r"\bGETDATE\s*\(\s*\)"
ISNULL = r"\bISNULL\s*\("
IFNULL = r"\bIFNULL\s*\("
NVL = r"\bNVL\s*\("
BACKTICK = r"`([^`\n]+)`"
BACKTICK_NAME = r"^`(?:[^`\n]++|``)++`\z"
BRACKET_NAME = r"^\[[A-Za-z_](?:[^\[\]\n]++|\]\])*+\]\z"
BLANKS = r"[ \t]{2,}"

# Statement classes, by first words, and what the converter does with the class.
STATEMENT_CLASSES = [
    ("create_table", r"^CREATE\s+TABLE"),
    ("insert", r"^INSERT\s"),
    ("create_index", r"^CREATE\s+(UNIQUE\s+)?INDEX"),
    ("drop_table", r"^DROP\s+TABLE"),
    ("alter_table", r"^ALTER\s+TABLE"),
    ("comment", r"^COMMENT\s"),
    ("use", r"^USE\s"),
    ("set", r"^SET\s"),
]
CONVERTED = ("create_table", "create_index", "drop_table", "insert")
SKIPPED = ("use", "set", "comment")
