"""Scripts cut, classed, audited and rewritten by the quoting of their own source.

The checking SQL has its own tokens for each source, and states every class, rule
and rewrite it expects as its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlift.operators import sqlcorpus as sc
from ledgerlift.plans import derived as d
from ledgerlift.plans.registry import query

TARGETS = {"mysql": "postgres", "mssql": "mysql", "postgres": "mssql"}

_PLAIN = r"""''[^'']*(?:''|\z)|"[^"]*(?:"|\z)"""
_REST = r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
_TOKEN = {
    "mysql": r"""''(?:[^''\\]|\\[\s\S]|\\\z)*(?:''|\z)|"(?:[^"\\]|\\[\s\S]|\\\z)*(?:"|\z)|`(?:[^`]|``)*(?:`|\z)|#[^\n]*|""" + _REST + r"""|[^''"`#/\-]+|[\s\S]""",
    "mssql": _PLAIN + r"|\[(?:[^\]]|\]\])*(?:\]|\z)|" + _REST + r"""|[^''"\[/\-]+|[\s\S]""",
    "postgres": _PLAIN + r"|\$\$[\s\S]*?(?:\$\$|\z)|\$f\$[\s\S]*?(?:\$f\$|\z)|" + _REST + r"""|[^''"$/\-]+|[\s\S]""",
}
_COMMENT = "(t LIKE '--%' OR t LIKE '/*%')"
_OTHER = {  # tokens that are no code: literals and comments
    "mysql": f"""(t LIKE '''%' OR t LIKE '"%' OR t LIKE '#%' OR {_COMMENT})""",
    "mssql": f"""(t LIKE '''%' OR t LIKE '"%' OR {_COMMENT})""",
    "postgres": f"""(t LIKE '''%' OR t LIKE '"%' OR t LIKE '$$%' OR t LIKE '$f$%' OR {_COMMENT})""",
}
_NAME = {"mysql": "t LIKE '`%'", "mssql": "t LIKE '[%'", "postgres": "false"}
_OPEN = {  # a last token that lacks its end
    "mysql": r"""regexp_matches(t, '^(''(?:[^''\\]|\\[\s\S])*\\?|"(?:[^"\\]|\\[\s\S])*\\?|`[^`]*|/\*([^*]|\*[^/])*\*?)\z')""",
    "mssql": r"""regexp_matches(t, '^(''[^'']*|"[^"]*|\[[^\]]*|/\*([^*]|\*[^/])*\*?)\z')""",
    "postgres": r"""regexp_matches(t, '^(''[^'']*|"[^"]*|\$\$([^$]|\$[^$])*|\$f\$([^$]|\$[^f])*|/\*([^*]|\*[^/])*\*?)\z')""",
}


def _tokens(c: str, source: str) -> str:
    return f"regexp_extract_all({c}, '{_TOKEN[source]}')"


def _each(c: str, source: str, fn: str) -> str:
    return f"array_to_string(list_transform({_tokens(c, source)}, lambda t: {fn}), '')"


def _scripts(source: str, closed: bool = False) -> str:
    last = f"(SELECT {_OPEN[source]} FROM (SELECT {_tokens('sql', source)}[-1] AS t))"
    return f"SELECT script_id, sql FROM ({d.sql_of('documents', d.DIALECT_SCRIPTS[source])})" + (f" WHERE NOT coalesce({last}, false)" if closed else "")


def _raw(source: str, closed: bool = False) -> str:
    """Pieces between the semicolons of code: script_id, statement_no, raw."""
    cut = _each("sql", source, f"CASE WHEN {_OTHER[source]} OR {_NAME[source]} THEN t ELSE replace(t, ';', chr(1)) END")
    return f"SELECT script_id, sql, CAST(generate_subscripts(p, 1) AS INT) AS statement_no, unnest(p) AS raw FROM (SELECT script_id, sql, string_split({cut}, chr(1)) AS p FROM ({_scripts(source, closed)}))"


def _statements(source: str) -> str:
    return f"SELECT script_id, statement_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS statement FROM ({_raw(source)}) WHERE regexp_matches(raw, '\\S')"


def _classes(source: str) -> str:
    is_comment = f"({_COMMENT} OR t LIKE '#%')" if source == "mysql" else _COMMENT
    head = f"upper(ltrim({_each('statement', source, f'CASE WHEN {is_comment} THEN repeat(chr(32), 0) ELSE t END')}, ' ' || chr(10))) || ' '"
    return f"""SELECT script_id, statement_no, statement, CASE WHEN regexp_matches(head, '^CREATE\\s+TABLE') THEN 'create_table' WHEN regexp_matches(head, '^INSERT\\s') THEN 'insert'
     WHEN regexp_matches(head, '^CREATE\\s+(UNIQUE\\s+)?INDEX') THEN 'create_index' WHEN regexp_matches(head, '^DROP\\s+TABLE') THEN 'drop_table' WHEN regexp_matches(head, '^ALTER\\s+TABLE') THEN 'alter_table'
     WHEN regexp_matches(head, '^COMMENT\\s') THEN 'comment' WHEN regexp_matches(head, '^USE\\s') THEN 'use' WHEN regexp_matches(head, '^SET\\s') THEN 'set' ELSE 'other' END AS class
     FROM (SELECT *, {head} AS head FROM ({_statements(source)}))"""


def _all(sql_of, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS source, {columns} FROM ({sql_of(s)})" for s in TARGETS)


def _stacked(spark, sf, fn) -> DataFrame:
    out = None
    for source in TARGETS:
        part = fn(d.dialect_scripts(spark, sf, source), source)
        part = part.select(F.lit(source).alias("source"), *part.columns)
        out = part if out is None else out.unionByName(part)
    return out


@query("sql_classes_by_source", _all(_classes, "script_id, statement_no, statement, class"))
def sql_classes_by_source(spark, sf):
    return _stacked(spark, sf, lambda df, s: sc.classify_statements(sc.explode_statements(df, source=s), source=s))


@query(
    "sql_conversion_by_source",
    _all(
        lambda s: f"""SELECT script_id, count(*) AS total_statements, count_if(class IN ('create_table', 'create_index', 'drop_table', 'insert'))::BIGINT AS converted,
        count_if(class IN ('alter_table', 'other'))::BIGINT AS passed, count_if(class IN ('use', 'set', 'comment'))::BIGINT AS skipped FROM ({_classes(s)}) GROUP BY script_id""",
        "*",
    ),
)
def sql_conversion_by_source(spark, sf):
    return _stacked(spark, sf, lambda df, s: sc.conversion_summary(sc.explode_statements(df, source=s), source=s))


@query(
    "sql_open_by_source",
    _all(lambda s: f"SELECT script_id FROM ({_scripts(s)}) WHERE script_id NOT IN (SELECT script_id FROM ({_scripts(s, True)}))", "script_id, 'a quote, a quoted name or a comment never closes' AS reason"),
)
def sql_open_by_source(spark, sf):
    return _stacked(spark, sf, lambda df, s: sc.convert_scripts(df, s, TARGETS[s])[1].drop("sql"))


# What each source's code turns into, in order; quoted names are turned by their own rule.
_CODE = {
    "mysql": [(r"\bIFNULL\s*\(", "COALESCE("), (r"\bNVL\s*\(", "COALESCE(")],
    "mssql": [(r"\bGETDATE\s*\(\s*\)", "NOW()"), (r"\bISNULL\s*\(", "COALESCE("), (r"\bNVL\s*\(", "COALESCE(")],
    "postgres": [(r"`([^`\n]+)`", r"[\1]")],
}
_TURNED = {
    "mysql": r"""CASE WHEN regexp_matches(t, '^`(?:[^`\n]|``)+`\z') THEN '"' || replace(replace(t[2:-2], '``', '`'), '"', '""') || '"' ELSE t END""",
    "mssql": r"""CASE WHEN regexp_matches(t, '^\[[A-Za-z_](?:[^\[\]\n]|\]\])*\]\z') THEN '`' || replace(replace(t[2:-2], ']]', ']'), '`', '``') || '`' ELSE t END""",
    "postgres": "t",
}
_TOP = r"(?i)\bTOP\s+(\d+)\b"
_UNSAFE = r"(?i)\bTOP\s+\d+\s+(?:PERCENT|WITH\s+TIES)"


def _flat(source: str) -> str:
    return _each("raw", source, f"CASE WHEN {_OTHER[source]} OR {_NAME[source]} THEN ' ' ELSE t END")


def _one_top(source: str) -> str:
    return f"(len(regexp_extract_all(flat, '{_TOP}')) = 1 AND NOT regexp_matches(flat, '{_UNSAFE}'))" if source == "mssql" else "false"


def _rewritten(source: str) -> str:
    code = rf"CASE WHEN one THEN regexp_replace(regexp_replace(t, '(?i)\bTOP\s+\d+\b', '', 'g'), '[ \t]{{2,}}', ' ', 'g') ELSE t END"
    for p, to in _CODE[source]:
        code = f"regexp_replace({code}, '(?i){p}', '{to}', 'g')"
    body = _each("raw", source, f"CASE WHEN {_OTHER[source]} THEN t WHEN {_NAME[source]} THEN {_TURNED[source]} ELSE {code} END")
    return rf"""SELECT script_id, string_agg(out, ';' || chr(10) ORDER BY statement_no) || CASE WHEN regexp_matches(any_value(sql), ';[ \t\r\n]*\z') THEN ';' ELSE '' END AS sql FROM (
      SELECT *, CASE WHEN one THEN regexp_replace(body, '[ \t\r\n]+$', '') || CASE WHEN {_tokens('raw', source)}[-1] LIKE '--%' THEN chr(10) ELSE ' ' END || 'LIMIT ' || regexp_extract(flat, '{_TOP}', 1) ELSE body END AS out FROM (
        SELECT *, {body} AS body FROM (SELECT *, {_one_top(source)} AS one FROM (SELECT *, {_flat(source)} AS flat, max(statement_no) OVER (PARTITION BY script_id) AS n FROM ({_raw(source, True)}))))
      WHERE statement_no < n OR regexp_matches(raw, '\S')) GROUP BY script_id"""


@query("sql_rewrite_by_source", _all(_rewritten, "*"))
def sql_rewrite_by_source(spark, sf):
    return _stacked(spark, sf, lambda df, s: sc.convert_scripts(df, s, TARGETS[s])[0])


def _changes(source: str) -> str:
    n = lambda *ps: " + ".join(f"len(regexp_extract_all(flat, '(?i){p}'))" for p in ps) or "0"
    renamed = {"mysql": r"^`(?:[^`\n]|``)+`\z", "mssql": r"^\[[A-Za-z_](?:[^\[\]\n]|\]\])*\]\z"}.get(source)
    names = f"len(list_filter({_tokens('raw', source)}, lambda t: regexp_matches(t, '{renamed}')))" if renamed else n(r"`[^`\n]+`")
    calls = {"mysql": [r"\bIFNULL\s*\(", r"\bNVL\s*\("], "mssql": [r"\bISNULL\s*\(", r"\bNVL\s*\("], "postgres": []}[source]
    now = [r"\bGETDATE\s*\(\s*\)"] if source == "mssql" else []
    counted = f"""SELECT script_id, sum(CAST({_one_top(source)} AS INT)) AS top_to_limit, sum({n(*now)}) AS now_calls, sum({n(*calls)}) AS coalesce_calls, sum({names}) AS quoted_names
      FROM (SELECT *, {_flat(source)} AS flat FROM ({_raw(source, True)})) GROUP BY script_id"""
    shown = ", ".join(f"CAST(coalesce({c}, 0) AS INT) AS {c}" for c in ("top_to_limit", "now_calls", "coalesce_calls", "quoted_names"))
    return f"SELECT script_id, {shown} FROM ({_scripts(source)}) LEFT JOIN ({counted}) USING (script_id)"


@query("sql_changes_by_source", _all(_changes, "*"))
def sql_changes_by_source(spark, sf):
    return _stacked(spark, sf, lambda df, s: sc.rewrite_changes(df, s, TARGETS[s]))


# Every rule a MySQL target has, written out.
_MYSQL_RULES = [
    ("bracket_name", "warning", r"\[[A-Za-z_][\w$#@ ]*\]"), ("top", "error", r"\bTOP\s+\d+"), ("getdate", "error", r"\bGETDATE\s*\(\s*\)"),
    ("last_identity", "error", r"\bSCOPE_IDENTITY\s*\(\s*\)|@@IDENTITY\b|@@ROWCOUNT\b"), ("datediff", "warning", r"\bDATEDIFF\s*\("), ("charindex", "warning", r"\bCHARINDEX\s*\("),
    ("isnull", "warning", r"\bISNULL\s*\(\s*[^)]+,"), ("returning", "error", r"\bRETURNING\b"), ("nvl", "warning", r"\bNVL\s*\("),
    ("merge", "warning", r"\bMERGE\s+(?:INTO\s+)?[`\"\[\w.]+"), ("on_conflict_mysql", "error", r"\bON\s+CONFLICT\b"), ("identity_query", "warning", r"SELECT\s+@@IDENTITY|SELECT\s+SCOPE_IDENTITY"),
    ("exec", "error", r"\bEXEC(?:UTE)?\s+(?:\[[^\]]+\]|(?:sp|usp|xp|dbo)_?\w+|dbo\.\w+)"), ("dollar_parameter", "info", r"\$\d+\b"),
]


def _audited(source: str) -> str:
    masked = _each("sql", source, f"CASE WHEN {_OTHER[source]} THEN regexp_replace(t, '[^\\n]', ' ', 'g') ELSE t END")
    hits = " UNION ALL ".join(
        f"SELECT script_id, '{i}' AS rule_id, '{s}' AS severity, len(regexp_extract_all(code, '(?i){p}'))::BIGINT AS n_hits, CAST(len(string_split(string_split_regex(code, '(?i){p}')[1], chr(10))) AS INT) AS first_line FROM code WHERE regexp_matches(code, '(?i){p}')"
        for i, s, p in _MYSQL_RULES
    )
    return f"WITH code AS (SELECT script_id, {masked} AS code FROM ({_scripts(source)})) {hits}"


@query("sql_audit_by_source", " UNION ALL ".join(f"SELECT '{s}' AS source, * FROM ({_audited(s)})" for s in TARGETS))
def sql_audit_by_source(spark, sf):
    """Hits of each rule and the line of the first, for a MySQL target, whatever source the scripts are from."""
    found = _stacked(spark, sf, lambda df, s: sc.audit_sql(df, "mysql", source=s))
    return found.groupBy("source", "script_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n_hits"), F.min("line_no").alias("first_line"))
