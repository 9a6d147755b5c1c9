"""Audit, split, classify and rewrite SQL scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.functions.sqltokens import mask_literals
from ledgerlift.operators import fixed_rules as fr
from ledgerlift.operators import sqlcorpus as sc
from ledgerlift.plans import derived as d
from ledgerlift.plans.registry import query

TARGET = "postgres"

# ---- checking SQL pieces --------------------------------------------------------
_TOKEN = r"""''[^'']*(?:''|\z)|"[^"]*(?:"|\z)|--[^\n]*|#[^\n]*|/\*[\s\S]*?(?:\*/|\z)|[^''"#/\-]+|[\s\S]"""
_IS_CODE = r"""(t NOT LIKE '''%' AND t NOT LIKE '"%' AND t NOT LIKE '#%' AND t NOT LIKE '--%' AND t NOT LIKE '/*%')"""
# A lone dash or slash is a token of its own here, which changes nothing for blanking or cutting.


def _tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '{_TOKEN}')"


def _mask(c: str) -> str:
    return f"array_to_string(list_transform({_tokens(c)}, lambda t: CASE WHEN {_IS_CODE} THEN t ELSE regexp_replace(t, '[^\\n]', ' ', 'g') END), '')"


def _cut(c: str) -> str:
    return f"string_split(array_to_string(list_transform({_tokens(c)}, lambda t: CASE WHEN {_IS_CODE} THEN replace(t, ';', chr(1)) ELSE t END), ''), chr(1))"


S_CTE = f"s AS ({d.SCRIPTS_SQL}), m AS (SELECT script_id, sql, {_mask('sql')} AS masked FROM s)"
L_CTE = f"{S_CTE}, l AS (SELECT script_id, sql AS written, masked AS code FROM m)"


def _hits_sql(rule: tuple[str, str, str, str]) -> str:
    i, category, severity, p = rule
    pat = "(?i)" + p.replace("'", "''")
    return f"""SELECT script_id, written, '{i}' AS rule_id, '{category}' AS category, '{severity}' AS severity, '{sc.ADVICE[i].replace("'", "''")}' AS suggestion,
     string_split_regex(code, '{pat}') AS gaps, regexp_extract_all(code, '{pat}') AS hits FROM l WHERE regexp_matches(code, '{pat}')"""


F_CTE = (
    f"{L_CTE}, r AS ({' UNION ALL '.join(_hits_sql(r) for r in sc.rules_for(TARGET))}), n AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM r),"
    """ p0 AS (SELECT script_id, rule_id, category, severity, suggestion, written, len(hits[i]) AS n_chars,
     1 + list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS pos FROM n),
     p AS (SELECT *, string_split(substr(written, 1, CAST(pos AS BIGINT) - 1), chr(10)) AS before FROM p0),
     f AS (SELECT script_id, CAST(len(before) AS INT) AS line_no, CAST(len(before[-1]) + 1 AS INT) AS column_no, rule_id, category, severity, suggestion,
     trim(CASE WHEN n_chars > 60 THEN substr(written, CAST(pos AS BIGINT), 57) || '...' ELSE substr(written, CAST(pos AS BIGINT), n_chars) END) AS snippet FROM p)"""
)
ST_CTE = f"{S_CTE}, pieces AS (SELECT script_id, {_cut('sql')} AS p FROM s), st AS (SELECT script_id, CAST(generate_subscripts(p, 1) AS INT) AS statement_no, unnest(p) AS raw FROM pieces), stm AS (SELECT script_id, statement_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS statement FROM st WHERE regexp_matches(raw, '\\S'))"
_CLASS = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(head, '{p}') THEN '{n}'" for n, p in fr.STATEMENT_CLASSES)
    + " ELSE 'other' END"
)
CL_CTE = (
    f"{ST_CTE}, cl AS (SELECT script_id, statement_no, {_CLASS} AS class FROM (SELECT script_id, statement_no, upper(ltrim(array_to_string(list_filter({_tokens('statement')},"
    " lambda t: NOT (t LIKE '#%' OR t LIKE '--%' OR t LIKE '/*%')), ''), ' ' || chr(10))) || ' ' AS head FROM stm))"
)


@query("sql_mask", f"WITH {S_CTE} SELECT script_id, masked FROM m")
def sql_mask(spark, sf):
    return d.scripts(spark, sf).select("script_id", mask_literals(F.col("sql")).alias("masked"))


@query("sql_statements", f"WITH {ST_CTE} SELECT * FROM stm")
def sql_statements(spark, sf):
    return sc.explode_statements(d.scripts(spark, sf))


@query("sql_classes", f"WITH {CL_CTE} SELECT * FROM cl")
def sql_classes(spark, sf):
    return sc.classify_statements(sql_statements(spark, sf)).drop("statement")


@query("sql_rule_match", f"WITH {F_CTE} SELECT DISTINCT script_id, rule_id FROM f")
def sql_rule_match(spark, sf):
    return sc.rule_match(d.scripts(spark, sf), TARGET)


@query("sql_audit", f"WITH {F_CTE} SELECT * FROM f")
def sql_audit(spark, sf):
    return sc.audit_sql(d.scripts(spark, sf), TARGET)


@query(
    "sql_audit_summary",
    f"""WITH {F_CTE}, c AS (SELECT script_id, len(string_split(written, chr(10))) AS total_lines FROM l)
    SELECT c.script_id, coalesce(count_if(severity = 'error'), 0)::BIGINT AS errors, coalesce(count_if(severity = 'warning'), 0)::BIGINT AS warnings, coalesce(count_if(severity = 'info'), 0)::BIGINT AS infos, max(total_lines) AS total_lines
    FROM c LEFT JOIN f ON c.script_id = f.script_id GROUP BY c.script_id""",
)
def sql_audit_summary(spark, sf):
    return sc.audit_summary(d.scripts(spark, sf), TARGET)


@query(
    "sql_conversion_summary",
    f"""WITH {CL_CTE} SELECT script_id, count(*) AS total_statements, count_if(class IN ('create_table', 'create_index', 'drop_table', 'insert'))::BIGINT AS converted,
    count_if(class IN ('alter_table', 'other'))::BIGINT AS passed, count_if(class IN ('use', 'set', 'comment'))::BIGINT AS skipped FROM cl GROUP BY script_id""",
)
def sql_conversion_summary(spark, sf):
    return sc.conversion_summary(sql_statements(spark, sf))


_FLAT = f"array_to_string(list_transform({_tokens('raw')}, lambda t: CASE WHEN {_IS_CODE} THEN t ELSE ' ' END), '')"
_SWAPS = [(r"\bGETDATE\s*\(\s*\)", "CURRENT_TIMESTAMP"), (r"\bISNULL\s*\(", "COALESCE("), (r"\bNVL\s*\(", "COALESCE("), (r"`([^`\n]+)`", r'"\1"'), (r"\[([A-Za-z_][^\[\]\n]*)\]", r'"\1"')]


def _swapped(c: str) -> str:
    for p, to in _SWAPS:
        c = f"regexp_replace({c}, '(?i){p}', '{to}', 'g')"
    return c


_ONE_TOP = r"(len(regexp_extract_all(flat, '(?i)\bTOP\s+\d+\b')) = 1 AND NOT regexp_matches(flat, '(?i)\bTOP\s+\d+\s+(?:PERCENT|WITH\s+TIES)'))"
_CODE_OUT = r"CASE WHEN one THEN regexp_replace(regexp_replace(t, '(?i)\bTOP\s+\d+\b', '', 'g'), '[ \t]{2,}', ' ', 'g') ELSE t END"


@query(
    "sql_rewrite",
    rf"""WITH {ST_CTE}, flat AS (SELECT *, {_FLAT} AS flat FROM st), one AS (SELECT *, {_ONE_TOP} AS one FROM flat),
    body AS (SELECT *, array_to_string(list_transform({_tokens('raw')}, lambda t: CASE WHEN {_IS_CODE} THEN {_swapped(_CODE_OUT)} ELSE t END), '') AS body FROM one),
    done AS (SELECT script_id, statement_no, raw, CASE WHEN one THEN regexp_replace(body, '[ \t\r\n]+$', '') || CASE WHEN regexp_matches({_tokens('raw')}[-1], '^(--|#)') THEN chr(10) ELSE ' ' END
      || 'LIMIT ' || regexp_extract(flat, '(?i)\bTOP\s+(\d+)\b', 1) ELSE body END AS out FROM body),
    keep AS (SELECT * FROM done d WHERE regexp_matches(raw, '\S') OR statement_no < (SELECT max(statement_no) FROM st WHERE st.script_id = d.script_id))
    SELECT k.script_id, string_agg(out, ';' || chr(10) ORDER BY statement_no) || CASE WHEN any_value(regexp_matches(s.sql, ';[ \t\r\n]*\z')) THEN ';' ELSE '' END AS sql FROM keep k JOIN s USING (script_id) GROUP BY k.script_id""",
)
def sql_rewrite(spark, sf):
    return sc.rewrite_sql(d.scripts(spark, sf), "mssql", TARGET)


@query(
    "sql_rewrite_changes",
    rf"""WITH {ST_CTE}, flat AS (SELECT script_id, statement_no, {_mask('raw')} AS flat FROM st)
    SELECT script_id, CAST(count_if({_ONE_TOP}) AS INT) AS top_to_limit, CAST(sum(len(regexp_extract_all(flat, '(?i)\bGETDATE\s*\(\s*\)'))) AS INT) AS now_calls,
    CAST(sum(len(regexp_extract_all(flat, '(?i)\bISNULL\s*\('))  + len(regexp_extract_all(flat, '(?i)\bNVL\s*\('))) AS INT) AS coalesce_calls,
    CAST(sum(len(regexp_extract_all(flat, '`[^`\n]+`')) + len(regexp_extract_all(flat, '\[[A-Za-z_][^\[\]\n]*\]'))) AS INT) AS quoted_names FROM flat GROUP BY script_id""",
)
def sql_rewrite_changes(spark, sf):
    return sc.rewrite_changes(d.scripts(spark, sf), "mssql", TARGET)


@query(
    "sql_requote_inserts",
    f"""WITH {ST_CTE} SELECT script_id, statement_no, array_to_string(list_transform({_tokens('statement')}, lambda t: CASE WHEN {_IS_CODE} THEN regexp_replace(t, '`([^`\\n]+)`', '"\\1"', 'g') ELSE t END), '') AS statement FROM stm""",
)
def sql_requote_inserts(spark, sf):
    return sql_statements(spark, sf).withColumn("statement", sc.requote_inserts(F.col("statement")))
