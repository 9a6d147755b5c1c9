"""Tables derived row by row from the given ones: the drifted copy, text forms, catalogs, runs, scripts.

Each recipe is a list of expressions both engines read alike, so the checking
SQL and Spark start from the same rows. They only prepare input; no operator
under test lives here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.sources.tables import read_table

Recipe = list[tuple[str, str]]


def _exprs(recipe: Recipe) -> list[str]:
    return [f"{e} AS {n}" for n, e in recipe]


def derive(spark: SparkSession, sf: str, base: str, recipe: Recipe, where: str | None = None) -> DataFrame:
    """Rows of a recipe."""
    df = read_table(spark, sf, base)
    return (df.filter(where) if where else df).selectExpr(*_exprs(recipe))


def sql_of(base: str, recipe: Recipe, where: str | None = None) -> str:
    return f"SELECT {', '.join(_exprs(recipe))} FROM {base}" + (f" WHERE {where}" if where else "")


def rows(df: DataFrame, recipe: Recipe) -> DataFrame:
    return df.selectExpr(*_exprs(recipe))


# ---- the drifted copy of orders -------------------------------------------------
DRIFT: Recipe = [
    ("o_orderkey", "o_orderkey"),
    ("o_custkey", "o_custkey"),
    ("o_orderstatus", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus || '   ' ELSE o_orderstatus END"),
    (
        "o_totalprice",
        "CASE WHEN o_orderkey % 97 = 3 THEN o_totalprice + CAST(0.01 AS DOUBLE)"
        " WHEN o_orderkey % 89 = 5 THEN o_totalprice + CAST(0.0000000001 AS DOUBLE) ELSE o_totalprice END",
    ),
    ("o_orderdate", "o_orderdate"),
    ("o_orderpriority", "CASE WHEN o_orderkey % 83 = 11 THEN NULL ELSE o_orderpriority END"),
]
ADDED: Recipe = [
    ("o_orderkey", "o_orderkey + 10000000"),
    ("o_custkey", "o_custkey"),
    ("o_orderstatus", "o_orderstatus"),
    ("o_totalprice", "o_totalprice"),
    ("o_orderdate", "o_orderdate"),
    ("o_orderpriority", "o_orderpriority"),
]
ORDERS_TGT_SQL = f"{sql_of('orders', DRIFT, 'o_orderkey % 101 <> 7')} UNION ALL {sql_of('orders', ADDED, 'o_orderkey % 103 = 9')}"


def orders_tgt(spark: SparkSession, sf: str) -> DataFrame:
    kept = derive(spark, sf, "orders", DRIFT, "o_orderkey % 101 <> 7")
    return kept.unionByName(derive(spark, sf, "orders", ADDED, "o_orderkey % 103 = 9"))


# ---- lineitem copy without a key: one row in 97 lost, one in 89 doubled ----------
LINE_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
LINE_MARK = "(l_orderkey * 31 + l_partkey * 7 + l_linenumber)"
LINES: Recipe = [(c, f"{c} || '  '" if c == "l_linestatus" else c) for c in LINE_COLS]
LINEITEM_TGT_SQL = (
    f"{sql_of('lineitem', LINES, f'{LINE_MARK} % 97 <> 3')} UNION ALL {sql_of('lineitem', LINES, f'{LINE_MARK} % 89 = 5')}"
)


def lineitem_tgt(spark: SparkSession, sf: str) -> DataFrame:
    kept = derive(spark, sf, "lineitem", LINES, f"{LINE_MARK} % 97 <> 3")
    return kept.unionByName(derive(spark, sf, "lineitem", LINES, f"{LINE_MARK} % 89 = 5"))


# ---- customers pointing at nations that do not exist -----------------------------
ORPHANS: Recipe = [
    ("c_custkey", "c_custkey"),
    ("c_name", "c_name"),
    ("c_nationkey", "CASE WHEN c_custkey % 50 = 0 THEN c_nationkey + 100 WHEN c_custkey % 50 = 1 THEN NULL ELSE c_nationkey END"),
    ("c_acctbal", "c_acctbal"),
    ("c_mktsegment", "c_mktsegment"),
]

# ---- order dates as text ----------------------------------------------------------
_D = "CAST(o_orderdate AS STRING)"
_DAY = "split_part(CAST(o_orderdate AS STRING), ' ', 1)"
DATE_TEXT: Recipe = [
    ("o_orderkey", "o_orderkey"),
    (
        "dt_text",
        f"CASE o_orderkey % 9 WHEN 0 THEN {_D} WHEN 1 THEN {_D} || ' +08:00' WHEN 2 THEN {_D} || ' +0000 UTC'"
        f" WHEN 3 THEN {_DAY} || 'T10:20:30Z' WHEN 4 THEN {_DAY}"
        f" WHEN 5 THEN {_D} || '.' || CAST(o_custkey AS STRING) || ' +0800 CST m=+0.001'"
        f" WHEN 6 THEN {_DAY} || 'T01:02:03.1234567+05:30' WHEN 7 THEN {_D} || ' UTC' ELSE o_orderpriority END",
    ),
    ("note", "CASE WHEN o_orderkey % 9 = 4 THEN '' ELSE o_orderstatus || '  ' END"),
]

# ---- texts for the coercion and zero-date checks ------------------------------------
LOOSE_TEXT: Recipe = [
    ("o_orderkey", "o_orderkey"),
    (
        "raw",
        "CASE o_orderkey % 10 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN '-' || CAST(o_custkey AS STRING) || '.25'"
        " WHEN 2 THEN 'true' WHEN 3 THEN '0' WHEN 4 THEN 'yes' WHEN 5 THEN NULL WHEN 6 THEN '12abc'"
        " WHEN 7 THEN '1' WHEN 8 THEN 'false' ELSE o_orderpriority END",
    ),
    (
        "date_raw",
        f"CASE o_orderkey % 7 WHEN 0 THEN '0000-00-00' WHEN 1 THEN '0000-00-00 00:00:00' WHEN 2 THEN 'none'"
        f" WHEN 3 THEN NULL ELSE {_DAY} END",
    ),
]

# ---- values a narrower target cannot hold -------------------------------------------
WIDE_VALUES: Recipe = [
    ("o_orderkey", "o_orderkey"),
    ("big_id", "(o_orderkey % 20000) * 1000000000000"),
    ("signed_qty", "o_custkey - 300"),
    ("small_no", "o_orderkey % 70000"),
]

# ---- a catalog with one row per order: tables of about ten columns each -------------
BASE_TYPES = "INT,VARCHAR,BIGINT UNSIGNED,DECIMAL,DATETIME,TIMESTAMP(6),TEXT,BIT,JSON,NUMBER,UNIQUEIDENTIFIER,BOOLEAN,geometry,VARBINARY,YEAR,ENUM,DOUBLE PRECISION,SMALLINT"
N_BASE_TYPES = BASE_TYPES.count(",") + 1


def _catalog(kind: str, drifted: bool) -> Recipe:
    k = "o_orderkey"
    nullable = f"({k} % 3 <> 0)"
    default = (
        f"CASE {k} % 8 WHEN 0 THEN '0' WHEN 1 THEN 'CURRENT_TIMESTAMP' WHEN 2 THEN 'NULL' WHEN 3 THEN '''pending'''"
        f" WHEN 4 THEN '(1)' ELSE NULL END"
    )
    auto = f"({k} % 37 = 0)"
    name = f"'c_' || CAST({k} AS STRING)"
    if drifted:
        nullable = f"CASE WHEN {k} % 83 = 11 THEN NOT {nullable} ELSE {nullable} END"
        default = (
            f"CASE WHEN {k} % 79 = 13 THEN NULL WHEN {k} % 73 = 17 THEN 'now()' WHEN {k} % 8 = 4 THEN '1' ELSE {default} END"
        )
        auto = f"({k} % 37 = 0 AND {k} % 5 <> 0)"
        name = f"CASE WHEN {k} % 2 = 0 THEN 'C_' ELSE 'c_' END || CAST({k} AS STRING)"
    return [
        ("table_name", "'t' || CAST(o_custkey AS STRING)"),
        ("column_name", name),
        ("ordinal", f"{k}"),
        ("base_type", kind),
        (
            "data_type",
            f"CASE WHEN {kind} IN ('VARCHAR', 'VARBINARY') THEN {kind} || '(' || CAST({k} % 300 AS STRING) || ')' ELSE {kind} END",
        ),
        ("char_len", f"CASE WHEN {kind} IN ('VARCHAR', 'VARBINARY', 'BIT') THEN CAST({k} % 300 AS INT) ELSE NULL END"),
        ("num_precision", f"CASE WHEN {kind} = 'DECIMAL' AND {k} % 5 <> 0 THEN 18 ELSE NULL END"),
        ("num_scale", f"CASE WHEN {kind} = 'DECIMAL' AND {k} % 5 <> 0 THEN 2 ELSE NULL END"),
        ("is_unsigned", f"({kind} = 'BIGINT UNSIGNED')"),
        ("is_nullable", nullable),
        ("is_auto", auto),
        ("is_pk", f"({k} % 11 = 0)"),
        ("is_generated", f"({k} % 29 = 0)"),
        ("default_value", default),
    ]


_TYPE_A = f"split_part('{BASE_TYPES}', ',', CAST(1 + o_orderkey % {N_BASE_TYPES} AS INT))"
_TYPE_B = f"CASE WHEN o_orderkey % 89 = 5 THEN 'SMALLINT' WHEN o_orderkey % 71 = 2 THEN 'blobish' ELSE {_TYPE_A} END"
COLUMNS_A = _catalog(_TYPE_A, False)
COLUMNS_B = _catalog(_TYPE_B, True)
COLUMNS_EXTRA: Recipe = [(n, f"'x_' || CAST(o_orderkey AS STRING)" if n == "column_name" else e) for n, e in COLUMNS_A]
B_KEEPS = "o_orderkey % 97 <> 3 AND o_custkey % 101 <> 7"
CAT_A_SQL = sql_of("orders", COLUMNS_A)
CAT_B_SQL = f"{sql_of('orders', COLUMNS_B, B_KEEPS)} UNION ALL {sql_of('orders', COLUMNS_EXTRA, 'o_orderkey % 103 = 9 AND o_custkey % 101 <> 7')}"


def cat_columns(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, "orders", COLUMNS_A)


def cat_columns_b(spark: SparkSession, sf: str) -> DataFrame:
    extra = derive(spark, sf, "orders", COLUMNS_EXTRA, "o_orderkey % 103 = 9 AND o_custkey % 101 <> 7")
    return derive(spark, sf, "orders", COLUMNS_B, B_KEEPS).unionByName(extra)


# ---- index parts: one row per (index, position), from lineitem -----------------------
INDEX_PARTS: Recipe = [
    ("table_name", "'t' || CAST(l_suppkey AS STRING)"),
    ("index_name", "'ix_' || CAST(l_orderkey AS STRING)"),
    ("is_unique", "(l_orderkey % 4 = 0)"),
    ("is_primary", "(l_orderkey % 10 = 0)"),
    ("position", "l_linenumber"),
    ("column_name", "'c_' || CAST(l_partkey AS STRING)"),
]
INDEX_PARTS_SQL = sql_of("lineitem", INDEX_PARTS)

# ---- ready-made index facts, one per part; the other side renames, reorders and drops --
_IX_COLS = "'c_' || CAST(p_size AS STRING) || ',a_' || CAST(p_partkey % 7 AS STRING)"
_IX_COLS_REV = "'a_' || CAST(p_partkey % 7 AS STRING) || ',c_' || CAST(p_size AS STRING)"
INDEX_A: Recipe = [
    ("table_name", "'t' || CAST(p_partkey AS STRING)"),
    ("index_name", "'ix_' || CAST(p_partkey AS STRING)"),
    ("is_unique", "(p_size % 3 = 0)"),
    ("is_primary", "(p_partkey % 10 = 0)"),
    ("column_list", _IX_COLS),
]
INDEX_B: Recipe = [
    ("table_name", "'t' || CAST(p_partkey AS STRING)"),
    ("index_name", "'idx_' || CAST(p_partkey AS STRING)"),
    ("is_unique", "(p_size % 3 = 0 AND p_partkey % 41 <> 1)"),
    ("is_primary", "(p_partkey % 10 = 0)"),
    ("column_list", f"CASE WHEN p_partkey % 5 = 0 THEN {_IX_COLS_REV} ELSE {_IX_COLS} END"),
]

# ---- foreign keys, one per customer ----------------------------------------------------
FK_A: Recipe = [
    ("table_name", "'t' || CAST(c_custkey AS STRING)"),
    ("fk_name", "'fk_' || CAST(c_custkey AS STRING)"),
    ("column_list", "'nation_id,Segment_' || c_mktsegment"),
    ("ref_table", "'Nation_' || CAST(c_nationkey AS STRING)"),
    ("ref_list", "'id,segment'"),
]
FK_B: Recipe = [
    ("table_name", "'t' || CAST(c_custkey AS STRING)"),
    ("fk_name", "'FK2_' || CAST(c_custkey AS STRING)"),
    ("column_list", "CASE WHEN c_custkey % 3 = 0 THEN 'Segment_' || c_mktsegment || ',nation_id' ELSE 'NATION_ID,segment_' || c_mktsegment END"),
    ("ref_table", "CASE WHEN c_custkey % 31 = 4 THEN 'region' ELSE 'nation_' || CAST(c_nationkey AS STRING) END"),
    ("ref_list", "'id,segment'"),
]

# ---- table-level facts, one per customer ------------------------------------------------
TABLES_A: Recipe = [
    ("table_name", "CASE WHEN c_custkey % 9 = 4 THEN '_bak_t' || CAST(c_custkey AS STRING) || '_20260830_153022' WHEN c_custkey % 9 = 5 THEN '_bak_oddly_named' || CAST(c_custkey AS STRING) ELSE 't' || CAST(c_custkey AS STRING) END"),
    ("charset", "CASE c_custkey % 4 WHEN 0 THEN 'utf8mb4' WHEN 1 THEN 'gbk' WHEN 2 THEN 'latin1' ELSE '' END"),
    ("check_count", "CAST(c_custkey % 3 AS INT)"),
]
TABLES_B: Recipe = [
    ("table_name", "'t' || CAST(c_custkey AS STRING)"),
    ("charset", "CASE c_custkey % 5 WHEN 0 THEN 'UTF8MB4' WHEN 1 THEN 'gbk' WHEN 2 THEN 'utf8' ELSE '' END"),
]

# ---- names to be mapped to a target schema -----------------------------------------------
SOURCE_NAMES: Recipe = [
    ("source_table", "CASE o_custkey % 5 WHEN 0 THEN 'buoy_' WHEN 1 THEN 'berth' WHEN 2 THEN 'old_' WHEN 3 THEN 'buoy_north' ELSE 'quay_' END || CAST(o_orderkey AS STRING)"),
]
OVERRIDE_NAMES: Recipe = [
    ("source_table", "'old_' || CAST(o_orderkey AS STRING)"),
    ("target_schema", "CASE WHEN o_orderkey % 2 = 0 THEN 'keep' ELSE '' END"),
]

# ---- runs and their tables ----------------------------------------------------------------
RUNS: Recipe = [
    ("run_id", "o_orderkey"),
    ("created_at", "o_orderdate"),
    ("error", "CASE WHEN o_orderkey % 7 = 0 THEN 'timeout' ELSE '' END"),
    ("tables_success", "CAST(o_custkey % 3 AS INT)"),
]
RUN_TABLES: Recipe = [
    ("run_id", "l_orderkey"),
    ("table_no", "l_linenumber"),
    ("table_name", "'t' || CAST(l_partkey AS STRING)"),
    (
        "status",
        "CASE WHEN l_partkey % 10 = 0 THEN 'failed' WHEN l_partkey % 10 = 1 THEN 'rolled_back'"
        " WHEN l_partkey % 10 = 2 THEN 'cancelled' WHEN l_partkey % 10 = 3 THEN 'running' ELSE 'success' END",
    ),
    ("n_rows", "CAST(l_quantity AS BIGINT)"),
    ("total_rows", "CAST(l_quantity AS BIGINT) * (1 + l_partkey % 2)"),
]

# ---- documents, key-value entries and points from events ------------------------------------
_VALUE = "CAST(CAST(value AS DECIMAL(18,2)) AS STRING)"
DOCS: Recipe = [
    ("event_id", "event_id"),
    (
        "doc",
        "'{\"_id\":\"' || lpad(CAST(event_id AS STRING), 24, '0') || '\",\"user\":' || CAST(user_id AS STRING)"
        " || ',\"event_type\":\"' || event_type || '\",\"at\":\"' || CAST(ts AS STRING) || '\"'"
        " || CASE WHEN event_id % 3 = 0 THEN ',\"flag\":true' WHEN event_id % 3 = 1 THEN ',\"flag\":null' ELSE '' END"
        f" || ',\"amount\":' || CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS STRING) ELSE {_VALUE} END"
        f" || ',\"score\":' || CASE WHEN event_id % 5 = 0 THEN '\"n/a\"' ELSE {_VALUE} END"
        " || ',\"tags\":[\"' || event_type || '\"],\"props\":' || props || '}'",
    ),
]
ODD_DOCS: Recipe = [
    ("event_id", "event_id"),
    (
        "doc",
        "CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '{broken' WHEN 2 THEN '{\"a\":' || CAST(user_id AS STRING) || '} junk' WHEN 3 THEN '[' || CAST(user_id AS STRING) || ']'"
        " WHEN 4 THEN '\"text\"' WHEN 5 THEN 'null' WHEN 6 THEN '{\"a\":1},{\"a\":2}' WHEN 7 THEN '{\"a\":[1,{\"b\":null}]}' ELSE ' {\"a\":' || CAST(user_id AS STRING) || '} ' END",
    ),
]
DOC_ROWS: Recipe = [
    ("_id", "CASE event_id % 3 WHEN 0 THEN lpad(CAST(event_id AS STRING), 24, '0') WHEN 1 THEN 'a\"b' || CAST(event_id AS STRING) ELSE 'x' || chr(92) || 'y' || CAST(event_id AS STRING) END"),
    ("user", "CASE WHEN event_id % 7 <> 0 THEN user_id END"),
    ("props", "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no json' WHEN 2 THEN '{\"k\":1} tail' ELSE props END"),
    ("blob", "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'hex:zz' WHEN 2 THEN 'plain ' || event_type ELSE 'hex:' || lower(hex(event_type)) END"),
]
KV_ENTRIES: Recipe = [
    ("key", "CASE user_id % 4 WHEN 0 THEN 'profile:' WHEN 1 THEN 'feed:' WHEN 2 THEN 'seen:' ELSE 'rank:' END || CAST(user_id AS STRING)"),
    ("type", "CASE user_id % 4 WHEN 0 THEN 'hash' WHEN 1 THEN 'list' WHEN 2 THEN 'set' ELSE 'zset' END"),
    ("field", "event_type || '_' || CAST(event_id % 13 AS STRING)"),
    ("member", "event_type || '_' || CAST(event_id % 17 AS STRING)"),
    ("score", "CAST(event_id % 19 AS DOUBLE)"),
    ("seq", "event_id"),
]
KV_ROWS: Recipe = [
    ("key", "CASE WHEN event_id % 11 = 0 THEN 'bare' || CAST(event_id AS STRING) WHEN event_id % 23 = 0 THEN '' ELSE event_type || ':' || CAST(event_id AS STRING) || ':x' END"),
    ("type", "CASE event_id % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'hash' WHEN 2 THEN 'list' WHEN 3 THEN 'set' WHEN 4 THEN 'zset' ELSE 'hash' END"),
    (
        "value",
        "CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN '{\"a\":\"' || event_type || '\",\"b\":\"' || CAST(user_id AS STRING) || '\"}'"
        " WHEN 2 THEN '[\"' || event_type || '\",\"' || CAST(user_id AS STRING) || '\"]' WHEN 3 THEN '[\"' || CAST(user_id AS STRING) || '\"]'"
        " WHEN 4 THEN '[{\"Score\":' || CAST(user_id AS STRING) || ',\"Member\":\"' || event_type || '\"}]' ELSE 'plain ' || event_type END",
    ),
]
POINT_VALUE: Recipe = [
    ("measurement", "event_type"),
    ("tag_user", "'u' || CAST(user_id AS STRING)"),
    ("time", "ts"),
    ("field", "'value'"),
    ("field_type", "'float'"),
    ("field_value", "value"),
]
POINT_K: Recipe = [
    ("measurement", "event_type"),
    ("tag_user", "'u' || CAST(user_id AS STRING)"),
    ("time", "ts"),
    ("field", "'k'"),
    ("field_type", "'integer'"),
    ("field_value", "CAST(replace(split_part(props, ': ', 2), '}', '') AS DOUBLE)"),
]
POINTS_SQL = f"{sql_of('events', POINT_VALUE)} UNION ALL {sql_of('events', POINT_K, 'event_id % 7 <> 0')}"
WIDE_POINTS: Recipe = [
    ("time", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END"),
    ("tag_user", "'u' || CAST(user_id AS STRING)"),
    ("host", "'h' || CAST(user_id % 7 AS STRING)"),
    ("kind", "event_type"),
    ("value", "value"),
    ("score", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END"),
]


def points(spark: SparkSession, sf: str) -> DataFrame:
    second = derive(spark, sf, "events", POINT_K, "event_id % 7 <> 0")
    return derive(spark, sf, "events", POINT_VALUE).unionByName(second)


# ---- SQL scripts: one per document, its whole text as a literal or a comment -------------------
_T = "replace(text, '''', '''''')"
_NL = "chr(10)"
SCRIPTS: Recipe = [
    ("script_id", "doc_id"),
    (
        "sql",
        "CASE doc_id % 7"
        f" WHEN 0 THEN 'SELECT TOP 10 [id], ISNULL([note], ''' || {_T} || ''') AS note FROM [users] WHERE created > GETDATE() ORDER BY id;' || {_NL} || 'SELECT 2;'"
        f" WHEN 1 THEN '-- LIMIT 5 in a comment; GETDATE()' || {_NL} || 'INSERT INTO t (a, b) VALUES (1, ''' || {_T} || ''') ON DUPLICATE KEY UPDATE b = IFNULL(b, 0);' || {_NL} || 'SELECT LAST_INSERT_ID()'"
        f" WHEN 2 THEN '/* ' || {_T} || ' */ select `name`, NVL(code, 0), if(a > 1, 2, 3) from `users` limit 20, 10'"
        f" WHEN 3 THEN 'CREATE TABLE t (id INT); CREATE UNIQUE INDEX i ON t (id);' || {_NL} || 'COMMENT ON TABLE t IS ''' || {_T} || ''';' || {_NL} || 'USE db; SET NAMES utf8; DROP TABLE old'"
        f" WHEN 4 THEN 'MERGE INTO tgt USING src ON (1=1); EXEC sp_help ''' || {_T} || '''; CALL `proc`(1); SELECT @@IDENTITY; SELECT DATE_FORMAT(d, ''x''), GROUP_CONCAT(a) FROM t'"
        f" WHEN 5 THEN 'SELECT TOP 30 PERCENT tide FROM berth; SELECT TOP 2 s FROM (SELECT TOP 9 s FROM ship) q;' || {_NL} || 'ALTER TABLE t ADD c INT; select top  7   id  from t -- ' || 'trailing GETDATE()'"
        f" ELSE 'INSERT INTO t (a) VALUES ($1) ON CONFLICT (a) DO NOTHING RETURNING id; REPLACE INTO t VALUES (''' || {_T} || '''); SELECT CHARINDEX(''a'', b), DATEDIFF(day, a, b), @p1 FROM \"GETDATE()\"' END",
    ),
]
SCRIPTS_SQL = sql_of("documents", SCRIPTS)


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, "documents", SCRIPTS)


def tables_of(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    return {n: read_table(spark, sf, n) for n in names.split()}


# ---- scripts in the quoting of one source each; one in five never closes its last quote ------------
_B = "chr(92)"
_MY = f"replace(replace(text, {_B}, {_B} || {_B}), '''', {_B} || '''')"
MYSQL_SCRIPTS: Recipe = [
    ("script_id", "doc_id"),
    (
        "sql",
        "CASE doc_id % 5"
        f" WHEN 0 THEN 'SELECT `id;x`, IFNULL(note, ''' || {_MY} || ''') FROM `t``s` WHERE a = NVL(b, ''it' || {_B} || '''s; NVL(1'');' || {_NL} || 'SELECT `p\"q`, 2;'"
        f" WHEN 1 THEN '# NVL(1); note' || {_NL} || 'INSERT INTO t VALUES (''' || {_MY} || '; IFNULL(''); USE db; SET NAMES utf8'"
        f" WHEN 2 THEN '-- x; y' || {_NL} || 'CREATE TABLE t (a INT); ALTER TABLE `t` ADD b INT # tail; IFNULL(' || {_NL} || '; DROP TABLE old;'"
        f" WHEN 3 THEN 'SELECT IFNULL(a, ''' || {_MY} || {_B} || ''''"
        f" ELSE 'SELECT \"a' || {_B} || '\"; IFNULL(\", ifnull(`x`, 1) FROM t /* ; `y` */; COMMENT ON TABLE t IS ''' || {_MY} || '''' END",
    ),
]
MSSQL_SCRIPTS: Recipe = [
    ("script_id", "doc_id"),
    (
        "sql",
        "CASE doc_id % 5"
        f" WHEN 0 THEN 'SELECT TOP 10 * INTO #tmp FROM [a b] WHERE d < GETDATE();' || {_NL} || 'SELECT [x;y], ISNULL(n, ''' || {_T} || ''') FROM #tmp;'"
        f" WHEN 1 THEN '-- TOP 3' || {_NL} || 'CREATE TABLE #t (a INT); INSERT INTO #t VALUES (''' || {_T} || '''); DROP TABLE #t'"
        " WHEN 2 THEN 'select top  7   [TOP 4], [GETDATE()], NVL(x, 1) from [o]]p] -- tail'"
        f" WHEN 3 THEN 'SELECT NVL(a, ''' || {_T}"
        f" ELSE 'SELECT TOP 30 PERCENT x FROM t; EXEC sp_help ''' || {_T} || ''';' || {_NL} || ' MERGE INTO t USING s ON (1=1); SELECT @@IDENTITY, DATEDIFF(day, `a`, GETDATE())' END",
    ),
]
_PG = "replace(text, '$', '')"
POSTGRES_SCRIPTS: Recipe = [
    ("script_id", "doc_id"),
    (
        "sql",
        "CASE doc_id % 5"
        f" WHEN 0 THEN 'DO $$ NVL(a; ''b $$; SELECT `x`, ''' || {_T} || ''';'"
        f" WHEN 1 THEN 'CREATE INDEX i ON t (a); INSERT INTO t VALUES ($1, ''' || {_B} || '''); USE x'"
        f" WHEN 2 THEN 'SELECT $f$ ' || {_PG} || '; `y` $f$, a # `b` FROM t;' || {_NL} || 'SET x = 1'"
        f" WHEN 3 THEN 'SELECT `z`; SELECT $f$ ' || {_PG}"
        f" ELSE 'COMMENT ON TABLE t IS ''' || {_T} || '''; ALTER TABLE t ADD c INT; select `a;b`, `c`' END",
    ),
]
DIALECT_SCRIPTS = {"mysql": MYSQL_SCRIPTS, "mssql": MSSQL_SCRIPTS, "postgres": POSTGRES_SCRIPTS}


def dialect_scripts(spark: SparkSession, sf: str, source: str) -> DataFrame:
    return derive(spark, sf, "documents", DIALECT_SCRIPTS[source])
