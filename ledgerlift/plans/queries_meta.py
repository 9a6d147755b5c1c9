"""Types, catalogs, structural differences and target names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.operators import naming, structure, typemap
from ledgerlift.operators import fixed_types as fx
from ledgerlift.plans import derived as d
from ledgerlift.plans.registry import query
from ledgerlift.sources.tables import read_table

# ---- checking SQL pieces -----------------------------------------------------------
# Fixed values, stated once more so that the check does not lean on the operator's own table.
_NAMES = """
TINYINT TINYINT,INT1,BYTE; SMALLINT SMALLINT,INT2,SMALLSERIAL,SHORT; INT MEDIUMINT,INT,INTEGER,INT4,SERIAL,COUNTER,AUTOINCREMENT,IDENTITY,LONG;
BIGINT BIGINT,INT8,BIGSERIAL; YEAR YEAR; DECIMAL DECIMAL,NUMERIC,NUMBER,MONEY,SMALLMONEY,CURRENCY; FLOAT REAL,FLOAT4,FLOAT,SINGLE; DOUBLE DOUBLE,DOUBLE PRECISION,FLOAT8;
BOOLEAN BOOLEAN,BOOL,LOGICAL,YESNO; BIT BIT; CHAR CHAR,NCHAR,CHARACTER,BPCHAR; VARCHAR VARCHAR,NVARCHAR,CHARACTER VARYING,VARCHAR2,SQL_VARIANT,SYSNAME;
TEXT TINYTEXT,TEXT,MEDIUMTEXT,LONGTEXT,CLOB,STRING,NTEXT,XML,MEMO,LONGCHAR; BLOB TINYBLOB,BLOB,MEDIUMBLOB,LONGBLOB,BYTEA,IMAGE,OLEOBJECT,LONGBINARY; BINARY BINARY,VARBINARY,RAW,ROWVERSION;
DATE DATE; TIME TIME,TIME WITHOUT TIME ZONE; DATETIME DATETIME,DATETIME2,SMALLDATETIME; TIMESTAMP TIMESTAMP,TIMESTAMP WITHOUT TIME ZONE,TIMESTAMPTZ,TIMESTAMP WITH TIME ZONE,DATETIMEOFFSET;
JSON JSON,JSONB; UUID UUID,UNIQUEIDENTIFIER,GUID; ENUM ENUM; SET SET
"""
_KIND_OF = {n: line.split()[0] for line in _NAMES.strip().split(";") for n in line.strip().split(" ", 1)[1].split(",")}
_ALIASES = ", ".join(f"('{n}', '{k}')" for n, k in _KIND_OF.items())
_BARE = "CASE WHEN strpos(upper(trim({c})), '(') > 1 THEN trim(left(upper(trim({c})), strpos(upper(trim({c})), '(') - 1)) ELSE upper(trim({c})) END"
_SIGNED = "regexp_replace(" + _BARE + ", '( UNSIGNED| ZEROFILL)$', '')"
KINDS_CTE = f"aliases AS (SELECT * FROM (VALUES {_ALIASES}) AS v(n, k))"


def _kind_sql(c: str) -> str:
    tries = (f"upper(trim({c}))", _BARE.format(c=c), _SIGNED.format(c=c))
    picks = ", ".join(f"(SELECT k FROM aliases WHERE n = {t})" for t in tries)
    return f"coalesce({picks}, '')"


A_CTE = f"a0 AS ({d.CAT_A_SQL}), ak AS (SELECT base_type, {_kind_sql('base_type')} AS kind FROM (SELECT DISTINCT base_type FROM a0)), a AS (SELECT a0.*, ak.kind FROM a0 JOIN ak USING (base_type))"
B_CTE = f"b0 AS ({d.CAT_B_SQL}), bk AS (SELECT base_type, {_kind_sql('base_type')} AS kind FROM (SELECT DISTINCT base_type FROM b0)), b AS (SELECT b0.*, bk.kind FROM b0 JOIN bk USING (base_type))"


def _size_sql(name: str, default: int | str) -> str:
    return f"'{name}(' || CASE WHEN char_len > 0 THEN CAST(char_len AS VARCHAR) ELSE '{default}' END || ')'"


_PS = "CASE WHEN num_precision IS NOT NULL AND num_scale IS NOT NULL THEN '{n}(' || num_precision || ', ' || num_scale || ')' ELSE '{e}' END"
_HAS_DEFAULT = "(trim(default_value) <> '' AND upper(trim(default_value)) <> 'NULL')"
MYSQL_SQL = f"""CASE
 WHEN kind = 'TEXT' AND {_HAS_DEFAULT} AND lower(replace(trim(default_value), '()', '')) IN ('current_timestamp', 'now', 'sysdate') THEN 'DATETIME'
 WHEN kind IN ('TEXT', 'JSON') AND {_HAS_DEFAULT} THEN {_size_sql('VARCHAR', 255)}
 WHEN kind IN ('TINYINT', 'SMALLINT', 'INT', 'BIGINT', 'FLOAT', 'DOUBLE') THEN kind || CASE WHEN is_unsigned THEN ' UNSIGNED' ELSE '' END
 WHEN kind IN ('YEAR', 'TEXT', 'JSON', 'DATETIME', 'TIMESTAMP', 'DATE', 'TIME') THEN kind
 WHEN kind = 'DECIMAL' THEN {_PS.format(n='DECIMAL', e='DECIMAL')} WHEN kind = 'BOOLEAN' THEN 'TINYINT(1)' WHEN kind = 'BIT' THEN {_size_sql('BIT', 1)}
 WHEN kind = 'VARCHAR' THEN {_size_sql('VARCHAR', 255)} WHEN kind = 'BINARY' THEN {_size_sql('VARBINARY', 255)}
 WHEN kind = 'UUID' THEN 'VARCHAR(36)' WHEN kind = 'ENUM' THEN 'VARCHAR(50)' ELSE data_type END"""
POSTGRES_SQL = f"""CASE
 WHEN kind IN ('TINYINT', 'SMALLINT', 'YEAR') THEN 'SMALLINT' WHEN kind = 'INT' THEN CASE WHEN is_auto THEN 'SERIAL' ELSE 'INTEGER' END
 WHEN kind = 'BIGINT' THEN CASE WHEN is_auto THEN 'BIGSERIAL' ELSE 'BIGINT' END WHEN kind = 'DECIMAL' THEN {_PS.format(n='NUMERIC', e='NUMERIC')}
 WHEN kind = 'DOUBLE' THEN 'DOUBLE PRECISION' WHEN kind = 'BIT' AND (char_len IS NULL OR char_len = 1) THEN 'BOOLEAN' WHEN kind = 'BIT' THEN 'BIT(' || char_len || ')'
 WHEN kind = 'VARCHAR' THEN {_size_sql('VARCHAR', 255)} WHEN kind = 'BINARY' THEN 'BYTEA' WHEN kind IN ('DATETIME', 'TIMESTAMP') THEN 'TIMESTAMP'
 WHEN kind = 'JSON' THEN 'JSONB' WHEN kind IN ('BOOLEAN', 'TEXT', 'UUID') THEN kind WHEN kind = 'ENUM' THEN 'VARCHAR(50)' ELSE data_type END"""
MSSQL_SQL = f"""CASE
 WHEN kind IN ('INT', 'BIGINT', 'SMALLINT') THEN kind WHEN kind = 'YEAR' THEN 'SMALLINT' WHEN kind = 'DECIMAL' THEN {_PS.format(n='DECIMAL', e='DECIMAL(18,0)')}
 WHEN kind = 'DOUBLE' THEN 'FLOAT(53)' WHEN kind = 'BOOLEAN' THEN 'BIT' WHEN kind = 'BIT' AND char_len > 1 THEN 'BINARY(' || char_len || ')' WHEN kind = 'BIT' THEN 'BIT'
 WHEN kind = 'VARCHAR' THEN {_size_sql('NVARCHAR', 255)} WHEN kind = 'BINARY' THEN {_size_sql('VARBINARY', 'MAX')} WHEN kind IN ('TEXT', 'JSON') THEN 'NVARCHAR(MAX)'
 WHEN kind IN ('DATETIME', 'TIMESTAMP') THEN 'DATETIME2' WHEN kind = 'UUID' THEN 'UNIQUEIDENTIFIER' WHEN kind = 'ENUM' THEN 'NVARCHAR(50)' ELSE data_type END"""
_ACCESS_SQL = f"""CASE WHEN kind IN ('SMALLINT', 'YEAR') THEN 'SHORT' WHEN kind = 'INT' THEN CASE WHEN is_auto THEN 'AUTOINCREMENT' ELSE 'LONG' END
 WHEN kind IN ('BIGINT', 'DOUBLE') THEN 'DOUBLE' WHEN kind = 'DECIMAL' THEN 'CURRENCY' WHEN kind IN ('BOOLEAN', 'BIT') THEN 'YESNO' WHEN kind = 'VARCHAR' THEN {_size_sql('VARCHAR', 255)}
 WHEN kind IN ('TEXT', 'JSON') THEN 'LONGTEXT' WHEN kind = 'BINARY' THEN 'OLEOBJECT' WHEN kind IN ('DATETIME', 'TIMESTAMP') THEN 'DATETIME' WHEN kind = 'UUID' THEN 'VARCHAR(38)' ELSE 'VARCHAR(255)' END"""


def _simple_sql(pairs: dict[str, str], other: str) -> str:
    cases = " ".join(f"WHEN kind IN ({', '.join(repr(k) for k in ks.split())}) THEN '{t}'" for ks, t in pairs.items())
    return f"CASE {cases} ELSE {other} END"


DIALECT_SQL = {
    "mysql": MYSQL_SQL,
    "postgres": POSTGRES_SQL,
    "mssql": MSSQL_SQL,
    "access": _ACCESS_SQL,
    "sqlite": _simple_sql({"SMALLINT INT BIGINT YEAR BOOLEAN BIT": "INTEGER", "DECIMAL DOUBLE": "REAL", "VARCHAR TEXT ENUM DATETIME TIMESTAMP JSON UUID": "TEXT", "BINARY": "BLOB"}, "data_type"),
    "mongodb": _simple_sql({"SMALLINT INT YEAR": "int32", "BIGINT": "int64", "DECIMAL DOUBLE": "double", "BOOLEAN BIT": "bool", "BINARY": "binData", "DATETIME TIMESTAMP": "date", "JSON": "object"}, "'string'"),
    "redis": _simple_sql({"SMALLINT INT BIGINT YEAR": "string:int", "DECIMAL DOUBLE": "string:float", "BOOLEAN BIT": "string:bool", "DATETIME TIMESTAMP": "string:datetime", "JSON": "hash", "BINARY": "string:bytes"}, "'string'"),
    "influxdb": _simple_sql({"SMALLINT INT BIGINT YEAR": "INT", "DECIMAL DOUBLE": "FLOAT", "BOOLEAN BIT": "BOOLEAN", "DATETIME TIMESTAMP": "TIMESTAMP"}, "'STRING'"),
    "cassandra": _simple_sql({"SMALLINT YEAR": "SMALLINT", "INT": "INT", "BIGINT": "BIGINT", "DECIMAL DOUBLE": "DOUBLE", "BOOLEAN BIT": "BOOLEAN", "VARCHAR TEXT JSON ENUM": "TEXT", "BINARY": "BLOB", "DATETIME TIMESTAMP": "TIMESTAMP", "UUID": "UUID"}, "data_type"),
    "oracle": _simple_sql({"SMALLINT YEAR": "NUMBER(5)", "INT": "NUMBER(10)", "BIGINT": "NUMBER(19)", "DOUBLE": "BINARY_DOUBLE", "BOOLEAN": "NUMBER(1)", "BIT": "RAW(1)", "TEXT JSON": "CLOB", "BINARY": "BLOB", "DATETIME TIMESTAMP": "TIMESTAMP", "UUID": "VARCHAR2(36)", "ENUM": "VARCHAR2(200)"},
        f"CASE WHEN kind = 'DECIMAL' THEN {_PS.format(n='NUMBER', e='NUMBER')} WHEN kind = 'VARCHAR' THEN {_size_sql('VARCHAR2', 255)} ELSE data_type END"),
    "db2": _simple_sql({"SMALLINT YEAR BOOLEAN": "SMALLINT", "INT": "INTEGER", "BIGINT": "BIGINT", "DOUBLE": "DOUBLE", "BIT": "CHAR(1) FOR BIT DATA", "TEXT JSON": "CLOB(1M)", "BINARY": "BLOB(1M)", "DATETIME TIMESTAMP": "TIMESTAMP", "UUID": "VARCHAR(36)", "ENUM": "VARCHAR(200)"},
        f"CASE WHEN kind = 'DECIMAL' THEN {_PS.format(n='DECIMAL', e='DECIMAL(31,0)')} WHEN kind = 'VARCHAR' THEN {_size_sql('VARCHAR', 255)} ELSE data_type END"),
    "tdengine": _simple_sql({"SMALLINT YEAR": "SMALLINT", "INT": "INT", "BIGINT": "BIGINT", "DECIMAL DOUBLE": "DOUBLE", "BOOLEAN BIT": "BOOL", "TEXT JSON BINARY": "NCHAR(255)", "DATETIME TIMESTAMP": "TIMESTAMP", "UUID": "VARCHAR(36)", "ENUM": "VARCHAR(200)"},
        f"CASE WHEN kind = 'VARCHAR' THEN {_size_sql('VARCHAR', 255)} ELSE data_type END"),
}


# ---- types ---------------------------------------------------------------------------
@query("neutral_kind", f"WITH {KINDS_CTE}, {A_CTE} SELECT table_name, column_name, base_type, kind FROM a")
def neutral_kind(spark, sf):
    kind = typemap.neutral_kind(F.col("base_type")).alias("kind")
    return d.cat_columns(spark, sf).select("table_name", "column_name", "base_type", kind)


# Every known name and some unknown ones, in other cases, with parameters and with marks behind them.
_ALL = ",".join([*_KIND_OF, "HYPERCUBE", "", "INTERVAL DAY"])
_NAMED: d.Recipe = [
    ("o_orderkey", "o_orderkey"),
    ("bare", f"split_part('{_ALL}', ',', CAST(1 + o_orderkey % {_ALL.count(',') + 1} AS INT))"),
]
_FORMS: d.Recipe = [
    ("o_orderkey", "o_orderkey"),
    ("bare", "bare"),
    ("base_type", "CASE WHEN bare = '' OR o_orderkey % 5 = 0 THEN bare WHEN o_orderkey % 5 = 1 THEN lower(bare) || '(12,3)' WHEN o_orderkey % 5 = 2 THEN ' ' || bare || ' (4)' WHEN o_orderkey % 5 = 3 THEN bare || ' unsigned' ELSE lower(bare) || ' ZEROFILL' END"),
]
_FORMS_SQL = f"SELECT {', '.join(f'{e} AS {n}' for n, e in _FORMS)} FROM ({d.sql_of('orders', _NAMED)})"


@query("neutral_kind_names", f"WITH {KINDS_CTE} SELECT o_orderkey, base_type, coalesce(k, '') AS kind FROM ({_FORMS_SQL}) LEFT JOIN aliases ON n = bare")
def neutral_kind_names(spark, sf):
    forms = d.rows(d.derive(spark, sf, "orders", _NAMED), _FORMS)
    return forms.select("o_orderkey", "base_type", typemap.neutral_kind(F.col("base_type")).alias("kind"))


@query(
    "target_type",
    f"WITH {KINDS_CTE}, {A_CTE} SELECT table_name, column_name, " + ", ".join(f"{s} AS {n}" for n, s in DIALECT_SQL.items()) + " FROM a",
)
def target_type(spark, sf):
    cat = d.cat_columns(spark, sf).withColumn("kind", typemap.neutral_kind(F.col("base_type")))
    return cat.select("table_name", "column_name", *[typemap.target_type(n, F.col("kind")).alias(n) for n in DIALECT_SQL])


def _changes_sql(dialect: str, notes: dict[str, str]) -> str:
    note = " ".join(f"WHEN kind = '{k}' THEN '{t}'" for k, t in notes.items())
    return (
        f"SELECT table_name, column_name, data_type AS source_type, t AS target_type, CASE {note} WHEN is_unsigned THEN '{fx.UNSIGNED_LOST}' ELSE '' END AS note"
        f" FROM (SELECT *, {DIALECT_SQL[dialect]} AS t FROM a) WHERE lower(replace(t, ' ', '')) <> lower(replace(data_type, ' ', ''))"
    )


_NOTES = fx.CHANGE_NOTES
_PG_NOTES = _NOTES | {"JSON": fx.JSON_NOTE_POSTGRES, "DATETIME": fx.TIME_NOTE_POSTGRES, "TIMESTAMP": fx.TIME_NOTE_POSTGRES}


@query("type_changes", f"WITH {KINDS_CTE}, {A_CTE} {_changes_sql('postgres', _PG_NOTES)}")
def type_changes(spark, sf):
    return typemap.type_changes(d.cat_columns(spark, sf), "postgres")


@query(
    "default_literals",
    f"""SELECT table_name, column_name, CASE WHEN regexp_matches(v, '^-?\\d+(\\.\\d+)?$') THEN v WHEN lower(replace(v, '()', '')) IN ('current_timestamp', 'now') THEN 'CURRENT_TIMESTAMP'
     WHEN lower(v) = 'null' THEN 'NULL' WHEN starts_with(v, '''') THEN v ELSE '''' || replace(v, '''', '''''') || '''' END AS default_text,
     CASE WHEN starts_with(v, '''') THEN v ELSE v || '::text' END AS cast_text
    FROM (SELECT table_name, column_name, trim(default_value) AS v FROM ({d.CAT_B_SQL}) WHERE default_value IS NOT NULL)""",
)
def default_literals(spark, sf):
    cat = d.cat_columns_b(spark, sf).filter("default_value IS NOT NULL")
    cast = F.when(F.col("default_value").startswith("'"), F.concat("default_value", F.lit("::character varying")))
    kept = F.concat("default_value", F.lit("::text"))
    return cat.select(
        "table_name",
        "column_name",
        typemap.default_literal(F.col("default_value")).alias("default_text"),
        F.coalesce(typemap.strip_default_cast(cast), kept).alias("cast_text"),
    )


_WIDE = [
    ("o_orderkey", "o_orderkey"), ("is_open", "(o_orderstatus = 'O')"), ("price", "CAST(o_totalprice AS DECIMAL(18,2))"),
    ("o_orderdate", "o_orderdate"), ("day", "CAST(o_orderdate AS DATE)"), ("o_orderpriority", "o_orderpriority"),
]
_WIDE_SQL = d.sql_of("orders", _WIDE)


@query(
    "cast_sqlite",
    f"SELECT o_orderkey, CAST(is_open AS INT) AS is_open, CAST(price AS DOUBLE) AS price, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, strftime(day, '%Y-%m-%d') AS day, o_orderpriority FROM ({_WIDE_SQL})",
)
def cast_sqlite(spark, sf):
    return typemap.cast_to_target(d.derive(spark, sf, "orders", _WIDE), "sqlite")


@query(
    "cast_document",
    f"SELECT o_orderkey, is_open, CAST(price AS DOUBLE) AS price, o_orderdate, CAST(day AS TIMESTAMP) AS day, o_orderpriority FROM ({_WIDE_SQL})",
)
def cast_document(spark, sf):
    return typemap.cast_to_target(d.derive(spark, sf, "orders", _WIDE), "mongodb")


@query(
    "cast_desktop",
    f"SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, is_open, CAST(price AS DOUBLE) AS price, o_orderdate, CAST(day AS TIMESTAMP) AS day, o_orderpriority FROM ({_WIDE_SQL})",
)
def cast_desktop(spark, sf):
    cast = typemap.cast_to_target(d.derive(spark, sf, "orders", _WIDE), "access")
    return cast.withColumn("price", F.col("price").cast("double"))


# ---- catalogs and their differences ----------------------------------------------------
# The columns of all given tables; orders is the drifted copy.
_TABLE_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
_KIND_BY_TYPE = {"int": "INT", "bigint": "BIGINT", "string": "TEXT", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "array<float>": "JSON"}


def _catalog_sql(table: str, columns: str) -> str:
    source = "t" if table == "orders" else table
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, CAST({i} AS INT) AS ordinal, '{_KIND_BY_TYPE[k]}' AS base_type, '{k}' AS data_type, CAST(NULL AS INT) AS num_precision,"
        f" CAST(NULL AS INT) AS num_scale, count(*) > count({c}) AS is_nullable, count(*) AS n_rows FROM {source}"
        for i, (c, k) in enumerate((x.split(" ") for x in columns.split(", ")), 1)
    )


@query("catalog_columns", f"WITH t AS ({d.ORDERS_TGT_SQL}) " + " UNION ALL ".join(_catalog_sql(t, c) for t, c in _TABLE_COLUMNS.items()))
def catalog_columns(spark, sf):
    return structure.build_catalog(spark, {**d.tables_of(spark, sf), "orders": d.orders_tgt(spark, sf)})


def _clean_sql(c: str) -> str:
    return f"trim(replace(replace(lower(trim({c})), '(', ''), ')', ''), '''\"')"


_FINDINGS = {
    ("column", "error", "'missing in target: ' || a.data_type"): "b.column_name IS NULL",
    ("column", "info", "'only in target: ' || b.data_type"): "a.column_name IS NULL",
    ("type", "warning", "a.data_type || ' -> ' || b.data_type"): "a.kind <> '' AND b.kind <> '' AND a.kind <> b.kind",
    ("type", "warning", "'unrecognised ' || a.data_type || ' -> ' || b.data_type"): "a.kind <> '' AND b.kind = ''",
    ("nullable", "warning", "'target forbids NULL'"): "a.is_nullable AND NOT b.is_nullable",
    ("nullable", "info", "'target allows NULL'"): "NOT a.is_nullable AND b.is_nullable",
    ("increment", "warning", "'identity lost'"): "a.is_auto AND NOT b.is_auto",
    ("default", "info", "a.default_value || ' -> ' || b.default_value"): f"{_clean_sql('a.default_value')} <> {_clean_sql('b.default_value')}",
    ("default", "warning", "'lost ' || trim(a.default_value)"): "a.column_name IS NOT NULL AND b.column_name IS NOT NULL AND b.default_value IS NULL AND trim(a.default_value) <> '' AND upper(trim(a.default_value)) <> 'NULL'",
}
_DIFF_CTE = (
    f"{KINDS_CTE}, {A_CTE}, {B_CTE}, ac AS (SELECT * FROM a WHERE table_name IN (SELECT table_name FROM b)), bc AS (SELECT * FROM b WHERE table_name IN (SELECT table_name FROM a)), cd AS ("
    + " UNION ALL ".join(
        f"SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name, '{c}' AS category, '{s}' AS severity, {m} AS message"
        f" FROM ac a FULL OUTER JOIN bc b ON a.table_name = b.table_name AND lower(a.column_name) = lower(b.column_name) WHERE {w}"
        for (c, s, m), w in _FINDINGS.items()
    )
    + ")"
)


@query("column_diff", f"WITH {_DIFF_CTE} SELECT * FROM cd")
def column_diff(spark, sf):
    return structure.column_diff(d.cat_columns(spark, sf), d.cat_columns_b(spark, sf))


@query("default_diff", f"WITH {_DIFF_CTE} SELECT * FROM cd WHERE category = 'default'")
def default_diff(spark, sf):
    return structure.default_diff(d.cat_columns(spark, sf), d.cat_columns_b(spark, sf))


@query("table_diff", f"SELECT DISTINCT table_name FROM ({d.CAT_A_SQL}) WHERE table_name NOT IN (SELECT table_name FROM ({d.CAT_B_SQL}))")
def table_diff(spark, sf):
    return structure.table_diff(d.cat_columns(spark, sf), d.cat_columns_b(spark, sf))


@query(
    "column_sets",
    f"""WITH a AS (SELECT DISTINCT table_name, lower(column_name) AS column_name FROM ({d.CAT_A_SQL})), b AS (SELECT DISTINCT table_name, lower(column_name) AS column_name FROM ({d.CAT_B_SQL}))
    SELECT table_name, column_name, CASE WHEN b.table_name IS NULL THEN 'source' WHEN a.table_name IS NULL THEN 'target' ELSE 'both' END AS side FROM a FULL OUTER JOIN b USING (table_name, column_name)""".replace(
        "b.table_name IS NULL", "b.t IS NULL").replace("a.table_name IS NULL", "a.t IS NULL").replace(
        "SELECT DISTINCT table_name, lower(column_name) AS column_name", "SELECT DISTINCT table_name, lower(column_name) AS column_name, 1 AS t"),
)
def column_sets(spark, sf):
    return structure.column_sets(d.cat_columns(spark, sf), d.cat_columns_b(spark, sf))


def _lists(df, *cols):
    """Comma text to arrays, as the catalogs of a database would give them."""
    for text, name in cols:
        df = df.withColumn(name, F.split(text, ",")).drop(text)
    return df


def indexes(spark, sf, recipe):
    return _lists(d.derive(spark, sf, "part", recipe), ("column_list", "columns"))


def fks(spark, sf, recipe):
    return _lists(d.derive(spark, sf, "customer", recipe), ("column_list", "columns"), ("ref_list", "ref_columns"))


def _sorted_sql(c: str) -> str:
    return f"array_to_string(list_sort(string_split({c}, ',')), ',')"


_IX_SQL = f"""SELECT table_name, index_name, is_unique, column_list FROM ({d.sql_of('part', d.INDEX_A)}) a WHERE NOT is_primary AND NOT EXISTS (
  SELECT 1 FROM ({d.sql_of('part', d.INDEX_B, 'p_partkey % 97 <> 3')}) b WHERE NOT b.is_primary AND b.table_name = a.table_name AND b.is_unique = a.is_unique
  AND {_sorted_sql('b.column_list')} = {_sorted_sql('a.column_list')})"""
_FK_SQL = f"""SELECT table_name, fk_name, column_list, ref_table, ref_list FROM ({d.sql_of('customer', d.FK_A)}) a WHERE NOT EXISTS (
  SELECT 1 FROM ({d.sql_of('customer', d.FK_B, 'c_custkey % 50 <> 0')}) b WHERE b.table_name = a.table_name AND lower(b.ref_table) = lower(a.ref_table)
  AND lower({_sorted_sql('b.column_list')}) = lower({_sorted_sql('a.column_list')}) AND {_sorted_sql('b.ref_list')} = {_sorted_sql('a.ref_list')})"""


def _index_b(spark, sf):
    return _lists(d.derive(spark, sf, "part", d.INDEX_B, "p_partkey % 97 <> 3"), ("column_list", "columns"))


def _fk_b(spark, sf):
    return _lists(d.derive(spark, sf, "customer", d.FK_B, "c_custkey % 50 <> 0"), ("column_list", "columns"), ("ref_list", "ref_columns"))


@query("index_diff", _IX_SQL)
def index_diff(spark, sf):
    lost = structure.index_diff(indexes(spark, sf, d.INDEX_A), _index_b(spark, sf))
    return lost.select("table_name", "index_name", "is_unique", F.concat_ws(",", "columns").alias("column_list"))


@query("fk_diff", _FK_SQL)
def fk_diff(spark, sf):
    lost = structure.fk_diff(fks(spark, sf, d.FK_A), _fk_b(spark, sf))
    return lost.select(
        "table_name", "fk_name", F.concat_ws(",", "columns").alias("column_list"), "ref_table", F.concat_ws(",", "ref_columns").alias("ref_list")
    )


@query(
    "constraint_columns",
    f"SELECT table_name, fk_name AS constraint_name, ref_table, column_list, ref_list FROM ({d.sql_of('customer', d.FK_A)})",
)
def constraint_columns(spark, sf):
    facts = fks(spark, sf, d.FK_A).withColumnRenamed("fk_name", "constraint_name")
    key_cols = facts.select("table_name", "constraint_name", F.posexplode("columns").alias("position", "column_name"))
    ref_cols = facts.select("table_name", "constraint_name", "ref_table", F.posexplode("ref_columns").alias("position", "ref_column"))
    out = structure.constraint_columns(facts, key_cols, ref_cols)
    return out.select(
        "table_name", "constraint_name", "ref_table", F.concat_ws(",", "columns").alias("column_list"), F.concat_ws(",", "ref_columns").alias("ref_list")
    )


_ASSEMBLED = f"""SELECT table_name, index_name, bool_or(is_unique) AS is_unique, bool_or(is_primary) AS is_primary,
 string_agg(column_name, ',' ORDER BY position, column_name) AS column_list FROM ({d.INDEX_PARTS_SQL}) GROUP BY table_name, index_name"""


@query("assemble_indexes", _ASSEMBLED)
def assemble_indexes(spark, sf):
    out = structure.assemble_indexes(d.derive(spark, sf, "lineitem", d.INDEX_PARTS))
    return out.select("table_name", "index_name", "is_unique", "is_primary", F.concat_ws(",", "columns").alias("column_list"))


@query(
    "choose_key",
    f"""WITH i AS ({_ASSEMBLED}), c AS (SELECT DISTINCT 't' || l_suppkey AS table_name, 'c_' || l_partkey AS column_name, l_partkey % 3 = 0 AS is_nullable FROM lineitem),
    r AS (SELECT i.table_name, index_name, column_list, CASE WHEN is_primary THEN 1 WHEN is_unique AND strpos(column_list, ',') = 0 AND NOT is_nullable THEN 2 END AS rank
     FROM i LEFT JOIN c ON i.table_name = c.table_name AND split_part(i.column_list, ',', 1) = c.column_name),
    n AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY rank NULLS LAST, index_name) AS rn FROM r)
    SELECT table_name, CASE rank WHEN 1 THEN 'primary' WHEN 2 THEN 'unique' ELSE 'none' END AS key_source, CASE WHEN rank IS NULL THEN '' ELSE column_list END AS key_columns FROM n WHERE rn = 1""",
)
def choose_key(spark, sf):
    columns = d.derive(
        spark, sf, "lineitem",
        [("table_name", "'t' || CAST(l_suppkey AS STRING)"), ("column_name", "'c_' || CAST(l_partkey AS STRING)"), ("is_nullable", "(l_partkey % 3 = 0)")],
    )
    return structure.choose_key(columns, structure.assemble_indexes(d.derive(spark, sf, "lineitem", d.INDEX_PARTS)))


# ---- reports ---------------------------------------------------------------------------
_TBL_A, _TBL_B = d.sql_of("customer", d.TABLES_A), d.sql_of("customer", d.TABLES_B)
_REPORT_CTE = f"""{_DIFF_CTE}, ta AS (SELECT DISTINCT table_name FROM a0), tb AS (SELECT DISTINCT table_name FROM b0), items AS (
 SELECT table_name, '' AS object_name, 'schema' AS category, 'error' AS severity, 'table missing in target' AS message FROM ta WHERE table_name NOT IN (SELECT table_name FROM tb)
 UNION ALL SELECT table_name, column_name, category, severity, message FROM cd
 UNION ALL SELECT table_name, index_name, 'index', 'warning', 'missing ' || CASE WHEN is_unique THEN 'unique ' ELSE '' END || 'index (' || replace(column_list, ',', ', ') || ')' FROM ({_IX_SQL}) WHERE table_name IN (SELECT table_name FROM tb)
 UNION ALL SELECT table_name, fk_name, 'fk', 'warning', 'missing ' || column_list || ' -> ' || ref_table || '(' || ref_list || ')' FROM ({_FK_SQL}) WHERE table_name IN (SELECT table_name FROM tb))"""


def _catalogs(spark, sf):
    a = structure.Catalog(d.cat_columns(spark, sf), indexes(spark, sf, d.INDEX_A), fks(spark, sf, d.FK_A))
    return a, structure.Catalog(d.cat_columns_b(spark, sf), _index_b(spark, sf), _fk_b(spark, sf))


@query("structure_report", f"WITH {_REPORT_CTE} SELECT * FROM items")
def structure_report(spark, sf):
    return structure.structure_report(*_catalogs(spark, sf))


_STATUS_CTE = f"""{_REPORT_CTE}, worst AS (SELECT ta.table_name, coalesce(max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 0 END), 0) AS r FROM ta LEFT JOIN items USING (table_name) GROUP BY ta.table_name),
 verdict AS (SELECT table_name, CASE r WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'ok' END AS status FROM worst)"""


def _statuses(spark, sf):
    a, b = _catalogs(spark, sf)
    items = structure.structure_report(a, b)
    return items.join(a.names(), "table_name", "left_semi"), a.names()


@query("compat_status", f"WITH {_STATUS_CTE} SELECT * FROM verdict")
def compat_status(spark, sf):
    return structure.worst_severity(*_statuses(spark, sf))


@query(
    "structure_summary",
    f"WITH {_STATUS_CTE} SELECT count(*) AS n_tables, count_if(status = 'ok')::BIGINT AS ok_count, count_if(status = 'warning')::BIGINT AS warning_count,"
    " count_if(status = 'error')::BIGINT AS error_count, true AS success, bool_and(status = 'ok') AS all_ok FROM verdict",
)
def structure_summary(spark, sf):
    return structure.structure_summary(*_statuses(spark, sf))


@query(
    "charset_diff",
    f"SELECT a.table_name, a.charset || ' -> ' || b.charset AS message FROM ({_TBL_A}) a JOIN ({_TBL_B}) b USING (table_name) WHERE a.charset <> '' AND b.charset <> '' AND lower(a.charset) <> lower(b.charset)",
)
def charset_diff(spark, sf):
    cols = d.rows(read_table(spark, sf, "customer"), d.TABLES_A).select("table_name").selectExpr(
        "table_name", "'id' AS column_name", "'INT' AS base_type", "'INT' AS data_type", "false AS is_nullable", "false AS is_auto", "CAST(NULL AS STRING) AS default_value"
    )
    a = structure.Catalog(cols, tables=d.derive(spark, sf, "customer", d.TABLES_A))
    b = structure.Catalog(cols, tables=d.derive(spark, sf, "customer", d.TABLES_B))
    return structure.structure_report(a, b).filter("category = 'charset'").select("table_name", "message")


_ADVICE = """CASE WHEN charset LIKE '%utf8%' THEN 'unicode source; nothing to do per table' WHEN charset LIKE '%gbk%' THEN 'check that the target database encodes rare characters and emoji'
 WHEN charset LIKE '%latin%' THEN 'if the bytes are really UTF-8, convert before the copy' END"""
_GUIDE_CTE = f"""t AS ({_TBL_A}), c AS ({d.CAT_A_SQL}), g AS (
 SELECT 'check' AS category, 'info' AS severity, table_name, '' AS object_name, check_count || ' CHECK constraints to verify' AS message FROM t WHERE check_count > 0
 UNION ALL SELECT 'charset', 'info', table_name, '', charset || ': ' || {_ADVICE} FROM t WHERE charset <> ''
 UNION ALL SELECT 'increment', 'info', table_name, column_name, 'explicit inserts do not move the sequence; reset it after the copy' FROM c WHERE is_auto AND is_pk
 UNION ALL SELECT 'dialect', 'info', '', '', m FROM (VALUES ('unquoted identifiers fold to lower case'), ('paging is LIMIT n OFFSET m; LIMIT a,b does not exist'), ('use INSERT ... RETURNING instead of LAST_INSERT_ID()')) AS v(m))"""


def _guide_input(spark, sf):
    return d.cat_columns(spark, sf), d.derive(spark, sf, "customer", d.TABLES_A)


@query("migration_guide", f"WITH {_GUIDE_CTE} SELECT * FROM g")
def migration_guide(spark, sf):
    return structure.migration_guide(*_guide_input(spark, sf), "postgres")


@query(
    "guide_summary",
    f"WITH {KINDS_CTE}, {A_CTE}, {_GUIDE_CTE} SELECT (SELECT count(DISTINCT table_name) FROM c) AS n_tables, (SELECT count(*) FROM ({_changes_sql('postgres', _PG_NOTES)})) AS n_type_changes,"
    " (SELECT count(*) FROM g) AS n_items, CAST(0 AS BIGINT) AS n_must_fix",
)
def guide_summary(spark, sf):
    return structure.guide_summary(*_guide_input(spark, sf), "postgres")


@query(
    "guide_sorted",
    f"WITH {_REPORT_CTE} SELECT *, CAST(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS INT) AS severity_rank FROM items ORDER BY severity_rank, category, table_name, object_name, message",
)
def guide_sorted(spark, sf):
    return structure.sort_by_severity(structure.structure_report(*_catalogs(spark, sf)))


# ---- names -------------------------------------------------------------------------------
@query("select_tables", f"SELECT table_name FROM ({_TBL_A}) WHERE NOT starts_with(table_name, '_bak_')")
def select_tables(spark, sf):
    return naming.select_tables(d.derive(spark, sf, "customer", d.TABLES_A)).select("table_name")


@query(
    "list_snapshots",
    f"SELECT table_name AS snapshot_name, CASE WHEN regexp_matches(table_name, '^_bak_(.+)_\\d{{8}}_\\d{{6}}$') THEN regexp_extract(table_name, '^_bak_(.+)_\\d{{8}}_\\d{{6}}$', 1)"
    f" ELSE substr(table_name, 6) END AS original_name, regexp_matches(table_name, '^_bak_(.+)_\\d{{8}}_\\d{{6}}$') AS can_restore FROM ({_TBL_A}) WHERE starts_with(table_name, '_bak_')",
)
def list_snapshots(spark, sf):
    return naming.list_snapshots(d.derive(spark, sf, "customer", d.TABLES_A).select("table_name"))


RULES = [("*", "broken"), (r"^buoy_", "sea"), (r"^berth", "port"), (r"^old_(.+)$", "attic.$1")]


@query(
    "resolve_target",
    f"""SELECT s.source_table, CASE WHEN o.target_schema IS NOT NULL THEN o.target_schema || '.' || s.source_table WHEN starts_with(s.source_table, 'buoy_') THEN 'sea.' || s.source_table
     WHEN starts_with(s.source_table, 'berth') THEN 'port.' || s.source_table WHEN starts_with(s.source_table, 'old_') THEN 'attic.' || substr(s.source_table, 5) ELSE 'main.' || s.source_table END AS target_table
    FROM ({d.sql_of('orders', d.SOURCE_NAMES)}) s LEFT JOIN (SELECT * FROM ({d.sql_of('orders', d.OVERRIDE_NAMES)}) WHERE target_schema <> '') o USING (source_table)""",
)
def resolve_target(spark, sf):
    names = d.derive(spark, sf, "orders", d.SOURCE_NAMES)
    return naming.resolve_target(names, RULES, d.derive(spark, sf, "orders", d.OVERRIDE_NAMES), "main")
