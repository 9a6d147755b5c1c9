"""Column kinds and the type names of each dialect, as plain dicts.

Fixed values: they must agree with the stores on both ends of a copy.
"""

# The type names that mean a kind.
KIND_NAMES = {
    "TINYINT": ["TINYINT", "INT1", "BYTE"],
    "SMALLINT": ["SMALLINT", "INT2", "SMALLSERIAL", "SHORT"],
    "INT": ["MEDIUMINT", "INT", "INTEGER", "INT4", "SERIAL", "COUNTER", "AUTOINCREMENT", "IDENTITY", "LONG"],
    "BIGINT": ["BIGINT", "INT8", "BIGSERIAL"],
    "YEAR": ["YEAR"],
    "DECIMAL": ["DECIMAL", "NUMERIC", "NUMBER", "MONEY", "SMALLMONEY", "CURRENCY"],
    "FLOAT": ["REAL", "FLOAT4", "FLOAT", "SINGLE"],
    "DOUBLE": ["DOUBLE", "DOUBLE PRECISION", "FLOAT8"],
    "BOOLEAN": ["BOOLEAN", "BOOL", "LOGICAL", "YESNO"],
    "BIT": ["BIT"],
    "CHAR": ["CHAR", "NCHAR", "CHARACTER", "BPCHAR"],
    "VARCHAR": ["VARCHAR", "NVARCHAR", "CHARACTER VARYING", "VARCHAR2", "SQL_VARIANT", "SYSNAME"],
    "TEXT": ["TINYTEXT", "TEXT", "MEDIUMTEXT", "LONGTEXT", "CLOB", "STRING", "NTEXT", "XML", "MEMO", "LONGCHAR"],
    "BLOB": ["TINYBLOB", "BLOB", "MEDIUMBLOB", "LONGBLOB", "BYTEA", "IMAGE", "OLEOBJECT", "LONGBINARY"],
    "BINARY": ["BINARY", "VARBINARY", "RAW", "ROWVERSION"],
    "DATE": ["DATE"],
    "TIME": ["TIME", "TIME WITHOUT TIME ZONE"],
    "DATETIME": ["DATETIME", "DATETIME2", "SMALLDATETIME"],
    "TIMESTAMP": ["TIMESTAMP", "TIMESTAMP WITHOUT TIME ZONE", "TIMESTAMPTZ", "TIMESTAMP WITH TIME ZONE", "DATETIMEOFFSET"],
    "JSON": ["JSON", "JSONB"],
    "UUID": ["UUID", "UNIQUEIDENTIFIER", "GUID"],
    "ENUM": ["ENUM"],
    "SET": ["SET"],
}

# The type of each kind, per dialect. {n} is the length, {p} and {s} are precision and
# scale, {u} is the UNSIGNED mark. Of two texts the second is for columns that lack the number.
DIALECT_TYPES = {
    "mysql": {
        "TINYINT": "TINYINT{u}",
        "SMALLINT": "SMALLINT{u}",
        "INT": "INT{u}",
        "BIGINT": "BIGINT{u}",
        "YEAR": "YEAR",
        "DECIMAL": ("DECIMAL({p}, {s})", "DECIMAL"),
        "FLOAT": "FLOAT{u}",
        "DOUBLE": "DOUBLE{u}",
        "BOOLEAN": "TINYINT(1)",
        "BIT": ("BIT({n})", "BIT(1)"),
        "CHAR": ("CHAR({n})", "CHAR(1)"),
        "VARCHAR": ("VARCHAR({n})", "VARCHAR(255)"),
        "TEXT": "TEXT",
        "BLOB": "BLOB",
        "BINARY": ("VARBINARY({n})", "VARBINARY(255)"),
        "DATE": "DATE",
        "TIME": "TIME",
        "DATETIME": "DATETIME",
        "TIMESTAMP": "TIMESTAMP",
        "JSON": "JSON",
        "UUID": "VARCHAR(36)",
        "ENUM": "VARCHAR(50)",
        "SET": "VARCHAR(200)",
    },
    "postgres": {
        "TINYINT": "SMALLINT",
        "SMALLINT": "SMALLINT",
        "YEAR": "SMALLINT",
        "INT": "INTEGER",
        "BIGINT": "BIGINT",
        "DECIMAL": ("NUMERIC({p}, {s})", "NUMERIC"),
        "FLOAT": "REAL",
        "DOUBLE": "DOUBLE PRECISION",
        "BOOLEAN": "BOOLEAN",
        "BIT": ("BIT({n})", "BIT(0)"),
        "CHAR": ("CHAR({n})", "CHAR(1)"),
        "VARCHAR": ("VARCHAR({n})", "VARCHAR(255)"),
        "TEXT": "TEXT",
        "BLOB": "BYTEA",
        "BINARY": "BYTEA",
        "DATE": "DATE",
        "TIME": "TIME",
        "DATETIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
        "JSON": "JSONB",
        "UUID": "UUID",
        "ENUM": "VARCHAR(50)",
        "SET": "VARCHAR(200)",
    },
    "sqlite": {
        "TINYINT": "INTEGER",
        "SMALLINT": "INTEGER",
        "INT": "INTEGER",
        "BIGINT": "INTEGER",
        "YEAR": "INTEGER",
        "BOOLEAN": "INTEGER",
        "BIT": "INTEGER",
        "DECIMAL": "REAL",
        "FLOAT": "REAL",
        "DOUBLE": "REAL",
        "CHAR": "TEXT",
        "VARCHAR": "TEXT",
        "TEXT": "TEXT",
        "ENUM": "TEXT",
        "SET": "TEXT",
        "DATE": "TEXT",
        "TIME": "TEXT",
        "DATETIME": "TEXT",
        "TIMESTAMP": "TEXT",
        "JSON": "TEXT",
        "UUID": "TEXT",
        "BLOB": "BLOB",
        "BINARY": "BLOB",
    },
    "mssql": {
        "TINYINT": "TINYINT",
        "SMALLINT": "SMALLINT",
        "YEAR": "SMALLINT",
        "INT": "INT",
        "BIGINT": "BIGINT",
        "DECIMAL": ("DECIMAL({p}, {s})", "DECIMAL(18,0)"),
        "FLOAT": "REAL",
        "DOUBLE": "FLOAT(53)",
        "BOOLEAN": "BIT",
        "BIT": "BIT",
        "CHAR": ("NCHAR({n})", "NCHAR(1)"),
        "VARCHAR": ("NVARCHAR({n})", "NVARCHAR(255)"),
        "TEXT": "NVARCHAR(MAX)",
        "JSON": "NVARCHAR(MAX)",
        "BLOB": ("VARBINARY({n})", "VARBINARY(MAX)"),
        "BINARY": ("VARBINARY({n})", "VARBINARY(MAX)"),
        "DATE": "DATE",
        "TIME": "TIME",
        "DATETIME": "DATETIME2",
        "TIMESTAMP": "DATETIME2",
        "UUID": "UNIQUEIDENTIFIER",
        "ENUM": "NVARCHAR(50)",
        "SET": "NVARCHAR(200)",
    },
    "oracle": {
        "TINYINT": "NUMBER(3)",
        "SMALLINT": "NUMBER(5)",
        "YEAR": "NUMBER(5)",
        "INT": "NUMBER(10)",
        "BIGINT": "NUMBER(19)",
        "DECIMAL": ("NUMBER({p}, {s})", "NUMBER"),
        "FLOAT": "BINARY_FLOAT",
        "DOUBLE": "BINARY_DOUBLE",
        "BOOLEAN": "NUMBER(1)",
        "BIT": "RAW(1)",
        "CHAR": ("CHAR({n})", "CHAR(1)"),
        "VARCHAR": ("VARCHAR2({n})", "VARCHAR2(255)"),
        "TEXT": "CLOB",
        "JSON": "CLOB",
        "BLOB": "BLOB",
        "BINARY": "BLOB",
        "DATE": "DATE",
        "TIME": "TIMESTAMP",
        "DATETIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
        "UUID": "VARCHAR2(36)",
        "ENUM": "VARCHAR2(200)",
        "SET": "VARCHAR2(200)",
    },
    "db2": {
        "TINYINT": "SMALLINT",
        "SMALLINT": "SMALLINT",
        "YEAR": "SMALLINT",
        "BOOLEAN": "SMALLINT",
        "INT": "INTEGER",
        "BIGINT": "BIGINT",
        "DECIMAL": ("DECIMAL({p}, {s})", "DECIMAL(31,0)"),
        "FLOAT": "REAL",
        "DOUBLE": "DOUBLE",
        "BIT": "CHAR(1) FOR BIT DATA",
        "CHAR": ("CHARACTER({n})", "CHARACTER(1)"),
        "VARCHAR": ("VARCHAR({n})", "VARCHAR(255)"),
        "TEXT": "CLOB(1M)",
        "JSON": "CLOB(1M)",
        "BLOB": "BLOB(1M)",
        "BINARY": "BLOB(1M)",
        "DATE": "DATE",
        "TIME": "TIME",
        "DATETIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
        "UUID": "VARCHAR(36)",
        "ENUM": "VARCHAR(200)",
        "SET": "VARCHAR(200)",
    },
    "mongodb": {
        "TINYINT": "int32",
        "SMALLINT": "int32",
        "INT": "int32",
        "YEAR": "int32",
        "BIGINT": "int64",
        "DECIMAL": "double",
        "FLOAT": "double",
        "DOUBLE": "double",
        "BOOLEAN": "bool",
        "BIT": "bool",
        "CHAR": "string",
        "VARCHAR": "string",
        "TEXT": "string",
        "ENUM": "string",
        "SET": "string",
        "UUID": "string",
        "BLOB": "binData",
        "BINARY": "binData",
        "DATE": "date",
        "TIME": "date",
        "DATETIME": "date",
        "TIMESTAMP": "date",
        "JSON": "object",
    },
    "redis": {
        "TINYINT": "string:int",
        "SMALLINT": "string:int",
        "INT": "string:int",
        "BIGINT": "string:int",
        "YEAR": "string:int",
        "DECIMAL": "string:float",
        "FLOAT": "string:float",
        "DOUBLE": "string:float",
        "BOOLEAN": "string:bool",
        "BIT": "string:bool",
        "DATE": "string:datetime",
        "TIME": "string:datetime",
        "DATETIME": "string:datetime",
        "TIMESTAMP": "string:datetime",
        "JSON": "hash",
        "BLOB": "string:bytes",
        "BINARY": "string:bytes",
    },
    "cassandra": {
        "TINYINT": "TINYINT",
        "SMALLINT": "SMALLINT",
        "YEAR": "SMALLINT",
        "INT": "INT",
        "BIGINT": "BIGINT",
        "DECIMAL": "DOUBLE",
        "DOUBLE": "DOUBLE",
        "FLOAT": "FLOAT",
        "BOOLEAN": "BOOLEAN",
        "BIT": "BOOLEAN",
        "CHAR": "TEXT",
        "VARCHAR": "TEXT",
        "TEXT": "TEXT",
        "JSON": "TEXT",
        "ENUM": "TEXT",
        "SET": "TEXT",
        "BLOB": "BLOB",
        "BINARY": "BLOB",
        "DATE": "DATE",
        "TIME": "TIME",
        "DATETIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
        "UUID": "UUID",
    },
    "influxdb": {
        "TINYINT": "INT",
        "SMALLINT": "INT",
        "INT": "INT",
        "YEAR": "INT",
        "BIGINT": "INT",
        "DECIMAL": "FLOAT",
        "FLOAT": "FLOAT",
        "DOUBLE": "FLOAT",
        "BOOLEAN": "BOOLEAN",
        "BIT": "BOOLEAN",
        "DATE": "TIMESTAMP",
        "TIME": "TIMESTAMP",
        "DATETIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
    },
    "access": {
        "TINYINT": "SHORT",
        "SMALLINT": "SHORT",
        "YEAR": "SHORT",
        "INT": "LONG",
        "BIGINT": "DOUBLE",
        "DOUBLE": "DOUBLE",
        "DECIMAL": "CURRENCY",
        "FLOAT": "SINGLE",
        "BOOLEAN": "YESNO",
        "BIT": "YESNO",
        "CHAR": ("VARCHAR({n})", "VARCHAR(50)"),
        "VARCHAR": ("VARCHAR({n})", "VARCHAR(255)"),
        "TEXT": "LONGTEXT",
        "JSON": "LONGTEXT",
        "BLOB": "OLEOBJECT",
        "BINARY": "OLEOBJECT",
        "DATE": "DATETIME",
        "TIME": "DATETIME",
        "DATETIME": "DATETIME",
        "TIMESTAMP": "DATETIME",
        "UUID": "VARCHAR(38)",
    },
    "tdengine": {
        "TINYINT": "TINYINT",
        "SMALLINT": "SMALLINT",
        "YEAR": "SMALLINT",
        "INT": "INT",
        "BIGINT": "BIGINT",
        "DECIMAL": "DOUBLE",
        "DOUBLE": "DOUBLE",
        "FLOAT": "FLOAT",
        "BOOLEAN": "BOOL",
        "BIT": "BOOL",
        "CHAR": ("VARCHAR({n})", "VARCHAR(255)"),
        "VARCHAR": ("VARCHAR({n})", "VARCHAR(255)"),
        "TEXT": "NCHAR(255)",
        "JSON": "NCHAR(255)",
        "BLOB": "NCHAR(255)",
        "BINARY": "NCHAR(255)",
        "DATE": "DATE",
        "TIME": "TIMESTAMP",
        "DATETIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
        "UUID": "VARCHAR(36)",
        "ENUM": "VARCHAR(200)",
        "SET": "VARCHAR(200)",
    },
}

# Types that hold only for columns that are an identity (auto), have a clock as default (now)
# or any default (default), a length of one or none (one), above one (wide) or above 4000 (long).
NARROWED_TYPES = {
    "mysql": {
        "now": {"TEXT": "DATETIME"},
        "default": {"TEXT": ("VARCHAR({n})", "VARCHAR(255)"), "JSON": ("VARCHAR({n})", "VARCHAR(255)"), "BLOB": ("VARBINARY({n})", "VARBINARY(255)")},
    },
    "postgres": {
        "auto": {"INT": "SERIAL", "BIGINT": "BIGSERIAL"},
        "one": {"BIT": "BOOLEAN"},
    },
    "mssql": {
        "wide": {"BIT": ("BINARY({n})", "BINARY(1)")},
        "long": {"CHAR": "NCHAR(MAX)", "VARCHAR": "NVARCHAR(MAX)"},
    },
    "access": {
        "auto": {"INT": "AUTOINCREMENT"},
    },
}

# The type of an unknown kind, and the dialects that keep the source's own text where there is one.
OTHER_TYPE = {
    "mysql": "TEXT",
    "postgres": "TEXT",
    "sqlite": "TEXT",
    "mssql": "NVARCHAR(MAX)",
    "oracle": "CLOB",
    "db2": "CLOB(1M)",
    "mongodb": "string",
    "redis": "string",
    "cassandra": "TEXT",
    "influxdb": "STRING",
    "access": "VARCHAR(255)",
    "tdengine": "NCHAR(255)",
}
KEEP_UNKNOWN = ("mysql", "postgres", "sqlite", "mssql", "oracle", "db2", "cassandra", "tdengine")

# Stores that speak another dialect's types.
SAME_TYPES_AS = {
    "mariadb": "mysql", "tidb": "mysql", "oceanbase": "mysql", "polardb": "mysql", "aurora": "mysql", "dameng": "mysql",
    "opengauss": "postgres", "kingbase": "postgres", "cockroachdb": "postgres", "timescaledb": "postgres",
    "scylladb": "cassandra",
}

MYSQL_FAMILY = ("mysql", "mariadb", "tidb", "oceanbase", "polardb", "aurora")
POSTGRES_FAMILY = ("postgres", "opengauss", "kingbase", "cockroachdb", "timescaledb")

# Defaults that mark a text column as a time column, and those rendered as a keyword.
TEMPORAL_DEFAULTS = (
    "current_timestamp", "current_date", "current_time", "localtime", "localtimestamp",
    "now", "sysdate", "curdate", "curtime",
)
DEFAULT_KEYWORDS = {
    "CURRENT_TIMESTAMP": ["current_timestamp", "now", "sysdate", "getdate", "getutcdate", "sysutcdatetime", "sysdatetime"],
    "CURRENT_DATE": ["current_date", "curdate"],
    "CURRENT_TIME": ["current_time", "curtime"],
    "LOCALTIME": ["localtime"],
    "LOCALTIMESTAMP": ["localtimestamp"],
    "NULL": ["null"],
    "TRUE": ["true"],
    "FALSE": ["false"],
}
DEFAULT_KEPT = ("uuid", "gen_random_uuid", "rand", "random")

# What a change of type means for the reader of the report.
CHANGE_NOTES = {
    "BOOLEAN": "stored the way of the target; tests for truth may need a change",
    "ENUM": "becomes VARCHAR; the database no longer limits the values",
    "SET": "becomes VARCHAR; the database no longer limits the values",
    "JSON": "stored and queried in the way of the target",
    "DATETIME": "precision and range differ; extreme values may be refused",
    "TIMESTAMP": "precision and range differ; extreme values may be refused",
    "YEAR": "becomes a whole number",
    "UUID": "native or text form; comparison and indexes may differ",
    "BIT": "bit semantics differ between stores; check code that reads single bits",
}
JSON_NOTE_POSTGRES = "becomes JSONB; query with its operators"
TIME_NOTE_POSTGRES = "becomes TIMESTAMP without zone conversion; zero dates are refused"
UNSIGNED_LOST = "UNSIGNED does not exist in the target; large values overflow"
UNSIGNED_KEPT = "UNSIGNED is kept"

# General advice per dialect family: severity info.
DIALECT_HINTS = {
    "postgres": [
        "unquoted identifiers fold to lower case",
        "paging is LIMIT n OFFSET m; LIMIT a,b does not exist",
        "use INSERT ... RETURNING instead of LAST_INSERT_ID()",
    ],
    "mysql": [
        "GROUP BY no longer sorts; add ORDER BY",
        "ONLY_FULL_GROUP_BY is on; select only grouped or aggregated columns",
    ],
    "mssql": [
        "paging is TOP n or OFFSET ... FETCH; LIMIT does not exist",
        "only N-types store Unicode",
    ],
    "dameng": [
        "unquoted identifiers are stored in upper case",
        "LIMIT depends on the compatibility mode",
    ],
    "sqlite": [
        "type affinity: dates and JSON are stored as text",
    ],
}
