"""Types, catalogs and names."""

import pytest
from pyspark.sql import functions as F

from ledgerlift.operators import fixed_types as fx
from ledgerlift.operators import naming, structure, typemap

CAT = (
    "table_name string, column_name string, base_type string, data_type string, char_len int, num_precision int, num_scale int,"
    " is_unsigned boolean, is_nullable boolean, is_auto boolean, is_pk boolean, default_value string"
)


def cat(spark, *rows):
    base = {"table_name": "t", "data_type": "", "char_len": None, "num_precision": None, "num_scale": None, "is_unsigned": False, "is_nullable": True, "is_auto": False, "is_pk": False, "default_value": None}
    full = [{**base, **r} for r in rows]
    return spark.createDataFrame([[r.get(c.split()[0]) for c in CAT.split(", ")] for r in full], CAT)


def target(spark, dialect, base_type, **facts):
    row = cat(spark, {"column_name": "c", "base_type": base_type, "data_type": base_type, **facts})
    return typemap.with_target_types(row, dialect).first()["target_type"]


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("int unsigned", "INT"), ("BIGINT ZEROFILL", "BIGINT"), ("TIMESTAMP(6)", "TIMESTAMP"), ("varchar2 (100)", "VARCHAR"),
        ("double precision", "DOUBLE"), ("time without time zone", "TIME"), (" money ", "DECIMAL"), ("geometry", ""), ("INT UNSIGNED ZEROFILL", ""),
        ("(x)", ""), ("DECIMAL(10,2) UNSIGNED", "DECIMAL"),
    ],
)
def test_kinds(spark, name, kind):
    assert spark.createDataFrame([(name,)], "b string").select(typemap.neutral_kind(F.col("b"))).first()[0] == kind


def test_alias_list_is_complete():
    assert len(fx.KIND_NAMES) == 23 and sum(len(n) for n in fx.KIND_NAMES.values()) == 88
    assert len(fx.DIALECT_TYPES) == 12 and set(fx.NARROWED_TYPES) < set(fx.OTHER_TYPE) == set(fx.DIALECT_TYPES)


@pytest.mark.parametrize(
    ("dialect", "base", "facts", "want"),
    [
        ("mysql", "TEXT", {"default_value": "now()"}, "DATETIME"),
        ("mysql", "TEXT", {"default_value": "x", "char_len": 40}, "VARCHAR(40)"),
        ("mysql", "TEXT", {"default_value": "null"}, "TEXT"),
        ("mysql", "BYTEA", {"default_value": "x"}, "VARBINARY(255)"),
        ("mysql", "JSONB", {"default_value": "{}"}, "VARCHAR(255)"),
        ("mysql", "INT", {"is_unsigned": True}, "INT UNSIGNED"),
        ("mysql", "NUMERIC", {"num_precision": 10, "num_scale": 2}, "DECIMAL(10, 2)"),
        ("mysql", "NUMERIC", {"num_precision": 10}, "DECIMAL"),
        ("postgres", "SERIAL", {"is_auto": True}, "SERIAL"),
        ("postgres", "BIT", {}, "BOOLEAN"),
        ("postgres", "BIT", {"char_len": 8}, "BIT(8)"),
        ("cockroachdb", "BLOB", {}, "BYTES"),
        ("opengauss", "BLOB", {}, "BYTEA"),
        ("mssql", "VARCHAR", {"char_len": 5000}, "NVARCHAR(MAX)"),
        ("mssql", "VARCHAR", {"char_len": 50}, "NVARCHAR(50)"),
        ("mssql", "CHAR", {}, "NCHAR(1)"),
        ("mssql", "BLOB", {}, "VARBINARY(MAX)"),
        ("mssql", "BIT", {"char_len": 4}, "BINARY(4)"),
        ("mssql", "DECIMAL", {}, "DECIMAL(18,0)"),
        ("oracle", "BIT", {"char_len": 4}, "RAW(1)"),
        ("db2", "JSON", {}, "CLOB(1M)"),
        ("access", "INT", {"is_auto": True}, "AUTOINCREMENT"),
        ("access", "CHAR", {}, "VARCHAR(50)"),
        ("access", "geometry", {}, "VARCHAR(255)"),
        ("sqlite", "geometry", {}, "geometry"),
        ("redis", "JSON", {}, "hash"),
        ("influxdb", "BLOB", {}, "STRING"),
        ("tdengine", "BOOL", {}, "BOOL"),
        ("scylladb", "NUMERIC", {}, "DOUBLE"),
    ],
)
def test_target_types(spark, dialect, base, facts, want):
    assert target(spark, dialect, base, **facts) == want


def test_number_narrowing(spark):
    df = spark.createDataFrame([(3, 0), (10, 0), (19, 0), (10, 2), (None, 0), (5, None)], "p int, s int")
    assert [r[0] for r in df.select(structure.narrow_number(F.col("p"), F.col("s"))).collect()] == ["SMALLINT", "INT", "BIGINT", "DECIMAL", "DECIMAL", "DECIMAL"]


def test_dropped_column_and_table_are_reported(spark):
    a = cat(spark, {"column_name": "Id", "base_type": "INT"}, {"column_name": "name", "base_type": "TEXT"}, {"table_name": "u", "column_name": "x", "base_type": "INT"})
    b = cat(spark, {"column_name": "id", "base_type": "INTEGER"}, {"column_name": "more", "base_type": "INT"})
    items = structure.structure_report(structure.Catalog(a), structure.Catalog(b))
    assert sorted((r["table_name"], r["object_name"], r["category"], r["severity"]) for r in items.collect()) == [
        ("t", "more", "column", "info"), ("t", "name", "column", "error"), ("u", "", "schema", "error"),
    ]
    summary = structure.structure_summary(items, structure.Catalog(a).names()).first()
    assert (summary["error_count"], summary["success"], summary["all_ok"]) == (2, True, False)


def test_defaults_ignore_case_and_brackets(spark):
    def diff(x, y):
        a, b = (cat(spark, {"column_name": "c", "base_type": "INT", "default_value": v}) for v in (x, y))
        return [r["severity"] for r in structure.default_diff(a, b).collect()]

    assert diff("(0)", "0") == [] and diff("'A'", "a") == [] and diff("1", "2") == ["info"]
    assert diff("1", None) == ["warning"] and diff("NULL", None) == [] and diff(None, "1") == []


def test_composite_keys_stay_whole(spark):
    columns = cat(spark, {"column_name": "a", "base_type": "INT", "is_nullable": False}, {"table_name": "u", "column_name": "n", "base_type": "INT"})
    schema = "table_name string, index_name string, is_unique boolean, is_primary boolean, columns array<string>"
    ix = spark.createDataFrame([("t", "pk", True, True, ["a", "b"]), ("t", "u1", True, False, ["a"]), ("u", "n1", True, False, ["n"])], schema)
    assert {r["table_name"]: (r["key_source"], r["key_columns"]) for r in structure.choose_key(columns, ix).collect()} == {"t": ("primary", "a,b"), "u": ("none", "")}


def resolve(spark, name, rules=None, overrides=None, default="", dialect="postgres"):
    names = spark.createDataFrame([(name,)], "source_table string")
    chosen = spark.createDataFrame(list(overrides.items()), "source_table string, target_schema string") if overrides else None
    return naming.resolve_target(names, rules, chosen, default, dialect).first()["target_table"]


def test_target_names(spark):
    two = [(r"^buoy", "sea"), (r"_log$", "cold")]
    assert [resolve(spark, n) for n in ("berth", "north.berth")] == ["berth", "north.berth"]
    assert resolve(spark, "berth", default="port") == "port.berth"
    assert resolve(spark, "berth", overrides={"berth": "pier"}, default="port") == "pier.berth"
    assert [resolve(spark, n, two) for n in ("buoy_log", "ship_log", "berth")] == ["sea.buoy_log", "cold.ship_log", "berth"]
    assert resolve(spark, "old_berth", [(r"^old_(.+)$", "attic.$1")]) == "attic.berth"
    assert resolve(spark, "buoy_9", two, {"buoy_9": "dock"}) == "dock.buoy_9"
    assert resolve(spark, "quay", [("*", "x"), (r"^qu", "west")]) == "west.quay"
    assert resolve(spark, "berth", default="port", dialect="sqlite") == "berth"
    assert resolve(spark, "berth", overrides={"berth": ""}, default="port") == "port.berth"
