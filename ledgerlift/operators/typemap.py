"""From a source type name to a neutral kind, to the target's type, and to the cast of the values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions.timetext import format_timestamp
from ledgerlift.functions.values import constant_map, let
from ledgerlift.operators import fixed_types as fx


UNKNOWN = ""


def _pick(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(constant_map(entries), key)


def neutral_kind(base_type: Column) -> Column:
    """Neutral kind of a type name: as written, without its parameters, without UNSIGNED or ZEROFILL. Empty if unknown."""
    kinds = {n: kind for kind, names in fx.KIND_NAMES.items() for n in names}
    name = F.upper(F.trim(base_type))
    bare = F.regexp_replace(name, r"(?s)(?<=.)\s*\(.*", "")
    signed = F.regexp_replace(bare, r"\s*(?: UNSIGNED| ZEROFILL)\z", "")
    return F.coalesce(_pick(kinds, name), _pick(kinds, bare), _pick(kinds, signed), F.lit(UNKNOWN))


def _variants() -> dict[str, Column]:
    """When each narrowing word of a type line applies to a column."""
    n, plain = F.col("char_len"), F.trim(F.col("default_value"))
    has_default = (plain != "") & (F.upper(plain) != "NULL")
    word = F.lower(F.regexp_replace(plain, r"\(\)\z", ""))
    return {
        "auto": F.col("is_auto"),
        "now": has_default & word.isin(*fx.TEMPORAL_DEFAULTS),
        "default": has_default,
        "long": n > 4000,
        "one": n.isNull() | (n == 1),
        "wide": n > 1,
    }


def _spec(template: str | tuple[str, str]) -> dict[str, str]:
    """Parts of a type text: what stands before and after its parameter, the parameter, and the form without one."""
    full, short = (template, "") if isinstance(template, str) else template
    head, mark, tail = re.match(r"([^{]*)(?:\{(n|p|u)\}(?:, \{s\})?)?(.*)", full).groups()
    return {"head": head, "mark": mark or "", "tail": tail, "short": short}


def _spec_map(entries: dict[str, str | tuple[str, str]]) -> Column:
    return constant_map({k: _spec(t) for k, t in entries.items()})


def _fill(spec: Column) -> Column:
    """Type text with the row's length (n), precision and scale (p) or UNSIGNED mark (u) put in."""
    digits, scale, n = F.col("num_precision"), F.col("num_scale"), F.col("char_len")
    head, tail, short = spec["head"], spec["tail"], spec["short"]
    sized = F.when(n > 0, F.concat(head, n.cast("string"), tail)).otherwise(short)
    pair = F.concat(head, digits.cast("string"), F.lit(", "), scale.cast("string"), tail)
    return (
        F.when(spec["mark"] == "", head)
        .when(spec["mark"] == "n", sized)
        .when(spec["mark"] == "p", F.coalesce(pair, short))
        .when(F.col("is_unsigned"), F.concat(head, F.lit(" UNSIGNED")))
        .when(spec.isNotNull(), head)
    )


def target_type(dialect: str, kind: Column) -> Column:
    """Type text in ``dialect``.

    Reads the catalog columns ``data_type, char_len, num_precision, num_scale,
    is_unsigned, is_auto, default_value`` of the row.
    """
    speaks = fx.SAME_TYPES_AS.get(dialect, dialect)
    plain = dict(fx.DIALECT_TYPES[speaks])
    if dialect == "cockroachdb":
        plain |= {"BLOB": "BYTES", "BINARY": "BYTES"}
    tries: list[Column] = []
    for word, applies in _variants().items():
        narrowed = fx.NARROWED_TYPES.get(speaks, {}).get(word)
        if narrowed:
            tries.append(F.when(applies, F.try_element_at(_spec_map(narrowed), kind)))
    source, spare = F.col("data_type"), fx.OTHER_TYPE[speaks]
    fallback = F.when(source != "", source).otherwise(spare) if speaks in fx.KEEP_UNKNOWN else F.lit(spare)
    spec = F.coalesce(*tries, F.try_element_at(_spec_map(plain), kind))
    return F.coalesce(let(spec, _fill), fallback)


def folded_type(c: Column) -> Column:
    """Type names are compared without blanks and in lower case."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def change_note(dialect: str, kind: Column) -> Column:
    notes = dict(fx.CHANGE_NOTES)
    if dialect in fx.POSTGRES_FAMILY and dialect != "timescaledb":
        notes |= {"JSON": fx.JSON_NOTE_POSTGRES, "DATETIME": fx.TIME_NOTE_POSTGRES, "TIMESTAMP": fx.TIME_NOTE_POSTGRES}
    unsigned = fx.UNSIGNED_KEPT if dialect in ("mysql", "mariadb", "tidb", "oceanbase") else fx.UNSIGNED_LOST
    return F.coalesce(_pick(notes, kind), F.when(F.col("is_unsigned"), unsigned), F.lit(""))


def with_target_types(cat: DataFrame, dialect: str) -> DataFrame:
    """Catalog rows with ``kind`` and ``target_type``."""
    kinds = cat.withColumn("kind", neutral_kind(F.col("base_type")))
    return kinds.withColumn("target_type", target_type(dialect, F.col("kind")))


def type_changes(cat: DataFrame, dialect: str) -> DataFrame:
    """Columns whose type text differs in the target, with a note."""
    typed = with_target_types(cat, dialect)
    differs = folded_type(F.col("target_type")) != folded_type(F.col("data_type"))
    return typed.filter(differs).select(
        "table_name", "column_name", F.col("data_type").alias("source_type"), "target_type",
        change_note(dialect, F.col("kind")).alias("note"),
    )


def default_literal(c: Column) -> Column:
    """A catalog default as it may stand in a column definition."""
    v = F.trim(c)
    word = F.lower(F.trim(F.regexp_replace(v, r"\(\)\z", "")))
    chain = F.when(v == "", "").when(v.rlike(r"^-?\d+(\.\d+)?\z"), v)
    for keyword, names in fx.DEFAULT_KEYWORDS.items():
        chain = chain.when(word.isin(*names), keyword)
    quoted = F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))
    return chain.when(word.isin(*fx.DEFAULT_KEPT), v).when(v.startswith("'"), v).otherwise(quoted)


def strip_default_cast(c: Column) -> Column:
    """Drop a trailing ``::type`` of a default when what is left is a literal, a number, NULL or a call."""
    v = F.trim(c)
    left = F.trim(F.regexp_extract(v, r"(?s)^(.*)::[A-Za-z_][\w .\[\](),\"]*\z", 1))
    call = left.rlike(r"(?s)^[^(]*\(.*\)\z") & (F.regexp_count(left, F.lit(r"\(")) == F.regexp_count(left, F.lit(r"\)")))
    plain = left.rlike(r"(?s)^'.*'\z") | left.rlike(r"^-?\d+(\.\d+)?\z") | (F.upper(left) == "NULL") | call
    return F.when(v.contains("::") & plain, left).otherwise(v)


SPARK_KINDS: list[tuple[type, str]] = [
    (T.ByteType, "TINYINT"), (T.ShortType, "SMALLINT"), (T.IntegerType, "INT"), (T.LongType, "BIGINT"),
    (T.DecimalType, "DECIMAL"), (T.FloatType, "FLOAT"), (T.DoubleType, "DOUBLE"), (T.BooleanType, "BOOLEAN"),
    (T.BinaryType, "BLOB"), (T.DateType, "DATE"), (T.TimestampType, "TIMESTAMP"), (T.TimestampNTZType, "TIMESTAMP"),
    (T.ArrayType, "JSON"), (T.MapType, "JSON"), (T.StructType, "JSON"), (T.VariantType, "JSON"), (T.StringType, "TEXT"),
]


def spark_kind(t: T.DataType) -> str:
    return next((kind for cls, kind in SPARK_KINDS if isinstance(t, cls)), UNKNOWN)


# How values of a kind are stored where the store's own types cannot hold them.
STORED_AS = {
    "sqlite": {"BOOLEAN": "int", "DECIMAL": "double", "FLOAT": "double", "DATE": "text", "TIMESTAMP": "text", "JSON": "text"},
    "mongodb": {"TINYINT": "int", "SMALLINT": "int", "DECIMAL": "double", "FLOAT": "double", "DATE": "timestamp_ntz"},
    "access": {"BIGINT": "double", "DECIMAL": "decimal(19,4)", "TINYINT": "smallint", "DATE": "timestamp_ntz", "JSON": "text"},
    "cassandra": {"DECIMAL": "double", "JSON": "text"},
    "influxdb": {"DECIMAL": "double", "TINYINT": "bigint", "SMALLINT": "bigint", "INT": "bigint", "JSON": "text", "BLOB": "text"},
    "tdengine": {"DECIMAL": "double", "JSON": "text"},
    "redis": dict.fromkeys([k for _, k in SPARK_KINDS], "text"),
}


def cast_to_target(df: DataFrame, dialect: str) -> DataFrame:
    """The values as the target will hold them; columns it can hold as they are stay untouched."""
    rules = STORED_AS.get(fx.SAME_TYPES_AS.get(dialect, dialect), {})

    def one(f: T.StructField) -> Column:
        c, kind = F.col(f.name), spark_kind(f.dataType)
        how = rules.get(kind)
        if how is None:
            return c
        if how != "text":
            return c.cast(how).alias(f.name)
        if kind == "TIMESTAMP":
            return format_timestamp(c).alias(f.name)
        if kind == "JSON":
            return F.to_json(c).alias(f.name)
        if kind == "BLOB":
            return F.concat(F.lit("hex:"), F.lower(F.hex(c))).alias(f.name)
        return c.cast("string").alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])
