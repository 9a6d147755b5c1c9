"""Document collections (JSON text) to typed tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions.values import decode_binary, is_json, let, parse_whole
from ledgerlift.session import spread

ID = "_id"
SPARK_OF = {
    "BOOLEAN": T.BooleanType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(),
    "JSON": T.VariantType(), "TEXT": T.VariantType(), "OBJECTID": T.StringType(),
}


def _is_object(c: Column) -> Column:
    return is_json(c) & F.coalesce(F.ltrim(c, F.lit(" \t\r\n")).startswith("{"), F.lit(False))


def _whole(c: Column, kind: str) -> Column:
    """A document in one parse. Only texts that this finds odd are looked at again, by the rule that rejects go by."""
    return F.coalesce(parse_whole(c, kind), F.when(_is_object(c), F.from_json(c, kind)))


def document_rejects(df: DataFrame, json_col: str) -> DataFrame:
    """Rows that hold no document, with the reason: missing, broken (not JSON, or text behind it) or not an object."""
    c = F.col(json_col)
    reason = F.when(c.isNull(), "missing").when(~is_json(c), "broken").otherwise("not an object")
    return df.filter(~_is_object(c)).withColumn("reason", reason)


def infer_document_schema(df: DataFrame, json_col: str, sample: int | None = None) -> DataFrame:
    """One row per field: name, type, nullable. All documents are read unless ``sample`` is given.

    Fields are listed per document and reduced by name to the few kinds of value
    each was seen with, combined before the shuffle; rows that are no document are
    left to ``document_rejects``. The widest type wins: whole numbers give way to
    fractions, any other mix to text; objects are JSON, arrays TEXT.
    """
    docs = df.select(json_col) if sample is None else df.select(json_col).limit(sample)
    listed = spread(docs).select(F.explode(_whole(F.col(json_col), "map<string,variant>")).alias("field", "value"))
    kind = F.substring_index(F.substring_index(F.schema_of_variant("value"), "<", 1), "(", 1)
    seen = listed.select("field", kind.alias("kind")).groupBy("field").agg(F.collect_set("kind").alias("kinds"))
    kinds = F.array_remove(F.coalesce("kinds", F.array()), "VOID")

    def only(*names: str) -> Column:
        return (F.size(kinds) > 0) & (F.size(F.array_except(kinds, F.array(*map(F.lit, names)))) == 0)

    data_type = (
        F.when(F.col("field") == ID, "OBJECTID").when(F.size(kinds) == 0, "TEXT").when(only("BIGINT"), "BIGINT")
        .when(only("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "DOUBLE").when(only("BOOLEAN"), "BOOLEAN")
        .when(only("OBJECT"), "JSON").when(only("ARRAY"), "TEXT").otherwise("VARCHAR")
    )
    is_id = F.col("field") == ID
    return seen.select("field", data_type.alias("data_type"), (~is_id).alias("is_nullable"), is_id.alias("is_pk")).orderBy(~is_id, "field")


def field_types(schema_rows: DataFrame) -> dict[str, str]:
    """The inferred fields on the driver: one small row per field, as for any table schema."""
    return {r["field"]: r["data_type"] for r in schema_rows.select("field", "data_type").collect()}


def read_documents(df: DataFrame, json_col: str, fields: dict[str, str]) -> DataFrame:
    """Typed columns from documents; nested values stay JSON text, mixed values become text.

    Rows that hold no document give no row here; ``document_rejects`` has them.
    """
    schema = T.StructType(
        [T.StructField(f, T.VariantType() if t in ("JSON", "TEXT", "VARCHAR") else SPARK_OF[t]) for f, t in fields.items()]
    )
    kept = [c for c in df.columns if c != json_col]

    def shown(f: str, t: str) -> Column:
        c = F.col("_doc")[f]
        if t in ("JSON", "TEXT", "VARCHAR"):
            c = F.when(~F.is_variant_null(c), c)
        if t in ("JSON", "TEXT"):
            return F.to_json(c).alias(f)
        if t == "VARCHAR":
            return F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c)).alias(f)
        return c.alias(f)

    # A generator that gives one row or none: the parse is neither pushed into a filter nor repeated per field.
    found = F.explode(let(_whole(F.col(json_col), schema.simpleString()), lambda v: F.when(v.isNotNull(), F.array(v))))
    parsed = spread(df).select(*kept, found.alias("_doc"))
    return parsed.select(*kept, *[shown(f, t) for f, t in fields.items()])


def write_documents(df: DataFrame, nested: list[str] | None = None, binary: list[str] | None = None) -> DataFrame:
    """One JSON document per row; every column is in it, NULL ones as null.

    ``nested`` names text columns that hold JSON; text that is not JSON is kept as
    text. ``binary`` columns holding prefixed hex text become bytes (base64 in
    JSON); other text, wrong hex included, is kept. A 24-hex ``_id`` becomes an
    object id in extended JSON form.
    """
    nested, binary = nested or [], binary or []

    def one(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name == ID and isinstance(f.dataType, T.StringType):
            is_oid = c.rlike(r"^[0-9a-fA-F]{24}\z")
            return F.when(is_oid, F.to_variant_object(F.struct(c.alias("$oid")))).otherwise(c.cast("variant"))
        if f.name in nested:
            return F.coalesce(F.when(is_json(c), F.try_parse_json(c)), c.cast("variant"))
        if f.name in binary:
            return F.coalesce(F.base64(decode_binary(c)), c)
        return c

    fields = F.struct(*[one(f).alias(f.name) for f in df.schema.fields])
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("doc"))
