"""Value-level rules: padding, keys, previews, binary text and the one definition of equality."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions.timetext import normalize_compare_time

TOLERANCE = 1e-9
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

PREVIEW_LIMIT = 50  # fixed values: longest preview, and what is kept of a longer one
PREVIEW_KEEP = 47
BINARY_PREFIX = "hex:"


def sql_text(v) -> str:
    """A Python constant (text, list or dict) as a Spark SQL literal, built in one call instead of one per entry."""
    if isinstance(v, dict):
        return "named_struct(" + ", ".join(f"{sql_text(k)}, {sql_text(x)}" for k, x in v.items()) + ")"
    if isinstance(v, list | tuple):
        return "array(" + ", ".join(sql_text(x) for x in v) + ")"
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_map(entries: dict) -> Column:
    """A constant map; one lookup stays one small expression however many entries it has."""
    return F.expr("map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in entries.items()) + ")")


def literal(v, t: T.DataType) -> Column:
    """A constant to compare with a column of type ``t``; wall times stay wall times in every session zone."""
    if isinstance(t, T.TimestampNTZType) and isinstance(v, datetime):
        return F.lit(v.isoformat(sep=" ")).cast(t)
    return F.lit(v)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def is_number(t: T.DataType) -> bool:
    return isinstance(t, INTEGRAL + FLOATING + (T.DecimalType,))


def trim_padding(c: Column) -> Column:
    """Trailing blanks only; tabs and line ends stay."""
    return F.rtrim(c)


def encode_binary(c: Column) -> Column:
    return F.concat(F.lit(BINARY_PREFIX), F.lower(F.hex(c)))


def decode_binary(c: Column) -> Column:
    """Bytes of a prefixed hex text; NULL when the text is not one."""
    body = F.substring(c, F.lit(len(BINARY_PREFIX) + 1), F.char_length(c))
    ok = c.startswith(BINARY_PREFIX) & (F.char_length(c) % 2 == 0) & body.rlike(r"^[0-9A-Fa-f]*+\z")
    return F.when(ok, F.unhex(body))


def is_json(c: Column) -> Column:
    """Whether the whole text is one JSON value: inside brackets it is the only element, inside braces the only field."""
    in_list = F.json_array_length(F.concat(F.lit("["), c, F.lit("\n]"))) == 1
    in_object = F.json_object_keys(F.concat(F.lit('{"v":'), c, F.lit("\n}"))) == F.array(F.lit("v"))
    return F.coalesce(in_list & in_object, F.lit(False))


def parse_whole(c: Column, kind: str) -> Column:
    """The text as one JSON value of type ``kind``, in one parse; NULL if it is not one, or if text goes on behind it.

    The value is parsed as a field whose neighbour repeats the text's own hash, so a
    text that closes the field itself does not have the neighbour where it belongs.
    """
    mark = F.xxhash64(c)
    framed = F.concat(F.lit('{"v":'), c, F.lit('\n,"s":'), mark.cast("string"), F.lit("}"))
    return let(F.from_json(framed, f"struct<v:{kind},s:bigint>"), lambda x: F.when(x["s"] == mark, x["v"]))


def preview_value(c: Column, t: T.DataType | None = None) -> Column:
    """Short text for a report: NULL, a byte count, or the value cut to 50 characters."""
    if isinstance(t, T.BinaryType):
        shown = F.concat(F.lit("<binary "), F.octet_length(c).cast("string"), F.lit(" bytes>"))
    elif isinstance(t, T.ArrayType):
        shown = F.concat(F.lit("<binary "), F.size(c).cast("string"), F.lit(" bytes>"))
    else:
        text = F.to_json(c) if isinstance(t, NESTED) else c.cast("string")
        shown = F.when(
            F.char_length(text) > PREVIEW_LIMIT, F.concat(F.left(text, F.lit(PREVIEW_KEEP)), F.lit("..."))
        ).otherwise(text)
    return F.when(c.isNull(), "NULL").otherwise(shown)


def text_form(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        return F.rtrim(c)
    if isinstance(t, NESTED):
        return F.to_json(c)
    return F.rtrim(c.cast("string"))


def normalize_key(c: Column, t: T.DataType, other: T.DataType | None = None) -> Column:
    """Key form under which two stores' rows meet.

    Whole numbers stay exact (a float would merge keys above 2^53), other
    numbers meet as double, everything else as text without trailing blanks.
    """
    other = other or t
    if is_number(t) and is_number(other):
        if isinstance(t, INTEGRAL) and isinstance(other, INTEGRAL):
            return c.cast("bigint")
        if isinstance(t, FLOATING) or isinstance(other, FLOATING):
            return c.cast("double")
        return c.cast("decimal(38,10)")
    if isinstance(t, TEMPORAL) and isinstance(other, TEMPORAL):
        return c.cast("timestamp_ntz")
    return text_form(c, t)


def _bytes_text(c: Column, t: T.DataType) -> Column:
    raw = c if isinstance(t, T.BinaryType) else c.cast("string").cast("binary")
    return F.regexp_replace(F.hex(raw), r"(?:20)++\z", "")


def values_equal(a: Column, ta: T.DataType, b: Column, tb: T.DataType, tol: float = TOLERANCE) -> Column:
    """Equality across stores; never NULL.

    Two NULLs are equal. Numbers agree within ``tol`` (whole numbers exactly, a
    boolean counts as 0 or 1), times by instant, bytes exactly, text (and bytes
    facing text) after padding is trimmed. A number or a time facing
    text is compared after parsing the text; unparsable text is different.
    """
    if isinstance(ta, T.BooleanType) and is_number(tb):
        return values_equal(a.cast("int"), T.IntegerType(), b, tb, tol)
    if isinstance(tb, T.BooleanType) and is_number(ta):
        return values_equal(b, tb, a, ta, tol)
    if is_number(ta) and is_number(tb):
        if isinstance(ta, INTEGRAL) and isinstance(tb, INTEGRAL):
            return a.eqNullSafe(b)
        if isinstance(ta, INTEGRAL) or isinstance(tb, INTEGRAL):  # a double would hide differences beyond 2^53
            wide = T.DecimalType(38, 10)
            x, y = a.try_cast(wide), b.try_cast(wide)
            return (a.isNull() & b.isNull()) | F.coalesce(F.abs(F.try_subtract(x, y)) < F.lit(tol), F.lit(False))
        if isinstance(ta, FLOATING) or isinstance(tb, FLOATING):
            x, y = a.cast("double"), b.cast("double")
            return x.eqNullSafe(y) | F.coalesce(F.abs(x - y) < F.lit(tol), F.lit(False))
        gap = F.abs(F.try_subtract(a, b))
        return a.eqNullSafe(b) | F.coalesce(gap < F.lit(tol), F.lit(False))
    if isinstance(ta, TEMPORAL) and isinstance(tb, TEMPORAL):
        return a.cast("timestamp_ntz").eqNullSafe(b.cast("timestamp_ntz"))
    if isinstance(tb, T.StringType) and (is_number(ta) or isinstance(ta, TEMPORAL)):
        return values_equal(b, tb, a, ta, tol)
    if isinstance(ta, T.StringType) and isinstance(tb, TEMPORAL):
        parsed = normalize_compare_time(a).try_cast("timestamp_ntz")
        return (a.isNull() & b.isNull()) | F.coalesce(parsed == b.cast("timestamp_ntz"), F.lit(False))
    if isinstance(ta, T.StringType) and is_number(tb):
        kind = T.DoubleType() if isinstance(tb, FLOATING) else T.DecimalType(38, 10)
        other = b.cast(kind)
        near = F.abs(F.try_subtract(a.try_cast(kind), other)) < F.lit(tol)
        same = a.try_cast(kind) == other
        return (a.isNull() & b.isNull()) | F.coalesce(same | near, F.lit(False))
    if isinstance(ta, T.BinaryType) and isinstance(tb, T.BinaryType):
        return a.eqNullSafe(b)
    if isinstance(ta, T.BinaryType) or isinstance(tb, T.BinaryType):
        return _bytes_text(a, ta).eqNullSafe(_bytes_text(b, tb))
    return text_form(a, ta).eqNullSafe(text_form(b, tb))
