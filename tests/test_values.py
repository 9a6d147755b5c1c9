"""Value clean-up and equality: the literal cases and the decided rules."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions import timetext as tt
from ledgerlift.functions import values as v
from ledgerlift.operators.rows import coerce_for_sink
from ledgerlift.operators.typemap import default_literal, strip_default_cast


def column(spark, rows, fn, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_datetime_text(spark):
    cases = {
        "1987-02-03 04:05:06 +0000 UTC": "1987-02-03 04:05:06",
        "1987-02-03 04:05:06.25 -0330 NST": "1987-02-03 04:05:06.25",
        "1999-12-31 23:59:59 +0100 CET m=+12.5": "1999-12-31 23:59:59",
        "1999-12-31 23:59:59": "1999-12-31 23:59:59",
        "1999-12-31T23:59:59Z": "1999-12-31T23:59:59Z",
        "2011-11-11T11:11:11 -05:00": "2011-11-11 11:11:11",
        "2011-11-11 11:11:11 -05:00\n": "2011-11-11 11:11:11 -05:00\n",
        "pending": "pending",
        "": "",
        None: None,
    }
    assert column(spark, list(cases), tt.normalize_datetime_text) == list(cases.values())


@pytest.mark.parametrize("with_fraction", [False, True])
def test_timestamp_text(spark, with_fraction):
    cases = [
        ("1999-7-4", "1999-7-4 00:00:00", ".000000"),
        ("1999-07-04 23:59:58", "1999-07-04 23:59:58", ".000000"),
        ("1999-07-04 23:59:58.07", "1999-07-04 23:59:58", ".070000"),
        ("1999-07-04 23:59:58.987654321", "1999-07-04 23:59:58", ".987654"),
        ("1999-07-04T23:59:58-0330", "1999-07-04 23:59:58", ".000000"),
        ("1999-07-04T23:59:58.5Z", "1999-07-04 23:59:58", ".500000"),
        ("  1999-07-04 3:09:08 noon ", "1999-07-04 3:09:08", ".000000"),
    ]
    want = [base + (frac if with_fraction else "") for _, base, frac in cases] + ["July 4th"]
    got = column(spark, [c[0] for c in cases] + ["July 4th"], lambda c: tt.normalize_timestamp_text(c, with_fraction))
    assert got == want


def test_compare_time(spark):
    cases = {
        "2026-01-02T15:04:05Z": "2026-01-02 15:04:05",
        "2026-01-02 15:04:05 UTC": "2026-01-02 15:04:05",
        "2026-01-02 15:04:05.5+08:00": "2026-01-02 15:04:05.5",
        "2026-01-02 15:04:05 -0300": "2026-01-02 15:04:05",
        "2026-01-02": "2026-01-02",
    }
    assert column(spark, list(cases), tt.normalize_compare_time) == list(cases.values())


def test_zero_dates(spark):
    cases = {"0000-00-00": True, "0000-00-00 00:00:00": True, "2024-00-00": False, "none": False}
    assert column(spark, list(cases), tt.is_zero_date) == list(cases.values())


def test_padding_keeps_tabs(spark):
    assert column(spark, ["a  ", "a\t ", " a"], v.trim_padding) == ["a", "a\t", " a"]


def test_preview(spark):
    long = "é" * 51
    assert column(spark, [long, "é" * 50, None], v.preview_value) == ["é" * 47 + "...", "é" * 50, "NULL"]
    assert column(spark, [b"\x00\xff", None], lambda c: v.preview_value(c, T.BinaryType()), "binary") == ["<binary 2 bytes>", "NULL"]


def test_binary_text(spark):
    raw = [b"\x00\xff\x10", b"", "ü".encode(), bytes(range(256)) * 8]
    assert [bytes(x) for x in column(spark, raw, lambda c: v.decode_binary(v.encode_binary(c)), "binary")] == raw
    assert column(spark, ["hex:0", "hex:zz", "plain"], v.decode_binary) == [None, None, None]


def equal(spark, a, ta, b, tb):
    df = spark.createDataFrame([(a, b)], f"a {ta}, b {tb}")
    kind = df.schema
    return df.select(v.values_equal(F.col("a"), kind["a"].dataType, F.col("b"), kind["b"].dataType)).first()[0]


def test_equality(spark):
    stamp = datetime.datetime(2026, 1, 2, 15, 4, 5, 123456)
    dec = decimal.Decimal
    assert equal(spark, None, "string", None, "int")
    assert not equal(spark, None, "string", "x", "string")
    assert equal(spark, 1.0, "double", 1.0 + 5e-10, "double")
    assert not equal(spark, 1.0, "double", 1.0 + 2e-9, "double")
    assert equal(spark, float("nan"), "double", float("nan"), "double")
    assert equal(spark, float("inf"), "double", float("inf"), "double")
    assert not equal(spark, 2**53, "bigint", 2**53 + 1, "bigint")
    assert equal(spark, 5, "int", 5, "bigint")
    assert equal(spark, dec("12.50"), "decimal(10,2)", dec("12.5"), "decimal(38,18)")
    assert equal(spark, dec("9" * 38), "decimal(38,0)", dec("9" * 38), "decimal(38,0)")
    assert equal(spark, "12.5 ", "string", 12.5, "double")
    assert equal(spark, 12, "int", "12", "string")
    assert not equal(spark, "twelve", "string", 12, "int")
    assert equal(spark, stamp, "timestamp_ntz", "2026-01-02T15:04:05.123456Z", "string")
    assert not equal(spark, stamp, "timestamp_ntz", "2026-01-02 15:04:05.123", "string")
    assert equal(spark, datetime.date(2026, 1, 2), "date", datetime.datetime(2026, 1, 2), "timestamp_ntz")
    assert equal(spark, "ab  ", "string", "ab", "string")
    assert not equal(spark, " ab", "string", "ab", "string")
    assert not equal(spark, b"ab  ", "binary", b"ab", "binary")
    assert equal(spark, b"ab  ", "binary", "ab", "string")
    assert equal(spark, True, "boolean", 1, "int") and equal(spark, 0, "bigint", False, "boolean")
    assert not equal(spark, True, "boolean", 0, "int") and equal(spark, None, "boolean", None, "int")
    assert not equal(spark, 2**53 + 1, "bigint", float(2**53), "double")
    assert equal(spark, 2**53, "bigint", float(2**53), "double") and not equal(spark, 1, "bigint", float("nan"), "double")
    assert equal(spark, b"ab", "binary", "ab", "string")
    assert not equal(spark, b"\x12\x0a", "binary", b"\x12\x0b", "binary")
    assert equal(spark, [1, 2], "array<int>", [1, 2], "array<int>")


def test_keys_stay_exact(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "k bigint")
    assert df.select(v.normalize_key(F.col("k"), T.LongType())).distinct().count() == 2


def test_coerce(spark):
    df = spark.createDataFrame([(1, "1.5", "7", "true"), (2, "x", "7.0", "yes"), (3, None, None, None), (4, "1d", "99999999999999999999", "0")], "id int, d string, n string, b string")
    good, bad = coerce_for_sink(df, {"d": "double", "n": "bigint", "b": "boolean"})
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, 1.5, 7, True), (2, None, None, None), (3, None, None, None), (4, None, None, False)]
    assert sorted(tuple(r) for r in bad.collect()) == [(2, "b", "yes"), (2, "d", "x"), (2, "n", "7.0"), (4, "d", "1d"), (4, "n", "99999999999999999999")]


def test_default_literals(spark):
    cases = {"5": "5", "-1.5": "-1.5", "pending": "'pending'", "it's": "'it''s'", "now()": "CURRENT_TIMESTAMP", "NULL": "NULL", "curdate()": "CURRENT_DATE", "'x'": "'x'", "uuid()": "uuid()", "": ""}
    assert column(spark, list(cases), default_literal) == list(cases.values())
    casts = {
        "'pending'::character varying": "'pending'", "NULL::text": "NULL", "0::numeric": "0", "'a::b'::text": "'a::b'",
        "nextval('t_id_seq'::regclass)": "nextval('t_id_seq'::regclass)", "now()::timestamp": "now()", "plain": "plain",
    }
    assert column(spark, list(casts), strip_default_cast) == list(casts.values())
