"""Clean-up of dates and times that arrive as text. Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text shapes that count as a datetime, and those whose zone is dropped.
PLAIN_DATETIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?\z"
ZONE_NAME_DATETIME = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?) [+-]\d{4} [A-Z]+(?: m=[+-][\d.]+)?\z"
OFFSET_DATETIME = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+[+-]\d{2}:?\d{2}\z"
SHORTEST_ZONED = len("2024-01-01 00:00:00 +0000")  # shorter text fits neither of the two above
LOOSE_DATE = r"^\d{4}-\d{1,2}-\d{1,2}\z"
LOOSE_DATETIME = (
    r"^(\d{4}-\d{1,2}-\d{1,2})[T ](\d{1,2}:\d{1,2}:\d{1,2})"
    r"(?:\.(\d{1,9}))?(?:[+-]\d{2}:?\d{2}|Z| .+)?\z"
)
ZONE_SUFFIX = r"(?: \+0000 UTC| UTC|Z| \+08:00)\z"


def looks_like_datetime(c: Column) -> Column:
    """True for plain, offset and zone-name datetimes."""
    return c.rlike(PLAIN_DATETIME) | c.rlike(ZONE_NAME_DATETIME) | c.rlike(OFFSET_DATETIME)


def normalize_datetime_text(c: Column) -> Column:
    """Drop a numeric offset or a zone name and keep the wall time; leave other text alone."""
    return (
        F.when(F.octet_length(c) < SHORTEST_ZONED, c)
        .when(c.rlike(OFFSET_DATETIME), F.translate(F.regexp_extract(c, OFFSET_DATETIME, 1), "T", " "))
        .when(c.rlike(ZONE_NAME_DATETIME), F.regexp_extract(c, ZONE_NAME_DATETIME, 1))
        .otherwise(c)
    )


def normalize_timestamp_text(c: Column, with_fraction: bool) -> Column:
    """Bring dated text to ``date time[.ffffff]``; text of any other shape stays as it is."""
    s = F.trim(c)
    base = F.concat_ws(" ", F.regexp_extract(s, LOOSE_DATETIME, 1), F.regexp_extract(s, LOOSE_DATETIME, 2))
    if with_fraction:
        fraction = F.rpad(F.left(F.regexp_extract(s, LOOSE_DATETIME, 3), F.lit(6)), 6, "0")
        full, midnight = F.concat(base, F.lit("."), fraction), " 00:00:00.000000"
    else:
        full, midnight = base, " 00:00:00"
    return F.when(s.rlike(LOOSE_DATE), F.concat(s, F.lit(midnight))).when(s.rlike(LOOSE_DATETIME), full).otherwise(s)


def normalize_compare_time(c: Column) -> Column:
    """Text form used when a timestamp is compared with text: no zone, a blank between date and time.

    The zone suffix goes first, so that a bare `` UTC`` is recognised too.
    """
    s = F.translate(F.regexp_replace(F.trim(c), ZONE_SUFFIX, ""), "T", " ")
    tail = F.regexp_replace(F.substring(s, F.lit(11), F.char_length(s)), r"(?s)[+-].*", "")
    return F.trim(F.concat(F.left(s, F.lit(10)), tail))


def format_timestamp(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` plus the fraction without trailing zeros (Spark's own text cast)."""
    return c.cast("timestamp_ntz").cast("string")


def is_zero_date(c: Column) -> Column:
    """All digits are zeros, and there is at least one."""
    return c.contains("0") & ~c.rlike("[1-9]")
