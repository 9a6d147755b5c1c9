"""Row-level steps between reading and writing a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions.timetext import normalize_datetime_text


def drop_generated(df: DataFrame, generated: Iterable[str]) -> DataFrame:
    """Generated columns are computed by the target and never written."""
    skip = set(generated)
    return df.select(*[c for c in df.columns if c not in skip])


def align_to_columns(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """Columns in the target's order; one the source lacks becomes NULL."""
    have = set(df.columns)
    return df.select(
        *[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields]
    )


def normalize_all_text(df: DataFrame) -> DataFrame:
    """Datetime clean-up over every text column."""
    return df.select(
        *[
            normalize_datetime_text(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def parse_as(c: Column, kind: str) -> Column:
    """Text to double, bigint or boolean; NULL when the text is not one.

    Stricter than a cast: only ``true``/``1`` and ``false``/``0`` are booleans.
    """
    if kind in ("double", "float"):
        shape = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z|^[+-]?(?:(?i)inf|infinity|nan)\z"
        return F.when(c.rlike(shape), c.try_cast(kind))
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.when(c.rlike(r"^[+-]?\d+\z"), c.try_cast(kind))
    if kind == "boolean":
        return F.when(c.isin("true", "1"), F.lit(True)).when(c.isin("false", "0"), F.lit(False))
    raise ValueError(f"no text form for {kind}")


def coerce_for_sink(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and one reject row per value that could not be read.

    A typed column cannot keep unreadable text, so it goes to the rejects with
    its column name while the typed value is NULL.
    """
    good = df.select(*[parse_as(F.col(c), types[c]).alias(c) if c in types else F.col(c) for c in df.columns])
    failed = [
        F.when(
            F.col(c).isNotNull() & parse_as(F.col(c), t).isNull(),
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("raw_value")),
        )
        for c, t in types.items()
    ]
    keep = [c for c in df.columns if c not in types]
    bad = df.select(*keep, F.explode(F.array_compact(F.array(*failed))).alias("r")).select(*keep, "r.*")
    return good, bad
