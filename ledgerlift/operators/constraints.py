"""Rules a target database would enforce, checked on the rows before or after the load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest whole number each narrowed target type can hold.
EXACT_IN_DOUBLE_DIGITS = 15
SIGNED_LIMITS = {"TINYINT": 2**7 - 1, "SMALLINT": 2**15 - 1, "INT": 2**31 - 1, "BIGINT": 2**63 - 1}


def fk_orphans(child: DataFrame, parent: DataFrame, fk: dict[str, str]) -> DataFrame:
    """Child rows whose reference points nowhere. A row with any NULL in the reference is exempt.

    Parent keys are made distinct before the join; child rows are the streamed
    side, so a hot reference value can be split by adaptive execution.
    """
    cond = F.lit(True)
    for c in fk:
        cond = cond & F.col(c).isNotNull()
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(fk.values())]).distinct()
    linked = child.filter(cond).select("*", *[F.col(c).alias(f"_p{i}") for i, c in enumerate(fk)])
    return linked.join(keys, [f"_p{i}" for i in range(len(fk))], "left_anti").select(*child.columns)


def unique_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values that occur more than once; rows with a NULL in the columns are exempt."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond).groupBy(*cols).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def _long_form(df: DataFrame, counts: dict[str, Column], name: str, value: str) -> DataFrame:
    """All counters in one pass over the table, then one row per counter."""
    one = df.agg(*[c.alias(f"_c{i}") for i, c in enumerate(counts.values())])
    pairs = [F.struct(F.lit(n).alias(name), F.col(f"_c{i}").alias(value)) for i, n in enumerate(counts)]
    return one.select(F.explode(F.array(*pairs)).alias("v")).select("v.*")


def null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULLs per column that the target declares NOT NULL."""
    return _long_form(df, {c: F.count_if(F.col(c).isNull()) for c in cols}, "column_name", "null_rows")


def check_violations(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Rows failing each CHECK predicate; an unknown (NULL) outcome passes, as in SQL."""
    return _long_form(df, {n: F.count_if(~F.expr(e)) for n, e in checks.items()}, "check_name", "failed_rows")


def range_violations(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Values that do not survive the target's type: ``{column: DOUBLE | TINYINT | … | UNSIGNED}``."""
    bad: dict[str, Column] = {}
    for c, kind in targets.items():
        v = F.col(c).cast("decimal(38,0)")
        if kind == "DOUBLE":
            over = F.abs(v) >= F.lit(10**EXACT_IN_DOUBLE_DIGITS).cast("decimal(38,0)")
        elif kind == "UNSIGNED":
            over = v < 0
        else:
            top = F.lit(SIGNED_LIMITS[kind]).cast("decimal(38,0)")
            over = (v > top) | (v < -top - 1)
        bad[c] = F.count_if(over)
    return _long_form(df, bad, "column_name", "bad_rows")


def sequence_high_water(df: DataFrame, col: str) -> DataFrame:
    """Where an identity column continues after a load; 1 for an empty table."""
    return df.agg(F.coalesce(F.max(col), F.lit(1)).cast("long").alias("high_water"))


def infer_temporal_columns(df: DataFrame, looks_like, sample: int | None = None) -> DataFrame:
    """Text columns in which every non-empty value is a datetime.

    All columns are judged in one pass over the whole table; ``sample`` restores
    the quick look at the first non-empty values.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    rows = df.select(*texts) if sample is None else df.select(*texts).limit(sample)
    one = rows.agg(
        *[F.count_if(F.coalesce(F.col(c) != "", F.lit(False))).alias(f"_n{i}") for i, c in enumerate(texts)],
        *[F.count_if(looks_like(F.col(c))).alias(f"_t{i}") for i, c in enumerate(texts)],
    )
    facts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_n{i}").alias("filled_rows"),
            ((F.col(f"_n{i}") > 0) & (F.col(f"_n{i}") == F.col(f"_t{i}"))).alias("is_temporal"),
        )
        for i, c in enumerate(texts)
    ]
    return one.select(F.explode(F.array(*facts)).alias("v")).select("v.*")
