"""Which tables take part, what they are called in the target, and which are snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNAPSHOT_PREFIX = "_bak_"  # fixed values: _bak_<table>_<yyyyMMdd>_<HHmmss>
SNAPSHOT_NAME = r"^_bak_(.+)_\d{8}_\d{6}\z"
SCHEMALESS = ("sqlite", "cassandra", "scylladb")


def select_tables(catalog: DataFrame, wanted: list[str] | None = None, skip_snapshots: bool = True) -> DataFrame:
    """All tables or a chosen few; snapshots are left out of checks."""
    rows = catalog.filter(F.col("table_name").isin(*[w.strip() for w in wanted])) if wanted else catalog
    return rows.filter(~F.col("table_name").startswith(SNAPSHOT_PREFIX)) if skip_snapshots else rows


def list_snapshots(catalog: DataFrame) -> DataFrame:
    """Snapshot tables with the table each belongs to; only a full name may be restored or dropped."""
    name = F.col("table_name")
    proper = name.rlike(SNAPSHOT_NAME)
    original = F.when(proper, F.regexp_extract(name, SNAPSHOT_NAME, 1)).otherwise(F.substring(name, F.lit(len(SNAPSHOT_PREFIX) + 1), F.char_length(name)))
    return catalog.filter(name.startswith(SNAPSHOT_PREFIX)).select(
        name.alias("snapshot_name"), original.alias("original_name"), proper.alias("can_restore"),
        *[c for c in catalog.columns if c != "table_name"],
    )


def resolve_target(
    names: DataFrame,
    rules: list[tuple[str, str]] | None = None,
    overrides: DataFrame | None = None,
    default: str = "",
    dialect: str = "postgres",
) -> DataFrame:
    """``source_table`` and ``target_table``: override, else the first matching rule, else the default schema.

    A rule whose target holds a dot is a template for the whole name (``$1``
    takes a group); a rule that is not a valid pattern is skipped.
    """
    source = F.col("source_table")
    if dialect in SCHEMALESS:
        return names.withColumn("target_table", source)
    chain = F.when(F.lit(False), source)
    for pattern, target in rules or []:
        try:
            re.compile(pattern)
        except re.error:
            continue
        named = F.regexp_replace(source, pattern, target) if "." in target else F.concat(F.lit(target + "."), source)
        chain = chain.when(source.rlike(pattern), named)
    last = F.concat(F.lit(default + "."), source) if default else source
    rows = names
    picked = chain.otherwise(last)
    if overrides is not None:
        chosen = overrides.filter("target_schema <> ''").groupBy("source_table").agg(F.max("target_schema").alias("_s"))
        rows = names.join(chosen, "source_table", "left_outer")
        picked = F.when(F.col("_s").isNotNull(), F.concat_ws(".", F.col("_s"), source)).otherwise(picked)
    return rows.select(*[c for c in names.columns], picked.alias("target_table"))
