"""The copy job: read, clean, cast and write each table, and report what happened."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions.values import literal
from ledgerlift.operators.constraints import fk_orphans
from ledgerlift.operators.naming import resolve_target
from ledgerlift.operators.reports import run_status
from ledgerlift.operators.rows import drop_generated, normalize_all_text
from ledgerlift.operators.typemap import cast_to_target
from ledgerlift.sources import sinks

REPORT = (
    "table_no int, table_name string, target_table string, status string, n_rows bigint,"
    " snapshot_name string, rolled_back boolean, error string"
)


@dataclass
class TableCopy:
    """One table to copy. ``identity`` names the column whose next value is recorded after the load."""

    name: str
    rows: DataFrame
    generated: tuple[str, ...] = ()
    identity: str | None = None


@dataclass
class CopySpec:
    """Where the tables go and what happens to tables that are already there."""

    database: str
    policy: str = "error"
    dialect: str = "postgres"
    run_ts: datetime = field(default_factory=datetime.now)
    rules: list[tuple[str, str]] = field(default_factory=list)
    overrides: dict[str, str] = field(default_factory=dict)
    default_schema: str = ""


def prepare_rows(rows: DataFrame, generated: Iterable[str], dialect: str) -> DataFrame:
    """The steps between reading and writing: no generated columns, clean times, the target's types."""
    return cast_to_target(normalize_all_text(drop_generated(rows, generated)), dialect)


def target_names(spark: SparkSession, names: list[str], spec: CopySpec) -> dict[str, str]:
    """Target of each table; a schema becomes a prefix of the catalog table's name."""
    if not (spec.rules or spec.overrides or spec.default_schema):
        return {n: n for n in names}
    source = spark.createDataFrame([(n,) for n in names], "source_table string")
    chosen = spark.createDataFrame(list(spec.overrides.items()), "source_table string, target_schema string") if spec.overrides else None
    found = resolve_target(source, spec.rules, chosen, spec.default_schema, spec.dialect).collect()  # one row per table
    return {r["source_table"]: r["target_table"].replace(".", "__") for r in found}


def copy_one(spark: SparkSession, no: int, table: TableCopy, target: str, spec: CopySpec) -> tuple:
    """Copy one table.

    Rows are written under a name of their own and take the target's name only
    when all of them are there, so a failed copy leaves the old table in place.
    ``rolled_back`` marks a failure under the backup policy after which the
    target holds its old rows, whether they never moved or came back.
    """
    db = spec.database
    existed = sinks.table_exists(spark, db, target)
    snapshot = stage = None
    try:
        if spec.policy == "error" and existed:
            raise ValueError(f"target table {target} exists")
        if spec.policy == "backup" and existed and sinks.table_exists(spark, db, sinks.snapshot_name(target, spec.run_ts)):
            raise ValueError(f"snapshot {sinks.snapshot_name(target, spec.run_ts)} exists")
        rows = prepare_rows(table.rows, table.generated, spec.dialect)
        if spec.policy == "append" and existed:
            columns = spark.table(f"`{db}`.`{target}`").schema
            written = sinks.write_table(rows, db, target, "append", columns)
        else:
            stage = f"{target}__load_{uuid.uuid4().hex[:8]}"
            written = sinks.write_table(rows, db, stage)
            snapshot = sinks.prepare_target(spark, db, target, spec.policy, spec.run_ts)
            spark.sql(f"ALTER TABLE `{db}`.`{stage}` RENAME TO `{db}`.`{target}`")
        return (no, table.name, target, "success", written, snapshot, False, None)
    except Exception as e:
        reason = str(e).splitlines()[0]
        try:
            if stage is not None:
                spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{stage}`")
            if snapshot is not None:
                sinks.restore_table(spark, db, snapshot, target)
        except Exception as again:
            return (no, table.name, target, "failed", 0, snapshot, False, f"{reason}; restore: {str(again).splitlines()[0]}")
        back = spec.policy == "backup" and existed
        return (no, table.name, target, "rolled_back" if back else "failed", 0, None, back, reason)


def copy_tables(spark: SparkSession, tables: list[TableCopy], spec: CopySpec) -> DataFrame:
    """Copy tables in the given order, one job each; returns one report row per table."""
    names = target_names(spark, [t.name for t in tables], spec)
    rows = [copy_one(spark, i, t, names[t.name], spec) for i, t in enumerate(tables)]
    return spark.createDataFrame(rows, REPORT)


def record_identities(spark: SparkSession, tables: list[TableCopy], report: DataFrame, spec: CopySpec) -> DataFrame:
    """Next identity start of each copied table that has such a column."""
    done = {r["table_name"]: r["target_table"] for r in report.filter("status = 'success'").collect()}  # one row per table
    parts = []
    for t in tables:
        if t.identity and t.name in done:
            copied = spark.table(f"`{spec.database}`.`{done[t.name]}`")
            high = F.coalesce(F.max(t.identity), F.lit(1)).cast("long").alias("high_water")
            parts.append(copied.agg(high).select(F.lit(t.name).alias("table_name"), F.lit(t.identity).alias("column_name"), "high_water"))
    out = spark.createDataFrame([], "table_name string, column_name string, high_water bigint")
    for p in parts:
        out = out.unionByName(p)
    return out


def orphan_counts(spark: SparkSession, spec: CopySpec, links: list[tuple[str, str, dict[str, str]]]) -> DataFrame:
    """Rows that would stop each foreign key from being created after the load."""
    out = spark.createDataFrame([], "child string, parent string, orphan_rows bigint")
    for child, parent, keys in links:
        lost = fk_orphans(spark.table(f"`{spec.database}`.`{child}`"), spark.table(f"`{spec.database}`.`{parent}`"), keys)
        counted = lost.agg(F.count("*").alias("orphan_rows"))
        out = out.unionByName(counted.select(F.lit(child).alias("child"), F.lit(parent).alias("parent"), "orphan_rows"))
    return out


def run_row(report: DataFrame, run_id: int, spec: CopySpec, error: str = "") -> DataFrame:
    """History row of a run."""
    status = F.col("status")
    ok = F.count_if(status == "success")
    return report.agg(
        F.lit(run_id).cast("long").alias("run_id"),
        literal(spec.run_ts, T.TimestampNTZType()).alias("created_at"),
        F.count("*").alias("tables_total"),
        ok.alias("tables_success"),
        F.count_if(status.isin("failed", "rolled_back")).alias("tables_failed"),
        F.coalesce(F.sum(F.when(status == "success", F.col("n_rows"))), F.lit(0)).alias("total_rows"),
        F.lit(error).alias("error"),
        run_status(F.lit(error), ok).alias("status"),
    )
