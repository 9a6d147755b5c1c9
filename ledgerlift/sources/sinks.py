"""Writing tables, snapshots by rename, restore, and the run history. Targets are catalog tables or JDBC."""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.operators.naming import SNAPSHOT_NAME, SNAPSHOT_PREFIX
from ledgerlift.operators.rows import align_to_columns
from ledgerlift.session import work_dir

POLICIES = ("backup", "drop", "error", "append")
INSERT_ROWS = 500  # fixed value: rows per insert statement


def ensure_database(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A database whose tables live in the shared folder."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{folder or work_dir(spark, name)}'")
    return name


def table_exists(spark: SparkSession, db: str, table: str) -> bool:
    return spark.catalog.tableExists(f"`{db}`.`{table}`")


def write_table(df: DataFrame, db: str, table: str, mode: str = "errorifexists", columns: T.StructType | None = None) -> int:
    """Write a table and return the rows written, counted by the writing job itself.

    With ``columns`` the rows follow the target's columns; one the source lacks becomes NULL.
    """
    rows = align_to_columns(df, columns) if columns is not None else df
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("parquet").mode(mode).saveAsTable(f"`{db}`.`{table}`")
    return seen.get["n"]


def jdbc_write_options(url: str, table: str, partitions: int = 8, **extra: str) -> dict[str, str]:
    """Options of a JDBC write: many rows per statement, one transaction per partition, bounded connections."""
    return {"url": url, "dbtable": table, "batchsize": str(INSERT_ROWS), "numPartitions": str(partitions), **extra}


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **extra: str) -> None:
    df.write.format("jdbc").options(**jdbc_write_options(url, table, **extra)).mode(mode).save()


def snapshot_name(table: str, run_ts: datetime) -> str:
    return f"{SNAPSHOT_PREFIX}{table}_{run_ts:%Y%m%d_%H%M%S}"


def is_snapshot(name: str) -> bool:
    return re.match(SNAPSHOT_NAME.replace(r"\z", r"\Z"), name) is not None


def snapshot_table(spark: SparkSession, db: str, table: str, run_ts: datetime, copy: bool = False) -> str:
    """Put the current table aside and return the snapshot's name.

    A rename moves no rows. ``copy=True`` keeps the table in place as well, and
    checks that both hold the same number of rows.
    """
    name = snapshot_name(table, run_ts)
    if not copy:
        spark.sql(f"ALTER TABLE `{db}`.`{table}` RENAME TO `{db}`.`{name}`")
        return name
    current = spark.table(f"`{db}`.`{table}`")
    written = write_table(current, db, name)
    if written != current.count():
        spark.sql(f"DROP TABLE `{db}`.`{name}`")
        raise RuntimeError(f"snapshot of {table} is incomplete")
    return name


def restore_table(spark: SparkSession, db: str, snapshot: str, table: str | None = None) -> str:
    """Bring a snapshot back under its table's name. The current table goes only after the snapshot is in place."""
    if not is_snapshot(snapshot) or not table_exists(spark, db, snapshot):
        raise ValueError(f"{snapshot} is not a snapshot")
    name = table or re.match(SNAPSHOT_NAME.replace(r"\z", r"\Z"), snapshot)[1]
    aside = f"{name}__replaced_{uuid.uuid4().hex[:8]}"  # no user's table
    had_current = table_exists(spark, db, name)
    if had_current:
        spark.sql(f"ALTER TABLE `{db}`.`{name}` RENAME TO `{db}`.`{aside}`")
    spark.sql(f"ALTER TABLE `{db}`.`{snapshot}` RENAME TO `{db}`.`{name}`")
    if had_current:
        spark.sql(f"DROP TABLE `{db}`.`{aside}`")
    return name


def restore_tables(spark: SparkSession, db: str, snapshots: list[str]) -> DataFrame:
    """Restore several; one that fails does not stop the others."""
    rows = []
    for s in snapshots:
        try:
            rows.append((s, restore_table(spark, db, s), True, None))
        except Exception as e:
            rows.append((s, None, False, str(e).splitlines()[0]))
    return spark.createDataFrame(rows, "snapshot_name string, table_name string, restored boolean, error string")


def drop_snapshot(spark: SparkSession, db: str, snapshot: str) -> None:
    """Only tables with a full snapshot name may be dropped this way."""
    if not is_snapshot(snapshot):
        raise ValueError(f"{snapshot} is not a snapshot")
    spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{snapshot}`")


def catalog_tables(spark: SparkSession, db: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN `{db}`").select(F.col("tableName").alias("table_name"))


def prepare_target(spark: SparkSession, db: str, table: str, policy: str, run_ts: datetime) -> str | None:
    """Apply the write policy to an existing target; returns the snapshot taken, if any."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    if policy == "append" or not table_exists(spark, db, table):
        return None
    if policy == "backup":
        return snapshot_table(spark, db, table, run_ts)
    if policy == "drop":
        spark.sql(f"DROP TABLE `{db}`.`{table}`")
        return None
    raise ValueError(f"target table {table} exists")


def append_run(run: DataFrame, db: str, table: str = "run_history") -> None:
    """Add runs to the history."""
    run.write.format("parquet").mode("append").saveAsTable(f"`{db}`.`{table}`")


def delete_run(spark: SparkSession, db: str, run_id: int, table: str = "run_history") -> None:
    """Remove one run: the rest is written next to the history, then the two change names."""
    rest = spark.table(f"`{db}`.`{table}`").filter(F.col("run_id") != run_id)
    stage, old = f"{table}__stage", f"{table}__old"
    write_table(rest, db, stage, "overwrite")
    spark.sql(f"ALTER TABLE `{db}`.`{table}` RENAME TO `{db}`.`{old}`")
    spark.sql(f"ALTER TABLE `{db}`.`{stage}` RENAME TO `{db}`.`{table}`")
    spark.sql(f"DROP TABLE `{db}`.`{old}`")
