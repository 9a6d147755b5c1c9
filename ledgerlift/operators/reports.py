"""Run reports, status, progress and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED = ("failed", "rolled_back")  # fixed values: table states
RUNNING = "running"


def run_status(error: Column, tables_success: Column) -> Column:
    """success without an error; with one, partial if any table arrived, else failed."""
    clean = F.coalesce(error, F.lit("")) == ""
    return F.when(clean, "success").when(tables_success > 0, "partial").otherwise("failed")


def run_report(run_tables: DataFrame) -> DataFrame:
    """Counts per run: tables by outcome, rows of the successful ones, roll-backs. All partial sums combine map-side."""
    status = F.col("status")
    return run_tables.groupBy("run_id").agg(
        F.count("*").alias("tables_total"),
        F.count_if(status == "success").alias("tables_success"),
        F.count_if(status.isin(*FAILED)).alias("tables_failed"),
        F.count_if(status == "cancelled").alias("tables_cancelled"),
        F.count_if(status == "rolled_back").alias("rollback_count"),
        F.coalesce(F.sum(F.when(status == "success", F.col("n_rows"))), F.lit(0)).alias("total_rows"),
    )


def failed_tables(run_tables: DataFrame) -> DataFrame:
    """The failed tables of every run as rows, so a run may have any number of them."""
    return run_tables.filter(F.col("status").isin(*FAILED)).select("run_id", "table_no", "table_name", "status")


def progress(run_tables: DataFrame) -> DataFrame:
    """Percent done per run: finished tables plus the row share of the running ones, at most 100."""
    running = F.col("status") == RUNNING
    share = F.when(running & (F.col("total_rows") > 0), F.col("n_rows") / F.col("total_rows")).otherwise(0.0)
    done = F.when(running, 0).otherwise(1)
    percent = F.least((F.sum(done) + F.sum(share)) / F.count("*") * 100, F.lit(100.0))
    return run_tables.groupBy("run_id").agg(F.sum(done).alias("tables_done"), F.count("*").alias("tables_total"), F.round(percent, 6).alias("percent"))


def latest_runs(history: DataFrame, n: int) -> DataFrame:
    """Newest runs first."""
    return history.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)
