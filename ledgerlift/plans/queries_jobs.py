"""Copy job, sinks, snapshots, run reports and history."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.operators import naming, reports
from ledgerlift.operators.reconcile import field_diffs, pair_rows, row_counts, validate_tables
from ledgerlift.plans import derived as d
from ledgerlift.plans.copyjob import CopySpec, TableCopy, copy_tables, prepare_rows, run_row
from ledgerlift.plans.queries_rows import DATES_SQL, ORDER_COLS, _norm_sql
from ledgerlift.plans.registry import query
from ledgerlift.session import shuffles_removed
from ledgerlift.sources import sinks
from ledgerlift.sources.tables import read_table

RUN_TS = datetime(2026, 8, 30, 15, 30, 22)
RUNS_SQL, RUN_TABLES_SQL = d.sql_of("orders", d.RUNS), d.sql_of("lineitem", d.RUN_TABLES)


def _database(spark) -> str:
    return sinks.ensure_database(spark, f"ll_{uuid.uuid4().hex[:12]}")


@query(
    "copy_orders",
    f"SELECT {', '.join('orders.' + c.strip() for c in ORDER_COLS.split(','))}, {_norm_sql('dt_text')} AS dt_text, {_norm_sql('note')} AS note FROM orders JOIN ({DATES_SQL}) t USING (o_orderkey)",
)
def copy_orders(spark, sf):
    """Copies all order columns and more dates as text and returns the target table."""
    spec = CopySpec(_database(spark), run_ts=RUN_TS)
    texts = [f"{e} AS {n}" for n, e in d.DATE_TEXT if n != "o_orderkey"]
    rows = read_table(spark, sf, "orders").selectExpr("*", *texts).withColumn("computed", F.col("o_orderkey") * 2)
    report = copy_tables(spark, [TableCopy("orders", rows, generated=("computed",))], spec).first()
    if report["status"] != "success":
        raise RuntimeError(report["error"])
    return spark.table(f"`{spec.database}`.`orders`")


_ALL_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("copy_report", " UNION ALL ".join(f"SELECT {i} AS table_no, '{t}' AS table_name, 'success' AS status, count(*) AS n_rows FROM {t}" for i, t in enumerate(_ALL_TABLES)))
def copy_report(spark, sf):
    spec = CopySpec(_database(spark), run_ts=RUN_TS, dialect="sqlite")
    report = copy_tables(spark, [TableCopy(t, rows) for t, rows in d.tables_of(spark, sf).items()], spec)
    spark.sql(f"DROP DATABASE `{spec.database}` CASCADE")  # the report is rows of its own
    return report.select("table_no", "table_name", "status", "n_rows")


_SUM = "CAST(sum(o_orderkey) AS BIGINT) AS key_sum"


@query(
    "copy_policies",
    f"""WITH t AS ({d.ORDERS_TGT_SQL}), o AS (SELECT count(*) AS n, {_SUM} FROM orders), c AS (SELECT count(*) AS n, {_SUM} FROM t)
    SELECT 'drop' AS policy, 'success' AS status, c.n AS written, c.n AS n_rows, c.key_sum, 0 AS snapshots FROM c
    UNION ALL SELECT 'append', 'success', c.n, o.n + c.n, o.key_sum + c.key_sum, 0 FROM o, c
    UNION ALL SELECT 'error', 'failed', 0, o.n, o.key_sum, 0 FROM o
    UNION ALL SELECT 'backup', 'success', c.n, c.n, c.key_sum, 1 FROM c
    UNION ALL SELECT 'backup, failing', 'rolled_back', 0, o.n, o.key_sum, 0 FROM o
    UNION ALL SELECT 'append, failing', 'failed', 0, o.n, o.key_sum, 0 FROM o""",
)
def copy_policies(spark, sf):
    """What each write policy leaves in a table that was there already, also where the copy fails half way."""
    orders, copy = read_table(spark, sf, "orders"), d.orders_tgt(spark, sf)
    failing = copy.withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 500 = 499 THEN raise_error('unreadable') ELSE o_custkey END").cast("bigint"))
    found = []
    for name, rows in [("drop", copy), ("append", copy), ("error", copy), ("backup", copy), ("backup, failing", failing), ("append, failing", failing)]:
        db = _database(spark)
        sinks.write_table(orders, db, "orders")
        report = copy_tables(spark, [TableCopy("orders", rows)], CopySpec(db, policy=name.split(",")[0], run_ts=RUN_TS)).first()
        left = spark.table(f"`{db}`.`orders`").agg(F.count(F.lit(1)), F.sum("o_orderkey")).first()
        snapshots = naming.list_snapshots(sinks.catalog_tables(spark, db)).count()
        found.append((name, report["status"], report["n_rows"], *left, snapshots))
        spark.sql(f"DROP DATABASE `{db}` CASCADE")
    return spark.createDataFrame(found, "policy string, status string, written bigint, n_rows bigint, key_sum bigint, snapshots int")


COPY_FORMS = ("sqlite", "mongodb", "access")
COPY_KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": None}


@query(
    "copy_then_reconcile",
    " UNION ALL ".join(f"SELECT '{form}' AS dialect, '{t}' AS table_name, 'match' AS status, count(*) AS compared_rows FROM {t}" for form in COPY_FORMS for t in COPY_KEYS),
)
def copy_then_reconcile(spark, sf):
    """Whole tables copied into several stores' forms, then checked by the reconciliation.

    The forms share nothing and are copied side by side. They are checked one after
    another, so that what is shuffled lies on disk for one form at a time.
    """
    checking = Lock()

    def one(form):
        spec = CopySpec(_database(spark), run_ts=RUN_TS, dialect=form)
        sources = {t: read_table(spark, sf, t) for t in COPY_KEYS}
        copy_tables(spark, [TableCopy(t, rows) for t, rows in sources.items()], spec)
        # A table without a key is compared in the form that the copy gives it.
        shown = {t: rows if COPY_KEYS[t] else prepare_rows(rows, (), form) for t, rows in sources.items()}
        checks = {t: (rows, spark.table(f"`{spec.database}`.`{t}`"), COPY_KEYS[t], COPY_KEYS[t] is not None) for t, rows in shown.items()}
        with checking:
            found = validate_tables(spark, checks).select(F.lit(form).alias("dialect"), "table_name", "status", "compared_rows")
            spark.sql(f"DROP DATABASE `{spec.database}` CASCADE")  # the verdicts are rows of their own
        return found

    with shuffles_removed(spark), ThreadPoolExecutor(len(COPY_FORMS)) as pool:
        jobs = [pool.submit(inheritable_thread_target(one), form) for form in COPY_FORMS]
    return reduce(DataFrame.unionByName, [job.result() for job in jobs])


@query("copy_faults", "SELECT o_orderkey, 'o_totalprice' AS column_name FROM orders WHERE o_orderkey % 97 = 3 UNION ALL SELECT o_orderkey, 'o_orderdate' FROM orders WHERE o_orderkey % 83 = 11")
def copy_faults(spark, sf):
    """A copy with damaged fields: the check finds exactly those."""
    spec = CopySpec(_database(spark), run_ts=RUN_TS, dialect="sqlite")
    orders = read_table(spark, sf, "orders")
    copy_tables(spark, [TableCopy("orders", orders)], spec)
    damaged = spark.table(f"`{spec.database}`.`orders`").withColumns(
        {
            "o_totalprice": F.expr("CASE WHEN o_orderkey % 97 = 3 THEN o_totalprice + 0.5D ELSE o_totalprice END"),
            "o_orderdate": F.expr("CASE WHEN o_orderkey % 83 = 11 THEN concat(o_orderdate, '1') ELSE o_orderdate END"),
        }
    )
    return field_diffs(pair_rows(orders, damaged, ["o_orderkey"], unique_keys=True)).select("o_orderkey", "column_name")


@query("write_roundtrip", f"SELECT {ORDER_COLS}, CAST(NULL AS VARCHAR) AS note FROM orders")
def write_roundtrip(spark, sf):
    db = _database(spark)
    orders = read_table(spark, sf, "orders")
    wanted = orders.withColumn("note", F.lit(None).cast("string")).schema
    sinks.write_table(orders, db, "orders", columns=wanted)
    return spark.table(f"`{db}`.`orders`")


@query("snapshot_roundtrip", "SELECT '_bak_orders_20260830_153022' AS snapshot_name, 'orders' AS original_name, true AS can_restore, count(*) AS n_rows FROM orders")
def snapshot_roundtrip(spark, sf):
    """Overwrites a target under the backup policy; the old rows are in the snapshot."""
    db = _database(spark)
    sinks.write_table(read_table(spark, sf, "orders"), db, "orders")
    copy_tables(spark, [TableCopy("orders", d.orders_tgt(spark, sf))], CopySpec(db, policy="backup", run_ts=RUN_TS))
    taken = [r["snapshot_name"] for r in naming.list_snapshots(sinks.catalog_tables(spark, db)).collect()]  # one row per table
    return naming.list_snapshots(row_counts({name: spark.table(f"`{db}`.`{name}`") for name in taken}))


@query("restore_roundtrip", f"SELECT {ORDER_COLS} FROM orders")
def restore_roundtrip(spark, sf):
    """Backs up, replaces, restores, and returns the restored rows."""
    db = _database(spark)
    sinks.write_table(read_table(spark, sf, "orders"), db, "orders")
    name = sinks.snapshot_table(spark, db, "orders", RUN_TS)
    sinks.write_table(d.orders_tgt(spark, sf), db, "orders")
    if not sinks.restore_tables(spark, db, [name]).first()["restored"]:
        raise RuntimeError("restore failed")
    return spark.table(f"`{db}`.`orders`")


@query(
    "history_roundtrip",
    f"SELECT run_id, created_at, CASE WHEN error = '' THEN 'success' WHEN tables_success > 0 THEN 'partial' ELSE 'failed' END AS status FROM ({RUNS_SQL}) WHERE run_id <> 14"
    " UNION ALL SELECT 9000000001, TIMESTAMP '2026-08-30 15:30:22', 'success'",
)
def history_roundtrip(spark, sf):
    """Appends all runs and one run of the copy job, deletes one, and returns the history."""
    db = _database(spark)
    runs = d.derive(spark, sf, "orders", d.RUNS)
    status = reports.run_status(F.col("error"), F.col("tables_success")).alias("status")
    sinks.append_run(runs.select("run_id", "created_at", status), db)
    spec = CopySpec(db, run_ts=RUN_TS)
    report = copy_tables(spark, [TableCopy("customer", read_table(spark, sf, "customer"))], spec)
    sinks.append_run(run_row(report, 9_000_000_001, spec).select("run_id", "created_at", "status"), db)
    sinks.delete_run(spark, db, 14)
    return spark.table(f"`{db}`.`run_history`")


@query(
    "run_report",
    f"""SELECT run_id, count(*) AS tables_total, count_if(status = 'success')::BIGINT AS tables_success, count_if(status IN ('failed', 'rolled_back'))::BIGINT AS tables_failed,
    count_if(status = 'cancelled')::BIGINT AS tables_cancelled, count_if(status = 'rolled_back')::BIGINT AS rollback_count,
    CAST(coalesce(sum(n_rows) FILTER (WHERE status = 'success'), 0) AS BIGINT) AS total_rows FROM ({RUN_TABLES_SQL}) GROUP BY run_id""",
)
def run_report(spark, sf):
    return reports.run_report(d.derive(spark, sf, "lineitem", d.RUN_TABLES))


@query("failed_tables", f"SELECT run_id, table_no, table_name, status FROM ({RUN_TABLES_SQL}) WHERE status IN ('failed', 'rolled_back')")
def failed_tables(spark, sf):
    return reports.failed_tables(d.derive(spark, sf, "lineitem", d.RUN_TABLES))


@query(
    "progress",
    f"""SELECT run_id, CAST(count_if(status <> 'running') AS BIGINT) AS tables_done, count(*) AS tables_total,
    round(least((count_if(status <> 'running') + coalesce(sum(CASE WHEN status = 'running' AND total_rows > 0 THEN n_rows / total_rows ELSE 0.0 END), 0)) / count(*) * 100, 100), 6) AS percent
    FROM ({RUN_TABLES_SQL}) GROUP BY run_id""",
)
def progress(spark, sf):
    return reports.progress(d.derive(spark, sf, "lineitem", d.RUN_TABLES))


@query(
    "run_status",
    f"SELECT run_id, CASE WHEN error = '' THEN 'success' WHEN tables_success > 0 THEN 'partial' ELSE 'failed' END AS status FROM ({RUNS_SQL})",
)
def run_status(spark, sf):
    status = reports.run_status(F.col("error"), F.col("tables_success")).alias("status")
    return d.derive(spark, sf, "orders", d.RUNS).select("run_id", status)


@query("latest_runs", f"SELECT * FROM ({RUNS_SQL}) ORDER BY created_at DESC, run_id DESC LIMIT 50")
def latest_runs(spark, sf):
    return reports.latest_runs(d.derive(spark, sf, "orders", d.RUNS), 50)
