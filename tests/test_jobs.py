"""Copying, snapshots, restore, history and the incremental stream."""

import uuid
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlift.operators import reports
from ledgerlift.operators.naming import list_snapshots
from ledgerlift.operators.reconcile import reconcile_keyless
from ledgerlift.plans.copyjob import CopySpec, TableCopy, copy_tables, orphan_counts, record_identities, run_row
from ledgerlift.session import shared_dir
from ledgerlift.sources import sinks
from ledgerlift.streaming.incremental import copy_new_files

TS = datetime(2026, 8, 30, 15, 30, 22)


@pytest.fixture
def db(spark):
    return sinks.ensure_database(spark, f"ll_{uuid.uuid4().hex[:10]}")


def rows_of(spark, db, table):
    return sorted(tuple(r) for r in spark.table(f"{db}.{table}").collect())


def one(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id int")


def broken(spark):
    return spark.range(2000).select(F.when(F.col("id") == 1999, F.raise_error(F.lit("bad row")).cast("int")).otherwise(1).alias("id"))


@pytest.mark.parametrize("n", [0, 1, 500, 1200])
def test_row_counts_of_a_copy(spark, db, n):
    report = copy_tables(spark, [TableCopy("t", spark.range(n))], CopySpec(db, run_ts=TS)).first()
    assert (report["status"], report["n_rows"]) == ("success", n) and spark.table(f"{db}.t").count() == n


def test_values_survive(spark, db):
    schema = "i bigint, d double, m decimal(38,10), s string, b binary, t timestamp_ntz, f boolean"
    data = [
        (2**63 - 1, 0.1, Decimal("1234567890123456789012345678.0123456789"), "emoji 😀 'q' \"d\"\n", bytes([0, 255, 10]) * 700, datetime(2026, 1, 2, 3, 4, 5, 123456), True),
        (-(2**63), -0.0, Decimal("0"), "", b"", datetime(1, 1, 1), False),
        (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, schema)
    copy_tables(spark, [TableCopy("t", df)], CopySpec(db, run_ts=TS))
    assert reconcile_keyless(df, spark.table(f"{db}.t"), trim=False).count() == 0


def test_policies(spark, db):
    sinks.write_table(one(spark, 1), db, "t")
    assert copy_tables(spark, [TableCopy("t", one(spark, 2))], CopySpec(db, run_ts=TS)).first()["status"] == "failed"
    assert rows_of(spark, db, "t") == [(1,)]
    assert copy_tables(spark, [TableCopy("t", one(spark, 2))], CopySpec(db, policy="append", run_ts=TS)).first()["n_rows"] == 1
    assert rows_of(spark, db, "t") == [(1,), (2,)]
    copy_tables(spark, [TableCopy("t", one(spark, 3))], CopySpec(db, policy="drop", run_ts=TS))
    assert rows_of(spark, db, "t") == [(3,)]
    report = copy_tables(spark, [TableCopy("t", one(spark, 4))], CopySpec(db, policy="backup", run_ts=TS)).first()
    assert report["snapshot_name"] == "_bak_t_20260830_153022"
    assert rows_of(spark, db, "t") == [(4,)] and rows_of(spark, db, report["snapshot_name"]) == [(3,)]


def test_failed_copy_brings_the_old_table_back(spark, db):
    sinks.write_table(one(spark, 1, 2), db, "t")
    tables = [TableCopy("t", broken(spark)), TableCopy("u", one(spark, 9)), TableCopy("w", broken(spark))]
    spec = CopySpec(db, policy="backup", run_ts=TS)
    report = copy_tables(spark, tables, spec)
    assert [(r["table_name"], r["status"], r["rolled_back"]) for r in report.collect()] == [("t", "rolled_back", True), ("u", "success", False), ("w", "failed", False)]
    assert rows_of(spark, db, "t") == [(1,), (2,)]
    assert list_snapshots(sinks.catalog_tables(spark, db)).count() == 0
    run = run_row(report, 1, spec, "table t failed").first()
    assert (run["tables_failed"], run["tables_success"], run["total_rows"], run["status"]) == (2, 1, 1, "partial")
    again = copy_tables(spark, [TableCopy("t", one(spark, 5))], spec).first()
    assert again["status"] == "success" and rows_of(spark, db, "t") == [(5,)]


def test_only_snapshots_are_restored_or_dropped(spark, db):
    sinks.write_table(one(spark, 1), db, "orders")
    for bad in ("orders", "_bak_orders", "_bak_orders_2026_15"):
        with pytest.raises(ValueError):
            sinks.restore_table(spark, db, bad)
        with pytest.raises(ValueError):
            sinks.drop_snapshot(spark, db, bad)
    name = sinks.snapshot_table(spark, db, "orders", TS, copy=True)
    assert rows_of(spark, db, "orders") == rows_of(spark, db, name) == [(1,)]
    out = sinks.restore_tables(spark, db, ["_bak_gone_20260830_153022", name]).collect()
    assert [(r["table_name"], r["restored"]) for r in out] == [(None, False), ("orders", True)]
    sinks.drop_snapshot(spark, db, sinks.snapshot_table(spark, db, "orders", TS, copy=True))
    assert list_snapshots(sinks.catalog_tables(spark, db)).count() == 0


def test_missing_columns_become_null(spark, db):
    wanted = spark.createDataFrame([], "id int, note string").schema
    sinks.write_table(one(spark, 1), db, "t", columns=wanted)
    assert rows_of(spark, db, "t") == [(1, None)]


def test_names_identities_and_orphans(spark, db):
    spec = CopySpec(db, run_ts=TS, rules=[(r"^tmp_", "temp")], overrides={"kids": "own"})
    kids = spark.createDataFrame([(1, 1), (2, 7), (3, None)], "id int, parent int")
    tables = [TableCopy("tmp_p", one(spark, 1)), TableCopy("kids", kids, identity="id")]
    report = copy_tables(spark, tables, spec)
    assert [r["target_table"] for r in report.collect()] == ["temp__tmp_p", "own__kids"]
    assert [tuple(r) for r in record_identities(spark, tables, report, spec).collect()] == [("kids", "id", 3)]
    links = [("own__kids", "temp__tmp_p", {"parent": "id"})]
    assert orphan_counts(spark, spec, links).first()["orphan_rows"] == 1


def test_history(spark, db):
    runs = spark.createDataFrame([(1, datetime(2026, 1, 1), "success"), (2, datetime(2026, 1, 2), "failed")], "run_id bigint, created_at timestamp_ntz, status string")
    sinks.append_run(runs, db)
    sinks.append_run(runs.filter("run_id = 2").withColumn("run_id", F.lit(3).cast("bigint")), db)
    sinks.delete_run(spark, db, 2)
    assert [r["run_id"] for r in reports.latest_runs(spark.table(f"{db}.run_history"), 10).collect()] == [3, 1]


def test_new_files_are_copied_once(spark, tmp_path):
    src, target, check = (str(tmp_path / x) for x in ("src", "target", "check"))
    df = spark.createDataFrame([("1987-02-03 04:05:06 -0330 NST",)], "t string")
    for _ in range(2):
        df.write.mode("append").parquet(src)
        copy_new_files(spark, src, df.schema, target, check)
    copy_new_files(spark, src, df.schema, target, check)
    assert [r[0] for r in spark.read.parquet(target).collect()] == ["1987-02-03 04:05:06"] * 2


def test_shared_folder_follows_the_session():
    class Named:
        """A session whose cluster names the shared folder."""

        sparkContext = property(lambda self: self)
        conf = property(lambda self: {"spark.checkpoint.dir": "hdfs://shared/checkpoints"})

    assert shared_dir(Named()) == "hdfs://shared/checkpoints"


def test_shared_folder_is_kept(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_forms_of_a_copy_run_side_by_side(spark, sf, monkeypatch):
    import threading

    from ledgerlift.plans import queries_jobs

    meet, whole = threading.Barrier(len(queries_jobs.COPY_FORMS), timeout=60), queries_jobs.copy_tables

    def copy_together(*args):
        meet.wait()  # breaks unless all forms copy at the same time
        return whole(*args)

    monkeypatch.setattr(queries_jobs, "copy_tables", copy_together)
    rows = queries_jobs.copy_then_reconcile(spark, sf).collect()
    assert len(rows) == 9 and {r["status"] for r in rows} == {"match"}


def test_checks_of_forms_take_turns_and_leave_no_shuffles(spark, sf, monkeypatch):
    import time

    from ledgerlift.plans import queries_jobs

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in (str(p.getName()) for p in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles())) if f.startswith("shuffle_")}
    before, seen, running, whole = shuffles(), [], [], queries_jobs.validate_tables

    def check(*args):
        running.append(1)
        seen.append((len(running), spark.conf.get(name)))
        try:
            return whole(*args)
        finally:
            running.pop()

    monkeypatch.setattr(queries_jobs, "validate_tables", check)
    was = spark.conf.get(name)
    queries_jobs.copy_then_reconcile(spark, sf)
    assert seen == [(1, "true")] * len(queries_jobs.COPY_FORMS) and spark.conf.get(name) == was
    until = time.time() + 20  # files go a moment after their query
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before


def test_the_shortest_zoned_texts_are_cleaned(spark):
    from pyspark.sql import functions as F

    from ledgerlift.functions.timetext import normalize_datetime_text

    texts = {"2024-01-01 00:00:00 +0000": "2024-01-01 00:00:00", "2024-01-01T00:00:00\t+0000": "2024-01-01 00:00:00", "2024-01-01 00:00:00 +0000 Z": "2024-01-01 00:00:00", "2024-01-01 00:00:00 +000": "2024-01-01 00:00:00 +000", "": "", "N": "N"}
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", normalize_datetime_text(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == {**texts, None: None}
