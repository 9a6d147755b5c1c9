"""Paging, splits, reconciliation and constraints on small tables with known answers."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlift.operators import constraints as con
from ledgerlift.operators import paging as pg
from ledgerlift.operators import reconcile as rec
from ledgerlift.plans import derived as d
from ledgerlift.sources import tables as src


def test_number_rows_with_one_hot_key(spark):
    # A third of all rows share one key, and some keys are NULL.
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id END AS k", "id")
    got = {r["id"]: r["row_no"] for r in pg.number_rows(df, ["k", "id"], partitions=8).collect()}
    want = sorted(df.collect(), key=lambda r: (r["k"] is not None, r["k"] or 0, r["id"]))
    assert got == {r["id"]: i + 1 for i, r in enumerate(want)}


def test_number_rows_of_text_and_nothing(spark):
    df = spark.createDataFrame([(x,) for x in "zaébcä"], "k string")
    rows = pg.number_rows(df, ["k"], partitions=4).orderBy("row_no").collect()
    assert [r["k"] for r in rows] == sorted("zaébcä")
    assert pg.number_rows(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("n", [1, 3, 7, 20])
def test_splits_cover_every_row_once(spark, n):
    df = spark.range(13).withColumn("k", F.col("id") * 5)
    splits = pg.key_splits(df, "k", n)
    assert splits.agg(F.sum("n_rows")).first()[0] == 13
    clauses = pg.split_predicates(splits, "k")
    hits = df.select(*[F.expr(c).cast("int").alias(f"c{i}") for i, c in enumerate(clauses)])
    assert all(sum(r) == 1 for r in hits.collect())


def test_split_predicates_quote_text(spark):
    df = spark.createDataFrame([("a'b",), ("c",), ("d",)], "k string")
    assert "'a''b'" in pg.split_predicates(pg.key_splits(df, "k", 3), "k")[0]


def test_physical_buckets_hold_every_row_once(spark, sf):
    lines = src.read_table(spark, sf, "lineitem")
    sizes = [r["count"] for r in pg.physical_buckets(lines, 8).groupBy("bucket").count().collect()]
    assert sum(sizes) == lines.count() and len(sizes) == 8 and max(sizes) - min(sizes) <= 1


def test_copies_of_one_row_spread_over_buckets(spark, tmp_path):
    spark.range(1000).select(F.lit(1).alias("x")).coalesce(1).write.parquet(str(tmp_path / "t"))
    same = spark.read.parquet(str(tmp_path / "t"))
    assert pg.physical_buckets(same, 10).groupBy("bucket").count().agg(F.max("count")).first()[0] == 100
    assert pg.hash_buckets(same, 10).select("bucket").distinct().count() == 1


def test_pages_walk_the_whole_table(spark):
    df, last, seen = spark.range(23), None, []
    while page := [r[0] for r in pg.keyset_page(df, "id", last, 10).collect()]:
        seen, last = seen + page, page[-1]
    assert seen == list(range(23))
    assert [r[0] for r in pg.offset_page(df, ["id"], 20, 10).collect()] == [20, 21, 22]


def test_pages_by_several_columns(spark):
    rows = [(None, 1), (None, 1), (1, None), (1, 2), (1, 3), (2, None), (2, 0), (3, 9)]
    df, last, seen = spark.createDataFrame(rows, "a int, b int").distinct(), None, []
    while page := [tuple(r) for r in pg.keyset_page(df, ["a", "b"], last, 3).collect()]:
        seen, last = seen + page, page[-1]
    assert seen == [(None, 1), (1, None), (1, 2), (1, 3), (2, None), (2, 0), (3, 9)]
    with pytest.raises(ValueError, match="as many values"):
        pg.keyset_page(df, ["a", "b"], (1,), 3)
    keyed = df.filter("a IS NOT NULL")
    assert sorted(pg.incremental_rows(keyed, ["a", "b"], (1, 3)).collect(), key=str) == sorted(keyed.filter("a > 1").collect(), key=str)
    with pytest.raises(Exception, match="key a is NULL"):
        pg.incremental_rows(df, ["a", "b"], (1, 3)).collect()


@pytest.mark.parametrize("seed", range(3))
def test_keys_at_any_rank(spark, seed, monkeypatch):
    """Against a sorted list: repeats, a key that fills a third, NULL and NaN, text, several columns; many rounds."""
    monkeypatch.setattr(pg, "SHORT_RANGES", 20)
    monkeypatch.setattr(pg, "DRAWN_KEYS", 5)
    r = random.Random(seed)
    ints = [None if r.random() < 0.1 else 7 if r.random() < 0.33 else r.randint(-50, 5000) for _ in range(700)]
    rows = [(i, r.choice("abü") + str(r.randint(0, 300)), r.choice([0.5, float("nan"), float(r.randint(0, 400))])) for i in ints]
    df = spark.createDataFrame(rows, "i int, s string, d double").repartition(4)
    for cols in (["i"], ["s"], ["d"], ["i", "s"], ["s", "d"]):
        listed = [tuple(x) for x in df.select(*cols).orderBy(*cols).collect()]
        found = pg.keys_at(df, cols, [-1, 0, 1, 2, 350, 351, 699, 700, 701])
        assert sorted(found) == [1, 2, 350, 351, 699, 700]
        for rank, (key, before) in found.items():
            assert repr(key) == repr(listed[rank - 1]) and before == next(i for i, k in enumerate(listed) if repr(k) == repr(key))


def test_pages_and_tiles_write_and_sort_nothing_whole(spark, sf):
    orders = src.read_table(spark, sf, "orders")
    plan = pg.offset_page(orders, ["o_custkey", "o_orderkey"], 500, 100)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "TakeOrdered" in plan and "GreaterThanOrEqual(o_custkey" in plan
    tiles = pg.key_splits(orders.withColumn("k", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey"))), "k", 3).orderBy("tile").collect()
    assert [t.n_rows for t in tiles] == [500, 500, 500] and tiles[0].lo_key is None and tiles[2].hi_key == 1498


def test_declared_keys_that_repeat(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (2, "x"), (3, "x"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (2, "y"), (4, "x")], "k int, v string")
    out = rec.reconcile(a, b, ["k"], unique_keys=True)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "repeated"), (2, "changed"), (3, "missing"), (4, "extra")]
    assert [r["k"] for r in rec.field_diffs(rec.pair_rows(a, b, ["k"], unique_keys=True), keys=["k"]).collect()] == [2]
    hot = spark.range(100_000).selectExpr("IF(id < 90000, 1, id) AS k", "id AS v")
    assert rec.reconcile(hot, hot, ["k"], unique_keys=True).groupBy("status").count().orderBy("status").collect() == [("repeated", 1), ("same", 10_000)]


def test_last_row_limits_each_task_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, None, "z"), (1, 1, "b"), (None, 5, "n"), (2, None, None)], "k int, o int, v string").repartition(3)
    last = rec.last_per_key(df, ["k"], ["o"])
    assert sorted(map(str, map(tuple, last.collect()))) == sorted(map(str, [(1, 1, "b"), (None, 5, "n"), (2, None, None)]))
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit [k#" in plan and ", Partial" in plan and "SortAggregate" not in plan


def test_failures_of_the_cluster_are_raised(spark, monkeypatch):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    monkeypatch.setattr(rec, "_lies_in_the_data", lambda e: False)
    with pytest.raises(Exception, match="unreadable"):
        rec.validate_tables(spark, {"t": (a.withColumn("v", F.raise_error(F.lit("unreadable"))), a, ["k"], True)})


def test_time_keys_keep_wall_time_in_any_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, id) AS t FROM range(24)")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r[0].hour for r in pg.keyset_page(df, "t", datetime(2026, 1, 1, 20), 2).collect()] == [21, 22]
        assert pg.incremental_rows(df, "t", datetime(2026, 1, 1, 20)).count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_incremental_rejects_null_keys(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "k int")
    with pytest.raises(Exception, match="key k is NULL"):
        pg.incremental_rows(df, "k", 3).collect()
    assert [r[0] for r in pg.incremental_rows(df.filter("k IS NOT NULL"), "k", 3).collect()] == [5]


def test_known_drift_is_found(spark, sf):
    orders, copy = src.read_table(spark, sf, "orders"), d.orders_tgt(spark, sf)
    counts = {r["status"]: r["count"] for r in rec.reconcile(orders, copy, ["o_orderkey"], unique_keys=True).groupBy("status").count().collect()}
    assert counts == {"missing": 15, "extra": 15, "changed": 34, "same": 1451}
    pairs = rec.pair_rows(orders, copy, ["o_orderkey"], unique_keys=True)
    fields = {r["column_name"]: r["n_diffs"] for r in rec.diffs_by_column(rec.field_diffs(pairs)).collect()}
    assert fields == {"o_totalprice": 16, "o_orderpriority": 18}


def test_both_ways_of_pairing_agree(spark, sf):
    orders, copy = src.read_table(spark, sf, "orders"), d.orders_tgt(spark, sf)
    a = rec.reconcile(orders, copy, ["o_orderkey"], unique_keys=True)
    b = rec.reconcile(orders, copy, ["o_orderkey"], order=["o_orderdate"])
    with pytest.raises(ValueError):
        rec.reconcile(orders, copy, ["o_orderkey"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_table_equals_itself(spark, sf):
    lines = src.read_table(spark, sf, "lineitem")
    assert rec.reconcile_keyless(lines, lines).count() == 0
    orders = src.read_table(spark, sf, "orders")
    assert [r[0] for r in rec.reconcile(orders, orders, ["o_orderkey"], unique_keys=True).select("status").distinct().collect()] == ["same"]


def test_rows_that_agree_are_not_shuffled(spark, sf):
    lines = src.read_table(spark, sf, "lineitem")
    facts = rec.table_facts("lineitem", lines, lines, None)
    row = facts.collect()[0]
    assert row["source_rows"] == row["target_rows"] == row["compared_rows"] == lines.count() and row["missing_rows"] == row["extra_rows"] == 0
    final = facts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and "hashpartitioning(_part" in final and "hashpartitioning(l_" not in final


@pytest.mark.parametrize("parts", [2, 4, 1 << 16])
def test_keyless_counts_are_those_of_whole_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(rec, "DIGEST_PARTS", parts)
    kinds = "a string, b string, x double"
    nan = float("nan")
    left = spark.createDataFrame([("a", None, 1.0), ("a", None, 1.0), ("b", "c", 0.0), ("t ", "u", nan), ("", None, None), ("p", "q", 1.0), ("p", "q", 1.0), ("r", "s", 1.0)], kinds)
    right = spark.createDataFrame([("a", None, 1.0), (None, "a", 1.0), ("b", "c", -0.0), ("t", "u", nan), (None, "", None), ("p", "q", 1.0), ("r", "s", 1.0), ("r", "s", 1.0), ("c", "b", 0.0)], kinds)
    fact = rec.table_facts("t", left, right, None).first()
    assert [fact[c] for c in ("source_rows", "target_rows", "compared_rows", "missing_rows", "extra_rows")] == [8, 9, 5, 3, 4]
    deep = [df.withColumn("d", F.array("x")) for df in (left, right)]  # nested values have no digest
    assert [rec.table_facts("t", *deep, None).first()[c] for c in ("compared_rows", "missing_rows", "extra_rows")] == [5, 3, 4]
    many = spark.range(3000).selectExpr("id % 500 AS k", "IF(id % 7 = 0, NULL, id % 3) AS v")
    other = many.withColumn("v", F.expr("IF(k = 77, v + 1, v)"))
    whole = rec._multiset(many, other).selectExpr("sum(least(source_count, target_count)) AS n").first()["n"]
    assert rec.table_facts("t", many, other, None).first()["compared_rows"] == whole < 3000
    assert rec.table_facts("t", many.limit(0), other.limit(0), None).first()["source_rows"] == 0


def test_values_that_meet_in_the_hash_are_told_apart(spark):
    p1, p2, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
    turn = lambda x, n: (x << n | x >> 64 - n) & full
    mixed = lambda w: turn(w * p2 & full, 31) * p1 & full
    unmixed = lambda k: turn(k * pow(p1, -1, 1 << 64) & full, 33) * pow(p2, -1, 1 << 64) & full
    words = [int.from_bytes(t, "little") for t in (b"ledger 1", b"entry 22")]
    other = [unmixed(mixed(words[0]) ^ 1 << 36), unmixed(mixed(words[1]) ^ 1 << 63)]
    a, b = (spark.createDataFrame([(b"".join(w.to_bytes(8, "little") for w in ws),)], "v binary") for ws in (words, other))
    for salt in (1, 2, 3):
        assert a.select(F.xxhash64(F.lit(salt), "v")).first() == b.select(F.xxhash64(F.lit(salt), "v")).first()
    fact = rec.table_facts("t", a, b, None).first()
    assert (fact["compared_rows"], fact["missing_rows"], fact["extra_rows"]) == (0, 1, 1)
    wide = [spark.sql(f"SELECT CAST('{n}' AS DECIMAL(38,0)) AS v, X'0102' AS w") for n in ("12345678901234567890123", "12345678901234567890124")]
    assert [rec.table_facts("t", wide[0], w, None).first()["compared_rows"] for w in wide] == [1, 0]


def test_repeated_keys_do_not_multiply(spark):
    # One key holds most rows on both sides: a plain join would give 900 * 900 pairs.
    src_rows = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 1 ELSE id END AS k", "id AS v")
    tgt_rows = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 1 ELSE id + 5 END AS k", "id AS v", "id AS seq")
    out = rec.reconcile(src_rows, tgt_rows, ["k"], order=["seq"])
    counts = {r["status"]: r["count"] for r in out.groupBy("status").count().collect()}
    assert counts == {"same": 1, "changed": 899 + 95, "missing": 5, "extra": 5}


def test_null_keys_are_counted_apart(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x "), (None, "y")], "k int, v string")
    assert [tuple(r) for r in rec.reconcile(a, b, ["k"], unique_keys=True).collect()] == [(1, "same")]
    for unique in (True, False):
        fact = rec.validate_tables(spark, {"t": (a, b, ["k"], unique, ["v"])}).first()
        assert (fact["source_rows"], fact["target_rows"], fact["null_key_rows"], fact["status"]) == (3, 2, 2, "row_count_mismatch")


def test_keys_of_different_types_meet(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([("1 ", "a"), ("3", "b")], "k string, v string")
    assert sorted(tuple(r) for r in rec.reconcile(a, b, ["k"], order=["v"]).collect()) == [(1, "same"), (2, "missing"), (3, "extra")]


def test_composite_key_uses_all_columns(spark):
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "t int, id int, v string")
    b = spark.createDataFrame([(1, 1, "a"), (1, 2, "c")], "t int, id int, v string")
    assert sorted(r["status"] for r in rec.reconcile(a, b, ["t", "id"], unique_keys=True).collect()) == ["changed", "same"]


def test_sample_has_no_false_extra_at_its_end(spark):
    a = spark.range(100).withColumn("v", F.col("id"))
    out = rec.sample_compare(a, a.filter("id <> 5"), ["id"], 10)
    assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"same": 9, "missing": 1}


def test_verdicts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    changed = a.withColumn("v", F.lit("x"))
    out = rec.validate_tables(spark, {
        "same": (a, a, ["k"], True), "changed": (a, changed, ["k"], True), "short": (a, a.filter("k = 1"), ["k"], True),
        "gone": (a, None, ["k"], True), "keyless": (a, a, None, False), "other rows": (a, changed, None, False),
        "repeats": (a.union(a), a.union(a), ["k"], True), "fails": (a.withColumn("v", F.raise_error(F.lit("unreadable"))), a, ["k"], True), "after": (a, a, ["k"], True),
    })
    assert {r["table_name"]: r["status"] for r in out.collect()} == {
        "same": "match", "changed": "sample_mismatch", "short": "row_count_mismatch", "gone": "missing_target", "keyless": "match", "other rows": "sample_mismatch",
        "repeats": "error", "fails": "error", "after": "match",
    }
    assert rec.validate_report(out).first().asDict() == {"match_count": 3, "mismatch_count": 4, "error_count": 2, "success": False}


def test_orphans_skip_partial_nulls(spark):
    child = spark.createDataFrame([(1, 1), (1, None), (9, 9)], "a int, b int")
    parent = spark.createDataFrame([(1, 1)], "x int, y int")
    assert [tuple(r) for r in con.fk_orphans(child, parent, {"a": "x", "b": "y"}).collect()] == [(9, 9)]


def test_checks_let_unknown_pass(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    assert con.check_violations(df, {"pos": "x > 0"}).first()["failed_rows"] == 1
    assert con.sequence_high_water(df.limit(0), "x").first()[0] == 1


def test_range_limits(spark):
    df = spark.createDataFrame([(127, -1), (128, 5), (-129, 10**15)], "t int, b bigint")
    got = {r["column_name"]: r["bad_rows"] for r in con.range_violations(df, {"t": "TINYINT", "b": "DOUBLE"}).collect()}
    assert got == {"t": 2, "b": 1}


def test_samples_are_not_capped(spark):
    df = spark.range(20_500).withColumnRenamed("id", "k")
    assert pg.sample_rows(df, "k", 20_000).count() == 20_000
    assert sorted(r.k for r in pg.offset_page(df, ["k"], 20_490, 50).collect()) == list(range(20_490, 20_500))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from ledgerlift import session

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    remote = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError):
        session.shared_dir(remote)


def test_jdbc_options():
    assert src.jdbc_options("u", "t")["fetchsize"] == "5000" and src.jdbc_options("u", "t", has_lob=True)["fetchsize"] == "200"
    assert src.partition_options("id", 1, 3, 8) == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "4", "numPartitions": "3"}


def staff(spark):
    rows = [(i, f"emp{i}", i % 3 + 1, None if i % 7 == 0 else i * 10.5, f"2024-01-{i % 28 + 1:02d} 08:00:00") for i in range(1, 51)]
    return spark.createDataFrame(rows, "id int, name string, dept_id int, salary double, hired string")


def test_added_lost_and_tampered_rows_are_told_apart(spark):
    src_rows = staff(spark)
    added = src_rows.unionByName(staff(spark).limit(1).withColumn("id", F.lit(999)))
    tampered = src_rows.withColumn("name", F.when(F.col("id") == 7, "changed").otherwise(F.col("name")))
    as_text = src_rows.select("id", F.rpad("name", 20, " ").alias("name"), "dept_id", F.col("salary").cast("string").alias("salary"), F.col("hired").cast("timestamp_ntz").alias("hired"))
    out = rec.validate_tables(spark, {
        "all": (src_rows, as_text, ["id"], True), "added": (src_rows, added, ["id"], True),
        "tampered": (src_rows, tampered, ["id"], True), "lost": (src_rows, None, ["id"], True),
    })
    facts = {r["table_name"]: r for r in out.collect()}
    assert {n: r["status"] for n, r in facts.items()} == {"all": "match", "added": "row_count_mismatch", "tampered": "sample_mismatch", "lost": "missing_target"}
    assert (facts["added"]["extra_rows"], facts["tampered"]["changed_rows"]) == (1, 1)
    diff = rec.field_diffs(rec.pair_rows(src_rows, tampered, ["id"], unique_keys=True)).collect()
    assert [tuple(r) for r in diff] == [(7, "name", "emp7", "changed")]


def test_only_common_columns_are_compared(spark):
    a = staff(spark)
    assert rec.common_columns(a, a.drop("salary").withColumn("extra", F.lit(1)), ["id"]) == ["name", "dept_id", "hired"]
    statuses = rec.reconcile(a, a.drop("salary").withColumn("extra", F.lit(1)), ["id"], unique_keys=True).select("status").distinct()
    assert [r[0] for r in statuses.collect()] == ["same"]


def test_repeated_keys_are_compared_in_every_column(spark, sf, monkeypatch):
    from oracle import compare, duck

    from ledgerlift.plans.queries_rows import reconcile_repeated_keys

    edits = {
        "l_partkey": "l_partkey + 1", "l_suppkey": "l_suppkey + 1", "l_extendedprice": "l_extendedprice + 1", "l_discount": "l_discount + 0.5",
        "l_tax": "l_tax + 0.5", "l_returnflag": "'X'", "l_linestatus": "'X'", "l_quantity": "l_quantity + 1",
    }
    edits = {c: f"CASE WHEN l_orderkey % 53 = {i} THEN {e} ELSE {c} END" for i, (c, e) in enumerate(edits.items())}
    whole = d.lineitem_tgt
    monkeypatch.setattr(d, "lineitem_tgt", lambda *a: whole(*a).selectExpr(*[f"{edits.get(c, c)} AS {c}" for c in d.LINE_COLS]))
    target = f"SELECT {', '.join(f'{edits.get(c, c)} AS {c}' for c in d.LINE_COLS)} FROM ({d.LINEITEM_TGT_SQL})"
    rest = ["l_shipdate", "l_quantity", *[c for c in d.LINE_COLS if c not in ("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")]]
    texts = ("l_returnflag", "l_linestatus", "l_shipdate")
    same = " AND ".join(f"rtrim(CAST(s.{c} AS VARCHAR)) = rtrim(CAST(t.{c} AS VARCHAR))" if c in texts else f"abs(s.{c} - t.{c}) < 0.000000001" for c in rest)
    sql = f"""WITH t AS (SELECT * FROM ({target}) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in rest)}) = 1),
    j AS (SELECT coalesce(s.l_orderkey, t.l_orderkey) AS l_orderkey, coalesce(s.l_linenumber, t.l_linenumber) AS l_linenumber,
     CASE WHEN t.l_orderkey IS NULL THEN 'missing' WHEN s.l_orderkey IS NULL THEN 'extra' WHEN {same} THEN 'same' ELSE 'changed' END AS status
     FROM lineitem s FULL OUTER JOIN t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
    SELECT l_orderkey, l_linenumber, status, count(*) AS n_rows FROM j GROUP BY ALL"""
    changed = duck(sf).execute(f"SELECT count(*) FROM ({sql}) WHERE status = 'changed' AND l_orderkey % 53 < 7").fetchone()[0]
    assert changed > 100
    assert compare(spark, "reconcile_repeated_keys", reconcile_repeated_keys, sql, sf) is None


def test_repeated_keys_follow_their_sql_through_ties_and_nulls(spark, sf, tmp_path):
    import pathlib

    from oracle import compare, duck

    from ledgerlift.plans.queries_rows import reconcile_repeated_keys
    from ledgerlift.plans import all_queries

    for f in pathlib.Path(sf).glob("*.parquet"):
        if f.stem != "lineitem":
            (tmp_path / f.name).symlink_to(f)
    rows = f"SELECT * FROM read_parquet('{sf}/lineitem.parquet')"
    # Ties: the same key, date and quantity, but another part, price or supplier. Then missing values and keys.
    ties = f"SELECT * REPLACE (l_partkey + 1 AS l_partkey, l_extendedprice + 5 AS l_extendedprice) FROM ({rows}) WHERE l_orderkey % 3 = 0"
    odd = f"SELECT * REPLACE (l_suppkey + 1 AS l_suppkey, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate, CASE WHEN l_orderkey % 7 = 1 THEN NULL ELSE l_quantity END AS l_quantity, CASE WHEN l_orderkey % 7 = 2 THEN NULL ELSE l_orderkey END AS l_orderkey, CASE WHEN l_orderkey % 7 = 3 THEN 'nan'::DOUBLE ELSE l_tax END AS l_tax) FROM ({rows}) WHERE l_orderkey % 5 = 0"
    lone = f"SELECT * REPLACE (l_orderkey + 1000000 AS l_orderkey, NULL AS l_shipdate, NULL AS l_returnflag) FROM ({rows}) WHERE l_orderkey % 11 = 0"
    duck(sf).execute(f"COPY (({rows}) UNION ALL ({ties}) UNION ALL ({odd}) UNION ALL ({lone})) TO '{tmp_path}/lineitem.parquet'")
    assert compare(spark, "reconcile_repeated_keys", reconcile_repeated_keys, all_queries()[1]["reconcile_repeated_keys"], str(tmp_path)) is None


def test_keys_of_a_whole_table_are_not_broadcast(spark, sf):
    from ledgerlift.plans import all_queries

    for name in ("reconcile_extra", "reconcile_missing", "reconcile_repeated_keys"):
        plan = all_queries()[0][name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, name


def test_missing_rows_under_a_declared_key_that_repeats(spark):
    from ledgerlift.operators.reconcile import extra_rows, missing_rows

    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (3, "v"), (None, "n")], "k long, c string")
    b = spark.createDataFrame([(2, "y"), (2, "w"), (4, "u"), (4, "t"), (None, "m")], "k long, c string")
    for unique in (False, True):
        assert sorted(map(tuple, missing_rows(a, b, ["k"], unique).collect())) == [(1, "x"), (3, "v")]
        assert sorted(map(tuple, extra_rows(a, b, ["k"], unique).collect())) == [(4, "t"), (4, "u")]
