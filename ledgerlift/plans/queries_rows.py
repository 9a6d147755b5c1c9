"""Scans, pages, value clean-up, reconciliation and constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.functions import timetext as tt
from ledgerlift.functions import values as v
from ledgerlift.operators import constraints as con
from ledgerlift.operators import paging as pg
from ledgerlift.operators import reconcile as rec
from ledgerlift.operators.rows import coerce_for_sink, drop_generated, normalize_all_text
from ledgerlift.plans import derived as d
from ledgerlift.plans.registry import query
from ledgerlift.sources.tables import read_table

ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
DATES_SQL = d.sql_of("orders", d.DATE_TEXT)
LOOSE_SQL = d.sql_of("orders", d.LOOSE_TEXT)


# ---- reading ---------------------------------------------------------------------
@query("scan_table", f"SELECT {ORDER_COLS} FROM orders")
def scan_table(spark, sf):
    return read_table(spark, sf, "orders")


@query(
    "key_splits",
    "SELECT tile, min(k) AS lo_key, max(k) AS hi_key, count(*) AS n_rows FROM"
    " (SELECT o_orderkey AS k, CAST(ntile(8) OVER (ORDER BY o_orderkey) AS INT) AS tile FROM orders) GROUP BY tile",
)
def key_splits(spark, sf):
    return pg.key_splits(read_table(spark, sf, "orders"), "o_orderkey", 8)


@query("keyset_page", f"SELECT {ORDER_COLS} FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, sf):
    return pg.keyset_page(read_table(spark, sf, "orders"), "o_orderkey", 500, 100)


_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("keyset_page_composite", f"SELECT {', '.join(d.LINE_COLS)} FROM lineitem WHERE (l_orderkey, l_linenumber, l_partkey, l_suppkey) > (500, 2, 100, 5) ORDER BY {', '.join(_LINE_KEY)} LIMIT 100")
def keyset_page_composite(spark, sf):
    return pg.keyset_page(read_table(spark, sf, "lineitem").select(*d.LINE_COLS), _LINE_KEY, (500, 2, 100, 5), 100)


@query(
    "incremental_points",
    f"""WITH p AS ({d.sql_of('events', d.WIDE_POINTS)}) SELECT * FROM p
    WHERE tag_user > 'u5' OR tag_user = 'u5' AND time > (SELECT max(ts) FROM events WHERE event_id <= 1000)""",
)
def incremental_points(spark, sf):
    """Points after (tag, time): times that are NULL come first within their tag."""
    last = read_table(spark, sf, "events").filter("event_id <= 1000").agg(F.max("ts")).first()[0]
    return pg.incremental_rows(d.derive(spark, sf, "events", d.WIDE_POINTS), ["tag_user", "time"], ("u5", last))


@query("offset_page", f"SELECT {ORDER_COLS} FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100 OFFSET 500")
def offset_page(spark, sf):
    return pg.offset_page(read_table(spark, sf, "orders"), ["o_custkey", "o_orderkey"], 500, 100)


@query(
    "keyless_buckets",
    "SELECT CAST(8 AS BIGINT) AS n_buckets, count(*) AS n_rows, CAST(ceil(count(*) / 8.0) AS BIGINT) AS fullest_bucket FROM lineitem",
)
def keyless_buckets(spark, sf):
    sizes = pg.physical_buckets(read_table(spark, sf, "lineitem"), 8).groupBy("bucket").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_buckets"), F.sum("n").alias("n_rows"), F.max("n").alias("fullest_bucket")
    )


@query(
    "incremental_rows",
    f"WITH orders_tgt AS ({d.ORDERS_TGT_SQL}) SELECT * FROM orders_tgt WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders)",
)
def incremental_rows(spark, sf):
    last = con.sequence_high_water(read_table(spark, sf, "orders"), "o_orderkey").first()[0]
    return pg.incremental_rows(d.orders_tgt(spark, sf), "o_orderkey", last)


@query(
    "number_rows",
    f"SELECT row_number() OVER (ORDER BY {', '.join(d.LINE_COLS)}) AS row_no, l_orderkey, l_linenumber, l_partkey FROM lineitem",
)
def number_rows(spark, sf):
    numbered = pg.number_rows(read_table(spark, sf, "lineitem"), d.LINE_COLS)
    return numbered.select(F.col("row_no").cast("long").alias("row_no"), "l_orderkey", "l_linenumber", "l_partkey")


@query("sequence_high_water", "SELECT CAST(coalesce(max(o_orderkey), 1) AS BIGINT) AS high_water FROM orders")
def sequence_high_water(spark, sf):
    return con.sequence_high_water(read_table(spark, sf, "orders"), "o_orderkey")


# ---- clean-up of values -------------------------------------------------------------
_ZONE = r"'^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+[+-]\d{2}:?\d{2}$'"
_NAMED = r"'^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?) [+-]\d{4} [A-Z]+(?: m=[+-][\d.]+)?$'"
_PLAIN = r"'^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?$'"
_LOOSE = (
    r"'^(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,9}))?(?:[+-]\d{2}:?\d{2}|Z| .+)?$'"
)


def _norm_sql(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, {_ZONE}) THEN replace(regexp_extract({c}, {_ZONE}, 1), 'T', ' ')"
        f" WHEN regexp_matches({c}, {_NAMED}) THEN regexp_extract({c}, {_NAMED}, 1) ELSE {c} END"
    )


@query("norm_datetime_text", f"SELECT o_orderkey, {_norm_sql('dt_text')} AS dt_text, {_norm_sql('note')} AS note FROM ({DATES_SQL})")
def norm_datetime_text(spark, sf):
    return normalize_all_text(d.derive(spark, sf, "orders", d.DATE_TEXT))


def _ts_sql(fraction: bool) -> str:
    base = " || ".join(
        [f"regexp_extract(trim(dt_text), {_LOOSE}, 1)"]
        + [f"'{s}' || regexp_extract(trim(dt_text), {_LOOSE}, {i})" for s, i in zip("-- ::", range(2, 7))]
    )
    tail = f" || '.' || rpad(left(regexp_extract(trim(dt_text), {_LOOSE}, 7), 6), 6, '0')" if fraction else ""
    zero = " 00:00:00.000000" if fraction else " 00:00:00"
    return (
        rf"CASE WHEN regexp_matches(trim(dt_text), '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN trim(dt_text) || '{zero}'"
        f" WHEN regexp_matches(trim(dt_text), {_LOOSE}) THEN {base}{tail} ELSE trim(dt_text) END"
    )


@query("norm_timestamp_text", f"SELECT o_orderkey, {_ts_sql(True)} AS as_timestamp, {_ts_sql(False)} AS as_date FROM ({DATES_SQL})")
def norm_timestamp_text(spark, sf):
    c = F.col("dt_text")
    return d.derive(spark, sf, "orders", d.DATE_TEXT).select(
        "o_orderkey",
        tt.normalize_timestamp_text(c, True).alias("as_timestamp"),
        tt.normalize_timestamp_text(c, False).alias("as_date"),
    )


@query(
    "norm_compare_time",
    r"""WITH s AS (SELECT o_orderkey, replace(regexp_replace(trim(dt_text), '( \+0000 UTC| UTC|Z| \+08:00)$', ''), 'T', ' ') AS s
    FROM (""" + DATES_SQL + r"""))
    SELECT o_orderkey, trim(CASE WHEN length(s) > 10 THEN left(s, 10) || regexp_replace(substr(s, 11), '[+-].*$', '') ELSE s END) AS compare_text FROM s""",
)
def norm_compare_time(spark, sf):
    return d.derive(spark, sf, "orders", d.DATE_TEXT).select(
        "o_orderkey", tt.normalize_compare_time(F.col("dt_text")).alias("compare_text")
    )


@query("format_timestamp", "SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '') AS ts_text FROM events")
def format_timestamp(spark, sf):
    return read_table(spark, sf, "events").select("event_id", tt.format_timestamp(F.col("ts")).alias("ts_text"))


@query(
    "looks_like_datetime",
    f"SELECT o_orderkey, regexp_matches(dt_text, {_PLAIN}) OR regexp_matches(dt_text, {_NAMED}) OR regexp_matches(dt_text, {_ZONE}) AS is_datetime FROM ({DATES_SQL})",
)
def looks_like_datetime(spark, sf):
    return d.derive(spark, sf, "orders", d.DATE_TEXT).select(
        "o_orderkey", tt.looks_like_datetime(F.col("dt_text")).alias("is_datetime")
    )


@query("trim_padding", f"SELECT o_orderkey, rtrim(note, ' ') AS note FROM ({DATES_SQL})")
def trim_padding(spark, sf):
    return d.derive(spark, sf, "orders", d.DATE_TEXT).select("o_orderkey", v.trim_padding(F.col("note")).alias("note"))


@query(
    "normalize_key",
    f"SELECT o_orderkey AS int_key, rtrim(note, ' ') AS text_key, CAST(o_orderkey AS DOUBLE) AS float_key FROM ({DATES_SQL})",
)
def normalize_key(spark, sf):
    df = d.derive(spark, sf, "orders", d.DATE_TEXT).withColumn("f", F.col("o_orderkey").cast("double"))
    kind = {c: df.schema[c].dataType for c in df.columns}
    return df.select(
        v.normalize_key(F.col("o_orderkey"), kind["o_orderkey"]).alias("int_key"),
        v.normalize_key(F.col("note"), kind["note"]).alias("text_key"),
        v.normalize_key(F.col("f"), kind["f"], kind["o_orderkey"]).alias("float_key"),
    )


@query(
    "zero_date_rows",
    f"SELECT o_orderkey, date_raw FROM ({LOOSE_SQL}) WHERE regexp_matches(regexp_replace(date_raw, '[^0-9]', '', 'g'), '^0+$')",
)
def zero_date_rows(spark, sf):
    return d.derive(spark, sf, "orders", d.LOOSE_TEXT).filter(tt.is_zero_date(F.col("date_raw"))).select("o_orderkey", "date_raw")


@query(
    "preview_value",
    "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 47) || '...' ELSE text END AS text_preview,"
    " '<binary ' || CAST(octet_length(encode(text)) AS VARCHAR) || ' bytes>' AS blob_preview,"
    " coalesce(lang, 'NULL') AS lang_preview FROM documents",
)
def preview_value(spark, sf):
    docs = read_table(spark, sf, "documents").withColumn("blob", F.col("text").cast("binary"))
    shown = {"text_preview": "text", "blob_preview": "blob", "lang_preview": "lang"}
    return docs.select("doc_id", *[v.preview_value(F.col(c), docs.schema[c].dataType).alias(n) for n, c in shown.items()])


@query(
    "hex_roundtrip",
    "SELECT doc_id, 'hex:' || lower(hex(encode(text))) AS encoded, true AS restored FROM documents",
)
def hex_roundtrip(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("blob"))
    coded = docs.withColumn("encoded", v.encode_binary(F.col("blob")))
    return coded.select("doc_id", "encoded", v.decode_binary(F.col("encoded")).eqNullSafe(F.col("blob")).alias("restored"))


@query(
    "coerce_text",
    rf"""SELECT o_orderkey, raw,
    CASE WHEN regexp_matches(raw, '^[+-]?\d+(\.\d+)?$') THEN CAST(raw AS DOUBLE) END AS as_double,
    CASE WHEN regexp_matches(raw, '^[+-]?\d+$') THEN CAST(raw AS BIGINT) END AS as_long,
    CASE WHEN raw IN ('true', '1') THEN true WHEN raw IN ('false', '0') THEN false END AS as_boolean
    FROM ({LOOSE_SQL})""",
)
def coerce_text(spark, sf):
    rows = d.derive(spark, sf, "orders", d.LOOSE_TEXT).select(
        "o_orderkey", "raw", *[F.col("raw").alias(n) for n in ("as_double", "as_long", "as_boolean")]
    )
    good, _ = coerce_for_sink(rows, {"as_double": "double", "as_long": "bigint", "as_boolean": "boolean"})
    return good


@query(
    "coerce_rejects",
    rf"""SELECT o_orderkey, 'amount' AS column_name, raw AS raw_value FROM ({LOOSE_SQL})
    WHERE raw IS NOT NULL AND NOT regexp_matches(raw, '^[+-]?\d+(\.\d+)?$')""",
)
def coerce_rejects(spark, sf):
    rows = d.derive(spark, sf, "orders", d.LOOSE_TEXT).select("o_orderkey", F.col("raw").alias("amount"))
    _, rejects = coerce_for_sink(rows, {"amount": "double"})
    return rejects.select("o_orderkey", "column_name", "raw_value")


@query("drop_generated", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_generated_query(spark, sf):
    orders = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.round(F.col("o_totalprice") * 1.1, 2).alias("with_tax")
    )
    return drop_generated(orders, {"with_tax"})


# ---- reconciliation --------------------------------------------------------------------
_PAIRS = f"""WITH t AS ({d.ORDERS_TGT_SQL}), p AS (
  SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, s.o_orderkey IS NOT NULL AS in_src, t.o_orderkey IS NOT NULL AS in_tgt,
   s.o_custkey IS DISTINCT FROM t.o_custkey AS d1, rtrim(s.o_orderstatus, ' ') IS DISTINCT FROM rtrim(t.o_orderstatus, ' ') AS d2,
   NOT coalesce(abs(s.o_totalprice - t.o_totalprice) < 0.000000001, s.o_totalprice IS NULL AND t.o_totalprice IS NULL) AS d3,
   s.o_orderdate IS DISTINCT FROM t.o_orderdate AS d4, rtrim(s.o_orderpriority, ' ') IS DISTINCT FROM rtrim(t.o_orderpriority, ' ') AS d5,
   s.o_totalprice AS sp, t.o_totalprice AS tp, s.o_orderpriority AS spr, t.o_orderpriority AS tpr
  FROM orders s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey),
 st AS (SELECT *, CASE WHEN NOT in_tgt THEN 'missing' WHEN NOT in_src THEN 'extra' WHEN d1 OR d2 OR d3 OR d4 OR d5 THEN 'changed' ELSE 'same' END AS status FROM p)"""
KEY = ["o_orderkey"]


def _orders_pairs(spark, sf, unique=True):
    return rec.pair_rows(read_table(spark, sf, "orders"), d.orders_tgt(spark, sf), KEY, unique_keys=unique)


@query("reconcile_full", f"{_PAIRS} SELECT o_orderkey, status FROM st")
def reconcile_full(spark, sf):
    return rec.reconcile(read_table(spark, sf, "orders"), d.orders_tgt(spark, sf), KEY, unique_keys=True)


@query("reconcile_summary", f"{_PAIRS} SELECT status, count(*) AS n_rows FROM st GROUP BY status")
def reconcile_summary(spark, sf):
    return reconcile_full(spark, sf).groupBy("status").agg(F.count("*").alias("n_rows"))


@query("reconcile_changed", f"{_PAIRS} SELECT o_orderkey, sp AS source_price, tp AS target_price FROM st WHERE status = 'changed'")
def reconcile_changed(spark, sf):
    pairs = _orders_pairs(spark, sf)
    changed = pairs.filter(F.col("in_src") & F.col("in_tgt")).filter(rec.row_status(pairs) == "changed")
    return changed.select("o_orderkey", F.col("s_o_totalprice").alias("source_price"), F.col("t_o_totalprice").alias("target_price"))


@query("reconcile_missing", f"WITH t AS ({d.ORDERS_TGT_SQL}) SELECT {ORDER_COLS} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)")
def reconcile_missing(spark, sf):
    return rec.missing_rows(read_table(spark, sf, "orders"), d.orders_tgt(spark, sf), KEY, unique_keys=True)


@query("reconcile_extra", f"WITH t AS ({d.ORDERS_TGT_SQL}) SELECT {ORDER_COLS} FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def reconcile_extra(spark, sf):
    return rec.extra_rows(read_table(spark, sf, "orders"), d.orders_tgt(spark, sf), KEY, unique_keys=True)


@query(
    "field_diffs",
    f"""{_PAIRS} SELECT o_orderkey, 'o_totalprice' AS column_name, CAST(CAST(sp AS DECIMAL(18,2)) AS VARCHAR) AS source_value,
    CAST(CAST(tp AS DECIMAL(18,2)) AS VARCHAR) AS target_value FROM st WHERE in_src AND in_tgt AND d3
    UNION ALL SELECT o_orderkey, 'o_orderpriority', coalesce(spr, 'NULL'), coalesce(tpr, 'NULL') FROM st WHERE in_src AND in_tgt AND d5
    UNION ALL SELECT o_orderkey, 'o_orderstatus', 'x', 'x' FROM st WHERE in_src AND in_tgt AND d2""",
)
def field_diffs(spark, sf):
    def money(df):
        return df.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))

    pairs = rec.pair_rows(money(read_table(spark, sf, "orders")), money(d.orders_tgt(spark, sf)), KEY, unique_keys=True)
    return rec.field_diffs(pairs)


@query(
    "diffs_by_column",
    f"""{_PAIRS}, f AS (SELECT unnest([CASE WHEN d1 THEN 'o_custkey' END, CASE WHEN d2 THEN 'o_orderstatus' END, CASE WHEN d3 THEN 'o_totalprice' END,
    CASE WHEN d4 THEN 'o_orderdate' END, CASE WHEN d5 THEN 'o_orderpriority' END]) AS column_name FROM st WHERE in_src AND in_tgt)
    SELECT column_name, count(*) AS n_diffs FROM f WHERE column_name IS NOT NULL GROUP BY column_name""",
)
def diffs_by_column(spark, sf):
    return rec.diffs_by_column(rec.field_diffs(_orders_pairs(spark, sf)))


_LINE_GROUP = ", ".join(c if c != "l_linestatus" else "rtrim(l_linestatus, ' ') AS l_linestatus" for c in d.LINE_COLS)
_LINE_KEYS = ", ".join(d.LINE_COLS)


@query(
    "reconcile_keyless",
    f"""WITH t AS ({d.LINEITEM_TGT_SQL}), u AS (SELECT {_LINE_GROUP}, 1 AS l, 0 AS r FROM lineitem UNION ALL SELECT {_LINE_GROUP}, 0, 1 FROM t)
    SELECT {_LINE_KEYS}, CAST(sum(l) AS BIGINT) AS source_count, CAST(sum(r) AS BIGINT) AS target_count FROM u GROUP BY {_LINE_KEYS} HAVING sum(l) <> sum(r)""",
)
def reconcile_keyless(spark, sf):
    return rec.reconcile_keyless(read_table(spark, sf, "lineitem"), d.lineitem_tgt(spark, sf))


_LATER = ["l_shipdate", "l_quantity"]
_LATEST = ", ".join(f"{c} DESC NULLS LAST" for c in _LATER + [c for c in d.LINE_COLS if c not in ("l_orderkey", "l_linenumber", *_LATER)])
_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LINE_SAME = " AND ".join(
    f"(s.{c} IS NOT DISTINCT FROM t.{c} OR coalesce(abs(s.{c} - t.{c}) < 0.000000001, false))" if c in _NUMBERS
    else f"rtrim(s.{c}, ' ') IS NOT DISTINCT FROM rtrim(t.{c}, ' ')" if c in ("l_returnflag", "l_linestatus")
    else f"s.{c} IS NOT DISTINCT FROM t.{c}"
    for c in d.LINE_COLS if c not in ("l_orderkey", "l_linenumber")
)


@query(
    "reconcile_repeated_keys",
    f"""WITH s AS (SELECT * FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL),
    t AS (SELECT * FROM ({d.LINEITEM_TGT_SQL}) WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
     QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LATEST}) = 1),
    j AS (SELECT coalesce(s.l_orderkey, t.l_orderkey) AS l_orderkey, coalesce(s.l_linenumber, t.l_linenumber) AS l_linenumber,
     CASE WHEN t.l_orderkey IS NULL THEN 'missing' WHEN s.l_orderkey IS NULL THEN 'extra' WHEN {_LINE_SAME} THEN 'same' ELSE 'changed' END AS status
     FROM s FULL OUTER JOIN t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
    SELECT l_orderkey, l_linenumber, status, count(*) AS n_rows FROM j GROUP BY ALL""",
)
def reconcile_repeated_keys(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    # Ties of the order fall to the other columns, so the last target row is one in all that is compared.
    status = rec.reconcile(read_table(spark, sf, "lineitem"), d.lineitem_tgt(spark, sf), keys, order=_LATER)
    return status.groupBy(*keys, "status").agg(F.count("*").alias("n_rows"))


@query(
    "last_per_key",
    "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber"
    " ORDER BY l_shipdate DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1",
)
def last_per_key(spark, sf):
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return rec.last_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"])


_TWICE = "o_orderkey % 61 = 4"  # keys that stand twice in the source, thrice in the target


@query(
    "reconcile_declared_repeats",
    f"""WITH rs AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE {_TWICE}),
    rt AS (SELECT * FROM ({d.ORDERS_TGT_SQL}) UNION ALL SELECT * FROM ({d.ORDERS_TGT_SQL}) WHERE {_TWICE} UNION ALL SELECT * FROM ({d.ORDERS_TGT_SQL}) WHERE o_orderkey % 61 IN (4, 5)),
    {_PAIRS.removeprefix("WITH ")}, n AS (SELECT o_orderkey, count(*) AS n FROM rs GROUP BY ALL), m AS (SELECT o_orderkey, count(*) AS n FROM rt GROUP BY ALL)
    SELECT o_orderkey, CASE WHEN n.n > 1 OR m.n > 1 THEN 'repeated' ELSE status END AS status FROM st LEFT JOIN n USING (o_orderkey) LEFT JOIN m USING (o_orderkey)""",
)
def reconcile_declared_repeats(spark, sf):
    """A declared key that repeats on either side or both is one row, named as such."""
    source, target = read_table(spark, sf, "orders"), d.orders_tgt(spark, sf)
    s = source.unionByName(source.filter(_TWICE))
    t = target.unionByName(target.filter(_TWICE)).unionByName(target.filter("o_orderkey % 61 IN (4, 5)"))
    return rec.reconcile(s, t, KEY, unique_keys=True)


@query(
    "sample_compare",
    f"""{_PAIRS}, h AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000)
    SELECT o_orderkey, status FROM st WHERE o_orderkey <= (SELECT max(o_orderkey) FROM h)""",
)
def sample_compare(spark, sf):
    return rec.sample_compare(read_table(spark, sf, "orders"), d.orders_tgt(spark, sf), KEY, 1000)


_COUNTED = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _COUNTED))
def row_counts(spark, sf):
    return rec.row_counts({t: read_table(spark, sf, t) for t in _COUNTED})


@query(
    "compare_counts",
    f"""WITH s AS (SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part),
    t AS (SELECT 'orders' AS table_name, count(*) AS n FROM ({d.ORDERS_TGT_SQL}) UNION ALL SELECT 'lineitem', count(*) FROM ({d.LINEITEM_TGT_SQL}) UNION ALL SELECT 'events', count(*) FROM events)
    SELECT coalesce(s.table_name, t.table_name) AS table_name, s.n AS source_rows, t.n AS target_rows, s.n IS NOT DISTINCT FROM t.n AS counts_match
    FROM s FULL OUTER JOIN t ON s.table_name = t.table_name""",
)
def compare_counts(spark, sf):
    src = rec.row_counts({t: read_table(spark, sf, t) for t in ("orders", "lineitem", "part")})
    tgt = rec.row_counts(
        {"orders": d.orders_tgt(spark, sf), "lineitem": d.lineitem_tgt(spark, sf), "events": read_table(spark, sf, "events")}
    )
    return rec.compare_counts(src, tgt)


def verdicts(spark, sf):
    orphans = d.derive(spark, sf, "customer", d.ORPHANS)
    return rec.validate_tables(
        spark,
        {
            "orders": (read_table(spark, sf, "orders"), d.orders_tgt(spark, sf), KEY, True),
            "customer": (read_table(spark, sf, "customer"), orphans, ["c_custkey"], True),
            "part": (read_table(spark, sf, "part"), read_table(spark, sf, "part"), ["p_partkey"], True),
            "lineitem": (read_table(spark, sf, "lineitem"), d.lineitem_tgt(spark, sf), None, False),
            "events": (read_table(spark, sf, "events"), None, ["event_id"], True),
            "failing": (read_table(spark, sf, "part").withColumn("p_size", F.col("p_name").cast("int")), read_table(spark, sf, "part"), ["p_partkey"], True),
            "repeating": (read_table(spark, sf, "lineitem"), read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], True),
        },
    )


_STATUS_SQL = f"""{_PAIRS}, o AS (SELECT count_if(in_src) AS sr, count_if(in_tgt) AS tr, count_if(in_src AND in_tgt) AS cr, count_if(status = 'missing') AS mr,
  count_if(status = 'extra') AS er, count_if(status = 'changed') AS ch FROM st),
 v AS (SELECT 0 AS table_no, 'orders' AS table_name, true AS target_exists, sr AS source_rows, tr AS target_rows, cr AS compared_rows, mr AS missing_rows, er AS extra_rows, ch AS changed_rows FROM o
 UNION ALL SELECT 1, 'customer', true, count(*), count(*), count(*), 0, 0, count_if(c_custkey % 50 IN (0, 1)) FROM customer
 UNION ALL SELECT 2, 'part', true, count(*), count(*), count(*), 0, 0, 0 FROM part
 UNION ALL SELECT 3, 'lineitem', true, sum(a), sum(b), sum(least(a, b)), sum(greatest(a - b, 0)), sum(greatest(b - a, 0)), 0 FROM (SELECT sum(l) AS a, sum(r) AS b FROM (
   SELECT {_LINE_GROUP}, 1 AS l, 0 AS r FROM lineitem UNION ALL SELECT {_LINE_GROUP}, 0, 1 FROM ({d.LINEITEM_TGT_SQL})) GROUP BY {_LINE_KEYS})
 UNION ALL SELECT 4, 'events', false, count(*), 0, 0, 0, 0, 0 FROM events UNION ALL SELECT 5, 'failing', true, 0, 0, 0, 0, 0, 0 UNION ALL SELECT 6, 'repeating', true, 0, 0, 0, 0, 0, 0),
 w AS (SELECT table_no, table_name, target_exists, CAST(source_rows AS BIGINT) AS source_rows, CAST(target_rows AS BIGINT) AS target_rows, CAST(compared_rows AS BIGINT) AS compared_rows,
  CAST(missing_rows AS BIGINT) AS missing_rows, CAST(extra_rows AS BIGINT) AS extra_rows, CAST(changed_rows AS BIGINT) AS changed_rows, CAST(0 AS BIGINT) AS null_key_rows, table_no > 4 AS failed,
  CASE WHEN table_no > 4 THEN 'error' WHEN NOT target_exists THEN 'missing_target' WHEN source_rows <> target_rows THEN 'row_count_mismatch' WHEN missing_rows + extra_rows + changed_rows > 0 THEN 'sample_mismatch' ELSE 'match' END AS status FROM v)"""


@query("table_status", f"{_STATUS_SQL} SELECT * FROM w")
def table_status(spark, sf):
    return verdicts(spark, sf).withColumn("error", F.col("error").isNotNull()).withColumnRenamed("error", "failed")


@query(
    "validate_report",
    f"{_STATUS_SQL} SELECT count_if(status = 'match')::BIGINT AS match_count, count_if(status NOT IN ('match', 'error'))::BIGINT AS mismatch_count,"
    " count_if(status = 'error')::BIGINT AS error_count, bool_and(status = 'match') AS success FROM w",
)
def validate_report(spark, sf):
    return rec.validate_report(verdicts(spark, sf))


# ---- constraints ------------------------------------------------------------------------
@query(
    "fk_orphans",
    f"SELECT * FROM ({d.sql_of('customer', d.ORPHANS)}) c WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT n_nationkey FROM nation)",
)
def fk_orphans(spark, sf):
    child = d.derive(spark, sf, "customer", d.ORPHANS)
    return con.fk_orphans(child, read_table(spark, sf, "nation"), {"c_nationkey": "n_nationkey"})


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf):
    return con.unique_violations(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "null_violations",
    f"WITH t AS ({d.ORDERS_TGT_SQL}) SELECT 'o_orderpriority' AS column_name, count(*) - count(o_orderpriority) AS null_rows FROM t"
    " UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus) FROM t UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey) FROM t",
)
def null_violations(spark, sf):
    return con.null_violations(d.orders_tgt(spark, sf), ["o_orderpriority", "o_orderstatus", "o_custkey"])


@query(
    "check_violations",
    "SELECT 'price_band' AS check_name, count_if(NOT (p_retailprice BETWEEN 900 AND 1000))::BIGINT AS failed_rows FROM part"
    " UNION ALL SELECT 'brand', count_if(NOT (p_brand <> 'Brand#2'))::BIGINT FROM part UNION ALL SELECT 'size', count_if(NOT (p_size > 0))::BIGINT FROM part",
)
def check_violations(spark, sf):
    checks = {"price_band": "p_retailprice BETWEEN 900 AND 1000", "brand": "p_brand <> 'Brand#2'", "size": "p_size > 0"}
    return con.check_violations(read_table(spark, sf, "part"), checks)


@query(
    "range_violations",
    f"WITH w AS ({d.sql_of('orders', d.WIDE_VALUES)}) SELECT 'big_id' AS column_name, count_if(abs(big_id) >= 1000000000000000)::BIGINT AS bad_rows FROM w"
    " UNION ALL SELECT 'signed_qty', count_if(signed_qty < 0)::BIGINT FROM w UNION ALL SELECT 'small_no', count_if(small_no > 32767 OR small_no < -32768)::BIGINT FROM w",
)
def range_violations(spark, sf):
    targets = {"big_id": "DOUBLE", "signed_qty": "UNSIGNED", "small_no": "SMALLINT"}
    return con.range_violations(d.derive(spark, sf, "orders", d.WIDE_VALUES), targets)


def _temporal_sql(c: str) -> str:
    like = f"(regexp_matches({c}, {_PLAIN}) OR regexp_matches({c}, {_NAMED}) OR regexp_matches({c}, {_ZONE}))"
    return (
        f"SELECT '{c}' AS column_name, count_if({c} <> '')::BIGINT AS filled_rows, count_if({c} <> '') > 0 AND count_if({c} <> '') = count_if({like}) AS is_temporal FROM x"
    )


@query(
    "infer_temporal",
    "WITH x AS (SELECT CAST(o_orderdate AS VARCHAR) AS plain_text, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderdate AS VARCHAR) || ' +08:00' END AS zoned_text,"
    " o_orderpriority AS priority FROM orders) " + " UNION ALL ".join(_temporal_sql(c) for c in ("plain_text", "zoned_text", "priority")),
)
def infer_temporal(spark, sf):
    df = read_table(spark, sf, "orders").selectExpr(
        "CAST(o_orderdate AS STRING) AS plain_text",
        "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderdate AS STRING) || ' +08:00' END AS zoned_text",
        "o_orderpriority AS priority",
    )
    return con.infer_temporal_columns(df, tt.looks_like_datetime)
