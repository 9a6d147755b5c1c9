"""Source against target: missing, extra and changed rows, and the fields that differ."""

from __future__ import annotations

import secrets
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions.values import TEMPORAL, TOLERANCE, is_number, literal, normalize_key, preview_value, values_equal
from ledgerlift.operators.paging import sample_rows


def common_columns(src: DataFrame, tgt: DataFrame, keys: list[str]) -> list[str]:
    """Columns on both sides, keys left out, in source order."""
    there = set(tgt.columns)
    return [c for c in src.columns if c in there and c not in keys]


def _join_keys(src: DataFrame, tgt: DataFrame, keys: list[str]) -> tuple[list[Column], list[Column]]:
    pairs = [(c, src.schema[c].dataType, tgt.schema[c].dataType) for c in keys]
    return (
        [normalize_key(F.col(c), a, b) for c, a, b in pairs],
        [normalize_key(F.col(c), b, a) for c, a, b in pairs],
    )


def _not_null(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def null_key_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that cannot be aligned because a key column is NULL."""
    return df.filter(~_not_null(keys))


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row by ``order`` wins, NULL before any value; rows equal in it go by their other columns.

    Each task keeps one row a key before the shuffle (a group limit), so a key with very many rows never meets in one task whole.
    """
    if not order:
        raise ValueError("which row is the later one needs an order")
    rest = [c for c in df.columns if c not in keys]
    lead = order + [c for c in rest if c not in order]
    latest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in lead])
    return df.withColumn("_nth", F.row_number().over(latest)).filter("_nth = 1").select(*df.columns)


def pair_rows(
    src: DataFrame,
    tgt: DataFrame,
    keys: list[str],
    compare: list[str] | None = None,
    unique_keys: bool = False,
    order: list[str] | None = None,
) -> DataFrame:
    """Key columns, ``in_src``, ``in_tgt`` and ``s_<col>``/``t_<col>`` for every row of either side.

    ``unique_keys=True`` (a declared primary or unique key on both sides) stacks the
    two sides and groups them by key once: each side's rows are counted and one row
    kept, combined before the shuffle, so a key that repeats after all neither
    multiplies nor meets in one task, and shows in ``in_src_rows`` and
    ``in_tgt_rows``. Otherwise repeated keys are expected: the last target
    row per key is kept, each source row is checked on its own, and the two
    joins can have a hot source key split by adaptive execution.
    Rows with a NULL key are left out; see ``null_key_rows``.
    """
    cols = common_columns(src, tgt, keys) if compare is None else compare
    src_keys, tgt_keys = _join_keys(src, tgt, keys)
    joined = [f"_k{i}" for i in range(len(keys))]
    if unique_keys:
        return _stacked_pairs(src, tgt, keys, cols).filter(_not_null(keys))
    s = src.filter(_not_null(keys)).select(
        *[k.alias(j) for k, j in zip(src_keys, joined)],
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        *[F.col(c).alias(f"s_{c}") for c in cols],
        F.lit(True).alias("in_src"),
    )
    extra_order = [c for c in (order or []) if c not in keys]
    if not extra_order:
        raise ValueError("keys that may repeat need an order that says which row is the later one")
    t = tgt.filter(_not_null(keys)).select(
        *[k.alias(j) for k, j in zip(tgt_keys, joined)],
        *[F.col(k).alias(f"_t_{k}") for k in keys],
        *[F.col(c).alias(f"t_{c}") for c in cols],
        *[F.col(c).alias(f"_o_{c}") for c in extra_order],
        F.lit(True).alias("in_tgt"),
    )
    t = last_per_key(t, joined, [f"_o_{c}" for c in extra_order])
    found = s.join(t.hint("merge"), joined, "left_outer")
    alone = t.join(s.select(*joined).distinct().hint("merge"), joined, "left_anti")
    both = found.unionByName(alone, allowMissingColumns=True)
    return both.select(
        *[F.coalesce(F.col(f"_s_{k}"), F.col(f"_t_{k}").cast(src.schema[k].dataType)).alias(k) for k in keys],
        F.coalesce(F.col("in_src"), F.lit(False)).alias("in_src"),
        F.coalesce(F.col("in_tgt"), F.lit(False)).alias("in_tgt"),
        *[F.col(f"s_{c}") for c in cols],
        *[F.col(f"t_{c}") for c in cols],
    )


def _stacked_pairs(src: DataFrame, tgt: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Both sides in one grouping by key: how many rows each has, and one row of each. NULL in a key is a key here."""
    src_keys, tgt_keys = _join_keys(src, tgt, keys)
    joined = [f"_k{i}" for i in range(len(keys))]

    def side(df: DataFrame, own_keys: list[Column], is_src: bool) -> DataFrame:
        row = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
        ones = [F.lit(int(x)).cast("bigint").alias(n) for n, x in (("_in_s", is_src), ("_in_t", not is_src))]
        return df.select(*[k.alias(j) for k, j in zip(own_keys, joined)], row.alias("_s" if is_src else "_t"), *ones)

    stacked = side(src, src_keys, True).unionByName(side(tgt, tgt_keys, False), allowMissingColumns=True)
    met = stacked.groupBy(*joined).agg(
        F.sum("_in_s").alias("in_src_rows"), F.sum("_in_t").alias("in_tgt_rows"), F.first("_s", ignorenulls=True).alias("_s"), F.first("_t", ignorenulls=True).alias("_t")
    )
    return met.select(
        *[F.coalesce(F.col(f"_s.k{i}"), F.col(f"_t.k{i}").cast(src.schema[k].dataType)).alias(k) for i, k in enumerate(keys)],
        (F.col("in_src_rows") > 0).alias("in_src"),
        (F.col("in_tgt_rows") > 0).alias("in_tgt"),
        *[F.col(f"_s.c{i}").alias(f"s_{c}") for i, c in enumerate(cols)],
        *[F.col(f"_t.c{i}").alias(f"t_{c}") for i, c in enumerate(cols)],
        "in_src_rows",
        "in_tgt_rows",
    )


def compared_columns(pairs: DataFrame) -> list[str]:
    return [c[2:] for c in pairs.columns if c.startswith("s_") and f"t_{c[2:]}" in pairs.columns]


def _same(pairs: DataFrame, c: str, tol: float) -> Column:
    kinds = pairs.schema
    return values_equal(F.col(f"s_{c}"), kinds[f"s_{c}"].dataType, F.col(f"t_{c}"), kinds[f"t_{c}"].dataType, tol)


def row_status(pairs: DataFrame, tol: float = TOLERANCE) -> Column:
    """same, changed, missing (not in target), extra (not in source), or repeated: a declared key on several rows of a side."""
    all_same = F.lit(True)
    for c in compared_columns(pairs):
        all_same = all_same & _same(pairs, c, tol)
    return (
        F.when(_repeats(pairs), "repeated").when(~F.col("in_tgt"), "missing").when(~F.col("in_src"), "extra").when(all_same, "same").otherwise("changed")
    )


def _repeats(pairs: DataFrame) -> Column:
    counted = {"in_src_rows", "in_tgt_rows"} <= set(pairs.columns)
    return (F.col("in_src_rows") > 1) | (F.col("in_tgt_rows") > 1) if counted else F.lit(False)


def reconcile(
    src: DataFrame,
    tgt: DataFrame,
    keys: list[str],
    compare: list[str] | None = None,
    tol: float = TOLERANCE,
    unique_keys: bool = False,
    order: list[str] | None = None,
) -> DataFrame:
    """One status per aligned row, over every row of both tables; one per key where ``unique_keys`` is declared."""
    pairs = pair_rows(src, tgt, keys, compare, unique_keys, order)
    return pairs.select(*keys, row_status(pairs, tol).alias("status"))


def missing_rows(src: DataFrame, tgt: DataFrame, keys: list[str], unique_keys: bool = False) -> DataFrame:
    """Source rows whose key the target lacks.

    Target keys are collapsed before the join, so that a key on very many rows does not
    meet in one task. Under ``unique_keys`` (declared for the target) that collapses nothing,
    so it is left out; keys that repeat after all give the same rows. The keys are never sent
    whole to every executor: files pack keys so well that a table of many rows looks small.
    """
    src_keys, tgt_keys = _join_keys(src, tgt, keys)
    joined = [f"_k{i}" for i in range(len(keys))]
    s = src.filter(_not_null(keys)).select("*", *[k.alias(j) for k, j in zip(src_keys, joined)])
    t = tgt.filter(_not_null(keys)).select(*[k.alias(j) for k, j in zip(tgt_keys, joined)])
    return s.join((t if unique_keys else t.distinct()).hint("merge"), joined, "left_anti").select(*src.columns)


def extra_rows(src: DataFrame, tgt: DataFrame, keys: list[str], unique_keys: bool = False) -> DataFrame:
    return missing_rows(tgt, src, keys, unique_keys)


def field_diffs(pairs: DataFrame, tol: float = TOLERANCE, keys: list[str] | None = None) -> DataFrame:
    """One row per differing field of rows present on both sides, values shortened for reading.

    A declared key that repeats names no single pair of rows, so its fields are not compared.
    """
    keys = keys or [c for c in pairs.columns if not c.startswith(("s_", "t_", "in_"))]
    entries = []
    for c in compared_columns(pairs):
        ts, tt = pairs.schema[f"s_{c}"].dataType, pairs.schema[f"t_{c}"].dataType
        entries.append(
            F.when(
                ~_same(pairs, c, tol),
                F.struct(
                    F.lit(c).alias("column_name"),
                    preview_value(F.col(f"s_{c}"), ts).alias("source_value"),
                    preview_value(F.col(f"t_{c}"), tt).alias("target_value"),
                ),
            )
        )
    if not entries:
        raise ValueError("the tables share no column besides the key")
    both = pairs.filter(F.col("in_src") & F.col("in_tgt") & ~_repeats(pairs))
    return both.select(*keys, F.explode(F.array_compact(F.array(*entries))).alias("d")).select(*keys, "d.*")


def diffs_by_column(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("column_name").agg(F.count("*").alias("n_diffs"))


def sample_compare(
    src: DataFrame, tgt: DataFrame, keys: list[str], n: int = 100, tol: float = TOLERANCE, unique_keys: bool = True
) -> DataFrame:
    """Status of the first ``n`` source rows by key.

    The target is bounded by the sample's last key rather than by its own first
    ``n`` rows, so one lost row does not make the row after the sample look extra.
    """
    key = keys[0]
    head = sample_rows(src.filter(_not_null(keys)), key, n)
    last = head.agg(F.max(key)).first()[0]  # one value
    return reconcile(head, tgt.filter(F.col(key) <= literal(last, tgt.schema[key].dataType)), keys, tol=tol, unique_keys=unique_keys)


def _stacked_rows(a: DataFrame, b: DataFrame, trim: bool = True) -> tuple[DataFrame, list[str]]:
    """The rows of two tables over their common columns, one under the other, with ``_l`` and ``_r`` saying whose each is."""
    cols = [c for c in a.columns if c in set(b.columns)]

    def side(df: DataFrame, left: int) -> DataFrame:
        shown = [
            F.rtrim(c).alias(c) if trim and isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in cols
        ]
        return df.select(*shown, F.lit(left).cast("long").alias("_l"), F.lit(1 - left).cast("long").alias("_r"))

    return side(a, 1).unionByName(side(b, 0)), cols


def _count_rows(stacked: DataFrame, cols: list[str]) -> DataFrame:
    return stacked.groupBy(*cols).agg(F.sum("_l").alias("source_count"), F.sum("_r").alias("target_count"))


def _multiset(a: DataFrame, b: DataFrame, trim: bool = True) -> DataFrame:
    """Each distinct row of two tables over their common columns with its count on both sides, in one grouping."""
    return _count_rows(*_stacked_rows(a, b, trim))


DIGEST_PARTS = 1 << 16


def _has_digest(t: T.DataType) -> bool:
    """Types whose hash sees all of a value; inside nested ones it passes over NULL, and other collations call different text equal."""
    return is_number(t) or isinstance(t, (*TEMPORAL, T.BooleanType, T.BinaryType)) or t == T.StringType()


def _hashed_form(c: Column, t: T.DataType) -> Column:
    """What of a value goes into its row's hash. Longer ones go by their SHA-256: of two words or more, values that meet in xxhash64 under every salt are easily made."""
    if not isinstance(t, (T.StringType, T.BinaryType)) and not (isinstance(t, T.DecimalType) and t.precision > 18):
        return c
    raw = c.cast("string").cast("binary") if isinstance(t, T.DecimalType) else c.cast("binary")
    return F.when(F.octet_length(raw) > 8, F.sha2(raw, 256).cast("binary")).otherwise(raw)


def _multiset_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of both sides as in ``_multiset``, summed up where the sides agree, so that rows that agree are never shuffled.

    Each row has two 64-bit hashes of all its columns, salted anew in every call; the
    first also deals the rows into parts. A part whose row count and sums of hashes are
    the same on both sides is one row of the result; the rows of all other parts are
    grouped whole. So a difference that is reported is always one of rows; one that is
    not there to see needs sums of 128 bits to meet by chance.
    """
    stacked, cols = _stacked_rows(a, b)
    kinds = {c: stacked.schema[c].dataType for c in cols}
    if not all(_has_digest(t) for t in kinds.values()):
        return _count_rows(stacked, cols).select("source_count", "target_count")
    hashed = [_hashed_form(F.col(c), t) for c, t in kinds.items()] + [F.isnull(c) for c in cols]  # a hash passes over NULL
    marked = stacked.select("*", *[F.xxhash64(F.lit(secrets.randbits(63)), *hashed).alias(h) for h in ("_h1", "_h2")])
    marked = marked.withColumn("_part", F.shiftrightunsigned("_h1", 65 - DIGEST_PARTS.bit_length()))
    halves = [x for h in ("_h1", "_h2") for x in (F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    parts = marked.groupBy("_part").agg(
        F.sum("_l").alias("source_count"), F.sum("_r").alias("target_count"),
        F.array(*[F.try_sum((F.col("_l") - F.col("_r")) * x) for x in halves]).alias("_gap"),
    )
    none = F.array(*[F.lit(0).cast("long")] * len(halves))
    alike = F.coalesce((F.col("source_count") == F.col("target_count")) & (F.col("_gap") == none), F.lit(False))
    unlike = parts.filter(~alike).select("_part")  # at most DIGEST_PARTS numbers
    rest = _count_rows(marked.join(F.broadcast(unlike), "_part", "left_semi"), cols)
    return parts.filter(alike).select("source_count", "target_count").unionByName(rest.select("source_count", "target_count"))


def reconcile_keyless(a: DataFrame, b: DataFrame, trim: bool = True) -> DataFrame:
    """Multiset difference of two tables without a key: each differing row with its count on both sides.

    Both sides are stacked and counted in one grouping, so the only shuffle
    carries rows already counted map-side; identical rows cost no join.
    """
    return _multiset(a, b, trim).filter(F.col("source_count") != F.col("target_count"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on more than one row, with their row counts; rows with a NULL in the key have no key."""
    return df.filter(_not_null(keys)).groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Counts of both sides next to each other; a table on one side only keeps a NULL."""
    return (
        source.withColumnRenamed("n_rows", "source_rows")
        .join(target.withColumnRenamed("n_rows", "target_rows"), "table_name", "full_outer")
        .select(
            "table_name",
            "source_rows",
            "target_rows",
            F.col("source_rows").eqNullSafe(F.col("target_rows")).alias("counts_match"),
        )
    )


def table_status(facts: DataFrame) -> DataFrame:
    """Adds the verdict per table. A wrong row count outranks differing rows."""
    differs = (F.col("missing_rows") > 0) | (F.col("extra_rows") > 0) | (F.col("changed_rows") > 0)
    return facts.withColumn(
        "status",
        F.when(F.col("error").isNotNull(), "error")
        .when(~F.col("target_exists"), "missing_target")
        .when(F.col("source_rows") != F.col("target_rows"), "row_count_mismatch")
        .when(differs, "sample_mismatch")
        .otherwise("match"),
    )


FACTS = (
    "target_exists", "source_rows", "target_rows", "compared_rows",
    "missing_rows", "extra_rows", "changed_rows", "null_key_rows", "error",
)


def table_facts(
    name: str,
    src: DataFrame,
    tgt: DataFrame | None,
    keys: list[str] | None,
    tol: float = TOLERANCE,
    unique_keys: bool = False,
    order: list[str] | None = None,
) -> DataFrame:
    """One row of counts for one table. Without a key the rows are compared as multisets."""
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("string")
    if tgt is None:
        counted = src.agg(F.count("*").alias("source_rows")).select(
            F.lit(name).alias("table_name"), F.lit(False).alias("target_exists"), "source_rows",
            *[zero.alias(c) for c in FACTS[2:8]], none.alias("error"),
        )
        return counted
    if not keys:
        l, r = F.col("source_count"), F.col("target_count")
        total = lambda c: F.coalesce(F.sum(c), zero)
        return _multiset_counts(src, tgt).agg(
            total(l).alias("source_rows"), total(r).alias("target_rows"), total(F.least(l, r)).alias("compared_rows"),
            total(F.greatest(l - r, zero)).alias("missing_rows"), total(F.greatest(r - l, zero)).alias("extra_rows"),
        ).select(
            F.lit(name).alias("table_name"), F.lit(True).alias("target_exists"), *FACTS[1:6],
            *[zero.alias(c) for c in FACTS[6:8]], none.alias("error"),
        )
    if unique_keys:
        return _declared_key_facts(name, src, tgt, keys, tol)
    pairs = pair_rows(src, tgt, keys, None, False, order)
    seen = pairs.select("in_src", "in_tgt", row_status(pairs, tol).alias("status"), F.lit(False).alias("null_src"), F.lit(False).alias("null_tgt"))

    def unkeyed(df: DataFrame, is_src: bool) -> DataFrame:
        return null_key_rows(df, keys).select(
            F.lit(is_src), F.lit(not is_src), F.lit(None).cast("string"), F.lit(is_src), F.lit(not is_src)
        )

    stacked = seen.unionAll(unkeyed(src, True)).unionAll(unkeyed(tgt, False))
    out = stacked.agg(
        F.count_if("in_src").alias("source_rows"),
        F.count_if(F.col("status").isin("same", "changed")).alias("compared_rows"),
        F.count_if(F.col("status") == "missing").alias("missing_rows"),
        F.count_if(F.col("status") == "extra").alias("extra_rows"),
        F.count_if(F.col("status") == "changed").alias("changed_rows"),
        F.count_if("null_src").alias("null_key_rows"),
    ).select(F.lit(name).alias("table_name"), F.lit(True).alias("target_exists"), "*", none.alias("error"))
    total = tgt.agg(F.count("*").alias("target_rows")).select(F.lit(name).alias("table_name"), "target_rows")
    return out.join(total, "table_name").select("table_name", *FACTS)


def _declared_key_facts(name: str, src: DataFrame, tgt: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Counts of one table under a declared key, all from one grouping; keys that repeat make the row an error."""
    pairs = _stacked_pairs(src, tgt, keys, common_columns(src, tgt, keys))
    status, keyed = F.col("status"), F.col("keyed")
    seen = pairs.select("in_src_rows", "in_tgt_rows", _not_null(keys).alias("keyed"), row_status(pairs, tol).alias("status"))
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("bigint")
    counted = seen.agg(
        total("in_src_rows").alias("source_rows"),
        total("in_tgt_rows").alias("target_rows"),
        F.count_if(keyed & status.isin("same", "changed")).alias("compared_rows"),
        *[F.count_if(keyed & (status == s)).alias(f"{s}_rows") for s in ("missing", "extra", "changed")],
        total("in_src_rows", ~keyed).alias("null_key_rows"),
        F.count_if(keyed & (F.col("in_src_rows") > 1)).alias("_in_s"),
        F.count_if(keyed & (F.col("in_tgt_rows") > 1)).alias("_in_t"),
    )
    said = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" keys repeat in the {side}"))) for c, side in (("_in_s", "source"), ("_in_t", "target"))]
    error = F.nullif(F.concat_ws("; ", *said), F.lit(""))
    facts = counted.withColumn("error", error)
    return facts.select(
        F.lit(name).alias("table_name"), F.lit(True).alias("target_exists"),
        *[F.when(F.col("error").isNull(), F.col(c)).otherwise(0).cast("bigint").alias(c) for c in FACTS[1:8]], "error",
    )


TABLES_AT_ONCE = 8

VERDICT = (
    "table_name string, target_exists boolean, source_rows bigint, target_rows bigint, compared_rows bigint, missing_rows bigint,"
    " extra_rows bigint, changed_rows bigint, null_key_rows bigint, error string, table_no int"
)


def validate_tables(spark: SparkSession, tables: dict[str, tuple]) -> DataFrame:
    """``{name: (source, target or None, keys or None, unique_keys, order)}`` to one verdict row per table, in that order.

    ``order`` may be left out where keys are unique.

    Each table is one job, several at a time, so small tables do not wait for large
    ones. One that fails for a reason that lies in the data or the table gets the
    verdict ``error`` and the others go on; lost executors, memory and other
    failures of the cluster are raised. A declared key that repeats on either side is
    an error of its table too, as its rows could not be aligned one to one.
    """
    rows: dict[int, tuple] = {}
    planned: dict[int, DataFrame] = {}

    def failed(i: int, e: Exception) -> None:
        name, (_, tgt, *_) = list(tables.items())[i]
        rows[i] = (name, tgt is not None, *[0] * 7, str(e).splitlines()[0], i)

    for i, (name, (src, tgt, keys, unique, *order)) in enumerate(tables.items()):
        try:
            planned[i] = table_facts(name, src, tgt, keys, unique_keys=unique, order=order[0] if order else None).withColumn("table_no", F.lit(i))
        except (AnalysisException, ValueError) as e:
            failed(i, e)
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        jobs = {i: pool.submit(inheritable_thread_target(facts.first)) for i, facts in planned.items()}  # one row a table
    for i, job in jobs.items():
        try:
            rows[i] = tuple(job.result())
        except PySparkException as e:
            if not _lies_in_the_data(e):
                raise
            failed(i, e)
    return table_status(spark.createDataFrame([rows[i] for i in sorted(rows)], VERDICT))


def _lies_in_the_data(e: PySparkException) -> bool:
    """An error with a SQL state that is not one of the engine's own: a value, a file or a name, not a lost machine."""
    state = e.getSqlState()
    return isinstance(e, AnalysisException) or bool(state) and not state.startswith(("XX", "53", "58"))


def validate_report(verdicts: DataFrame) -> DataFrame:
    """Roll-up of table verdicts; success only when every table matches."""
    status = F.col("status")
    return verdicts.agg(
        F.count_if(status == "match").alias("match_count"),
        F.count_if(~status.isin("match", "error")).alias("mismatch_count"),
        F.count_if(status == "error").alias("error_count"),
        F.coalesce(F.bool_and(status == "match"), F.lit(True)).alias("success"),
    )
