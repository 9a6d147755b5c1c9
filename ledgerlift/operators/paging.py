"""Pages, key ranges, row numbers and physical-row buckets of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions.values import literal
from ledgerlift.session import default_buckets, ensure_checkpoint_dir

SHORT_RANGES = 32_768  # keys that may be read in order at last
DRAWN_KEYS = 128  # keys that cut the ranges of a round
PLACE_BITS = 33  # monotonically_increasing_id: row place in the low bits, partition above


def keyset_page(df: DataFrame, key: str | list[str], last: Any, n: int) -> DataFrame:
    """The ``n`` rows after ``last`` in key order; ``last=None`` gives the first page.

    A key of several columns takes ``last`` as a tuple. NULL comes before any value,
    in each column. A page may end between rows of one key only if keys repeat.
    """
    cols = [key] if isinstance(key, str) else key
    return (df if last is None else rows_after(df, cols, (last,) if isinstance(key, str) else last)).orderBy(*cols).limit(n)


def rows_after(df: DataFrame, cols: list[str], last: tuple) -> DataFrame:
    """Rows strictly after a key in the order by ``cols``, NULL first. The leading column alone prunes the scan."""
    if len(last) != len(cols):
        raise ValueError(f"a key of {len(cols)} columns needs as many values")
    lead, kind = F.col(cols[0]), df.schema[cols[0]].dataType
    if len(cols) == 1:
        return df.filter(lead.isNotNull() if last[0] is None else lead > literal(last[0], kind))
    key, constant = _key(df, cols)
    pruned = df if last[0] is None else df.filter(lead >= literal(last[0], kind))
    return pruned.filter(key > constant(last))


def _constant(values: tuple, types: list[T.DataType], names: list[str]) -> Column:
    """A key as a constant struct, which Spark compares field by field, NULL first."""
    return F.struct(*[literal(v, t).cast(t).alias(n) for v, t, n in zip(values, types, names)])


def _key(df: DataFrame, cols: list[str]) -> tuple[Column, Callable[[tuple], Column]]:
    """The key as one value that Spark compares, and how to write a constant one. NULL in a composite key comes first."""
    types, names = [df.schema[c].dataType for c in cols], [f"k{i}" for i in range(len(cols))]
    if len(cols) == 1:
        return F.col(cols[0]), lambda v: literal(v[0], types[0]).cast(types[0])
    return F.struct(*[F.col(c).alias(n) for c, n in zip(cols, names)]), lambda v: _constant(v, types, names)


def _sorted_keys(keys: Iterable[tuple]) -> list[tuple]:
    """Different keys in Spark's order: NULL first, NaN last."""
    return sorted(set(keys), key=lambda k: [(v is not None, v != v, v if v is not None and v == v else 0) for v in k])


def _place(key: Column, cuts: list[Column], first: int = 0) -> Column:
    """2 i between cuts, 2 i + 1 on cut i, by halving."""
    if not cuts:
        return F.lit(2 * first)
    m = len(cuts) // 2
    return (
        F.when(key == cuts[m], 2 * (first + m) + 1).when(key < cuts[m], _place(key, cuts[:m], first))
        .otherwise(_place(key, cuts[m + 1 :], first + m + 1))
    )


def keys_at(df: DataFrame, cols: list[str], ranks: list[int], total: int | None = None, empty: int | None = None) -> dict[int, tuple[tuple, int]]:
    """The key at each rank (from 1) of the order by ``cols``, and how many rows stand before that key.

    Exact, with nothing sorted, shuffled or written but counts: a few keys drawn at
    random cut the table into ranges, one pass counts the rows of each, and only the
    ranges that hold a wanted rank are cut again, all in one pass, until they are
    short enough together to be read in order. A cut is a range of its own, so a key
    that repeats without end is an answer too. The driver sees drawn keys, counts and
    at most SHORT_RANGES keys. ``total`` and ``empty``, the rows and those with a NULL
    key, are counted unless given. Ranks outside the table are left out; NULL comes first.
    """
    key, constant = _key(df, cols)
    rows = df.select(*cols)
    total = df.count() if total is None else total
    found: dict[int, tuple[tuple, int]] = {}
    before = 0
    if len(cols) == 1:
        before = rows.filter(key.isNull()).count() if empty is None else empty
        found = {r: ((None,), 0) for r in ranks if 1 <= r <= before}
        rows = rows.filter(key.isNotNull())
    wanted = sorted({r for r in ranks if before < r <= total})
    ranges = [(None, None, before, total - before, wanted)] if wanted else []  # after, ahead of, rows before, rows, ranks

    def inside(low: tuple | None, high: tuple | None) -> Column:
        over = F.lit(True) if low is None else key > constant(low)
        return over if high is None else over & (key < constant(high))

    while ranges:
        part = rows.filter(reduce(Column.__or__, [inside(low, high) for low, high, *_ in ranges]))
        if sum(n for *_, n, _ in ranges) <= SHORT_RANGES:
            listed, start = [tuple(r) for r in part.orderBy(*cols).collect()], 0
            for _, _, before, n, own in ranges:
                mine, start = listed[start : start + n], start + n
                first = {k: i for i, k in reversed(list(enumerate(mine)))}
                found |= {r: (mine[r - before - 1], before + first[mine[r - before - 1]]) for r in own}
            break
        drawn = [tuple(r) for r in part.orderBy(F.rand(7)).limit(DRAWN_KEYS).collect()]
        cuts = _sorted_keys(drawn + [e for low, high, *_ in ranges for e in (low, high) if e is not None])
        place = _place(key, [constant(c) for c in cuts])
        counts = {r["place"]: r["n"] for r in part.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        at, rest = {c: i for i, c in enumerate(cuts)}, []
        for low, high, before, _, own in ranges:
            for i in range(0 if low is None else 2 * at[low] + 2, 2 * len(cuts) + 1 if high is None else 2 * at[high] + 1):
                size = counts.get(i, 0)
                here = [r for r in own if before < r <= before + size]
                if here and i % 2:
                    found |= {r: (cuts[i // 2], before) for r in here}
                elif here:
                    rest.append((cuts[i // 2 - 1] if i else None, cuts[i // 2] if i < 2 * len(cuts) else None, before, size, here))
                before += size
        ranges = rest
    return found


def offset_page(df: DataFrame, order_cols: list[str], offset: int, n: int) -> DataFrame:
    """Rows ``offset+1 .. offset+n`` of the order by ``order_cols``.

    The page's two border keys are found by counting; only rows between them are
    read again, so only the page is sorted. Rows equal in all order columns stand in
    any order among themselves.
    """
    total = df.count()
    last = min(offset + n, total)
    if offset >= total or n < 1:
        return df.limit(0)
    ends = keys_at(df, order_cols, [offset + 1, last], total)
    (low, before), (high, _) = ends[offset + 1], ends[last]
    key, constant = _key(df, order_cols)
    page = df
    if low[0] is not None:
        lead = df.schema[order_cols[0]].dataType  # alone, the leading column prunes the scan
        page = page.filter((F.col(order_cols[0]) >= literal(low[0], lead)) & (F.col(order_cols[0]) <= literal(high[0], lead)))
    if len(order_cols) > 1:
        page = page.filter((key >= constant(low)) & (key <= constant(high)))
    elif low[0] is None:
        page = page.filter(key.isNull() if high[0] is None else key.isNull() | (key <= constant(high)))
    return page.orderBy(*order_cols).offset(offset - before).limit(n)


def incremental_rows(df: DataFrame, key: str | list[str], last: Any) -> DataFrame:
    """Rows written since the recorded high-water key, which for several columns is a tuple.

    The filter on the leading column stays plain, so it prunes the scan. A NULL there
    could never be resumed past, so such a row is an error; looking for one is a
    pruned scan too. In further columns NULL comes before any value.
    """
    cols = [key] if isinstance(key, str) else key
    lead = cols[0]
    fail = F.raise_error(F.lit(f"key {lead} is NULL")).cast(df.schema[lead].dataType).alias(lead)
    unkeyed = df.filter(F.col(lead).isNull()).select(*[fail if c == lead else F.col(c) for c in df.columns])
    newer = df.filter(F.col(lead).isNotNull()) if last is None else rows_after(df, cols, (last,) if isinstance(key, str) else last)
    return newer.unionByName(unkeyed)


def sample_rows(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The first ``n`` rows by key."""
    return df.orderBy(key).limit(max(1, n))


def number_rows(df: DataFrame, order_cols: list[str], name: str = "row_no", partitions: int | None = None) -> DataFrame:
    """``ROW_NUMBER()`` over a whole table without sorting it in one task.

    Rows are range-partitioned and sorted, then checkpointed so that the
    partitions stay the same whatever executor is lost later. A row's number is
    its place in its partition plus the size of the partitions before, so no
    second shuffle and no window is needed. ``order_cols`` must be a total
    order; with all of them in the range key, a hot first column splits too.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    placed = df.repartitionByRange(partitions or default_buckets(spark), *order_cols).sortWithinPartitions(*order_cols)
    rows = placed.checkpoint().withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", PLACE_BITS)
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one per partition
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(str(total))
        total += sizes.get(p, 0)
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    start = F.element_at(F.expr(f"array({', '.join(starts)})"), part.cast("int") + 1).cast("long")
    inside = F.col("_place").bitwiseAND(F.lit(2**PLACE_BITS - 1))
    return rows.select(*df.columns, (start + inside + 1).alias(name))


def key_splits(df: DataFrame, key: str, n: int) -> DataFrame:
    """Exact ``ntile`` ranges of a key: tile, lowest and highest key, row count. Tiles without rows are left out.

    ``ntile`` gives the first tiles one row more, so the ranks of all borders are
    known from the row count, and ``keys_at`` finds their keys without sorting or
    writing the table. NULL keys stand first and are no border.
    """
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("filled")).first()
    total, empty = counted["n"], counted["n"] - counted["filled"]
    small, longer = divmod(total, n)
    tiles, last = [], 0
    for tile in range(1, min(n, total) + 1):
        size = small + (tile <= longer)
        tiles.append((tile, max(last + 1, empty + 1), last + size, size))
        last += size
    keys = keys_at(df, [key], [r for _, lo, hi, _ in tiles for r in (lo, hi) if lo <= hi], total, empty)
    rows = [(tile, keys[lo][0][0] if lo <= hi else None, keys[hi][0][0] if lo <= hi else None, size) for tile, lo, hi, size in tiles]
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("tile", T.IntegerType()), T.StructField("lo_key", kind), T.StructField("hi_key", kind), T.StructField("n_rows", T.LongType())])
    return df.sparkSession.createDataFrame(rows, schema)


def split_predicates(splits: DataFrame, key: str) -> list[str]:
    """WHERE clauses, one per tile, for a partitioned JDBC read. Open ends catch rows outside the measured range."""
    text_key = isinstance(splits.schema["hi_key"].dataType, T.StringType)

    def show(v: Any) -> str:
        return "'" + str(v).replace("'", "''") + "'" if text_key or not isinstance(v, int | float) else str(v)

    tops = [r["hi_key"] for r in splits.orderBy("tile").select("hi_key").collect()]  # one value per tile
    cuts = sorted(set(tops[:-1]), key=tops.index)
    if not cuts:
        return ["1 = 1"]
    clauses = [f"{key} <= {show(cuts[0])}"]
    clauses += [f"{key} > {show(a)} AND {key} <= {show(b)}" for a, b in zip(cuts, cuts[1:])]
    return clauses + [f"{key} > {show(cuts[-1])}"]


def physical_buckets(df: DataFrame, n: int) -> DataFrame:
    """Bucket of each row of a file-backed table by its physical place (file and row position).

    Needs no key, and copies of one row spread evenly because their places differ.
    ``df`` must come straight from a file scan.
    """
    place = F.hash(F.col("_metadata.file_path")).cast("long") + F.col("_metadata.row_index")
    return df.select("*", F.pmod(place, F.lit(n)).cast("int").alias("bucket"))


def hash_buckets(df: DataFrame, n: int) -> DataFrame:
    """Bucket by content, for sources without a physical row address. Equal rows share a bucket."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int"))
