"""Reading tables: files by path, and any database through Spark's JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlift.operators.paging import split_predicates

PAGE_ROWS = 5000  # fixed values: rows per fetch, and per fetch when large objects are present
LOB_PAGE_ROWS = 200


def read_table(spark: SparkSession, source: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A whole table; Spark splits the files and prunes columns and filters itself."""
    if fmt == "table":
        return spark.table(f"{source}.{name}" if source else name)
    suffix = "" if "." in name else f".{fmt}"
    return spark.read.format(fmt).load(f"{source.rstrip('/')}/{name}{suffix}")


def jdbc_options(url: str, table: str, has_lob: bool = False, **extra: str) -> dict[str, str]:
    """Options of a JDBC read. Large objects lower the fetch size, so that a page fits in memory."""
    return {
        "url": url,
        "dbtable": table,
        "fetchsize": str(LOB_PAGE_ROWS if has_lob else PAGE_ROWS),
        "pushDownPredicate": "true",
        **extra,
    }


def partition_options(key: str, low: int, high: int, n: int) -> dict[str, str]:
    """Even slices of a whole-number key; ``n`` also bounds the connections in use."""
    return {
        "partitionColumn": key,
        "lowerBound": str(low),
        "upperBound": str(high + 1),
        "numPartitions": str(max(1, min(n, high - low + 1))),
    }


def read_table_parallel(
    spark: SparkSession, url: str, table: str, key: str, n: int, has_lob: bool = False, **extra: str
) -> DataFrame:
    """Parallel JDBC read sliced on a whole-number key between its measured ends."""
    base = jdbc_options(url, table, has_lob, **extra)
    ends_query = f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) ends"
    ends = spark.read.format("jdbc").options(**{**base, "dbtable": ends_query}).load().first()  # one row
    if ends is None or ends[0] is None:
        return spark.read.format("jdbc").options(**base).load()
    return spark.read.format("jdbc").options(**base, **partition_options(key, int(ends[0]), int(ends[1]), n)).load()


def read_table_by_splits(
    spark: SparkSession, url: str, table: str, splits: DataFrame, key: str, properties: dict[str, str] | None = None
) -> DataFrame:
    """Parallel JDBC read over measured tiles, for text or unevenly filled keys."""
    clauses = split_predicates(splits, key)
    return spark.read.jdbc(url, table, predicates=clauses, properties={"fetchsize": str(PAGE_ROWS), **(properties or {})})
