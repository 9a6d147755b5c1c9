"""Sharding by a Feistel permutation over global row numbers.

Rows are numbered by their key through a range partitioning that is written down
first: a row's number is its place in its sorted range plus the size of the ranges
before it. The permutation works on pairs (left, right) of two moduli whose product
is just above the row count; numbers that land outside are sent through again until
they land inside (cycle walking). Shard and slot follow from the new number alone,
and back.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlift.llm.texts import pick, settle
from ledgerlift.session import default_buckets

SHARDS = 16
ROUND_KEYS = (0x2545F491, 0x3C6EF372, 0x1F83D9AB, 0x5BE0CD19, 0x428A2F98, 0x71374491)
PRIME = (1 << 31) - 1  # products of two numbers below it fit in 62 bits
FACTOR = 0x3504F333


def moduli(n: int) -> tuple[int, int]:
    """Sizes of the two halves: their product is at least ``n`` and little more."""
    left = max(1, isqrt(max(0, n - 1)) + 1)
    return left, max(1, -(-n // left))


def _round(half: np.ndarray, key: int) -> np.ndarray:
    x = ((half % PRIME) ^ key) % PRIME * FACTOR % PRIME
    return (x ^ (x >> 15)) * (key | 1) % PRIME


def _forward(numbers: np.ndarray, a: int, b: int) -> np.ndarray:
    left, right = numbers // b, numbers % b
    for i, key in enumerate(ROUND_KEYS):
        if i % 2:
            right = (right + _round(left, key)) % b
        else:
            left = (left + _round(right, key)) % a
    return left * b + right


def _backward(numbers: np.ndarray, a: int, b: int) -> np.ndarray:
    left, right = numbers // b, numbers % b
    for i, key in reversed(list(enumerate(ROUND_KEYS))):
        if i % 2:
            right = (right - _round(left, key)) % b
        else:
            left = (left - _round(right, key)) % a
    return left * b + right


def _walk(step, numbers: np.ndarray, n: int) -> np.ndarray:
    a, b = moduli(n)
    out = step(np.asarray(numbers, np.int64), a, b)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = step(out[outside], a, b)
        outside = outside[out[outside] >= n]
    return out


def permute(numbers: np.ndarray, n: int) -> np.ndarray:
    """New place of each row number in [0, n)."""
    return _walk(_forward, numbers, n)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS) -> np.ndarray:
    """The row number that stands in a slot of a shard: the way back."""
    return _walk(_backward, np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64), n)


def number_rows(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Rows with ``row_number`` from 0 in the order of ``keys``, and how many there are.

    Rows equal in all keys are interchangeable and are dealt out by a written-down
    random number, so that no key fills a range. One count per range is collected.
    """
    spark = rows.sparkSession
    base = settle(rows.withColumn("__deal", F.rand(17)))
    ranged = base.repartitionByRange(default_buckets(spark), *keys, "__deal").sortWithinPartitions(*keys, "__deal").drop("__deal")
    ranged = settle(ranged).withColumn("__at", F.monotonically_increasing_id())
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, size in sizes:
        offsets.append((p, total))
        total += size
    starts = spark.createDataFrame(offsets, "__part bigint, __start bigint")
    joined = ranged.withColumn("__part", part).join(starts, "__part")
    return joined.withColumn("row_number", F.col("__start") + place).drop("__part", "__start", "__at"), total


def shard_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, row_number, law, shard, slot, grown_shard.

    The law is ``rows``: shards differ by at most one row, slots are gapless from 0.
    Numbers follow doc_id (NULL first), then size and checksum; NULL and empty text
    have size 1 and checksum 0. Only these small values are shuffled, never texts.
    An empty table gives no rows.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    small = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", (F.octet_length(body).cast("bigint") + 1).alias("size"), F.crc32(body).alias("text_crc32")
    )
    numbered, n = number_rows(small, ["doc_id", "size", "text_crc32"])

    def place(numbers: pa.Array) -> pa.Array:
        return pa.array(permute(numbers.to_numpy(zero_copy_only=False), n), pa.int64())

    place.__annotations__ = {"numbers": pa.Array, "return": pa.Array}
    at = F.col("__place")
    return numbered.withColumn("__place", F.arrow_udf(place, "bigint")(F.col("row_number"))).select(
        "doc_id", "size", "text_crc32", "row_number", F.lit("rows").alias("law"), (at % shards).cast("int").alias("shard"),
        F.expr(f"__place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
