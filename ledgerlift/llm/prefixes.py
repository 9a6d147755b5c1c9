"""Parts shared by the set-similarity joins: rarity of tokens, prefixes, membership filters, written tables, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlift.llm.texts import give_back, mix, slices
from ledgerlift.session import work_dir

TABLE_BITS = 20  # counters of the rarity table, whatever the input's size
FILTER_BITS = 25  # bits of a membership filter, whatever the input's size
CHUNKS, FAN = 16, 32


class Workspace:
    """Tables of one run in a folder of its own under the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.names, self.made = spark, work_dir(spark, label), [], 0

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it from there."""
        self.made += 1
        place = f"{self.path}/{self.made}-{name}"
        df.write.parquet(place)
        self.names.append(place)
        return self.spark.read.parquet(place)

    def clear(self, *keep: DataFrame) -> None:
        """Delete the tables no longer needed: all but those that ``keep`` reads."""
        kept = [f for df in keep for f in df.inputFiles()]
        for place in list(self.names):
            tail = place.split("://")[-1]
            if not any(tail in f for f in kept):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
                self.names.remove(place)


def _fold(parts: DataFrame, join: np.ufunc, dtype: type) -> bytes:
    """Join the tasks' tables (chunk, slot, body) entry by entry in two rounds; one table comes to the driver."""

    def once(table: pa.Table) -> pa.Table:
        body = None
        for x in table.column("body"):
            part = np.frombuffer(x.as_buffer(), dtype)
            body = part.copy() if body is None else join(body, part, out=body)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "slot": table.column("slot").slice(0, 1), "body": pa.array([body.tobytes()], pa.binary())})

    schema = "chunk int, slot int, body binary"
    rows = parts.groupBy("chunk", "slot").applyInArrow(once, schema).groupBy("chunk").applyInArrow(once, schema).collect()
    return b"".join(r["body"] for r in sorted(rows, key=lambda r: r["chunk"]))


def _chunked(body: np.ndarray) -> pa.RecordBatch:
    slot = TaskContext.get().partitionId() % FAN
    parts = [p.tobytes() for p in np.split(body, CHUNKS)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(CHUNKS), pa.int32()), pa.array([slot] * CHUNKS, pa.int32()), pa.array(parts, pa.binary())], ["chunk", "slot", "body"]
    )


def rarity_table(texts: DataFrame, tokens: Callable[[list[bytes | None]], np.ndarray]) -> np.ndarray:
    """How common tokens are, over all texts: 2**20 counters by hash, as quarter powers of two.

    ``texts`` has one text column; equal texts of a slice count once. The table has
    one size for any input: rare tokens that share a counter are merely ordered as
    if commoner, which costs time and never a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            for _, rows in slices(batch.column(0)):
                found = np.bincount((tokens(list(set(rows))) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=1 << TABLE_BITS)
                counts = found.astype(np.float32) if counts is None else np.add(counts, found, out=counts, casting="unsafe")
        if counts is not None:
            yield _chunked(counts)

    body = _fold(texts.mapInArrow(run, "chunk int, slot int, body binary"), np.add, np.float32)
    counts = np.frombuffer(body, np.float32) if body else np.zeros(1 << TABLE_BITS, np.float32)
    return np.minimum(255, 4 * np.log2(1 + counts)).astype(np.uint8)


def membership(keys: DataFrame) -> Callable[[pa.Array], pa.Array]:
    """A test for one bigint column: false only for values that are not among ``keys``. Of one size for any input."""

    def places(x: np.ndarray) -> np.ndarray:
        h = mix(x.view(np.uint64))
        return np.concatenate([h >> np.uint64(64 - FILTER_BITS), h & np.uint64((1 << FILTER_BITS) - 1)]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8) if bits is None else bits
            p = places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            np.bitwise_or.at(bits, p >> 3, np.uint8(128) >> (p & 7).astype(np.uint8))
        if bits is not None:
            yield _chunked(bits)
        give_back()

    body = np.frombuffer(_fold(keys.mapInArrow(run, "chunk int, slot int, body binary"), np.bitwise_or, np.uint8) or bytes((1 << FILTER_BITS) // 8), np.uint8)

    def test(column: pa.Array) -> pa.Array:
        p = places(column.to_numpy(zero_copy_only=False).astype(np.int64))
        hit = (body[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
        half = len(p) // 2
        return pa.array((hit[:half] & hit[half:]).astype(bool))

    test.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(test, "boolean").asNondeterministic()


def sorted_sets(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each list in hash order, where each list begins, and the owner of each token."""
    tokens = tokens.copy()
    bounds = starts.tolist()
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        if e - s > 1:
            tokens[s:e].sort()
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    owner = owner[new]
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(starts) - 1))]).astype(np.int64)
    return tokens[new], at, owner


def set_names(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit name of each set; empty sets have name 0."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x6A09E667F3BCC909)))])
    sizes = np.diff(at).astype(np.uint64)
    return np.where(sizes > 0, mix(sums[at[1:]] - sums[at[:-1]] + sizes * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))


def rare_prefixes(tokens: np.ndarray, at: np.ndarray, owner: np.ndarray, table: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix of each set, rarest tokens first, where each begins, and how common its tokens are in sum.

    Sets of similarity ``share`` (a fraction) or more have a token in common within
    their first n - ceil(share * n) + 1 tokens, under any order that all sets obey.
    """
    sizes = np.diff(at)
    # In one number: owner, then rarity, then as many bits of the hash as are left.
    bits = max(1, int(len(sizes) - 1).bit_length())
    cls = table[(tokens >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.uint64)
    order = np.argsort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (cls << np.uint64(56 - bits)) | (tokens >> np.uint64(8 + bits)), kind="stable")
    length = np.where(sizes > 0, sizes - -(-sizes * share[0] // share[1]) + 1, 0)
    begins = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    take = np.repeat(at[:-1] - begins[:-1], length) + np.arange(begins[-1])
    sums = np.concatenate([[0], np.cumsum(cls[order[take]].astype(np.int64))])
    return tokens[order[take]], begins, sums[begins[1:]] - sums[begins[:-1]]


def lists_of(values: np.ndarray, begins: np.ndarray, show: np.ndarray) -> pa.Array:
    """One list of bigint per row, NULL where ``show`` is false."""
    sizes = np.where(show, np.diff(begins), 0)
    keep = np.repeat(show, np.diff(begins))
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = pa.array(values[keep].view(np.int64), pa.int64())
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat, mask=pa.array(~show))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, label) of every node in ``edges``: the smallest node it is connected with.

    Alternates large-star and small-star steps: neighbours are hung on the smallest
    one around until nothing changes. Every step is a grouped minimum (combined
    before the shuffle) and a join whose many-edged side Spark can split; edges
    between steps lie in the shared folder.
    """
    space = Workspace(edges.sparkSession, "components")
    now = space.stash(edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).where("hi > lo").distinct(), "edges")
    mark = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        stars = small.select("hi", F.col("m").alias("lo")).union(small.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        now = space.stash(stars.distinct(), "edges")
        space.clear(now)
        seen = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("hi", "lo") % 1_000_003), F.lit(0))).first())
        if seen == mark:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
        mark = seen
