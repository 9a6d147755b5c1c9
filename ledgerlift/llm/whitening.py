"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, are packed into blocks and written once. From then
on the covariance is never formed: every step sends a block of a few directions Q
through one pass over the data, V Q = 1/n sum c (c'Q) with c a centred vector, and
adds up what the tasks return. A Chebyshev recurrence over such passes damps the
unwanted part of the spectrum, whose lower end a few Lanczos steps bound; then QR
and a Rayleigh-Ritz step. The leading directions are certified by their residuals
and by a second look in which all other directions are drawn anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlift.llm.prefixes import FAN, Workspace
from ledgerlift.llm.texts import pick, ship

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BLOCK_ENTRIES = 1 << 17  # entries of a block: 1 MB
LARGEST = 1 << 62  # entries beyond are held at this size
MOST_ROUNDS = 60
LANCZOS_STEPS = 12


class Centred:
    """Exact centring: from whole numbers x to n x - S, and from there to doubles."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums = n, sums
        self.small = 2 * n * largest < LARGEST  # n x - S fits in 64 bits
        self.squares_fit = self.small and len(sums) * (2 * n * largest) ** 2 < LARGEST

    def whole(self, x: np.ndarray) -> np.ndarray:
        if self.small:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.whole(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2 of each row; NULL where it has over 38 digits."""
        whole, kind = self.whole(x), pa.decimal128(38, 0)
        if self.small and (self.squares_fit or len(self.sums) * int(np.abs(whole).max(initial=0)) ** 2 < LARGEST):
            return pa.array((whole * whole).sum(axis=1), pa.int64()).cast(kind)
        sums = (whole.astype(object) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 10**38 else None for v in sums], kind)


def _numbers(vectors: pa.Array, d: int) -> np.ndarray:
    """floor(1024 c) + 100000 of every entry, a row per vector."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    scaled = np.clip(np.floor(flat * SCALE) + SHIFT, -float(LARGEST), float(LARGEST))
    return scaled.astype(np.int64).reshape(-1, d)


def _usable(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """Rows with a whole and finite vector of the commonest length, and that length."""
    good = pick(rows, vec_id=vec_id, vec=vector).where(
        F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda c: F.coalesce(c.between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    )
    top = good.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = top[0]["d"] if top else 0
    return good.where(F.size("vec") == d), d


def _blocks(good: DataFrame, d: int) -> DataFrame:
    """Vectors as blocks of whole numbers: (body), row by row."""
    most = max(1, BLOCK_ENTRIES // d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                x = _numbers(batch.column(0).slice(start, most), d)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["body"])

    return good.select("vec").mapInArrow(run, "body binary")


def _total(blocks: DataFrame, tasks: int, d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of ``of(x)``, an array of one shape: added up in the tasks, then in a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for body in batch.column(0):
                part = of(np.frombuffer(body.as_buffer(), np.int64).reshape(-1, d))
                total = part if total is None else total + part
        if total is not None:
            slot = TaskContext.get().partitionId() % FAN
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for body in batch.column(1):
                part = np.frombuffer(body.as_buffer(), np.float64)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "body"])

    schema = "slot int, body binary"
    parts = blocks.mapInArrow(run, schema)
    if tasks > FAN:  # never more than FAN arrays on the driver
        parts = parts.repartition(FAN, "slot").mapInArrow(add, schema)
    rows = parts.collect()
    return np.sum([np.frombuffer(r["body"], np.float64) for r in rows], axis=0)


def _moments(blocks: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Number of vectors, exact sum of each dimension, largest entry without its sign. One row a dimension is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, most = 0, np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            for body in batch.column(0):
                x = np.frombuffer(body.as_buffer(), np.int64).reshape(-1, d)
                n, most = n + len(x), max(most, int(x.max()), -int(x.min()))
                low, high = low + (x & 0x7FFFFFFF).sum(axis=0), high + (x >> 31).sum(axis=0)
        if n:
            columns = [pa.array(np.arange(d, dtype=np.int32)), pa.array([n] * d, pa.int64()), pa.array(low), pa.array(high), pa.array([most] * d, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "n", "low", "high", "most"])

    parts = blocks.mapInArrow(run, "k int, n bigint, low bigint, high bigint, most bigint")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "low", "high")]
    rows = sorted(parts.groupBy("k").agg(*wide, F.max("most").alias("most")).collect(), key=lambda r: r["k"])
    return int(rows[0]["n"]), [int(r["low"]) + (int(r["high"]) << 31) for r in rows], max(r["most"] for r in rows)


class Spectrum:
    """Leading eigenpairs of a symmetric positive matrix known only by its products."""

    def __init__(self, product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 11):
        self.product, self.d, self.wanted = product, d, min(wanted, d)
        self.k = min(d, self.wanted + max(8, 2 * self.wanted))
        self.random = np.random.default_rng(seed)
        self.passes = 0

    def times(self, q: np.ndarray) -> np.ndarray:
        self.passes += 1
        return self.product(q)

    def lower_end(self) -> float:
        """A bound that the spectrum does not go below: the smallest Ritz value of a short Lanczos run less its remainder."""
        v = self.random.standard_normal(self.d)
        basis, alpha, beta = [v / np.linalg.norm(v)], [], []
        for _ in range(min(LANCZOS_STEPS, self.d)):
            w = self.times(basis[-1][:, None])[:, 0]
            alpha.append(float(w @ basis[-1]))
            for _ in range(2):
                for b in basis:
                    w = w - (w @ b) * b
            beta.append(float(np.linalg.norm(w)))
            if beta[-1] <= 1e-12 * max(1e-300, abs(alpha[0])):
                break
            basis.append(w / beta[-1])
        small = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
        return max(0.0, float(np.linalg.eigvalsh(small)[0]) - beta[len(alpha) - 1])

    def ritz(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rayleigh-Ritz in the span of Q: values falling, vectors, their products, residual norms."""
        q = np.linalg.qr(q)[0]
        w = self.times(q)
        h = q.T @ w
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        q, w = q @ u, w @ u
        return values, q, w, np.linalg.norm(w - q * values, axis=0)

    def filtered(self, values: np.ndarray, q: np.ndarray, w: np.ndarray | None, low: float, high: float) -> np.ndarray:
        """Chebyshev polynomial of V times Q: at most 1 on [low, high], steeply growing above."""
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-9 * values[0])
        grow = np.arccosh(np.maximum(1.0, (values[[0, self.wanted - 1]] - centre) / half))
        degree = int(np.clip(25 / (grow[0] - grow[1] + 1e-9), 4, 20))
        sigma = first = half / (values[0] - centre)
        before, now = q, ((self.times(q) if w is None else w) - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, 2 * (after / half) * (self.times(now) - centre * now) - sigma * after * before
            sigma = after
        return now

    def solve(self) -> tuple[np.ndarray, np.ndarray]:
        """(values, vectors) of the wanted components, falling; fewer where the matrix has a lower rank."""
        c = self.wanted
        values, q, w, left = self.ritz(self.random.standard_normal((self.d, self.k)))
        if self.k < self.d and values[0] > 0:
            low, proven, least = self.lower_end(), None, np.inf
            enough = 64 * np.finfo(float).eps * np.sqrt(self.d)
            for _ in range(MOST_ROUNDS):
                rest = left[:c].max() / values[0]
                if rest <= enough or rest <= 1e-11 and rest > least / 2:
                    if proven is not None and np.abs(values[:c] - proven).max() <= 1e-11 * values[0]:
                        break
                    proven = values[:c].copy()
                    others = self.random.standard_normal((self.d, self.k - c))  # a component missed so far would show
                    high, q, w = values[-1], np.concatenate([q[:, :c], others - q[:, :c] @ (q[:, :c].T @ others)], axis=1), None
                else:
                    high = values[-1]
                least = min(least, rest)
                low = min(low, max(0.0, values[-1] * (1 - 1e-12)))
                values, q, w, left = self.ritz(self.filtered(values, q, w, low, high))
            else:
                raise RuntimeError(f"no certified components after {MOST_ROUNDS} rounds; residual {left[:c].max() / values[0]:.2g}")
        real = int((values[:c] > self.d * 16 * np.finfo(float).eps * max(values[0], 0)).sum()) if values[0] > 0 else 0
        return values[:real], q[:, :real]


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Vectors that are NULL, empty, or hold a NULL or non-finite entry are dropped, as
    are those whose length is not the commonest one (the smaller of two equally
    common). Repeated rows and NULL ids count like any other. Components of no
    variance are left out, so equal vectors, one vector or an empty table give no
    rows. Entries beyond 2**62 after scaling are held there. ``deviation`` is exact,
    NULL above 38 digits. Other columns are not looked at.

    What the driver holds are sums of one size for any input: d x (components + 16).
    Each pass re-reads blocks from the shared folder, so a lost executor costs its
    tasks of one pass.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = dict(rows.dtypes)[vec_id]
    schema = f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    good, d = _usable(rows, vec_id, vector)
    if not d:
        return spark.createDataFrame([], schema)
    space = Workspace(spark, "whitening")
    blocks = space.stash(_blocks(good, d), "blocks")
    tasks = blocks.rdd.getNumPartitions()
    n, sums, largest = _moments(blocks, d)
    centre = Centred(n, sums, largest)

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return (c.T @ (c @ q)).ravel()

        return _total(blocks, tasks, d, part).reshape(q.shape) / n

    trace = float(_total(blocks, tasks, d, lambda x: np.array([(centre(x) ** 2).sum()]))[0]) / n
    values, vectors = Spectrum(product, d, components).solve()
    c = len(values)
    if not c:
        space.clear()
        return spark.createDataFrame([], schema)
    project = vectors / np.sqrt(values)
    mean = _total(blocks, tasks, d, lambda x: (centre(x) @ project).sum(axis=0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        y = centre(x) @ project - mean
        return (y.T @ y).ravel()

    identity = float(np.abs(_total(blocks, tasks, d, spread).reshape(c, c) / n - np.eye(c)).max())
    space.clear()
    explained = values / trace
    most = max(1, BLOCK_ENTRIES // d)
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                ids, x = batch.column(0).slice(start, most), _numbers(batch.column(1).slice(start, most), d)
                owner = pa.array(np.repeat(np.arange(len(x)), c))
                columns = [
                    ids.take(owner), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * c, n, np.int64)),
                    centre.deviation(x).take(owner), pa.array((centre(x) @ project).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * c, identity)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return good.mapInArrow(out, schema)
