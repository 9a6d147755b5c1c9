"""Helpers shared by the text operators: batches of texts, word hashes, shingles and the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlift.session import ensure_checkpoint_dir

SLICE_BYTES = 2 << 20  # texts turned into Python objects at a time
PACKED_BYTES = 1 << 20  # the same for packed texts
TABLE_WORDS = 100_000  # word hashes kept by a worker before its table starts anew


def give_back() -> None:
    """Hand freed memory back to the system, as idle workers stay around for a while."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as bytes) for runs of rows of about ``most`` bytes; a longer text is alone."""
    raw = texts.cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, ends = 0, np.cumsum(sizes)
    while start < len(raw):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, raw.slice(start, stop - start).to_pylist()
        start = stop
    del raw
    give_back()


def text_udf(fn: Callable[[list[bytes | None]], list[pa.Array]], ddl: str, names: list[str]) -> Callable[[Column], Column]:
    """Column function that hands whole texts (bytes or None) to ``fn`` and returns a struct.

    Marked non-deterministic so that a filter on the result does not run it a second time.
    """

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays(fn(rows), names) for _, rows in slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays(fn([]), names)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ddl).asNondeterministic()


def tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns cannot clash."""
    return df.select(*[F.col(tick(c)).alias(name) for name, c in columns.items()])


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, where a job has not been submitted with it."""
    name = "ledgerlift_package.zip"
    context = spark.sparkContext
    if name not in context._python_includes:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="spark-"), name)  # the driver serves it; executors keep copies of their own
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(path))


def settle(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and go on from there, so that lost executors cost no rework."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(text: Column) -> Column:
    """Texts as zstd frames, for shuffles that move many of them; NULL stays NULL."""

    def run(texts: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=1)
        return pa.concat_arrays([pa.array([None if t is None else press.compress(t) for t in rows], pa.binary()) for _, rows in slices(texts)] or [pa.array([], pa.binary())])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(text)


def unpacked(frames: list[bytes | None]) -> list[bytes | None]:
    press = zstandard.ZstdDecompressor()
    return [None if f is None else press.decompress(f) for f in frames]


class WordHashes(dict):
    """64-bit hash of each word, computed once per worker; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def word_lists(texts: list[bytes | None], lower: bool = False) -> list[list[bytes]]:
    """Words between ASCII white space (bytes.split cuts at exactly 0x20 and 0x09-0x0D)."""
    if lower:
        return [t.lower().split() if t else [] for t in texts]
    return [t.split() if t else [] for t in texts]


def hash_words(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all lists in a row, and where each list begins (one more entry than lists)."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    hashes = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(lists)), np.uint64, int(starts[-1]))
    return hashes, starts


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SCAN_BYTES = 1 << 18  # bytes hashed at a time
LONG_WORD = 256  # longer words are hashed one by one


class WordScan:
    """Words between ASCII white space of texts laid end to end, and their 64-bit hashes, without a Python object per word.

    A word's hash is a polynomial in its bytes modulo 2**64, read off running sums:
    (sum up to its end - sum up to its start) / base**start. It depends on the word
    alone. Each text is followed by a line break of its own.
    """

    base = 0x9E3779B97F4A7C15
    tables: tuple | None = None

    def __init__(self, texts: list[bytes | None]):
        self.buffer = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]), np.uint8)
        sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
        self.text_ends = np.cumsum(sizes)
        inside = np.empty(len(self.buffer) + 1, bool)
        inside[0] = False
        np.logical_not(_BLANK[self.buffer], out=inside[1:])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = turns[::2], turns[1::2]  # the last byte is a blank, so every word ends

    @classmethod
    def _powers(cls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if cls.tables is None:
            up, down = np.full(SCAN_BYTES + 1, cls.base, np.uint64), np.full(SCAN_BYTES + 1, pow(cls.base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
            cls.tables = np.multiply.accumulate(up), np.multiply.accumulate(down), letters
        return cls.tables

    def hashes(self) -> np.ndarray:
        up, down, letters = self._powers()
        out, i = np.zeros(len(self.starts), np.uint64), 0
        while i < len(self.starts):
            s = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, s + SCAN_BYTES, side="right")))
            e = min(int(self.ends[j - 1]), s + SCAN_BYTES)
            sums = np.zeros(e - s + 1, np.uint64)
            np.cumsum(letters[self.buffer[s:e]] * up[: e - s], out=sums[1:])
            first, last = self.starts[i:j] - s, np.minimum(self.ends[i:j] - s, e - s)
            out[i:j] = (sums[last] - sums[first]) * down[first]
            i = j
        lengths = self.ends - self.starts
        out = mix(out + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.buffer[self.starts[i] : self.ends[i]].tobytes())
        return out

    def by_text(self) -> np.ndarray:
        """First word of every text; one more entry than texts."""
        return np.searchsorted(self.starts, np.concatenate([[0], self.text_ends])).astype(np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, text and number within it of every line that has a word; one more entry than lines for the words."""
        breaks = np.flatnonzero(self.buffer == 0x0A)
        line = np.searchsorted(breaks, self.starts)
        new = np.flatnonzero(np.diff(line, prepend=-1))
        line, owner = line[new], np.searchsorted(self.text_ends, self.starts[new], side="right")
        before = np.concatenate([[0], np.searchsorted(breaks, self.text_ends[:-1])]).astype(np.int64)
        return np.concatenate([new, [len(self.starts)]]).astype(np.int64), owner, line - before[owner] if len(owner) else line


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(k: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def shingles(hashes: np.ndarray, starts: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every list, and where each list's shingles begin.

    A list of fewer than k words, but not none, has one shingle: its whole sequence.
    """
    factors = _factors(k, salt)
    sizes, n = np.diff(starts), len(hashes)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        rolled[: n - j] += hashes[j:] * factors[j]
    valid = np.ones(n, bool)  # starts of whole shingles: not the last k - 1 words of a list
    ends = starts[1:]
    for j in range(1, k):
        at = ends - j
        valid[at[at >= starts[:-1]]] = False
    for i in np.flatnonzero((sizes > 0) & (sizes < k)).tolist():
        s, e = int(starts[i]), int(starts[i + 1])
        valid[s] = True
        rolled[s] = (hashes[s:e] * factors[: e - s]).sum() + np.uint64(sum(range(e - s + 1, k + 1)))
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64)), out=at[1:])
    return mix(rolled[valid]), at


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64, copy=False) if x.dtype != np.uint64 else x.view(np.int64), pa.int64())
