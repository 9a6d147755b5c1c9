"""Removal of repeated passages: word windows that also start anywhere else.

Window hashes at every word would be as many rows as the corpus has words. Instead
words are anchored: positions modulo 21 that lie in the difference cover
{3, 6, 7, 12, 14} get a hash of the 15 words there. Any two positions reach cover
positions after the same number of steps (fewer than 21), so two equal windows of
35 words always share an aligned anchor. Repeated anchors are then extended: only
the windows around them are hashed in full (128 bits), and windows found twice are
removed. The text is shuffled once, packed; both joins read the same exchange. A
text is known by 44 bits of one hash and 31 of another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlift.llm.texts import PACKED_BYTES, hash_words, longs, mix, packed, pick, slices, unpacked, word_lists

WINDOW = 35
PERIOD = 21
COVER = (3, 6, 7, 12, 14)  # fixed values: every difference modulo 21 is one of two members
PLACE_BITS = 20  # of a packed document key and place; places beyond repeat modulo 2**20
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def rolled(hashes: np.ndarray, at: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of the ``width`` words at each position, from running sums."""
    steps = np.full(len(hashes) + 1, base, np.uint64)
    steps[0] = 1
    powers = np.cumprod(steps)
    steps[1:] = np.uint64(pow(base, -1, 1 << 64))
    back = np.cumprod(steps)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers[:-1], out=sums[1:])
    return mix((sums[at + width] - sums[at]) * back[at])


def cover_places(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every anchor; texts shorter than a window have none."""
    width = window - PERIOD + 1
    ends = np.where(sizes >= window, sizes - width + 1, 0)
    rows, places = [], []
    for c in COVER:
        n = np.maximum(0, -(-(ends - c) // PERIOD))
        rows.append(np.repeat(np.arange(len(sizes)), n))
        places.append(c + PERIOD * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)))
    return np.concatenate(rows), np.concatenate(places)


def _distinct(texts: list[bytes | None], keys: list[int]) -> tuple[list[int], np.ndarray]:
    """Rows of the first of each equal text, and whether it stands there more than once."""
    first: dict[tuple, int] = {}
    times: dict[int, int] = {}
    for i, (t, k) in enumerate(zip(texts, keys, strict=True)):
        row = first.setdefault((k, t), i)
        times[row] = times.get(row, 0) + 1
    return list(times), np.array(list(times.values()), np.int64) > 1


def _first_of_each(names: np.ndarray, known: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What to send: a name repeated in this batch travels once; its other places are known and go under a name of their own."""
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    again = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    twice = again | np.concatenate([again[1:], [False]])
    names = names.copy()
    known = known.copy()
    known[order[twice]] = True
    names[order[again]] = own[order[again]]
    return names, known


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(0)):
                keys = batch.column(1).slice(start, len(texts)).to_pylist()
                rows, copied = _distinct(texts, keys)
                hashes, starts = hash_words(word_lists([texts[r] for r in rows]))
                owner, place = cover_places(np.diff(starts), window)
                name = rolled(hashes, starts[owner] + place, window - PERIOD + 1, BASES[0])
                key = np.array([keys[r] for r in rows], np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
                named = (key << PLACE_BITS) | (place & ((1 << PLACE_BITS) - 1))
                name, known = _first_of_each(name, copied[owner] if len(owner) else np.zeros(0, bool), mix(named.view(np.uint64)))
                yield pa.RecordBatch.from_arrays([longs(name), longs(named), pa.array(known)], ["name", "packed", "known"])

    return run


def candidate_starts(places: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Window starts around repeated anchors: those from which an anchor lies fewer than PERIOD words ahead."""
    limit = n_words - window + 1
    if limit <= 0:
        return np.zeros(0, np.int64)
    if n_words > 1 << PLACE_BITS:
        places = (places[:, None] + (np.arange(-(-n_words // (1 << PLACE_BITS))) << PLACE_BITS)[None, :]).ravel()
        places = places[places < n_words]
    edges = np.zeros(n_words + 2, np.int64)
    np.add.at(edges, np.maximum(0, places - PERIOD + 1), 1)
    np.add.at(edges, places + 1, -1)
    return np.flatnonzero(np.cumsum(edges)[:limit] > 0)


def _short_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 33


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, frames in slices(batch.column(1), PACKED_BYTES):
                texts = unpacked(frames)
                keys = batch.column(2).slice(start, len(texts)).to_pylist()
                rows, copied = _distinct(texts, keys)
                found = batch.column(3).slice(start, len(texts))
                hashes, starts = hash_words(word_lists([texts[r] for r in rows]))
                at = [candidate_starts(np.asarray(found[r].values, np.int64), int(n), window) for r, n in zip(rows, np.diff(starts), strict=True)]
                owner = np.repeat(np.arange(len(rows)), [len(a) for a in at])
                place = np.concatenate([np.zeros(0, np.int64), *at])
                where = starts[owner] + place
                one, two = rolled(hashes, where, window, BASES[0]), rolled(hashes, where, window, BASES[1])
                key = np.array([keys[r] for r in rows], np.int64)[owner]
                short = np.array([_short_key(texts[r]) for r in rows], np.int64)[owner] << 32 | place
                one, known = _first_of_each(one, copied[owner], mix(key.view(np.uint64) ^ mix(short.view(np.uint64))))
                yield pa.RecordBatch.from_arrays([longs(one), longs(two), longs(key), longs(short), pa.array(known)], ["one", "two", "key", "short", "known"])

    return run


def _finish(window: int):
    def cut(text: bytes | None, hits: np.ndarray | None) -> tuple[int, int, bytes]:
        words = text.split() if text else []
        if hits is None or len(words) < window:
            return len(words), 0, b" ".join(words)
        mine = hits[hits >> 32 == np.int64(_short_key(text))]
        edges = np.zeros(len(words) + 1, np.int64)
        places = mine & 0xFFFFFFFF
        edges[places] += 1
        edges[places + window] -= 1
        kept = np.cumsum(edges[:-1]) == 0
        return len(words), int((~kept).sum()), b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, frames in slices(batch.column(1), PACKED_BYTES):
                hits = batch.column(3).slice(start, len(frames))
                out = []
                for frame, same in groupby(range(len(frames)), lambda i: frames[i]):  # noqa: B023
                    rows = list(same)  # copies of a text stand together and are cut once
                    found = hits[rows[0]]
                    out += [cut(*unpacked([frame]), np.asarray(found.values, np.int64) if found.is_valid else None)] * len(rows)
                ids = batch.column(0).slice(start, len(frames))
                counts = np.array([o[:2] for o in out], np.int64).reshape(len(out), 2)
                kept = pa.array([o[2] for o in out], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, longs(counts[:, 0].copy()), longs(counts[:, 1].copy()), kept], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document row: n_words, n_removed and the kept words joined by one blank.

    A word goes if a window of ``window`` words that covers it also starts anywhere
    else in the input, in the same or another row; rows with equal id and text are
    two places, so both lose such words. NULL and empty texts have no words. Texts
    shorter than a window keep all. ``window`` is at least 22.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD}")
    kind = docs.select(F.col(f"`{doc_id}`")).dtypes[0][1]
    hashed = F.xxhash64("text")
    long_enough = F.coalesce(F.length("text") >= 2 * window - 1, F.lit(False))
    # A text that cannot hold a window is dealt out by its id as well; it is never looked for.
    dealt = F.when(long_enough, F.shiftright(hashed, PLACE_BITS)).otherwise(F.shiftright(F.xxhash64("doc_id", "text"), PLACE_BITS))
    rows = pick(docs, doc_id=doc_id, text=text)
    long_rows = rows.where(F.length("text") >= 2 * window - 1)
    anchors = long_rows.select("text", F.shiftright(hashed, PLACE_BITS).alias("key")).mapInArrow(_anchors(window), "name bigint, packed bigint, known boolean")
    times = F.count(F.lit(1)).over(Window.partitionBy("name"))
    again = anchors.withColumn("times", times).where("known OR times > 1").select(
        F.shiftright("packed", PLACE_BITS).alias("key"), F.col("packed").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place")
    )
    places = again.groupBy("key").agg(F.collect_set("place").alias("places"))
    source = rows.select("doc_id", packed(F.col("text")).alias("frame"), dealt.alias("key"))
    near = source.join(places, "key").select("doc_id", "frame", "key", "places")
    windows = near.mapInArrow(_windows(window), "one bigint, two bigint, key bigint, short bigint, known boolean")
    times = F.count(F.lit(1)).over(Window.partitionBy("one", "two"))
    twice = windows.withColumn("times", times).where("known OR times > 1")
    hits = twice.groupBy("key").agg(F.collect_set("short").alias("hits"))
    joined = source.join(hits, "key", "left").select("doc_id", "frame", "key", "hits")
    return joined.mapInArrow(_finish(window), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
