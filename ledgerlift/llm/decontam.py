"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item (an item of
fewer words is one pattern). The alphabet is the benchmark's own vocabulary; any
other word is 0 and can be in no pattern. As in Wu and Manber's search, a block
of the last words under the window looks up how far the window may move; where it
may not move, the block's bucket names the patterns that end so, and direct
comparison of all their words confirms an occurrence. Texts are laid end to end
and cut into lanes which numpy moves forward together.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlift.llm.texts import longs, pick, settle, spare, text_udf, tick

WINDOW = 13
BLOCK = 3
ITEM_BYTES = 4 << 20  # benchmark text that one compiled search may hold
LANE = 256
AT_ONCE = 1 << 20  # pattern comparisons per step

# Upper case to lower, everything between words to a blank; bytes from 0x80 on belong to words.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


class WuManber:
    """Search for patterns of one length; ``words`` holds them all, ``at`` says where each begins."""

    def __init__(self, words: np.ndarray, at: np.ndarray, length: int, block: int = BLOCK):
        self.words, self.at, self.m, self.b = words, at, length, min(block, length)
        bits = int(np.clip(np.ceil(np.log2(4 * max(1, len(at) * self.b))), 10, 22))
        self.mask = np.int64((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.b + 1, np.int16)
        for j in range(length - self.b + 1):
            slot = self.slot(words, at + j + self.b - 1)
            np.minimum.at(self.shift, slot, length - self.b - j)
        last = self.slot(words, at + length - 1)
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount(last, minlength=1 << bits), out=self.bucket[1:])

    def slot(self, ids: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Table slot of the block of words that ends at each position."""
        h = np.zeros(len(end), np.int64)
        for j in range(self.b):
            h = h * 1_000_003 + ids[end - j]
        return (h ^ (h >> 21)) & self.mask

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence."""
        stops = np.arange(self.m - 1, len(ids), LANE)
        pos, limit = stops.copy(), np.minimum(stops + LANE, len(ids))
        ends = []
        while len(pos):
            slot = self.slot(ids, pos)
            step = np.where(ids[pos] == 0, self.m, self.shift[slot])
            ends.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            live = pos < limit
            pos, limit = pos[live], limit[live]
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        slot = self.slot(ids, ends)
        sizes = self.bucket[slot + 1] - self.bucket[slot]
        found_at, found = [], []
        total = np.cumsum(sizes)
        start = 0
        while start < len(ends):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + AT_ONCE, side="right")))
            n = sizes[start:stop]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pattern = self.order[np.repeat(self.bucket[slot[start:stop]], n) + inner]
            first = np.repeat(ends[start:stop] - self.m + 1, n)
            for j in range(self.m):
                same = self.words[self.at[pattern] + j] == ids[first + j]
                pattern, first = pattern[same], first[same]
            found_at.append(first)
            found.append(pattern)
            start = stop
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_at]), np.concatenate([none, *found])


class Searcher:
    """All patterns of some benchmark items, compiled, with the items each pattern belongs to."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        rows: list[int] = []
        places: dict[int, dict[tuple, int]] = defaultdict(dict)  # by length: words -> first place
        owners: dict[tuple, set] = defaultdict(set)
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            base, m = len(rows), min(window, len(ids))
            rows.extend(ids)
            for i in range(len(ids) - m + 1) if m else ():
                key = tuple(ids[i : i + m])
                places[m].setdefault(key, base + i)
                owners[key].add(name)
        words = np.array(rows, np.int64)
        self.searches = []
        for m, found in sorted(places.items()):
            names = [sorted(x for x in owners[key] if x is not None) for key in found]
            self.searches.append((WuManber(words, np.fromiter(found.values(), np.int64, len(found)), m), names))

    def __call__(self, texts: list[bytes | None]) -> list[pa.Array]:
        lists = [words_of(t) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        starts = np.cumsum(sizes + 1) - sizes  # one word 0 ahead of each text keeps occurrences inside it
        ids = np.fromiter(
            chain.from_iterable(chain((0,), map(self.vocabulary.get, x, repeat(0))) for x in lists), np.int64, int(sizes.sum()) + len(lists)
        )
        edges = np.zeros(len(ids) + 1, np.int64)
        items: list[set] = [set() for _ in texts]
        for search, names in self.searches:
            first, pattern = search.find(ids)
            np.add.at(edges, first, 1)
            np.add.at(edges, first + search.m, -1)
            owner = np.searchsorted(starts, first, side="right") - 1
            for o, p in set(zip(owner.tolist(), pattern.tolist(), strict=True)):
                items[o].update(names[p])
        hit = np.cumsum(edges[:-1]) > 0
        turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        owner = np.searchsorted(starts, turn[::2], side="right") - 1
        local = (turn - np.repeat(starts[owner], 2)).astype(np.int64)
        n_hit = np.bincount(owner, weights=local[1::2] - local[::2], minlength=len(texts))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)) * 2)]).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(local, pa.int64()))
        return [longs(sizes), longs(n_hit), runs, pa.array([sorted(x) for x in items], pa.list_(pa.string()))]


_MATCH = "struct<n_words:bigint,n_hit:bigint,runs:array<bigint>,items:array<string>>"


def _covered(runs: pa.Array) -> pa.Array:
    """Words inside the union of [start, end) pairs."""
    out = []
    for flat in runs.to_pylist():
        last = total = 0
        for s, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
            total += max(0, e - max(s, last))
            last = max(last, e)
        out.append(total)
    return pa.array(out, pa.int64())


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, item_bytes: int = ITEM_BYTES, keep: bool = False,
) -> DataFrame:
    """One row per document: n_words, n_hit, items (sorted ids of items with occurring windows), contaminated.

    Every document row gets a row, repeated and NULL ids included. NULL or empty
    text has no words. Repeated items count once; an item with a NULL id hits words
    but has no name to report; items without words, and an empty benchmark, hit
    nothing. ``keep`` adds the result, as a struct in one last column, to all of the
    document's own columns instead.

    The benchmark is measured first. Up to ``item_bytes`` of it is compiled into one
    search and sent to the executors; a larger one is cut into as many parts as
    needed by a hash of the item, and the documents pass each part in turn, so that
    what is sent stays within the bound.
    """
    items = pick(benchmark, item=item_id, body=item_text).withColumn("item", F.col("item").cast("string"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // item_bytes))
    rows = docs if keep else pick(docs, doc_id=doc_id, text=text)
    body = F.col(tick(text if keep else "text"))
    found, hits = [spare(rows, f"__match_{p}") for p in range(parts)], spare(rows, "__hit")
    for part, name in enumerate(found):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == part)
        search = Searcher([(r["item"], r["body"].encode() if r["body"] is not None else None) for r in mine.collect()], window)
        rows = rows.withColumn(name, text_udf(search, _MATCH, ["n_words", "n_hit", "runs", "items"])(body))
        if parts > 1:
            rows = settle(rows)
    matches = [F.col(name) for name in found]
    n_words = matches[0]["n_words"]
    # Words that several parts hit count once; one part's own count needs no second Python worker for each task.
    runs = F.flatten(F.array(*[m["runs"] for m in matches]))
    out = rows.withColumn(hits, matches[0]["n_hit"] if parts == 1 else F.arrow_udf(_covered_udf(), "bigint")(runs))
    hit = F.col(hits)
    names = F.array_sort(F.array_distinct(F.flatten(F.array(*[m["items"] for m in matches]))))
    fields = [n_words.alias("n_words"), hit.alias("n_hit"), names.alias("items"), ((hit > 0) & (20 * hit >= n_words)).alias("contaminated")]
    if keep:
        return out.select(*[F.col(tick(c)) for c in docs.columns], F.struct(*fields).alias(spare(docs, "match")))
    return out.select("doc_id", *fields)


def _covered_udf():
    def covered(runs: pa.Array) -> pa.Array:
        return _covered(runs)

    covered.__annotations__ = {"runs": pa.Array, "return": pa.Array}
    return covered


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    judged = find_contamination(docs, benchmark, doc_id, text, keep=True, **options)
    match = judged.columns[-1]
    return judged.where(~F.col(match)["contaminated"]).drop(match)
