"""Ranked lexical search by the Best Position Algorithm.

Documents become rows of (length, query terms, counts), written once; from these
come the statistics over all documents. The rows are then searched where they lie:
each slice of a task keeps one impact list per term, highest impact first. An item
reads its lists from the top in step; each document met is scored by direct access
to the other lists, and every position so seen is marked. A list's best position is
the last of its unbroken run of marks, so the impacts there bound whatever has not
been seen. The search of a slice stops when that bound is strictly below the
item's k-th score so far in the task; ties are therefore always read to the end.
The tasks' best rows are ranked at last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlift.llm.decontam import words_of
from ledgerlift.llm.prefixes import Workspace
from ledgerlift.llm.texts import give_back, longs, pick, ship, slices, text_udf

TOP = 50
ITEM_BYTES = 4 << 20  # terms of items that one pass over the documents may look for
POSTINGS = 1 << 20  # of a slice
FIRST_READ = 16


def _distinct_terms(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([sorted(set(words_of(t))) for t in rows], pa.list_(pa.binary())).cast(pa.list_(pa.string())) for _, rows in slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(text)


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))


class TermCounts:
    """Number of terms of each text, and which of the vocabulary it holds how often."""

    def __init__(self, vocabulary: list[bytes]):
        self.ids = {w: i for i, w in enumerate(vocabulary)}

    def __call__(self, texts: list[bytes | None]) -> list[pa.Array]:
        lists = [words_of(t) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter(map(self.ids.get, chain.from_iterable(lists), repeat(-1)), np.int64, int(sizes.sum()))
        keys = (np.repeat(np.arange(len(lists)), sizes) << 32) + ids
        keys, counts = np.unique(keys[ids >= 0], return_counts=True)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(keys >> 32, minlength=len(lists)))])
        return [longs(sizes), _lists(keys & 0xFFFFFFFF, cuts), _lists(counts, cuts)]


class ImpactLists:
    """Impact lists of some documents, with direct access from a document to its place in every list."""

    def __init__(self, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, stats: Statistics):
        self.starts = starts
        self.terms = terms
        docs = np.repeat(np.arange(len(n)), np.diff(starts))
        impact = stats.impact(terms, counts.astype(np.int64), n[docs])
        order = np.argsort(-impact, kind="stable")
        order = order[np.argsort(terms[order], kind="stable")]
        self.doc, self.impact, self.posting_impact = docs[order], impact[order], impact
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.begin = np.zeros(len(stats.weights) + 1, np.int64)
        np.cumsum(np.bincount(terms, minlength=len(stats.weights)), out=self.begin[1:])
        self.seen, self.met, self.turn = np.zeros(len(order), np.int32), np.zeros(len(n), np.int32), 0
        self.asked = np.zeros(len(stats.weights), bool)

    def _score(self, docs: np.ndarray) -> np.ndarray:
        """Direct accesses: scores of some documents; marks their positions."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        at = np.repeat(self.starts[docs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        hit = self.asked[self.terms[at]]
        at, owner = at[hit], np.repeat(np.arange(len(docs)), sizes)[hit]
        self.seen[self.place[at]] = self.turn
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, owner, self.posting_impact[at])
        return scores

    def search(self, terms: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all that can be among the best k: scores above 0, not below ``floor`` nor the k-th here."""
        terms = terms[self.begin[terms + 1] > self.begin[terms]]
        begin, end = self.begin[terms], self.begin[terms + 1]
        best = begin.copy()  # first position of each list that has not been seen in unbroken order
        self.asked[terms], self.turn = True, self.turn + 1
        docs, scores, read, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST_READ
        while (best < end).any():
            at = (begin + read)[:, None] + np.arange(step)
            found = np.unique(self.doc[at[at < end[:, None]]])
            found = found[self.met[found] != self.turn]
            self.met[found] = self.turn
            docs, scores = np.concatenate([docs, found]), np.concatenate([scores, self._score(found)])
            read, step = read + step, step * 2
            bound = 0
            for i in np.flatnonzero(best < end).tolist():
                p, stop, look = int(best[i]), int(end[i]), step
                while p < stop:
                    gap = self.seen[p : min(stop, p + look)] != self.turn
                    first = int(gap.argmax())
                    if gap[first]:
                        p += first
                        break
                    p += len(gap)
                best[i] = p
                bound += int(self.impact[p - 1]) if p < stop else 0  # the impact at the best position
            if len(scores) > 4 * k:
                keep = scores >= np.partition(scores, -k)[-k]
                docs, scores = docs[keep], scores[keep]
            last = int(np.partition(scores, -k)[-k]) if len(scores) >= k else None
            last = max((x for x in (last, floor) if x is not None), default=None)
            if last is not None and bound < last:
                break
        self.asked[terms] = False
        if len(scores) > k:
            floor = max(floor or 0, int(np.partition(scores, -k)[-k]))
        keep = (scores > 0) & (scores >= (floor or 0))
        return docs[keep], scores[keep]


class Statistics:
    """Corpus statistics, the same for every task."""

    def __init__(self, n_docs: int, n_terms: int, weights: np.ndarray):
        self.n_docs, self.n_terms, self.weights = n_docs, n_terms, weights

    @staticmethod
    def weight(n_docs: int, df: int) -> int:
        return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))

    def impact(self, terms: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + 50 * n * self.n_docs // self.n_terms
        return self.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def _best(found: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    """The k best (score, id): higher scores first, then ascending ids, NULL last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]


def _search(index: DataFrame, kind: str, items: list[np.ndarray], stats: Statistics, k: int) -> DataFrame:
    """The best k of each item among each task's documents: (item, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            cuts = batch.column(2).offsets.to_numpy().astype(np.int64)
            flat = [batch.column(c).values.to_numpy() for c in (2, 3)]
            n, start = batch.column(1).to_numpy(), 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(cuts, cuts[start] + POSTINGS, side="right")) - 1)
                ids, low, high = batch.column(0).slice(start, stop - start), cuts[start], cuts[stop]
                lists = ImpactLists(n[start:stop], cuts[start : stop + 1] - low, flat[0][low:high], flat[1][low:high], stats)
                # Ids in order, so that of equal scores only the lowest k are looked at.
                rank = np.empty(len(ids), np.int64)
                rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                for i, terms in enumerate(items):
                    docs, scores = lists.search(terms, k, best[i][-1][0] if len(best[i]) == k else None)
                    if len(docs) > k:
                        top = np.lexsort((rank[docs], -scores))[:k]
                        docs, scores = docs[top], scores[top]
                    if len(docs):
                        best[i] = _best(best[i] + list(zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist(), strict=True)), k)
                start = stop
        if id_type is not None:
            rows = [(i, doc, score) for i, found in enumerate(best) for score, doc in found]
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])
        give_back()

    return index.select("doc_id", "n", "terms", "counts").mapInArrow(run, f"item int, doc_id {kind}, score bigint")


def rank_documents(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    k: int = TOP, item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score.

    Every document row is ranked, repeated ids and texts included; equal scores go by
    ascending doc_id, NULL last. NULL, empty and wordless texts are no documents. Rows of
    one item_id, NULL too, make one item with the terms of all. An item without terms,
    or whose terms no document holds, has no rows, nor has any item of an empty table.
    Other columns are not looked at.

    Up to ``item_bytes`` of distinct terms of items are sent to the tasks at once; more
    of them are dealt into parts by item, and the documents pass each part in turn. An
    item's terms stay together.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "lexical")
    raw = pick(benchmark, item=item_id, body=item_text)
    items = space.stash(raw.select("item", F.explode(_distinct_terms(F.col("body"))).alias("term")).distinct(), "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // item_bytes))
    source, kind, results = pick(docs, doc_id=doc_id, text=text), dict(docs.dtypes)[doc_id], []
    item_kind = dict(raw.dtypes)["item"]
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("term").collect()
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(r["term"] for r in mine))}
        names = list(dict.fromkeys(r["item"] for r in mine))
        place, asked = {x: i for i, x in enumerate(names)}, [[] for _ in names]
        for r in mine:
            asked[place[r["item"]]].append(vocabulary[r["term"]])
        counts = text_udf(TermCounts([w.encode() for w in vocabulary]), "struct<n:bigint,terms:array<int>,counts:array<int>>", ["n", "terms", "counts"])
        index = space.stash(source.select("doc_id", counts(F.col("text")).alias("t")).select("doc_id", "t.*").where("n > 0"), "index")
        whole = index.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        weights = np.zeros(max(1, len(vocabulary)), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[r["term"]] = Statistics.weight(whole["docs"], r["count"])
        stats = Statistics(whole["docs"], max(1, whole["terms"]), weights)
        found = _search(index, kind, [np.array(x, np.int64) for x in asked], stats, k)
        place_in = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(place_in)).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {item_kind}")
        results.append(space.stash(ranked.join(named, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
        space.clear(items, *results)
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    space.clear(out)
    return out
