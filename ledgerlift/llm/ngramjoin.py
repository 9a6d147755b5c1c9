"""N-gram Jaccard join by grouped prefixes, and the groups of linked documents.

A document's set holds its distinct 3-word shingles. Equal sets are one class; the
classes that share prefix and size are one group. Groups meet over prefix tokens,
rarest first; a pair of groups is kept only if sizes and prefixes allow the
similarity, then it is expanded to its classes, which are verified on their texts.

Pairs within a long token list are not all emitted. First each group meets only the
leader of each of its lists, and each class only the first class of its own group.
What is linked with one leader needs no further check; then the pairs that this does
not connect are checked, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlift.llm import prefixes as px
from ledgerlift.llm.texts import WordScan, longs, pick, shingles, slices, spare, tick

SHINGLE = 3
SHARE = (9, 10)


def _shingled(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    scan = WordScan([t.lower() if t else t for t in texts])
    return shingles(scan.hashes(), scan.by_text(), k)


def _tokens(k: int):
    return lambda texts: _shingled(texts, k)[0]


def _describe(k: int, share: tuple[int, int], table: np.ndarray):
    """Set size, class, group and (once per group and slice) prefix of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                tokens, at, owner = px.sorted_sets(*_shingled(texts, k))
                sizes, names = np.diff(at), px.set_names(tokens, at)
                prefix, begins, common = px.rare_prefixes(tokens, at, owner, table, share)
                groups = np.zeros(len(texts), np.uint64)
                first = np.zeros(len(texts), bool)
                seen = set()
                for i in np.flatnonzero(sizes).tolist():
                    g = xxhash.xxh3_64_intdigest(prefix[begins[i] : begins[i + 1]].tobytes(), seed=int(sizes[i]))
                    groups[i] = g
                    first[i] = g not in seen
                    seen.add(g)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), batch.column(2).slice(start, len(texts)), longs(sizes), longs(names), longs(groups), longs(common), px.lists_of(prefix, begins, first)],
                    ["doc_id", "hash", "n", "class", "grp", "common", "prefix"],
                )

    return run


def _verify(k: int, share: tuple[int, int]):
    """Keeps the pairs whose texts reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)

        def of(text: bytes) -> np.ndarray:
            return np.unique(_shingled([text], k)[0])

        for batch in batches:
            keep = []
            for start, rows in slices(batch.column(2)):
                for x, y in zip(rows, batch.column(3).slice(start, len(rows)).cast(pa.large_binary()).to_pylist(), strict=True):
                    if last[0] != x:
                        last = (x, of(x))
                    one, two = last[1], of(y)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    keep.append(share[1] * both >= share[0] * (len(one) + len(two) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _may_meet(m: Column, i: Column, n: Column, j: Column, share: tuple[int, int]) -> Column:
    """Whether sets of these sizes can reach the similarity if their first common token stands at these places.

    Length filter and positional filter: behind the first common token the overlap is
    at most what is left of either set.
    """
    fits = F.least(m, n) * share[1] >= F.greatest(m, n) * share[0]
    return fits & (F.least(m - i, n - j) * (share[0] + share[1]) >= (m + n) * share[0])


def _needed(m: Column, n: Column, share: tuple[int, int]) -> Column:
    """Smallest overlap of sets of these sizes at the similarity (not rounded up)."""
    return (m + n) * share[0] / (share[0] + share[1])


def _rest(n: Column, share: tuple[int, int]) -> Column:
    """Tokens of a set behind its prefix."""
    return F.ceil(n * share[0] / share[1]) - 1


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest doc_id reachable over links).

    Two documents link if their sets' Jaccard similarity is ``share`` or more. NULL
    and empty texts have the empty set, are linked with nothing, and name themselves.
    Equal texts and equal sets are linked; rows that repeat a doc_id count as they
    stand. A component whose ids are all NULL has component_id NULL. An empty table
    gives no rows.
    """
    space = px.Workspace(docs.sparkSession, "ngramjoin")
    body = pick(docs, doc_id=doc_id, text=text)
    table = px.rarity_table(body.select("text"), _tokens(k))
    kind = body.dtypes[0][1]
    source = body.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    facts = space.stash(source.mapInArrow(_describe(k, share, table), f"doc_id {kind}, hash bigint, n bigint, class bigint, grp bigint, common bigint, prefix array<bigint>"), "sets")
    some = facts.where("n > 0")
    classes = space.stash(
        some.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.min("hash").alias("hash"), F.min("grp").alias("grp"), F.min("n").alias("n")), "classes"
    )
    shown = some.where("prefix IS NOT NULL")
    group = Window.partitionBy("token")
    posted = shown.select("grp", F.col("n").cast("int").alias("n"), F.col("common").cast("int").alias("common"), F.posexplode("prefix").alias("at", "token"))
    lists = posted.withColumn("lo", F.min("grp").over(group)).withColumn("hi", F.max("grp").over(group)).where("lo < hi")
    lists = lists.withColumn("lead", F.max(F.struct("common", "grp", "n", "at")).over(group))
    lists = space.stash(lists.select("token", "grp", "n", "at", "lead").distinct(), "lists")

    # First links: groups with the leader of each of their lists, classes with the first class of their group. A
    # leader is the group whose prefix is commonest: what copies changed is rare, so it is the nearest to their origin.
    heads = classes.groupBy("grp").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("members"))
    in_group = classes.join(heads.where("members > 1"), "grp").where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    sets = space.stash(shown.groupBy("grp").agg(F.min("n").alias("n"), F.min("prefix").alias("prefix")), "groups")

    def bounded(pairs: DataFrame) -> DataFrame:
        """Group pairs whose prefixes share enough: what lies behind them cannot make up for more."""
        pairs = pairs.join(sets.select(F.col("grp").alias("ga"), F.col("n").alias("na"), F.col("prefix").alias("pa")), "ga")
        pairs = pairs.join(sets.select(F.col("grp").alias("gb"), F.col("n").alias("nb"), F.col("prefix").alias("pb")), "gb")
        na, nb = F.col("na"), F.col("nb")
        meet = F.size(F.array_intersect("pa", "pb"))
        return pairs.where(meet + F.greatest(_rest(na, share), _rest(nb, share)) >= _needed(na, nb, share)).select("ga", "gb")

    star = lists.where((F.col("grp") != F.col("lead.grp")) & _may_meet(F.col("lead.n"), F.col("lead.at"), F.col("n"), F.col("at"), share))
    star = bounded(star.select(F.col("lead.grp").alias("ga"), F.col("grp").alias("gb")).distinct())
    star = star.join(heads.select(F.col("grp").alias("ga"), F.col("head").alias("a")), "ga")
    star = star.join(classes.select(F.col("grp").alias("gb"), F.col("class").alias("b")), "gb")
    first_pairs = space.stash(star.select("a", "b").union(in_group), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that reach the similarity, by the texts of the classes in them, one each."""
        used = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        wanted = space.stash(classes.join(used, "class").select("hash", "class"), "wanted")
        maybe = px.membership(wanted.select("hash"))
        found = source.select("hash", "text").where(maybe(F.col("hash"))).mapInArrow(_one_of_each, "hash bigint, text string")
        bodies = space.stash(found.join(wanted, "hash").groupBy("class").agg(F.min("text").alias("text")), "bodies")
        x = bodies.select(F.col("class").alias("a"), F.col("text").alias("x"))
        y = bodies.select(F.col("class").alias("b"), F.col("text").alias("y"))
        return space.stash(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(k, share), "a bigint, b bigint"), "links")

    links = verified(first_pairs)
    # Classes linked with one leader are connected. Then what may be unconnected within a list or a group.
    labels = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    labelled = space.stash(
        classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "grp", "n", "first_id", F.coalesce("label", "class").alias("label")), "labels"
    )
    spans = labelled.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    open_lists = lists.drop("lead").join(spans, "grp")
    open_lists = open_lists.withColumn("list_low", F.min("low").over(group)).withColumn("list_high", F.max("high").over(group)).where("list_low < list_high")
    open_lists = space.stash(open_lists.select("token", "grp", "n", "at", "low", "high"), "open")
    one = open_lists.select("token", F.col("grp").alias("ga"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("low").alias("la"), F.col("high").alias("ha"))
    two = open_lists.select("token", F.col("grp").alias("gb"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    apart = ~((F.col("la") == F.col("ha")) & (F.col("lb") == F.col("hb")) & (F.col("la") == F.col("lb")))
    meet = _may_meet(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib"), share)
    pairs = bounded(one.join(two, "token").where((F.col("ga") < F.col("gb")) & apart & meet).select("ga", "gb").distinct())
    pairs = pairs.union(spans.where("low < high").select(F.col("grp").alias("ga"), F.col("grp").alias("gb")))
    mine = labelled.select(F.col("grp").alias("ga"), F.col("class").alias("a"), F.col("label").alias("ka"))
    yours = labelled.select(F.col("grp").alias("gb"), F.col("class").alias("b"), F.col("label").alias("kb"))
    rest = pairs.join(mine, "ga").join(yours, "gb").where("ka <> kb AND (ga <> gb OR a < b)").select("a", "b")
    late = verified(space.stash(rest.join(first_pairs, ["a", "b"], "left_anti"), "pairs"))
    labels = px.components(links.union(late))
    labelled = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "first_id", F.coalesce("label", "class").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = space.stash(labelled.join(lowest, "label").select("class", "component_id"), "named")
    space.clear(facts, named)
    lone = facts.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(lone)


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """The documents, with all their columns, less those that are linked with one of a smaller doc_id.

    Of each component one row stays: the smallest doc_id (NULL before all), of rows
    that share it the first as stored. Documents without words all stay. The rows are
    written down once, so that each has a name of its own. Texts of documents that
    surely stay (by a membership filter of fixed size) are not shuffled.
    """
    space = px.Workspace(docs.sparkSession, "keep-one")
    row, maybe = spare(docs, "__row"), spare(docs, "__maybe")
    rows = space.stash(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    linked = link_documents(rows, row, text, k, share).withColumnRenamed("doc_id", "row")
    groups = linked.join(pick(rows, row=row, id=doc_id), "row").select("component_id", F.struct("id", "row").alias("one"))
    best = groups.groupBy("component_id").agg(F.min("one").alias("best"))
    gone = groups.join(best, "component_id").where(F.col("one.row") != F.col("best.row")).select(F.col("one.row").alias(row))
    gone = space.stash(gone, "gone")
    marked = rows.withColumn(maybe, px.membership(gone)(F.col(row)))
    stay = marked.where(~F.col(maybe))
    kept = stay.union(marked.where(F.col(maybe)).join(gone, row, "left_anti").select(*[F.col(tick(c)) for c in marked.columns]))
    return kept.drop(row, maybe)


def _one_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of a batch; the rest of a batch's copies need not travel."""
    for batch in batches:
        first = {k: i for i, k in reversed(list(enumerate(batch.column(0).to_pylist())))}
        yield batch.take(pa.array(sorted(first.values()), pa.int64()))
