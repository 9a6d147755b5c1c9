"""Line dedup by an exact set-similarity join over the lines of all documents.

A line's set holds its distinct 5-word shingles (of a shorter line, the whole line).
Lines with equal sets are one class. Tokens are ordered by rarity; two lines of
similarity 0.8 or more share a token in their prefixes. Pairs are filtered by size
and by the place of their shared tokens, and verified on the lines themselves.

A line goes if an equal or similar line stands earlier, judged on the input: the
order is doc_id, then row, then line. So a class needs one earlier partner, not all
of them: first every class meets only the earliest class of each of its lists; only
classes that this leaves standing are then held against the other earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlift.llm import prefixes as px
from ledgerlift.llm.texts import WordScan, longs, pick, shingles, slices, spare, tick

SHINGLE = 5
SHARE = (4, 5)


def _tokens(k: int):
    def tokens(texts: list[bytes | None]) -> np.ndarray:
        scan = WordScan(texts)
        return shingles(scan.hashes(), scan.lines()[0], k)[0]

    return tokens


def _describe(k: int, share: tuple[int, int], table: np.ndarray):
    """Class, set size and (once per class and slice, where a partner is possible) prefix of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                scan = WordScan(texts)
                begin, owner, number = scan.lines()
                tokens, at, of = px.sorted_sets(*shingles(scan.hashes(), begin, k))
                sizes, names = np.diff(at), px.set_names(tokens, at)
                prefix, begins, _ = px.rare_prefixes(tokens, at, of, table, share)
                first = np.zeros(len(owner), bool)
                first[np.unique(names, return_index=True)[1]] = True
                first &= sizes > 1  # a set of one token is similar to equal sets only
                rows = pa.array(owner + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(number.astype(np.int32)), longs(names), pa.array(sizes, pa.int32()), px.lists_of(prefix, begins, first)],
                    ["doc_id", "row", "line", "class", "n", "prefix"],
                )

    return run


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns row, text, wanted (line, class): the texts of those lines, once per row and batch."""
    for batch in batches:
        seen = set()
        for start, texts in slices(batch.column(1)):
            keys = batch.column(0).slice(start, len(texts)).to_pylist()
            names, bodies = [], []
            for text, key, wanted in zip(texts, keys, batch.column(2).slice(start, len(texts)).to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    lines = text.split(b"\n")
                    for w in wanted:
                        names.append(w["class"])
                        bodies.append(lines[w["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary()).cast(pa.string())], ["class", "text"])


def _verify(k: int, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for start, xs in slices(batch.column(2)):
                ys = batch.column(3).slice(start, len(xs)).cast(pa.large_binary()).to_pylist()
                scan = WordScan([t for xy in zip(xs, ys, strict=True) for t in xy])
                tokens, at, _ = px.sorted_sets(*shingles(scan.hashes(), scan.by_text(), k))
                for i in range(0, 2 * len(xs), 2):
                    m, n = at[i + 1] - at[i], at[i + 2] - at[i + 1]
                    both = len(np.intersect1d(tokens[at[i] : at[i + 1]], tokens[at[i + 1] : at[i + 2]], assume_unique=True))
                    keep.append(bool(share[1] * both >= share[0] * (m + n - both)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _drop_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """(lines with a word, lines removed, kept lines) of each text."""
    names, done = ["n_lines", "n_removed", "kept"], []
    for start, rows in slices(texts):
        counts, removed, kept = [], [], []
        for text, lines in zip(rows, gone.slice(start, len(rows)).to_pylist(), strict=True):
            own = text.split(b"\n") if text else []
            counts.append(sum(1 for x in own if x.strip(b" \t\n\x0b\x0c\r")))
            out = set(lines or ())
            removed.append(len(out))
            kept.append(text if not out else b"\n".join([x for i, x in enumerate(own) if i not in out]))
        parts = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        done.append(pa.StructArray.from_arrays(parts, names))
    return pa.concat_arrays(done) if done else pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names)


def _drop_udf():
    def drop(texts: pa.Array, gone: pa.Array) -> pa.Array:
        return _drop_lines(texts, gone)

    drop.__annotations__ = {"texts": pa.Array, "gone": pa.Array, "return": pa.Array}
    return F.arrow_udf(drop, "struct<n_lines:bigint,n_removed:bigint,kept:string>").asNondeterministic()


def _may_meet(m: Column, i: Column, n: Column, j: Column, share: tuple[int, int]) -> Column:
    """Whether sets of these sizes can reach the similarity if their first common token stands at these places.

    Length filter and positional filter: behind the first common token the overlap is
    at most what is left of either set.
    """
    fits = F.least(m, n) * share[1] >= F.greatest(m, n) * share[0]
    return fits & (F.least(m - i, n - j) * (share[0] + share[1]) >= (m + n) * share[0])


def repeated_lines(docs: DataFrame, doc_id: str, text: str, k: int, share: tuple[int, int]) -> DataFrame:
    """(row, lines): the removed line numbers of each row that loses any; ``row`` is a hash of doc_id and text."""
    space = px.Workspace(docs.sparkSession, "lines")
    body = pick(docs, doc_id=doc_id, text=text)
    kind = body.dtypes[0][1]
    table = px.rarity_table(body.select("text"), _tokens(k))
    source = body.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    schema = f"doc_id {kind}, row bigint, line int, class bigint, n int, prefix array<bigint>"
    facts = space.stash(source.mapInArrow(_describe(k, share, table), schema), "lines")
    place = F.struct("doc_id", "row", "line")
    classes = space.stash(facts.groupBy("class").agg(F.min(place).alias("first"), F.max("n").alias("n")), "classes")

    # Lists of classes by prefix token, and the classes that share any.
    group = Window.partitionBy("token")
    posted = facts.where("prefix IS NOT NULL").select("class", F.posexplode("prefix").alias("at", "token"))
    lists = posted.withColumn("low", F.min("class").over(group)).withColumn("high", F.max("class").over(group)).where("low < high").select("token", "class", "at").distinct()
    lists = space.stash(lists.join(classes, "class").select("token", "class", "at", "first", "n"), "lists")
    led = lists.withColumn("lead", F.min(F.struct("first", "class", "n", "at")).over(group))
    star = led.where((F.col("class") != F.col("lead.class")) & _may_meet(F.col("lead.n"), F.col("lead.at"), F.col("n"), F.col("at"), share))
    star = space.stash(star.select(F.col("lead.class").alias("a"), F.col("class").alias("b")).distinct(), "pairs")

    # The text of one line of each such class.
    wanted = lists.groupBy("class").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"), F.struct(F.col("first.line").alias("line"), "class").alias("want"))
    wanted = wanted.groupBy("row").agg(F.collect_list("want").alias("wanted"))
    maybe = px.membership(wanted.select("row"))
    found = source.select("row", "text").where(maybe(F.col("row"))).join(wanted, "row").select("row", "text", "wanted")
    bodies = space.stash(found.mapInArrow(_wanted_lines, "class bigint, text string").groupBy("class").agg(F.min("text").alias("text")), "bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        x = bodies.select(F.col("class").alias("a"), F.col("text").alias("x"))
        y = bodies.select(F.col("class").alias("b"), F.col("text").alias("y"))
        return space.stash(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(k, share), "a bigint, b bigint"), "links")

    # a always stands before b, so b goes.
    gone = verified(star).select(F.col("b").alias("class")).distinct()
    later = lists.join(gone, "class", "left_anti").select("token", F.col("class").alias("b"), F.col("first").alias("fb"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    earlier = lists.select("token", F.col("class").alias("a"), F.col("first").alias("fa"), F.col("n").alias("na"), F.col("at").alias("ia"))
    meet = _may_meet(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib"), share)
    pairs = earlier.join(later, "token").where((F.col("fa") < F.col("fb")) & meet).select("a", "b").distinct()
    gone = gone.union(verified(pairs.join(star, ["a", "b"], "left_anti")).select(F.col("b").alias("class"))).distinct()

    fates = classes.join(gone.withColumn("gone", F.lit(True)), "class", "left").select("class", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    lost = facts.select("class", "doc_id", "row", "line").join(fates, "class").where(F.col("gone") | ~place.eqNullSafe(F.col("first")))
    lost = space.stash(lost.groupBy("row").agg(F.collect_set("line").alias("lines")), "lost")
    space.clear(lost)
    return lost


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """The documents with all their columns and a last one, ``dedup``: n_lines, n_removed and kept (the text left).

    Lines without words always stay and are not counted. A NULL text stays NULL with
    no lines. Rows equal in doc_id and text keep and lose the same lines; rows that
    share a doc_id are in the order of their hash. A NULL doc_id comes first. Columns
    of other names stay as they are; where one is called ``dedup``, the last is ``_dedup``.

    Texts that surely lose nothing (by a membership filter of fixed size) are not
    shuffled.
    """
    row, maybe, gone = spare(docs, "__row"), spare(docs, "__maybe"), spare(docs, "__gone")
    lost = repeated_lines(docs, doc_id, text, k, share).toDF(row, gone)
    drop, result = _drop_udf(), spare(docs, "dedup")
    names = [F.col(tick(c)) for c in docs.columns]
    marked = docs.withColumn(row, F.xxhash64(F.col(tick(doc_id)), F.col(tick(text))))
    marked = marked.withColumn(maybe, px.membership(lost.select(row))(F.col(row)))
    touched = marked.where(F.col(maybe)).join(lost, row, "left").select(*names, drop(F.col(tick(text)), F.col(gone)).alias(result))
    whole = marked.where(~F.col(maybe)).select(*names, drop(F.col(tick(text)), F.lit(None).cast("array<int>")).alias(result))
    return touched.union(whole)
