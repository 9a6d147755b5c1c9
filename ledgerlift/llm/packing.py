"""Best-fit packing of documents into sequences, hierarchically.

Documents are tokenized and cut where they lie; each task packs what it holds in
memory best-fit, longest piece first. Sequences that are nearly full are done. The
others become items of their filled size: they are dealt into groups and packed
best-fit again, round after round with fewer groups, until one group has been
packed or a round closes no gaps any more. Where a piece ends up follows from the
few rows (child, parent, place) that each round writes.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlift.llm.prefixes import Workspace
from ledgerlift.llm.texts import PACKED_BYTES, give_back, pick, ship, slices

LENGTH = 2048
SLACK = 2  # tokens a sequence may lack and still be done before the last round
HELD_BYTES = 24 << 20  # ids that a task packs at a time
GROUP_ITEMS = 1 << 17  # open sequences that a later round packs at a time
LONG_TEXT = 1 << 20  # longer texts are handed to the tokenizer in parts


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, place) of each item and the fill of each bin: longest first, each into the fullest bin that has room."""
    bins, places, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: some bin has room for exactly r
    order = np.argsort(-sizes, kind="stable").tolist()
    listed = sizes.tolist()
    for i in order:
        size = listed[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            b, room = len(fill), length
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(b)
    return bins, places, np.array(fill, np.int64)


# Fixed value: where a byte-level pre-tokenizer cuts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 1000  # texts with a longer run without a blank are left to the library


def _settled(c: str) -> bool:
    """Whether every library takes a character for the same: its class stands since Unicode 3.2, and it is no odd blank or control."""
    kind = unicodedata.category(c)
    return c in " \t\n\r\f\v" or kind == unicodedata.ucd_3_2_0.category(c) and kind[0] not in "CZ"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _ranks(rules: dict, special: list[str]) -> dict[bytes, int] | None:
    """Bytes of each token with its id, if ids alone say which merge comes first; else None."""
    cut, model = rules["pre_tokenizer"] or {}, rules["model"]
    plain = rules["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    odd = ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")
    if not plain or model["type"] != "BPE" or any(model.get(k) for k in odd):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab, letters = model["vocab"], {c: b for b, c in _byte_letters().items()}
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    return {bytes(letters[c] for c in w): i for w, i in vocab.items() if w not in special}


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them.

    Where the file is a plain byte-level vocabulary numbered in the order of its
    merges, the same ranks are run by tiktoken, which is several times faster. Texts
    with characters whose class differs between Unicode versions, with a special
    token's name or with very long words go to the tokenizers library, as do all
    texts of any other kind of file. Very long texts go in parts, cut where the
    pre-tokenizer cuts as well: ahead of a blank between two letters.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "tokenizer": None}

    def _load(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.settled: dict[str, bool] = {}
        ranks = _ranks(json.loads(self.tokenizer.to_str()), self.special)
        self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    @staticmethod
    def parts(text: str, most: int = LONG_TEXT) -> list[str]:
        out, start = [], 0
        while len(text) - start > most:
            cut = start + most
            while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isascii() and text[cut - 1].isalpha() and text[cut + 1].isascii() and text[cut + 1].isalpha()):
                cut += 1
            if cut >= len(text) - 1:
                break
            out.append(text[start:cut])
            start = cut
        return [*out, text[start:]]

    def _is_plain(self, text: str) -> bool:
        chars = set(text)
        for c in chars.difference(self.settled):
            self.settled[c] = _settled(c)
        short = max(map(len, text.split(" "))) < LONG_WORD and " " * LONG_WORD not in text
        return short and all(map(self.settled.__getitem__, chars)) and not any(s in text for s in self.special)

    def _ids(self, text: str) -> np.ndarray:
        if self.fast is not None and self._is_plain(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.tokenizer is None:
            self._load()
        return [np.concatenate([self._ids(p) for p in self.parts(t)]) for t in texts]


def _cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than a sequence."""
    first = n % length if n > length else n
    starts = [0] if first else []
    return [(s, first) for s in starts] + [(s, length) for s in range(first, n, length)]


_PIECE = "piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, bin bigint, at bigint, fill bigint"


def _first_round(docs: DataFrame, kind: str, path: str, length: int, end_id: int) -> DataFrame:
    """Pieces of all documents, packed by task: their bin, place in it and the bin's fill. A bin is named by a number of its own."""
    encode = Encoder(path)
    names = ["doc_id", *[c.split(" ")[0] for c in _PIECE.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, held_bytes, id_type = 0, [], 0, None
        own = TaskContext.get().partitionId() << 36

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, held_bytes
            sizes = np.array([len(x[3]) for x in held], np.int64)
            bins, places, fill = best_fit(sizes, length)
            for start in range(0, len(held), 2048):
                rows, b = held[start : start + 2048], bins[start : start + 2048]
                columns = [
                    pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array(sizes[start : start + 2048]),
                    pa.array([r[3].tobytes() for r in rows], pa.binary()), pa.array([zlib.crc32(r[3].tobytes()) for r in rows], pa.int64()),
                    pa.array(b + (own + made)), pa.array(places[start : start + 2048]), pa.array(fill[b]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
            made, held, held_bytes = made + len(fill), [], 0

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids = batch.column(0)
            for first, texts in slices(batch.column(1), PACKED_BYTES):
                tokens = encode([t.decode() if t else "" for t in texts])
                for i, found in enumerate(tokens):
                    found = np.append(found, np.uint32(end_id)).astype("<u4", copy=False)
                    doc = ids[first + i].as_py()
                    held += [(doc, p, s, found[s : s + n]) for p, (s, n) in enumerate(_cuts(len(found), length))]
                    held_bytes += 4 * len(found) + 400
                if held_bytes > HELD_BYTES:
                    yield from packed()
            give_back()
        if held:
            yield from packed()

    return docs.mapInArrow(run, f"doc_id {kind}, {_PIECE}")


def _next_round(items: DataFrame, groups: int, length: int) -> DataFrame:
    """Open bins packed again within their groups: (child, parent, at, fill); a parent has the name of its first child."""

    def run(table: pa.Table) -> pa.Table:
        name, sizes = table.column("bin").to_numpy(), table.column("fill").to_numpy()
        bins, places, fill = best_fit(sizes, length)
        first = np.zeros(len(fill), np.int64)
        first[bins[places == 0]] = name[places == 0]
        return pa.table({"child": name, "parent": first[bins], "at": places, "fill": fill[bins]})

    dealt = items.withColumn("group", F.pmod(F.xxhash64("bin"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, "child bigint, parent bigint, at bigint, fill bigint")


def pack_documents(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = 0, slack: int = SLACK, group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids (little-endian 32-bit), ids_crc32, sequence_id, offset.

    ``tokenizer`` is a tokenizers file with a byte-level pre-tokenizer, in a place that
    every executor has. A document is its ids and ``end_id``, so NULL and empty text
    are one token. Documents of more than ``length`` tokens are cut from their end, so
    only the first piece may be shorter. Repeated rows and NULL ids are documents of
    their own; an empty table gives no rows; other columns are not looked at.

    A task holds at most HELD_BYTES of ids (a longer text alone), a later round at most
    about ``group_items`` sequences a group; rounds end when all open sequences were in
    one group or fewer than one in a hundred went.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "packing")
    source, kind = pick(docs, doc_id=doc_id, text=text), dict(docs.dtypes)[doc_id]
    pieces = space.stash(_first_round(source, kind, tokenizer, length, end_id), "pieces")
    is_open = F.col("fill") < length - slack
    items = pieces.where((F.col("at") == 0) & is_open).select("bin", "fill")
    places = pieces
    before, rounds = None, 0
    while True:
        count = items.count()
        groups = max(1, -(-count // group_items))
        if count < 2 or before is not None and count > 0.99 * before:
            break
        rounds += 1
        moved = space.stash(_next_round(items, groups, length), f"round{rounds}")
        steps = moved.select(F.col("child").alias("bin"), "parent", F.col("at").alias("further"))
        joined = places.join(steps, "bin", "left")
        at = F.col("at") + F.coalesce(F.col("further"), F.lit(0))
        rest = [c for c in places.columns if c not in ("bin", "at")]
        places = joined.select(*rest, F.coalesce("parent", "bin").alias("bin"), at.alias("at"))
        items = moved.where((F.col("at") == 0) & is_open).select(F.col("parent").alias("bin"), "fill")
        if groups == 1:
            break
        before = count
    return places.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (all pieces in order), n_tokens, doc_ids. A sequence's pieces are never more than its tokens."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length"))).alias("p"))
    return rows.select(
        "sequence_id", F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["ids"])), "")).alias("ids"),
        F.aggregate("p", F.lit(0).cast("bigint"), lambda n, p: n + p["length"]).alias("n_tokens"), F.transform("p", lambda p: p["doc_id"]).alias("doc_ids"),
    )
