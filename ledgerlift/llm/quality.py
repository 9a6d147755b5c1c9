"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Rolling hashes of several n-gram lengths are compared inside each text; windows
whose hashes agree are then compared word by word, so nothing rests on a hash. The
share of a text's characters that lies inside repeated n-grams (or repeated lines)
is held against one limit per length.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlift.llm.texts import longs, mix, pick, spare, text_udf, tick

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
# Percent of a text's word characters that may lie inside repeated n-grams of each length, and inside repeated lines.
LIMITS = {5: 20, 6: 20, 7: 20, 8: 20, 9: 20, 10: 20}
LINE_PERCENT = 50
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"chars_{n}" for n in LIMITS]]
DDL = "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that occurs at least twice in ``ids``, the first occurrence included."""
    marked = np.zeros(len(ids), bool)
    windows = len(ids) - n + 1
    if windows < 2:
        return marked
    spread = mix(ids.astype(np.uint64) + np.uint64(1))
    rolled = np.zeros(windows, np.uint64)
    for j in range(n):
        rolled = rolled * _BASE + spread[j : j + windows]
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return marked
    left, right = order[:-1][same], order[1:][same]
    equal = np.ones(len(left), bool)
    for j in range(n):
        equal &= ids[left + j] == ids[right + j]
    if not equal.all():  # different windows under one hash: compare by their words
        seen: dict[tuple, int] = {}
        hits = set()
        for i in range(windows):
            first = seen.setdefault(tuple(ids[i : i + n].tolist()), i)
            if first != i:
                hits.update((first, i))
        where = np.array(sorted(hits), np.int64)
    else:
        where = np.concatenate([left, right])
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, where, 1)
    np.add.at(edges, where + n, -1)
    return np.cumsum(edges[:-1]) > 0


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "surrogatepass"))


def measure(text: bytes | None) -> list[int]:
    """The counts of FIELDS for one text."""
    if not text:
        return [0] * len(FIELDS)
    words = text.split()
    word_chars = code_points(text) - (len(text) - sum(map(len, words)))
    ids = np.fromiter(map(defaultdict(count().__next__).__getitem__, words), np.int64, len(words))
    seen: set[bytes] = set()
    n_dup_lines = dup_chars = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                n_dup_lines += 1
                dup_chars += sum(map(code_points, line.split()))
            elif line.strip(BLANKS):
                seen.add(line)
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeat = repeated_words(ids, REPEAT_WINDOW)
    chars = [0] * len(LIMITS)
    if repeat.any():  # a longer window can repeat only where shorter ones do
        lengths = np.fromiter(map(code_points, words), np.int64, len(words))
        chars = [int(lengths[repeat if n == REPEAT_WINDOW else repeated_words(ids, n)].sum()) for n in LIMITS]
    return [len(words), word_chars, n_symbols, n_dup_lines, int(repeat.sum()), dup_chars, *chars]


def _measure_all(texts: list[bytes | None]) -> list[pa.Array]:
    table = np.array([measure(t) for t in texts], np.int64).reshape(len(texts), len(FIELDS))
    return [longs(np.ascontiguousarray(table[:, i])) for i in range(len(FIELDS))]


def _verdict(q):
    base_failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > REPEAT_PERCENT * q["n_words"])
    covered = F.lit(False)
    for n, percent in LIMITS.items():
        covered = covered | (100 * q[f"chars_{n}"] > percent * q["word_chars"])
    covered = covered | (100 * q["dup_line_chars"] > LINE_PERCENT * q["word_chars"])
    return base_failed, ~(base_failed | covered)


def score_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: counts, characters inside repeats, base_failed and kept.

    NULL and empty texts have no words: all counts 0, base_failed true, kept false.
    Repeated rows are judged each for itself; nothing crosses documents, so there is
    no shuffle. Extra columns are ignored.
    """
    q = F.col("__q")
    base_failed, kept = _verdict(q)
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("__q", text_udf(_measure_all, DDL, FIELDS)(F.col("text")))
    return rows.select("doc_id", *[q[f].alias(f) for f in FIELDS], base_failed.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose verdict is kept, with their own columns."""
    q = spare(docs, "__q")
    rows = docs.withColumn(q, text_udf(_measure_all, DDL, FIELDS)(F.col(tick(text))))
    return rows.where(_verdict(F.col(q))[1]).drop(q)
