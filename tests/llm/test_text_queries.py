"""The registered text queries over whole tables, against plain Python, and their SQL against the same."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute_rows import brute

import __spark_entry__ as entry
from ledgerlift.llm.queries import ORACLES, QUERIES, vocabulary


@pytest.fixture(scope="module")
def rows(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()


@pytest.fixture(scope="module")
def benchmark(sf):
    return duckdb.sql(f"SELECT item_id, text FROM read_parquet('{sf}/benchmark.parquet')").fetchall()


def same(got, want):
    a, b = Counter(map(tuple, got)), Counter(map(tuple, want))
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(ORACLES) <= set(entry.oracle_sql())


def wanted(name, rows, benchmark):
    return {
        "op1_decontaminate": lambda: brute.contamination(rows, benchmark),
        "op2_repeats": lambda: brute.repeats(rows),
        "op3_line_dedup": lambda: brute.line_dedup(rows),
        "op4_ngram_join": lambda: brute.ngram_join(rows),
        "op9_quality": lambda: [(*q, brute.good(r)) for q, r in zip(brute.quality(rows), rows, strict=True)],
    }[name]()


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_repeats", "op3_line_dedup", "op4_ngram_join", "op9_quality"])
def test_query(spark, sf, rows, benchmark, name):
    df = QUERIES[name](spark, sf)
    same(df.collect(), wanted(name, rows, benchmark))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    from oracle import compare

    assert compare(spark, name, QUERIES[name], ORACLES[name], sf) is None


def test_personal_data(spark, sf, rows):
    found = QUERIES["op5_personal_data"](spark, sf).collect()
    same([r[:6] for r in found], [(*w[:5], brute.sha(w[5])) for w in brute.personal(rows)])


def test_shards(spark, sf, rows):
    found = QUERIES["op6_shard"](spark, sf).collect()
    same([(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in found], [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for d, t in rows])
    slots = [sorted(r.slot for r in found if r.shard == s) for s in range(16)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_tokens(spark, sf, rows):
    import hashlib

    from tokenizers import Tokenizer

    own, want = Tokenizer.from_file(vocabulary()), []
    for doc, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(own.decode(ids, skip_special_tokens=False))))
    same(QUERIES["op7_bpe"](spark, sf).collect(), want)


def test_language_accuracy(spark, sf):
    """At least 98 of 100 held-out documents."""
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM read_parquet('{sf}/documents.parquet')").fetchall())
    found = [r for r in QUERIES["op10_language"](spark, sf).collect() if r.held_out]
    assert {r.doc_id for r in found} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found]) >= 0.98
