"""Whitening, ranked search and packing against numpy, plain Python and the tokenizers library."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute_rows import data
from test_operators import same

from ledgerlift.llm import lexical, packing, whitening
from ledgerlift.llm.decontam import words_of
from ledgerlift.llm.queries import QUERIES, vocabulary
from ledgerlift.llm.texts import ship

BYTE_BPE = vocabulary("byte_bpe_50k.json")


# ---- whitening --------------------------------------------------------------------------
def whitened(vectors, k=8):
    """Values, explained shares and exact deviations by a dense decomposition."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return c @ u / np.sqrt(e), e / (c**2).sum() * n, [sum(int(v) ** 2 for v in row) for row in n * x.astype(object) - s]


def agree(rows, ids, vectors, k):
    want, explained, deviation = whitened(vectors, k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * k
    found = np.array([[got[i, j + 1].whitened for j in range(k)] for i in ids])
    assert np.abs(found * np.sign((found * want).sum(axis=0)) - want).max() < 1e-9
    for row, i in enumerate(ids):
        r = got[i, 1]
        assert int(r.deviation) == deviation[row] and r.n == len(ids) and r.identity_error < 1e-10
        assert all(abs(got[i, j + 1].explained / explained[j] - 1) < 1e-10 for j in range(k))


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "'x' AS n", "1 AS vec", "2 AS d")


def test_whitening_against_a_dense_decomposition(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((400, 40)) * np.linspace(1, 3, 40)).astype(np.float32).tolist()
    odd = [(900, None, 1), (901, [], 1), (902, [None] * 40, 1), (903, [1.0] * 39 + [float("nan")], 1), (904, [float("inf")] * 40, 1), (905, [1.0] * 7, 1)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    found = whitening.whiten(frame_of(spark, rows + odd).repartition(5)).collect()
    agree(found, list(range(400)), vectors, 8)


def test_whitening_of_few_and_equal_vectors(spark):
    assert whitening.whiten(frame_of(spark, [])).count() == 0
    assert whitening.whiten(frame_of(spark, [(1, None, 0)])).count() == 0
    assert whitening.whiten(frame_of(spark, [(1, [0.5, 0.25], 0)])).count() == 0
    assert whitening.whiten(frame_of(spark, [(1, [0.5, 0.25], 0)] * 50)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 7.0], 0) for i in range(20)]  # one direction of variance
    assert {r.component for r in whitening.whiten(frame_of(spark, flat)).collect()} == {1}
    repeated = whitening.whiten(frame_of(spark, [(None, [1.0, 0.0], 0), (None, [0.0, 1.5], 0), (7, [0.0, 1.5], 0)])).collect()
    assert Counter(r.vec_id for r in repeated) == {None: 2 * 1, 7: 1}
    huge = whitening.whiten(frame_of(spark, [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 3.0], 0)])).collect()
    assert {r.vec_id: r.deviation is None for r in huge} == {1: True, 2: True, 3: False}  # over 38 digits


def test_spectrum_certifies_close_and_equal_values():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    for values in (np.linspace(1, 1.02, 60), np.repeat([5.0, 2.0, 1.0], 20), np.concatenate([[1e6], np.linspace(1, 2, 59)]), np.eye(60)[0]):
        v = (q * values) @ q.T
        found, u = whitening.Spectrum(lambda x, v=v: v @ x, 60, 8).solve()
        want = np.sort(values)[::-1][:8]
        want = want[want > 1e-12 * want[0]]
        assert np.abs(found - want).max() < 1e-11 * want[0]
        assert np.abs(v @ u - u * found).max() < 1e-10 * want[0] and np.abs(u.T @ u - np.eye(len(found))).max() < 1e-12


def test_whitening_query(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{sf}/embeddings.parquet')").fetchall()
    agree(QUERIES["op11_whitening"](spark, sf).collect(), [r[0] for r in rows], [r[1] for r in rows], 8)


# ---- ranked search ----------------------------------------------------------------------
def ranked(docs, benchmark, k=50):
    counts = [(d, Counter(words_of(t.encode())) if t else {}) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    items = defaultdict(set)
    for item, text in benchmark:
        items[item] |= set(words_of(text.encode())) if text else set()
    out = []
    for item, terms in items.items():
        scored = []
        for d, c, size in counts:
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_ranked_search(spark):
    ship(spark)
    docs, bench = data.frame(spark).repartition(4), spark.createDataFrame(data.BENCHMARK, "item_id bigint, text string")
    for k in (1, 3, 50):
        same(lexical.rank_documents(docs, bench, k=k).collect(), ranked(data.ROWS, data.BENCHMARK, k))
    same(lexical.rank_documents(docs, bench, item_bytes=300).collect(), ranked(data.ROWS, data.BENCHMARK))  # in several parts
    assert lexical.rank_documents(data.empty(spark), bench).count() == 0
    assert lexical.rank_documents(docs, bench.limit(0)).count() == 0
    assert lexical.rank_documents(docs, bench.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_go_by_document(spark):
    ship(spark)
    rows = [(i, "same words here") for i in range(300)] + [(1000 + i, f"other text {i}") for i in range(300)]
    bench = [(1, "same words"), (2, "words words other"), (3, "nothing of it")]
    found = lexical.rank_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), spark.createDataFrame(bench, "item_id int, text string"), k=20)
    same(found.collect(), ranked(rows, bench, 20))


@pytest.mark.parametrize("seed", range(8))
def test_best_positions_keep_the_best(seed):
    """Against all scores; flat, steep and tied impacts, with and without a score to beat."""
    r = np.random.default_rng(seed)
    n_docs, n_terms = 400, 30
    lists = [np.sort(r.choice(n_terms, r.integers(1, 12), replace=False)) for _ in range(n_docs)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    terms = np.concatenate(lists)
    counts = r.integers(1, 2 + seed, len(terms))
    n = np.array([int(counts[a:b].sum()) + int(r.integers(0, 1 + 10 * seed)) for a, b in zip(starts[:-1], starts[1:], strict=True)])
    stats = lexical.Statistics(n_docs, int(n.sum()), r.integers(0, 3 + 900 * (seed % 2), n_terms))
    built = lexical.ImpactLists(n, starts, terms, counts, stats)
    impact = stats.impact(terms, counts, n[np.repeat(np.arange(n_docs), np.diff(starts))])
    for _ in range(20):
        asked = r.choice(n_terms, int(r.integers(1, 10)), replace=False)
        whole = np.array([impact[a:b][np.isin(terms[a:b], asked)].sum() for a, b in zip(starts[:-1], starts[1:], strict=True)])
        k = int(r.integers(1, 60))
        floor = int(np.sort(whole)[-min(k, n_docs)]) if r.random() < 0.5 else None
        docs, scores = built.search(asked, k, floor)
        assert (whole[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
        least = max(floor or 0, int(np.sort(whole)[-k]))
        assert set(np.flatnonzero((whole >= least) & (whole > 0)).tolist()) <= set(docs.tolist())


# ---- packing ----------------------------------------------------------------------------
def pieces_of(rows, length, end_id=0):
    from tokenizers import Tokenizer

    own, out = Tokenizer.from_file(BYTE_BPE), []
    for doc, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, end_id]
        first = len(ids) % length if len(ids) > length else len(ids)
        cuts = [0] * bool(first) + list(range(first, len(ids), length)) + [len(ids)]
        for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            out.append((doc, p, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
    return out


def packed_right(found, rows, length, slack=0):
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], want := pieces_of(rows, length))
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = 0
        for at, n in sorted(parts):
            assert at == ends
            ends += n
        assert ends <= length
    plain = len(packing.best_fit(np.array([w[3] for w in want]), length)[2]) if want else 0
    assert len(bins) <= plain + slack
    return len(bins)


def test_packing(spark):
    ship(spark)
    docs = data.frame(spark).repartition(3)
    found = packing.pack_documents(docs, BYTE_BPE).collect()
    packed_right(found, data.ROWS, 2048, 1)
    assert packing.pack_documents(data.empty(spark), BYTE_BPE).count() == 0
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in found)


def test_packing_in_many_rounds(spark):
    """Small groups and short sequences: later rounds close what tasks leave open, and stop where nothing fits."""
    ship(spark)
    r = random.Random(5)
    rows = [(i, " ".join(["on"] * r.randint(0, 30))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40)
    for group in (4, 64, 1 << 17):
        packed_right(packing.pack_documents(df, BYTE_BPE, length=24, group_items=group, slack=0).collect(), rows, 24, {4: 40, 64: 20}.get(group, 12))
    alone = [(i, " ".join(["on"] * 12)) for i in range(200)]  # 13 of 24: no two fit
    df = spark.createDataFrame(alone, "doc_id bigint, text string").repartition(20)
    assert packed_right(packing.pack_documents(df, BYTE_BPE, length=24, group_items=8).collect(), alone, 24) == 200


def test_sequences_hold_their_pieces(spark):
    ship(spark)
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 40)) for i in range(60)], "doc_id bigint, text string")
    pieces = packing.pack_documents(docs, BYTE_BPE, length=64)
    own = defaultdict(list)
    for r in pieces.collect():
        own[r.sequence_id].append((r.offset, bytes(r.ids), r.doc_id))
    for r in packing.sequences(pieces).collect():
        parts = sorted(own.pop(r.sequence_id))
        assert bytes(r.ids) == b"".join(p[1] for p in parts) and r.n_tokens * 4 == len(r.ids) and r.doc_ids == [p[2] for p in parts]
    assert not own


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    own, encode, r = Tokenizer.from_file(BYTE_BPE), packing.Encoder(BYTE_BPE), random.Random(3)
    pool = " \t\n\r\x0b\x0c\x1c\x85\xa0'aZ_9½Ⅷß日本😀́–.s'tll've're<|endoftext|>éñ٣𝟘ǅªº"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["a<|endoftext|>b  c", " \n x", "x" * 30_000, " " * 5000 + "y", "word it's " * 300_000]
    want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encode(texts)] == want
    assert encode.fast is not None and len(encode.parts(texts[-1])) > 1


def test_packing_query(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()
    packed_right(QUERIES["op13_packing"](spark, sf).collect(), rows, 2048, 1)
