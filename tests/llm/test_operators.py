"""Every text operator on rows with NULLs, empty and long texts, repeats and clashing columns, against plain Python."""

import zlib
from collections import Counter

import numpy as np
import pytest
from brute_rows import brute, data
from pyspark.sql import functions as F

from ledgerlift.llm import bpe, decontam, langid, lines, ngramjoin, pii, quality, sharding, substrings, urls
from ledgerlift.llm.queries import vocabulary
from ledgerlift.llm.texts import ship

ROWS = data.ROWS


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return data.frame(spark).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    ship(spark)
    return data.empty(spark)


def same(got, want):
    a, b = Counter(map(tuple, got)), Counter(map(tuple, want))
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


def test_decontamination(spark, docs, nothing):
    bench = spark.createDataFrame(data.BENCHMARK, "item_id bigint, text string")
    digest = ["doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated"]
    want = brute.contamination(ROWS, data.BENCHMARK)
    assert sum(w[5] for w in want) > 3
    same(decontam.find_contamination(docs, bench).select(*digest).collect(), want)
    same(decontam.find_contamination(docs, bench, item_bytes=200).select(*digest).collect(), want)  # in several parts
    assert decontam.find_contamination(nothing, bench).count() == 0
    none = decontam.find_contamination(docs, bench.limit(0))
    assert none.count() == len(ROWS) and none.where("contaminated OR n_hit > 0").count() == 0
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_every_pattern(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 4, 3000)
    length = int(rng.integers(1, 15))
    words = rng.integers(1, 4, 200)
    at = np.unique(rng.integers(0, 200 - length, 20))
    keys = {tuple(words[a : a + length]): a for a in at.tolist()}
    at = np.array(sorted(keys.values()))
    first, pattern = decontam.WuManber(words, at, length).find(text)
    got = sorted((int(f), tuple(words[at[p] : at[p] + length])) for f, p in zip(first, pattern, strict=True))
    assert got == sorted((i, tuple(text[i : i + length])) for i in range(len(text) - length + 1) if tuple(text[i : i + length]) in keys)


def test_repeats(docs, nothing):
    digest = ["doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)]
    same(substrings.remove_repeats(docs).select(*digest).collect(), brute.repeats(ROWS))
    same(substrings.remove_repeats(docs, window=22).select(*digest).collect(), brute.repeats(ROWS, 22))
    assert substrings.remove_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, window=21)


def test_cover_meets_every_difference():
    differences = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert differences == set(range(substrings.PERIOD))


def test_candidates_beyond_packed_places():
    n = (1 << substrings.PLACE_BITS) + 5000
    starts = substrings.candidate_starts(np.array([1000]), n, 35)
    assert {980, 1000, (1 << 20) + 980, (1 << 20) + 1000} <= set(starts.tolist()) and len(starts) == 42


def test_lines(docs, nothing):
    found = lines.dedup_lines(docs)
    assert found.columns == [*docs.columns, "dedup"]
    kept = F.sha2(F.coalesce(F.col("dedup.kept"), F.lit("")).cast("binary"), 256)
    same(found.select("doc_id", "dedup.n_lines", "dedup.n_removed", kept).collect(), brute.line_dedup(ROWS))
    assert lines.dedup_lines(nothing).count() == 0


def test_ngram_join(docs, nothing):
    same(ngramjoin.link_documents(docs).collect(), brute.ngram_join(ROWS))
    assert ngramjoin.link_documents(nothing).count() == 0
    kept = ngramjoin.keep_one_of_each(docs)
    found = brute.groups(ROWS)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for _, n, c in found if n}) + sum(not n for _, n, _ in found)
    assert {r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()} >= {3, 4, 5, 6, 9, 13}
    assert ngramjoin.keep_one_of_each(nothing).count() == 0


def test_chain_of_near_copies(spark):
    """Neighbours in the chain are linked, its ends are far apart; a leader alone would not connect it."""
    ship(spark)
    base = [f"w{i}" for i in range(300)]
    rows = [(100 - k, " ".join([f"x{i}" if i < 8 * k else w for i, w in enumerate(base)])) for k in range(12)] + [(500 + k, " ".join(base[k:] + base[:k])) for k in range(30)]
    same(ngramjoin.link_documents(data.frame(spark, rows).repartition(4)).collect(), brute.ngram_join(rows))


def test_personal_data(docs, nothing):
    found = pii.find_personal_data(docs).collect()
    same([r[:6] for r in found], brute.personal(ROWS))
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in found)
    assert pii.find_personal_data(nothing).count() == 0


def test_personal_data_learns_other_separators(spark):
    ship(spark)
    numbers = ["4111111111111111", "5500005555555559", "340000000000009", "6011000990139424"]
    rows = [(i, f"pay by card {numbers[i % 4] if i // 4 % 2 else numbers[i % 4][:-1] + '7'} now {i}") for i in range(1200)]
    rows += [(5000, "pay by card 4111/1111/1111/1111 now 7"), (5001, "pay by card 4111/1111/1111/1112 now 7")]
    found = {r.doc_id: r for r in pii.find_personal_data(data.frame(spark, rows)).where("doc_id >= 5000").collect()}
    assert found[5000].spans == "card:12:31" and found[5000].n_card == 0
    assert found[5001].spans == ""
    assert pii.redact("pay by card 4111/1111/1111/1111 now 7", found[5000].spans) == "pay by card <card> now 7"


LOOSE_ROWS = [
    ("email", "mail to jane.doe (at) example (dot) org now"),
    ("ip", "address 10:20:130:40 is up"),
    ("card", "pay by card 4111/1111/1111/1111 now"),
    ("phone", "please call 030 1234-5678 now"),
]


def personal_rows(n):
    card = ["4111111111111111", "5500005555555559", "6011000990139424"]
    forms = (
        lambda i: f"mail to user.{i}@host{i % 7}.example.com now",
        lambda i: f"address {i % 200}.20.{i % 90 + 10}.{i % 250} is up",
        lambda i: f"pay by card {card[i % 3] if i % 8 < 4 else card[i % 3][:-1] + '7'} now x{i}",
        lambda i: f"please call +49 30 {1000 + i}-{9999 - i} now",
    )
    return [(i, forms[i % 4](i)) for i in range(n)]


def test_personal_data_adds_every_kind(spark):
    ship(spark)
    rows = personal_rows(1600) + [(5000 + i, t) for i, (_, t) in enumerate(LOOSE_ROWS)]
    rows += [(6000, "see you at example.org now"), (6001, "rows 1,2,3,4 of it"), (6002, "on 2024-01-02 we"), (6003, "address 10:20:999:40 is up")]
    found = {r.doc_id: r for r in pii.find_personal_data(data.frame(spark, rows)).where("doc_id >= 5000").collect()}
    for i, (kind, text) in enumerate(LOOSE_ROWS):
        assert found[5000 + i].base == "" and f"<{kind}>" in pii.redact(text, found[5000 + i].spans)
    assert [found[i].spans for i in range(6000, 6004)] == [""] * 4


@pytest.mark.parametrize("n, sample_texts", [(400, 3000), (1600, 500)])
def test_personal_data_needs_no_number_of_spans(spark, n, sample_texts):
    """Few texts of a kind, or one kind among very many texts of another, add spans all the same."""
    ship(spark)
    rows = personal_rows(n) if n < 1000 else [r for r in personal_rows(n) if r[0] % 4 or r[0] < 160]
    rows += [(5000 + i, t) for i, (_, t) in enumerate(LOOSE_ROWS)]
    found = {r.doc_id: r for r in pii.find_personal_data(data.frame(spark, rows), sample_texts=sample_texts).where("doc_id >= 5000").collect()}
    for i, (kind, text) in enumerate(LOOSE_ROWS):
        assert f"<{kind}>" in pii.redact(text, found[5000 + i].spans)


def test_thresholds():
    counts = np.zeros((4, 2, 2 * pii.REACH * pii.STEPS), np.int64)
    counts[0, 1, 300], counts[0, 0, 200] = 3, 9  # three examples are enough
    counts[1, 1, [300, 100]], counts[1, 0, [200, 99]] = (98, 1), (3, 1)
    counts[2, 0, 300] = 5
    assert pii.thresholds(counts) == {"email": 250.5 / pii.STEPS - pii.REACH, "ip": 250.5 / pii.STEPS - pii.REACH}


def test_sharding(docs, nothing):
    found = sharding.shard_rows(docs).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in found], [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ROWS])
    slots = {s: sorted(r.slot for r in found if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(r.row_number for r in found) == list(range(len(ROWS)))
    again = sharding.shard_rows(docs.repartition(7)).collect()
    same([(r.doc_id, r.shard, r.slot) for r in again if r.doc_id not in (1, None)], [(r.doc_id, r.shard, r.slot) for r in found if r.doc_id not in (1, None)])
    back = sharding.row_at(np.array([r.shard for r in found]), np.array([r.slot for r in found]), len(ROWS))
    assert back.tolist() == [r.row_number for r in found]
    assert sharding.shard_rows(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 99_991])
def test_permutation(n):
    numbers = np.arange(n)
    placed = sharding.permute(numbers, n)
    assert sorted(placed.tolist()) == list(range(n))
    assert (sharding._walk(sharding._backward, placed, n) == numbers).all()
    if n >= 1000:  # neighbours do not stay together
        assert (np.abs(np.diff(placed)) <= 2).mean() < 0.05


def test_bpe(docs, nothing):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary())
    want = []
    for doc, text in ROWS:
        ids = own.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), np.array(ids, "<u4").tobytes(), own.decode(ids, skip_special_tokens=False)))
    same([(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.tokenize(docs, vocabulary()).collect()], want)
    assert bpe.tokenize(docs, vocabulary(), keep=("odd.name", "hash")).columns == ["doc_id", "n_tokens", "ids", "decoded", "odd.name", "hash"]
    assert bpe.tokenize(nothing, vocabulary()).count() == 0


def test_bpe_small_tables(monkeypatch):
    """Tables that start anew all the time change nothing; letters of many scripts, one by one."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "TABLE_ARCS", 50)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    coder, own = bpe.Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    texts = [f"A{chr(c)}b1{chr(c)}É {chr(c)}" for c in [*range(1, 0x500), *range(0x1E00, 0x2200), *range(0x3040, 0x3060), 0x1F600]] + ["aaaaaaaaaa", "ababababab", "''s 're's"]
    for i in range(0, len(texts), 300):
        for text, ids in zip(texts[i : i + 300], coder.encode(texts[i : i + 300]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_urls(spark):
    ship(spark)
    pages = [
        (1, "https://A.Example.ORG/es/x?y#z"), (2, "http://example.org/en/12"), (3, "http://org/"), (4, "http://borg/"), (5, "https://org"), (6, "x.com/fr/"),
        (7, None), (8, ""), (9, "ftp://a.com/fr"), (10, "ftp://a.com/fr/"), (11, "http://de.com/de/?a"), (12, "http://x.example.net?q=/de/"), (13, "://"), (14, "http://ORG./x"),
        (15, "http://.org/a"), (16, "http://example.org/en/2"), (None, "http://q.com/de/"), (1, "https://A.Example.ORG/es/x?y#z"), (17, "http://ÄÖ.com/de/" + "s/" * 20_000),
    ]
    frame = spark.createDataFrame(pages, "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS rule", "'x' AS `a.b`")
    rules = spark.createDataFrame([*urls.RULES, ("block", "com", None), ("allow", "com", "/de/")], "verdict string, host string, path string")

    def want(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
            host, slash, path = rest[:cut].partition("/")
            host, path = brute.low(host), slash + path
        fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, "allow", None)
        return host, path, best[2], best[1]

    expected = [(p, *want(u)) for p, u in pages]
    same(urls.judge_urls(frame, rules).collect(), expected)
    same(urls.judge_urls(frame, rules, trie_bytes=10).collect(), expected)  # several tries, one after the other
    assert urls.judge_urls(frame.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(frame, rules.limit(0), default="block").collect()} == {"block"}
    wide = spark.createDataFrame([("block", "com", ""), ("allow", "b.com", "/x")], "verdict string, host string, path string")
    few = spark.createDataFrame([(1, "http://b.com/y"), (2, "http://b.com/xy"), (3, "http://b.com")], "page_id bigint, url string")
    same([(r.page_id, r.rule, r.verdict) for r in urls.judge_urls(few, wide).collect()], [(1, "com", "block"), (2, "b.com/x", "allow"), (3, "com", "block")])


def test_quality(docs, nothing):
    found = quality.score_quality(docs).collect()
    same([(*r[:6], r.base_failed) for r in found], brute.quality(ROWS))
    same([(r.doc_id, r.kept) for r in found], [(d, brute.good((d, t))) for d, t in ROWS])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(map(brute.good, ROWS))
    assert quality.score_quality(nothing).count() == 0


def test_quality_compares_words_under_one_hash(monkeypatch):
    monkeypatch.setattr(quality, "mix", lambda x: x * np.uint64(0))
    ids = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 9])
    assert quality.repeated_words(ids, 5).tolist() == [True] * 5 + [False] + [True] * 5 + [False]


def test_language(spark, docs, nothing):
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "b").when(F.col("doc_id") < 15, "a"))
    found = {r.doc_id: r for r in langid.identify(labelled).where("doc_id <> 1").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in found.items())
    assert {d for d, r in found.items() if r.lang_pred == "und"} == {4, 5, 6}
    assert all(r.lang_pred in ("a", "b", "und") and 0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(nothing.withColumn("lang", F.lit("x"))).count() == 0


def test_numeric_signs_are_no_letters(spark):
    ship(spark)
    rows = [(i, f"plain words of text number {i}", "en") for i in range(40)] + [(100, "½ ① Ⅷ ²", "en"), (101, "½ plain words", "en")]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert (found[100].lang_pred, found[100].accepted, found[101].lang_pred) == ("und", False, "en")
    assert langid.letters("½ ① Ⅷ") == [] and langid.letters("½ ab Ⅷé") == ["ab", "é"]


def test_line_dedup_keeps_a_column_of_its_name(spark, docs):
    found = lines.dedup_lines(docs.withColumn("dedup", F.lit(7)))
    assert found.columns == [*docs.columns, "dedup", "_dedup"]
    same(found.select("dedup", "_dedup.n_lines").collect(), [(7, n) for (n,) in lines.dedup_lines(docs).select("dedup.n_lines").collect()])


def test_bpe_digests(spark, docs):
    plain = bpe.tokenize(docs, vocabulary()).select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256))
    short = bpe.tokenize(docs, vocabulary(), digest=True, keep=("class",))
    assert short.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256", "class"]
    same(short.drop("class").collect(), plain.collect())
