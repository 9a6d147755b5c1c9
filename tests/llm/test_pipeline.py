"""The pipeline against plain Python, stage after stage."""

import numpy as np
import pytest
from brute_rows import brute, data
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlift.llm.queries import table, vocabulary


def expected(rows, benchmark):
    """Text of every document that is left before it is encoded."""
    rows = [r for r in rows if brute.good(r)]
    holders, kept = [], []
    for doc, text in sorted(rows):
        lines, before = [], len(holders)
        for line in (text or "").split("\n"):
            w = brute.WORD.findall(line)
            own = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            if not w or not any(5 * len(own & o) >= 4 * len(own | o) for o in holders):
                lines.append(line)
            if w:
                holders.append(own)
        had = len(holders) - before
        left = sum(bool(brute.WORD.search(x)) for x in lines)
        if left or not had:
            kept.append((doc, "\n".join(lines)))
    found = brute.groups(kept)
    first = {}
    for (doc, text), (_, n, c) in zip(kept, found, strict=True):
        if n:
            first[c] = min(first.get(c, (doc, text)), (doc, text))
    kept = sorted([*first.values(), *[r for r, f in zip(kept, found, strict=True) if not f[1]]])
    dirty = {w[0] for w in brute.contamination(kept, benchmark) if w[5]}
    return {doc: text for doc, text in kept if doc not in dirty}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = data.words(400, 20)
    rows = [(i, "\n".join([" ".join(data.words(30, 100 + i)), " ".join(data.words(25, 200 + i))])) for i in range(30)]
    rows += [(40 + k, " ".join(base[: 390 - k] + [f"own{k}"] + base[391 - k :])) for k in range(6)]  # near copies, one line each
    rows += [(50, " ".join(base)), (51, " ".join(data.words(60, 60) + data.PASSAGE)), (52, "word " * 50), (53, rows[3][1]), (54, rows[4][1] + "\nand one more line that is its own here today")]
    where = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    docs.write.parquet(f"{where}/documents.parquet")
    bench = [(1, " ".join(data.PASSAGE))]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, bench


def test_pipeline(spark, folder):
    from tokenizers import Tokenizer

    where, rows, bench = folder
    own = Tokenizer.from_file(vocabulary())
    want = {}
    for doc, text in expected(rows, bench).items():
        ids = own.encode(text, add_special_tokens=False).ids
        want[doc] = (len(text), len(ids), np.array(ids, "<u4").tobytes(), brute.sha(own.decode(ids, skip_special_tokens=False)))
    found = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id: (r.n_chars, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in found} == want
    assert not {51, 52, 53} & set(want) and 54 in want and len(want) < len(rows) - 3


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        nothing = stage(spark, docs.limit(0), folder[0])
        assert nothing.columns == docs.columns and nothing.count() == 0


def test_decontamination_takes_one_python_worker_a_task(spark, sf):
    docs = table(spark, sf, "documents")
    plan = corpus_pipeline.clean_documents(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_pipeline_hands_texts_over_in_small_batches(spark, sf):
    import pyarrow as pa
    from pyspark.sql import functions as F

    def size(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    docs = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    corpus_pipeline.prepare(spark)
    assert docs.select(F.arrow_udf(size, "bigint")("text").alias("n")).agg(F.max("n")).first()[0] <= 2 * corpus_pipeline.BATCH_BYTES
