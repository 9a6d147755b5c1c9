"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlift.llm import bpe, decontam, lines, ngramjoin, quality
from ledgerlift.llm.prefixes import Workspace
from ledgerlift.llm.queries import table, vocabulary
from ledgerlift.llm.texts import ship, tick


BATCH_BYTES = 4 << 20  # of a batch handed to a Python worker; Spark's own limit of 10,000 texts is tens of MB on both sides


def prepare(spark: SparkSession) -> None:
    """What every stage needs of the session: this package on the executors, and batches of texts that stay small."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. NULL, empty and short texts fail them and go; repeated rows share a fate; an empty table stays empty."""
    prepare(spark)
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; n_chars, if there, follows. A document with no line left goes.

    Texts without words, NULL among them, lose nothing and stay. Rows equal in doc_id
    and text lose the same lines; other columns, whatever their names, go along.
    """
    prepare(spark)
    found = lines.dedup_lines(docs)
    result = F.col(tick(found.columns[-1]))
    left = found.where((result["n_removed"] == 0) | (result["n_removed"] < result["n_lines"]))
    own = {"text": result["kept"]}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(result["n_removed"] > 0, F.length(result["kept"]).cast("bigint")).otherwise(F.col("n_chars"))
    return left.select(*[own.get(c, F.col(tick(c))).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, NULL before all, of rows that share it one. Texts without words all stay."""
    prepare(spark)
    return ngramjoin.keep_one_of_each(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. NULL and empty texts, and all texts where the benchmark is empty, stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a checksum of what they decode to, and its own columns but the text.

    NULL and empty texts have no tokens. A column that has the name of a result is
    left out; an empty table stays empty.
    """
    prepare(spark)
    results = ("doc_id", "text", "n_tokens", "ids", "decoded", "decoded_sha256")
    return bpe.tokenize(docs, vocabulary(), keep=tuple(c for c in docs.columns if c not in results), digest=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("decontaminate", clean_documents),
    ("bpe", tokens),
]

ORACLE_SQL = None  # BPE has no SQL form; tests/llm hold the pipeline against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. What a stage returned lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    space = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = space.stash(stage(spark, docs, sf_dir), name)
        space.clear(docs)
    return docs
