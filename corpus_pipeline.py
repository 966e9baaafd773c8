"""The corpus pipeline: quality, near duplicates, repeated substrings, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`; all but the last return the columns of documents. Rows of null or
empty texts are scored, kept or dropped like any other. Rows of a null doc_id are scored by the first stage; the stages after it name
documents by doc_id, so they let such rows pass. A repeated doc_id stands or falls with all its rows. An empty table gives empty stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm import chunk_dedup, decontaminate, near_dedup, packing, quality
from tipoff.llm.common import read, tokenizer_path, written

#: Documents that score lower go.
LEAST_QUALITY = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on labelled rows of `docs` and drop what scores under LEAST_QUALITY."""
    machine = quality.fit(docs, read(spark, sf_dir, "labels"))
    out = quality.scored(docs, machine, keep=COLUMNS[1:])
    return out.filter(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by a similarity of 0.8 or more of five-word shingles stays: that of the least id."""
    named = docs.filter(F.col("doc_id").isNotNull())
    gone = near_dedup.near_duplicates(named, width=5, percent=80).filter("NOT kept").select("doc_id")
    return docs.hint("merge").join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of chunks that stand elsewhere first are cut out; n_chars follows the text."""
    out = chunk_dedup.deduplicated(docs).select("row.*", "text")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with its own or other values, go."""
    leaks = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id")
    return docs.hint("merge").join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as the genetic search finds: one row for each piece."""
    return packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_substrings),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", best_fit_packing),
]
#: The stages learn a model, hash and search; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"pipeline-{name}")
    return docs
