"""The opN queries as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm.common import read, tokenizer_path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm.packing import packed_documents

    return packed_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm.chunk_dedup import deduplicated

    done = deduplicated(read(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm import quality

    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm.html_text import page_text

    return page_text(read(spark, sf_dir, "pages"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm.media import text_media

    return text_media(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm import toxicity

    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, *toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm.repeats import without_repeats

    done = without_repeats(read(spark, sf_dir, "documents"), width=400)
    # what stays, as text: a character of which a part was removed becomes U+FFFD
    return done.select("*", F.make_valid_utf8(F.col("kept").cast("string")).alias("text")).drop("kept")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm.decontaminate import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm.near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm.conversations import damaged, repair_report

    rows = read(spark, sf_dir, "conversations")
    return repair_report(rows, damaged(rows))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm.manifest import document_manifest

    return document_manifest(read(spark, sf_dir, "documents"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.llm.ngram_join import ngram_components

    return ngram_components(read(spark, sf_dir, "documents"), width=4, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_best_fit_packing, op2_substring_dedup, op3_quality_classifier, op4_html_extraction, op5_media_columns, op6_toxicity, op7_suffix_array_dedup, op8_benchmark_decontamination, op9_minhash_near_dedup, op10_token_counts, op11_conversation_repair, op12_merkle_manifest, op13_ngram_jaccard_join)
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    """SQL where there is an exact form that is cheap on whole tables of the small scales; the first ten have none, tests/llm holds plain
    versions, round trips and held-out accuracies of theirs."""
    from tipoff.llm.oracle import ORACLES

    return dict(ORACLES)
