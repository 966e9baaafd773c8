"""Each stage of the corpus pipeline on what the one before it kept."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from tipoff.llm import decontaminate, near_dedup, packing, quality
from tipoff.llm.common import read, tokenizer_path, written

SF = "/root/testdata/sf0.001"


def test_stages_follow_on_each_other(spark):
    docs = read(spark, SF, "documents")
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))).unionByName(docs.limit(1).withColumn("doc_id", F.lit(10**9).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit(None).cast("string")))
    docs = written(docs, "test-docs")
    kept = [docs]
    for name, stage in P.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], SF), f"test-{name}"))
        assert kept[-1].columns == list(P.COLUMNS) and kept[-1].schema == docs.select(*P.COLUMNS).schema
        assert kept[-1].count() <= kept[-2].count()
    good, single, cut, clean = kept[1:]
    scores = {r.doc_id: r.score for r in quality.scored(docs, quality.fit(docs, read(spark, SF, "labels"))).collect() if r.doc_id is not None}
    assert {r.doc_id for r in good.collect() if r.doc_id is not None} == {i for i, s in scores.items() if s >= P.LEAST_QUALITY}
    labels = near_dedup.near_duplicates(good.filter("doc_id IS NOT NULL"), width=5).collect()
    assert {r.doc_id for r in single.collect() if r.doc_id is not None} == {r.doc_id for r in labels if r.doc_id == r.component_id}
    before = {r.doc_id: r.text for r in single.collect()}
    assert {r.doc_id for r in cut.collect()} == before.keys()
    assert all(r.n_chars == len(r.text) and len(r.text) <= len(before[r.doc_id] or "") for r in cut.collect())
    assert not [r for r in decontaminate.contamination(clean.filter("doc_id IS NOT NULL"), read(spark, SF, "benchmark")).collect() if r.contaminated]
    found = [r.doc_id for r in decontaminate.contamination(cut, read(spark, SF, "benchmark")).collect() if r.contaminated]
    assert {r.doc_id for r in clean.collect()} == before.keys() - set(found)
    packed = P.STAGES[-1][1](spark, clean, SF).collect()
    parts = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pieces(clean, tokenizer_path("word_bpe_49k.json")).collect())
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == parts


def test_an_empty_table_gives_empty_stages(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
