import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tipoff.llm import chunk_dedup, decontaminate, near_dedup, repeats, suffix_array


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 300):
        text = bytes(rng.choice(b"abc") for _ in range(n))
        assert suffix_array.suffix_array(text) == sorted(range(n), key=lambda i: text[i:])


@pytest.mark.parametrize("group", [1024, 1])
def test_repeats_against_brute_force(spark, group):
    rng = random.Random(2)
    common = words(rng, 90)
    texts = [words(rng, 60) + common + words(rng, rng.randint(0, 80)) for _ in range(6)]
    texts += [texts[0], "", None, "aa" * 450, "é" * 500, texts[1][:700] + "x" + texts[1][700:], common[:399], common[:400]]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, name string")
    got = {r.doc_id: r for r in repeats.without_repeats(docs, group=group).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    for i, b in enumerate(raw):
        end, kept = 0, bytearray()
        for k in range(len(b)):
            if k + 400 <= len(b) and seen[b[k : k + 400]] > 1:
                end = k + 400
            if k >= end:
                kept.append(b[k])
        assert bytes(got[i].kept) == bytes(kept) and got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("share", [1, 1000])
def test_a_common_passage_and_a_text_of_many_copies_are_no_task_of_their_own(spark, share):
    rng = random.Random(12)
    passage = words(rng, 400)
    texts = [f"{words(rng, 9)} {passage} {words(rng, 9)}" for _ in range(60)] + [passage[:900]] * 80 + [words(rng, 30) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repeats.without_repeats(docs, share=share).select("doc_id", "n_removed", "n_spans", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    raw = [t.encode() for t in texts]
    seen = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    for r in got:
        b = raw[r.doc_id]
        cover = {j for k in range(len(b) - 399) if seen[b[k : k + 400]] > 1 for j in range(k, k + 400)}
        assert r.n_removed == len(cover) and r.n_spans == sum(j - 1 not in cover for j in cover)
    assert len(got) == len(texts)
    if share > 1:
        assert max(Counter(r.task for r in got if r.n_removed == 900).values()) < 60
    # the rows of a large group meet it where they are
    rows = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"))
    for how in ("inner", "left_semi"):
        met = repeats.met(rows, groups.filter("key <> 10"), ["key"], "n", 1000, how, 100).select("id", F.spark_partition_id().alias("task")).collect()
        assert sorted(r.id for r in met) == [i for i in range(1000) if i != 10]
        assert max(Counter(r.task for r in met if r.id % 10).values()) < 300


def test_repeats_of_an_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_keep_the_first_and_resist_shifts(spark):
    rng = random.Random(3)
    passage = words(rng, 120)
    rows = [(1, words(rng, 40) + " " + passage, 0), (2, "x " + passage + " " + words(rng, 40), 0), (3, words(rng, 50), 0), (4, None, 0), (5, "", 0), (None, passage, 0)]
    out = {r.row.doc_id: r for r in chunk_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, starts int")).collect()}
    assert out[1].n_removed == 0 and out[3].text == rows[2][1] and out[4].text == "" and out[None].text == passage
    assert out[2].n_removed > 0.6 * len(passage) and passage not in out[2].text


def test_chunk_ends_never_split_a_character():
    raw = ("日本語" * 400).encode()
    at = 0
    for end in chunk_dedup.cuts(raw):
        raw[at:end].decode()
        at = end
    assert at == len(raw)


def test_reparameterised_questions_are_found(spark):
    item = "A train leaves Paris at 5 and travels 300 km before it meets another train from Lyon that left at 5 as well."
    other = "So then: a train leaves Berlin at 7 and travels 420 km before it meets another train from Bonn that left at 7 as well."
    broken = other.replace("left at 7", "left at 9")
    rows = [(1, item), (2, other), (3, broken), (4, "nothing like it " * 20), (5, None), (6, "")]
    bench = spark.createDataFrame([(10, item), (11, None), (12, "12 34")], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert out[1].item_ids == [10] and not out[1].reparameterised
    assert out[2].item_ids == [10] and out[2].reparameterised
    assert not any(out[k].contaminated for k in (3, 4, 5, 6))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    base = [words(rng, 100).split() for _ in range(5)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:50], "zz", *w[51:]]) for w in base] + ["", None, "one two", "one two", words(rng, 30)]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in range(len(texts))}


def test_label_sample_is_the_least_hashes(spark):
    """Few labelled pages among many: the slice widens until it holds them; null ids, null html and an empty table are fine."""
    from tipoff.llm import html_text

    plain = [(i, "u", "<div>a b c</div>") for i in range(60)]
    pages = spark.createDataFrame([*plain, (None, "u", None), (None, "u", ""), (99, "u", "<nav>x</nav><article><p>one two three</p></article>")], "page_id long, url string, html string")
    assert vars(html_text.learned(pages, labelled=2)) == vars(html_text.learned(pages, labelled=50))
    got = {(r["page_id"], r["text"]) for r in html_text.page_text(pages).collect()}
    assert (99, "one two three") in got and (None, "") in got
    assert html_text.page_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("gap", [" ", ""])
def test_short_repeats_go_whole(spark, gap):
    """Passages of 51 words, and as long ones without spaces: all but the first copy of each goes, and only that."""
    rng = random.Random(7)
    shared = [words(rng, 51).replace(" ", gap) for _ in range(60)]
    own = [[words(rng, 30).replace(" ", gap) for _ in range(2)] for _ in range(120)]
    rows = [(i, f"{own[i][0]} {shared[i % 60]} {own[i][1]}") for i in range(120)] + [(200, shared[0])]
    out = {r.row.doc_id: r.text for r in chunk_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == rows[i][1] for i in range(60))
    assert [i for i in range(60, 120) if len(out[i]) > len(" ".join(own[i])) + 1] == []
    assert [i for i in range(60, 120) if not all(x[:-8] in out[i] for x in own[i][:1]) or own[i][1][8:] not in out[i]] == []
    assert len(out[200]) == 0


def test_cuts_of_periodic_text_are_few():
    for raw in (b"a" * 10_000, b"ab " * 4000, "日".encode() * 3000):
        assert len(chunk_dedup.cuts(raw)) <= len(raw) // 20
