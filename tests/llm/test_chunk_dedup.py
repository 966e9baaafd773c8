"""Substring dedup where ids repeat, and against brute force over chunks."""

import random

import pytest
from pyspark.sql import functions as F

from tipoff.llm import chunk_dedup


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_unique_texts_under_repeated_ids_stay_whole(spark):
    """Each id has a text that stands nowhere else and one that shares a passage with other ids: only the passage goes, but for its first place."""
    rng = random.Random(11)
    passages = [words(rng, 60) for _ in range(8)]
    rows, unique = [], {}
    for i in range(400):
        unique[i] = words(rng, rng.randint(5, 120))
        rows += [(i, unique[i], "u"), (i, f"{words(rng, 20)} {passages[i % 8]} {words(rng, 20)}", "s")]
    rows += [(3, unique[3], "u")] * 5
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    out = chunk_dedup.deduplicated(df).select("row.doc_id", "row.kind", "text", "n_removed").collect()
    assert len(out) == len(rows)
    assert all(r.text == unique[r.doc_id] and r.n_removed == 0 for r in out if r.kind == "u")
    for k, p in enumerate(passages):
        kept = [r for r in out if r.kind == "s" and r.doc_id % 8 == k and p in r.text]
        assert [r.doc_id for r in kept] == [k]
        assert all(r.n_removed >= len(p) - 2 * chunk_dedup.WINDOW for r in out if r.kind == "s" and r.doc_id % 8 == k and r.doc_id != k)


def brute(rows):
    """(id, t, text) -> what stays of each, from all chunks in one table."""
    first, docs = {}, sorted({(i, t, x or "") for i, t, x in rows})
    chunks = {}
    for i, t, x in docs:
        raw, start = x.encode(), 0
        chunks[i, t] = []
        for end in chunk_dedup.cuts(raw):
            name = (raw[max(0, start - chunk_dedup.SYNC) : start], raw[start:end])
            first.setdefault(name, (i, t, start))
            chunks[i, t].append((start, end, name))
            start = end
    text = {(i, t): x.encode() for i, t, x in docs}
    out = {}
    for (i, t), cut in chunks.items():
        runs = []
        for start, end, name in cut:
            place = first[name]
            if place != (i, t, start):
                if runs and runs[-1]["end"] == start:
                    runs[-1] |= {"end": end, "right": (place[:2], place[2] + end - start)}
                else:
                    runs.append({"start": start, "end": end, "left": (place[:2], place[2]), "right": (place[:2], place[2] + end - start)})
        for r in runs:
            (d, p), (e, q) = r["left"], r["right"]
            r |= {"before": text[d][max(0, p - chunk_dedup.CONTEXT) : p], "after": text[e][q : q + chunk_dedup.CONTEXT]}
        out[i, t] = chunk_dedup.kept_text(text[i, t].decode(), runs)[0]
    return out


@pytest.mark.parametrize("most", [0, chunk_dedup.MOST_SEVERAL])
def test_against_brute_force(spark, monkeypatch, most):
    """Also with more ids of several texts than are broadcast."""
    monkeypatch.setattr(chunk_dedup, "MOST_SEVERAL", most)
    rng = random.Random(12)
    parts = [words(rng, rng.randint(10, 90)) for _ in range(30)] + ["日本語のテキスト" * 30, "ab" * 300]
    rows = [(rng.randrange(60), " ".join([words(rng, rng.randint(0, 30)), *rng.sample(parts, rng.randint(0, 3)), words(rng, rng.randint(0, 30))]), "x", 1) for _ in range(150)]
    rows += [(7, None, "x", 1), (7, "", "x", 1), (None, parts[0], "x", 1), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string, at int")
    out = chunk_dedup.deduplicated(df).select("row.doc_id", "text").collect()
    keyed = df.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()
    several = {r.doc_id for r in keyed if len({x.h for x in keyed if x.doc_id == r.doc_id}) > 1}
    t = lambda r: r.h if most == 0 or r.doc_id in several else 0
    want = brute([(r.doc_id, t(r), r.text) for r in keyed if r.doc_id is not None])
    expected = [(r.doc_id, (r.text or "") if r.doc_id is None else want[r.doc_id, t(r)]) for r in keyed]
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(expected, key=repr)
