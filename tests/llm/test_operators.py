"""Round trips, libraries, brute force and held-out accuracy for the operators that SQL cannot express; odd rows and empty tables for all."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tipoff.llm import chunk_dedup, media, near_dedup, packing, quality, repeats, token_counts, toxicity
from tipoff.llm.common import tokenizer_path

COLUMNS = "doc_id long, text string, row int, key string, start int, score double, sequence_id int, kept boolean, labels int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows():
    rng = random.Random(9)
    long = words(rng, 40_000)
    texts = [None, "", "a", words(rng, 60), words(rng, 60), long, long, "é\x1f日本語 😀 \x00", "same", "same", "same"]
    ids = [1, 2, 3, 4, 4, 5, 6, 7, 8, 8, None]
    return [(i, t, 1, "k", 2, 0.5, 3, True, 0) for i, t in zip(ids, texts, strict=True)]


LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 0, 1), (4, 1, 1), (5, 1, None), (None, 0, 1), (6, 0, 0)]


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", ["packing", "chunks", "quality", "media", "toxicity", "repeats", "near", "tokens"])
def test_odd_rows(spark, name, empty):
    """Null and empty texts, null and repeated ids, repeated rows, very long texts, clashing names: a row each (packing: a piece each)."""
    docs = spark.createDataFrame([] if empty else odd_rows(), COLUMNS)
    labels = spark.createDataFrame([] if empty else LABELS, "doc_id long, quality int, toxic int")
    run = {
        "packing": lambda: packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json")).filter("piece = 0"),
        "chunks": lambda: chunk_dedup.deduplicated(docs),
        "quality": lambda: quality.scored(docs, quality.fit(docs, labels)),
        "media": lambda: media.text_media(docs),
        "toxicity": lambda: toxicity.scored(docs, *toxicity.fit(docs, labels)),
        "repeats": lambda: repeats.without_repeats(docs),
        "near": lambda: near_dedup.near_duplicates(docs),
        "tokens": lambda: token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json")),
    }
    rows = run[name]().collect()
    assert len(rows) == (0 if empty else len(odd_rows()))
    if name != "chunks" and not empty:
        assert sorted((r["doc_id"] or 0) for r in rows) == sorted((r[0] or 0) for r in odd_rows())


def test_packing_holds_all_tokens(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    path = tokenizer_path("word_bpe_49k.json")
    texts = [words(rng, rng.choice([0, 3, 40, 300, 900, 3000])) for _ in range(80)] + [None, "", "Ünïcode, 日本語! don't stop\x1cnow"]
    tok = Tokenizer.from_file(path)
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    got = packing.packed_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    by = defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.start == 2048 * r.piece and zlib.crc32(np.asarray(part, "<u4").tobytes()) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= packing.lower_bound([r.length for r in got], 2048) + 1


def test_crossover_beats_best_fit():
    """Items in triples that fill a bin exactly: best fit alone opens more bins than the search does, and both hold every item once."""
    plain = searched = bound = 0
    for seed in range(12):
        rng = random.Random(seed)
        sizes = []
        for _ in range(40):
            a = rng.randint(380, 480)
            b = rng.randint(260, 330)
            sizes += [a, b, 1000 - a - b]
        bins, room = [], []
        packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1000, bins, room)
        labels = packing.evolve(sizes, 1000, seed, crossovers=60, population=8)
        load = np.bincount(labels, sizes)
        assert load.max() <= 1000 and len(labels) == len(sizes)
        plain, searched, bound = plain + len(bins), searched + len(load), bound + 40
    assert bound <= searched < plain


def test_factorisation_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = quality.Machine(0.1, rng.normal(0, 0.1, quality.DIMS).astype(np.float32), rng.normal(0, 0.1, (quality.DIMS, quality.FACTORS)).astype(np.float32))
    idx, x, at = quality.features(["one two three", "Ab 12 !!\nAb 12 !!"])
    for k, got in enumerate(m.score(idx, x, at)):
        i, v = idx[at[k] : at[k + 1]], x[at[k] : at[k + 1]]
        z = m.bias + float(m.weights[i] @ v) + sum(float(m.factors[i[a]] @ m.factors[i[b]]) * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4
        assert np.allclose(quality.values_of(i), v)


def test_quality_of_held_out_rows(spark):
    rng = random.Random(4)
    junk = lambda: "|".join(rng.choice(["BUY NOW!!!", "### $$$", "click 123 456", "|||"]) for _ in range(40))
    docs = [(k, words(rng, 80) if k % 3 else junk(), "x") for k in range(600)]
    labels = [(k, int(k % 3 > 0)) for k in range(600)] + [(5, 0), (None, 1)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.scored(d, quality.fit(d, y)).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 80 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distances():
    rng = random.Random(5)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 9))): rng.randint(0, 2) for _ in range(12)}
    found = toxicity.Automaton({t: (e, False) for t, e in terms.items()})
    for _ in range(600):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(2, 11)))
        near = [d for t, e in terms.items() if (d := _distance(w, t)) <= e]
        hit = found.find(w)
        assert (hit is None) == (not near) and (hit is None or hit[1] == min(near) == _distance(w, hit[0]))


def test_toxicity_of_held_out_rows(spark):
    """Half of the terms are misspelled, in ways that no training row shows. A quoted term is told apart."""
    rng = random.Random(6)
    bad = ["grumbler", "snotface", "dunderhead"]
    misspelled = lambda w: w[:3] + rng.choice("xyz") + w[4:]
    docs, labels = [], []
    for k in range(900):
        body = words(rng, 30).split()
        toxic = k % 5 == 0
        if toxic:
            w = rng.choice(bad)
            body[rng.randrange(5, 25)] = f"you {misspelled(w) if k % 2 else w} you"
        docs.append((k, " ".join(body)))
        labels.append((k, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    terms, weights = toxicity.fit(d, y)
    out = toxicity.scored(d, terms, weights).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    automaton = toxicity.Automaton(terms)
    assert toxicity.features('he said the word "grumbler" was old', automaton)[2] == 1


def test_media_round_trip(spark):
    rng = random.Random(7)
    texts = [words(rng, n) for n in (0, 1, 100, 5000)] + ["日本語" * 192, None, "x" * 576, "x" * 575]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.text_media(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.mux(payload)
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest()


def test_media_columns_of_files(spark):
    """Keyframe ranges lie in the payload; broken files say why and do not fail the job."""
    payload = bytes(range(256)) * 9
    whole = media.mux(payload)
    huge = struct.pack(">I4s", 0xFFFFFFF0, b"moov") + b"x" * 20
    rows = [(1, bytearray(whole)), (2, bytearray(whole[: len(whole) // 2])), (3, bytearray(b"")), (4, None), (5, bytearray(b"no media at all, only text")), (6, bytearray(huge))]
    got = {r.id: r for r in media.media_index(spark.createDataFrame(rows, "id long, film binary"), "id", "film").collect()}
    assert got[1].error is None and got[1].n_samples > 0 and got[1].keyframes
    assert all(0 <= k.start < k.end <= len(whole) and whole[k.start : k.end] in payload for k in got[1].keyframes)
    assert got[4].codec is None and len(got) == 6 and all(got[k].n_samples is None or got[k].n_samples == 0 or got[k].error for k in (3, 5, 6))


def test_token_counts_against_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    path = tokenizer_path("byte_bpe_50k.json")
    odd = ["don't  stop\n\n now ", " \t x\r\n", "日本語のテキスト 123,456", "😀😀 é́", "<|endoftext|> hi <|endoftext|>", "a" * 3000, "\x00\x1f ", "I'LL we'Ve", "Ünïcödé ǅ ß", " ", "  ", "1 22 333"]
    texts = odd + [words(rng, rng.randint(1, 400)) for _ in range(40)] + ["".join(rng.choice("ab '!\n\tÉß日") for _ in range(80)) for _ in range(60)] + [None, ""]
    tok = Tokenizer.from_file(path)
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512), t
