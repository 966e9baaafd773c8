"""Benchmark decontamination against a plain version that compares every window of every document with every window of every item."""

import random
from collections import Counter

import pytest

from tipoff.llm import decontaminate as D


def plain(texts, items):
    """For each text the ids of the items found, from windows compared token by token."""
    out = []
    for t in texts:
        found = set()
        for item_id, item in items:
            rows = []
            for (view, tok, val, kind, _), (_, tok2, val2, kind2, _) in zip(D.views([t]), D.views([item]), strict=True):
                size, words = len(tok2), int((kind2 == 0).sum())
                if words < D.LEAST:
                    continue
                width = min(size, D.WIDTH)
                for p in range(size - width + 1):
                    if (kind2[p : p + width] == 0).sum() < D.LEAST:
                        continue
                    for q in range(len(tok) - width + 1):
                        if tok[q : q + width].tolist() == tok2[p : p + width].tolist():
                            rows.append((view, q - p, p, width, size, kind2[p : p + width].tolist(), val2[p : p + width].tolist(), val[q : q + width].tolist()))
            if rows and D.judged(rows) is not None:
                found.add(item_id)
        out.append(sorted(found))
    return out


def sentence(rng, names, n):
    words = [rng.choice("ant bee cat dog eel fox gnu hen ibis jay kid lynx mole newt owl pig ram seal toad vole wasp yak zebu".split()) for _ in range(n)]
    for _ in range(n // 6):
        words[rng.randrange(1, n)] = rng.choice([str(rng.randrange(99)), rng.choice(names), "5 km"])
    return " ".join(words).capitalize() + rng.choice([".", "?", ""])


@pytest.mark.parametrize("parts", [1, 5])
def test_against_every_window_compared(spark, parts):
    rng = random.Random(4)
    names = ["Anna", "Bert", "Émile", "Жан", "Zoe"]
    items = [(k, sentence(rng, names, rng.randint(4, 30))) for k in range(25)] + [(3, sentence(rng, names, 12)), (None, "ant bee cat dog eel fox"), (40, None), (41, ""), (42, "7 8 9 10 11")]
    texts = []
    for k in range(40):
        own = [sentence(rng, names, 25) for _ in range(3)]
        it = rng.choice(items[:26])[1]
        cut = it.split()
        own.insert(1, rng.choice([it, it.upper(), it.replace("5", "7"), " ".join(cut[: len(cut) * 2 // 3]), it.replace("Anna", "Otto"), " ".join(cut[::-1])]))
        texts.append(" ".join(own))
    texts += ["", None, texts[0], texts[0], "word " * 30_000 + items[2][1]]
    ids = [*range(40), 50, 51, 0, None, 99]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, row int, hits int, item_ids int").repartition(parts)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(parts)
    got = Counter((r.doc_id, tuple(r.item_ids), r.contaminated, r.n_items) for r in D.contamination(docs, bench).collect())
    want = plain([(t or "")[-4000:] for t in texts], [i for i in items if i[0] is not None])
    assert got == Counter((i, tuple(w), bool(w), len(w)) for i, w in zip(ids, want, strict=True))
    assert sum(map(bool, want)) > 20


def test_small_bit_set_gives_the_same_rows(spark, monkeypatch):
    """More candidates, never other rows."""
    rng = random.Random(5)
    items = [(k, sentence(rng, ["Anna"], 20)) for k in range(50)]
    docs = spark.createDataFrame([(k, sentence(rng, ["Bert"], 30) + " " + items[k][1]) for k in range(50)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, D.contamination(docs, bench).collect()))
    monkeypatch.setattr(D, "BITS", 64)
    assert sorted(map(str, D.contamination(docs, bench).collect())) == one


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert [tuple(r)[:2] for r in D.contamination(docs, bench.limit(0)).collect()] == [(1, False)]
    assert [tuple(r)[:2] for r in D.contamination(docs, bench).collect()] == [(1, True)]
