"""The prefix-tree join against all pairs, on the given table and on made rows; the trie against plain sets; parts over many blocks."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tipoff.llm import ngram_join

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def root_of(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def plain(rows, percent=85):
    """(id, text) -> sorted (id, n, component): all pairs that share a shingle are compared; rows of one id are one document."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    parent = {k: k for k in range(len(rows))}
    same = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            parent[root_of(parent, k)] = root_of(parent, same.setdefault(i, k))
    for k, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < k}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both) and (s == sets[j] or None not in (rows[k][0], rows[j][0])):
                parent[root_of(parent, k)] = root_of(parent, j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root_of(parent, k)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return sorted(((i, len(sets[k]), i if not sets[k] else least[root_of(parent, k)]) for k, (i, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted((tuple(r) for r in ngram_join.ngram_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_given_table(spark):
    from tipoff.llm.queries import op13_ngram_jaccard_join

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = sorted((tuple(r) for r in op13_ngram_jaccard_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert out == plain(rows) and sum(a != c for a, _, c in out) > 10


def near_copies(seed, groups, size, words):
    """Groups of texts of which each is a copy of another of the group with a few words changed: many links near the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(groups):
        group = [[word() for _ in range(rng.randint(words // 2, words))]]
        for _ in range(size):
            copy = list(rng.choice(group))
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[rng.randint(0, len(copy) // 8) :]
            group.append(copy)
        out += [" ".join(g) for g in group]
    return out


@pytest.mark.parametrize(("block", "direct"), [(4, 1), (4, 8), (ngram_join.BLOCK_SETS, ngram_join.DIRECT)])
def test_near_the_threshold(spark, monkeypatch, block, direct):
    """Also with parts that take many blocks: pairs of blocks and labels of the first deals must not lose a link."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    monkeypatch.setattr(ngram_join, "DIRECT", direct)
    texts = near_copies(1, 12, 25, 60) + near_copies(2, 30, 6, 12) + near_copies(3, 40, 3, 5)
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    out = got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert out == plain(rows) and len({c for _, _, c in out}) > 60


def test_odd_rows(spark):
    rng = random.Random(5)
    texts = near_copies(6, 3, 8, 40)
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "One two"), (7, "É é É é é"), (8, "a a a a a a a"), (None, texts[0]), (None, "only here and nowhere else"), (9, "a b c d"), (9, texts[3]), (10, "A B C D")]
    rows += [(20 + k, t) for k, t in enumerate(texts)] + [(11, "same words in every one of these rows")] * 40 + [(12, " ".join(str(k) for k in range(30_000)))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, part int, id int, label string")
    assert got(df) == plain(rows)


def test_no_rows(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_trie_against_all_pairs(percent):
    rng = random.Random(percent)
    for _ in range(60):
        base = rng.sample(range(1000), 30)
        sets = {frozenset(rng.sample(base, rng.randint(20, 30)) + rng.sample(range(1000, 1100), rng.randint(0, 4))) for _ in range(rng.randint(2, 40))}
        sets |= {frozenset(list(s)[:25]) for s in list(sets)[:5]}
        sets = [np.array(sorted(s), np.uint64) for s in sets]
        parent = {k: k for k in range(len(sets))}
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[root_of(parent, a)] = root_of(parent, b)
        mine = {k: k for k in range(len(sets))}
        for a, b in ngram_join.trie_links(sets, list(range(len(sets))), percent):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
            mine[root_of(mine, a)] = root_of(mine, b)
        of = lambda p: {frozenset(k for k in p if root_of(p, k) == r) for r in map(lambda k: root_of(p, k), p)}  # noqa: B023, E731
        assert of(parent) == of(mine)
