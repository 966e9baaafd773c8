"""The manifest against a plain tree, on the given table and on made rows; the caches of folding; partial parents handed on early."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tipoff.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """(root, for each leaf the siblings by level as (before, after))."""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for k, p in enumerate(at):
            run, j = runs[p // 16], p % 16
            proofs[k].append((run[:j], run[j + 1 :]))
            at[k] = p // 16
        level = [h(*r) for r in runs]
    return level[0], proofs


def plain(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        of = lambda t, i=i, source=source, lang=lang, n=n: h(*map(encoded, (i, source, lang, n, t)))
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by[source].append((i is not None, i or 0, of(text), of(text.translate(lower) if hit and text is not None else text)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in by[s]])
    root, upper = tree([trees[s][0] for s in sources]) if sources else ("", [])
    out = []
    for s, above in zip(sources, upper, strict=True):
        for (some, i, leaf, shown), own in zip(by[s], trees[s][1], strict=True):
            path = own + above
            found = shown
            for left, right in path:
                found = h(*left, found, *right)
            out.append((i if some else None, leaf, trees[s][0], root, h(*(x for left, right in path for x in left + right)), found, found == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
key = lambda rows: sorted(rows, key=repr)


def test_given_table(spark):
    from tipoff.llm.queries import op12_merkle_manifest

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = [tuple(r[c] for c in COLUMNS) for r in op12_merkle_manifest(spark, sf).collect()]
    assert key(out) == key(plain(rows)) and 0 < sum(not r[-1] for r in out) < len(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, digest string"


@pytest.mark.parametrize("most", [2, manifest.MOST])
def test_odd_rows(spark, monkeypatch, most):
    """Nulls anywhere, repeated ids and rows, groups of 1, 16, 17, 256 and 257 leaves, clashing names, and partial parents handed on at once."""
    monkeypatch.setattr(manifest, "MOST", most)
    rng = random.Random(3)
    rows = [(k, f"Text {k} É", "en", f"s{n}", n) for n in (1, 2, 16, 17, 256, 257, 300) for k in range(1000 * n, 1000 * n + n)]
    rows += [(rng.choice([None, 5, 6, 10**15]), rng.choice([None, "", "AbC", "x" * 100_000]), rng.choice([None, "de"]), rng.choice([None, "", "ü", "z"]), rng.choice([None, -3])) for _ in range(150)]
    rows += [(7, "Same TEXT", "en", "hot", 9)] * 400
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(7)
    out = [tuple(r[c] for c in COLUMNS) for r in manifest.document_manifest(df).collect()]
    assert key(out) == key(plain(rows))


def test_small_tables(spark):
    for rows in ([], [(1, "A", "en", "s", 1)], [(1, "A", "en", None, 1), (5, None, "en", "s", None)]):
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
        out = [tuple(r[c] for c in COLUMNS) for r in manifest.document_manifest(df).collect()]
        assert key(out) == key(plain(rows))


def test_proofs_lead_to_the_root(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, f"t{k}", "en", f"s{k % 3}", k, 1, "x") for k in range(100)], SCHEMA)
    out = manifest.verified(df, "source", "doc_id", ["doc_id", "text"], {}, F.lit(False), proofs=True).collect()
    assert len(out) == 100 and all(r.verified and h(*(d for level in r.proof for d in level)) == r.proof_sha256 for r in out)
