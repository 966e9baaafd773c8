"""Repair of conversations against a search over pairs (cost, audit), on the given table and on made rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tipoff.llm import conversations

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        hit = zlib.crc32(name.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def plain_repair(rows):
    """rows of one conversation -> all result columns; the cheapest way as a minimum over (cost, audit, lines)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    step = lambda q, r: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((q, r))
    best = {q: {"": (0, "", []), "a": (0, "", [])}.get(q) for q in ("", "s", "u", "a")}

    def inserted(best):
        for _ in range(3):
            for q in best:
                for r in ("user", "assistant"):
                    to = step(q, r[0])
                    if to is not None and best[to] is not None:
                        cost, audit, lines = best[to]
                        new = (cost + 5, "I" + audit, [r + ":", *lines])
                        best[q] = min([b for b in (best[q], new) if b is not None], key=lambda b: b[:2])

    inserted(best)
    for (_, _, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        now = {}
        for q in best:
            ways = []
            if best[q] is not None:
                ways.append((best[q][0] + 2, "D" + best[q][1], best[q][2]))
            if fault not in ("blank", "duplicate"):
                for name, price, edit in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    to = step(q, name[:1])
                    if to is not None and best[to] is not None:
                        ways.append((best[to][0] + price + 5 * (fault == "truncated"), edit + best[to][1], [f"{name}:{text}", *best[to][2]]))
            now[q] = min(ways, key=lambda b: b[:2]) if ways else None
        inserted(now)
        best = now
    cost, audit, lines = best[""]
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows, damage=True):
    by = {r[0]: [] for r in rows}
    for r in plain_damage(rows) if damage else rows:
        by[r[0]].append(r)
    return {c: plain_repair(x) for c, x in by.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(original, rows):
    out = conversations.repair_report(original, rows).select("conv_id", *COLUMNS).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def test_given_table(spark):
    from tipoff.llm.queries import op11_conversation_repair

    sf = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op11_conversation_repair(spark, sf).collect()}
    assert out == expected(rows)


def made(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unknown"]
    texts = ["Yes.", "No", "", " \t", None, "Why?", "é 日本!", "x" * 3000, "Well.\n", "A", "B.", "C.", "D.", "E."]
    return [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("block", [3, conversations.BLOCK])
@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows_and_small_blocks(spark, monkeypatch, seed, block):
    """Null ids, turns, roles and texts, repeated rows, ties; conversations over many blocks and partitions. Further columns do not matter."""
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = made(seed, 250)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, block int, k string")
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = expected(filled, damage=False)
    assert got(df, df) == want
    assert got(df, conversations.damaged(df)) == expected(rows)


def test_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert got(empty, empty) == {}
    one = spark.createDataFrame([(5, 1, "user", "Hi.")], schema)
    assert got(one, empty) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_conversation_holds_most_rows(spark):
    """A hot conversation with a hot row: equal rows become one run, the others spread over partitions."""
    rows = [(1, k, ["user", "assistant"][k % 2], f"Turn {k}.") for k in range(3000)] + [(1, 7, "user", "again.")] * 2000 + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    order = conversations.ordered(df).groupBy("conv_id", "block").count().collect()
    assert max(r["count"] for r in order) <= conversations.BLOCK
    spread = defaultdict(set)
    for r in order:
        spread[r.conv_id].add(r.block >> 32)
    assert len(spread[1]) > 1
    assert got(df, df) == expected(rows, damage=False)
