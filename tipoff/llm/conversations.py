"""Repair of the turn structure of conversations: the cheapest edits that make the roles `(s?(ua)+)?`.

A row is kept (0), given the role user or assistant (1) or deleted (2); empty turns are inserted (5); a truncated row that stays adds 5; blank
and duplicate rows must go. Cost-to-go is a vector over the four states of the grammar (start, after a system turn, after user, after
assistant). It is computed backwards over the turns; then a forward walk takes, among the edits on a cheapest way, the one whose initial is
least (D < I < K < R). An audit string fixes the states it passes, so the walk is the ASCII-least of all cheapest audits.

No task holds a conversation. Rows are sorted by range, so a long conversation lies in several partitions, and are cut into blocks of BLOCK
rows. Each block has a matrix of least costs from state to state; a scan over a conversation's matrices gives the costs behind each block,
each block then the edits from each of the four states it may begin in, and a scan over those picks the edits. Only the hash of a repaired
conversation reads its turns one after another, as a stream: SHA-256 has no other way.

Cases: rows of a null conv_id are one conversation; null turns come first; ties of a turn go by role, then text (bytewise); repeated rows are
duplicates after the first. Null roles and texts are taken as one space. Blank rows are never duplicates. Empty roles have no initial and fit
nowhere. Texts of any length are taken whole. A table without rows gives no conversations. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import inf

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import map_batches, written

BLOCK = 4096
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: State after a turn of the next legal role, for each state; an insertion leads there too.
NEXT = (2, 2, 3, 2)
#: Costs behind the last row, and the turns still to insert there.
LAST = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "ua", "a", "")
#: Faults of a row.
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
MUST_GO = 8


@lru_cache(None)
def before(after: tuple, code: int) -> tuple[tuple, tuple]:
    """(costs before a row, (moves, state after) from each state) from the costs behind it. code: 2 * role (s, u, a, other) + truncated,
    or MUST_GO. Moves: u, a insert; U, A give a role; K keeps; D deletes."""
    if code == MUST_GO:
        return tuple(c + DELETE for c in after), tuple(("D", q) for q in range(4))
    role, extra = code // 2, CUT * (code % 2)
    ways = []
    for q in range(4):
        to = NEXT[q]
        fits = 1 if q == 0 and role == 0 else to if role == to - 1 else None
        ways.append((DELETE + after[q], inf if fits is None else extra + after[fits], REROLE + extra + after[to], fits))
    best = [min(w[:3]) for w in ways]
    best[2], best[3] = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
    best[:2] = (min(b, INSERT + best[2]) for b in best[:2])

    def walk(q: int) -> tuple[str, int]:
        delete, keep, rerole, fits = ways[q]
        if best[q] == delete:
            return "D", q
        if best[q] == INSERT + best[NEXT[q]]:
            moves, to = walk(NEXT[q])
            return "a" + moves if q == 2 else "u" + moves, to
        if best[q] == keep:
            return "K", fits
        return "A" if q == 2 else "U", NEXT[q]

    return tuple(best), tuple(walk(q) if best[q] < inf else ("", q) for q in range(4))


@lru_cache(1 << 16)
def _before(after: tuple, code: int) -> tuple[tuple, float, tuple]:
    """before() with the least cost taken out: vectors differ by little, so there are few of them."""
    costs, walks = before(after, code)
    least = min(costs)
    return tuple(c - least for c in costs), least, walks


def codes(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(role, fault, n) of each run of equal rows -> (code, repeats)."""
    out = []
    for role, fault, n in rows:
        if fault >= DUPLICATE:
            out.append((MUST_GO, n))
        else:
            out.append((2 * role + (fault == TRUNCATED), 1))
            if n > 1:
                out.append((MUST_GO, n - 1))
    return out


def backward(runs: list[tuple[int, int]], after: tuple) -> tuple[tuple, list]:
    """(costs before the first row, the walks of each run from the last to the first)."""
    walks, total = [], 0
    for code, n in reversed(runs):
        if code == MUST_GO:
            total += DELETE * n
            walks.append(n)
        else:
            after, least, walk = _before(after, code)
            total += least
            walks.append(walk)
    return tuple(c + total for c in after), walks


def forward(walks: list, q: int) -> tuple[str, int]:
    out = []
    for w in reversed(walks):
        if isinstance(w, int):
            out.append("D" * w)
        else:
            moves, q = w[q]
            out.append(moves)
    return "".join(out), q


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of the query, by crc32(`conv_id:turn`) % 20."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _same(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}"))
    return out


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> runs of equal rows in order: conv_id, block, k (rows of the block before it), n, kind (role), fault, role, text."""
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    # equal rows are counted before they are dealt, so copies never fill a task
    runs = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256)), "turn-runs")
    by_turn = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = runs.groupBy("conv_id", "role", "digest").agg(F.min(by_turn).alias("first"))
    both = runs.alias("x").hint("merge").join(first.alias("y"), _same("conv_id", "role", "digest"))
    last = F.regexp_extract("x.text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    seen = F.struct(F.col("x.turn").isNotNull().alias("some"), F.col("x.turn")) > F.col("y.first")
    fault = F.when(last == "", BLANK).when(seen, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    initial = F.substring("x.role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = both.select("x.conv_id", "x.turn", "x.role", "x.text", "x.n", kind.alias("kind"), fault.alias("fault")).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = placed.schema["conv_id"].dataType.simpleString()

    def make():
        block, k, size, last = (TaskContext.get().partitionId() << 32) - 1, 0, BLOCK, object()

        def step(batch):
            nonlocal block, k, size, last
            blocks, places = [], []
            for conv, n in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if size == BLOCK or conv != last:
                    block, k, size, last = block + 1, 0, 0, conv
                blocks.append(block)
                places.append(k)
                k, size = k + n, size + 1
            columns = [batch.column(0), pa.array(blocks, pa.int64()), pa.array(places, pa.int64()), *(batch.column(j) for j in (4, 5, 6, 2, 3))]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "k", "n", "kind", "fault", "role", "text"])

        return step

    return written(map_batches(placed, make, f"conv_id {schema}, block long, k long, n long, kind int, fault int, role string, text string"), "turn-order")


def _blocks(order: DataFrame, key: str) -> DataFrame:
    """A row for each block: its runs, the least costs from state to state, counts of faults and of illegal neighbours."""
    each = order.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("k", "kind", "fault", "n"))).alias("runs"))

    def make():
        def step(batch):
            out = []
            for runs in batch.column(2).to_pylist():
                rows = [(r["kind"], r["fault"], r["n"]) for r in runs]
                coded = codes(rows)
                cells = [backward(coded, tuple(0 if q == j else inf for q in range(4)))[0] for j in range(4)]
                pairs = zip(rows, rows[1:], strict=False)
                illegal = sum(n - 1 for _, _, n in rows) + sum((a[0], b[0]) not in LEGAL for a, b in pairs)
                counts = [sum(n for _, f, n in rows if f == BLANK), sum(n if f == DUPLICATE else n - 1 for _, f, n in rows if f < BLANK), sum(f == TRUNCATED for _, f, _ in rows), illegal]
                out.append({"costs": [None if c == inf else int(c) for column in cells for c in column], "first": rows[0][0], "last": rows[-1][0], "counts": counts})
            kind = pa.struct([("costs", pa.list_(pa.int64())), ("first", pa.int32()), ("last", pa.int32()), ("counts", pa.list_(pa.int64()))])
            return pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(3)), pa.array(out, kind)], ["conv_id", "block", "runs", "own"])

        return step

    runs = each.schema["runs"].dataType.simpleString()
    return written(map_batches(each, make, f"conv_id {key}, block long, runs {runs}, own struct<costs:array<long>,first:int,last:int,counts:array<long>>"), "turn-blocks")


#: Neighbours su, ua and au.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _costs_behind(blocks: DataFrame, key: str) -> DataFrame:
    """The scan from a conversation's last block to its first: cost, counts, and the costs behind each block."""
    each = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "own"))).alias("parts"))

    def make():
        def step(batch):
            cost, counts, ends = [], [], []
            for parts in batch.column(1).to_pylist():
                after, behind = LAST, []
                for p in reversed(parts):
                    behind.append({"block": p["block"], "behind": [int(c) for c in after]})
                    cells = [inf if c is None else c for c in p["own"]["costs"]]
                    after = tuple(min(cells[4 * j + q] + after[j] for j in range(4)) for q in range(4))
                cost.append(int(after[0]))
                sums = [sum(p["own"]["counts"][k] for p in parts) for k in range(4)]
                sums[3] += sum((a["own"]["last"], b["own"]["first"]) not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
                counts.append(sums)
                ends.append(behind)
            own = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            return pa.RecordBatch.from_arrays([batch.column(0), *own, pa.array(cost, pa.int64()), pa.array(ends, pa.list_(pa.struct([("block", pa.int64()), ("behind", pa.list_(pa.int64()))])))], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "ends"])

        return step

    return written(map_batches(each, make, f"conv_id {key}, blank long, duplicate long, truncated long, illegal long, cost long, ends array<struct<block:long,behind:array<long>>>"), "turn-costs")


def _moves(blocks: DataFrame, costs: DataFrame, key: str) -> DataFrame:
    """conv_id, picked (block, moves): each block walked from every state, and the scan that picks the state it begins in."""
    ends = costs.select("conv_id", F.explode("ends").alias("end")).select("conv_id", "end.*")
    both = blocks.alias("x").join(ends.alias("y"), _same("conv_id", "block")).select("x.conv_id", "x.block", "x.runs", "y.behind")

    def make():
        def step(batch):
            to, moves = [], []
            for runs, behind in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                least = min(behind)
                _, walks = backward(codes([(r["kind"], r["fault"], r["n"]) for r in runs]), tuple(c - least for c in behind))
                each = [forward(walks, q) for q in range(4)]
                moves.append([m for m, _ in each])
                to.append([q for _, q in each])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(to, pa.list_(pa.int32())), pa.array(moves, pa.list_(pa.string()))], ["conv_id", "block", "to", "moves"])

        return step

    walked = map_batches(both, make, f"conv_id {key}, block long, to array<int>, moves array<string>")
    each = walked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "to", "moves"))).alias("parts"))

    def scan():
        def step(batch):
            out = []
            for parts in batch.column(1).to_pylist():
                q, picked = 0, []
                for p in parts:
                    picked.append({"block": p["block"], "moves": p["moves"][q]})
                    q = p["to"][q]
                picked[-1]["moves"] += TAIL[q]
                out.append(picked)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("block", pa.int64()), ("moves", pa.string())])))], ["conv_id", "picked"])

        return step

    return written(map_batches(each, scan, f"conv_id {key}, picked array<struct<block:long,moves:string>>"), "turn-moves")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation with its counts, cost and audit; the turns of the repaired conversations: conv_id, block, k, j (their
    order), role, text)."""
    order = ordered(rows)
    key = order.schema["conv_id"].dataType.simpleString()
    blocks = _blocks(order, key)
    costs = _costs_behind(blocks, key)
    moves = _moves(blocks, costs, key)
    audit = F.translate(F.array_join(F.col("y.picked.moves"), ""), "uaUA", "IIRR")
    report = costs.alias("x").join(moves.alias("y"), _same("conv_id")).select(*(f"x.{c}" for c in costs.columns if c != "ends"), audit.alias("audit"))
    each = moves.select("conv_id", F.explode("picked").alias("p")).select("conv_id", "p.*")
    own = each.select("conv_id", "block", F.posexplode(F.regexp_extract_all("moves", F.lit("([ua]*[DKUA])"), F.lit(1))).alias("k", "move")).filter("move <> 'D'")
    edited = order.alias("x").hint("merge").join(own.alias("y"), _same("conv_id", "block", "k")).select("x.conv_id", "x.block", "x.k", "x.role", "x.text", "y.move")
    tail = each.select("conv_id", "block", F.lit(2**62).alias("k"), F.lit("").alias("role"), F.lit("").alias("text"), F.regexp_extract("moves", "[ua]*$", 0).alias("move")).filter("move <> ''")
    turns = edited.unionByName(tail).select("*", F.posexplode(F.split("move", "")).alias("j", "m")).filter("m <> ''")
    role = F.when(F.lower("m") == "u", "user").when(F.lower("m") == "a", "assistant").otherwise(F.col("role"))
    return report, turns.select("conv_id", "block", "k", "j", role.alias("role"), F.when(F.col("m").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


def hashed(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of `role:text` lines, joined by newlines, as a stream over sorted turns."""
    key = turns.schema["conv_id"].dataType.simpleString()
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block", "k", "j")

    def run(batches):
        conv, digest, kind = None, None, None
        for batch in batches:
            kind, ids, out = batch.column(0).type, [], []
            for c, role, text in zip(*(batch.column(j).to_pylist() for j in (0, 4, 5)), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        ids.append(conv)
                        out.append(digest.hexdigest())
                    conv, digest = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(out)], ["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return dealt.mapInArrow(run, f"conv_id {key}, repaired_sha256 string")


def repair_report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of `original`: what was found in `rows`, the edits and the hash of the repaired turns. Gaps that are no long are null."""
    report, turns = repaired(rows)
    turn = F.col("turn").cast("decimal(38,0)")
    gaps = rows.groupBy("conv_id").agg(F.max(turn).alias("most"), F.min(turn).alias("least"), F.count_distinct("turn").alias("n"))
    gaps = gaps.select("conv_id", F.coalesce(F.when(F.col("n") == 0, 0), (F.col("most") - F.col("least") + 1 - F.col("n")).try_cast("long")).alias("gaps"), F.lit(True).alias("some"))
    out = original.select("conv_id").distinct()
    for more in (gaps, report, hashed(turns)):
        out = out.alias("x").join(more.alias("y"), _same("conv_id"), "left").select("x.*", *(f"y.{c}" for c in more.columns if c != "conv_id"))
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", F.when(F.col("some").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
