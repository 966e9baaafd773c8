"""Substring dedup by content-defined chunks.

A gear rolling hash over the last SYNC bytes decides where a text is cut: at the place of least hash of each window of WINDOW bytes, at a
word's start where the window has one and else at any character. A cut depends on the bytes near it only, so an insertion moves the cuts
around it and no others, and any two equal stretches of over SYNC + 2 * WINDOW bytes, spaced or not, have a chunk in common. Each chunk is
named by a 128-bit digest of itself and the SYNC bytes before it. Of a chunk that occurs more than once, the occurrence in the lowest id
(the earliest there) stays; runs of the others are extended byte by byte, on both sides, as far as they agree with the text around that
occurrence (CONTEXT bytes hold all of it), and go where they then have at least `least_run` bytes. No word or character is split.

A document is an id and a text: texts of one id are told apart by a hash, and of these the one of the lower hash counts as the earlier.
Rows of one id and one text are one document, cut alike. Null texts count as empty: they have no chunks and come back empty. Texts of any
length are cut whole. An empty table gives an empty result. Extra columns come back untouched inside `row`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import map_batches, written
from tipoff.llm.hashing import byte_values

SYNC, WINDOW = 32, 80
#: Equal bytes beside a chunk in common are fewer than SYNC + WINDOW.
CONTEXT = 128
LEAST_RUN = 120
#: Ids with several texts that are broadcast at most, 16 bytes each.
MOST_SEVERAL = 200_000

_GEAR = (byte_values() >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - k]] << k over the last 32 bytes, by doubling."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            h[s:] += h[:-s] << np.uint32(s)
    return h


def cuts(raw: bytes) -> list[int]:
    """Chunk ends of a text, the last at its length; none inside a character."""
    n = len(raw)
    if n <= WINDOW:
        return [n] if n else []
    data = np.frombuffer(raw, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    # places 1 to n - 1; word starts before other characters before places inside characters
    rank = gear(data)[:-1] >> np.uint32(2)
    rank[~(space[:-1] & ~space[1:])] |= np.uint32(1 << 30)
    rank[data[1:] & 0xC0 == 0x80] = np.uint32(0xFFFFFFFF)
    least = (rank.astype(np.uint64) << np.uint64(32)) | np.arange(1, n, dtype=np.uint64)
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        if len(least) <= step:
            break
        least = np.minimum(least[:-step], least[step:])
        width += step
    ends = np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if (rank[ends[1:] - 1] == rank[ends[:-1] - 1]).any():  # periodic text: equal ranks side by side
        out = [int(ends[0])]
        for e in ends[1:].tolist():
            if rank[e - 1] != rank[out[-1] - 1] or e - out[-1] >= WINDOW:
                out.append(e)
        return [*out, n]
    return [*ends.tolist(), n]


def _chunks(docs: DataFrame) -> DataFrame:
    """(id, t, text) -> id, t, at (byte where the chunk starts), n (its bytes), a and b (its digest)."""

    def make():
        def step(batch):
            row, at, size, names = [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                raw, start = (text or "").encode(), 0
                for end in cuts(raw):
                    before = min(start, SYNC)
                    names.append(hashlib.blake2b(b"%d " % before + raw[start - before : end], digest_size=16).digest())
                    at.append(start)
                    size.append(end - start)
                    row.append(k)
                    start = end
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            keys = [batch.column(k).take(pa.array(row, pa.int64())) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(at, pa.int64()), pa.array(size, pa.int32()), pa.array(np.ascontiguousarray(name[:, 0])), pa.array(np.ascontiguousarray(name[:, 1]))], ["id", "t", "at", "n", "a", "b"])

        return step

    return map_batches(docs, make, "id long, t long, at long, n int, a long, b long")


def _alike(x: bytes, y: bytes) -> int:
    """How many first bytes are equal."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return next(k for k in range(n) if x[k] != y[k])


def _joins(raw: bytes, p: int) -> bool:
    """Whether place p is inside a word or a character of several bytes."""
    if not 0 < p < len(raw):
        return False
    return raw[p] & 0xC0 == 0x80 or (raw[p - 1 : p].isalnum() or raw[p - 1] >= 128) and (raw[p : p + 1].isalnum() or raw[p] >= 128)


def extended(raw: bytes, start: int, end: int, before: bytes | None, after: bytes | None) -> tuple[int, int]:
    """A run's ends after it took in what agrees with the bytes before and after its first occurrence. The added ends split no word; in
    text without spaces, no character."""
    a = start - _alike(raw[max(0, start - CONTEXT) : start][::-1], (before or b"")[::-1])
    b = end + _alike(raw[end : end + CONTEXT], after or b"")
    left = next((p for p in range(a, start) if not _joins(raw, p) and not raw[p : p + 1].isspace()), start)
    right = next((p for p in range(b, end, -1) if not _joins(raw, p)), end)
    if left == start and _joins(raw, start):
        left = next(p for p in range(a, start + 1) if raw[p] & 0xC0 != 0x80)
    if right == end and _joins(raw, end):
        right = next(p for p in range(b, end - 1, -1) if p == len(raw) or raw[p] & 0xC0 != 0x80)
    return left, right


def kept_text(text: str | None, repeated: list[dict] | None, least_run: int = LEAST_RUN) -> tuple[str, int, int]:
    """(what stays, bytes removed, spans removed); repeated: runs of chunks that stand elsewhere first, with the bytes around that place."""
    raw = (text or "").encode()
    if not repeated:
        return text or "", 0, 0
    runs = []
    for a, b in sorted(extended(raw, r["start"], r["end"], r["before"], r["after"]) for r in repeated):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    runs = [r for r in runs if r[1] - r[0] >= least_run]
    parts, last = [], 0
    for a, b in runs:
        parts.append(raw[last:a])
        last = b
    return b"".join([*parts, raw[last:]]).decode(), sum(b - a for a, b in runs), len(runs)


_RUN = ("id", "t", "start", "end", "left_id", "left_t", "left_at", "right_id", "right_t", "right_at")


def _runs(later: DataFrame) -> DataFrame:
    """(id, t, chunks (at, n, first: id, t, at)) -> its runs of adjoining chunks, and where their ends stand first."""

    def make():
        def step(batch):
            out = []
            for i, t, found in (row for at in range(0, batch.num_rows, 200) for row in zip(*(batch.slice(at, 200).column(k).to_pylist() for k in range(3)), strict=True)):
                runs: list[list] = []
                for c in sorted(found, key=lambda c: (c["at"], c["n"])):
                    first, at, end = c["first"], c["at"], c["at"] + c["n"]
                    place = (first["id"], first["t"], first["at"] + c["n"])
                    if runs and runs[-1][3] == at:
                        runs[-1][3], runs[-1][7:] = end, place
                    else:
                        runs.append([i, t, at, end, first["id"], first["t"], first["at"], *place])
                out += runs
            columns = list(zip(*out, strict=True)) or [[]] * len(_RUN)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_RUN))

        return step

    return map_batches(later, make, ", ".join(f"{c} long" for c in _RUN))


def _contexts(asked: DataFrame) -> DataFrame:
    """(id, t, row, text, places (at, after)) -> id, t, at, after, context: the CONTEXT bytes after or before each place."""

    def make():
        def step(batch):
            row, at, after, context = [], [], [], []
            for k, (text, places) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if places:
                    raw = (text or "").encode()
                    for p in places:
                        x = p["at"]
                        row.append(k)
                        at.append(x)
                        after.append(p["after"])
                        context.append(raw[x : x + CONTEXT] if p["after"] else raw[max(0, x - CONTEXT) : x])
            keys = [batch.column(k).take(pa.array(row, pa.int64())) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(at, pa.int64()), pa.array(after, pa.bool_()), pa.array(context, pa.binary())], ["id", "t", "at", "after", "context"])

        return step

    return map_batches(asked, make, "id long, t long, at long, after boolean, context binary")


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(id, t, row, text) -> id, t, runs: the runs of chunks that stand elsewhere, or earlier in the document, first, and what is around that place."""
    chunks = written(_chunks(rows.select("id", "t", "text").filter(F.col("id").isNotNull())), "chunks")
    place = F.struct("id", "t", "at")
    first = chunks.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") < F.col("last"))
    # a merge join whatever the size: its skewed partitions are split, and the table of repeats grows with the corpus
    later = chunks.hint("merge").join(first.select("a", "b", "first"), ["a", "b"]).filter(place > F.col("first"))
    found = later.select("id", "t", F.struct("at", "n", "first").alias("chunk"))
    runs = written(_runs(found.groupBy("id", "t").agg(F.collect_set("chunk").alias("chunks"))), "chunk-runs")
    side = lambda s, after: F.struct(F.col(f"{s}_id").alias("f"), F.col(f"{s}_t").alias("ft"), F.col(f"{s}_at").alias("at"), F.lit(after).alias("after"))
    wanted = runs.select("id", "t", "start", "end", F.explode(F.array(side("left", False), side("right", True))).alias("side")).select("id", "t", "start", "end", "side.*")
    places = wanted.select("f", "ft", "at", "after").distinct().groupBy(F.col("f").alias("id"), F.col("ft").alias("t")).agg(F.collect_list(F.struct("at", "after")).alias("places"))
    # the left join of whole rows shares its exchange with deduplicated(), so texts are dealt out once
    context = _contexts(rows.hint("merge").join(places, ["id", "t"], "left").select("id", "t", "row", "text", "places")).withColumnsRenamed({"id": "f", "t": "ft"})
    known = wanted.hint("merge").join(context, ["f", "ft", "at", "after"])
    whole = known.groupBy("id", "t", "start", "end").agg(F.max(F.when(~F.col("after"), F.col("context"))).alias("before"), F.max(F.when(F.col("after"), F.col("context"))).alias("after"))
    return whole.groupBy("id", "t").agg(F.collect_list(F.struct("start", "end", "before", "after")).alias("runs"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """(id, row, text) with t: 0 for an id of one text, else a hash of the text. Few ids have several, so hashes are not dealt out with every
    chunk; beyond MOST_SEVERAL such ids, which are not broadcast, every row has its hash, with the same result."""
    t = F.xxhash64("text")
    several = written(rows.groupBy("id").agg(F.min(t).alias("x"), F.max(t).alias("y")).filter("x < y").select("id", F.lit(True).alias("several")), "chunk-several")
    if several.limit(MOST_SEVERAL + 1).count() > MOST_SEVERAL:
        return rows.select("id", t.alias("t"), "row", "text")
    return rows.join(F.broadcast(several), "id", "left").select("id", F.when(F.col("several"), t).otherwise(F.lit(0)).cast("long").alias("t"), "row", "text")


def deduplicated(docs: DataFrame, least_run: int = LEAST_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: row (a struct of all its columns but the text, whatever their names), text (what stays), n_removed bytes, n_spans
    and n_bytes before. Rows of a null id keep their text."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = _told_apart(docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*others).alias("row"), F.col(text_col).alias("text")))
    joined = rows.hint("merge").join(repeated_runs(rows), ["id", "t"], "left").select("row", "text", "runs")

    def make():
        def step(batch):
            texts, runs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = [kept_text(t, r, least_run) for t, r in zip(texts, runs, strict=True)]
            own = [pa.array([o[0] for o in out], pa.string()), *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2)), pa.array([len((t or "").encode()) for t in texts], pa.int64())]
            return pa.RecordBatch.from_arrays([batch.column(0), *own], ["row", "text", "n_removed", "n_spans", "n_bytes"])

        return step

    return map_batches(joined, make, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_removed long, n_spans long, n_bytes long")
