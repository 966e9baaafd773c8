"""Suffix-array dedup: remove each byte covered by a string of WIDTH bytes that starts anywhere else too.

1. Texts that are equal are one class; a class of several texts of at least WIDTH bytes is covered whole, and one of it stands for the rest.
2. Each window of WIDTH bytes belongs to an anchor: the gram of GRAM bytes with the least hash in it, the first of equal ones. Equal
   windows have equal anchors at equal offsets, so only windows around equal grams need comparing. An anchor and its windows are a segment.
3. Segments that occur more than once under a gram are covered whole. The others of a gram are compared on their bytes: columns on
   which all agree become one symbol, the segments are joined with closing symbols, and a suffix array by linear grouping with the
   lengths of common prefixes gives each suffix's longest match; matches of WIDTH bytes or more are covered.
4. Under a gram of more than GROUP different segments, whole windows are matched by 128-bit names instead, spread over all tasks, so no
   group needs one task to hold it and none is left out. The starts of a text's matched windows are kept as 64-bit masks.
5. A segment, gram or text with over one in SHARE of all rows (so SHARE of them at most) is met by broadcast or dealt in parts, the others
   by key, so a passage that every document holds is no task of its own.

Null texts count as empty. Texts under WIDTH bytes are never touched. Texts of any length are read in overlapping pieces of PIECE bytes.
Repeated rows count as copies of each other, whatever their ids; a null id comes back as null. All copies of a repeat go, so ties have no
order. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import map_batches, written
from tipoff.llm.hashing import Prefix
from tipoff.llm.suffix_array import suffix_array

WIDTH, GRAM = 400, 128
PIECE = 1 << 22
GROUP = 1024
SHARE = 1000
_LOW = np.uint64((1 << 24) - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    full = np.concatenate([x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(full, axis=1).ravel()
    after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def segments(raw: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor's gram hash, two hashes of the segment, start, end, anchor) of a text's segments; the anchor is counted from the start."""
    out = []
    for base in range(0, max(1, len(raw) - width + 1), PIECE):
        data = np.frombuffer(raw[base : base + PIECE + width - 1], np.uint8)
        if len(data) < width:
            continue
        prefix = Prefix(data)
        h = prefix.windows(gram)
        least = sliding_least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), width - gram + 1) & _LOW
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        at = least[first].astype(np.int64)
        end, left = last + width, at - first
        a = prefix.of(first, end) + left.astype(np.uint64)
        b = prefix.of(first + left, end) + left.astype(np.uint64) * np.uint64(31) + prefix.of(first, first + left) * np.uint64(17)
        out.append((h[at], a, b, first + base, end + base, left))
    if not out:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none.view(np.uint64), none, none, none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def longest_matches(text: list[int], weight: list[int]) -> list[int]:
    """For each suffix the weight of its longest common prefix with another suffix."""
    order = suffix_array(text)
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    total = [0]
    for w in weight:
        total.append(total[-1] + w)
    best, k = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + k < n and j + k < n and text[i + k] == text[j + k]:
                k += 1
            best[i] = max(best[i], total[i + k] - total[i])
            best[j] = max(best[j], total[j + k] - total[j])
            k = max(0, k - 1)
        else:
            k = 0
    return best


def _clusters(data: list[bytes], left: list[int], width: int) -> list[list[int]]:
    """Segments that may share a window at one offset, by the windows' hashes: a filter that loses none."""
    size = np.array([len(d) for d in data])
    prefix = Prefix(np.frombuffer(b"".join(data), np.uint8))
    start = np.cumsum(size) - size
    n = size - width + 1
    row = np.repeat(np.arange(len(data)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = start[row] + at
    h = prefix.of(place, place + width) + (np.array(left)[row] - at).astype(np.uint64)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    one, two = row[order][:-1][same], row[order][1:][same]
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i

    for pair in np.unique(one * len(data) + two).tolist():
        a, b = root(pair // len(data)), root(pair % len(data))
        parent[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for i in list(parent):
        out.setdefault(root(i), []).append(i)
    return [sorted(x) for x in out.values() if len(x) > 1]


def matched(data: list[bytes], left: list[int], width: int = WIDTH) -> list[tuple[int, int, int]]:
    """(segment, start, end): stretches of at least `width` bytes that another segment has at the same offset from its anchor."""
    out = []
    for members in _clusters(data, left, width):
        most = max(left[i] for i in members)
        wide = max(most - left[i] + len(data[i]) for i in members)
        table = np.full((len(members), wide), -1, np.int32)
        for r, i in enumerate(members):
            table[r, most - left[i] : most - left[i] + len(data[i])] = np.frombuffer(data[i], np.uint8)
        differ = (table != table[0]).any(axis=0) | (table < 0).any(axis=0)
        edge = np.flatnonzero(np.concatenate([[True], differ[1:] | differ[:-1]]))
        span = np.diff(np.concatenate([edge, [wide]])).tolist()
        text, weight, where = [], [], []
        # a symbol names its column and its byte, so only matches at the same offset count
        own = (table[:, edge].astype(np.int64) + 1 + np.arange(len(edge)) * 257 + len(members) + 1).tolist()
        for r, i in enumerate(members):
            for c, (symbol, w) in enumerate(zip(own[r], span, strict=True)):
                if table[r, edge[c]] >= 0:
                    text.append(symbol)
                    weight.append(w)
                    where.append((i, int(edge[c]) - most + left[i]))
            text.append(r + 1)
            weight.append(0)
            where.append((i, -1))
        for (i, at), length in zip(where, longest_matches(text, weight), strict=True):
            if length >= width:
                out.append((i, at, at + length))
    return out


def _anchors(texts: DataFrame, width: int) -> DataFrame:
    def make():
        def step(batch):
            columns, ids = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = segments(t.encode(), width)
                columns.append(found)
                ids.append(np.full(len(found[0]), i, np.int64))
            g, a, b, start, end, left = (np.concatenate(c) for c in zip(*columns, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(ids), g.view(np.int64), a.view(np.int64), b.view(np.int64), start, end, left)], ["id", "key", "a", "b", "start", "end", "left"])

        return step

    return map_batches(texts, make, "id long, key long, a long, b long, start long, end long, left long")


def _cut(rows: DataFrame) -> DataFrame:
    """(id, text, places) -> one row for each place with the segment's bytes."""

    def make():
        def step(batch):
            out = []
            for i, t, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = t.encode()
                out += [(i, p["key"], p["start"], p["left"], raw[p["start"] : p["end"]], p["kinds"]) for p in places]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "key", "start", "left", "data", "kinds"])

        return step

    return map_batches(rows, make, "id long, key long, start long, left long, data binary, kinds long")


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """Segments -> id, place and a 128-bit name of each of their windows."""

    def make():
        def step(batch):
            parts = []
            for i, start, left, data in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                n = len(data) - width + 1
                at, prefix = np.arange(n), Prefix(np.frombuffer(data, np.uint8))
                offset = (left - at).astype(np.uint64)
                half = width // 2
                parts.append((np.full(n, i), start + at, prefix.of(at, at + width) + offset, prefix.of(at, at + half) * np.uint64(31) + prefix.of(at + half, at + width)))
            i, at, a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(i), pa.array(at), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["id", "start", "a", "b"])

        return step

    return map_batches(rows, make, "id long, start long, a long, b long")


def _compared(rows: DataFrame, width: int) -> DataFrame:
    """(key, id, start, left, data), those of a key side by side -> covered (id, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, done = None, [], []

        def solve() -> None:
            if len(members) > 1:
                for k, a, b in matched([m[3] for m in members], [m[2] for m in members], width):
                    done.append((members[k][0], members[k][1] + a, members[k][1] + b))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(3)], ["id", "start", "end"])
            done.clear()
            return out

        for batch in batches:
            for k, *member in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if k != key:
                    solve()
                    key, members = k, []
                members.append(member)
            if done:
                yield flush()
        solve()
        if done:
            yield flush()

    return rows.mapInArrow(run, "id long, start long, end long")


def starts_of(masks: list[dict]) -> Iterator[int]:
    """The window starts that masks of 64 places each hold."""
    for m in masks:
        bits, at = m["mask"] & (1 << 64) - 1, 64 * m["block"]
        while bits:
            yield at + (bits & -bits).bit_length() - 1
            bits &= bits - 1


def _left(rows: DataFrame, width: int) -> DataFrame:
    """(id, text, spans, masks) -> id, n_bytes, n_removed, n_spans, kept_sha256, kept."""

    def make():
        last: list = [None, None]  # rows of a class come one after another

        def step(batch):
            out = []
            for t, spans, masks in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if t == last[0]:
                    out.append(last[1])
                    continue
                raw, runs = (t or "").encode(), []
                for s in sorted([(x["start"], x["end"]) for x in spans or ()] + [(a, a + width) for a in starts_of(masks or [])]):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append([*s])
                parts, end = [], 0
                for a, b in runs:
                    parts.append(raw[end:a])
                    end = b
                kept = b"".join([*parts, raw[end:]])
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
                last[:] = t, out[-1]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        return step

    return map_batches(rows, make, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def met(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, how: str = "inner", share: int = SHARE) -> DataFrame:
    """`rows` joined with `groups`, one row for each key with its `size` in rows: the rows of large groups stay where they are."""
    large = groups.filter(F.col(size) * share > total)
    spread = rows.join(F.broadcast(large), on, how)
    rest = rows.join(F.broadcast(large.select(*on)), on, "left_anti").hint("merge").join(groups.filter(F.col(size) * share <= total), on, how)
    return spread.unionByName(rest)


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, share: int = SHARE) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay). Equal texts get equal values."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("name", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    classes = texts.groupBy("name").agg(F.count("*").alias("copies"), F.first("text").alias("text"))  # copies meet before the shuffle
    # numbers are given once and read from the table, so no two classes share one
    own = written(classes.select(F.monotonically_increasing_id().alias("id"), "name", "copies", "text"), "repeat-texts")
    long_enough = own.filter(F.octet_length("text") >= width)
    anchors = written(_anchors(long_enough.select("id", "text"), width), "repeat-anchors")
    kinds = anchors.groupBy("key", "a", "b").agg(F.min(F.struct("id", "start", "end", "left")).alias("one"), F.count("*").alias("n"))
    kinds = written(kinds, "repeat-kinds")
    sizes = written(kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "repeat-sizes")
    twice = kinds.filter("n > 1").select("key", "a", "b", "n")
    whole = met(anchors, twice, ["key", "a", "b"], "n", anchors.count(), "left_semi", share).select("id", "start", "end")
    places = met(kinds, sizes, ["key"], "kinds", kinds.count(), share=share).select(F.col("one.id").alias("id"), F.struct("key", F.col("one.start").alias("start"), F.col("one.end").alias("end"), F.col("one.left").alias("left"), "kinds").alias("place"))
    wanted = places.groupBy("id").agg(F.collect_list("place").alias("places"))
    cut = written(_cut(long_enough.hint("merge").join(wanted, "id").select("id", "text", "places")), "repeat-segments")
    few = cut.filter(F.col("kinds") <= group).select("key", "id", "start", "left", "data")
    found = _compared(few.repartition(n, "key").sortWithinPartitions("key", "id", "start"), width)
    windows = written(_windows(cut.filter(F.col("kinds") > group), width), "repeat-windows")
    common = windows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    hot = windows.hint("merge").join(common, ["a", "b"], "left_semi").select("id", "start").repartition(n, "id")
    # dealt by id once for both groupings
    masks = hot.groupBy("id", F.shiftright("start", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(start & 63 AS INT))")).alias("mask")).groupBy("id").agg(F.collect_list(F.struct("block", "mask")).alias("masks"))
    copies = long_enough.filter(F.col("copies") > 1).select("id", F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"))
    spans = whole.unionByName(found).unionByName(copies)
    gathered = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    # the rows of a class of many copies are dealt in parts, each of which gets the class's text and spans
    total = own.agg(F.sum("copies")).first()[0] or 1
    parts = F.least("copies", F.ceil(F.col("copies") * share / total).cast("long"))
    parted = own.select("id", "name", "text", parts.alias("parts"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    found_in = parted.select("id", "name", "parts").hint("merge").join(gathered, "id", "left").join(masks, "id", "left").select("name", part, "spans", "masks")
    many = F.broadcast(parted.filter("parts > 1").select("name", "parts"))
    rows = texts.select("id", "name").join(many, "name", "left").select("id", "name", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0).cast("long")).alias("part"))
    # a class's text meets its spans and then its rows by one dealing by name and part
    whole_rows = parted.select("name", part, "text").hint("merge").join(found_in, ["name", "part"]).join(rows.hint("merge"), ["name", "part"])
    return _left(whole_rows.select("id", "text", "spans", "masks"), width).withColumnRenamed("id", id_col)
