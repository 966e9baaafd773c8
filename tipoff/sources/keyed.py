"""Large json objects of entries by key, read in splits and written in parts.

Spark's text reader cuts a file of any size, in any store it can read, into splits of pieces that end at `}`. Whether a split begins inside a
text, and how deep in the nesting, follows from the splits before it: each split counts its quotes and its brackets under both assumptions, and a
running sum over a file's splits (a row each) settles which held. With that, each split finds the entries of the outer object; what an entry
has on either side of a cut is put together by key of the entry, so an entry may also span several splits.

Commas, braces and escaped quotes inside texts do not count. A repeated key comes back as often as it stands. Objects without entries, empty
files and paths that are not there give no rows. What is not an object of entries by key gives none either.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tipoff.sources.staged import staged

CUT = "}"
_ESCAPED = re.compile(rb"\\.", re.S)
QUOTE, COMMA, OPEN, CLOSE = (ord(c) for c in '",{}')
#: Depth that a byte adds outside of texts, and the bytes that count at all.
_DEEPER = np.zeros(256, np.int8)
_DEEPER[[OPEN, ord("[")]], _DEEPER[[CLOSE, ord("]")]] = 1, -1
_COUNTS = _DEEPER != 0
_COUNTS[[QUOTE, COMMA]] = True


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """value (a piece with its end), file, block (first byte of its split); a split's pieces come in order."""
    out = None
    for path in paths:
        try:
            one = spark.read.option("lineSep", CUT).text(path).select(F.concat("value", F.lit(CUT)).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = one if out is None else out.unionByName(one)
    return out


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], memoryview, tuple]]:
    """(file, block), the pieces of a batch that are the split's as one run of bytes, further columns of its first row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts, file, block = (batch.column(k) for k in range(3))
        starts = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1]
        data, blocks = memoryview(texts.buffers()[2]), block.to_numpy()
        turns = (blocks[1:] != blocks[:-1]) | pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        for a, b in pairwise([0, *(np.flatnonzero(turns) + 1).tolist(), n]):
            yield (file[a].as_py(), int(blocks[a])), data[starts[a] : starts[b]], tuple(batch.column(k)[a].as_py() for k in range(3, batch.num_columns))


def _tokens(text: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and bytes of quotes, brackets and commas, how much deeper each leads, and the quotes up to each; what is escaped is none. A run of
    pieces never ends within an escape."""
    plain = bytes(text)
    b = np.frombuffer(_ESCAPED.sub(b"__", plain) if b"\\" in plain else plain, np.uint8)
    at = np.flatnonzero(_COUNTS[b])
    kind = b[at]
    return at, kind, _DEEPER[kind], np.cumsum(kind == QUOTE)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each split, and how much deeper it ends than it begins, outside of texts, if it begins outside (0) or inside (1) of one."""
    found: dict[tuple[str, int], list[int]] = {}
    for split, text, _ in _by_split(batches):
        own = found.setdefault(split, [0, 0, 0])
        _, _, deeper, quotes = _tokens(text)
        if len(quotes):
            odd = (own[0] + quotes) % 2 == 1
            own[1] += int(deeper[~odd].sum(dtype=np.int64))
            own[2] += int(deeper[odd].sum(dtype=np.int64))
            own[0] += int(quotes[-1])
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found]), *(pa.array(c, pa.int64()) for c in zip(*((b, *v) for (_, b), v in found.items()), strict=True))], ["file", "block", "quotes", "outside", "inside"])


class _Reader:
    """Follows one split from its state at the start; gives whole entries, and what stands before its first and after its last boundary."""

    def __init__(self, in_text: bool, depth: int):
        self.in_text, self.depth = in_text, depth
        self.parts: list[bytes] = []
        self.bounded = False

    def rest(self) -> str:
        return b"".join(self.parts).decode()

    def take(self, text: memoryview) -> Iterator[tuple[bool, str]]:
        """(whether a boundary stood before it in this split, text) of each run that ends at a boundary."""
        at, kind, deeper, quotes = _tokens(text)
        start = 0
        if len(at):
            outside = (quotes + self.in_text) % 2 == 0
            deeper = np.where(outside, deeper, 0)
            after = self.depth + np.cumsum(deeper, dtype=np.int64)
            before = after - deeper
            ends = outside & np.where(kind == OPEN, before == 0, ((kind == COMMA) | (kind == CLOSE)) & (before == 1))
            self.in_text, self.depth = not outside[-1], int(after[-1])
            for end in at[ends].tolist():
                self.parts.append(bytes(text[start:end]))
                yield self.bounded, self.rest()
                self.parts, self.bounded, start = [], True, end + 1
        self.parts.append(bytes(text[start:]))


def _entry(text: str) -> tuple[str, str] | None:
    """Key and value of a `"key": value` text; None for what is none."""
    text = text.strip().removeprefix("\ufeff")
    if text.startswith('"'):
        key, end = json.JSONDecoder().raw_decode(text)
        rest = text[end:].lstrip()
        if rest.startswith(":"):
            return key, rest[1:].strip()
    return None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, file, block, in_text, depth) -> file, block, part (0: up to the split's first boundary, 1: a whole entry, with its key, 2: after the
    last one), bounded, key, value."""
    split, reader, rows = None, None, []
    kinds = {"file": pa.string(), "block": pa.int64(), "part": pa.int32(), "bounded": pa.bool_(), "key": pa.string(), "value": pa.string()}

    def batch():
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))

    def close():
        rows.append((*split, 2 if reader.bounded else 0, reader.bounded, None, reader.rest()))

    size = 0
    for now, piece, (in_text, depth) in _by_split(batches):
        if now != split:
            if reader is not None:
                close()
            split, reader = now, _Reader(in_text, depth)
        for bounded, text in reader.take(piece):
            if not bounded:
                rows.append((*split, 0, True, None, text))
            elif (named := _entry(text)) is not None:
                rows.append((*split, 1, True, *named))
            size += len(text)
            if size > 1_000_000 or len(rows) > 10_000:
                if rows:
                    yield batch()
                size = 0
    if reader is not None:
        close()
    if rows:
        yield batch()


def entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, key, value (json) of each entry of the objects at `paths`."""
    pieces = _pieces(spark, paths)
    if pieces is None:
        return spark.createDataFrame([], "file string, key string, value string")
    counts = staged(pieces.select("value", "file", "block").mapInArrow(_counts, "file string, block long, quotes long, outside long, inside long"), "json-counts")
    # a task may hold part of a split's count only if the split is read by several tasks, which it is not; the sum is a row a split
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    texts = counts.withColumn("in_text", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    deeper = F.when(F.col("in_text"), F.col("inside")).otherwise(F.col("outside"))
    states = texts.withColumn("deeper", deeper).select("file", "block", "in_text", F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth"))
    # a row for each split of the scan, which the driver lists anyway
    runs = staged(pieces.join(F.broadcast(states), ["file", "block"]).select("value", "file", "block", "in_text", "depth").mapInArrow(_runs, "file string, block long, part int, bounded boolean, key string, value string"), "json-runs")
    whole = runs.filter("part = 1").select("file", "key", "value")
    # the pieces of an entry that was cut: one ends a split, others fill splits, the last ends at a boundary
    cut = runs.filter("part <> 1")
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.select("file", "block", "part", F.coalesce(F.sum(F.when((F.col("part") == 0) & F.col("bounded"), 1).otherwise(0)).over(order), F.lit(0)).alias("entry"))
    joined = cut.join(ends, ["file", "block", "part"]).groupBy("file", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "value"))), lambda x: x["value"]), "").alias("value"))
    return whole.unionByName(_named(joined.select("file", "value")))


def _named(raw: DataFrame) -> DataFrame:
    """`"key": value` texts -> file, key, value; what is none goes. Two rows of a split at most come here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(file.as_py(), *named) for file, text in zip(batch.column(0), batch.column(1), strict=True) if (named := _entry(text.as_py())) is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["file", "key", "value"])

    return raw.mapInArrow(run, "file string, key string, value string")


def write_entries(rows: DataFrame, path: str, metadata: DataFrame | None = None, parts: int | None = None) -> None:
    """rows (key, value: json) as `parts` json objects (as many as a shuffle has partitions if not given), one for each part file, an entry a line.
    metadata: one row, which each object has as its entry `_metadata`."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = "" if metadata is None else '"_metadata":' + metadata.select(F.to_json(F.struct("*")).alias("value")).first()[0]
    name = F.to_json(F.array("key"))
    lines = rows.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("place"), F.concat(F.substr(name, F.lit(2), F.length(name) - 2), F.lit(":"), "value").alias("line"))
    ends = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.inline(F.array(*(F.struct(F.lit(place).alias("place"), F.lit(line).alias("line")) for place, line in ((0, "{" + first), (2, "}"))))))
    placed = lines.unionByName(ends).repartitionById(parts, "part").sortWithinPartitions("place")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in its file
    comma = (F.col("place") == 1) & ((row > 1) | F.lit(first != ""))
    placed.select(F.concat(F.when(comma, ",").otherwise(""), "line").alias("value")).write.mode("errorifexists").text(path)
