"""Benchmark decontamination by template canonicalisation.

Texts become templates: words in lower case without ASCII punctuation, where a word with a digit is <number>, a unit of measure after a
number is <unit>, a capitalised word inside a sentence is <name>, and a run of one kind is one placeholder. Windows of WIDTH template
tokens of the benchmark (an item with fewer: all of it) are joined by hash with those of every document. Windows on one diagonal of a document
and an item add up; an item is found where they cover RUN tokens in one run, or SHARE of the item, and its slots are consistent: equal
values of the item are equal in the document, and different ones are different, in every kind of slot. So a question with other
numbers or names is caught, and a text that only has the same shape is not. A run of RUN tokens, or SHARE of the item and a window at
least, with the item's own values counts whatever the slots around it hold.

Windows of words without placeholders, their case folded, are joined in the same way: they find exact copies of items in capitals or in
title case, of which templates keep next to nothing, and copies in another case.

Windows of both kinds are a table of (hash, item, place), as large as the benchmark. Documents are scanned once: a window whose bit is
set in a bit set of BITS bits, made from all hashes of that table and sent to every task, is a candidate with its values beside it; candidates
meet the table in a hash join, and the windows of a row and an item are judged together. The bit set has a fixed size: a larger benchmark
gives more candidates, never other rows. Executors that are lost cost only their tasks: the scan's candidates and the windows are written
tables.

Each row of docs gives one row, whatever its id: null and repeated ids are told apart by a number that the scan gives each row. Repeated items
and items of one id count as one item id; items of a null id are left out. Null and empty texts and items, and items with fewer than LEAST
words without a digit, match nothing; so does everything where either table is empty. Documents may have any length; extra columns are
ignored, whatever their names. Ties have no order: item_ids are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import chunks, map_batches, written
from tipoff.llm.hashing import BASE, Prefix, mixed

WIDTH, RUN, SHARE, LEAST = 8, 13, 0.5, 3
#: Bits of the candidate filter: 8 MB at any size of the benchmark.
BITS = 1 << 26
NUMBER, UNIT, NAME = 1, 2, 3
#: Units of measure, in English, then German, French and Spanish.
UNITS = ("mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound pounds ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years kmh mph hz khz mhz v volt volts w watt watts kw j joule joules n newton newtons c f k degree degrees percent dollar dollars euro euros cent cents usd eur"
    " kilometer zentimeter millimeter meile meilen gramm kilogramm tonne tonnen pfund sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre grad prozent"
    " mètre mètres kilomètre kilomètres gramme grammes kilo kilos tonnes livre livres seconde secondes heure heures jour jours semaine semaines mois an ans année années degré degrés"
    " metro metros kilómetro kilómetros gramo gramos tonelada toneladas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados céntimos").split()
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 33 or b == 127 or 33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 else b for b in range(256))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(raw.translate(_FOLD) + b" ", np.uint8)
    space = data == 32
    edge = np.flatnonzero(np.diff(np.concatenate([[1], space.astype(np.int8)])))
    start, end = edge[::2], edge[1::2]
    return Prefix(data).of(start, end), start, end


_UNIT_HASHES = np.sort(_word_hashes(" ".join(UNITS).encode())[0])


def templates(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, value, kind, where each text's tokens begin): kind 0 is a word; the value of a placeholder names what it replaced."""
    raw = [(t or "").encode() for t in texts]
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    value, start, end = _word_hashes(joined)
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    n = len(start)
    if not n:
        return value, value, np.zeros(0, np.int64), np.zeros(len(raw) + 1, np.int64)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57), dtype=np.int64)])
    stops = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".!?:;\"\n", np.uint8)), dtype=np.int64)])
    owner = np.searchsorted(bounds, start, "right") - 1
    same = np.zeros(n, bool)
    same[1:] = owner[1:] == owner[:-1]
    number = digits[end] > digits[start]
    inside = np.zeros(n, bool)
    inside[1:] = same[1:] & (stops[start[1:]] == stops[end[:-1]])
    # A-Z, and the capitals of Latin-1, Greek and Cyrillic by their two bytes
    one, two = data[start], data[np.minimum(start + 1, len(data) - 1)]
    capital = (one >= 65) & (one <= 90) | (one == 0xC3) & (two >= 0x80) & (two <= 0x9E) | (one == 0xCE) & (two >= 0x91) & (two <= 0xA9) | (one == 0xD0) & (two >= 0x80) & (two <= 0xAF)
    after = np.zeros(n, bool)
    after[1:] = number[:-1] & same[1:]
    kind = np.where(number, NUMBER, 0)
    at = np.flatnonzero(after & ~number)
    kind[at[np.isin(value[at], _UNIT_HASHES)]] = UNIT
    kind[inside & capital & (kind == 0)] = NAME
    first = np.ones(n, bool)
    first[1:] = ~((kind[1:] > 0) & (kind[1:] == kind[:-1]) & same[1:])
    keep = np.flatnonzero(first)
    value, kind, owner = np.add.reduceat(value, keep), kind[keep], owner[keep]
    token = np.where(kind > 0, mixed(kind.astype(np.uint64) + np.uint64(0x51ED)), value)
    return token, value, kind, np.searchsorted(owner, np.arange(len(raw) + 1))


def literals(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word in folded case, whether it has a digit, where each text's words begin)."""
    raw = [(t or "").casefold().encode() for t in texts]
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    word, start, end = _word_hashes(joined)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57), dtype=np.int64)])
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    return word, digits[end] > digits[start], np.searchsorted(start, bounds)


def windows(token: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each window of `width` tokens inside one text."""
    m = len(token) - width + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k in range(width):
        h = h * np.uint64(BASE) + token[k : m + k]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(owner[:m] == owner[width - 1 :])
    return mixed(h[at]), at


def views(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the view, token, value, kind or digit, where each text's tokens begin): templates, then words in folded case."""
    token, value, kind, first = templates(texts)
    yield 0, token, value, kind, first
    word, digit, first = literals(texts)
    yield 1, word, word, digit.astype(np.int64), first


def named(h: np.ndarray, view: int, width: int) -> np.ndarray:
    """Hashes of windows of one view and width, apart from those of others."""
    return mixed(h + np.uint64(view * 64 + width))


def _spread(a: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    """Lists of the `width` values from each place on."""
    flat = a[at[:, None] + np.arange(width)].ravel().astype(np.int64, copy=False) if len(at) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(flat))


def item_windows(texts: list[str | None]) -> list[pa.RecordBatch]:
    """Windows of items: h, view, width, item (number in `texts`), place, size (tokens of the item), kinds, values."""
    out = []
    for view, token, value, kind, first in views(texts):
        size, plain = np.diff(first), kind == 0
        so_far = np.concatenate([[0], np.cumsum(plain)])
        words = so_far[first[1:]] - so_far[first[:-1]]
        for width in sorted({*np.minimum(size[words >= LEAST], WIDTH).tolist()}):
            h, at = windows(token, first, width)
            item = np.searchsorted(first, at, "right") - 1
            ok = (words[item] >= LEAST) & ((size[item] == width) if width < WIDTH else True) & (so_far[at + width] - so_far[at] >= LEAST)
            h, at, item = h[ok], at[ok], item[ok]
            n = len(at)
            columns = (named(h, view, width).view(np.int64), np.full(n, view), np.full(n, width), item, at - first[item], size[item])
            out.append(pa.RecordBatch.from_arrays([*map(pa.array, columns), _spread(kind, at, width), _spread(value.view(np.int64), at, width)], ["h", "view", "width", "item", "place", "size", "kinds", "values"]))
    return out


def judged(rows: list[tuple[int, int, int, int, int, list[int], list[int], list[int]]]) -> tuple[int, bool] | None:
    """rows: (view, shift, place, width, size, kinds, the item's values, the document's values) of one document's windows that one item has
    too -> (tokens matched, whether slots hold other values), or None where they do not make the item."""
    best: tuple[int, bool] | None = None
    for (view, _), same in groupby(sorted(rows, key=lambda r: r[:3]), key=lambda r: r[:2]):
        same = list(same)
        size, where, kinds, mine, theirs = same[0][4], [], {}, {}, {}
        for _, _, p, width, _, k, x, y in same:
            if where and p <= where[-1][1]:
                where[-1][1] = max(where[-1][1], p + width)
            else:
                where.append([p, p + width])
            if not view:
                for d in range(width):
                    kinds[p + d], mine[p + d], theirs[p + d] = k[d], x[d], y[d]
        total = sum(b - a for a, b in where)
        if max(b - a for a, b in where) < RUN and total < SHARE * size:
            continue
        other = False
        if not view:
            there: dict = {}
            back: dict = {}
            slots = [(kinds[p], mine[p], theirs[p]) for p in sorted(kinds) if kinds[p]]
            if all(there.setdefault((k, x), y) == y and back.setdefault((k, y), x) == x for k, x, y in slots):
                other = any(x != y for _, x, y in slots)
            else:
                # a run with the item's own values needs no consistency of the slots around it
                total = longest_equal(where, mine, theirs)
                if total < RUN and total < max(SHARE * size, min(WIDTH, size)):
                    continue
        best = (total, other) if best is None else (max(best[0], total), best[1] and other)
    return best


def longest_equal(where: list[list[int]], mine: dict[int, int], theirs: dict[int, int]) -> int:
    """Tokens of the longest run of words and slots equal to the item's."""
    longest = 0
    for a, b in where:
        now = 0
        for p in range(a, b):
            now = now + 1 if mine[p] == theirs[p] else 0
            longest = max(longest, now)
    return longest


def _windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The benchmark's windows, written once, with a number for each item."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()

    def make():
        def step(batch):
            out, n = [], 0
            for some in chunks(batch.column(1).to_pylist()):
                for found in item_windows(some):
                    item = batch.column(0).take(pa.array(np.asarray(found.column(3)) + n))
                    out.append(pa.RecordBatch.from_arrays([item, *(found.column(k) for k in (0, 1, 2, 4, 5, 6, 7))], ["item", "h", "view", "width", "place", "size", "kinds", "values"]))
                n += len(some)
            return pa.concat_batches(out) if out else None

        return step

    # the text itself tells items of one id apart, as windows of different texts must not make one item
    named_items = items.select(F.struct("item_id", F.xxhash64("text").alias("text_hash")).alias("item"), "text")
    rows = map_batches(named_items, make, "item struct<item_id:bigint,text_hash:bigint>, h long, view long, width long, place long, size long, kinds array<long>, values array<long>")
    return written(rows.select("item.*", "h", "view", "width", "place", "size", "kinds", "values"), "benchmark-windows")


def _bits(table: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(the bit set of all hashes, the views and widths that occur): BITS / 8 bytes at most reach the driver, whatever the benchmark's size."""
    slot = F.shiftrightunsigned("h", 64 - BITS.bit_length() + 1)
    words = table.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - BITS.bit_length() + 1}) & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
    return out, sorted((r["view"], r["width"]) for r in table.select("view", "width").distinct().collect())


def _candidates(docs: DataFrame, bits: np.ndarray, kinds: list[tuple[int, int]], id_col: str, text_col: str) -> DataFrame:
    """One row for each of docs: id, hits (h, view, width, at, values): its windows that the bit set lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    shift = np.uint64(64 - BITS.bit_length() + 1)

    def hits(texts: list[str | None]) -> list[list[dict]]:
        found: list[list[dict]] = [[] for _ in texts]
        own = shared.value
        for view, token, value, _, first in views(texts):
            for v, width in kinds:
                if v != view:
                    continue
                h, at = windows(token, first, width)
                h = named(h, view, width)
                slot = h >> shift
                maybe = np.flatnonzero(own[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
                text = np.searchsorted(first, at[maybe], "right") - 1
                for k, t in zip(maybe.tolist(), text.tolist(), strict=True):
                    a = int(at[k])
                    found[t].append({"h": int(h[k].view(np.int64)), "view": view, "width": width, "at": a - int(first[t]), "values": None if view else value[a : a + width].view(np.int64).tolist()})
        return found

    kind = pa.list_(pa.struct([("h", pa.int64()), ("view", pa.int64()), ("width", pa.int64()), ("at", pa.int64()), ("values", pa.list_(pa.int64()))]))

    def make():
        def step(batch):
            out = []
            for some in chunks(batch.column(1).to_pylist()):
                out += hits(some)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["id", "hits"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, make, "id long, hits array<struct<h:bigint,view:bigint,width:bigint,at:bigint,values:array<bigint>>>")


def _judged(met: DataFrame) -> DataFrame:
    """Windows (row, item_id, text_hash, view, shift, place, width, size, kinds, mine, theirs), those of a row and item side by side -> row, item_id, tokens, other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        done: list[tuple] = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["row", "item_id", "tokens", "other"])

        for (row, item, _), same in groupby(flat(), key=lambda r: r[:3]):
            if (found := judged([r[3:] for r in same])) is not None:
                done.append((row, item, *found))
            if len(done) >= 10_000:
                yield flush()
                done.clear()
        if done:
            yield flush()

    return met.mapInArrow(run, "row long, item_id long, tokens long, other boolean")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: id, contaminated, n_items, item_ids, matched_tokens (of the best item), reparameterised (no item with its own values)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = _windows(benchmark, item_col, item_text)
    rows = _candidates(docs, *_bits(table), id_col, text_col)
    # rows are numbered once, in the table
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "hits"), "benchmark-candidates")
    hits = rows.select("row", F.inline("hits"))
    met = hits.withColumnRenamed("values", "theirs").hint("merge").join(table.withColumnRenamed("values", "mine"), ["h", "view", "width"])
    met = met.select("row", "item_id", "text_hash", "view", (F.col("at") - F.col("place")).alias("shift"), "place", "width", "size", "kinds", "mine", "theirs")
    found = _judged(met.repartition(n, "row").sortWithinPartitions("row", "item_id", "text_hash"))
    each = found.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("tokens").alias("matched_tokens"), F.min("other").alias("reparameterised"))
    out = rows.select("row", F.col("id").alias(id_col)).hint("merge").join(each, "row", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<long>"))
    return out.select(id_col, F.col("item_ids").isNotNull().alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"), F.coalesce("matched_tokens", F.lit(0)).alias("matched_tokens"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"))
