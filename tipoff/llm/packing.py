"""Best-fit packing of tokenised documents by a grouping genetic algorithm on migrating islands.

A document's tokens, closed by `end_id`, are cut into pieces of `capacity` tokens only where it is longer. Full pieces are
sequences of their own. The rest is dealt by hash into blocks of about BLOCK pieces. Each block is evolved on ISLANDS
islands: an individual is a list of bins; crossover injects whole well-filled bins of one parent into another, drops the
bins that would hold an item twice, and best-fits the displaced items. After each epoch the best individual of an island
moves to the next island of its block. The best island gives the block's sequences; then bins that stayed poorly filled
are dissolved, dealt anew over fewer blocks, and packed in the same way.

An island whose best plan meets the lower bound is done, as no plan has fewer bins; the others run their crossovers.

Null and empty texts are one piece holding only the end id; long texts are cut into as many pieces as they need. Repeated rows are packed
each, whatever their ids, null ids too. An empty table gives no rows; extra columns are ignored. Blocks, islands and elites are
rows of Spark tables of bounded size; nothing is gathered on the driver but a count.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import map_batches, texts_of, written

CAPACITY = 2048
#: Pieces of a block, islands of a block, epochs (with a migration between two), individuals of an island, crossovers of an epoch.
BLOCK, ISLANDS, EPOCHS, POPULATION, CROSSOVERS = 4096, 2, 2, 4, 8
#: Bins filled less than this share are dissolved and packed once more across blocks.
POOR = 0.97
#: Segments whose ids are kept; beyond that the table starts anew.
MEMO = 500_000
#: Characters that str.split() takes for white space and the vocabulary does not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Words of Latin letters that lower-case to one letter each, closed by an ASCII letter.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-įĲ-ɏ]*[A-Za-z]")


# --- tokens -----------------------------------------------------------------------------------------------------------


@lru_cache(2)
def _tokenizer(path: str):
    """The tokenizer; whether an added token holds a space; and for plain words a rank coder with its end-of-word ids.

    In the coder a word's last letter is written as a capital, which stands for the letter with its end-of-word mark; lower-cased
    text has no other capitals. Words that the coder and the tokenizer might see differently are left to the tokenizer."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    spaced = any(" " in t.content for t in tok.get_added_tokens_decoder().values())
    own = [chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    to_byte = {c: ord(c) for c in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in own)}
    ranks: dict[bytes, int] = {}
    for piece, i in tok.get_vocab(with_added_tokens=False).items():
        body = piece.removesuffix("</w>")
        if not body or any(c not in to_byte for c in body):
            continue
        raw = bytes(to_byte[c] for c in body)
        if any(65 <= b <= 90 for b in raw):
            continue
        if body == piece:
            ranks[raw] = i
        elif 97 <= raw[-1] <= 122:
            ranks[raw[:-1] + bytes([raw[-1] - 32])] = i
    free = max(ranks.values(), default=0) + 1
    for b in range(256):
        ranks.setdefault(bytes([b]), free + b)
    coder = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
    ends = np.zeros(free + 256, bool)
    whole = {}
    for raw, i in ranks.items():
        if 65 <= raw[-1] <= 90 and i < free:
            ends[i] = True
            if (word := raw.lower().decode("utf-8", "ignore")).encode() == raw.lower():
                whole[word] = i
    alone = tok.encode_batch(list(whole), add_special_tokens=False)
    unsure = {w for (w, i), e in zip(whole.items(), alone, strict=True) if e.ids != [i]}
    return tok, spaced, coder, ends, unsure


class Ids:
    """Little-endian ids of texts. White space separates tokens of this vocabulary, so a segment between spaces is encoded once."""

    def __init__(self, path: str):
        self.tok, self.spaced, self.coder, self.ends, self.unsure = _tokenizer(path)
        self.memo: dict[str, bytes] = {}

    def encoded(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of each segment: plain words together by the rank coder, told apart by their end-of-word ids, others by the tokenizer."""
        words = [s for s in segments if _WORD.fullmatch(s) and s.lower() not in self.unsure]
        other = list(set(segments).difference(words))
        found = {s: np.asarray(e.ids, "<u4").tobytes() for s, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False), strict=True)} if other else {}
        if words:
            ids = np.asarray(self.coder(" ".join([s[:-1].lower() + s[-1].upper() for s in words])), "<u4")
            at = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            raw = ids.tobytes()
            found.update((w, raw[i:j]) for w, i, j in zip(words, [0, *at[:-1]], at, strict=True))
        return found

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """Ids of segments not yet known; a word with a mark after it is its two parts."""
        memo, cores, found = self.memo, {}, {}
        for s in segments:
            core = s[:-1]
            cores[s] = core if s[-1] in ",.;:!?" and core.isalpha() and core[-1].lower().isalpha() else s
        need = list({c for c in cores.values() if c not in memo} | {s[-1] for s, c in cores.items() if c is not s and s[-1] not in memo})
        own = self.encoded(need)
        for s, c in cores.items():
            found[s] = (memo[c] if c in memo else own[c]) + (b"" if c is s else memo[s[-1]] if s[-1] in memo else own[s[-1]])
        found.update(own)
        return found

    def of(self, texts: list[str]) -> list[bytes]:
        out, memo = [], self.memo
        for k in range(0, len(texts), 64):
            split = [[t] if self.spaced or any(c in t for c in _NOT_SPACE) else t.split() for t in texts[k : k + 64]]
            if len(memo) > MEMO:
                memo.clear()
            memo[""] = b""
            if new := set().union(*split).difference(memo):
                memo.update(self.learn(new))
            out += [b"".join(map(memo.__getitem__, segs)) for segs in split]
        return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32."""

    def make():
        ids, end, width = Ids(path), np.asarray([end_id], "<u4").tobytes(), 4 * capacity

        def step(batch):
            out: list[tuple] = []
            for key, raw in zip(batch.column(0).to_pylist(), ids.of(texts_of(batch.column(1))), strict=True):
                raw += end
                out += [(key, k, k * capacity, min(width, len(raw) - k * width) // 4, zlib.crc32(raw[k * width : (k + 1) * width])) for k in range(-(-len(raw) // width))]
            kinds = [batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [id_col, "piece", "start", "length", "ids_crc32"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), make, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


# --- the genetic algorithm on one island --------------------------------------------------------------------------------


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The larger of the volume bound and the bound from items that cannot share a bin (Martello and Toth's L2)."""
    s = np.sort(np.asarray(sizes, np.int64))[::-1]
    best = -(-int(s.sum()) // capacity)
    total = np.concatenate([[0], np.cumsum(s)])
    for low in np.unique(s[s <= capacity // 2])[:: max(1, len(np.unique(s)) // 64)]:
        big, mid = int((s > capacity - low).sum()), int((s > capacity // 2).sum())
        rest = int((s >= low).sum())
        room = (mid - big) * capacity - int(total[mid] - total[big])
        best = max(best, mid + max(0, -(-(int(total[rest] - total[mid]) - room) // capacity)))
    return best


def best_fit(order, sizes: list[int], capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Put the items of `order` each into the fullest bin that takes it; bins and room grow in place."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in order:
        size = sizes[i]
        above = mask >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            held = by_room[r]
            b = held.pop()
            if not held:
                mask ^= 1 << r
        else:
            b, r = len(bins), capacity
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] = r = r - size
        if r:
            held = by_room.setdefault(r, [])
            if not held:
                mask |= 1 << r
            held.append(b)


def fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more of the room in few bins."""
    r = np.asarray(room, np.float64)
    return len(room), -float(((1 - r / capacity) ** 2).sum())


def crossover(one, two, sizes, capacity, rng):
    """Whole well-filled bins of `two` are injected into `one`; bins of `one` that share an item go and what they lose is best-fitted."""
    (bins1, room1), (bins2, room2) = one, two
    good = [b for b in range(len(bins2)) if room2[b] * 50 <= capacity]
    take = good if len(good) < 2 else rng.sample(good, max(1, len(good) // 2))
    bins, room = [list(bins2[b]) for b in take], [room2[b] for b in take]
    held = {i for b in bins for i in b}
    displaced = []
    for items, r in zip(bins1, room1, strict=True):
        if held.isdisjoint(items):
            bins.append(list(items))
            room.append(r)
        else:
            displaced += [i for i in items if i not in held]
    displaced.sort(key=lambda i: -sizes[i])
    best_fit(displaced, sizes, capacity, bins, room)
    return bins, room


def mutated(one, sizes, capacity, rng):
    """Dissolve the emptiest bins and some others, and best-fit their items."""
    bins, room = one
    order = sorted(range(len(bins)), key=lambda b: -room[b])
    gone = set(order[: max(1, len(bins) // 50)]) | set(rng.sample(order, max(1, len(bins) // 20)))
    kept = [b for b in range(len(bins)) if b not in gone]
    loose = [i for b in gone for i in bins[b]]
    out, left = [list(bins[b]) for b in kept], [room[b] for b in kept]
    loose.sort(key=lambda i: (-sizes[i], rng.random()))
    best_fit(loose, sizes, capacity, out, left)
    return out, left


def as_individual(labels, sizes, capacity):
    bins: list[list[int]] = [[] for _ in range(max(labels, default=-1) + 1)]
    for i, b in enumerate(labels):
        bins[b].append(i)
    return bins, [capacity - sum(sizes[i] for i in b) for b in bins]


def as_labels(individual, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(individual[0]):
        for i in items:
            out[i] = b
    return out


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[int]] = (), crossovers: int = CROSSOVERS, population: int = POPULATION) -> list[int]:
    """One epoch on one island: the best assignment of items to bins found. `elites` are assignments that live here or came here."""
    rng, bound = random.Random(seed), lower_bound(sizes, capacity)
    if any(s > capacity or s <= 0 for s in sizes):
        raise ValueError("sizes must be from 1 to the capacity")
    scored = [(fitness(x[1], capacity), k, x) for k, x in enumerate(as_individual(e, sizes, capacity) for e in elites)]
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    while len(scored) < population and not (scored and min(scored)[0][0] <= bound):
        noise = 0.0 if not scored else 0.08
        order = down if not noise else sorted(down, key=lambda i: -sizes[i] * (1 + noise * rng.random()))
        bins, room = [], []
        best_fit(order, sizes, capacity, bins, room)
        scored.append((fitness(room, capacity), len(scored), (bins, room)))
    for k in range(crossovers):
        scored.sort(key=lambda x: x[:2])
        if scored[0][0][0] <= bound or len(scored) < 2:
            break
        one, two = rng.sample(scored, 2)
        new = crossover(one[2], two[2], sizes, capacity, rng)
        if k % 3 == 2:
            new = mutated(new, sizes, capacity, rng)
        score = fitness(new[1], capacity)
        if score < scored[-1][0]:
            scored[-1] = (score, population + k, new)
    return as_labels(min(scored, key=lambda x: x[:2])[2], len(sizes))


# --- islands as rows ----------------------------------------------------------------------------------------------------


def _epoch(rows: DataFrame, capacity: int, turn: int) -> DataFrame:
    """rows: block, island, lengths, own (assignment or null), guest (assignment or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                labels = evolve(row["lengths"], capacity, hash((row["block"], row["island"], turn)) & 0xFFFFFFFF, [x for x in (row["own"], row["guest"]) if x])
                row |= {"own": labels, "guest": None, "n_bins": max(labels) + 1}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int64())), ("own", pa.list_(pa.int32())), ("guest", pa.list_(pa.int32())), ("n_bins", pa.int32())]))

    return rows.mapInArrow(run, "block long, island int, lengths array<long>, own array<int>, guest array<int>, n_bins int")


def _packed(items: DataFrame, capacity: int, name: str) -> DataFrame:
    """items (key struct, length) -> key, length, block, bin: every item in a bin of its block."""
    n = max(1, -(-items.count() // BLOCK))
    block = F.pmod(F.xxhash64("key"), F.lit(n)).alias("block")
    blocks = items.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("items"))
    spread = max(1, min(n, 4096))
    blocks = written(blocks, f"{name}-blocks")
    rows = blocks.select("block", F.explode(F.array([F.lit(i) for i in range(ISLANDS)])).alias("island"), F.col("items.length").alias("lengths"))
    rows = rows.repartition(max(spread, 12), "block", "island").withColumns({"own": F.lit(None).cast("array<int>"), "guest": F.lit(None).cast("array<int>")})
    for turn in range(EPOCHS):
        if turn:
            elites = rows.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("own").alias("moved"))
            rows = rows.join(elites, ["block", "island"]).select("block", "island", "lengths", "own", F.col("moved").alias("guest"))
        rows = written(_epoch(rows.select("block", "island", "lengths", "own", "guest"), capacity, turn), f"{name}-epoch{turn}")
    best = rows.groupBy("block").agg(F.min_by("own", F.struct("n_bins", "island")).alias("bins"))
    both = blocks.join(best, "block").select("block", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    return both.select(F.col("x.items.key").alias("key"), F.col("x.items.length").alias("length"), "block", F.col("x.bins").alias("bin"))


def pack(parts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """parts: pieces() or any rows with id, piece and length; adds sequence_id and offset (gapless from 0 in each sequence).

    Rows are numbered once, in a written table; so repeated rows and ids are packed each."""
    parts = written(parts.withColumn("_row", F.monotonically_increasing_id()), "packing-pieces")
    full = parts.filter(F.col("length") >= capacity).select("*", (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = parts.filter(F.col("length") < capacity)
    items = written(loose.select(F.struct(F.col(id_col), "piece", "_row").alias("key"), "length"), "packing-items")
    first = written(_packed(items, capacity, "packing1"), "packing-first")
    fill = first.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    poor = fill.filter(F.col("fill") < POOR * capacity).select("block", "bin")
    again = written(_packed(first.join(poor, ["block", "bin"], "left_semi").select("key", "length"), capacity, "packing2"), "packing-again")
    kept = first.join(poor, ["block", "bin"], "left_anti")
    place = lambda df, level: df.select("key", "length", (F.col("block") * 2 * (1 << 20) + F.col("bin") + level * (1 << 20)).alias("sequence_id"))
    placed = place(kept, 0).unionByName(place(again, 1))
    members = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("key", "length"))).alias("m"))
    start = F.expr("transform(m, (x, i) -> struct(x.key as key, aggregate(slice(m, 1, i), 0L, (a, y) -> a + y.length) as offset))")
    flat = members.select("sequence_id", F.explode(start).alias("x")).select(F.col("x.key._row").alias("_row"), "sequence_id", F.col("x.offset").alias("offset"))
    return full.unionByName(loose.join(flat, "_row")).drop("_row")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(docs, path, capacity, 0, id_col, text_col), capacity, id_col)
