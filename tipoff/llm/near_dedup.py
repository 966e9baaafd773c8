"""Near-duplicate classes by b-bit MinHash.

1. Each text's set of word shingles gives ROWS * BANDS minima whose bands are hashed; texts with the same set are one class.
2. Classes that share a band are candidates; their groups are the connected components of band sharing.
3. Inside a group, BITS bits of each of HASHES minima are packed in bit planes. A pair's similarity is estimated by counting equal
   bits, corrected for chance collisions; pairs that may reach the threshold are confirmed on their full sets, most similar first,
   and only where they would join two parts. Groups too large for one task are dealt into blocks, and each pair of blocks is a task
   of bounded size, so no pair is left out.
4. The confirmed links' connected components are the classes.

Null texts and texts without words have an empty set and are linked with nothing. Bands find a pair of similarity 0.8 but for
one in 2 * 10^7. Texts are taken whole, whatever their length. Each row of docs comes back with its id; rows of one id count as one document
in component_id, rows of a null id are linked with nothing by name and come back with the class of their text. Ties go to the least id. An
empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import map_batches, written
from tipoff.llm.graph import components
from tipoff.llm.hashing import mixed, shingles, words

BANDS, ROWS = 32, 4
HASHES, BITS = 512, 2
#: Standard deviations of the estimate by which a pair may fall short of the threshold and still be confirmed.
SLACK = 5.5
#: A block of a group holds about so many sets and so many shingles.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000

_SEEDS = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL, _ADD = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32)


def minima(values: np.ndarray, starts: np.ndarray, n_hashes: int) -> np.ndarray:
    """n_hashes minima of each non-empty set; starts are the sets' first positions in values."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), n_hashes), np.uint32)
    for k in range(n_hashes):
        out[:, k] = np.minimum.reduceat(x * _MUL[k] + _ADD[k], starts)
    return out


def band_keys(low: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.zeros((len(low), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for r in range(rows):
        h = mixed(h + low[:, r : bands * rows : rows])
    return h.view(np.int64)


def planes(low: np.ndarray) -> np.ndarray:
    """(sets, BITS, HASHES / 64): bit planes of BITS bits of each minimum, mixed with the number of its hash. The minima's own low bits
    would be equal for two shingles in all hashes alike, as the multipliers are odd; so chance collisions would not average out."""
    low = mixed((np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(32)) | low)
    return np.stack([np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for b in range(BITS)], axis=1)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one set to many: the share of equal b-bit minima, less what chance makes equal."""
    differ = many[:, 0] ^ one[0]
    for b in range(1, BITS):
        differ = differ | (many[:, b] ^ one[b])
    equal = 1 - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def confirmed(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def links(sets: list[np.ndarray], block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links: between the two blocks if there are two, else among all."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    two = block.min() != block.max()
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if m <= 3:
        i, j = np.triu_indices(m, 1)
        pairs.append((i, j, np.ones(len(i), np.float32)))
    else:
        starts = np.concatenate([[0], np.cumsum(size)])[:-1]
        packed = planes(minima(np.concatenate(sets), starts, HASHES))
        t = percent / 100
        equal = t + (1 - t) * 2.0**-BITS
        least = t - SLACK * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - 2.0**-BITS)
        for i in range(m - 1):
            e = estimate(packed[i], packed[i + 1 :])
            j = np.flatnonzero((e >= least) & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :])))
            pairs.append((np.full(len(j), i, np.int32), (j + i + 1).astype(np.int32), e[j].astype(np.float32)))
    i, j, e = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if two:
        cross = block[i] != block[j]
        i, j, e = i[cross], j[cross], e[cross]
    order = np.argsort(-e, kind="stable")
    out = []
    for at in range(0, len(order), 20_000):
        part = order[at : at + 20_000]
        top = np.array([root(x) for x in range(m)]) if at else np.arange(m)
        part = part[top[i[part]] != top[j[part]]]
        for a, b in zip(i[part].tolist(), j[part].tolist(), strict=True):
            if (x := root(a)) != (y := root(b)) and confirmed(sets[a], sets[b], percent):
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def _sets_of(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode().lower() for t in texts]
    values, first, base = [], [0], 0
    k = 0
    while k < len(raw):  # about a megabyte at a time
        n, end = 0, k
        while end < len(raw) and (end == k or n + len(raw[end]) < 1_000_000):
            n += len(raw[end])
            end += 1
        v, at = shingles(*words(raw[k:end]), end - k, width)
        values.append(v)
        first += (at[1:] + base).tolist()
        base += len(v)
        k = end
    return np.concatenate(values) if values else np.empty(0, np.uint64), np.array(first)


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """(id, text) -> id, n_shingles, set_a, set_b (a 128-bit name of the set), bands."""

    def make():
        def step(batch):
            texts, parts = batch.column(1).to_pylist(), []
            for at in range(0, len(texts), 512):
                values, first = _sets_of(texts[at : at + 512], width)
                n = np.diff(first)
                full = np.flatnonzero(n)
                names = np.zeros((2, len(n)), np.uint64)
                bands = np.empty((0, BANDS), np.int64)
                if len(full):
                    for r, salt in enumerate((1, 0x7FEB352D)):
                        names[r, full] = mixed(np.add.reduceat(mixed(values + np.uint64(salt)), first[:-1][full]) + n[full].astype(np.uint64))
                    bands = band_keys(minima(values, first[:-1][full], BANDS * ROWS))
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands.ravel(), pa.int64()))
                parts.append((n, *names.view(np.int64), lists))
            n, a, b = (np.concatenate([p[k] for p in parts]) for k in range(3))
            lists = pa.concat_arrays([p[3] for p in parts])
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b), lists], ["id", "n_shingles", "set_a", "set_b", "bands"])

        return step

    return map_batches(docs, make, "id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _with_sets(rows: DataFrame, width: int) -> DataFrame:
    """(id, coarse, block, blocks, text) -> the text replaced by its sorted set, eight bytes a shingle."""

    def make():
        def step(batch):
            values, first = _sets_of(batch.column(4).to_pylist(), width)
            sets = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(sets, pa.binary())], ["id", "coarse", "block", "blocks", "shingles"])

        return step

    return map_batches(rows, make, "id long, coarse long, block long, blocks long, shingles binary")


def _group_links(rows: DataFrame, percent: int) -> DataFrame:
    """rows (coarse, i, j, id, block, shingles), those of a (coarse, i, j) side by side -> links (a, b)."""

    def solve(ids: list, block: list, sets: list) -> list[tuple[int, int]]:
        found = links([np.frombuffer(s, np.uint64) for s in sets], np.array(block), percent)
        return [(ids[a], ids[b]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, block, sets = None, [], [], []
        done: list[tuple[int, int]] = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.int64()), pa.array([b for _, b in done], pa.int64())], ["a", "b"])
            done.clear()
            return out

        for batch in batches:
            for coarse, i, j, x, b, s in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (coarse, i, j) != key:
                    if len(ids) > 1:
                        done += solve(ids, block, sets)
                    key, ids, block, sets = (coarse, i, j), [], [], []
                ids.append(x)
                block.append(b)
                sets.append(s)
            if done:
                yield flush()
        if len(ids) > 1:
            done += solve(ids, block, sets)
        if done:
            yield flush()

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (the least id reachable by links of at least `percent` similarity), kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = written(_profile(texts, width), "near-profile")
    full = own.filter(F.col("n_shingles") > 0)
    classes = written(full.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n")), "near-classes")
    banded = full.join(classes.select(F.col("rep").alias("id"), "set_a", "set_b"), ["id", "set_a", "set_b"], "left_semi").select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter(F.col("least") < F.col("most"))
    edges = banded.join(shared, "band").filter(F.col("id") != F.col("least")).select(F.col("id").alias("a"), F.col("least").alias("b"))
    coarse = components(edges, "near-coarse").select("id", F.col("component").alias("coarse"))
    member = written(coarse.join(classes.select(F.col("rep").alias("id"), "n"), "id"), "near-members")
    size = member.groupBy("coarse").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    member = member.join(size, "coarse").select("id", "coarse", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "blocks")
    # a merge join whatever the size: the member side grows with the corpus and must not be broadcast
    sets = _with_sets(member.hint("merge").join(texts, "id").select("id", "coarse", "block", "blocks", "text"), width)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = sets.select("*", other).select("coarse", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block", "shingles")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _group_links(dealt.repartition(n, "coarse", "i", "j").sortWithinPartitions("coarse", "i", "j", "id"), percent)
    final = components(found, "near-links").select(F.col("id").alias("rep"), "component")
    label = classes.join(final, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    linked = full.select("id", "n_shingles", "set_a", "set_b").join(label, ["set_a", "set_b"]).select("id", "n_shingles", "component")
    alone = own.filter(F.col("n_shingles") == 0).select("id", "n_shingles", F.col("id").alias("component"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
