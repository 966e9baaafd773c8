"""Exact Jaccard join of word n-gram sets with a prefix tree, down to connected components.

1. Texts with the same set are one class; one text stands for it.
2. Shingles have one global order: those of the zone (a fixed share of all hashes) by how many classes hold them, rarest first, then the rest
   by hash. Two sets that link must share one of their first `n - ceil(percent * n / 100) + 1` shingles, so only classes that share such a
   shingle, with sizes that fit, can meet. Of the holders of a shingle, those that follow each other by size and fit are one part: a star.
3. Each connected part of these is joined by a trie of its sets, most common shingles first, so that like sets share their beginnings. A probe
   walks the trie once: the overlap up to a node holds for all sets under it, and a subtree is left where even all that remains of
   the probe or of the subtree's sets could not lift the overlap to the threshold, where sizes do not fit, and where all of it is in the
   probe's component already.
4. A part too large for one task is dealt into blocks, and each pair of blocks is a task. One of over DIRECT blocks is dealt twice first, by
   two hashes, and the links found inside blocks give labels. Only shingles whose holders still have different labels count from then on;
   their holders are parted anew before pairs of blocks are compared. So no pair of different texts is left out, copies and groups of near
   copies are not expanded into pairs, and no task holds more than two blocks. DIRECT changes which tasks find a link, never the links.

Sets are told by 128 bits, shingles by 64. Null texts and texts without words have an empty set and link with nothing. Texts are taken whole.
Each row comes back; rows of one id are one document in component_id, rows of a null id come back with the class of their text. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.common import map_batches, written
from tipoff.llm.graph import components
from tipoff.llm.hashing import mixed
from tipoff.llm.near_dedup import _sets_of

#: Share of all hashes that are counted, as a limit on 64 bits; twice what a prefix takes at 85 percent.
ZONE = int(0.3 * 2**64)
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
#: Parts of more blocks get labels before pairs of blocks are compared.
DIRECT = 8


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set of n hold one of any set that links with it."""
    return n - (percent * n + 99) // 100 + 1


class Trie:
    """Sets of numbers as a compressed prefix tree over their sorted order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets  # in lexicographic order, all different
        self.size = np.array([len(s) for s in sets])
        self.start, self.end, self.rep, self.low, self.high, self.term, self.children = [0], [0], [0], [0], [len(sets)], [-1], [[]]
        path = [0]
        for k, s in enumerate(sets):
            shared = self._common(sets[k - 1], s) if k else 0
            while len(path) > 1 and self.start[path[-1]] >= shared:
                self.high[path.pop()] = k
            if self.end[path[-1]] > shared:
                path[-1] = self._split(path[-2], path[-1], shared, k)
            path.append(self._node(shared, len(s), k, k, k))
            self.children[path[-2]].append(path[-1])
        for node in path:
            self.high[node] = len(sets)
        self.least = [int(self.size[a:b].min()) for a, b in zip(self.low, self.high, strict=True)]
        self.most = [int(self.size[a:b].max()) for a, b in zip(self.low, self.high, strict=True)]

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _node(self, start: int, end: int, rep: int, low: int, term: int) -> int:
        for column, value in ((self.start, start), (self.end, end), (self.rep, rep), (self.low, low), (self.high, low + 1), (self.term, term), (self.children, [])):
            column.append(value)
        return len(self.start) - 1

    def _split(self, parent: int, node: int, at: int, k: int) -> int:
        upper = self._node(self.start[node], at, self.rep[node], self.low[node], -1)
        self.start[node], self.high[node] = at, k
        self.children[upper].append(node)
        self.children[parent][-1] = upper
        return upper


def trie_links(sets: list[np.ndarray], labels: list[int], percent: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets of different labels (and of different sides, where given), as many as join all components that such links make."""
    every = np.concatenate(sets)
    values, place, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -count))] = np.arange(len(values))
    ends = np.cumsum([len(s) for s in sets])
    ranked = [np.sort(x) for x in np.split(rank[place], ends[:-1])]
    order = sorted(range(len(sets)), key=lambda k: ranked[k].astype(">u4").tobytes())
    trie = Trie([ranked[k] for k in order])
    label = np.array([labels[k] for k in order])
    side = np.arange(len(order)) if sides is None else np.array([sides[k] for k in order])
    here, out = np.zeros(len(values), np.int64), []
    for s in range(len(order) - 1):
        x = trie.sets[s]
        n = len(x)
        here[x] = 1
        todo = [(c, 0) for c in trie.children[0]]
        while todo:
            node, overlap = todo.pop()
            low, high = trie.low[node], trie.high[node]
            if high <= s + 1 or 100 * trie.most[node] < percent * n or percent * trie.least[node] > 100 * n or ((label[low:high] == label[s]) | (side[low:high] == side[s])).all():
                continue
            depth = trie.end[node]
            run = trie.sets[trie.rep[node]][trie.start[node] : depth]
            overlap += int(here[run].sum())
            left = n - int(np.searchsorted(x, run[-1], "right"))
            best = min(max(depth + left, trie.least[node]), trie.most[node])
            hope = overlap + min(best - depth, left)
            if 100 * hope < percent * (n + best - hope):
                continue
            k = trie.term[node]
            if k > s and label[k] != label[s] and side[k] != side[s] and 100 * overlap >= percent * (n + depth - overlap):
                out.append((order[s], order[k]))
                label[label == label[k]] = label[s]
            todo += [(c, overlap) for c in trie.children[node]]
        here[x] = 0
    return out


def _profile(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, text) -> id, n_shingles, set_a, set_b (a 128-bit name of the set), zone (shingles in the zone), least (those and the prefix)."""

    def make():
        def step(batch):
            texts, parts = batch.column(1).to_pylist(), []
            for at in range(0, len(texts), 512):
                values, first = _sets_of(texts[at : at + 512], width)
                n = np.diff(first)
                full = np.flatnonzero(n)
                names, zone = np.zeros((2, len(n)), np.uint64), np.zeros(len(n), np.int64)
                inside = values < np.uint64(ZONE)
                if len(full):
                    for r, salt in enumerate((1, 0x7FEB352D)):
                        names[r, full] = mixed(np.add.reduceat(mixed(values + np.uint64(salt)), first[:-1][full]) + n[full].astype(np.uint64))
                    zone[full] = np.add.reduceat(inside.astype(np.int64), first[:-1][full])
                # sets are in order of hash, so what is in the zone comes first
                kept = np.where(n > 0, np.maximum(prefix(n, percent), zone), 0)
                place = np.arange(len(values)) - np.repeat(first[:-1], n)
                least = values[place < np.repeat(kept, n)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(least))
                parts.append((n, *names.view(np.int64), zone, lists))
            n, a, b, zone = (np.concatenate([p[k] for p in parts]) for k in range(4))
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(zone, pa.int64()), pa.concat_arrays([p[4] for p in parts])], ["id", "n_shingles", "set_a", "set_b", "zone", "least"])

        return step

    return map_batches(texts, make, "id long, n_shingles long, set_a long, set_b long, zone long, least array<long>")


def _prefixes(reps: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(id, least), (id, n, zone) -> token, id, n: the shingles of each prefix that some other set holds too."""
    rows = reps.select(F.explode("least").alias("token"), "id")
    shared = rows.withColumn("df", F.count("*").over(Window.partitionBy("token"))).filter("df > 1")
    # beyond the zone (or below 0, as hashes are unsigned) the order is that of the hashes, and few are listed: all of them count
    beyond = (F.col("token") < 0) | (F.col("token") >= ZONE)
    own = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(beyond.alias("beyond"), "df", "token"))).alias("shared"), F.count_if(~beyond).cast("int").alias("zoned"))
    both = own.join(sizes, "id")
    # shingles of the zone that no other set holds come first and take their places
    room = F.expr(f"cast(greatest(least(n - (n * {percent} + 99) div 100 + 1 - (zone - zoned), zoned), 0) as int)")
    kept = F.concat(F.slice("shared", F.lit(1), room), F.slice("shared", F.col("zoned") + 1, F.size("shared")))
    return both.select("id", "n", F.explode(kept).alias("x")).select("id", "n", "x.token")


def _met(held: DataFrame, percent: int) -> DataFrame:
    """(token, id, n) -> edges (a, b) from each holder of a shingle to the least of those that it reaches by steps of sizes that fit."""
    by_size = Window.partitionBy("token").orderBy("n", "id")
    apart = F.coalesce(F.lag("n").over(by_size) * 100 < F.col("n") * percent, F.lit(True))
    rows = held.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(by_size))
    least = F.min("id").over(Window.partitionBy("token", "island"))
    return rows.select(F.col("id").alias("a"), least.alias("b")).filter("a <> b")


def _parts(edges: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """(id, part, n, blocks): the connected parts, and the number of blocks each is dealt into."""
    member = components(edges, name).join(sizes, "id").select("id", F.col("component").alias("part"), "n")
    size = member.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    return written(member.join(size, "part").select("id", "part", "n", "blocks"), f"{name}-parts")


def _with_sets(rows: DataFrame, width: int) -> DataFrame:
    """(id, part, blocks, text) -> the text replaced by its set, eight bytes a shingle."""

    def make():
        def step(batch):
            values, first = _sets_of(batch.column(3).to_pylist(), width)
            sets = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sets, pa.binary())], ["id", "part", "blocks", "shingles"])

        return step

    return map_batches(rows, make, "id long, part long, blocks long, shingles binary")


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """(part, i, j, id, side, label, shingles) -> links (a, b) inside each (part, i, j), between its sides if it has several."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("part", "i", "j", "id", "side", "label", "shingles").repartition(n, "part", "i", "j").sortWithinPartitions("part", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, labels, sets = None, [], [], [], []
        done: list[tuple[int, int]] = []

        def solve():
            if len(ids) > 1 and min(labels) < max(labels):
                done.extend((ids[a], ids[b]) for a, b in trie_links([np.frombuffer(s, np.uint64) for s in sets], labels, percent, sides if min(sides) < max(sides) else None))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.int64()), pa.array([b for _, b in done], pa.int64())], ["a", "b"])
            done.clear()
            return out

        for batch in batches:
            for part, i, j, x, side, label, s in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (part, i, j) != key:
                    solve()
                    key, ids, sides, labels, sets = (part, i, j), [], [], [], []
                ids.append(x)
                sides.append(side)
                labels.append(label)
                sets.append(s)
            if done:
                yield flush()
        solve()
        if done:
            yield flush()

    return rows.mapInArrow(run, "a long, b long")


def _pairs(rows: DataFrame) -> DataFrame:
    """Each row once for every block of its part: what a task for a pair of blocks reads."""
    rows = rows.withColumn("side", F.expr("pmod(xxhash64(id, 3), blocks)")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("part", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "id", "side", "label", "shingles")


def links(reps: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between ids of `reps` that join all that are linked."""
    held = written(_prefixes(reps, sizes, percent), "ngram-prefixes")
    sizes = sizes.select("id", "n")
    parts = _parts(_met(held, percent), sizes, "ngram-coarse")
    # a merge join whatever the size: the parts grow with the corpus and must not be broadcast
    sets = written(_with_sets(parts.hint("merge").join(texts, "id").select("id", "part", "blocks", "text"), width).distinct(), "ngram-sets")
    large = F.col("blocks") > DIRECT
    deals = sets.filter(large).withColumn("deal", F.explode(F.array(F.lit(1), F.lit(2)))).select("part", (-F.col("deal")).cast("long").alias("i"), F.expr("pmod(xxhash64(id, deal), blocks)").alias("j"), "id", F.lit(0).cast("long").alias("side"), F.col("id").alias("label"), "shingles")
    found = written(_joined(_pairs(sets.filter(~large).withColumn("label", F.col("id"))).unionByName(deals), percent), "ngram-links")
    many = parts.filter(large).select("id")
    if many.isEmpty():
        return found
    label = many.join(components(found, "ngram-labels"), "id", "left").select("id", F.coalesce("component", "id").alias("label"))
    known = written(held.hint("merge").join(label, "id"), "ngram-known")
    open_tokens = known.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("token")
    rest = written(known.hint("merge").join(open_tokens, "token", "left_semi"), "ngram-open")
    if rest.isEmpty():
        return found
    again = _parts(_met(rest, percent), sizes, "ngram-again")
    labelled = sets.select("id", "shingles").hint("merge").join(again.join(label, "id"), "id")
    return found.unionByName(written(_joined(_pairs(labelled), percent), "ngram-links"))


def ngram_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (the least id reachable by links of at least `percent` similarity)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = written(_profile(texts, width, percent).withColumn("row", F.monotonically_increasing_id()), "ngram-profile")
    full = own.filter("n_shingles > 0")
    # rows of a class have one set; any of them stands for it under the least id
    classes = written(full.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.min("row").alias("row"), F.min("n_shingles").alias("n"), F.min("zone").alias("zone")), "ngram-classes")
    named_classes = classes.filter("rep IS NOT NULL").select(F.col("rep").alias("id"), "row", "n", "zone")
    reps = full.select("row", "least").hint("merge").join(named_classes.select("id", "row"), "row").select("id", "least")
    # an id with several texts is one document: its classes are linked
    named = full.filter("id IS NOT NULL").select("id", "set_a", "set_b").join(classes, ["set_a", "set_b"])
    shared = named.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).filter("b < most").select("id", "b")
    several = named.join(shared, "id").select(F.col("rep").alias("a"), "b").distinct()
    found = links(reps, named_classes.drop("row"), texts, width, percent).unionByName(several)
    final = components(found, "ngram-final").select(F.col("id").alias("rep"), "component")
    label = classes.join(final, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    linked = full.select("id", "n_shingles", "set_a", "set_b").join(label, ["set_a", "set_b"]).select("id", "n_shingles", "component")
    alone = own.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
