"""Merkle manifest of a dataset: a tree of ARITY for each group (source), a tree over the groups' roots, and a proof for each row.

Leaves are sorted by range and numbered inside their group; offsets of partitions come from counts by partition. Each task then takes its
leaves as events: a partial parent gathers its children's digests by place, and once it has as many as its arity it becomes a digest, which is
an event for its own parent. What stays partial at the end of a task, a few nodes of each level at its ends, is the frontier. The
frontier is reshuffled by parent until the arities that follow from the groups' sizes are met; that takes at most as many rounds as there are
levels. Completed parents stay as links to their children; walked back from the root, they give each run of leaves its path.

A parent has at most ARITY children, a task has the frontier of its own leaves (over MOST partial parents it hands on what it has), and
nothing is gathered by group, so a group may hold all rows. Offsets are a row for each partition, and are broadcast.

Cases: nulls in any column have a digest of their own; a null id sorts first and is never tampered with; a null group is a group. Rows of one
id follow by digest; equal rows are leaves side by side, whichever comes first, spread over partitions by row number. Empty and very long
texts are hashed whole in the JVM. An empty table has no leaves and no root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.common import map_batches, written

ARITY = 16
#: Partial parents that a task holds before it hands them on.
MOST = 50_000

_NODE = "group {g}, level int, parent long, children array<struct<place:long,digest:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def _same(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}"))
    return out


def numbered(leaves: DataFrame, name: str) -> DataFrame:
    """(group, key, digest, own) -> group, place (from 0 in order of key, then digest), digest, own."""
    g, n = leaves.schema["group"].dataType.simpleString(), int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in ("group", "key", "digest", "row")]
    # the row number only spreads equal rows over partitions
    dealt = leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("group", "digest", "own")
    own = leaves.schema["own"].dataType.simpleString()

    def make():
        part, at, group, head = TaskContext.get().partitionId(), 0, None, None

        def step(batch):
            nonlocal at, group, head
            places, heads = [], []
            for g in batch.column(0).to_pylist():
                if head is None or g != group:
                    at, group, head = 0, g, head is None
                places.append(at)
                heads.append(head)
                at += 1
            more = [pa.array(places, pa.int64()), pa.array(heads, pa.bool_()), pa.array([part] * len(places), pa.int32())]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], ["group", "digest", "own", "place", "head", "part"])

        return step

    sorted_rows = written(map_batches(dealt, make, f"group {g}, digest string, own {own}, place long, head boolean, part int"), f"{name}-sorted")
    counts = sorted_rows.groupBy("group", "part", "head").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "head", F.coalesce(before, F.lit(0)).alias("offset")).filter("head AND offset > 0").drop("head")
    # a row for each partition at most: the group that a partition begins with
    placed = sorted_rows.join(F.broadcast(offsets), "part", "left")
    return placed.select("group", (F.col("place") + F.when(F.col("head"), F.coalesce("offset", F.lit(0))).otherwise(0)).alias("place"), "digest", "own")


def _events(placed: DataFrame) -> DataFrame:
    """Parents of the leaves of each task, complete and partial, of all levels it reaches."""
    kind = placed.schema["group"].dataType.simpleString()

    def run(batches):
        partial: dict[tuple, dict[int, str]] = {}
        group_type = None

        def rows(nodes):
            children = [[{"place": p, "digest": d} for p, d in sorted(c.items())] for _, c in nodes]
            columns = [pa.array([k[0] for k, _ in nodes], group_type), pa.array([k[1] for k, _ in nodes], pa.int32()), pa.array([k[2] for k, _ in nodes], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(children, pa.list_(pa.struct([("place", pa.int64()), ("digest", pa.string())])))], ["group", "level", "parent", "children"])

        for batch in batches:
            group_type, done = batch.column(0).type, []
            for group, place, d in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                level = 0
                while True:
                    key = (group, level, place // ARITY)
                    children = partial.setdefault(key, {})
                    children[place] = d
                    if len(children) < ARITY:
                        break
                    done.append((key, partial.pop(key)))
                    level, place, d = level + 1, place // ARITY, digest(*(children[p] for p in sorted(children)))
            if len(partial) > MOST:
                done += partial.items()
                partial = {}
            if done:
                yield rows(done)
        if partial:
            yield rows(list(partial.items()))

    return placed.select("group", "place", "digest").mapInArrow(run, _NODE.format(g=kind))


#: Nodes on a level of a group of `size` leaves.
_HERE = "shiftright(size + shiftleft(1L, 4 * level) - 1, 4 * level)"


def forest(placed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(group, place, digest) -> (runs: group, level, parent, digests, top, lone; roots: group, size, root). A run holds the digests of the
    children of `parent` on `level`; the parent of a top run is the root. A group of one leaf has a lone run, whose child is the root."""
    sizes = written(placed.groupBy("group").agg(F.count("*").alias("size")), f"{name}-sizes")
    nodes = written(_events(placed), f"{name}-events")
    # what has ARITY children is complete whatever the group's size; the rest is the frontier
    complete, frontier, roots = [nodes.filter(F.size("children") == ARITY)], nodes.filter(F.size("children") < ARITY), []
    while not frontier.isEmpty():
        met = frontier.groupBy("group", "level", "parent").agg(F.array_sort(F.flatten(F.collect_list("children"))).alias("children"))
        sized = met.alias("x").join(sizes.alias("y"), _same("group")).select("x.*", "y.size").withColumn("here", F.expr(_HERE))
        step = written(sized.withColumn("whole", F.size("children") == F.least(F.lit(ARITY).cast("long"), F.col("here") - ARITY * F.col("parent"))), f"{name}-frontier")
        roots.append(step.filter("here = 1").select("group", "size", F.col("children")[0]["digest"].alias("root")))
        complete.append(step.filter("whole AND (here > 1 OR level = 0)").select("group", "level", "parent", "children"))
        up = F.array(F.struct(F.col("parent").alias("place"), F.sha2(F.array_join("children.digest", ""), 256).alias("digest")))
        above = step.filter("whole AND here > 1").select("group", (F.col("level") + 1).alias("level"), F.shiftright("parent", 4).alias("parent"), up.alias("children"))
        frontier = step.filter("NOT whole").select("group", "level", "parent", "children").unionByName(above)
    runs = complete[0]
    for more in complete[1:]:
        runs = runs.unionByName(more)
    out = sizes.select("group", "size", F.lit("").alias("root")).limit(0)
    for more in roots:
        out = out.unionByName(more)
    sized = runs.alias("x").join(sizes.alias("y"), _same("group")).select("x.*", "y.size")
    runs = sized.select("group", "level", "parent", F.col("children.digest").alias("digests"), (F.expr(_HERE) <= ARITY).alias("top"), (F.col("size") == 1).alias("lone"))
    return written(runs, f"{name}-runs"), written(out, f"{name}-roots")


def paths(runs: DataFrame, tops: DataFrame) -> DataFrame:
    """Runs of leaves with what is above them: group, parent, digests, lone, above (place, digests of its run) up to the root, and further
    columns of `tops`. tops: a row for each top run with its group, above and further columns."""
    more = [c for c in tops.columns if c not in ("group", "above")]
    highest = runs.agg(F.max("level")).first()[0]
    found = None
    for level in range(highest or 0, -1, -1):
        here = runs.filter(F.col("level") == level)
        now = here.filter("top").alias("x").join(tops.alias("y"), _same("group")).select("x.group", "x.parent", "x.digests", "x.lone", "y.above", *(f"y.{c}" for c in more))
        if found is not None:
            below = here.filter("NOT top").withColumn("over", F.shiftright("parent", 4))
            own = F.concat(F.array(F.struct((F.col("x.parent") % ARITY).cast("int").alias("place"), F.col("y.digests").alias("digests"))), F.col("y.above"))
            linked = below.alias("x").hint("merge").join(found.alias("y"), F.col("x.group").eqNullSafe(F.col("y.group")) & (F.col("x.over") == F.col("y.parent")))
            now = now.unionByName(linked.select("x.group", "x.parent", "x.digests", "x.lone", own.alias("above"), *(f"y.{c}" for c in more)))
        found = now
    return found


_ABOVE = "array<struct<place:int,digests:array<string>>>"


def manifest(leaves: DataFrame) -> DataFrame:
    """(group, key, digest, own) -> runs of leaves: group, parent, digests, lone, above, subroot, root, leaves (place, own) of each."""
    placed = numbered(leaves, "manifest")
    runs, roots = forest(placed, "manifest")
    upper = numbered(roots.select(F.lit(0).alias("group"), F.col("group").alias("key"), F.col("root").alias("digest"), F.struct(F.col("group").alias("of"), F.col("root").alias("subroot")).alias("own")), "manifest-roots")
    upper = written(upper, "manifest-upper")
    upper_runs, upper_roots = forest(upper, "manifest-upper")
    root = upper_roots.select("root")
    tops = root.select(F.lit(0).alias("group"), F.array().cast(_ABOVE).alias("above"), "root")
    of = upper.withColumn("parent", F.shiftright("place", 4)).alias("x").join(paths(upper_runs, tops).alias("y"), _same("parent"))
    step = F.array(F.struct((F.col("x.place") % ARITY).cast("int").alias("place"), F.col("y.digests").alias("digests")))
    tops = of.select(F.col("x.own.of").alias("group"), F.when(F.col("y.lone"), F.col("y.above")).otherwise(F.concat(step, "y.above")).alias("above"), F.col("x.own.subroot").alias("subroot"), "y.root")
    each = placed.groupBy("group", F.shiftright("place", 4).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("place", "own"))).alias("leaves"))
    return each.alias("x").hint("merge").join(paths(runs, written(tops, "manifest-tops")).alias("y"), _same("group", "parent")).select("y.*", "x.leaves")


def siblings(run: list[str], place: int) -> list[str]:
    return run[:place] + run[place + 1 :]


def folded(found: str, run: list[str], place: int, lone: bool, above: list[dict]) -> str:
    """The root that follows from a leaf's digest and its siblings."""
    if not lone:
        found = digest(*run[:place], found, *run[place + 1 :])
    for a in above:
        found = digest(*a["digests"][: a["place"]], found, *a["digests"][a["place"] + 1 :])
    return found


def verified(rows: DataFrame, group: str, key: str, columns: list[str], tampered: dict[str, Column], where: Column, proofs: bool = False) -> DataFrame:
    """Each row's key, leaf, subroot, root, hash of its proof, and what folding its proof over the row as `tampered` (columns replaced where
    `where` holds) gives: folded_root, verified. proofs adds the siblings themselves, level by level."""
    own = leaf(*(F.col(c) for c in columns))
    other = F.when(F.coalesce(where, F.lit(False)), leaf(*(tampered.get(c, F.col(c)) for c in columns)))
    leaves = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), own.alias("digest"), F.struct(F.col(key).alias("key"), own.alias("leaf"), other.alias("other")).alias("own"))
    kind = rows.schema[key].dataType.simpleString()
    joined = manifest(leaves)

    def make():
        names = ["digests", "lone", "above", "subroot", "root", "leaves"]
        known = {c: k for k, c in enumerate(joined_columns)}

        def step(batch):
            out = []
            for run, lone, above, subroot, root, found in zip(*(batch.column(known[c]).to_pylist() for c in names), strict=True):
                upper = "".join(d for a in above for d in siblings(a["digests"], a["place"]))
                roots: dict[str, str] = {}
                for x in found:
                    place, own = x["place"] % ARITY, x["own"]
                    shown = own["other"] or own["leaf"]
                    end = roots.get(shown) if shown == run[place] else None
                    if end is None:
                        end = folded(shown, run, place, lone, above)
                        if shown == run[place]:
                            roots[shown] = end
                    row = (own["key"], own["leaf"], subroot, root, digest(*siblings(run, place), upper), end, end == root)
                    out.append((*row, [siblings(run, place), *(siblings(a["digests"], a["place"]) for a in above)]) if proofs else row)
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, fields)

        return step

    joined_columns = joined.columns
    fields = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if proofs else [])]
    types = [None, *[pa.string()] * 5, pa.bool_(), *([pa.list_(pa.list_(pa.string()))] if proofs else [])]
    if kind == "bigint":
        types[0] = pa.int64()
    return map_batches(joined, make, f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<array<string>>" * proofs)


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents; where 5 divides the CRC of the id, a text in lower case (A-Z) is held against it."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return verified(docs, "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": lower}, where)
