"""Connected components of an edge table by alternating stars; labels and links stay distributed.

Repeated edges and loops count once or not at all; edges with a null end are left out; an empty table has no components. Each step is a
written table, and the one before it is removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.common import removed, written_at


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v), u > v: each node hands its neighbours (large: those above it; small: those below and itself) to the least
    of them, which is the first of its rows in order: one exchange a step, and no node's rows are gathered."""
    least = F.first("v").over(Window.partitionBy("u").orderBy("v"))
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return both.withColumn("m", F.least("u", least)).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = edges.withColumn("m", least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) of integer ids -> (id, component): the least id reachable, for every id that has an edge to another."""
    now = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = written_at(now, f"{name}-edges")
    mark = None
    while True:
        (now, path), old = written_at(_star(_star(now, True), False), f"{name}-step"), path
        removed(edges.sparkSession, old)
        new = tuple(now.agg(F.count("*"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
