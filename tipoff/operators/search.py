"""Joins by something else than equality, as joins on equal keys: intervals, substrings, and the first candidate that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.sources.staged import staged

BIN = 8


def first_covering(points: DataFrame, spans: DataFrame, key: str, order: tuple[str, ...], value: str) -> DataFrame:
    """points (key, at) -> key, at, value: that of the span (key, low, high) which holds `at` and is the greatest by `order`; points that no
    span holds are left out.

    A span is dealt into bins of BIN: of those it fills only the greatest of each bin matters, and at its two ends it is dealt to single
    places. Both are maxima by key, taken before any join, so no point meets a list of spans: a key with many spans costs their number.
    """
    best = F.struct(*order, value)
    bin_of = lambda c: F.floor(c / BIN)
    known = spans.filter("low <= high").select(key, "low", "high", best.alias("best"))
    first, last = bin_of(F.col("low") + BIN - 1), bin_of(F.col("high") + 1) - 1  # bins filled
    whole = known.filter(first <= last).select(key, F.explode(F.sequence(first, last)).alias("bin"), "best").groupBy(key, "bin").agg(F.max("best").alias("whole"))
    places = F.when(first > last, F.sequence("low", "high")).otherwise(
        F.concat(F.when(F.col("low") < first * BIN, F.sequence(F.col("low"), first * BIN - 1)).otherwise(F.array().cast("array<long>")), F.when((last + 1) * BIN <= F.col("high"), F.sequence((last + 1) * BIN, F.col("high"))).otherwise(F.array().cast("array<long>")))
    )
    single = known.select(key, F.explode(places).alias("at"), "best").groupBy(key, "at").agg(F.max("best").alias("single"))
    met = points.select(key, F.col("at").cast("long").alias("at")).distinct().withColumn("bin", bin_of(F.col("at"))).join(whole, [key, "bin"], "left").join(single, [key, "at"], "left")
    return met.withColumn("best", F.greatest("whole", "single")).filter("best IS NOT NULL").select(key, "at", F.col("best")[value].alias(value))


def _parts(texts: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """texts -> a row for each different part of `column` that is as long as some term of asked (term): its columns and `part`. A text makes at
    most its characters times the different lengths asked for, however many texts share what it holds."""
    lengths = asked.agg(F.array_sort(F.collect_set(F.length("term"))).alias("lengths"))  # one row, no longer than the longest term
    length = F.length(column)
    sized = texts.crossJoin(F.broadcast(lengths)).withColumn("n", F.explode(F.filter("lengths", lambda n: n <= length))).drop("lengths")
    cut = F.transform(F.sequence(F.lit(1), length - F.col("n") + 1), lambda i: F.substring(F.col(column), i, F.col("n")))
    return sized.withColumn("part", F.explode(F.array_distinct(cut))).drop("n")


class GramIndex:
    """Searches in texts (id, text) by runs of characters as long as what is asked for: a join on equal runs, whose rows are its results, so no
    candidates meet that share a run but not the rest. Texts without characters are not indexed, and are asked for by none. The rows of the join
    are kept as `candidates`, to be counted."""

    def __init__(self, texts: DataFrame):
        self.texts = texts.select("id", "text").filter("text <> ''")
        self.candidates: DataFrame | None = None

    def holding(self, asked: DataFrame) -> DataFrame:
        """asked (term) -> term, id of each text that holds it."""
        terms = asked.select("term").filter("term <> ''").distinct()
        return self._met(_parts(self.texts, "text", terms).select("id", F.col("part").alias("term")), terms, "term")

    def held_by(self, asked: DataFrame) -> DataFrame:
        """asked (term) -> term, id of each text that it holds."""
        terms = asked.select("term").filter("term <> ''").distinct()
        return self._met(_parts(terms, "term", self.texts.select(F.col("text").alias("term"))).withColumnRenamed("part", "text"), self.texts, "text")

    def _met(self, one: DataFrame, other: DataFrame, run: str) -> DataFrame:
        self.candidates = one.join(other, run).select("term", "id")
        return self.candidates.distinct()


def first_hits(keys: DataFrame, key: str, candidate: Column, n: Column, pages: DataFrame, holds: Column) -> tuple[DataFrame, int]:
    """keys -> (key, place, url and the columns of `pages` for the first candidate whose page is there and `holds`; how many candidates were
    made). candidate: the url as an expression of the keys' columns and `place` (from 0); n: how many a key has.

    Candidates are made in rounds of one, two, four and so on of each key that is still open, so no key makes over twice what it tries, and
    never the product of its lists."""
    open_keys, found, start, width, made = keys.withColumn("_n", n), None, 0, 1, 0
    while True:
        places = F.sequence(F.lit(start), F.least(F.col("_n") - 1, F.lit(start + width - 1)))
        tried = staged(open_keys.filter(F.col("_n") > start).withColumn("place", F.explode(places)).withColumn("url", candidate), "candidates")
        count = tried.count()
        if not count:
            break
        made += count
        hit = tried.join(pages, "url").filter(holds)
        first = staged(hit.groupBy(key).agg(F.min_by(F.struct("place", "url", *(c for c in pages.columns if c != "url")), "place").alias("hit")).select(key, "hit.*"), "hits")
        found = first if found is None else found.unionByName(first)
        open_keys = open_keys.join(first.select(key), key, "left_anti")
        start, width = start + width, width * 2
    if found is None:
        found = keys.select(key).limit(0).join(pages.limit(0).withColumn("place", F.lit(0)), F.lit(True)).select(key, "place", "url", *(c for c in pages.columns if c != "url"))
    return found, made
