"""Interval, substring and first-candidate joins against plain loops; work stays in bounds."""

import random

import pytest
from pyspark.sql import functions as F

from tipoff.operators import search


def test_first_covering(spark):
    rng = random.Random(1)
    spans = [(rng.randrange(4), a := rng.randint(-30, 60), a + rng.randint(-1, 40), rng.randint(0, 5), f"v{k}") for k in range(300)]
    points = [(rng.randrange(5), rng.randint(-40, 110)) for _ in range(400)]
    got = search.first_covering(spark.createDataFrame(points, "key int, at long"), spark.createDataFrame(spans, "key int, low long, high long, o int, value string"), "key", ("o",), "value")
    want = {}
    for k, at in set(points):
        if held := [(o, v) for key, low, high, o, v in spans if key == k and low <= at <= high]:
            want[k, at] = max(held)[1]
    assert {(r.key, r.at): r.value for r in got.collect()} == want


def test_a_key_with_many_spans(spark):
    """10^5 spans that all hold a point make as many rows as there are spans and ends, not one for each pair."""
    spans = spark.range(100_000).select(F.lit(1).alias("key"), (F.col("id") % 50).alias("low"), (F.col("id") % 50 + 900).alias("high"), "id", F.col("id").cast("string").alias("value"))
    points = spark.range(1000).select(F.lit(1).alias("key"), F.col("id").alias("at"))
    got = search.first_covering(points, spans, "key", ("id",), "value").collect()
    assert len(got) == 950 and {r.value for r in got if 60 <= r.at <= 890} == {"99999"}


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    texts = [(k, word(rng.randint(0, 12))) for k in range(150)]
    terms = [word(rng.randint(0, 6)) for _ in range(60)] + [t for _, t in texts[:20]] + [word(30) for _ in range(10)]
    index = search.GramIndex(spark.createDataFrame(texts, "id int, text string"))
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    holding = {(r.term, r.id) for r in index.holding(asked).collect()}
    assert holding == {(t, k) for t in terms for k, x in texts if t and x and t in x}
    held = {(r.term, r.id) for r in index.held_by(asked).collect()}
    assert held == {(t, k) for t in terms for k, x in texts if t and x and x in t}


def test_the_rarest_run_is_looked_up(spark):
    texts = [(k, f"common words {k:04d}") for k in range(2000)]
    index = search.GramIndex(spark.createDataFrame(texts, "id int, text string"))
    got = index.holding(spark.createDataFrame([("common words 0137",), ("zzz common",)], "term string")).collect()
    assert [r.id for r in got] == [137] and index.candidates.count() <= 20


def test_only_results_meet_in_texts(spark):
    """Schools that share every run of three characters with hundreds of others: texts about them meet the schools that they hold."""
    schools = [(k, f"school {k:06d}") for k in range(3000)]
    terms = [(f"the {a} met the {b}.",) for (_, a), (_, b) in zip(schools, schools[7:], strict=False)]
    index = search.GramIndex(spark.createDataFrame(schools, "id int, text string"))
    got = index.held_by(spark.createDataFrame(terms, "term string")).count()
    assert got == 2 * len(terms) == index.candidates.count()


def test_only_results_meet_in_lookups(spark):
    """Terms whose runs of three characters are all common, while the whole term stands in one text."""
    texts = [(k, f"school {k:06d} owls") for k in range(3000)]
    index = search.GramIndex(spark.createDataFrame(texts, "id int, text string"))
    got = index.holding(spark.createDataFrame([(f"{k:06d} owl",) for k in range(3000)], "term string")).count()
    assert got == 3000 == index.candidates.count()


def test_first_hits(spark):
    rng = random.Random(3)
    keys = [(k, [f"d{j}" for j in range(rng.randint(0, 9))], [f"s{k}", f"t{k}"]) for k in range(40)]
    pages = {f"{d}-{s}": rng.random() < 0.5 for k, ds, ss in keys for d in ds for s in ss if rng.random() < 0.3}
    df = spark.createDataFrame(keys, "game int, dates array<string>, slugs array<string>")
    slugs = F.size("slugs")
    url = F.concat(F.get("dates", F.floor(F.col("place") / slugs).cast("int")), F.lit("-"), F.get("slugs", F.col("place") % slugs))
    got, made = search.first_hits(df, "game", url, F.size("dates") * slugs, spark.createDataFrame(list(pages.items()), "url string, good boolean"), F.col("good"))
    want, tried = {}, 0
    for k, ds, ss in keys:
        for n, u in enumerate(f"{d}-{s}" for d in ds for s in ss):
            tried += 1
            if pages.get(u):
                want[k] = (n, u)
                break
    assert {r.game: (r.place, r.url) for r in got.collect()} == want and made <= 2 * tried
