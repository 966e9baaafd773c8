"""Trajectories with gaps, the model against plain Newton steps, sensitivity against plain pairs, and the small operators of ingestion."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tipoff.operators import sync, trends
from tipoff.operators.score import WEIGHTS
from tipoff.sources import files


def slope(points):
    n, mx = len(points), sum(x for x, _ in points) / len(points)
    my = sum(y for _, y in points) / n
    return sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)


def test_trajectories_look_back_by_years(spark):
    rng = random.Random(1)
    rows = [(team, y, round(rng.uniform(0, 100), 2), 20 if rng.random() < 0.9 else 3, 5) for team in range(25) for y in sorted(rng.sample(range(1950, 2020), rng.randint(1, 40)))]
    got = trends.trajectories(spark.createDataFrame(rows, "team_id long, end_year long, score double, wins int, losses int")).collect()
    for s in trends.SPANS:
        found = {}
        for team in range(25):
            good = [(y, v) for t, y, v, w, l in rows if t == team and w + l >= 10]
            last = max((y for y, _ in good), default=0)
            seen = [(y, v) for y, v in good if y > last - s]
            if len(seen) >= trends.LEAST_SEASONS:
                found[team] = (round(slope(seen), 6), len(seen))
        for direction, sign in (("riser", -1), ("faller", 1)):
            want = sorted(found, key=lambda t: (sign * found[t][0], t))[: trends.LISTED]
            mine = sorted((r.place, r.team_id) for r in got if (r.span, r.direction) == (s, direction))
            assert [t for _, t in mine] == want and [p for p, _ in mine] == list(range(1, len(want) + 1))
            assert all(found[r.team_id] == (pytest.approx(r.slope, abs=2e-6), r.seasons) for r in got if r.span == s)


def test_round_model_is_newtons(spark):
    rng = random.Random(2)
    rows = [(1990, s := round(rng.gauss(50, 15), 2), 20, 5, "Lost NCAA Tournament Regional Semifinal" if rng.random() < 1 / (1 + math.exp(-(s - 60) / 8)) else None) for _ in range(300)]
    r = trends.round_model(spark.createDataFrame(rows, "end_year int, score double, wins int, losses int, tourney string")).first()
    data = [((s - 50) / 15, float(t is not None), s) for _, s, _, _, t in rows]
    # at the optimum of the penalised likelihood the gradient vanishes
    p = [1 / (1 + math.exp(-(r.b0 + r.b1 * x))) for x, _, _ in data]
    assert abs(sum(y - q for (_, y, _), q in zip(data, p, strict=True)) - trends.RIDGE * r.b0) < 1e-6
    assert abs(sum((y - q) * x for (x, y, _), q in zip(data, p, strict=True)) - trends.RIDGE * r.b1) < 1e-6
    assert r.n == 300 and r.base == pytest.approx(sum(y for _, y, _ in data) / 300) and r.top > 2 * r.base


def test_no_seasons_to_model(spark):
    r = trends.round_model(spark.createDataFrame([], "end_year int, score double, wins int, losses int, tourney string")).first()
    assert (r.b0, r.b1, r.n, r.base) == (0.0, 0.0, 0, None)


def test_sensitivity_counts_turned_pairs(spark):
    rng = random.Random(3)
    rows = [(k, f"{k}", 20, 5, *(None if c == "perception" and k % 3 else rng.gauss(0, 1) for c in WEIGHTS)) for k in range(130)]
    got = trends.sensitivity(spark.createDataFrame(rows, "team_id long, season string, wins int, losses int, " + ", ".join(f"{c} double" for c in WEIGHTS))).collect()

    def raw(r, weights):
        parts = dict(zip(WEIGHTS, r[4:], strict=True))
        return round(sum((parts[c] or 0) * w for c, w in weights.items()) / sum(w for c, w in weights.items() if parts[c] is not None), 9)

    first = sorted(rows, key=lambda r: -raw(r, WEIGHTS))[: trends.COMPARED]
    assert len(got) == 2 * len(WEIGHTS)
    for g in got:
        new = [raw(r, WEIGHTS | {g.component: WEIGHTS[g.component] * (1 + g.change)}) for r in first]
        assert g.moved == sum(new[a] < new[b] for b in range(len(first)) for a in range(b)) and g.pairs == 4950


def test_small_operators(spark):
    rows = spark.createDataFrame([(1, "b", 5), (1, "a", 7), (1, "b", 9), (1, None, 9), (2, "c", 1)], "team int, coach string, year int")
    assert sorted(map(tuple, sync.first_seen(rows, "team", "coach", (-F.col("year"),)).collect())) == [(1, 1, "b"), (1, 2, "a"), (2, 1, "c")]
    ids = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "team_id int, source_slug string")
    wanted = spark.createDataFrame([("x",), ("y",), ("z",), ("x",)], "slug string")
    assert sorted(map(tuple, sync.ids_of_slugs(wanted, ids).collect())) == [("x", 1), ("y", 3)]
    games = spark.createDataFrame([("g", "2026/a-b-vs-c", None, "C Name"), ("h", "2026-a-vs-b", None, None), ("i", "2026/a", None, None)], "key string, path string, winner string, loser string")
    assert [r.title for r in files.game_tags(games, "S").collect()] == ["A B Upsets C Name — 2026 NCAA Tournament | S"]
    pairs = spark.createDataFrame([("k", "A", "B"), ("l", "A", None)], "key string, name_a string, name_b string")
    assert [r.title for r in files.comparison_tags(pairs, "S").collect()] == ["A vs B — S"]
