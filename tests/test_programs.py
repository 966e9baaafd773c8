import math
import operator
from functools import reduce

import pytest

from tipoff.operators import score

#: Ten scores whose mean ends in half a cent, so that the order in which they are added decides the last place.
TEN = [64.21, 62.82, 60.35, 59.53, 59.29, 57.47, 57.4, 57.19, 54.36, 54.23]
SCHEMA = "team_id long, season string, score double, wins long, losses long, coach string"


def rows(team, scores, wins=20):
    return [(team, f"{1950 + k}-{(51 + k) % 100:02d}", s, wins, 5, None) for k, s in enumerate(scores)]


def test_scores_are_added_from_the_best_in_every_team(spark):
    """Equal teams have equal sums, however many of them a task holds: one that collects lists goes over to sorting at 128 teams, and would
    add the rows of the last one in another order. A team whose mean is another when ranks are counted gets a wrong rank or is lost."""
    up = lambda scores: math.floor(reduce(operator.add, scores) / 10 * 100 + 0.5) / 100
    assert (up(TEN), up(TEN[1:] + TEN[:1])) == (58.68, 58.69)
    scored = spark.createDataFrame([r for team in range(1000) for r in rows(team, TEN)], SCHEMA)
    out = score.programs(scored).collect()
    assert len(out) == 1000 and {r.top10 for r in out} == {58.68} and len({r.decayed for r in out}) == 1
    assert all(r["rank"] == r.team_id + 1 for r in out)


def test_programs_equal_their_sql(spark):
    """Teams of no, few and many seasons of enough games."""
    duckdb = pytest.importorskip("duckdb")
    from tipoff.plans.sql import CTES

    data = [r for team in range(300) for r in rows(team, [round((team * 37 + k * 53) % 97 + k / 7, 2) for k in range(team % 45 + 1)])] + rows(900, [50.0, 40.5], wins=3) + rows(901, [40.25], wins=3) + rows(901, [30.75] * 3)[1:]
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE TABLE scored ({SCHEMA})")
    con.executemany("INSERT INTO scored VALUES (?, ?, ?, ?, ?, ?)", data)
    columns = ["team_id", "top10", "seasons", "qualifying", "best_season", "best_score", "rank"]
    want = con.execute(f"WITH placed AS ({CTES['placed']}), programs AS ({CTES['programs']}) SELECT {', '.join(columns)}, decayed, best_five FROM programs ORDER BY team_id").fetchall()
    out = sorted(score.programs(spark.createDataFrame(data, SCHEMA)).collect(), key=lambda r: r.team_id)
    assert [tuple(r[c] for c in columns) for r in out] == [w[:-2] for w in want]
    assert all(abs(r.decayed - w[-2]) < 1e-9 for r, w in zip(out, want, strict=True))
    assert ["; ".join(f"{b.season} {b.record} {b.coach or '?'}" for b in r.best_five) for r in out] == [w[-1] for w in want]
