"""Column functions of seasons, eras, tournaments and games. All are built-in expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points per possession-unit by first season year (exclusive upper bound), then the rest.
POSSESSION_DIVISORS = ((1960, 2.30), (1972, 2.25), (1986, 2.20), (1994, 2.15), (2008, 2.10), (2016, 2.08))
POSSESSION_REST = 2.12
#: Last end year and name of each era.
ERAS = ((1964, "Pre-Modern"), (1985, "Integration Era"), (1993, "Early Modern"), (2007, "Mid Modern"), (2015, "Late Modern"))
ERA_REST = "Current"
#: The same for the earlier score.
EARLIER_ERAS = ((1985, "Pre-Shot Clock"), (1993, "Early Modern"), (2007, "Mid Modern"), (2015, "Late Modern"))
#: Pace of each era's games, in the order of ERAS, then the rest.
PACES = (78, 73, 70, 67, 65)
PACE_REST = 67
#: Last end year and size of the tournament field.
FIELDS = ((1950, 8), (1952, 16), (1974, 25), (1978, 32), (1984, 48), (2000, 64), (2010, 65))
FIELD_REST = 68
#: Text in a tournament result (the first found counts), round, points.
RESULTS = (
    ("Won NCAA Tournament National Final", "champion", 15.0),
    ("Lost NCAA Tournament National Final", "runner_up", 8.0),
    ("National Semifinal|Regional Final \\(Final Four\\)", "final_four", 5.0),
    ("Regional Final", "elite_eight", 3.0),
    ("Regional Semifinal|Third Round", "sweet_sixteen", 1.5),
    ("Second Round", "round_of_32", 0.5),
    ("First Round|First Four|Opening Round", "first_round", -0.5),
    ("Playing", "in_progress", 0.0),
    ("Regional Third Place", "final_four", 5.0),
)
HOME_EDGE = 3.5


def ladder(value: Column, steps, rest, below: bool = False) -> Column:
    """The second of the first step whose bound is not under `value` (below: is over it)."""
    out = None
    for bound, result in steps:
        test = value < bound if below else value <= bound
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.when(value.isNotNull(), rest)


def start_year(date: Column, first_month: int = 6) -> Column:
    """Year in which the season of a date begins; the season turns in `first_month` (6 for batches, 10 for lookups)."""
    return F.year(date) - F.when(F.month(date) < first_month, 1).otherwise(0)


def season_key(year: Column) -> Column:
    """1999 -> '1999-00'."""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def key_start_year(key: Column) -> Column:
    return F.substring_index(key, "-", 1).try_cast("int")


def possession_divisor(year: Column) -> Column:
    return ladder(year, POSSESSION_DIVISORS, POSSESSION_REST, below=True)


def era(end_year: Column) -> Column:
    return ladder(end_year, ERAS, ERA_REST)


def earlier_era(end_year: Column) -> Column:
    return ladder(end_year, EARLIER_ERAS, ERA_REST)


def pace(end_year: Column) -> Column:
    return ladder(end_year, tuple((e[0], p) for e, p in zip(ERAS, PACES, strict=True)), PACE_REST)


def field_size(end_year: Column) -> Column:
    return ladder(end_year, FIELDS, FIELD_REST)


def tournament_result(text: Column, first_round: float | None = None) -> Column:
    """struct(round, points) of a season's result text; null or empty means the team was not in it. `first_round`: its points, if others."""
    clean = F.replace(text, F.lit("*"), F.lit(""))
    result = lambda r, p: F.struct(F.lit(r).alias("round"), F.lit(p).alias("points"))
    out = F.when(F.coalesce(text, F.lit("")) == "", result("none", -2.0))
    for pattern, name, points in RESULTS:
        out = out.when(clean.rlike(pattern), result(name, first_round if first_round is not None and name == "first_round" else points))
    return out.otherwise(result("unknown_tourney", 0.0))


def round_up(value: Column, digits: int) -> Column:
    """Half goes up, also below zero."""
    k = float(10**digits)
    return F.floor(value * k + 0.5) / k


def safe_z(value: Column, mean: Column, deviation: Column, cap: float | None = None) -> Column:
    """(value - mean) / deviation with 1 for a deviation of 0 or null; capped if asked; null for null or NaN."""
    z = F.when(value.isNotNull() & ~F.isnan(value), (value - F.coalesce(mean, F.lit(0.0))) / F.when(deviation > 0, deviation).otherwise(1.0))
    return z if cap is None else F.when(z.isNotNull(), F.greatest(F.lit(-cap), F.least(F.lit(cap), z)))


def win_probability(oe_a: Column, de_a: Column, oe_b: Column, de_b: Column, pace_a: Column, pace_b: Column) -> Column:
    """Of the first team: possessions are the mean pace, points are offence plus the other's defence less 100."""
    points = ((oe_a + de_b - 100) - (oe_b + de_a - 100)) * ((pace_a + pace_b) / 2 / 100)
    return 1 / (1 + F.exp(-points / 4.5))
