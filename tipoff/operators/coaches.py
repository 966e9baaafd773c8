"""Coaches: tenures at a team, careers over teams, who coached a season, and the prestige that brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tipoff.functions.names import one_coach
from tipoff.functions.seasons import round_up
from tipoff.operators.score import ranked

#: Wins that list a coach, the ranks of the great, and the parts of prestige.
LISTED_WINS, GREAT = 200, 50
WINS_SCALE, WINS_MOST, WINS_WORTH, PCT_WORTH, GREAT_WORTH = 500, 1.5, 2.0, 1.5, 1.0


def _pct(wins, losses):
    """Percent to one place, half to even."""
    return F.bround(F.try_divide(wins * 100.0, wins + losses), 1)


def tenures(rows: DataFrame) -> DataFrame:
    """rows: team_id, coach, start_year, season, wins, losses. Shared seasons (a comma in the name) do not count. A coach's best season at a
    team is the one of most wins, the latest of equals, as sources list seasons from the newest."""
    named = rows.filter(F.col("coach").isNotNull() & ~F.col("coach").contains(",")).withColumn("coach", one_coach(F.col("coach"), F.col("start_year") + 1))
    best = F.max_by(F.struct("season", F.concat_ws("-", "wins", "losses").alias("record"), "wins"), F.struct("wins", "start_year"))
    out = named.groupBy("team_id", "coach").agg(F.min(F.col("start_year") + 1).alias("first_year"), F.max(F.col("start_year") + 1).alias("last_year"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), best.alias("best"))
    return out.select("team_id", "coach", "first_year", "last_year", "wins", "losses", F.coalesce(_pct(F.col("wins"), F.col("losses")), F.lit(0.0)).alias("pct"), F.col("best.season").alias("best_season"), F.col("best.record").alias("best_record"), F.col("best.wins").alias("best_wins"))


def careers(tenures: DataFrame) -> DataFrame:
    """Totals of a coach with the schools in order of time and the best season; the order by wins is the rank. Coaches without a game are left out."""
    out = tenures.groupBy("coach").agg(
        F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"),
        F.sort_array(F.collect_list(F.struct("first_year", "team_id", "last_year"))).alias("stops"), F.max_by("best_season", F.struct("best_wins", -F.col("team_id"))).alias("best_season"),
    ).filter(F.col("wins") + F.col("losses") > 0)
    schools = F.array_join(F.transform("stops", lambda s: s["team_id"].cast("string")), ",")
    out = out.select("coach", "wins", "losses", _pct(F.col("wins"), F.col("losses")).alias("pct"), "first_year", "last_year", F.size("stops").alias("n_schools"), schools.alias("schools"), F.element_at("stops", -1)["team_id"].alias("last_school"), "best_season")
    return ranked(out, "wins", ("coach",), digits=0)


def leaderboard(careers: DataFrame, least: int = LISTED_WINS) -> DataFrame:
    return careers.filter(F.col("wins") >= least)


def season_coaches(rows: DataFrame, tenures: DataFrame) -> DataFrame:
    """rows with who: the season's coach, else the first stint, newest first, that holds the season with a year to spare on both sides."""
    key = ["team_id", "start_year"]
    stints = tenures.select("team_id", F.col("coach").alias("stint_coach"), "first_year", "last_year")
    open_rows = rows.filter(F.col("coach").isNull()).select(*key)
    inside = (F.col("start_year") >= F.col("first_year") - 1) & (F.col("start_year") + 1 <= F.col("last_year") + 1)
    found = open_rows.join(stints, "team_id").filter(inside).groupBy(*key).agg(F.max_by("stint_coach", F.struct("last_year", "first_year", "stint_coach")).alias("stint_coach"))
    return rows.join(found, key, "left").withColumn("who", F.coalesce("coach", "stint_coach")).drop("stint_coach")


def prestige(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows (who, start_year) with wins_then and prestige: wins of the career so far (in proportion to its years), its share of wins and a place
    among the great; null without a coach, 0 for one who is not listed. Listed coaches are a small table of their own; Spark decides how to
    join it. Names match whatever their case."""
    l = listed.select(F.lower("coach").alias("_who"), F.col("wins").alias("_wins"), F.col("pct").alias("_pct"), F.col("first_year").alias("_first"), F.col("last_year").alias("_last"), F.col("rank").alias("_rank"))
    met = rows.withColumn("_who", F.lower("who")).join(l, "_who", "left")
    span = F.col("_last") - F.col("_first")
    years = F.greatest(F.lit(0), F.least(F.col("start_year") + 1 - F.col("_first"), span))
    then = F.when(span <= 0, F.col("_wins")).otherwise(round_up(F.col("_wins") * (years / span), 0))
    value = F.least(then / WINS_SCALE, F.lit(WINS_MOST)) * WINS_WORTH + F.col("_pct") / 100 * PCT_WORTH + F.when(F.col("_rank") <= GREAT, GREAT_WORTH).otherwise(0.0)
    out = met.withColumn("wins_then", then.cast("long")).withColumn("prestige", F.when(F.col("who").isNotNull(), F.coalesce(value, F.lit(0.0))))
    return out.drop("_who", "_wins", "_pct", "_first", "_last", "_rank")


def with_deltas(listed: DataFrame, deltas: DataFrame, year: int) -> DataFrame:
    """Coaches still active in `year` take the wins and losses gained by their last school; shares and ranks follow."""
    gained = deltas.select(F.col("team_id").alias("last_school"), "dw", "dl")
    active = (F.col("last_year") >= year) & F.col("dw").isNotNull()
    new = lambda c, d: F.when(active, F.col(c) + F.col(d)).otherwise(F.col(c))
    out = listed.join(gained, "last_school", "left").select("coach", new("wins", "dw").alias("wins"), new("losses", "dl").alias("losses"), F.when(active, _pct(F.col("wins") + F.col("dw"), F.col("losses") + F.col("dl"))).otherwise(F.col("pct")).alias("pct"), F.coalesce(active, F.lit(False)).alias("updated"))
    return ranked(out, "wins", ("coach",), digits=0)
