"""Games, seasons, teams, coaches and picks as deterministic views of the driver's tables.

The order lines' years are spread over nine decades, so that every era, field size and pace occurs. Columns that the sources lack before
some year are null there: points per game, SRS, SOS and ratings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tipoff.functions.names import slug
from tipoff.functions.seasons import season_key, start_year

#: Nicknames, dealt to teams in turn.
NICKNAMES = ("Wildcats", "Blue Devils", "Tar Heels", "Bruins", "Owls", "Fighting Irish", "Jayhawks", "Zephyrs", "Orange", "Crimson Tide", "Night Herons")
#: First season whose games are rated, whose points per game, SRS and SOS are known.
FIRST_RATED, FIRST_POINTS, FIRST_SRS, FIRST_SOS = 1956, 1958, 1970, 1962


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, school, mascot, name (both), slug, conf, super."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    mascot = F.element_at(F.array(*map(F.lit, NICKNAMES)), (F.col("s_suppkey") % len(NICKNAMES) + 1).cast("int"))
    named = joined.select(F.col("s_suppkey").cast("long").alias("team_id"), F.replace("s_name", F.lit("#"), F.lit(" ")).alias("school"), mascot.alias("mascot"), F.col("n_name").alias("conf"), F.col("r_name").alias("super"))
    name = F.concat_ws(" ", "school", "mascot")
    return named.select("team_id", "school", "mascot", name.alias("name"), slug(name).alias("slug"), "conf", "super")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each game: team_id, opp, opp_id (null where it cannot be mapped), game_date, season, loc, pts, opp_pts, order_key."""
    n = table(spark, sf_dir, "supplier").count()  # parquet footers only
    l = table(spark, sf_dir, "lineitem").select(*(F.col(f"l_{c}").alias(c) for c in ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "returnflag", "shipdate")))
    void = F.col("orderkey") % 97 == 0
    opp = (F.col("suppkey") + 1 + F.col("partkey") % (n - 1)) % n
    zero = lambda c: F.when(void, 0).otherwise(c).cast("long")
    day = F.add_months(F.col("shipdate").cast("date"), (F.col("orderkey") % 10 * 96 - 480).cast("int"))
    half = l.select(
        F.col("suppkey").cast("long").alias("team_id"), opp.cast("long").alias("opp"), day.alias("game_date"),
        F.when(F.col("returnflag") == "A", "A").when(F.col("returnflag") == "R", "H").otherwise("N").alias("loc"),
        zero(40 + F.floor("quantity") + F.col("suppkey") % 7).alias("pts"), zero(41 + (F.col("partkey") * 7 + F.col("orderkey") * 3 + F.col("linenumber")) % 50 + opp % 7).alias("opp_pts"),
        F.col("orderkey").alias("order_key"),
    )
    there = F.when(F.col("loc") == "A", "H").when(F.col("loc") == "H", "A").otherwise("N")
    other = F.struct(F.col("opp").alias("team_id"), F.col("team_id").alias("opp"), "game_date", there.alias("loc"), F.col("opp_pts").alias("pts"), F.col("pts").alias("opp_pts"), "order_key")
    both = half.select(F.inline(F.array(F.struct("team_id", "opp", "game_date", "loc", "pts", "opp_pts", "order_key"), other)))  # one scan, no union
    year = start_year(F.col("game_date"))
    return both.select("*", F.when(F.col("order_key") % 20 != 0, F.col("opp")).alias("opp_id"), year.alias("start_year"), season_key(year).alias("season"))


def seasons(games: DataFrame, teams: DataFrame) -> DataFrame:
    """A row for each team and season with record, points, close games, polls, seed and tournament result, which follow from the order by
    wins. All counts of games come from one grouping."""
    won, lost, gap = F.col("pts") > F.col("opp_pts"), F.col("pts") < F.col("opp_pts"), F.abs(F.col("pts") - F.col("opp_pts"))
    kinds = {"close": gap <= 5, "clutch": gap <= 3, "overtime": (gap <= 3) & (F.col("pts") + F.col("opp_pts") > 150)}
    league = (F.col("team_id") + F.col("opp")) % 5 == 0  # a view's rule: a fifth of all pairs are league games
    by = games.groupBy("team_id", "season", "start_year").agg(
        F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"), F.avg("pts").alias("ppg"), F.avg("opp_pts").alias("opp_ppg"), F.avg(F.col("pts") - F.col("opp_pts")).alias("srs"),
        F.count_if(won & league).alias("conf_wins"), F.count_if(lost & league).alias("conf_losses"),
        *(F.count_if(test & (won if side == "wins" else ~won)).alias(f"{k}_{side}") for k, test in kinds.items() for side in ("wins", "losses")),
    )
    place = F.row_number().over(Window.partitionBy("season").orderBy(F.desc("wins"), "losses", "team_id"))
    p, year = F.col("place"), F.col("start_year")
    result = F.when(p == 1, "Won NCAA Tournament National Final*").when(p == 2, "Lost NCAA Tournament National Final").when(p <= 4, "Lost NCAA Tournament National Semifinal").when(p <= 8, "Lost NCAA Tournament Regional Final").when(p <= 16, "Lost NCAA Tournament Regional Semifinal").when(p <= 32, "Lost NCAA Tournament Second Round").when(p <= 64, "Lost NCAA Tournament First Round")
    result = F.when((year == 2026) & (p <= 64), "Playing First Round").otherwise(result)
    pct = lambda w, l: F.when(F.col(w) + F.col(l) > 0, F.col(w) / (F.col(w) + F.col(l)))
    since = lambda first, c: F.when(year >= first, c)
    out = by.withColumn("place", place).select(
        *(c for c in by.columns if c not in ("ppg", "opp_ppg", "srs")), "place", *(since(FIRST_POINTS, F.col(c)).alias(c) for c in ("ppg", "opp_ppg")), since(FIRST_SRS, F.col("srs")).alias("srs"),
        since(FIRST_SOS, ((F.col("team_id") * 13 + year * 7) % 41 - 20) / 2).alias("sr_sos"), pct("wins", "losses").alias("win_pct"), pct("conf_wins", "conf_losses").alias("conf_pct"), (year + 1).alias("end_year"),
        F.when(p <= 64, F.floor((p - 1) / 4) + 1).alias("seed"), F.when(p <= 20, (p * 7) % 25 + 1).alias("ap_pre"), F.when(p <= 25, p).alias("ap_high"), F.when(p <= 22, p + 3).alias("ap_final"), result.alias("tourney"),
    )
    return out.join(teams.select("team_id", "name", "conf"), "team_id", "left")


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").count()
    pick = F.col("o_orderkey") % 60 + 1
    day = F.add_months(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 10 * 96 - 480).cast("int"))
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % n).cast("long").alias("team_id"), F.year(day).alias("year"), pick.cast("long").alias("pick"), F.when(pick <= 30, 1).otherwise(2).alias("round"), F.col("o_orderkey").cast("long").alias("pick_id"))


def coach_seasons(spark: SparkSession, sf_dir: str, seasons: DataFrame) -> DataFrame:
    """Seasons with `coach`: null where the source has none, and two names with a comma where two shared the season."""
    c = table(spark, sf_dir, "customer")
    n = max(1, c.count() // 25)
    who: Column = (F.col("team_id") * 31 + F.floor((F.col("start_year") - 1940) / 4)) % n
    name = F.when(F.col("c_custkey") == 1, "John Thompson").otherwise(F.col("c_name"))  # one name stands for two people
    kind = (F.col("team_id") + F.col("start_year")) % 9
    coach = F.when(kind == 0, F.concat(name, F.lit(", Interim"))).when(kind == 4, F.lit(None)).otherwise(name)
    return seasons.withColumn("c_custkey", who).join(c.select("c_custkey", "c_name"), "c_custkey", "left").withColumn("coach", coach).drop("c_custkey", "c_name")
