"""Query service: one function for each lookup; parameters are literals, so they reach the scan. No match gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tipoff.functions.names import slug

TITLE = "Won NCAA Tournament National Final"


def team_info(teams: DataFrame, seasons: DataFrame, picks: DataFrame) -> DataFrame:
    """Teams with their all-time record, titles and their years, deep runs, appearances, league titles, first-round picks and polled seasons."""
    t = F.col("tourney")
    reached = lambda *texts: F.count_if(F.coalesce(t.rlike("|".join(texts)), F.lit(False)))
    by = seasons.groupBy("team_id").agg(
        F.sum("wins").alias("all_wins"), F.sum("losses").alias("all_losses"), F.sort_array(F.collect_list(F.when(t.contains(TITLE), F.col("end_year")))).alias("title_years"),
        reached("National").alias("final_fours"), reached("National", "Regional Final").alias("elite_eights"), reached("National", "Regional").alias("sweet_sixteens"), F.count("tourney").alias("appearances"),
        F.count_if((F.col("conf_pct") >= 1) & (F.col("conf_wins") > 1)).alias("conf_titles"), F.count("ap_high").alias("polled"),
    )
    firsts = picks.groupBy("team_id").agg(F.count_if(F.col("round") == 1).alias("first_round"))
    out = teams.join(by, "team_id", "left").join(firsts, "team_id", "left")
    counts = ("all_wins", "all_losses", "final_fours", "elite_eights", "sweet_sixteens", "appearances", "conf_titles", "polled", "first_round")
    years = F.coalesce("title_years", F.array().cast("array<long>"))
    return out.select(*teams.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.size(years).alias("titles"), years.alias("title_years"))


def find_team(teams: DataFrame, text: str, aliases: DataFrame | None = None, most: int = 5) -> DataFrame:
    """By a part of the name, the nickname or the slug; only where that finds none, by a part of an alias (alias, team_id)."""
    t = text.lower().strip()
    hit = F.lower("name").contains(t) | F.lower("mascot").contains(t) | slug(F.col("name")).contains(t)
    found = teams.filter(hit).withColumn("way", F.lit(0))
    if aliases is not None:
        by_alias = aliases.filter(F.col("alias").contains(t)).select("team_id").distinct()
        found = found.unionByName(teams.join(by_alias, "team_id", "left_semi").withColumn("way", F.lit(1)))
    # the first `most` by way and id hold all of the first way that count
    first = found.orderBy("way", "team_id").limit(most)
    return first.withColumn("_least", F.min("way").over(Window.partitionBy())).filter(F.col("way") == F.col("_least")).drop("way", "_least")


def team_seasons(seasons: DataFrame, team_id: int, first: int | None = None, last: int | None = None, most: int = 15) -> DataFrame:
    """All seasons in the years asked for, or the latest `most`."""
    rows = seasons.filter(F.col("team_id") == team_id)
    if first is None and last is None:
        return rows.orderBy(F.desc("start_year")).limit(most)
    return rows.filter(F.col("end_year").between(first or 0, last or 9999)).orderBy(F.desc("start_year"))


def head_to_head(games: DataFrame) -> DataFrame:
    """Wins, losses and games of each ordered pair of teams."""
    return games.groupBy("team_id", "opp").agg(F.count_if(F.col("pts") > F.col("opp_pts")).alias("w"), F.count_if(F.col("pts") < F.col("opp_pts")).alias("l"), F.count("*").alias("g"))


def head_to_head_of(h2h: DataFrame, one: int, two: int) -> DataFrame:
    """The pair's row, or the mirrored row of the other direction where only that is stored."""
    direct = h2h.filter((F.col("team_id") == one) & (F.col("opp") == two)).select("w", "l", "g", F.lit(0).alias("o"))
    mirror = h2h.filter((F.col("team_id") == two) & (F.col("opp") == one)).select(F.col("l").alias("w"), F.col("w").alias("l"), "g", F.lit(1).alias("o"))
    return direct.unionByName(mirror).orderBy("o").limit(1).drop("o")


def qualifying(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("wins") + F.col("losses") >= 10)


def rankings(scored: DataFrame, kind: str = "top", most: int = 25, era: str | None = None, team_id: int | None = None, since: int | None = None) -> DataFrame:
    """kind: top (of all), era (of one), team (of one). Seasons of few games are not ranked."""
    rows = qualifying(scored)
    if kind == "era":
        rows = rows.filter(F.col("era") == era)
    elif kind == "team":
        rows = rows.filter(F.col("team_id") == team_id)
    elif kind != "top":
        raise ValueError(f"no ranking of kind {kind}")
    rows = rows if since is None else rows.filter(F.col("end_year") >= since)
    return rows.orderBy(F.desc("score"), "season", "team_id").limit(most)


def era_leaders(scored: DataFrame, most: int = 25) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("era").orderBy(F.desc("score"), "season", "team_id"))
    return qualifying(scored).withColumn("era_rank", place).filter(F.col("era_rank") <= most)


def by_team(ranked: DataFrame) -> DataFrame:
    """Each team's ranked seasons, best first, as one list."""
    return ranked.groupBy("team_id").agg(F.sort_array(F.collect_list(F.struct("rank", "season", "score"))).alias("seasons"))


def coach_info(careers: DataFrame, tenures: DataFrame | None = None, name: str | None = None, team_id: int | None = None, least: int | None = None, greatest: int | None = None, most: int = 20) -> DataFrame:
    """By part of a name (five of those listed), else the coaches of a team (ten, newest first), else by a range of wins (thirty), else the
    first `most`."""
    if name is not None:
        return careers.filter(F.lower("coach").contains(name.lower())).orderBy("rank").limit(5)
    if team_id is not None:
        return tenures.filter(F.col("team_id") == team_id).orderBy(F.desc("last_year"), "coach").limit(10)
    if least or greatest:
        return careers.filter(F.col("wins").between(least or 0, greatest or 99999)).orderBy("rank").limit(30)
    return careers.orderBy("rank").limit(most)


def coach_stops(tenures: DataFrame, teams: DataFrame, name: str, most: int = 10) -> DataFrame:
    """Tenures of coaches whose name holds a text, with the team's name."""
    return tenures.filter(F.lower("coach").contains(name.lower())).join(teams.select("team_id", "name"), "team_id", "left").select("team_id", "coach", "wins", "losses", F.coalesce("name", F.lit("Unknown")).alias("team")).orderBy("team_id", "coach").limit(most)


def efficiency(ratings: DataFrame, team_id: int, season: str | None = None, most: int = 5) -> DataFrame:
    rows = ratings.filter(F.col("team_id") == team_id)
    return rows.filter(F.col("season") == season) if season else rows.orderBy(F.desc("season")).limit(most)


def draft_schools(picks: DataFrame, first: int = 1947, last: int = 2026, most: int = 15) -> DataFrame:
    """Schools by first-round picks, then by all picks, of the years asked for."""
    rows = picks.filter(F.col("year").between(first, last)).groupBy("team_id").agg(F.count("*").alias("picks"), F.count_if(F.col("round") == 1).alias("first_round"))
    return rows.orderBy(F.desc("first_round"), F.desc("picks"), "team_id").limit(most)


def draft_picks(picks: DataFrame, first: int = 1947, last: int = 2026, team_id: int | None = None, most: int = 20) -> DataFrame:
    """The best picks of the years, or of a team."""
    rows = picks.filter(F.col("year").between(first, last))
    return (rows if team_id is None else rows.filter(F.col("team_id") == team_id)).orderBy("pick", "year", "pick_id").limit(most)


def champion(info: DataFrame, year: int) -> DataFrame:
    return info.filter(F.array_contains("title_years", F.lit(year).cast("long")))


def conference(info: DataFrame, name: str) -> DataFrame:
    """Teams whose conference holds the text, by all-time wins."""
    return info.filter(F.lower("conf").contains(name.lower().strip())).orderBy(F.desc("all_wins"), "team_id")


def conferences(teams: DataFrame) -> DataFrame:
    """What there is, for a conference that was not found."""
    return teams.filter(F.col("conf").isNotNull()).select("conf").distinct()


def search_games(games: DataFrame, team_id: int, season: str | None = None, opp: int | None = None, opp_text: str | None = None, teams: DataFrame | None = None, march: bool = False, most: int = 30) -> DataFrame:
    """A team's games from October to the first of June of a season, against an opponent by id or part of its slug, in March and April only;
    the first `most` with how many there are in all."""
    rows = games.filter(F.col("team_id") == team_id)
    if season is not None:
        year = int(season.split("-")[0])
        rows = rows.filter(F.col("game_date").between(f"{year}-10-01", f"{year + 1}-06-01"))
    rows = rows if opp is None else rows.filter(F.col("opp") == opp)
    if opp_text is not None:
        rows = rows.join(teams.filter(F.col("slug").contains(opp_text.lower())).select(F.col("team_id").alias("opp")), "opp", "left_semi")
    rows = rows.filter(F.month("game_date").between(3, 4)) if march else rows
    where = F.when(F.col("loc") == "A", "Away").when(F.col("loc") == "H", "Home").otherwise("Neutral")
    win = F.when(F.col("pts") > F.col("opp_pts"), "W").otherwise("L")
    total = rows.agg(F.count("*").alias("total"))
    first = rows.orderBy("game_date", "order_key", "opp", "pts", "opp_pts").limit(most)
    return first.select("game_date", "opp", where.alias("place"), win.alias("result"), F.concat_ws("-", "pts", "opp_pts").alias("points")).crossJoin(F.broadcast(total))  # one row of totals


def tournament_games(games: DataFrame, seasons: DataFrame) -> DataFrame:
    """Games from 14 March to April of teams in a season (that of the autumn before) in which they have a seed; opp_seed where the opponent has one."""
    seeds = seasons.filter(F.col("seed").isNotNull())
    day = F.col("game_date")
    window = games.filter(((F.month(day) == 3) & (F.dayofmonth(day) >= 14)) | (F.month(day) == 4)).withColumn("start_year", F.year(day) - 1)
    met = window.join(seeds.select("team_id", "start_year", "seed"), ["team_id", "start_year"])
    return met.join(seeds.select(F.col("team_id").alias("opp"), "start_year", F.col("seed").alias("opp_seed")), ["opp", "start_year"], "left")


def seed_record(tournament: DataFrame, opp_seed: int | None = None) -> DataFrame:
    """Wins and other games by own seed and in all (seed 0); against opponents of one seed only, if asked."""
    rows = tournament if opp_seed is None else tournament.filter(F.col("opp_seed") == opp_seed)
    won = F.col("pts") > F.col("opp_pts")
    return rows.rollup("seed").agg(F.count_if(won).alias("w"), F.count_if(~won).alias("l"), F.count("*").alias("games")).select(F.coalesce("seed", F.lit(0)).alias("seed"), "w", "l", "games")


def upsets(tournament: DataFrame) -> DataFrame:
    """Tournament games from the worse seed's side in which the seeds differ, with whether it won."""
    return tournament.filter(F.col("seed") > F.col("opp_seed")).select(F.concat_ws("v", F.col("opp_seed").cast("string"), F.col("seed").cast("string")).alias("seeds"), "game_date", "team_id", "opp", "seed", "opp_seed", "pts", "opp_pts", "order_key", (F.col("pts") > F.col("opp_pts")).alias("upset"))


def upset_summary(upsets: DataFrame) -> DataFrame:
    """Each pairing of seeds: wins of both sides, games and the percentage of upsets."""
    out = upsets.groupBy("seeds").agg(F.count_if(~F.col("upset")).alias("better_wins"), F.count_if("upset").alias("worse_wins"), F.count("*").alias("games"))
    return out.select("*", F.bround(F.col("worse_wins") * 100.0 / F.col("games"), 1).alias("upset_pct"))


def upsets_of(upsets: DataFrame, seeds: str, most: int = 20) -> DataFrame:
    return upsets.filter(F.col("upset") & (F.col("seeds") == seeds)).orderBy("game_date", "team_id", "order_key").limit(most)


def upset_worklist(upsets: DataFrame, done: DataFrame, iconic: DataFrame, first: int = 1985, last: int = 2004) -> DataFrame:
    """Upsets of the years still to do: the iconic ones (year, team_id) first, then by year and by how unlikely the pairing is."""
    year = F.year("game_date")
    rows = upsets.filter(F.col("upset") & year.between(first, last)).withColumn("year", year)
    key = F.format_string("%d/%d-vs-%d", "year", "team_id", "opp")
    order = F.when(F.col("seed") + F.col("opp_seed") == 17, F.col("opp_seed") - 1).otherwise(99)
    rows = rows.withColumn("game_key", key).join(done, "game_key", "left_anti").join(iconic.withColumn("iconic", F.lit(0)), ["year", "team_id"], "left")
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.coalesce("iconic", F.lit(1)), order, "game_key", "order_key"))
    return rows.select("game_key", "year", "seeds", F.coalesce("iconic", F.lit(1)).alias("later"), place.alias("place"))


def team_history(info: DataFrame, seasons: DataFrame, team_id: int) -> DataFrame:
    """One document about a team: its record and its decades."""
    decade = F.floor(F.col("end_year") / 10) * 10
    by = seasons.filter(F.col("team_id") == team_id).groupBy("team_id", decade.alias("decade")).agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))
    lines = by.groupBy("team_id").agg(F.sort_array(F.collect_list(F.struct("decade", "wins", "losses"))).alias("decades"))
    text = F.array_join(F.transform("decades", lambda d: F.format_string("%ds: %d-%d", d["decade"], d["wins"], d["losses"])), "; ")
    return info.filter(F.col("team_id") == team_id).join(lines, "team_id", "left").select("team_id", "name", "all_wins", "all_losses", text.alias("decades"))


def slug_pair(teams: DataFrame, one: str, two: str) -> DataFrame:
    """Two teams by their slugs, side by side; no row unless both are known."""
    pick = lambda s, p: teams.filter(F.col("slug") == s).select(F.col("team_id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"))
    return pick(one, "one").crossJoin(pick(two, "two"))  # one row each
