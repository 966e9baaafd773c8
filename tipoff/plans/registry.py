"""The reference's operators as queries over the driver's tables, each beside the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.functions import names
from tipoff.functions import seasons as S
from tipoff.operators import coaches, ingest, lookups, matchup, ratings, score, score_earlier, sync
from tipoff.plans import analyses, stores
from tipoff.plans.sql import _up, oracle
from tipoff.sources import domain, files, render
from tipoff.sources.staged import staged
from tipoff.streaming.limiter import limited

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Views of one query, each planned once. Tables with a row for each team and season that several branches of a score read are written to the
    shared folder: seasons and ratings come from one scan of the games each, and era statistics, ranks and profiles read rows, not their plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return domain.table(self.spark, self.dir, name)

    @cached_property
    def teams(self) -> DataFrame:
        return domain.teams(self.spark, self.dir)

    @cached_property
    def games(self) -> DataFrame:
        return domain.games(self.spark, self.dir)

    @cached_property
    def seasons(self) -> DataFrame:
        return domain.seasons(self.games, self.teams)

    @cached_property
    def coached(self) -> DataFrame:
        return domain.coach_seasons(self.spark, self.dir, self.seasons)

    @cached_property
    def picks(self) -> DataFrame:
        return domain.picks(self.spark, self.dir)

    @cached_property
    def rated(self) -> DataFrame:
        return ratings.per_100(self.games, domain.FIRST_RATED)

    @cached_property
    def ratings(self) -> DataFrame:
        return ratings.season_ratings(self.rated)

    @cached_property
    def kept_seasons(self) -> DataFrame:
        return staged(self.coached, "seasons")

    @cached_property
    def kept_ratings(self) -> DataFrame:
        return staged(self.ratings, "ratings")

    @cached_property
    def tenures(self) -> DataFrame:
        return coaches.tenures(self.coached)

    @cached_property
    def careers(self) -> DataFrame:
        return coaches.careers(self.tenures)

    @cached_property
    def led(self) -> DataFrame:
        """Seasons with who coached and the prestige that brought."""
        seasons = self.kept_seasons
        tenures = coaches.tenures(seasons)
        return coaches.prestige(coaches.season_coaches(seasons, tenures), coaches.leaderboard(coaches.careers(tenures)))

    @cached_property
    def score_rows(self) -> DataFrame:
        key = ["team_id", "season"]
        rated = self.kept_ratings.select(*key, "em", "sos", score.quality_record().alias("quality_record"))
        rows = self.led.join(rated, key, "left").join(score.draft_production(self.picks).select("team_id", "start_year", "draft_score"), ["team_id", "start_year"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        rows = rows.withColumns({"win_pct": zero("win_pct"), "draft_score": zero("draft_score"), "close_score": score.close_score(), "era": S.era(F.col("end_year"))})
        return staged(rows, "score-rows")

    @cached_property
    def scored(self) -> DataFrame:
        return score.season_scores(self.score_rows)

    @cached_property
    def earlier(self) -> DataFrame:
        return score_earlier.season_scores(self.seasons)

    @cached_property
    def ranked(self) -> DataFrame:
        """Scored seasons of enough games with their rank of all."""
        return staged(score.ranked(lookups.qualifying(self.scored), "score", ("season", "team_id")), "ranked")

    @cached_property
    def info(self) -> DataFrame:
        return lookups.team_info(self.teams, self.seasons, self.picks)

    @cached_property
    def late(self) -> DataFrame:
        return lookups.tournament_games(self.games, self.seasons)

    @cached_property
    def upsets(self) -> DataFrame:
        return lookups.upsets(self.late)

    @cached_property
    def h2h(self) -> DataFrame:
        return lookups.head_to_head(self.games)

    @cached_property
    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        """Records before and after a day; a part of the teams lost wins between, as a correction does."""
        pts, opp = F.col("pts"), F.col("opp_pts")
        old = self.games.filter(F.col("game_date") < "2001-06-01").groupBy("team_id").agg(F.count_if(pts > opp).alias("w"), F.count_if(pts < opp).alias("l"))
        new = self.games.groupBy("team_id").agg((F.count_if(pts > opp) - F.when(F.col("team_id") % 7 == 0, F.count("*")).otherwise(0)).alias("w"), F.count_if(pts < opp).alias("l"))
        return old, new

    @cached_property
    def matchups(self) -> DataFrame:
        """Ten matchups as texts: a year and a school, and a school with a season."""
        t = self.teams
        n = self.read("supplier").count()
        first = t.filter("team_id < 10").select(F.col("team_id").alias("matchup"), F.concat((F.col("team_id") * 6 + 1960).cast("string"), F.lit(" "), "school").alias("text_a"), ((F.col("team_id") + 1) % n).alias("other"))
        other = t.select(F.col("team_id").alias("other"), F.lower("school").alias("other_school"))
        return first.join(other, "other").select("matchup", "text_a", F.concat("other_school", F.lit("  "), S.season_key(1995 - F.col("matchup") * 3)).alias("text_b"))

    @cached_property
    def played(self) -> DataFrame:
        """The matchups resolved, profiled and predicted."""
        short = self.spark.createDataFrame([("s1", "Supplier 000000001")], "abbr string, meant string")
        games, ranked_, rated, coached, teams = self.games, self.ranked, self.kept_ratings, self.kept_seasons, self.teams
        asked = self.matchups.select("matchup", F.explode(F.array(F.struct(F.lit("a").alias("letter"), F.col("text_a").alias("t")), F.struct(F.lit("b").alias("letter"), F.col("text_b").alias("t")))).alias("s"))
        sides = matchup.resolved(asked.select("matchup", "s.letter", matchup.parsed(F.col("s.t")).alias("p")).select("matchup", "letter", "p.*"), teams, short)
        both = matchup.profiles(sides, teams, rated, ranked_, coached, games, score.close_score())
        return matchup.predicted(matchup.facing(both))


    @cached_property
    def kept_factors(self) -> DataFrame:
        """One row for each matchup asked for."""
        return staged(matchup.factors(self.played), "factors")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to `digits` places, counts as long: the same on every engine."""
    kinds = dict(df.dtypes)
    return df.select(*(S.round_up(F.col(c), digits).cast("double").alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint", "smallint") else F.col(c) for c in df.columns))


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str
    doubles: str = ""


ENTRIES: dict[str, Entry] = {}


def entry(name: str, sql: str, doubles: str = ""):
    """Registers a query with its SQL and the SQL's columns of doubles."""

    def add(build: Callable[[Tables], DataFrame]):
        ENTRIES[name] = Entry(build, sql, doubles)
        return build

    return add


def add(name: str, build: Callable[[Tables], DataFrame], sql: str, doubles: str = "") -> None:
    entry(name, sql, doubles)(build)


_PARTS = ", ".join(score.WEIGHTS)
_OLD_PARTS = ", ".join(score_earlier.WEIGHTS)
_TIERS = ", ".join(ratings.TIER_COUNTS)

# efficiency
add("season_efficiency", lambda t: ratings.team_means(t.rated), "SELECT season, team_id, em, oe, de, games, wins, losses, rank FROM means", "em oe de")
add("adjusted_efficiency", lambda t: t.ratings.select("season", "team_id", "em", "oe", "de", "games", "wins", "losses", "rank", "steps"), "SELECT season, team_id, em, oe, de, games, wins, losses, rank, steps FROM adj", "em oe de")
add("schedule_strength", lambda t: t.ratings.select("season", "team_id", "sos", *ratings.TIER_COUNTS, "sos_rank"), f"SELECT season, team_id, sos, {_TIERS}, sos_rank FROM strength", "sos")
add("league_averages", lambda t: ratings.team_means(t.rated).groupBy("season").agg(F.avg("em").alias("em"), F.avg("oe").alias("oe"), F.avg("de").alias("de"), F.count("*").alias("teams")), "SELECT season, avg(em) AS em, avg(oe) AS oe, avg(de) AS de, count(*) AS teams FROM m0 GROUP BY season", "em oe de")
add("all_time_ratings", lambda t: t.ratings.select("season", "team_id", S.round_up(F.col("em"), 2).alias("em")).orderBy(F.desc("em"), "season", "team_id").limit(100), f"SELECT season, team_id, em FROM (SELECT season, team_id, {_up('em', 2)} AS em FROM adj) ORDER BY em DESC, season, team_id LIMIT 100")
add("current_ratings", lambda t: t.ratings.filter(F.col("season") >= "2015-16").select("season", "team_id", S.round_up(F.col("em"), 2).alias("em")).orderBy(F.desc("em"), "season", "team_id").limit(25), f"SELECT season, team_id, em FROM (SELECT season, team_id, {_up('em', 2)} AS em FROM adj WHERE season >= '2015-16') ORDER BY em DESC, season, team_id LIMIT 25")
add("rank_correlation", lambda t: ratings.spearman(t.ratings, t.seasons), """SELECT season, n, 1 - 6 * d2 / (n * (n * n - 1)) AS rho FROM (SELECT season, count(*) AS n, CAST(sum((a - b) * (a - b)) AS DOUBLE) AS d2 FROM (SELECT season, row_number() OVER (PARTITION BY season ORDER BY round(em, 6) DESC, team_id) AS a, row_number() OVER (PARTITION BY season ORDER BY round(srs, 6) DESC, team_id) AS b FROM adj JOIN (SELECT season, team_id, srs FROM v_seasons WHERE srs IS NOT NULL) USING (season, team_id)) GROUP BY 1 HAVING count(*) >= 10)""", "rho")
add("average_rank_correlation", lambda t: ratings.spearman(t.ratings, t.seasons).agg(F.count("*").alias("seasons"), F.avg("rho").alias("rho")), """SELECT count(*) AS seasons, avg(1 - 6 * d2 / (n * (n * n - 1))) AS rho FROM (SELECT season, count(*) AS n, CAST(sum((a - b) * (a - b)) AS DOUBLE) AS d2 FROM (SELECT season, row_number() OVER (PARTITION BY season ORDER BY round(em, 6) DESC, team_id) AS a, row_number() OVER (PARTITION BY season ORDER BY round(srs, 6) DESC, team_id) AS b FROM adj JOIN (SELECT season, team_id, srs FROM v_seasons WHERE srs IS NOT NULL) USING (season, team_id)) GROUP BY 1 HAVING count(*) >= 10)""", "rho")
add("rating_samples", lambda t: t.ratings.join(t.seasons.filter(F.col("srs").isNotNull()).select("team_id", "season", "srs"), ["team_id", "season"]).filter((F.col("team_id") <= 5) & F.col("season").isin("1999-00", "1984-85", "2012-13")).select("team_id", "season", S.round_up(F.col("em"), 2).alias("em"), "srs", "rank"), f"SELECT team_id, season, {_up('adj.em', 2)} AS em, s.srs, rank FROM adj JOIN (SELECT team_id, season, srs FROM v_seasons WHERE srs IS NOT NULL) s USING (team_id, season) WHERE team_id <= 5 AND season IN ('1999-00', '1984-85', '2012-13')", "srs")

# seasons and scores
add("seasons", lambda t: t.seasons, "SELECT * FROM v_seasons", "ppg opp_ppg srs sr_sos win_pct conf_pct")
add("close_games", lambda t: t.seasons.select("team_id", "season", *(f"{k}_{s}" for k in ("close", "clutch", "overtime") for s in ("wins", "losses")), score.close_score().alias("close_score")), f"SELECT team_id, season, close_wins, close_losses, clutch_wins, clutch_losses, overtime_wins, overtime_losses, close_score FROM (SELECT *, {'{close}'} AS close_score FROM v_seasons)", "close_score")
add("draft_production", lambda t: score.draft_production(t.picks), "SELECT * FROM production")
add("era_stats", lambda t: score.era_stats(t.score_rows), "SELECT * FROM era_means", " ".join(f"{m}_{s}" for m in score.METRICS for s in ("mean", "sd")))
add("season_scores", lambda t: t.scored.select("team_id", "season", "era", *score.WEIGHTS, "raw", "score", "note"), f"SELECT team_id, season, era, {_PARTS}, raw, score, note FROM scored", " ".join([*score.WEIGHTS, "raw"]))
add("program_rankings", lambda t: score.programs(t.scored).withColumn("best_five", F.array_join(F.transform("best_five", lambda b: F.concat_ws(" ", b["season"], b["record"], F.coalesce(b["coach"], F.lit("?")))), "; ")), "SELECT team_id, top10, decayed, seasons, qualifying, best_season, best_score, best_five, decayed / " + repr(sum(100 * 0.92**i for i in range(30))) + "::DOUBLE * 100 AS normalised, rank FROM programs", "decayed normalised")
add("era_leaders", lambda t: lookups.era_leaders(t.scored).select("era", "era_rank", "team_id", "season", "score"), "SELECT * FROM (SELECT era, row_number() OVER (PARTITION BY era ORDER BY score DESC, season, team_id) AS era_rank, team_id, season, score FROM scored WHERE wins + losses >= 10) WHERE era_rank <= 25")
add("era_counts", lambda t: t.score_rows.groupBy("era").agg(F.count("*").alias("n")), "SELECT era, count(*) AS n FROM score_rows GROUP BY era")
add("best_seasons", lambda t: score.best_of_team(t.scored).orderBy(F.desc("score"), "team_id"), "SELECT team_id, first(season ORDER BY score DESC, season) AS season, max(score) AS score, first(era ORDER BY score DESC, season) AS era FROM scored GROUP BY team_id")
add("scores_by_team", lambda t: lookups.by_team(t.ranked).select("team_id", F.size("seasons").alias("n"), F.array_join(F.transform("seasons", lambda s: F.concat_ws("#", s["season"], s["rank"].cast("string"))), " ").alias("seasons")), "SELECT team_id, count(*) AS n, string_agg(season || '#' || rank, ' ' ORDER BY rank) AS seasons FROM good GROUP BY team_id")
add("top_seasons", lambda t: score.ranked(lookups.rankings(t.scored, most=100), "score", ("season", "team_id")).select("rank", "team_id", "season", "score", "em", F.concat_ws("-", "wins", "losses").alias("record"), "coach", "era", "conf", "seed"), "SELECT rank, team_id, season, score, em, wins || '-' || losses AS record, coach, era, conf, seed FROM good WHERE rank <= 100", "em")
add("current_leaders", lambda t: lookups.rankings(t.scored, since=2016).select("team_id", "season", "score"), "SELECT team_id, season, score FROM good WHERE end_year >= 2016 ORDER BY rank LIMIT 25")
add("score_listing", lambda t: score.ranked(lookups.rankings(t.scored, most=50), "score", ("season", "team_id")).select(matchup.report_line(F.col("rank"), F.col("score"), F.col("season"), F.col("name")).alias("line")), "SELECT lpad(CAST(rank AS VARCHAR), 4, ' ') || ' ' || lpad(printf('%.2f', score), 6, ' ') || '  ' || rpad(season, 8, ' ') || ' ' || rpad(name, 30, ' ') AS line FROM good WHERE rank <= 50")
add("sanity_checks", lambda t: t.scored.filter("place = 1").select("team_id", "season", score.banded(F.col("score")).alias("verdict")), "SELECT team_id, season, CASE WHEN score >= 80 THEN 'PASS (80+)' WHEN score >= 75 THEN 'OK (75+)' WHEN score >= 70 THEN 'WARN (70+)' ELSE 'FAIL (<70)' END AS verdict FROM scored WHERE place = 1")
add("earlier_era_stats", lambda t: score.era_stats(score_earlier.rows(t.seasons), score_earlier.METRICS), "SELECT * FROM old_means", " ".join(f"{m}_{s}" for m in score_earlier.METRICS for s in ("mean", "sd")))
add("earlier_scores", lambda t: t.earlier.select("team_id", "season", "era", *score_earlier.WEIGHTS, "raw", "score"), f"SELECT team_id, season, era, {_OLD_PARTS}, raw, score FROM old_scored", " ".join([*score_earlier.WEIGHTS, "raw"]))
add("earlier_programs", lambda t: score_earlier.programs(t.earlier), "SELECT * FROM old_programs")
add("earlier_leaders", lambda t: lookups.rankings(t.earlier, most=100).select("team_id", "season", "score"), "SELECT team_id, season, score FROM old_scored WHERE wins + losses >= 10 ORDER BY score DESC, season, team_id LIMIT 100")
add("scores_compared", lambda t: score.compared(t.scored, t.earlier), """SELECT rank, team_id, season, score, earlier_rank, earlier_score, score - earlier_score AS change, CASE WHEN score > earlier_score THEN '↑' WHEN score < earlier_score THEN '↓' WHEN score = earlier_score THEN '=' END AS arrow FROM (SELECT * FROM good WHERE rank <= 20) LEFT JOIN (SELECT team_id, season, score AS earlier_score, row_number() OVER (ORDER BY score DESC, season, team_id) AS earlier_rank FROM old_scored WHERE wins + losses >= 10 QUALIFY earlier_rank <= 100) USING (team_id, season)""", "change")

# coaches
add("coach_tenures", lambda t: t.tenures, "SELECT * FROM tenures", "pct")
add("coach_careers", lambda t: t.careers, "SELECT * FROM careers", "pct")
add("coach_leaderboard", lambda t: coaches.leaderboard(t.careers, 500).select("rank", "coach", "wins"), "SELECT rank, coach, wins FROM careers WHERE wins >= 500")
add("season_coaches", lambda t: coaches.season_coaches(t.coached, t.tenures).select("team_id", "season", "coach", "who"), "SELECT team_id, season, coach, who FROM led")
add("coach_prestige", lambda t: t.led.select("team_id", "season", "who", "wins_then", "prestige"), "SELECT team_id, season, who, wins_then, prestige FROM esteem JOIN (SELECT team_id, season, prestige FROM score_rows) USING (team_id, season)", "prestige")
add("coaches_updated", lambda t: coaches.with_deltas(coaches.leaderboard(t.careers), sync.deltas(*t.snapshots), 2010), "SELECT *, row_number() OVER (ORDER BY wins DESC, coach) AS rank FROM (SELECT coach, wins + CASE WHEN up THEN dw ELSE 0 END AS wins, losses + CASE WHEN up THEN dl ELSE 0 END AS losses, CASE WHEN up THEN round_even(CAST(wins + dw AS DOUBLE) * 100 / (wins + dw + losses + dl), 1) ELSE pct END AS pct, up AS updated FROM (SELECT c.*, dw, dl, dw IS NOT NULL AND last_year >= 2010 AS up FROM careers c LEFT JOIN gains ON gains.team_id = c.last_school WHERE wins >= 200))", "pct")

# query service
add("head_to_head", lambda t: t.h2h, "SELECT * FROM h2h")
add("team_info", lambda t: t.info.withColumn("title_years", F.array_join(F.transform("title_years", lambda y: y.cast("string")), ",")), "SELECT * REPLACE (coalesce(array_to_string(title_years, ','), '') AS title_years) FROM info")
add("lookup_team", lambda t: lookups.find_team(t.teams, "00001"), "SELECT * FROM v_teams WHERE contains(name, '00001') ORDER BY team_id LIMIT 5")
add("lookup_team_by_alias", lambda t: lookups.find_team(t.teams, "nick-3", t.teams.select(F.concat(F.lit("nick-"), "team_id").alias("alias"), "team_id")), "SELECT * FROM v_teams WHERE contains('nick-' || team_id, 'nick-3') ORDER BY team_id LIMIT 5")
add("lookup_team_by_mascot", lambda t: lookups.find_team(t.teams, "Tar Heels"), "SELECT * FROM v_teams WHERE mascot = 'Tar Heels' ORDER BY team_id LIMIT 5")
add("lookup_team_seasons", lambda t: lookups.team_seasons(t.seasons, 3).select("season", "wins", "losses", "seed", "ap_high", "tourney"), "SELECT season, wins, losses, seed, ap_high, tourney FROM v_seasons WHERE team_id = 3 ORDER BY start_year DESC LIMIT 15")
add("lookup_team_seasons_of_years", lambda t: lookups.team_seasons(t.seasons, 3, 1970, 1999).select("season", "wins", "losses"), "SELECT season, wins, losses FROM v_seasons WHERE team_id = 3 AND end_year BETWEEN 1970 AND 1999")
add("lookup_head_to_head", lambda t: lookups.head_to_head_of(t.h2h, 1, 2), "SELECT w, l, g FROM h2h WHERE team_id = 1 AND opp = 2")
add("lookup_head_to_head_mirrored", lambda t: lookups.head_to_head_of(t.h2h.filter("team_id < opp"), 4, 1), "SELECT l AS w, w AS l, g FROM h2h WHERE team_id = 1 AND opp = 4")
add("lookup_rankings", lambda t: lookups.rankings(t.scored).select("team_id", "season", "score"), "SELECT team_id, season, score FROM good ORDER BY rank LIMIT 25")
add("lookup_rankings_of_era", lambda t: lookups.rankings(t.scored, "era", era="Mid Modern", most=10).select("team_id", "season", "score"), "SELECT team_id, season, score FROM good WHERE era = 'Mid Modern' ORDER BY rank LIMIT 10")
add("lookup_rankings_of_team", lambda t: lookups.rankings(t.scored, "team", team_id=3).select("season", "score"), "SELECT season, score FROM good WHERE team_id = 3 ORDER BY rank LIMIT 25")
add("lookup_rankings_of_programs", lambda t: score.programs(t.scored).filter("rank <= 50").select("rank", "team_id", "top10"), "SELECT rank, team_id, top10 FROM programs WHERE rank <= 50")
add("lookup_coach", lambda t: lookups.coach_info(t.careers), "SELECT * FROM careers ORDER BY rank LIMIT 20", "pct")
add("lookup_coach_by_name", lambda t: lookups.coach_info(t.careers, name="Thompson"), "SELECT * FROM careers WHERE contains(lower(coach), 'thompson') ORDER BY rank LIMIT 5", "pct")
add("lookup_coaches_of_team", lambda t: lookups.coach_info(t.careers, t.tenures, team_id=3), "SELECT * FROM tenures WHERE team_id = 3 ORDER BY last_year DESC, coach LIMIT 10", "pct")
add("lookup_coaches_by_wins", lambda t: lookups.coach_info(t.careers, least=300, greatest=900), "SELECT * FROM careers WHERE wins BETWEEN 300 AND 900 ORDER BY rank LIMIT 30", "pct")
add("lookup_coach_stops", lambda t: lookups.coach_stops(t.tenures, t.teams, "John"), "SELECT team_id, coach, wins, losses, coalesce(name, 'Unknown') AS team FROM tenures LEFT JOIN v_teams USING (team_id) WHERE contains(lower(coach), 'john') ORDER BY team_id, coach LIMIT 10")
add("lookup_efficiency", lambda t: lookups.efficiency(t.ratings, 3).select("season", "em", "oe", "de", "rank", "sos", "sos_rank"), "SELECT season, em, oe, de, rank, sos, sos_rank FROM ratings WHERE team_id = 3 ORDER BY season DESC LIMIT 5", "em oe de sos")
add("lookup_efficiency_of_season", lambda t: lookups.efficiency(t.ratings, 3, "1998-99").select("season", "em", "rank"), "SELECT season, em, rank FROM ratings WHERE team_id = 3 AND season = '1998-99'", "em")
add("lookup_draft", lambda t: lookups.draft_schools(t.picks), "SELECT team_id, count(*) AS picks, count(*) FILTER (round = 1) AS first_round FROM picks WHERE year BETWEEN 1947 AND 2026 GROUP BY team_id ORDER BY first_round DESC, picks DESC, team_id LIMIT 15")
add("lookup_draft_picks", lambda t: lookups.draft_picks(t.picks, 1980, 1999), "SELECT * REPLACE (CAST(round AS BIGINT) AS round) FROM picks WHERE year BETWEEN 1980 AND 1999 ORDER BY pick, year, pick_id LIMIT 20")
add("lookup_draft_of_team", lambda t: lookups.draft_picks(t.picks, team_id=3), "SELECT * REPLACE (CAST(round AS BIGINT) AS round) FROM picks WHERE year BETWEEN 1947 AND 2026 AND team_id = 3 ORDER BY pick, year, pick_id LIMIT 20")
add("lookup_champion", lambda t: lookups.champion(t.info, 1999).select("team_id", "name", "slug", "titles"), "SELECT team_id, name, slug, titles FROM info WHERE list_contains(title_years, 1999)")
add("lookup_conference", lambda t: lookups.conference(t.info, "nation_1").select("team_id", "name", "mascot", "conf", "all_wins", "all_losses", "titles", "appearances"), "SELECT team_id, name, mascot, conf, all_wins, all_losses, titles, appearances FROM info WHERE contains(lower(conf), 'nation_1')")
add("lookup_conferences", lambda t: lookups.conferences(t.teams), "SELECT DISTINCT conf FROM v_teams WHERE conf IS NOT NULL")
_FOUND = "SELECT game_date, opp, CASE loc WHEN 'A' THEN 'Away' WHEN 'H' THEN 'Home' ELSE 'Neutral' END AS place, CASE WHEN pts > opp_pts THEN 'W' ELSE 'L' END AS result, pts || '-' || opp_pts AS points, count(*) OVER () AS total FROM v_games WHERE team_id = 5 AND {} ORDER BY game_date, order_key, opp, pts, opp_pts LIMIT 30"
add("lookup_games", lambda t: lookups.search_games(t.games, 5, season="1998-99"), _FOUND.format("game_date BETWEEN DATE '1998-10-01' AND DATE '1999-06-01'"))
add("lookup_games_in_march", lambda t: lookups.search_games(t.games, 5, march=True), _FOUND.format("month(game_date) IN (3, 4)"))
add("lookup_games_against", lambda t: lookups.search_games(t.games, 5, opp_text="TAR-HEELS", teams=t.teams), _FOUND.format("opp IN (SELECT team_id FROM v_teams WHERE contains(slug, 'tar-heels'))"))
add("lookup_games_against_id", lambda t: lookups.search_games(t.games, 5, opp=8), _FOUND.format("opp = 8"))
_SEEDS = "SELECT coalesce(seed, 0) AS seed, count(*) FILTER (pts > opp_pts) AS w, count(*) FILTER (NOT pts > opp_pts) AS l, count(*) AS games FROM played_late {} GROUP BY ROLLUP (seed)"
add("seed_record", lambda t: lookups.seed_record(t.late), _SEEDS.format(""))
add("seed_record_against", lambda t: lookups.seed_record(t.late, 2), _SEEDS.format("WHERE opp_seed = 2"))
add("upset_summary", lambda t: lookups.upset_summary(t.upsets), "SELECT seeds, count(*) FILTER (NOT upset) AS better_wins, count(*) FILTER (upset) AS worse_wins, count(*) AS games, round_even(count(*) FILTER (upset) * 100.0::DOUBLE / count(*), 1) AS upset_pct FROM upsets GROUP BY seeds", "upset_pct")
add("lookup_upsets", lambda t: lookups.upsets_of(t.upsets, "1v3").select("game_date", "team_id", "opp", "pts", "opp_pts"), "SELECT game_date, team_id, opp, pts, opp_pts FROM upsets WHERE upset AND seeds = '1v3' ORDER BY game_date, team_id, order_key LIMIT 20")
add("upset_worklist", lambda t: lookups.upset_worklist(t.upsets, t.upsets.filter("team_id % 5 = 0").select(F.format_string("%d/%d-vs-%d", F.year("game_date"), "team_id", "opp").alias("game_key")).distinct(), t.teams.filter("team_id % 4 = 1").select("team_id", F.lit(1991).alias("year"))), "SELECT game_key, year, seeds, CAST(later AS BIGINT) AS later, row_number() OVER (PARTITION BY year ORDER BY later, far, game_key, order_key) AS place FROM (SELECT *, year || '/' || team_id || '-vs-' || opp AS game_key, CASE WHEN seed + opp_seed = 17 THEN opp_seed - 1 ELSE 99 END AS far, CASE WHEN year = 1991 AND team_id % 4 = 1 THEN 0 ELSE 1 END AS later FROM (SELECT *, year(game_date) AS year FROM upsets) WHERE upset AND year BETWEEN 1985 AND 2004 AND team_id % 5 <> 0)")
add("lookup_team_history", lambda t: lookups.team_history(t.info, t.seasons, 3), "SELECT team_id, name, all_wins, all_losses, decades FROM info JOIN (SELECT team_id, string_agg(decade || 's: ' || w || '-' || l, '; ' ORDER BY decade) AS decades FROM (SELECT team_id, CAST(floor(end_year / 10) * 10 AS BIGINT) AS decade, CAST(sum(wins) AS BIGINT) AS w, CAST(sum(losses) AS BIGINT) AS l FROM v_seasons WHERE team_id = 3 GROUP BY ALL) GROUP BY team_id) USING (team_id)")
add("lookup_slug_pair", lambda t: lookups.slug_pair(t.teams, "supplier-000000001-blue-devils", "supplier-000000002-tar-heels"), "SELECT a.team_id AS one_id, a.name AS one_name, b.team_id AS two_id, b.name AS two_name FROM v_teams a, v_teams b WHERE a.slug = 'supplier-000000001-blue-devils' AND b.slug = 'supplier-000000002-tar-heels'")

# matchups
add("matchup_sides", lambda t: matchup.resolved(t.matchups.select("matchup", matchup.parsed(F.col("text_b")).alias("p")).select("matchup", "p.*"), t.teams, t.spark.createDataFrame([("s1", "Supplier 000000001")], "abbr string, meant string")).select("matchup", "season", "spring", "team_id", "error"), "SELECT matchup, season_b AS season, spring_b AS spring, team_b AS team_id, NULL::VARCHAR AS error FROM sides")
add("matchup_prediction", lambda t: t.played.select("matchup", "name_a", "name_b", "season_a", "season_b", "record_a", "record_b", "points_a", "points_b", "prob_a", "final_a", "final_b", "winner", "lead"), "SELECT matchup, name_a, name_b, season_a, season_b, record_a, record_b, points_a, points_b, prob_a, final_a, final_b, winner, lead FROM played", "points_a points_b prob_a")
add("matchup_factors", lambda t: t.kept_factors.select("matchup", F.inline("factors")), "SELECT matchup, e.name, e.team_a, e.team_b, e.edge, e.side FROM (SELECT matchup, unnest(f) AS e FROM weighed) WHERE e.name <> 'HTSS' OR e.side IS NOT NULL")
add("short_names", lambda t: t.teams.select("team_id", names.short_name(F.col("name")).alias("short"), names.school_name(F.col("name"), F.col("mascot")).alias("school"), names.suggested_slug(F.col("name")).alias("guess"), names.title_of_slug(F.col("slug")).alias("title")), f"SELECT team_id, CASE WHEN regexp_matches(name, ' ({names.MASCOTS})$') THEN regexp_replace(name, ' ({names.MASCOTS})$', '') ELSE split_part(name, ' ', 1) END AS short, school, CASE WHEN mascot IN ('Wildcats', 'Tar Heels', 'Jayhawks', 'Bruins') THEN replace(lower(school), ' ', '-') ELSE replace(lower(name), ' ', '-') END AS guess, array_to_string([upper(x[1]) || x[2:] FOR x IN string_split(slug, '-')], ' ') AS title FROM v_teams")

# sync, quality, sets
add("snapshot_deltas", lambda t: sync.deltas(*t.snapshots), "SELECT * FROM gains")
add("first_run_deltas", lambda t: sync.deltas(t.snapshots[0].limit(0), t.snapshots[1]), "SELECT * FROM gains WHERE false")
add("repaired_games", lambda t: sync.repaired(t.games.withColumn("w", F.col("order_key") % 3 == 0)).groupBy("team_id").agg(F.count("*").alias("games"), F.count_if("repaired").alias("repaired"), F.count_if("w").alias("won")), "SELECT team_id, count(*) AS games, count(*) FILTER (w <> f) AS repaired, count(*) FILTER (f) AS won FROM (SELECT *, CASE WHEN pts > opp_pts THEN true WHEN pts < opp_pts THEN false ELSE w END AS f FROM (SELECT *, order_key % 3 = 0 AS w FROM v_games QUALIFY row_number() OVER (PARTITION BY team_id, game_date, opp, pts, opp_pts ORDER BY order_key) = 1)) GROUP BY 1")
add("coverage", lambda t: sync.coverage(t.games.filter(~((F.col("team_id") % 3 == 0) & (F.col("order_key") % 3 > 0))), t.seasons), "SELECT * EXCLUDE (won), CASE WHEN share < 50 THEN 'LOW' WHEN share < 80 THEN 'PARTIAL' WHEN won > book_wins + 5 THEN 'CONFLICT' WHEN share IS NOT NULL THEN 'GOOD' END AS band FROM (SELECT team_id, book_wins, book_losses, coalesce(found, 0) AS found, coalesce(found, 0) * 100 / nullif(book_wins + book_losses, 0) AS share, book_wins - coalesce(won, 0) AS win_gap, book_losses - (coalesce(found, 0) - coalesce(won, 0)) AS loss_gap, resolved, bad_scores, won FROM (SELECT team_id, CAST(sum(wins) AS BIGINT) AS book_wins, CAST(sum(losses) AS BIGINT) AS book_losses FROM v_seasons GROUP BY 1) LEFT JOIN (SELECT team_id, count(*) AS found, count(*) FILTER (pts > opp_pts) AS won, avg(CASE WHEN opp_id IS NULL THEN 0 ELSE 1 END) AS resolved, count(*) FILTER (pts > 200 OR opp_pts > 200) AS bad_scores FROM v_games WHERE NOT (team_id % 3 = 0 AND order_key % 3 > 0) GROUP BY 1) USING (team_id))", "share resolved")
add("conference_coverage", lambda t: sync.conference_coverage(t.teams, t.games.filter("team_id % 3 <> 0")), "SELECT conf, count(*) AS teams, count(games) AS covered, CAST(coalesce(sum(games), 0) AS BIGINT) AS games, count(games) * 100 / count(*) AS pct FROM v_teams LEFT JOIN (SELECT team_id, count(*) AS games FROM v_games WHERE team_id % 3 <> 0 GROUP BY 1) USING (team_id) GROUP BY conf", "pct")
add("to_fetch", lambda t: sync.to_fetch(t.teams, t.teams.filter("team_id % 3 = 0"), t.teams.filter("team_id % 2 = 0").select("team_id", (F.col("team_id") * 7 % 50).alias("net_rank")), 30), "SELECT team_id, name, CASE WHEN team_id % 2 = 0 THEN team_id * 7 % 50 ELSE 999 END AS net_rank FROM v_teams WHERE team_id % 3 <> 0 ORDER BY net_rank, team_id LIMIT 30")
add("schedules_to_fetch", lambda t: sync.schedule_keys(t.teams, 2001, 2004, (2, 3), t.teams.select(F.format_string("%d_2003_2", "team_id").alias("key"))), "SELECT team_id, CAST(year AS BIGINT) AS year, CAST(kind AS BIGINT) AS kind, team_id || '_' || year || '_' || kind AS key FROM v_teams, (SELECT unnest([2001, 2002, 2003, 2004]) AS year), (SELECT unnest([2, 3]) AS kind) WHERE NOT (year = 2003 AND kind = 2)")
_ZERO = ("conf_titles", "titles", "polled")
add("zeros_filled", lambda t: sync.filled(t.info.select("team_id", *_ZERO), t.teams.filter("team_id % 2 = 0").select("team_id", (F.col("team_id") % 5).alias("conf_titles"), F.lit(9).alias("titles"), F.lit(0).alias("polled")), _ZERO), "SELECT team_id, CASE WHEN conf_titles = 0 AND team_id % 2 = 0 AND team_id % 5 > 0 THEN team_id % 5 ELSE conf_titles END AS conf_titles, CASE WHEN titles = 0 AND team_id % 2 = 0 THEN 9 ELSE titles END AS titles, polled, (conf_titles = 0 AND team_id % 2 = 0 AND team_id % 5 > 0) OR (titles = 0 AND team_id % 2 = 0) AS changed FROM info")
add("zeros_left", lambda t: sync.needs_update(t.info, _ZERO).select("team_id"), "SELECT team_id FROM info WHERE conf_titles = 0 OR titles = 0 OR polled = 0")
add("records_overwritten", lambda t: sync.overwritten(t.info.select("team_id", "all_wins"), t.teams.filter("team_id % 2 = 0").join(t.info.select("team_id", "all_wins"), "team_id").select("team_id", (F.col("all_wins") + F.col("team_id") % 4).alias("all_wins")), ("all_wins",)), "SELECT team_id, CASE WHEN team_id % 2 = 0 THEN all_wins + team_id % 4 ELSE all_wins END AS all_wins, team_id % 4 = 2 AS changed FROM info")
add("overrides", lambda t: sync.with_overrides(t.info.select("team_id", "titles"), t.teams.filter("team_id % 9 = 0").select("team_id", F.lit(7).cast("long").alias("value"), F.lit("record book").alias("source")), "titles"), "SELECT team_id, CASE WHEN team_id % 9 = 0 THEN 7 ELSE titles END AS titles, CASE WHEN team_id % 9 = 0 THEN titles END AS replaced, CASE WHEN team_id % 9 = 0 THEN 'record book' END AS source FROM info")
add("merged_games", lambda t: sync.merged(t.games.filter("team_id % 3 = 0"), t.games.filter("team_id % 2 = 0")).groupBy("team_id").agg(F.count("*").alias("n")), "SELECT team_id, count(*) AS n FROM v_games WHERE team_id % 3 = 0 OR team_id % 2 = 0 GROUP BY 1")
add("last_file_wins", lambda t: sync.kept_last(t.teams.select("team_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("file")).filter("(team_id + file) % 3 < 2"), ("team_id",), F.col("file")), "SELECT team_id, CAST(max(file) AS BIGINT) AS file FROM v_teams, (SELECT unnest([1, 2, 3]) AS file) WHERE (team_id + file) % 3 < 2 GROUP BY 1")
add("all_files_appended", lambda t: t.games.filter("team_id % 3 = 0").unionByName(t.games.filter("team_id % 3 = 1")).unionByName(t.games.filter("team_id % 3 = 1")).groupBy("team_id").agg(F.count("*").alias("n")), "SELECT team_id, count(*) * CASE WHEN team_id % 3 = 1 THEN 2 ELSE 1 END AS n FROM v_games WHERE team_id % 3 < 2 GROUP BY 1")
add("teams_seen", lambda t: t.games.filter("order_key % 2 = 0").select("team_id").union(t.games.filter("order_key % 2 = 1").select("team_id")).distinct(), "SELECT DISTINCT team_id FROM v_games")
add("least_loaded_file", lambda t: sync.least_loaded(t.games.withColumn("file", F.concat(F.lit("games_"), (F.col("team_id") % 3 + 1).cast("string"))), "file"), "SELECT 'games_' || (team_id % 3 + 1) AS file, count(*) AS games, count(DISTINCT team_id) AS teams FROM v_games GROUP BY 1 ORDER BY games, file LIMIT 1")
add("halves", lambda t: sync.halves(t.games.select("team_id"), "team_id").groupBy("part").agg(F.count("*").alias("games"), F.count_distinct("team_id").alias("teams")), "SELECT CAST(CASE WHEN team_id <= m THEN 1 ELSE 2 END AS BIGINT) AS part, count(*) AS games, count(DISTINCT team_id) AS teams FROM v_games, (SELECT quantile_cont(team_id, 0.5) AS m FROM (SELECT DISTINCT team_id FROM v_games)) GROUP BY 1")
add("opponents_resolved", lambda t: sync.resolved_opponents(t.games.join(t.teams.select(F.col("team_id").alias("opp"), "slug"), "opp").select("team_id", "order_key", F.when(F.col("order_key") % 4 != 0, F.col("opp")).alias("raw_opp"), F.when(F.col("order_key") % 20 == 0, "nowhere").when(F.col("order_key") % 8 == 0, F.concat(F.lit("x-"), F.col("opp").cast("string"))).otherwise(F.col("slug")).alias("opp_slug")), t.teams, t.teams.select(F.concat(F.lit("x-"), F.col("team_id").cast("string")).alias("alias"), "team_id")).groupBy("team_id", "way").agg(F.count("*").alias("n"), F.sum("found").alias("ids")), "SELECT team_id, CASE WHEN order_key % 4 <> 0 THEN 'id' WHEN order_key % 20 = 0 THEN 'none' WHEN order_key % 8 = 0 THEN 'alias' ELSE 'slug' END AS way, count(*) AS n, CAST(sum(CASE WHEN order_key % 20 <> 0 THEN opp END) AS BIGINT) AS ids FROM v_games GROUP BY 1, 2")
add("season_years", lambda t: sync.season_years(t.teams.select(F.when(F.col("team_id") % 3 == 0, F.col("team_id")).otherwise(F.col("team_id") + 1000000).alias("team_id"), F.when(F.col("team_id") % 3 == 2, "none").otherwise(F.col("slug")).alias("slug")), t.seasons, t.teams).select("team_id", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years")), "SELECT CASE WHEN team_id % 3 = 0 THEN team_id ELSE team_id + 1000000 END AS team_id, CASE WHEN team_id % 3 = 2 THEN (SELECT string_agg(y, ',' ORDER BY y) FROM range(1950, 2027) r(y)) ELSE years END AS years FROM v_teams JOIN (SELECT team_id, string_agg(end_year, ',' ORDER BY end_year) AS years FROM v_seasons WHERE end_year >= 1950 GROUP BY 1) USING (team_id)")
add("clone_teams", lambda t: sync.clones(t.seasons.withColumn("season_conf", F.when(F.col("team_id") % 6 == 1, F.lit("ACC")).otherwise(F.col("conf"))).withColumn("wins", F.when(F.col("team_id") % 10 < 2, F.lit(5).cast("long")).otherwise(F.col("wins"))).withColumn("losses", F.when(F.col("team_id") % 10 < 2, F.lit(5).cast("long")).otherwise(F.col("losses"))), t.info), """SELECT team_id, CASE WHEN turn > 1 THEN 'same records' ELSE 'conference' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY print ORDER BY all_wins DESC, team_id) AS turn FROM (SELECT s.team_id, any_value(i.all_wins) AS all_wins, string_agg(season || ':' || CASE WHEN s.team_id % 10 < 2 THEN '5-5' ELSE s.wins || '-' || s.losses END, '|' ORDER BY start_year DESC) AS print FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY start_year DESC) AS k, count(*) OVER (PARTITION BY team_id) AS c FROM v_seasons) s JOIN info i USING (team_id) WHERE k <= 10 AND c >= 3 GROUP BY s.team_id)) WHERE turn > 1 OR team_id % 6 = 1""")
add("repeated_schools", lambda t: sync.repeated_schools(t.coached.filter("team_id % 2 = 0").unionByName(t.coached.filter("team_id % 2 = 0").withColumn("team_id", F.col("team_id") + 100000)), t.teams.filter("team_id % 4 <> 0").unionByName(t.teams.withColumn("team_id", F.col("team_id") + 100000))), "SELECT team_id FROM (SELECT *, row_number() OVER (PARTITION BY n, newest, oldest, coach ORDER BY unlisted, team_id) AS turn FROM (SELECT team_id, n, newest, oldest, coach, CASE WHEN team_id % 4 <> 0 THEN 0 ELSE 1 END AS unlisted FROM (SELECT team_id, count(*) AS n, max(season) AS newest, min(season) AS oldest, coalesce(arg_max_null(coach, season), '') AS coach FROM coached WHERE team_id % 2 = 0 GROUP BY 1) UNION ALL SELECT team_id + 100000, n, newest, oldest, coach, 0 FROM (SELECT team_id, count(*) AS n, max(season) AS newest, min(season) AS oldest, coalesce(arg_max_null(coach, season), '') AS coach FROM coached WHERE team_id % 2 = 0 GROUP BY 1))) WHERE turn > 1")
add("asymmetric_pairs", lambda t: sync.asymmetric(t.h2h.withColumn("w", F.when((F.col("team_id") == 1) & (F.col("opp") < 5), F.col("w") + 1).otherwise(F.col("w")))), "SELECT *, CASE WHEN team_id = 1 THEN l ELSE l + 1 END AS w2, CASE WHEN team_id = 1 THEN w - 1 ELSE w END AS l2 FROM (SELECT team_id, opp, w + CASE WHEN team_id = 1 AND opp < 5 THEN 1 ELSE 0 END AS w, l, g FROM h2h) WHERE (team_id = 1 AND opp < 5) OR (opp = 1 AND team_id < 5)")
add("pair_summary", lambda t: sync.head_to_head_summary(t.h2h), "SELECT count(*) AS teams, CAST(sum(o) AS BIGINT) AS pairings, max(o) AS most, first(team_id ORDER BY o DESC, team_id) AS most_team FROM (SELECT team_id, count(*) AS o FROM h2h GROUP BY 1)")
add("season_summary", lambda t: sync.season_summary(t.seasons), "SELECT CAST(sum(n) AS BIGINT) AS seasons, count(*) FILTER (t) AS with_tournament, count(*) FILTER (p) AS with_poll FROM (SELECT team_id, count(*) AS n, bool_or(tourney IS NOT NULL) AS t, bool_or(ap_high IS NOT NULL OR ap_final IS NOT NULL) AS p FROM v_seasons GROUP BY 1)")
add("slug_problems", lambda t: sync.slug_problems(t.teams.select(F.when(F.col("team_id") % 5 == 0, F.concat("slug", F.lit("!"))).when(F.col("team_id") % 5 == 1, F.lit("twice")).otherwise(F.col("slug")).alias("slug"))), "SELECT slug, n, CASE WHEN contains(slug, '!') THEN 'format' ELSE 'repeated' END AS problem FROM (SELECT CASE team_id % 5 WHEN 0 THEN slug || '!' WHEN 1 THEN 'twice' ELSE slug END AS slug, count(*) AS n FROM v_teams GROUP BY 1) WHERE contains(slug, '!') OR n > 1")
add("url_buckets", lambda t: sync.url_buckets(t.teams.select(F.when(F.col("team_id") % 10 == 0, 404).when(F.col("team_id") % 10 == 1, 500).otherwise(200).alias("status"))), "SELECT CASE team_id % 10 WHEN 0 THEN 'not_found' WHEN 1 THEN 'error' ELSE 'success' END AS bucket, count(*) AS n FROM v_teams GROUP BY 1")
add("failures_in_a_row", lambda t: sync.failures_in_a_row(t.read("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), (F.col("event_id") % 3 == 0).alias("ok"))).select("at", "failures"), "SELECT event_id AS at, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS failures FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT *, event_id % 3 = 0 AS ok FROM events))")
add("page_links", lambda t: sync.page_links(t.read("pages")), "SELECT page_id, coalesce(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1), '') AS title, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS BIGINT) AS n_links FROM pages")

# ingest
add("parsed_schedules", lambda t: ingest.schedule(render.schedule_rows(t.games, t.teams), "2025-12-31").drop("opp"), "SELECT g.team_id, order_key, game_date, CASE WHEN order_key % 20 = 0 THEN t.school ELSE t.slug END AS opp_slug, loc, pts > opp_pts AS won, pts, opp_pts, CASE WHEN abs(pts - opp_pts) <= 1 THEN 'OT' END AS ot FROM v_games g JOIN v_teams t ON t.team_id = g.opp WHERE order_key % 41 <> 0 AND order_key % 43 <> 0 AND order_key % 31 <> 0 AND game_date <= DATE '2025-12-31' AND NOT (pts = 0 AND opp_pts = 0)")
add("parsed_seasons", lambda t: ingest.season_table(render.season_rows(t.coached)), "SELECT team_id, season AS of_season, season, wins, losses, wins || '-' || losses AS record, floor(win_pct * 1000 + 0.5) / 1000 AS win_pct, conf, conf_wins || '-' || conf_losses AS conf_record, CASE WHEN place % 17 <> 0 THEN sign(srs) * floor(abs(srs) * 1000 + 0.5) / 1000 END AS srs, nullif(ap_pre, 13) AS ap_pre, nullif(ap_high, 13) AS ap_high, nullif(ap_final, 13) AS ap_final, tourney, seed, coach FROM coached WHERE place % 29 <> 0 AND place % 31 <> 0", "win_pct srs")
add("parsed_school_pages", lambda t: ingest.school_page(render.school_pages(t.info)), "SELECT team_id, CASE team_id % 6 WHEN 5 THEN NULL WHEN 4 THEN all_wins + 1000 ELSE all_wins END AS wins, CASE team_id % 6 WHEN 5 THEN NULL WHEN 4 THEN all_losses + 1000 ELSE all_losses END AS losses, conf_titles + titles AS conf_titles, polled AS ap_weeks, greatest(final_fours, 1) AS all_americans, CAST((greatest(appearances, 1) + 2) // 3 AS BIGINT) AS first_round FROM info")
_LINES = "SELECT l_orderkey AS game, CAST(l_suppkey AS BIGINT) AS team_id, l_linenumber AS n, l_partkey AS a, l_partkey // 7 AS b, l_orderkey + l_linenumber AS c FROM lineitem"


def _box(t: Tables) -> DataFrame:
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").cast("long").alias("team_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("a"), F.floor(F.col("l_partkey") / 7).alias("b"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("c"))
    # a game's lines are dealt to two teams
    two = lines.withColumn("team_id", F.col("game") % 7 * 2 + F.col("n") % 2)
    return ingest.box_rows(ingest.box_tables(render.box_scores(two, t.teams)))


_BOX = f"SELECT game, team_id, slug, n, CASE WHEN n % 2 = 0 THEN a % 40 + CASE WHEN b % 60 >= 30 THEN 1 ELSE 0 END ELSE a % 40 END AS min, c % 31 AS pts, a % 9 || '-' || a % 9 + 3 AS tp, CASE WHEN n % 3 = 0 OR b % 15 = 0 THEN b % 4 + b % 7 ELSE b % 15 END AS reb, c % 5 AS turnovers, c FROM (SELECT * REPLACE (CAST(game % 7 * 2 + n % 2 AS BIGINT) AS team_id) FROM ({_LINES})) JOIN v_teams USING (team_id)"
_TWO = "SELECT game FROM (SELECT DISTINCT game, team_id FROM boxes) GROUP BY game HAVING count(*) = 2"
add("parsed_box_scores", lambda t: _box(t).filter("NOT is_total").select("game", "slug", "name", "min", "pts", "tp", "reb", "turnovers"), f"SELECT game, slug, 'Player ' || n AS name, min, pts, tp, reb, turnovers FROM (WITH boxes AS ({_BOX}) SELECT * FROM boxes WHERE c % 13 <> 0 AND game IN ({_TWO}))")
add("box_score_totals", lambda t: ingest.box_scores(_box(t)).select("game", F.size("teams").alias("teams"), F.col("teams")[0]["slug"].alias("first_slug"), F.size(F.col("teams")[0]["players"]).alias("players"), F.col("teams")[0]["total"].alias("total")), f"SELECT game, 2::BIGINT AS teams, slug AS first_slug, players, total FROM (WITH boxes AS ({_BOX}) SELECT game, team_id, slug, count(*) FILTER (c % 13 <> 0) AS players, CAST(sum(pts) AS BIGINT) AS total FROM boxes WHERE game IN ({_TWO}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY game ORDER BY total DESC, team_id DESC) = 1")
_DOCS = """SELECT *, CASE WHEN order_key % 3 = 2 THEN 0 ELSE pts END AS p1, CASE WHEN order_key % 3 = 2 THEN 0 ELSE opp_pts END AS p2, CASE WHEN month(game_date) BETWEEN 3 AND 4 THEN 3 ELSE 2 END AS kind, order_key || '-' || least(team_id, opp) || '-' || greatest(team_id, opp) || '-' || least(pts, opp_pts) AS id FROM v_games WHERE order_key % 11 <> 0"""
_GAMES = f"""SELECT id, strftime(game_date, '%Y-%m-%d') AS date, CASE WHEN CAST(team_id AS VARCHAR) < CAST(opp AS VARCHAR) THEN team_id ELSE opp END AS t1, CASE WHEN CAST(team_id AS VARCHAR) < CAST(opp AS VARCHAR) THEN opp ELSE team_id END AS t2, CASE WHEN CAST(team_id AS VARCHAR) < CAST(opp AS VARCHAR) THEN p1 ELSE p2 END AS s1, CASE WHEN CAST(team_id AS VARCHAR) < CAST(opp AS VARCHAR) THEN p2 ELSE p1 END AS s2, kind,
  CASE order_key % 7 WHEN 0 THEN 'ncaa' WHEN 1 THEN 'nit' ELSE CASE WHEN kind = 3 THEN CASE WHEN order_key % 7 = 2 THEN 'conf_tourney' ELSE 'postseason' END ELSE 'regular' END END AS type FROM ({_DOCS})"""
_KEPT = f"SELECT DISTINCT id, date, CAST(t1 AS VARCHAR) AS t1, CAST(t2 AS VARCHAR) AS t2, s1, s2, CASE WHEN kind = 2 AND abs(s1 - s2) <= 3 AND s1 > 0 THEN 'close' ELSE type END AS type FROM ({_GAMES}) WHERE kind = 3 OR abs(s1 - s2) >= 15 OR (abs(s1 - s2) <= 3 AND s1 > 0)"
add("parsed_schedule_documents", lambda t: ingest.schedule_games(render.schedule_documents(t.games)).filter("t1 <> t2"), f"SELECT id, first(date ORDER BY type <> 'close', type, date) AS date, first(t1) AS t1, first(t2) AS t2, first(s1) AS s1, first(s2) AS s2, first(type ORDER BY type <> 'close', type, date) AS type FROM ({_KEPT}) WHERE t1 <> t2 GROUP BY id")
add("games_by_type", lambda t: ingest.schedule_games(render.schedule_documents(t.games)).filter("t1 <> t2").groupBy("type").agg(F.count("*").alias("n")), f"SELECT type, count(*) AS n FROM (SELECT id, first(type ORDER BY type <> 'close', type, date) AS type FROM ({_KEPT}) WHERE t1 <> t2 GROUP BY id) GROUP BY type")
add("parsed_records", lambda t: ingest.current_records(render.record_documents(t.snapshots[0])), "SELECT team_id, w0 AS w, l0 AS l FROM snap WHERE team_id % 4 <> 3 AND before > 0")
add("parsed_game_logs", lambda t: ingest.game_logs(render.game_logs(t.games, t.teams)).groupBy("team_id").agg(F.count("*").alias("n"), F.count("opp").alias("opps"), F.count_if("w").alias("won"), F.sum("pts").alias("pts"), F.min("game_date").alias("first")), "SELECT team_id, count(*) AS n, count(*) FILTER (order_key % 4 <> 0) AS opps, count(*) FILTER (pts > opp_pts) AS won, CAST(sum(pts) AS BIGINT) AS pts, min(game_date) AS first FROM v_games GROUP BY 1")
add("parsed_stream", lambda t: ingest.stream_events(render.event_lines(t.read("events"))), "SELECT 'delta' AS type, event_id AS id, user_id FROM events WHERE event_id % 10 > 3")
add("site_map", lambda t: files.site_map(t.teams, "https://example.org/").select("part", "key", "loc", "priority"), "SELECT 2::BIGINT AS part, name AS key, 'https://example.org/?team=' || slug AS loc, '0.8' AS priority FROM v_teams UNION ALL SELECT * FROM (VALUES (0::BIGINT, '', 'https://example.org/', '1.0'), (1, '0', 'https://example.org/?view=bracket', '0.6'), (1, '1', 'https://example.org/?view=rankings', '0.6'), (1, '2', 'https://example.org/?view=teams', '0.6'), (1, '3', 'https://example.org/?view=coaches', '0.6'))")
add("meta_tags", lambda t: files.meta_tags(t.info.withColumn("name", F.concat("name", F.lit(' & "Co" <x>')))), "SELECT team_id, name || ' &amp; &quot;Co&quot; &lt;x&gt;' AS title, all_wins || '-' || all_losses || ' all-time | ' || CASE WHEN titles > 0 THEN titles || ' National Championship' || CASE WHEN titles > 1 THEN 's' ELSE '' END ELSE 'No National Championships' END || ' | ' || coalesce(conf, '') AS description FROM info")

# streaming state
add("rate_limited", lambda t: limited(t.read("events"), most=3, seconds=86400), """SELECT user_id, event_id, n <= 3 AS allowed FROM walk""")
_WALK = """ordered AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk AS (SELECT user_id, event_id, k, ts AS opened, 1 AS n FROM ordered WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.ts - w.opened > INTERVAL 86400 SECOND THEN o.ts ELSE w.opened END, CASE WHEN o.ts - w.opened > INTERVAL 86400 SECOND THEN 1 ELSE w.n + 1 END FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.k = w.k + 1)"""


stores.register(add)
analyses.register(add)


def _run(build: Callable[[Tables], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build(Tables(spark, sf_dir)))


def queries() -> dict[str, Query]:
    return {name: partial(_run, e.build) for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, e in ENTRIES.items():
        sql = e.sql.replace("{close}", CLOSE_SQL)
        out[name] = f"WITH RECURSIVE {_WALK}\n{sql}" if name == "rate_limited" else oracle(sql, e.doubles)
    return out


from tipoff.plans.sql import _CLOSE as CLOSE_SQL  # noqa: E402
