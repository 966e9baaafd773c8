"""The earlier season score: five components, a factor for open rosters, programs by their decayed sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tipoff.functions import seasons as S
from tipoff.operators import score as now

#: Weights of the five components; shares of SRS, win share and margin with and without SRS; of schedules; of league records.
WEIGHTS = {"dominance": 0.35, "sos_part": 0.20, "tournament": 0.20, "conference": 0.10, "perception": 0.15}
WITH_SRS, WITHOUT_SRS, SOS, SOS_BONUS, LEAGUE_SOS = (0.45, 0.30, 0.25), (0.55, 0.45), 0.85, 0.15, 0.3
LEAGUE_BONUS = ((1.0, 0.5), (0.9, 0.2))
OPEN_ROSTERS_FROM, OPEN_ROSTERS = 2021, 1.03
BOOST_POWER, BOOST_SIZE = 1.3, 3.0
METRICS = ("win_pct", "margin", "srs", "sr_sos", "conf_pct", "ap_pre", "ap_high", "ap_final")


def rows(seasons: DataFrame) -> DataFrame:
    """Seasons with margin (null where points are unknown), the earlier eras, and 0 for an unknown win share."""
    return seasons.withColumn("margin", F.col("ppg") - F.col("opp_ppg")).withColumn("era", S.earlier_era(F.col("end_year"))).withColumn("win_pct", F.coalesce("win_pct", F.lit(0.0)))


def season_scores(seasons: DataFrame) -> DataFrame:
    own = rows(seasons)
    data = now.with_era_stats(own, METRICS)
    z = {m: S.safe_z(F.col(m).cast("double"), F.col(f"{m}_mean"), F.col(f"{m}_sd")) for m in METRICS}
    base = F.coalesce(
        z["srs"] * WITH_SRS[0] + z["win_pct"] * WITH_SRS[1] + z["margin"] * WITH_SRS[2],
        z["win_pct"] * WITHOUT_SRS[0] + z["margin"] * WITHOUT_SRS[1],
        z["win_pct"],
    )
    league = F.when((F.col("conf_pct") >= LEAGUE_BONUS[0][0]) & (F.col("conf_wins") > 0), LEAGUE_BONUS[0][1]).when((F.col("conf_pct") >= LEAGUE_BONUS[1][0]) & (F.col("conf_wins") > 0), LEAGUE_BONUS[1][1]).otherwise(0.0)
    parts = {
        "dominance": F.when(base.isNull(), 0.0).otherwise(base + now.perfect_bonus()),
        "sos_part": F.coalesce(z["sr_sos"] * SOS + F.when(z["sr_sos"] > 1, (z["sr_sos"] - 1) * SOS_BONUS).otherwise(0.0), z["conf_pct"] * LEAGUE_SOS, F.lit(0.0)),
        "tournament": now.tournament_part(S.tournament_result(F.col("tourney"), first_round=0.0)),
        "conference": F.coalesce(z["conf_pct"] + league, F.lit(0.0)),
        "perception": now.perception_part(z),
    }
    data = data.select(*own.columns, *(c.alias(k) for k, c in parts.items()))
    rosters = F.when(F.col("end_year") >= OPEN_ROSTERS_FROM, OPEN_ROSTERS).otherwise(1.0)
    data = data.withColumn("raw", now.shared_out(WEIGHTS) * rosters)
    return data.withColumn("score", now.bounded(S.round_up(now.scaled(F.col("raw"), BOOST_POWER, BOOST_SIZE), 2)))


def programs(scored: DataFrame) -> DataFrame:
    """Per team the decayed sum of its thirty best seasons as a share of the greatest possible; this is what ranks it."""
    good = scored.filter(F.col("wins") + F.col("losses") >= now.FEW_GAMES)
    place = F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("score"), "season"))
    most = sum(100 * now.DECAY**i for i in range(now.TOP))
    top = good.select("team_id", "season", "score", place.alias("place")).filter(F.col("place") <= now.TOP)
    sums = top.groupBy("team_id").agg(F.sum(F.col("score") * F.pow(F.lit(now.DECAY), F.col("place") - 1)).alias("decayed"), F.max(F.when(F.col("place") == 1, F.col("season"))).alias("best_season"))
    out = sums.select("team_id", "best_season", S.round_up(F.col("decayed") / most * 100, 2).alias("program_score"))
    return now.ranked(out, "program_score", ("team_id",))
