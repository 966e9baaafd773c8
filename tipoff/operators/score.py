"""Season scores: components normalised within eras, weights shared out where a component is missing, program rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tipoff.functions import seasons as S

CAP = 3.5
#: Weights of the nine components.
WEIGHTS = {"efficiency": 0.30, "sos_part": 0.12, "tournament": 0.18, "quality": 0.10, "perception": 0.10, "close_game": 0.05, "coaching": 0.05, "draft": 0.05, "era_difficulty": 0.05}
METRICS = ("em", "sos", "win_pct", "conf_pct", "ap_high", "ap_final", "srs", "sr_sos", "quality_record", "close_score", "prestige", "draft_score")
#: Shares of SRS and win share where ratings lack, of the other schedule measures, of the polls; bonuses of polls to 1, 3 and 5,
#: of perfect records (base, each win over 20) and of one loss with 28 wins; points of a title; the scale of scores.
NO_RATING, OTHER_SOS, LEAGUE_SOS, HIGH_POLL, FINAL_POLL = (0.65, 0.35), 0.8, 0.3, 0.40, 0.35
POLL_BONUS, PERFECT, ONE_LOSS, TITLE = ((1, 0.5), (3, 0.25), (5, 0.125)), (0.3, 0.015), 0.15, 15.0
MIDDLE, EACH, BOOST_FROM, BOOST_POWER, BOOST_SIZE = 50, 15, 1.5, 1.2, 3.5
DECAY, TOP = 0.92, 30
FEW_GAMES, FEW_GAMES_MOST, WINLESS_MOST = 10, 65.0, 20.0
#: Seasons ending from here on may still be open: no tournament is no fault yet.
OPEN_FROM = 2026


def close_score() -> Column:
    """Smoothed share of close games won, those by three or fewer once more; null without any."""
    total = lambda k: F.col(f"{k}_wins") + F.col(f"{k}_losses")
    smooth = lambda k: (F.col(f"{k}_wins") + 1.0) / (total(k) + 2.0)
    return F.when(total("close") >= 1, smooth("close") * 0.6 + F.when(total("clutch") > 0, smooth("clutch")).otherwise(smooth("close")) * 0.4)


def draft_production(picks: DataFrame) -> DataFrame:
    """Each pick counts for the season that ends in its year and the two before: 3 for the first 14, 2 for the rest of round one, 1 after."""
    worth = F.when((F.col("round") == 1) & (F.col("pick") <= 14), 3).when(F.col("round") == 1, 2).otherwise(1)
    whole = picks.filter(F.col("year").isNotNull() & F.col("round").isNotNull())
    each = whole.withColumn("worth", worth).select("team_id", "worth", F.explode(F.sequence(F.col("year") - 3, F.col("year") - 1)).alias("start_year"))
    return each.groupBy("team_id", "start_year").agg(F.count_if(F.col("worth") == 3).alias("lottery"), F.count_if(F.col("worth") == 2).alias("first_round"), F.count_if(F.col("worth") == 1).alias("second_round"), F.sum("worth").cast("double").alias("draft_score"))


def quality_record() -> Column:
    wins = F.col("t1w") * 4 + F.col("t2w") * 2 + F.col("t3w") * 0.5
    return wins - (F.col("t2l") + F.col("t3l") * 2 + F.col("t4l") * 4)


def era_stats(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Rows, mean and deviation (of all, not of a sample) of each metric in each era; nulls do not count."""
    return rows.groupBy("era").agg(F.count("*").alias("n"), *(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_sd"))))


def with_era_stats(rows: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """One row for each era, joined back: a handful of rows by the rule of eras. Seasons without an era keep null statistics."""
    return rows.join(F.broadcast(era_stats(rows, metrics)), "era", "left")


def perfect_bonus() -> Column:
    return F.when((F.col("win_pct") >= 1) & (F.col("wins") >= 20), PERFECT[0] + (F.col("wins") - 20) * PERFECT[1]).when((F.col("losses") == 1) & (F.col("wins") >= 28), ONE_LOSS).otherwise(0.0)


def tournament_part(result: Column) -> Column:
    """Points by the size of the field, a title today being 1; 0 while the season is open."""
    grow = F.log2(F.lit(float(S.FIELD_REST))) / F.log2(F.greatest(S.field_size(F.col("end_year")), F.lit(2)).cast("double"))
    points = F.when(result["points"] > 0, result["points"] * grow).otherwise(result["points"] / grow)
    is_open = (result["round"] == "in_progress") | ((result["round"] == "none") & (F.col("end_year") >= OPEN_FROM))
    return F.when(is_open, 0.0).otherwise(points / TITLE)


def perception_part(z: dict[str, Column]) -> Column:
    """Polls, whose ranks count the other way; null where no poll lists the team."""
    poll = lambda m: F.coalesce(-z[m], F.lit(0.0))
    bonus = reduce(lambda a, b: a.when(F.col("ap_high") <= b[0], b[1]), POLL_BONUS[1:], F.when(F.col("ap_high") <= POLL_BONUS[0][0], POLL_BONUS[0][1])).otherwise(0.0)
    return F.when(F.col("ap_high").isNotNull() | F.col("ap_final").isNotNull(), poll("ap_high") * HIGH_POLL + poll("ap_final") * FINAL_POLL + bonus)


def scaled(raw: Column, power: float, size: float) -> Column:
    return MIDDLE + raw * EACH + F.when(raw > BOOST_FROM, F.pow(F.greatest(raw - BOOST_FROM, F.lit(0.0)), F.lit(power)) * size).otherwise(0.0)


def bounded(score: Column) -> Column:
    """0 to 100; few games give 65 at most, no win 20 at most."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    capped = F.when((F.col("wins") + F.col("losses") < FEW_GAMES) & (inside > FEW_GAMES_MOST), FEW_GAMES_MOST).otherwise(inside)
    return F.when((F.col("wins") == 0) & (F.col("losses") > 0), F.least(capped, F.lit(WINLESS_MOST))).otherwise(capped)


def shared_out(weights: dict[str, float]) -> Column:
    """Weighted mean of the components that are there."""
    total = lambda f: reduce(lambda a, b: a + b, (f(k, w) for k, w in weights.items()))
    return total(lambda k, w: F.coalesce(F.col(k), F.lit(0.0)) * w) / total(lambda k, w: F.when(F.col(k).isNotNull(), w).otherwise(0.0))


def season_scores(rows: DataFrame) -> DataFrame:
    """rows: a season each with METRICS (null where unknown), wins, losses, end_year, era and tourney. Adds the components, raw, score and a
    note where few games capped it. A season without an era has no components and scores 50."""
    data = with_era_stats(rows, METRICS)
    z = {m: S.safe_z(F.col(m).cast("double"), F.col(f"{m}_mean"), F.col(f"{m}_sd"), CAP) for m in METRICS}
    base = F.coalesce(z["em"], z["srs"] * NO_RATING[0] + z["win_pct"] * NO_RATING[1], z["win_pct"])
    sos = F.least(z["sos"] + F.when(z["sos"] > 1, (z["sos"] - 1) * 0.1).otherwise(0.0), F.lit(CAP))
    parts = {
        "efficiency": F.when(base.isNull(), 0.0).otherwise(base + perfect_bonus()),
        "sos_part": F.coalesce(F.when(z["sos"].isNotNull(), sos), z["sr_sos"] * OTHER_SOS, z["conf_pct"] * LEAGUE_SOS, F.lit(0.0)),
        "tournament": tournament_part(S.tournament_result(F.col("tourney"))),
        "quality": F.coalesce(z["quality_record"], F.lit(0.0)),
        "perception": perception_part(z),
        "close_game": z["close_score"],
        "coaching": z["prestige"],
        "draft": F.coalesce(z["draft_score"], F.lit(0.0)),
        "era_difficulty": F.when(F.col("end_year") >= 2021, 0.6).when(F.col("end_year") < 1966, -0.2).otherwise(0.0),
    }
    known = F.col("n").isNotNull()
    data = data.select(*rows.columns, *(F.when(known, c).alias(k) for k, c in parts.items()), known.alias("_known"))
    data = data.withColumn("raw", F.when(F.col("_known"), shared_out(WEIGHTS))).drop("_known")
    score = F.when(F.col("raw").isNull(), float(MIDDLE)).otherwise(S.round_up(scaled(F.col("raw"), BOOST_POWER, BOOST_SIZE), 2))
    few = (F.col("wins") + F.col("losses") < FEW_GAMES) & (F.least(score, F.lit(100.0)) > FEW_GAMES_MOST)
    return data.withColumn("note", F.when(few, "Capped: fewer than 10 games played")).withColumn("score", bounded(score))


def ranked(df: DataFrame, value: str, ties: tuple[str, ...], name: str = "rank", digits: int = 2) -> DataFrame:
    """Rank by `value` from the greatest, ties by `ties`, without gathering all rows: rows are numbered within each value (to `digits`
    places), and counts of the values, of which there are few by their range, give where each begins."""
    key = F.floor(F.col(value) * 10**digits + 0.5).cast("long")
    keyed = df.withColumn("_key", key)
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(F.desc("_key")).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_key", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*ties))
    return keyed.withColumn("_place", place).join(starts, "_key").withColumn(name, F.col("_place") + F.col("_before")).drop("_key", "_place", "_before")


def programs(scored: DataFrame) -> DataFrame:
    """Per team: mean of its ten best seasons, the decayed sum of its thirty best and its share of the greatest possible, best five. Means of
    ten scores often end in half a cent, where the order of adding decides, so scores are added from the best on, as lists of thirty at most:
    an aggregate's own sum depends on how many teams its task has, and ranks count teams by it twice."""
    good = F.col("wins") + F.col("losses") >= FEW_GAMES
    place = F.row_number().over(Window.partitionBy("team_id").orderBy(F.when(good, 0).otherwise(1), F.desc("score"), "season"))
    record = F.concat_ws("-", "wins", "losses")
    rows = scored.select("team_id", "season", "score", record.alias("record"), "coach", good.alias("good"), place.alias("place"))
    most = sum(100 * DECAY**i for i in range(TOP))
    in_top = lambda k: F.col("good") & (F.col("place") <= k)
    added = lambda c, of: F.aggregate(c, F.lit(0.0), lambda total, b: total + of(b))
    out = rows.groupBy("team_id").agg(
        F.count("*").alias("seasons"), F.count_if("good").alias("qualifying"), F.max(F.when(in_top(1), F.col("season"))).alias("best_season"), F.max(F.when(in_top(1), F.col("score"))).alias("best_score"),
        F.sort_array(F.collect_list(F.when(in_top(TOP), F.struct("place", "season", "record", "score", "coach")))).alias("best"),
    )
    ten = F.slice("best", 1, 10)
    out = out.select(
        "team_id", F.coalesce(F.try_divide(added(ten, lambda b: b["score"]), F.size(ten)), F.lit(0.0)).alias("top10"), added(F.col("best"), lambda b: b["score"] * F.pow(F.lit(DECAY), b["place"] - 1)).alias("decayed"),
        "seasons", "qualifying", "best_season", "best_score", F.slice("best", 1, 5).alias("best_five"),
    )
    out = out.withColumn("top10", S.round_up(F.col("top10"), 2)).withColumn("normalised", F.col("decayed") / most * 100)
    return ranked(out, "top10", ("team_id",))


def best_of_team(scored: DataFrame) -> DataFrame:
    """The best season of each team, the earliest of equal ones."""
    return scored.groupBy("team_id").agg(F.min_by(F.struct("season", "score", "era"), F.struct(-F.col("score"), "season")).alias("b")).select("team_id", "b.*")


def compared(scored: DataFrame, earlier: DataFrame, most: int = 20, listed: int = 100) -> DataFrame:
    """The first `most` seasons beside their rank and score among the first `listed` of the earlier score, with an arrow for the change."""
    order = (F.desc("score"), "season", "team_id")
    good = lambda d: d.filter(F.col("wins") + F.col("losses") >= FEW_GAMES).select("team_id", "season", "score").orderBy(*order)
    place = F.row_number().over(Window.orderBy(*order))  # over `most` or `listed` rows
    new = good(scored).limit(most).withColumn("rank", place)
    old = good(earlier).limit(listed).withColumn("earlier_rank", place).withColumnRenamed("score", "earlier_score")
    both = new.join(F.broadcast(old), ["team_id", "season"], "left")
    change = F.col("score") - F.col("earlier_score")
    return both.select("rank", "team_id", "season", "score", "earlier_rank", "earlier_score", change.alias("change"), F.when(change > 0, "↑").when(change < 0, "↓").when(change == 0, "=").alias("arrow"))


def banded(score: Column) -> Column:
    """Verdict on a season that should score high."""
    return F.when(score.isNull(), "MISS").when(score >= 80, "PASS (80+)").when(score >= 75, "OK (75+)").when(score >= 70, "WARN (70+)").otherwise("FAIL (<70)")
