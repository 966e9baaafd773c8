"""What scores say over time and how firmly: trajectories of programs, a model of deep tournament runs, sensitivity to the weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.operators.score import FEW_GAMES, WEIGHTS
from tipoff.sources.staged import staged

#: Years that a trajectory looks back, and how many risers and fallers are listed.
SPANS, LISTED = (5, 10, 20), 15
LEAST_SEASONS = 3
#: First year of the model, size of a step of the weights, seasons whose order is compared.
MODEL_FROM, CHANGE, COMPARED = 1985, 0.05, 100
NEWTON_STEPS, RIDGE = 8, 1.0


def _good(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("wins") + F.col("losses") >= FEW_GAMES)


def trajectories(scored: DataFrame) -> DataFrame:
    """span, direction, place, team_id, slope, seasons: the LISTED programs that rose and fell most in points a year over the last 5, 10 and 20
    years of each program. A frame is one of years, not of rows, so years without a season count as years; fewer than LEAST_SEASONS seasons
    give no slope. Each list is a top-k; no window spans all programs."""
    rows = _good(scored).select("team_id", F.col("end_year").cast("long").alias("end_year"), "score")
    by_year = Window.partitionBy("team_id").orderBy("end_year")
    frames = {s: by_year.rangeBetween(1 - s, 0) for s in SPANS}
    seen = rows.select("*", F.max("end_year").over(Window.partitionBy("team_id")).alias("last"), *(F.regr_slope("score", "end_year").over(w).alias(f"slope{s}") for s, w in frames.items()), *(F.count("*").over(w).alias(f"n{s}") for s, w in frames.items()))
    last = staged(seen.filter("end_year = last"), "trajectories")
    out = None
    for s in SPANS:
        own = last.filter(F.col(f"n{s}") >= LEAST_SEASONS).select(F.lit(s).alias("span"), "team_id", F.round(f"slope{s}", 6).alias("slope"), F.col(f"n{s}").alias("seasons"))
        for direction, order in (("riser", F.desc("slope")), ("faller", F.asc("slope"))):
            top = own.orderBy(order, "team_id").limit(LISTED)
            placed = top.withColumn("place", F.row_number().over(Window.orderBy(order, "team_id"))).select("span", F.lit(direction).alias("direction"), "place", "team_id", "slope", "seasons")  # LISTED rows
            out = placed if out is None else out.unionByName(placed)
    return out


def deep_runs(scored: DataFrame) -> DataFrame:
    """x (score in steps of 15 from 50), y (whether the season reached the last sixteen) of seasons that ended since MODEL_FROM."""
    deep = F.coalesce(F.col("tourney").rlike("Regional|National"), F.lit(False))
    return _good(scored).filter(F.col("end_year") >= MODEL_FROM).select(((F.col("score") - 50) / 15).alias("x"), deep.cast("double").alias("y"), "score")


def round_model(scored: DataFrame) -> DataFrame:
    """One row: the logistic regression of deep runs on the score (b0, b1; ridge RIDGE), by Newton steps of which each is one aggregate of
    all rows, and how often the top quartile gets there against all."""
    data = staged(deep_runs(scored), "deep-runs")
    b0 = b1 = 0.0
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * F.col("x"))))
        d, w, x = F.col("y") - p, p * (1 - p), F.col("x")
        g0, g1, h00, h01, h11 = (v or 0.0 for v in data.agg(F.sum(d), F.sum(d * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).first())
        g0, g1, h00, h11 = g0 - RIDGE * b0, g1 - RIDGE * b1, h00 + RIDGE, h11 + RIDGE
        det = h00 * h11 - h01 * h01
        b0, b1 = b0 + (h11 * g0 - h01 * g1) / det, b1 + (h00 * g1 - h01 * g0) / det
    quartile = data.agg(F.percentile("score", 0.75).alias("q"))  # scores have two places, so their values are few
    top = F.col("score") >= F.col("q")
    return data.crossJoin(F.broadcast(quartile)).agg(F.lit(b0).alias("b0"), F.lit(b1).alias("b1"), F.count("*").alias("n"), F.avg("y").alias("base"), F.avg(F.when(top, F.col("y"))).alias("top"))  # one row


def sensitivity(scored: DataFrame) -> DataFrame:
    """component, change, moved: pairs among the first COMPARED seasons whose order turns when a component's weight is changed by CHANGE of
    itself (Kendall distance), for each weight up and down; share of all pairs. All variants are computed in one pass over the seasons; only
    the first COMPARED are compared by pairs."""
    grid = [(k, sign * CHANGE) for k in WEIGHTS for sign in (1, -1)]

    def raw(weights: dict[str, float]):
        up = down = F.lit(0.0)
        for k, w in weights.items():
            up, down = up + F.coalesce(F.col(k), F.lit(0.0)) * w, down + F.when(F.col(k).isNotNull(), w).otherwise(0.0)
        return F.round(up / down, 9)

    variants = [F.struct(F.lit(k).alias("component"), F.lit(c).alias("change"), raw({j: w * (1 + c) if j == k else w for j, w in WEIGHTS.items()}).alias("value")) for k, c in grid]
    rows = _good(scored).select("team_id", "season", raw(WEIGHTS).alias("base"), F.array(*variants).alias("v"))
    first = staged(rows.orderBy(F.desc("base"), "season", "team_id").limit(COMPARED), "sensitivity")
    each = first.select("team_id", "season", "base", F.explode("v").alias("v")).select("team_id", "season", "base", "v.*")
    a, b = each.alias("a"), each.alias("b")
    same = (F.col("a.component") == F.col("b.component")) & (F.col("a.change") == F.col("b.change"))
    pairs = a.join(b, same).filter(F.col("a.base") > F.col("b.base"))
    return pairs.groupBy(F.col("a.component").alias("component"), F.col("a.change").alias("change")).agg(F.count_if(F.col("a.value") < F.col("b.value")).alias("moved"), F.count("*").alias("pairs"))
