"""Efficiency: per-100 values of games, and for each season the opponent-adjusted fixed point with ranks, schedules and tiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from tipoff.functions.seasons import HOME_EDGE, possession_divisor
from tipoff.sources.staged import removed, shared_path, staged

#: Last opponent rank of the first three tiers, at home and elsewhere.
TIERS_HOME, TIERS_AWAY = (50, 100, 200), (30, 75, 160)
FEW_GAMES, DAMPING, CLOSE_ENOUGH, MOST_STEPS = 10, 0.5, 0.01, 100
TIER_COUNTS = tuple(f"t{t}{s}" for t in (1, 2, 3, 4) for s in "wl")
#: Games of a season that one task takes: at 18 bytes a pair of teams, 150 MB at most.
TASK_GAMES = 8_000_000
#: Pairs of a run, pairs that are summed at once as they are read, and rows of a batch that goes back.
RUN, READ, OUT_ROWS = 1 << 18, 1 << 15, 10_000
SCHEMA = "season string, team_id long, em double, oe double, de double, games long, wins long, losses long, rank int, sos double, sos_rank int, " + ", ".join(f"{c} long" for c in TIER_COUNTS) + ", steps int"


def per_100(games: DataFrame, first: int = 0) -> DataFrame:
    """Games with points, from the season that starts in `first` on, with margin (less the home edge), offence and defence per 100 possessions."""
    edge = F.when(F.col("loc") == "H", -HOME_EDGE).when(F.col("loc") == "A", HOME_EDGE).otherwise(0.0)
    scale = 100 / ((F.col("pts") + F.col("opp_pts")) / possession_divisor(F.col("start_year")))
    valid = games.filter((F.col("pts") + F.col("opp_pts") > 0) & (F.col("start_year") >= first))
    return valid.select("*", ((F.col("pts") - F.col("opp_pts") + edge) * scale).alias("margin"), (F.col("pts") * scale).alias("off"), (F.col("opp_pts") * scale).alias("def"), (F.col("pts") > F.col("opp_pts")).alias("won"))


def team_means(rated_games: DataFrame) -> DataFrame:
    """One row for each team and season, before any adjustment: em, oe, de, games, wins, losses, rank."""
    means = rated_games.groupBy("season", "team_id").agg(F.avg("margin").alias("em"), F.avg("off").alias("oe"), F.avg("def").alias("de"), F.count("*").alias("games"), F.count_if("won").alias("wins"))
    # near ties of floating sums are ranked alike everywhere
    rank = F.row_number().over(Window.partitionBy("season").orderBy(F.desc(F.round("em", 6)), "team_id"))
    return means.select("*", (F.col("games") - F.col("wins")).alias("losses"), rank.alias("rank"))


def _ranks(value: np.ndarray) -> np.ndarray:
    """1 for the greatest; equal values by place."""
    out = np.empty(len(value), np.int64)
    out[np.argsort(-np.round(value, 6), kind="stable")] = np.arange(1, len(value) + 1)
    return out


class _Season:
    """Pairs of one season as they are read. Teams and opponents get numbers in the order they come in; margins, offence and defence are summed by
    team at once: of all games, and of those against teams of the season, for which a pair whose opponent has not come as a team yet waits. So 18
    bytes of a pair are kept, in runs of RUN or more rows that are never put together."""

    def __init__(self):
        self.known, self.code = np.zeros(0, np.int64), np.zeros(0, np.int32)  # ids in order, and their numbers
        self.team, self.sums = np.zeros(0, np.bool_), np.zeros((6, 0))
        self.pairs: list[dict[str, np.ndarray]] = []
        self.open: list[dict[str, np.ndarray]] = []  # of the run to come
        self.waiting: list[np.ndarray] = []

    def codes(self, ids: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.known, ids)
        fresh = np.unique(ids[self.known[np.minimum(place, len(self.known) - 1)] != ids] if len(self.known) else ids)
        if len(fresh):
            at = np.searchsorted(self.known, fresh)
            self.code = np.insert(self.code, at, np.arange(len(self.known), len(self.known) + len(fresh), dtype=np.int32))
            self.known = np.insert(self.known, at, fresh)
            self.team = np.append(self.team, np.zeros(len(fresh), np.bool_))
            self.sums = np.hstack([self.sums, np.zeros((6, len(fresh)))])
            place = np.searchsorted(self.known, ids)
        return self.code[place]

    def add(self, rows: dict[str, np.ndarray]) -> None:
        own, other, met = self.codes(rows["team_id"]), np.zeros(len(rows["rated"]), np.int32), rows["rated"]
        other[met] = self.codes(rows["opp_id"][met])
        self.team[own] = True
        values = [rows[c] for c in ("margin", "off", "def")]
        for k, v in enumerate(values):
            self.sums[k] += np.bincount(own, v, len(self.team))
        here = [x[met] for x in (own, other, *values)]
        waiting = [np.concatenate(x) for x in zip(self.waiting, here, strict=True)] if self.waiting else here
        rated = self.team[waiting[1]]
        for k, v in enumerate(waiting[2:], 3):
            self.sums[k] += np.bincount(waiting[0][rated], v[rated], len(self.team))
        self.waiting = [x[~rated] for x in waiting]
        self.open.append({"own": own, "other": other, **{c: rows[c] for c in ("rated", "home", "n", "won")}})
        if sum(len(x["own"]) for x in self.open) >= RUN:
            self.close()

    def close(self) -> None:
        if self.open:
            self.pairs.append({c: np.concatenate([x[c] for x in self.open]) for c in self.open[0]})
            self.open = []

    def finished(self) -> tuple[np.ndarray, np.ndarray, list[dict[str, np.ndarray]]]:
        """ids of the teams in order, sums by team, and pairs by place in that order; `rated` is false where the opponent is none of them."""
        self.close()
        own = self.code[self.team[self.code]]
        ids, sums = self.known[self.team[self.code]], self.sums[:, own]
        place = np.full(len(self.code), -1, np.int32)
        place[own] = np.arange(len(own), dtype=np.int32)
        for r in self.pairs:
            other = place[r["other"]]
            r["rated"] &= other >= 0
            r["own"], r["other"] = place[r["own"]], np.maximum(other, 0)
        self.waiting = []
        return ids, sums, self.pairs


def _runs(batches: Iterator[pa.RecordBatch]) -> _Season:
    """Pairs as plain arrays, without the texts and frames around them."""
    kinds = {"team_id": np.int64, "opp_id": np.int64, "home": np.bool_, "margin": np.float64, "off": np.float64, "def": np.float64, "n": np.int32, "won": np.int32}
    out, open_rows, size = _Season(), [], 0

    def close():
        out.add({c: np.concatenate([x[c] for x in open_rows]) for c in open_rows[0]})
        open_rows.clear()

    for batch in batches:
        opp = batch.column("opp_id")
        rows = {c: (opp.fill_null(0) if c == "opp_id" else batch.column(c)).to_numpy(zero_copy_only=False).astype(kind) for c, kind in kinds.items()}  # copies, so that the batch can go
        open_rows.append(rows | {"rated": opp.is_valid().to_numpy(zero_copy_only=False)})
        size += len(opp)
        if size >= READ:
            close()
            size = 0
    if open_rows:
        close()
    return out


def _solve(season: str | None, read: _Season, steps: int | None) -> Iterator[pa.RecordBatch]:
    """read: sums of games of a team against an opponent, at home or not, of one season. Beside them only rows of teams are held."""
    ids, by_team, runs = read.finished()
    n = len(ids)

    def total(values: Callable[[dict[str, np.ndarray]], np.ndarray]) -> np.ndarray:
        out = np.zeros(n)
        for r in runs:
            out += np.bincount(r["own"], values(r), n)
        return out

    games, wins, met = total(lambda r: r["n"]), total(lambda r: r["won"]), total(lambda r: r["n"] * r["rated"])
    most = np.maximum(met, 1)
    em, oe, de = by_team[:3] / games
    sums = by_team[3:]
    league = em.mean(), oe.mean(), de.mean()
    oe, de = oe - league[1], de - league[2]
    faced = lambda v: total(lambda r: r["n"] * v[r["other"]] * r["rated"])
    w = np.where(games < FEW_GAMES, games / FEW_GAMES, 1.0)
    done = 0
    while done < (steps or MOST_STEPS):
        new = [(sums[0] + faced(em)) / most, (sums[1] - faced(league[1] + de)) / most, (sums[2] - faced(league[2] + oe)) / most]
        new = [w * new[0] + (1 - w) * league[0], w * new[1], w * new[2]]
        old = (em, oe, de)
        em, oe, de = (np.where(met > 0, DAMPING * a + (1 - DAMPING) * b, b) for a, b in zip(new, old, strict=True))
        moved = np.abs(em - old[0]).max()
        em, oe, de = em - em.mean(), oe - oe.mean(), de - de.mean()
        done += 1
        if steps is None and moved <= CLOSE_ENOUGH:
            break
    em, oe, de = em + league[0], oe + league[1], de + league[2]
    rest = em - (oe - de)
    rank = _ranks(em)
    sos = faced(em) / most
    for r in runs:
        placed = rank[r["other"]]
        r["tier"] = np.where(r["home"], np.searchsorted(TIERS_HOME, placed), np.searchsorted(TIERS_AWAY, placed)).astype(np.int8)
    counts = {f"t{t + 1}{s}": total(lambda r: (r["won"] if s == "w" else r["n"] - r["won"]) * (r["rated"] & (r["tier"] == t))).astype(np.int64) for t in range(4) for s in "wl"}  # noqa: B023
    runs.clear()
    out = {"team_id": ids, "em": em, "oe": oe + rest / 2, "de": de - rest / 2, "games": games.astype(np.int64), "wins": wins.astype(np.int64), "losses": (games - wins).astype(np.int64), "rank": rank.astype(np.int32), "sos": sos, "sos_rank": _ranks(sos).astype(np.int32), **counts, "steps": np.full(n, done, np.int32)}
    for at in range(0, n, OUT_ROWS):
        rows = {c: pa.array(v[at : at + OUT_ROWS]) for c, v in out.items()}
        yield pa.RecordBatch.from_pydict({"season": pa.array([season] * len(rows["team_id"]), pa.string()), **rows})


def season_ratings(rated_games: DataFrame, steps: int | None = None) -> DataFrame:
    """Per team and season: the fixed point (every team's margin, offence and defence as its games show them against opponents as rated a step
    before), its rank, the mean rating of rated opponents with its rank (0 without any), and wins and losses in four tiers of opponents.

    Games are summed by team, opponent and place before they are dealt by season, which is all that a step needs; a season's table is as
    large as the pairs of its teams that met, and is read in batches into plain arrays. `steps` fixes their number, else a season ends when no
    margin moves by more than CLOSE_ENOUGH.
    """
    sums = [F.sum(c).alias(c) for c in ("margin", "off", "def")]
    pairs = rated_games.groupBy("season", "team_id", "opp_id", (F.col("loc") == "H").alias("home")).agg(*sums, F.count("*").alias("n"), F.count_if("won").alias("won"))

    def solved(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _solve(key[0].as_py(), _runs(batches), steps)

    return pairs.groupBy("season").applyInArrow(solved, SCHEMA)


def season_ratings_by_tables(rated_games: DataFrame, task_games: int = TASK_GAMES) -> DataFrame:
    """season_ratings() for seasons (or other groups) of any size: the same columns. A season of up to `task_games` games fits into a task and is
    solved there, which takes one shuffle of its pairs; a larger one takes joins and groupings, three shuffles a step."""
    per = staged(rated_games.groupBy("season").agg(F.count("*").alias("n")), "rating-sizes")
    large = per.filter(F.col("n") > task_games).select("season")
    if large.isEmpty():
        return season_ratings(rated_games)
    spread = _ratings_by_steps(rated_games.join(F.broadcast(large), "season", "left_semi"))  # a row for each season
    return spread.unionByName(season_ratings(rated_games.join(F.broadcast(large), "season", "left_anti")))


def _ratings_by_steps(rated_games: DataFrame) -> DataFrame:
    """The ratings of seasons whose pairs do not fit into a task, by joins and groupings.

    A step is a join of the pairs with the ratings of the step before, a sum by team, and means by season. Each step is a written table, which
    cuts the lineage, in one job that also counts what still moves. Seasons whose ratings have settled stay behind in their step's table; later
    steps carry only the others, and tables in which nothing settled are removed.
    """
    spark = rated_games.sparkSession
    sums = [F.sum(c).alias(c) for c in ("margin", "off", "def")]
    pairs = staged(rated_games.groupBy("season", "team_id", "opp_id", (F.col("loc") == "H").alias("home")).agg(*sums, F.count("*").alias("n"), F.count_if("won").alias("won")), "rating-pairs")
    mean = lambda c: (F.sum(c) / F.sum("n")).alias(c)
    means = pairs.groupBy("season", "team_id").agg(mean("margin"), mean("off"), mean("def"), F.sum("n").alias("games"), F.sum("won").alias("wins"))
    league = means.groupBy("season").agg(F.avg("margin").alias("league_em"), F.avg("off").alias("league_oe"), F.avg("def").alias("league_de"))
    teams = staged(means.join(league, "season"), "rating-teams")
    other = teams.select("season", F.col("team_id").alias("opp_id"))
    met = pairs.join(other, ["season", "opp_id"])
    links = staged(met.groupBy("season", "team_id", "opp_id").agg(*sums, F.sum("n").alias("n")), "rating-links")

    weight = F.when(F.col("games") < FEW_GAMES, F.col("games") / FEW_GAMES).otherwise(1.0).alias("w")
    leagues = ("league_em", "league_oe", "league_de")
    now = teams.select("season", "team_id", F.col("margin").alias("em"), (F.col("off") - F.col("league_oe")).alias("oe"), (F.col("def") - F.col("league_de")).alias("de"), weight, *leagues)
    paths = []  # of steps in which a season settled, and of the last
    for step in range(1, MOST_STEPS + 1):
        rated = now.select("season", F.col("team_id").alias("opp_id"), F.col("em").alias("x"), F.col("oe").alias("y"), F.col("de").alias("z"), *leagues)
        n = F.col("n")
        total = links.join(rated, ["season", "opp_id"]).groupBy("season", "team_id").agg(
            F.sum("n").alias("met"), F.sum(F.col("margin") + n * F.col("x")).alias("e"), F.sum(F.col("off") - n * (F.col("league_oe") + F.col("z"))).alias("o"), F.sum(F.col("def") - n * (F.col("league_de") + F.col("y"))).alias("d")
        )
        damped = lambda new, old: F.when(F.col("met") > 0, DAMPING * new + (1 - DAMPING) * F.col(old)).otherwise(F.col(old)).alias(old)
        w, met_ = F.col("w"), F.col("met")
        moved = now.join(total, ["season", "team_id"], "left").select("season", "team_id", F.col("em").alias("was"), damped(w * F.col("e") / met_ + (1 - w) * F.col("league_em"), "em"), damped(w * F.col("o") / met_, "oe"), damped(w * F.col("d") / met_, "de"), "w", *leagues)
        centre = moved.groupBy("season").agg(F.avg("em").alias("em0"), F.avg("oe").alias("oe0"), F.avg("de").alias("de0"), F.max(F.abs(F.col("em") - F.col("was"))).alias("moved"))
        new = moved.join(centre, "season").select("season", "team_id", *((F.col(c) - F.col(f"{c}0")).alias(c) for c in ("em", "oe", "de")), "w", *leagues, "moved")
        new = new.withColumn("steps", F.lit(step)).withColumn("settled", (F.col("moved") <= CLOSE_ENOUGH) | F.lit(step == MOST_STEPS)).drop("moved")
        path, seen = shared_path(spark, "rating-step"), Observation()
        new.observe(seen, F.count_if("settled").alias("settled"), F.count_if(~F.col("settled")).alias("moving")).write.parquet(path)
        if paths and not paths[-1][1]:
            removed(spark, paths.pop()[0])
        paths.append((path, seen.get["settled"] > 0))
        table = spark.read.schema(new.schema).parquet(path)
        now = table.filter("NOT settled").drop("steps", "settled")
        if not seen.get["moving"]:
            break
    kept = spark.read.schema(new.schema).parquet(*(p for p, _ in paths)).filter("settled").drop("settled")
    done = kept.join(teams.select("season", "team_id", "games", "wins"), ["season", "team_id"])
    em, oe, de = F.col("em") + F.col("league_em"), F.col("oe") + F.col("league_oe"), F.col("de") + F.col("league_de")
    rest = (em - (oe - de)) / 2
    ranked = lambda c: F.row_number().over(Window.partitionBy("season").orderBy(F.desc(F.round(c, 6)), "team_id"))
    final = done.select("season", "team_id", em.alias("em"), (oe + rest).alias("oe"), (de - rest).alias("de"), "games", "wins", (F.col("games") - F.col("wins")).alias("losses"), "steps").withColumn("rank", ranked("em"))
    final = staged(final, "rating-final")
    faced = met.join(final.select("season", F.col("team_id").alias("opp_id"), F.col("em").alias("x"), F.col("rank").alias("place")), ["season", "opp_id"])
    tier = lambda ranks: F.size(F.filter(F.array(*map(F.lit, ranks)), lambda r: r < F.col("place")))
    faced = faced.withColumn("tier", F.when(F.col("home"), tier(TIERS_HOME)).otherwise(tier(TIERS_AWAY)))
    counts = [F.coalesce(F.sum(F.when(F.col("tier") == int(c[1]) - 1, F.col("won") if c[2] == "w" else F.col("n") - F.col("won"))), F.lit(0)).alias(c) for c in TIER_COUNTS]
    strength = faced.groupBy("season", "team_id").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("sos"), *counts)
    out = final.join(strength, ["season", "team_id"], "left").na.fill(0, ["sos", *TIER_COUNTS])
    return out.withColumn("sos_rank", ranked("sos")).select("season", "team_id", "em", "oe", "de", "games", "wins", "losses", "rank", "sos", "sos_rank", *TIER_COUNTS, "steps")


def spearman(ratings: DataFrame, outside: DataFrame, least: int = 10) -> DataFrame:
    """Rank correlation of em with outside ratings (team_id, season, srs) for each season with `least` pairs or more."""
    both = ratings.select("season", "team_id", "em").join(outside.select("season", "team_id", "srs").filter(F.col("srs").isNotNull()), ["season", "team_id"])
    rank = lambda c: F.row_number().over(Window.partitionBy("season").orderBy(F.desc(F.round(c, 6)), "team_id"))
    ranked = both.select("season", rank("em").alias("a"), rank("srs").alias("b"))
    d = (F.col("a") - F.col("b")).cast("double")
    n = F.col("n").cast("double")
    out = ranked.groupBy("season").agg(F.count("*").alias("n"), F.sum(d * d).alias("d2")).filter(F.col("n") >= least)
    return out.select("season", "n", (1 - 6 * F.col("d2") / (n * (n * n - 1))).alias("rho"))
