"""Queries over what is stored: large json objects, published snapshots, streams, and ratings by tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.operators import ingest, ratings, sync
from tipoff.sources import files, keyed, render, store
from tipoff.sources.staged import shared_path, staged
from tipoff.streaming import paged

#: Order lines of a json object: about 160 MB of games, more than a split.
ORDER_LINES = 1_000_000


def _stored_logs(t) -> DataFrame:
    """Games written as json objects with metadata, three at least and one for each million order lines, and read from them in splits."""
    entry = F.regexp_extract("value", r'(?s)^\{"\d+":(.*)\}$', 1)
    rows = render.game_logs(t.games, t.teams).select(F.col("file").cast("string").alias("key"), entry.alias("value"))
    path = shared_path(t.spark, "game-logs")
    keyed.write_entries(rows, path, files.with_metadata(t.games, "game_date"), parts=max(3, t.read("lineitem").count() // ORDER_LINES))
    return ingest.logs_of(keyed.entries(t.spark, [path]))


def _synced(t) -> DataFrame:
    """A first run that stores a baseline, then a run with deltas against it."""
    root = shared_path(t.spark, "records")
    old, new = t.snapshots
    first = sync.synced(root, old).select(F.lit(1).alias("run"), "team_id", "dw", "dl")
    baseline = store.snapshot(t.spark, root, "").agg(F.count("*").alias("dw"), F.sum("w").alias("dl")).select(F.lit(0).alias("run"), F.lit(-1).alias("team_id"), "dw", "dl")
    second = sync.synced(root, new).select(F.lit(2).alias("run"), "team_id", "dw", "dl")
    return first.unionByName(baseline).unionByName(second)


def _published(t) -> DataFrame:
    """Two merges into a snapshot, and a loss of rows that its audit rejects."""
    root = shared_path(t.spark, "games")
    sync.merge_into(root, t.games.filter("team_id % 3 = 0"))
    sync.merge_into(root, t.games.filter("team_id % 2 = 0"))
    try:
        store.publish(t.games.filter("team_id = 6"), root, lambda seen, last: "fewer rows than before" if seen["rows"] < last["observed"]["rows"] else None)
    except store.Rejected:
        pass
    return store.snapshot(t.spark, root, "").groupBy("team_id").agg(F.count("*").alias("n"))


def _grown(t) -> DataFrame:
    """Seasons landed in four waves, of 6, 7, most and 5: the first waits for the second, the last stays waiting."""
    root, landing = shared_path(t.spark, "grown"), shared_path(t.spark, "landing")
    per = t.games.groupBy("season").agg(F.count("*").alias("games"))
    place = F.row_number().over(Window.orderBy("season"))  # a row for each season
    numbered = staged(per.withColumn("place", place).withColumn("n", F.count("*").over(Window.partitionBy())), "grown-seasons")
    body = F.to_json(F.struct("season", "games"))
    n, k = F.col("n"), F.col("place")
    for wave in (k <= 6, (k > 6) & (k <= 13), (k > 13) & (k <= n - 5), k > n - 5):
        paged.land(numbered.filter(wave).select(F.format_string("%06d.json", "place").alias("name"), F.col("season").alias("id"), F.lit(1).alias("attempt"), F.when(k % 9 == 4, 404).otherwise(200).alias("status"), body.alias("body")), landing)
        done = paged.outcomes(paged.documents(t.spark, landing)).filter("outcome IN ('done', 'gone')")
        paged.growing(done, root, "id").trigger(availableNow=True).start().awaitTermination()
    games = F.from_json("body", "season string, games bigint")
    return store.snapshot(t.spark, root, "").select("id", "outcome", games["games"].alias("games"))


def register(add) -> None:
    tiers = ", ".join(ratings.TIER_COUNTS)
    add("stored_game_logs", lambda t: _stored_logs(t).groupBy("team_id").agg(F.count("*").alias("n"), F.count("opp").alias("opps"), F.count_if("w").alias("won"), F.sum("pts").alias("pts"), F.min("game_date").alias("first")), "SELECT team_id, count(*) AS n, count(*) FILTER (order_key % 4 <> 0) AS opps, count(*) FILTER (pts > opp_pts) AS won, CAST(sum(pts) AS BIGINT) AS pts, min(game_date) AS first FROM v_games GROUP BY 1")
    add("ratings_by_tables", lambda t: ratings.season_ratings_by_tables(t.rated), f"SELECT season, team_id, em, oe, de, games, wins, losses, rank, sos, sos_rank, {tiers}, steps FROM ratings", "em oe de sos")
    add("synced_records", _synced, "SELECT 2::BIGINT AS run, team_id, dw, dl FROM gains UNION ALL SELECT 0, -1, count(*), CAST(sum(w0) AS BIGINT) FROM snap WHERE before > 0")
    add("published_games", _published, "SELECT team_id, count(*) AS n FROM v_games WHERE team_id % 3 = 0 OR team_id % 2 = 0 GROUP BY 1")
    add("grown_seasons", _grown, "SELECT season AS id, CASE WHEN place % 9 = 4 THEN 'gone' ELSE 'done' END AS outcome, CASE WHEN place % 9 <> 4 THEN games END AS games FROM (SELECT season, count(*) AS games, row_number() OVER (ORDER BY season) AS place, count(*) OVER () AS n FROM v_games GROUP BY season) WHERE place <= n - 5")
