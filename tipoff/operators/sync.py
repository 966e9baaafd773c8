"""Incremental sync and data quality: snapshot deltas, repairs, merges, coverage, work lists, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tipoff.sources import store

#: Conferences whose members are majors.
MAJORS = ("ACC", "SEC", "Big Ten", "Big 12", "Big East", "Pac-12", "AAC", "WCC", "MWC", "American")


def deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Wins and losses gained by teams in both snapshots, where either rose. An empty old snapshot is a first run: a baseline, no deltas."""
    both = new.join(old.select("team_id", F.col("w").alias("w0"), F.col("l").alias("l0")), "team_id")
    gained = both.select("team_id", (F.col("w") - F.col("w0")).alias("dw"), (F.col("l") - F.col("l0")).alias("dl"))
    return gained.filter((F.col("dw") > 0) | (F.col("dl") > 0))


def repaired(games: DataFrame, flag: str = "w") -> DataFrame:
    """The first of repeated games (same team, date, opponent and points), with the flag set by the points where they differ."""
    first = F.row_number().over(Window.partitionBy("team_id", "game_date", "opp", "pts", "opp_pts").orderBy("order_key"))
    fixed = F.when(F.col("pts") > F.col("opp_pts"), True).when(F.col("pts") < F.col("opp_pts"), False).otherwise(F.col(flag))
    return games.withColumn("_first", first).filter(F.col("_first") == 1).drop("_first").withColumn("repaired", ~F.col(flag).eqNullSafe(fixed)).withColumn(flag, fixed)


def coverage(games: DataFrame, seasons: DataFrame) -> DataFrame:
    """Games found against the record book for each team, the gaps in wins and losses, the share of opponents that resolve, and a verdict."""
    found = games.groupBy("team_id").agg(F.count("*").alias("found"), F.count_if(F.col("pts") > F.col("opp_pts")).alias("won"), F.avg(F.col("opp_id").isNotNull().cast("double")).alias("resolved"), F.count_if((F.col("pts") > 200) | (F.col("opp_pts") > 200)).alias("bad_scores"))
    listed = seasons.groupBy("team_id").agg(F.sum("wins").alias("book_wins"), F.sum("losses").alias("book_losses"))
    all_ = listed.join(found, "team_id", "left").withColumn("found", F.coalesce("found", F.lit(0))).withColumn("won", F.coalesce("won", F.lit(0)))
    share = F.try_divide(F.col("found") * 100.0, F.col("book_wins") + F.col("book_losses"))
    band = F.when(share < 50, "LOW").when(share < 80, "PARTIAL").when(F.col("won") > F.col("book_wins") + 5, "CONFLICT").when(share.isNotNull(), "GOOD")
    return all_.select("team_id", "book_wins", "book_losses", "found", share.alias("share"), (F.col("book_wins") - F.col("won")).alias("win_gap"), (F.col("book_losses") - (F.col("found") - F.col("won"))).alias("loss_gap"), "resolved", "bad_scores", band.alias("band"))


def conference_coverage(teams: DataFrame, games: DataFrame) -> DataFrame:
    """Teams, teams with games, games and the share covered of each conference."""
    per_team = games.groupBy("team_id").agg(F.count("*").alias("games"))
    out = teams.join(per_team, "team_id", "left").groupBy("conf").agg(F.count("*").alias("teams"), F.count("games").alias("covered"), F.coalesce(F.sum("games"), F.lit(0)).alias("games"))
    return out.select("*", (F.col("covered") * 100.0 / F.col("teams")).alias("pct"))


def to_fetch(teams: DataFrame, done: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """Teams not yet done, best rank first; without a rank 999."""
    left = teams.join(done.select("team_id"), "team_id", "left_anti").join(ranks, "team_id", "left")
    return left.select("team_id", "name", F.coalesce("net_rank", F.lit(999)).alias("net_rank")).orderBy("net_rank", "team_id").limit(most)


def schedule_keys(teams: DataFrame, first: int, last: int, kinds: tuple[int, ...], done: DataFrame) -> DataFrame:
    """Every team, year and kind of schedule that is not done yet: each team's list of keys is a fixed range, not a join."""
    each = teams.select("team_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")).withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    return each.withColumn("key", F.format_string("%d_%d_%d", "team_id", "year", "kind")).join(done.select("key"), "key", "left_anti")


def filled(old: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Take new values only where the old one is 0 and the new one is over 0; `changed` tells whether any was."""
    got = new.select("team_id", *(F.col(c).alias(f"_{c}") for c in columns))
    take = {c: (F.col(c) == 0) & (F.coalesce(f"_{c}", F.lit(0)) > 0) for c in columns}
    changed = None
    for t in take.values():
        changed = t if changed is None else changed | t
    out = old.join(got, "team_id", "left").withColumn("_changed", changed)
    for c, t in take.items():
        out = out.withColumn(c, F.when(t, F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*old.columns, F.col("_changed").alias("changed"))


def needs_update(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows in which any of the columns is 0."""
    return rows.filter(" OR ".join(f"`{c}` = 0" for c in columns))


def overwritten(old: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """New values where there are any, with whether they differ from the old."""
    got = new.select("team_id", *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_got"))
    out = old.join(got, "team_id", "left")
    same = None
    for c in columns:
        equal = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = equal if same is None else same & equal
    return out.select("team_id", *(F.when(F.col("_got"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns), (F.coalesce("_got", F.lit(False)) & ~same).alias("changed"))


def with_overrides(rows: DataFrame, protected: DataFrame, column: str) -> DataFrame:
    """Protected values win whatever was read; the audit columns tell the value replaced and its source."""
    p = protected.select("team_id", F.col("value").alias("_value"), "source")
    out = rows.join(p, "team_id", "left")
    return out.select("team_id", F.coalesce("_value", column).alias(column), F.when(F.col("_value").isNotNull(), F.col(column)).alias("replaced"), "source")


def merged(existing: DataFrame, new: DataFrame, key: str = "team_id") -> DataFrame:
    """Rows of new keys are added, rows of keys that exist are left alone."""
    return existing.unionByName(new.join(existing.select(key).distinct(), key, "left_anti"))


def merge_into(root: str, new: DataFrame, key: str = "team_id") -> dict:
    """merged() into the snapshot at `root`, published only if as many rows of existing keys were written as there were before: both are
    counts of a whole side, no window over a key's rows."""
    before = store.snapshot(new.sparkSession, root, new.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    rows = before.withColumn("_old", F.lit(True)).unionByName(new.join(before.select(key).distinct(), key, "left_anti").withColumn("_old", F.lit(False)))

    def audit(seen: dict, last: dict | None) -> str | None:
        kept = 0 if last is None else last["observed"]["rows"]
        return None if seen["old"] == kept else f"{seen['old']} rows of existing keys, {kept} before"

    return store.publish(rows, root, audit, {"old": F.count_if("_old")}, drop=("_old",))


def synced(root: str, new: DataFrame) -> DataFrame:
    """Publishes new records (team_id, w, l) and gives the deltas against those before. The first run stores a baseline and has none. Records
    with fewer teams than before, a null or repeated team are not published."""
    spark, schema = new.sparkSession, "team_id bigint, w bigint, l bigint"
    before = store.manifest(spark, root)
    old = store.snapshot(spark, root, schema)

    def audit(seen: dict, last: dict | None) -> str | None:
        if seen["unnamed"] or seen["rows"] != new.select("team_id").distinct().count():
            return "teams are null or repeated"
        if last is not None and seen["rows"] < last["observed"]["rows"]:
            return f"{seen['rows']} teams, {last['observed']['rows']} before"
        return None

    now = store.publish(new.select(*(F.col(c).cast("long").alias(c) for c in ("team_id", "w", "l"))), root, audit, {"unnamed": F.count_if(F.col("team_id").isNull())})
    fresh = store.snapshot(spark, root, schema, now["number"])
    return deltas(old, fresh) if before is not None else deltas(fresh.limit(0), fresh)


def kept_last(rows: DataFrame, key: tuple[str, ...], order: Column) -> DataFrame:
    """The last row of each key: later files win."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))
    return rows.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def least_loaded(rows: DataFrame, part: str) -> DataFrame:
    """The part with the fewest rows."""
    return rows.groupBy(part).agg(F.count("*").alias("games"), F.count_distinct("team_id").alias("teams")).orderBy("games", part).limit(1)


def halves(rows: DataFrame, key: str) -> DataFrame:
    """Two parts of the keys at their exact middle, as numbers: a value for each different key meets in the one row of the aggregate."""
    middle = rows.select(key).distinct().agg(F.percentile(key, 0.5).alias("_middle"))
    return rows.crossJoin(F.broadcast(middle)).withColumn("part", F.when(F.col(key) <= F.col("_middle"), 1).otherwise(2)).drop("_middle")  # one row


def resolved_opponents(games: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """games (raw_opp, opp_slug): the opponent's id where it is a known team, else by its slug, else by an alias; `way` tells how."""
    ids = teams.select(F.col("team_id").alias("raw_opp"), F.lit(True).alias("_known"))
    slugs = teams.select(F.col("slug").alias("opp_slug"), F.col("team_id").alias("_by_slug"))
    others = aliases.select(F.col("alias").alias("opp_slug"), F.col("team_id").alias("_by_alias"))
    out = games.join(ids, "raw_opp", "left").join(slugs, "opp_slug", "left").join(others, "opp_slug", "left")
    by_id = F.when(F.col("_known"), F.col("raw_opp"))
    way = F.when(by_id.isNotNull(), "id").when(F.col("_by_slug").isNotNull(), "slug").when(F.col("_by_alias").isNotNull(), "alias").otherwise("none")
    return out.withColumn("found", F.coalesce(by_id, "_by_slug", "_by_alias")).withColumn("way", way).drop("_known", "_by_slug", "_by_alias")


def season_years(wanted: DataFrame, seasons: DataFrame, teams: DataFrame, first: int = 1950, last: int = 2026) -> DataFrame:
    """wanted (team_id, slug): the end years of the team's seasons from `first` on, by id, else by slug, else all years to `last`."""
    years = seasons.groupBy("team_id").agg(F.sort_array(F.collect_set(F.when(F.col("end_year") >= first, F.col("end_year")))).alias("years"))
    by_slug = teams.join(years, "team_id").select("slug", F.col("years").alias("slug_years"))
    out = wanted.join(years, "team_id", "left").join(by_slug, "slug", "left")
    some = lambda c: F.when(F.size(F.coalesce(c, F.array())) > 0, F.col(c))
    return out.select("team_id", "slug", F.coalesce(some("years"), some("slug_years"), F.sequence(F.lit(first), F.lit(last)).cast("array<long>")).alias("years"))


def clones(seasons: DataFrame, info: DataFrame) -> DataFrame:
    """team_id of teams that repeat another: the same first ten records, newest first, of three seasons or more (the one of most all-time
    wins stays), or last three conferences that are all major while the team's own is not."""
    newest = F.sort_array(F.collect_list(F.struct("start_year", "season", "wins", "losses", "season_conf")), asc=False)
    by = seasons.groupBy("team_id").agg(newest.alias("s")).filter(F.size("s") >= 3)
    prints = by.select("team_id", "s", F.array_join(F.transform(F.slice("s", 1, 10), lambda x: F.concat(x["season"], F.lit(":"), x["wins"].cast("string"), F.lit("-"), x["losses"].cast("string"))), "|").alias("print"))
    known = prints.join(info.select("team_id", "conf", "all_wins"), "team_id", "left")
    place = F.row_number().over(Window.partitionBy("print").orderBy(F.desc(F.coalesce("all_wins", F.lit(0))), "team_id"))
    recent = F.filter(F.transform(F.slice("s", 1, 3), lambda x: x["season_conf"]), lambda c: c.isNotNull())
    mismatch = (F.size(recent) > 0) & F.forall(recent, lambda c: c.isin(*MAJORS)) & ~F.col("conf").isin(*MAJORS)
    return known.withColumn("place", place).withColumn("reason", F.when(F.col("place") > 1, "same records").when(F.coalesce(mismatch, F.lit(False)), "conference")).filter(F.col("reason").isNotNull()).select("team_id", "reason")


def repeated_schools(seasons: DataFrame, listed: DataFrame) -> DataFrame:
    """team_id of schools that stand for another of the same number of seasons, newest and oldest season and newest coach; a listed one stays."""
    by = seasons.groupBy("team_id").agg(F.count("*").alias("n"), F.max("season").alias("newest"), F.min("season").alias("oldest"), F.max_by("coach", "season").alias("coach"))
    marked = by.join(listed.select("team_id", F.lit(0).alias("unlisted")), "team_id", "left")
    place = F.row_number().over(Window.partitionBy("n", "newest", F.coalesce("coach", F.lit("")), "oldest").orderBy(F.coalesce("unlisted", F.lit(1)), "team_id"))
    return marked.withColumn("place", place).filter(F.col("place") > 1).select("team_id")


def asymmetric(h2h: DataFrame) -> DataFrame:
    """Pairs whose two rows do not mirror each other."""
    other = h2h.select(F.col("opp").alias("team_id"), F.col("team_id").alias("opp"), F.col("w").alias("w2"), F.col("l").alias("l2"))
    return h2h.join(other, ["team_id", "opp"]).filter((F.col("w") != F.col("l2")) | (F.col("l") != F.col("w2")))


def head_to_head_summary(h2h: DataFrame) -> DataFrame:
    """Teams, pairings, and the team with the most opponents (the least id of equals)."""
    per = h2h.groupBy("team_id").agg(F.count("*").alias("opponents"))
    most = F.max_by("team_id", F.struct("opponents", -F.col("team_id")))
    return per.agg(F.count("*").alias("teams"), F.sum("opponents").alias("pairings"), F.max("opponents").alias("most"), most.alias("most_team"))


def season_summary(seasons: DataFrame) -> DataFrame:
    """Seasons in all, teams with any tournament and with any poll."""
    per = seasons.groupBy("team_id").agg(F.count("*").alias("n"), F.bool_or(F.col("tourney").isNotNull()).alias("t"), F.bool_or(F.col("ap_final").isNotNull() | F.col("ap_high").isNotNull()).alias("p"))
    return per.agg(F.sum("n").alias("seasons"), F.count_if("t").alias("with_tournament"), F.count_if("p").alias("with_poll"))


def slug_problems(rows: DataFrame) -> DataFrame:
    """Slugs that stand for several teams, and slugs of other characters than letters, digits and hyphens."""
    n = rows.groupBy("slug").agg(F.count("*").alias("n"))
    bad = ~F.coalesce(F.col("slug").rlike("^[A-Za-z0-9-]+$"), F.lit(False))
    return n.withColumn("problem", F.when(bad, "format").when(F.col("n") > 1, "repeated")).filter(F.col("problem").isNotNull())


def url_buckets(results: DataFrame) -> DataFrame:
    """results (status): how many succeeded, were not found, or failed."""
    bucket = F.when(F.col("status").between(200, 299), "success").when(F.col("status") == 404, "not_found").otherwise("error")
    return results.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def failures_in_a_row(events: DataFrame) -> DataFrame:
    """events (key, at, ok): failures since the key's last success, at each event."""
    order = Window.partitionBy("key").orderBy("at")
    island = F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("island", island).withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("key", "island").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def page_links(pages: DataFrame) -> DataFrame:
    """Title, number of links and first heading of raw pages, by patterns."""
    h = F.col("html")
    return pages.select("page_id", F.regexp_extract(h, r"(?is)<title[^>]*>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(h, F.lit(r'href="([^"]*)"'), 1)).alias("n_links"))


def rosters(teams: DataFrame, ids: DataFrame) -> DataFrame:
    """teams (team_id, name, conf) that the id map (team_id, source_slug) knows, numbered by name within their conference."""
    place = F.row_number().over(Window.partitionBy("conf").orderBy("name", "team_id"))
    return teams.join(ids, "team_id").select("conf", place.alias("place"), "team_id", "name", "source_slug")


def ids_of_slugs(wanted: DataFrame, ids: DataFrame) -> DataFrame:
    """wanted (slug) -> slug, team_id, by the id map; unknown slugs are skipped, a slug of several teams means the least id."""
    return wanted.select("slug").distinct().join(ids.groupBy(F.col("source_slug").alias("slug")).agg(F.min("team_id").alias("team_id")), "slug")


def source_slugs(teams: DataFrame, manual: DataFrame) -> DataFrame:
    """teams (team_id, slug) -> source_slug: that of the manual map (team_id, mapped), else the team's own."""
    return teams.join(manual.select("team_id", "mapped"), "team_id", "left").select("team_id", F.coalesce("mapped", "slug").alias("source_slug"))


def first_seen(rows: DataFrame, key: str, value: str, order: tuple[Column, ...]) -> DataFrame:
    """key, place, value: the distinct values of each key in the order in which they first come. Values are made distinct with their first
    place before the places are numbered, so a key's repeats never meet."""
    once = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first", value))
    return once.select(key, place.alias("place"), value)


def reachable(teams: DataFrame, games: DataFrame) -> DataFrame:
    """team_id, games, sample: whether a team's games can be read, and the first of them as json."""
    row = F.struct("game_date", "order_key", "opp", "pts", "opp_pts")
    found = games.groupBy("team_id").agg(F.count("*").alias("games"), F.min(row).alias("first"))
    return teams.select("team_id").join(found, "team_id", "left").select("team_id", F.coalesce("games", F.lit(0)).alias("games"), F.to_json("first").alias("sample"))
