"""Queries by interval, substring and first candidate, and over scores in time, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.functions import names
from tipoff.operators import matchup, search, sync, tables, trends
from tipoff.plans.sql import CTES
from tipoff.sources import files, render


def _stints(t) -> DataFrame:
    seasons = t.kept_seasons
    from tipoff.operators import coaches

    spans = coaches.tenures(seasons).select("team_id", (F.col("first_year") - 1).cast("long").alias("low"), F.col("last_year").cast("long").alias("high"), "last_year", "first_year", "coach")
    points = seasons.filter("coach IS NULL").select("team_id", F.col("start_year").alias("at"))
    return search.first_covering(points, spans, "team_id", ("last_year", "first_year"), "coach")


def _terms(t) -> DataFrame:
    """The last four characters of a school and the first three of its mascot."""
    return t.teams.select(F.lower(F.concat(F.right("school", F.lit(4)), F.lit(" "), F.substring("mascot", 1, 3))).alias("term"))


def _substrings(t) -> DataFrame:
    index = search.GramIndex(t.teams.select(F.col("team_id").alias("id"), F.lower("name").alias("text")))
    return index.holding(_terms(t)).select("term", F.col("id").alias("team_id"))


def _named(t) -> DataFrame:
    """Schools that stand in a text about two teams."""
    other = t.teams.select((F.col("team_id") - 1).alias("team_id"), F.col("name").alias("other"))
    texts = t.teams.join(other, "team_id").select(F.lower(F.concat(F.lit("The "), "name", F.lit(" met the "), "other", F.lit("."))).alias("term"))
    index = search.GramIndex(t.teams.select(F.col("team_id").alias("id"), F.lower("school").alias("text")))
    return index.held_by(texts).select("term", F.col("id").alias("team_id"))


def _found(t) -> DataFrame:
    """For each text the first stored matchup that holds it."""
    other = t.teams.select((F.col("team_id") - 1).alias("team_id"), F.col("name").alias("other"))
    stored = t.teams.join(other, "team_id").select(F.col("team_id").alias("id"), F.lower(F.concat((F.col("team_id") % 60 + 1960).cast("string"), F.lit(" "), "name", F.lit(" vs "), "other")).alias("text"))
    return search.GramIndex(stored).holding(_terms(t)).groupBy("term").agg(F.min("id").alias("matchup"))


def _addresses(t) -> DataFrame:
    """Each tournament upset's page, looked for on seven days under two names; pages may be missing, about others, or without names."""
    games = t.upsets.groupBy("team_id", "opp", "game_date").agg(F.min("order_key").alias("k"))
    name = lambda c, s: t.teams.select(F.col("team_id").alias(c), F.col("slug").alias(f"{s}_slug"), F.lower("school").alias(f"{s}_school"))
    keys = games.join(name("team_id", "a"), "team_id").join(name("opp", "b"), "opp").withColumn("key", F.concat_ws("-", "team_id", "opp", "game_date"))
    keys = keys.withColumn("first_day", F.date_sub("game_date", (F.col("k") % 4).cast("int")))
    own = F.concat_ws("-", F.col("game_date").cast("string"), F.when(F.col("k") % 3 != 0, F.col("a_slug")).otherwise(F.col("b_slug")))
    html = F.when(F.col("k") % 11 == 0, "nothing of use").when(F.col("k") % 5 == 0, '<table class="stats_table">').otherwise(F.concat("a_school", F.lit(" - "), "b_school"))
    pages = keys.filter("k % 7 <> 0").groupBy(own.alias("url")).agg(F.max(html).alias("html"))
    day = F.date_add("first_day", F.floor(F.col("place") / 2).cast("int")).cast("string")
    url = F.concat_ws("-", day, F.when(F.col("place") % 2 == 0, F.col("a_slug")).otherwise(F.col("b_slug")))
    strong = F.col("html").contains(F.col("a_school")) & F.col("html").contains(F.col("b_school"))
    hits, _ = search.first_hits(keys, "key", url, F.lit(14), pages, strong | F.col("html").contains("stats_table"))
    return hits.select("key", "place", "url", F.when(F.col("html").contains("stats_table"), "weak").otherwise("names").alias("way"))


def _located(t) -> DataFrame:
    """Season rows found in whole pages: behind a table of links, a table inside a cell and a comment, by id or by the name of a cell."""
    rows = render.season_rows(t.coached)
    page = rows.groupBy("team_id").agg(F.array_join(F.array_sort(F.collect_list("row")), "\n").alias("rows")).join(t.teams.select("team_id", "slug"), "team_id")
    own = F.when(F.col("team_id") % 2 == 0, F.concat(F.lit(' id="'), "slug", F.lit('"'))).otherwise("")
    html = F.concat(F.lit('<html><!-- <table id="'), "slug", F.lit('"><tr><td data-stat="season">hidden</td></tr></table> --><table><tr><td>Links<table><tr><td data-stat="other">1</table></table><table'), own, F.lit('><thead><tr><th data-stat="season">Season</th></thead><tbody>'), "rows", F.lit('</tbody><tfoot><tr><td data-stat="season">Overall</td></tr></table>'))
    found = tables.body_rows(tables.table_rows(page.select("team_id", html.alias("html"), "slug"), F.col("slug"), "season", key="team_id"), "team_id")
    cells = tables.by_stat(F.col("cells"))
    return found.select("team_id", cells["season"].alias("season"), cells["wins"].try_cast("long").alias("wins"), cells["losses"].try_cast("long").alias("losses"))


def _tags(t) -> DataFrame:
    """Tags of compared neighbours, of champions (a third of their slugs unknown) and of upsets."""
    teams = t.teams.select("team_id", "name", "slug")
    other = teams.select((F.col("team_id") - 1).alias("team_id"), F.col("name").alias("name_b"))
    pairs = teams.join(other, "team_id", "left").select(F.concat(F.lit("c"), F.col("team_id").cast("string")).alias("key"), F.col("name").alias("name_a"), "name_b")
    won = t.seasons.filter("contains(tourney, 'Won NCAA Tournament National Final')").select("team_id", "end_year").join(teams, "team_id")
    titles = won.select(F.concat_ws("-", F.lit("t"), "team_id", "end_year").alias("key"), F.col("end_year").alias("year"), "slug", F.when(F.col("end_year") % 3 != 0, F.col("name")).alias("name"))
    loser = teams.select(F.col("team_id").alias("opp"), F.col("name").alias("loser"), F.col("slug").alias("loser_slug"))
    games = t.upsets.filter("upset").join(teams, "team_id").join(loser, "opp")
    path = F.concat(F.year("game_date").cast("string"), F.when(F.col("order_key") % 5 == 0, "-").otherwise("/"), F.col("slug"), F.lit("-vs-"), F.col("loser_slug"))
    upsets = games.select(F.concat_ws("-", F.lit("g"), "order_key", "team_id", "opp", "pts", "opp_pts").alias("key"), path.alias("path"), F.when(F.col("order_key") % 2 == 0, F.col("name")).alias("winner"), "loser")
    return files.comparison_tags(pairs, "Site").unionByName(files.champion_tags(titles, "Site")).unionByName(files.game_tags(upsets, "Site"))


_TITLED = lambda x: f"array_to_string([upper(x[1]) || x[2:] FOR x IN string_split({x}, '-')], ' ')"
_TAGS = f"""SELECT 'c' || a.team_id AS key, 'website' AS type, a.name || ' vs ' || b.name || ' — Site' AS title, 'Head-to-head comparison on Site' AS description FROM v_teams a JOIN v_teams b ON b.team_id = a.team_id + 1
UNION ALL SELECT 't-' || team_id || '-' || end_year, 'article', who || ' — ' || end_year || ' National Champions | Site', 'Relive ' || who || chr(39) || 's ' || end_year || ' championship run. Full tournament path, box scores, highlights, and the story of how they cut down the nets.'
  FROM (SELECT s.team_id, end_year, CASE WHEN end_year % 3 <> 0 THEN t.name ELSE {_TITLED('t.slug')} END AS who FROM v_seasons s JOIN v_teams t USING (team_id) WHERE contains(tourney, 'Won NCAA Tournament National Final'))
UNION ALL SELECT 'g-' || order_key || '-' || team_id || '-' || opp || '-' || pts || '-' || opp_pts, 'article', won || ' Upsets ' || lost || ' — ' || y || ' NCAA Tournament | Site', 'Relive the Moment: ' || won || ' defeats ' || lost || ' in the ' || y || ' NCAA Tournament. Box score, highlights, and why this upset mattered.'
  FROM (SELECT u.*, year(game_date) AS y, CASE WHEN order_key % 2 = 0 THEN a.name ELSE {_TITLED('a.slug')} END AS won, b.name AS lost FROM upsets u JOIN v_teams a USING (team_id) JOIN v_teams b ON b.team_id = u.opp WHERE upset AND order_key % 5 <> 0)"""
_MAP = "SELECT team_id, CASE WHEN team_id % 4 = 0 THEN 'own-' || team_id ELSE slug END AS source_slug FROM v_teams"


def _map(t) -> DataFrame:
    manual = t.teams.filter("team_id % 4 = 0").select("team_id", F.concat(F.lit("own-"), F.col("team_id").cast("string")).alias("mapped"))
    return sync.source_slugs(t.teams, manual)


CTES["pagekeys"] = """SELECT *, team_id || '-' || opp || '-' || game_date AS key FROM (SELECT team_id, opp, game_date, min(order_key) AS k FROM upsets GROUP BY ALL)
  JOIN (SELECT team_id, slug AS a_slug, lower(school) AS a_school FROM v_teams) USING (team_id) JOIN (SELECT team_id AS opp, slug AS b_slug, lower(school) AS b_school FROM v_teams) USING (opp)"""
CTES["pagetable"] = """SELECT url, max(html) AS html FROM (SELECT game_date || '-' || CASE WHEN k % 3 <> 0 THEN a_slug ELSE b_slug END AS url, CASE WHEN k % 11 = 0 THEN 'nothing of use' WHEN k % 5 = 0 THEN '<table class="stats_table">' ELSE a_school || ' - ' || b_school END AS html FROM pagekeys WHERE k % 7 <> 0) GROUP BY url"""
CTES["roundx"] = "SELECT (score - 50) / 15::DOUBLE AS x, score, CASE WHEN coalesce(regexp_matches(tourney, 'Regional|National'), false) THEN 1::DOUBLE ELSE 0 END AS y FROM scored WHERE wins + losses >= 10 AND end_year >= 1985"
CTES["roundfit"] = """SELECT 0 AS step, 0::DOUBLE AS b0, 0::DOUBLE AS b1
UNION ALL SELECT step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
  SELECT step, b0, b1, sum(y - p) - b0 AS g0, sum((y - p) * x) - b1 AS g1, sum(p * (1 - p)) + 1 AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 1 AS h11
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM roundfit, roundx WHERE step < 8) GROUP BY step, b0, b1)"""
CTES["yearly"] = "SELECT team_id, CAST(end_year AS BIGINT) AS end_year, score FROM scored WHERE wins + losses >= 10"
CTES["slopes"] = " UNION ALL ".join(f"SELECT {s} AS span, team_id, round(slope, 6) AS slope, n AS seasons FROM (SELECT *, regr_slope(score, end_year) OVER w AS slope, count(*) OVER w AS n, max(end_year) OVER (PARTITION BY team_id) AS latest FROM yearly WINDOW w AS (PARTITION BY team_id ORDER BY end_year RANGE BETWEEN {s - 1} PRECEDING AND CURRENT ROW)) WHERE end_year = latest AND n >= 3" for s in (5, 10, 20))
# the weights of the score, written out
_WEIGHTS = {"efficiency": 0.30, "sos_part": 0.12, "tournament": 0.18, "quality": 0.10, "perception": 0.10, "close_game": 0.05, "coaching": 0.05, "draft": 0.05, "era_difficulty": 0.05}


def _raw(changed: str = "", by: float = 0.0) -> str:
    w = {k: v * (1 + by) if k == changed else v for k, v in _WEIGHTS.items()}
    return f"round(({' + '.join(f'coalesce({k}, 0) * {v!r}::DOUBLE' for k, v in w.items())}) / ({' + '.join(f'CASE WHEN {k} IS NOT NULL THEN {v!r}::DOUBLE ELSE 0 END' for k, v in w.items())}), 9)"


CTES["firstgood"] = f"SELECT *, {_raw()} AS base FROM scored WHERE wins + losses >= 10 ORDER BY base DESC, season, team_id LIMIT 100"
CTES["reweighed"] = " UNION ALL ".join(f"SELECT '{k}' AS component, {c} AS change, base, {_raw(k, c)} AS value FROM firstgood" for k in _WEIGHTS for c in (0.05, -0.05))


def _short(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, ' ({names.MASCOTS})$') THEN regexp_replace({x}, ' ({names.MASCOTS})$', '') ELSE split_part({x}, ' ', 1) END"


def _strong(side: str) -> str:
    return f"""[CASE x.name WHEN 'Coaching' THEN coalesce(CASE WHEN {side} = 'A' THEN coach_a ELSE coach_b END, 'coaching') || ' pedigree'
  WHEN 'Offense' THEN 'elite offense' WHEN 'Defense' THEN 'suffocating defense' WHEN 'Pace' THEN 'pace advantage' WHEN 'Talent' THEN 'NBA-caliber talent' WHEN 'Clutch' THEN 'close-game toughness' END FOR x IN f IF x.side = {side} AND x.name <> 'HTSS']"""


def _listed(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN 'overall balance' WHEN len({x}) <= 2 THEN array_to_string({x}, ' and ') ELSE array_to_string({x}[1:len({x}) - 1], ', ') || ', and ' || {x}[len({x})] END"


def _one(x: str, one: str, more: str) -> str:
    return f"CASE WHEN len({x}) = 1 THEN '{one}' ELSE '{more}' END"


CTES["faced"] = f"SELECT *, CASE WHEN winner = 'A' THEN 'B' ELSE 'A' END AS loser, spring_a || ' ' || {_short('name_a')} AS who_a, spring_b || ' ' || {_short('name_b')} AS who_b, CASE WHEN winner = 'A' THEN {_short('name_a')} ELSE {_short('name_b')} END AS ws FROM weighed"
CTES["told"] = f"SELECT *, CASE WHEN winner = 'A' THEN who_a ELSE who_b END AS w, CASE WHEN loser = 'A' THEN who_a ELSE who_b END AS l, {_strong('winner')} AS wp, {_strong('loser')} AS lp FROM faced"
CTES["spoken"] = f"SELECT *, {_listed('wp')} AS wl, {_listed('lp')} AS ll FROM told"
_STORY = f"""SELECT matchup, CASE
  WHEN lead >= 10 THEN w || '''s ' || wl || ' would overwhelm ' || l || ' in a convincing victory. ' || CASE WHEN len(lp) > 0 THEN l || '''s ' || ll || {_one('lp', " isn''t", " aren''t")} || ' enough to overcome the gap in overall quality.' ELSE 'The talent and efficiency gap is simply too wide to overcome.' END
  WHEN lead >= 5 THEN w || '''s ' || wl || {_one('wp', ' gives', ' give')} || ' them the edge in a competitive but ultimately decisive game. ' || CASE WHEN len(lp) > 0 THEN l || '''s ' || ll || {_one('lp', ' keeps', ' keep')} || ' it interesting, but ' || ws || ' pulls away down the stretch.' ELSE l || ' battles hard but can''t match ' || ws || '''s firepower.' END
  ELSE 'This one goes down to the wire — ' || w || ' barely edges ' || l || ' in an instant classic. ' || CASE WHEN len(lp) > 0 THEN l || '''s ' || ll || ' nearly ' || {_one('lp', 'steals', 'steal')} || ' the game, but ' || ws || '''s ' || wl || {_one('wp', ' proves', ' prove')} || ' decisive in the final minutes.' ELSE 'Both teams trade blows, but ' || ws || ' makes one more play when it matters most.' END END AS story FROM spoken"""


def register(add) -> None:
    add("matchup_story", lambda t: matchup.narrated(t.kept_factors).select("matchup", "story"), _STORY)
    add("season_stints", _stints, "SELECT team_id, start_year AS at, stint AS coach FROM stints")
    add("substring_lookups", _substrings, "SELECT DISTINCT term, t.team_id FROM (SELECT lower(right(school, 4) || ' ' || left(mascot, 3)) AS term FROM v_teams) a JOIN v_teams t ON contains(lower(t.name), term)")
    add("names_in_texts", _named, "SELECT DISTINCT term, t.team_id FROM (SELECT lower('The ' || a.name || ' met the ' || b.name || '.') AS term FROM v_teams a JOIN v_teams b ON b.team_id = a.team_id + 1) x JOIN v_teams t ON contains(term, lower(t.school))")
    add("found_matchups", _found, "SELECT term, min(m.team_id) AS matchup FROM (SELECT lower(right(school, 4) || ' ' || left(mascot, 3)) AS term FROM v_teams) x JOIN (SELECT a.team_id, lower((a.team_id % 60 + 1960) || ' ' || a.name || ' vs ' || b.name) AS text FROM v_teams a JOIN v_teams b ON b.team_id = a.team_id + 1) m ON contains(text, term) GROUP BY term")
    add("alternate_addresses", _addresses, """SELECT key, place, url, CASE WHEN contains(html, 'stats_table') THEN 'weak' ELSE 'names' END AS way FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place) AS turn FROM (
  SELECT key, place, a_school, b_school, CAST(game_date - CAST(k % 4 AS INT) + CAST(place // 2 AS INT) AS VARCHAR) || '-' || CASE WHEN place % 2 = 0 THEN a_slug ELSE b_slug END AS url FROM pagekeys, range(14) r(place)) JOIN pagetable USING (url)
  WHERE contains(html, a_school) AND contains(html, b_school) OR contains(html, 'stats_table')) WHERE turn = 1""")
    add("trajectories", lambda t: trends.trajectories(t.scored), "SELECT * FROM (SELECT span, 'riser' AS direction, row_number() OVER (PARTITION BY span ORDER BY slope DESC, team_id) AS place, team_id, slope, seasons FROM slopes UNION ALL SELECT span, 'faller', row_number() OVER (PARTITION BY span ORDER BY slope, team_id), team_id, slope, seasons FROM slopes) WHERE place <= 15", "slope")
    add("round_model", lambda t: trends.round_model(t.scored), "SELECT b0, b1, n, base, top FROM roundfit, (SELECT count(*) AS n, avg(y) AS base FROM roundx), (SELECT avg(y) AS top FROM roundx WHERE score >= (SELECT quantile_cont(score, 0.75) FROM roundx)) WHERE step = 8", "b0 b1 base top")
    add("weight_sensitivity", lambda t: trends.sensitivity(t.scored), "SELECT a.component, CAST(a.change AS DOUBLE) AS change, count(*) FILTER (a.value < b.value) AS moved, count(*) AS pairs FROM reweighed a JOIN reweighed b ON a.component = b.component AND a.change = b.change AND a.base > b.base GROUP BY ALL")
    add("located_tables", _located, "SELECT team_id, CASE WHEN place % 29 = 0 THEN 'School' ELSE season END AS season, CASE WHEN place % 31 <> 0 THEN wins END AS wins, losses FROM coached")
    add("page_tags", _tags, _TAGS)
    add("source_slugs", _map, _MAP)
    add("conference_rosters", lambda t: sync.rosters(t.teams, _map(t).filter("team_id % 5 <> 0")), f"SELECT conf, row_number() OVER (PARTITION BY conf ORDER BY name, team_id) AS place, team_id, name, source_slug FROM v_teams JOIN ({_MAP}) USING (team_id) WHERE team_id % 5 <> 0")
    add("ids_of_slugs", lambda t: sync.ids_of_slugs(t.teams.select("slug").unionByName(_map(t).select(F.col("source_slug").alias("slug"))), _map(t)), f"SELECT source_slug AS slug, team_id FROM ({_MAP})")
    add("coaches_in_order", lambda t: sync.first_seen(t.coached, "team_id", "coach", (-F.col("start_year"),)), "SELECT team_id, row_number() OVER (PARTITION BY team_id ORDER BY newest DESC, coach) AS place, coach FROM (SELECT team_id, coach, max(start_year) AS newest FROM coached WHERE coach IS NOT NULL GROUP BY ALL)")
    add("reachable_teams", lambda t: sync.reachable(t.teams, t.games.filter("team_id % 6 <> 1")), """SELECT team_id, coalesce(n, 0) AS games, CASE WHEN n > 0 THEN '{"game_date":"' || g.game_date || '","order_key":' || g.order_key || ',"opp":' || g.opp || ',"pts":' || g.pts || ',"opp_pts":' || g.opp_pts || '}' END AS sample
  FROM v_teams LEFT JOIN (SELECT team_id, count(*) AS n, first({'game_date': game_date, 'order_key': order_key, 'opp': opp, 'pts': pts, 'opp_pts': opp_pts} ORDER BY game_date, order_key, opp, pts, opp_pts) AS g FROM v_games WHERE team_id % 6 <> 1 GROUP BY team_id) USING (team_id)""")
