"""Rules that turn scraped html and json into typed rows, as built-in expressions over a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = r'<t[dh][^>]*data-stat="([^"]*)"[^>]*>(.*?)</t[dh]>'
#: Wordings of a school's record, the first that fits; the most general one ignores case.
RECORDS = (r"Record\s*\(since\s+\d{4}-\d{2,4}\):</strong>\s*(\d+)-(\d+)", r"Record:</strong>\s*(\d+)-(\d+)", r"Record[^<]*:</strong>\s*(\d+)-(\d+)", r"Record[^<]*:</strong>\s*\n\s*(\d+)-(\d+)", r"(?i)Record[^<]{0,60}?(\d{3,5})-(\d{3,5})")
#: Headers of box scores by the column they stand for.
HEADERS = {"MP": "min", "MIN": "min", "FG": "fg", "FGA": "fga", "3P": "tp", "3FG": "tp", "3PA": "tpa", "3FGA": "tpa", "FT": "ft", "FTA": "fta", "TRB": "reb", "REB": "reb", "ORB": "orb", "DRB": "drb", "AST": "ast", "STL": "stl", "BLK": "blk", "TOV": "to", "TO": "to", "PTS": "pts", "PF": "pf"}
TOTALS = ("team totals", "totals", "school totals", "total")
#: Schedule kinds, and leads that keep a regular game.
POSTSEASON, ONE_SIDED, CLOSE = 3, 15, 3

EVENTS = "struct<events:array<struct<id:string,date:string,notes:array<struct<headline:string>>,competitions:array<struct<competitors:array<struct<team:struct<id:string>,score:string>>>>>>>"
RECORD = "struct<team:struct<record:struct<items:array<struct<type:string,description:string,summary:string,stats:array<struct<name:string,value:double>>>>>>>"
GAME = "struct<date:string,opp:string,loc:string,w:boolean,pts:bigint,opp_pts:bigint>"


def _html(pattern: str) -> str:
    return f"(?s){pattern}"


def bare(html: Column) -> Column:
    """Text without tags and without space around it."""
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def cells(row: Column) -> Column:
    """Map of a table row's cells by their data-stat; the last of equal names."""
    names, texts = F.regexp_extract_all(row, F.lit(_html(CELL)), 1), F.regexp_extract_all(row, F.lit(_html(CELL)), 2)
    return F.map_from_entries(F.arrays_zip(names.alias("k"), F.transform(texts, bare).alias("v")))


def cell(row_cells: Column, name: str) -> Column:
    """A cell's text; null where it is absent or empty."""
    return F.nullif(F.element_at(row_cells, name), F.lit(""))


def whole(text: Column, otherwise: int | None = 0) -> Column:
    """A number, or `otherwise`."""
    n = text.try_cast("long")
    return n if otherwise is None else F.coalesce(n, F.lit(otherwise))


def digits(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def day_of(text: Column) -> Column:
    """'Mon, Nov 6, 2023' -> date; null for anything else."""
    return F.try_to_date(F.regexp_replace(text, "^[^,]*, (?=[A-Z])", ""), "MMM d, yyyy")


def opponent_slug(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"/cbb/schools/([^/]+)/", 1), F.lit(""))


def schedule(rows: DataFrame, today: str | None = None) -> DataFrame:
    """rows (team_id, row, and what goes along) -> games. Header rows, rows without a date, games to come, games without a result and
    games without points are left out."""
    c = F.col("cells")
    body = rows.filter(~F.col("row").rlike('^<tr class="(thead|over_header)')).withColumn("cells", cells(F.col("row")))
    out = body.select(
        *(x for x in rows.columns if x != "row"), day_of(cell(c, "date_game")).alias("game_date"), F.coalesce(opponent_slug(F.col("row")), cell(c, "opp_name")).alias("opp_slug"),
        F.when(cell(c, "game_location") == "@", "A").when(cell(c, "game_location") == "N", "N").otherwise("H").alias("loc"), cell(c, "game_result").startswith("W").alias("won"),
        whole(cell(c, "pts")).alias("pts"), whole(cell(c, "opp_pts")).alias("opp_pts"), cell(c, "overtimes").alias("ot"),
    )
    last = F.current_date() if today is None else F.lit(today).cast("date")
    return out.filter(F.col("game_date").isNotNull() & (F.col("game_date") <= last) & F.col("won").isNotNull() & ~((F.col("pts") == 0) & (F.col("opp_pts") == 0)))


def season_table(rows: DataFrame) -> DataFrame:
    """rows (row and what goes along) -> seasons. Rows without a year or a record are left out; what cannot be read is null."""
    c = F.col("cells")
    text = lambda n: cell(c, n)
    number = lambda n: text(n).try_cast("double")
    record = lambda w, l: F.when(text(w).isNotNull() & text(l).isNotNull(), F.concat_ws("-", text(w), text(l)))
    coach = F.trim(F.regexp_replace(text("coaches"), r"\(\d+-\d+\)", ""))
    out = rows.withColumn("cells", cells(F.col("row"))).select(
        *(x for x in rows.columns if x != "row"), text("season").alias("season"), whole(text("wins"), None).alias("wins"), whole(text("losses"), None).alias("losses"), record("wins", "losses").alias("record"), number("win_loss_pct").alias("win_pct"), text("conf_abbr").alias("conf"),
        record("wins_conf", "losses_conf").alias("conf_record"), number("srs").alias("srs"), digits(text("rank_pre")).alias("ap_pre"), digits(text("rank_min")).alias("ap_high"), digits(text("rank_final")).alias("ap_final"), text("round_max").alias("tourney"), digits(text("seed")).alias("seed"), coach.alias("coach"),
    )
    return out.filter(F.col("season").rlike(r"^\d{4}") & F.col("record").isNotNull())


def school_page(pages: DataFrame) -> DataFrame:
    """pages (team_id, html) -> record, league titles, polled weeks, All-Americans, first-round picks."""
    h = F.col("html")
    got = lambda p, g: F.nullif(F.regexp_extract(h, p, g), F.lit(""))
    one = lambda text, p: F.coalesce(F.regexp_extract(text, p, 1).try_cast("int"), F.lit(0))
    block = F.regexp_extract(h, _html(r"Conference Champion.*?</p>"), 0)
    titles = one(block, r"(\d+)\s+Times?\s*\(Reg\.\s*Seas\.\)") + one(block, r"(\d+)\s+Times?\s*\(Tourn\.\)")
    stars = F.array_max(F.transform(F.regexp_extract_all(h, F.lit(r'data-stat="ranker"\s+csk="(\d+)"'), 1), lambda x: x.cast("int")))
    rounds = F.regexp_extract_all(h, F.lit(r'<td[^>]*data-stat="round"[^>]*>(\d+)</td>'), 1)
    return pages.select(
        "team_id", *(F.coalesce(*(got(p, g) for p in RECORDS)).try_cast("long").alias(n) for g, n in ((1, "wins"), (2, "losses"))), titles.alias("conf_titles"), one(h, _html(r"Ranked in AP Poll.*?(\d+)\s+Weeks?\s*\(Total\)")).alias("ap_weeks"),
        F.coalesce(stars, F.lit(0)).alias("all_americans"), F.size(F.filter(rounds, lambda r: r == "1")).alias("first_round"),
    )


def minutes(text: Column) -> Column:
    """'31:40' -> 32, '31' -> 31, else 0."""
    parts = F.split(text, ":")
    clock = F.get(parts, F.lit(0)).try_cast("int") + F.when(F.get(parts, F.lit(1)).try_cast("int") >= 30, 1).otherwise(0)
    return F.coalesce(F.when(text.contains(":"), clock).otherwise(text.try_cast("int")), F.lit(0))


def box_tables(pages: DataFrame) -> DataFrame:
    """pages (game, html, winner, loser, winner_score, loser_score) -> a row for each team's table: slug, html, is_winner and score. A team is
    the winner if its name shares more words with the winner's than with the loser's. Pages of fewer than two tables give none."""
    open_id, by_class = r'<table[^>]*id="box-score-basic-([^"]*)"[^>]*>', r'<table[^>]*class="[^"]*stats_table[^"]*"[^>]*>(.*?)</table>'
    # what a pattern finds is a column that later steps read, or stands in an outer explode: a filter on it would search each page again
    found = pages.withColumn("found", F.regexp_extract_all("html", F.lit(_html(f"{open_id}.*?</table>")), 0))
    named = F.transform("found", lambda t: F.struct(F.regexp_extract(t, _html(f"^{open_id}"), 1).alias("slug"), F.regexp_extract(t, _html(f"^{open_id}(.*)</table>$"), 2).alias("body")))
    other = F.transform(F.slice(F.regexp_extract_all("html", F.lit(_html(by_class)), 1), 1, 2), lambda b, i: F.struct(F.concat(F.lit("team"), (i + 1).cast("string")).alias("slug"), b.alias("body")))
    tables = found.withColumn("tables", F.when(F.size("found") >= 2, named).otherwise(other))
    each = tables.select("game", "winner", "loser", "winner_score", "loser_score", F.posexplode_outer(F.when(F.size("tables") >= 2, F.col("tables"))).alias("place", "t")).filter("t IS NOT NULL")
    words = lambda c: F.split(F.replace(F.lower(c), F.lit("-"), F.lit(" ")), " ")
    shared = lambda c: F.size(F.array_intersect(words(F.col("t.slug")), words(F.col(c))))
    won = shared("winner") > shared("loser")
    return each.select("game", "place", F.col("t.slug").alias("slug"), F.col("t.body").alias("body"), won.alias("is_winner"), F.when(won, F.col("winner_score")).otherwise(F.col("loser_score")).alias("score"))


def box_rows(tables: DataFrame) -> DataFrame:
    """Each team's table -> its rows: player or totals, minutes, points, shots as made-attempted, rebounds (offensive and defensive where the
    total is 0), turnovers. Rows of headings and of players who did not play are left out."""
    head = F.regexp_extract("body", _html("<thead>(.*?)</thead>"), 1)
    last = F.element_at(F.regexp_extract_all(head, F.lit(_html("<tr[^>]*>(.*?)</tr>")), 1), -1)
    keys = F.transform(F.regexp_extract_all(last, F.lit(_html("<th[^>]*>(.*?)</th>")), 1), lambda h: F.upper(bare(h)))
    known = F.create_map(*(F.lit(x) for kv in HEADERS.items() for x in kv))
    columns = F.transform(keys, lambda k, i: F.coalesce(F.element_at(known, k), F.concat(F.lit("?"), i.cast("string"))))
    body = F.regexp_extract("body", _html("<tbody>(.*?)</tbody>"), 1)
    found = F.regexp_extract_all(body, F.lit(_html("(<tr[^>]*>.*?</tr>)")), 1)
    split = F.transform(found, lambda r: F.struct(r.alias("row"), F.transform(F.regexp_extract_all(r, F.lit(_html("<t[hd][^>]*>(.*?)</t[hd]>")), 1), bare).alias("cells")))
    each = tables.withColumn("columns", columns).withColumn("r", F.explode(split)).filter("r IS NOT NULL")
    row = F.col("r.row")
    each = each.filter(~row.contains('class="thead"') & ~row.rlike("Reserves|Starters") & ~F.lower(row).contains("did not play") & (F.size("r.cells") >= 3)).withColumn("cells", F.col("r.cells"))
    named = F.map_from_entries(F.filter(F.arrays_zip(F.col("columns").alias("k"), F.slice("cells", F.lit(1), F.size("columns")).alias("v")), lambda e: e["k"].isNotNull()))
    each = each.withColumn("m", named)
    n = lambda c: whole(F.element_at("m", c))
    pair = lambda a, b: F.concat_ws("-", n(a), n(b))
    rebounds = F.when((n("reb") == 0) & F.array_contains("columns", "orb") & F.array_contains("columns", "drb"), n("orb") + n("drb")).otherwise(n("reb"))
    name = F.col("cells")[0]
    return each.select("game", "slug", "is_winner", "score", name.alias("name"), F.lower(name).isin(*TOTALS).alias("is_total"), minutes(F.element_at("m", "min")).alias("min"), n("pts").alias("pts"), pair("fg", "fga").alias("fg"), pair("tp", "tpa").alias("tp"), pair("ft", "fta").alias("ft"), rebounds.alias("reb"), n("ast").alias("ast"), n("to").alias("turnovers"))


def box_scores(rows: DataFrame) -> DataFrame:
    """Rows of a game -> one row for each team, the winner first: players as a list, and the totals' points."""
    player = F.struct("name", "min", "pts", "tp", "reb", "turnovers")
    out = rows.groupBy("game", "slug", "is_winner", "score").agg(F.sort_array(F.collect_list(F.when(~F.col("is_total"), player))).alias("players"), F.max(F.when(F.col("is_total"), F.col("pts"))).alias("total"))
    return out.groupBy("game").agg(F.transform(F.sort_array(F.collect_list(F.struct((~F.col("is_winner")).alias("later"), "slug", "score", "players", "total"))), lambda t: t.dropFields("later")).alias("teams"))


def schedule_games(docs: DataFrame) -> DataFrame:
    """docs (kind, value: a json schedule) -> games: id, date, the two teams in the order of their ids as text, scores and type. Of regular games
    only one-sided and close ones stay. A game of several schedules is one row; the close type wins."""
    events = docs.select("kind", F.explode(F.from_json("value", EVENTS)["events"]).alias("e")).filter(F.col("e.id").isNotNull())
    points = lambda s: F.coalesce(F.get_json_object(s, "$.value").try_cast("double"), s.try_cast("double"), F.lit(0.0)).cast("long")
    sides = F.transform(F.get("e.competitions", F.lit(0))["competitors"], lambda c: F.struct(c["team"]["id"].alias("id"), points(c["score"]).alias("score")))
    note = F.lower(F.coalesce(F.get(F.col("e.notes"), F.lit(0))["headline"], F.lit("")))
    league = F.when(note.rlike("conference|tournament"), "conf_tourney").otherwise("postseason")
    kind = F.when(note.rlike("ncaa|march madness"), "ncaa").when(note.contains("nit"), "nit").when(F.col("kind") == POSTSEASON, league).otherwise("regular")
    rows = events.withColumn("sides", F.array_sort(sides)).filter(F.size("sides") >= 2)
    s = lambda k: F.get("sides", F.lit(k))
    rows = rows.select("kind", F.col("e.id").alias("id"), F.substring("e.date", 1, 10).alias("date"), s(0)["id"].alias("t1"), s(1)["id"].alias("t2"), s(0)["score"].alias("s1"), s(1)["score"].alias("s2"), kind.alias("type"))
    gap, regular = F.abs(F.col("s1") - F.col("s2")), F.col("kind") != POSTSEASON
    close = regular & (gap <= CLOSE) & (F.col("s1") > 0)
    kept = rows.filter(~regular | (gap >= ONE_SIDED) | close).withColumn("type", F.when(close, "close").otherwise(F.col("type")))
    return kept.groupBy("id").agg(F.min_by(F.struct("date", "t1", "t2", "s1", "s2", "type"), F.struct((F.col("type") != "close").alias("x"), "type", "date")).alias("g")).select("id", "g.*")


def current_records(docs: DataFrame) -> DataFrame:
    """docs (team_id, value: json) -> w, l of the item of type total or the overall record, else of the last item's summary; null without any."""
    items = F.coalesce(F.from_json("value", RECORD)["team"]["record"]["items"], F.array())
    total = F.get(F.filter(items, lambda i: (i["type"] == "total") | (i["description"] == "Overall Record")), F.lit(0))
    stat = lambda n: F.coalesce(F.element_at(F.map_from_entries(F.transform(total["stats"], lambda s: F.struct(s["name"], s["value"]))), n).cast("long"), F.when(total.isNotNull(), F.lit(0)))
    summary = F.split(F.get(items, F.size(items) - 1)["summary"], "-")
    part = lambda k: F.when(F.size(summary) >= 2, F.get(summary, F.lit(k)).try_cast("long"))
    return docs.select("team_id", F.coalesce(stat("wins"), part(0)).alias("w"), F.coalesce(stat("losses"), part(1)).alias("l")).filter(F.col("w").isNotNull())


def game_logs(files: DataFrame) -> DataFrame:
    """files (file, value: a json object of teams by id) -> games of all files. A file is one text here; logs_of() takes files of any size."""
    return logs_of(files.select("file", F.explode(F.from_json("value", "map<string,string>")).alias("key", "value")))


def logs_of(entries: DataFrame) -> DataFrame:
    """entries (file, key: team, value: json) -> their games. A team is a list of games or an object with such a list."""
    games = F.when(F.col("value").startswith("["), F.from_json("value", f"array<{GAME}>")).otherwise(F.from_json("value", f"struct<games:array<{GAME}>>")["games"])
    rows = entries.filter(F.col("key") != "_metadata").select("file", F.col("key").cast("long").alias("team_id"), F.explode(games).alias("g"))
    return rows.select("file", "team_id", F.col("g.date").cast("date").alias("game_date"), F.col("g.opp").cast("long").alias("opp"), F.col("g.loc").alias("loc"), F.col("g.w").alias("w"), F.col("g.pts").alias("pts"), F.col("g.opp_pts").alias("opp_pts"))


def stream_events(lines: DataFrame) -> DataFrame:
    """lines (value) of a server-sent stream -> the data lines that hold json; comments, blanks, the closing mark and broken lines go."""
    data = lines.filter(F.col("value").startswith("data: ")).withColumn("json", F.substring("value", 7, 1 << 30)).filter(F.col("json") != "[DONE]")
    parsed = F.from_json("json", "type string, delta struct<id:bigint,user:bigint>")
    return data.withColumn("e", parsed).filter(F.col("e.type").isNotNull()).select(F.col("e.type").alias("type"), F.col("e.delta.id").alias("id"), F.col("e.delta.user").alias("user_id"))
