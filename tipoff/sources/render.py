"""Domain views as the texts that sources deliver: html rows, pages, json documents, event streams. They feed the parsers' queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(name: str, text: Column, tag: str = "td") -> Column:
    return F.concat(F.lit(f'<{tag} class="x" data-stat="{name}">'), F.coalesce(text.cast("string"), F.lit("")), F.lit(f"</{tag}>"))


def schedule_rows(games: DataFrame, teams: DataFrame) -> DataFrame:
    """One html row for each game of a team, with rows of headers, games to come and games without a score between them."""
    opp = teams.select(F.col("team_id").alias("opp"), F.col("school").alias("opp_name"), F.col("slug").alias("opp_slug"))
    link = F.when(F.col("order_key") % 20 == 0, F.col("opp_name")).otherwise(F.concat(F.lit('<a href="/cbb/schools/'), F.col("opp_slug"), F.lit('/men/2024.html">'), F.col("opp_name"), F.lit("</a>")))
    day = F.concat(F.element_at(F.array(*map(F.lit, ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"))), F.dayofweek("game_date")), F.lit(", "), F.date_format("game_date", "MMM d, yyyy"))
    result = F.when(F.col("order_key") % 31 == 0, "").when(F.col("pts") > F.col("opp_pts"), "W").otherwise("L")
    overtime = F.when(F.abs(F.col("pts") - F.col("opp_pts")) <= 1, "OT").otherwise("")
    row = F.concat(
        F.when(F.col("order_key") % 41 == 0, '<tr class="thead">').otherwise("<tr>"), _cell("date_game", F.when(F.col("order_key") % 43 == 0, "to be announced").otherwise(day), "th"), _cell("opp_name", link),
        _cell("game_location", F.when(F.col("loc") == "A", "@").when(F.col("loc") == "N", "N").otherwise("")), _cell("game_result", result), _cell("pts", F.when(F.col("pts") > 0, F.col("pts"))), _cell("opp_pts", F.when(F.col("opp_pts") > 0, F.col("opp_pts"))), _cell("overtimes", overtime), F.lit("</tr>"),
    )
    return games.join(opp, "opp").select("team_id", "order_key", "opp", row.alias("row"))


def season_rows(seasons: DataFrame) -> DataFrame:
    """One html row of a school's season table."""
    number = lambda c: F.format_string("%.3f", c)
    coach = F.when(F.col("coach").isNotNull(), F.concat(F.col("coach"), F.lit(" ("), F.col("wins").cast("string"), F.lit("-"), F.col("losses").cast("string"), F.lit(")")))
    poll = lambda c: F.when(F.col(c) == 13, "x13").otherwise(F.col(c).cast("string"))  # noqa: E731  a footnote makes a rank unreadable
    cells = (
        ("season", F.when(F.col("place") % 29 == 0, "School").otherwise(F.col("season"))), ("wins", F.when(F.col("place") % 31 != 0, F.col("wins"))), ("losses", F.col("losses")), ("win_loss_pct", number("win_pct")), ("conf_abbr", F.col("conf")), ("wins_conf", F.col("conf_wins")), ("losses_conf", F.col("conf_losses")),
        ("win_loss_pct_conf", number("conf_pct")), ("srs", F.when(F.col("place") % 17 == 0, "n/a").otherwise(number("srs"))), ("rank_pre", poll("ap_pre")), ("rank_min", poll("ap_high")), ("rank_final", poll("ap_final")), ("round_max", F.col("tourney")), ("seed", F.col("seed")), ("coaches", coach),
    )
    present = lambda c: F.when(c.isNull() | (c.cast("string") == "null"), F.lit(None)).otherwise(c.cast("string"))
    return seasons.select("team_id", F.col("season").alias("of_season"), F.concat(F.lit("<tr>"), *(_cell(n, present(c)) for n, c in cells), F.lit("</tr>")).alias("row"))


def school_pages(info: DataFrame) -> DataFrame:
    """A school's main page: record in one of five wordings, league titles, polls, All-Americans, drafted players."""
    w, l, k = F.col("all_wins"), F.col("all_losses"), F.col("team_id") % 6
    record = (
        F.when(k == 0, F.format_string("<strong>Record (since 1949-50):</strong>\n  %d-%d .600 W-L%%", w, l)).when(k == 1, F.format_string("<strong>Record:</strong> %d-%d", w, l)).when(k == 2, F.format_string("<strong>Record (all games):</strong> %d-%d", w, l))
        .when(k == 3, F.format_string("<strong>Record, in all:</strong>\n %d-%d", w, l)).when(k == 4, F.format_string("overall record stands at %d-%d", w + 1000, l + 1000)).otherwise("no such line")
    )
    times = lambda n: F.concat(n.cast("string"), F.when(n == 1, " Time").otherwise(" Times"))
    titles = F.concat(F.lit("<p><strong>Conference Champion</strong>\n"), times(F.col("conf_titles")), F.lit(" (Reg. Seas.), "), times(F.col("titles")), F.lit(" (Tourn.)</p>"))
    polls = F.when(F.col("polled") > 0, F.concat(F.lit("<p>Ranked in AP Poll\n: "), F.col("polled").cast("string"), F.lit(" Weeks (Total)</p>"))).otherwise("")
    stars = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("final_fours"), F.lit(1))), lambda i: F.concat(F.lit('<th data-stat="ranker" csk="'), i.cast("string"), F.lit('">'))), "")
    drafted = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("appearances"), F.lit(1))), lambda i: F.concat(F.lit('<td class="r" data-stat="round">'), (i % 3).cast("string"), F.lit("</td>"))), "")
    return info.select("team_id", F.concat(record, titles, polls, stars, drafted).alias("html"))


def box_scores(lines: DataFrame, teams: DataFrame) -> DataFrame:
    """lines (game, team_id, n, a, b, c): a page for each game with a table for each of two teams, players as rows, in one of two header styles."""
    headers = lambda alt: "".join(f"<th>{h}</th>" for h in (("Player", "MIN", "3FG", "3FGA", "ORB", "DRB", "REB", "TO", "PTS") if alt else ("Starters", "MP", "3P", "3PA", "ORB", "DRB", "TRB", "TOV", "PTS")))
    td = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    minutes = F.when(F.col("n") % 2 == 0, F.format_string("%d:%02d", F.col("a") % 40, F.col("b") % 60)).otherwise((F.col("a") % 40).cast("string"))
    rebounds = F.when(F.col("n") % 3 == 0, F.lit("")).otherwise((F.col("b") % 15).cast("string"))
    cells = F.concat(td(minutes), td(F.col("a") % 9), td(F.col("a") % 9 + 3), td(F.col("b") % 4), td(F.col("b") % 7), td(rebounds), td(F.col("c") % 5), td(F.col("c") % 31))
    player = F.concat(F.lit('<tr><th scope="row"><a href="#">Player '), F.col("n").cast("string"), F.lit("</a></th>"), F.when(F.col("c") % 13 == 0, '<td colspan="8">Did Not Play</td>').otherwise(cells), F.lit("</tr>"))
    rows = lines.withColumn("row", player).groupBy("game", "team_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "row"))), lambda r: r["row"]), "\n").alias("rows"), F.sum(F.col("c") % 31).alias("points"))
    # few teams may have all games: pages are not dealt by team
    named = rows.join(F.broadcast(teams.select("team_id", "slug").join(lines.select("team_id").distinct(), "team_id", "left_semi")), "team_id")
    head = F.when(F.col("game") % 2 == 0, headers(True)).otherwise(headers(False))
    total = F.concat(F.lit("<tr><th>School Totals</th><td>200</td><td>0</td><td>0</td><td>2</td><td>5</td><td></td><td>9</td>"), td(F.col("points")), F.lit("</tr>"))
    table = F.concat(F.lit('<table class="sortable stats_table" id="box-score-basic-'), F.col("slug"), F.lit('"><thead><tr><th>Basic</th></tr><tr>'), head, F.lit('</tr></thead><tbody><tr class="thead"><th>Reserves</th></tr>'), F.col("rows"), total, F.lit("</tbody></table>"))
    return named.groupBy("game").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("team_id", table.alias("t")))), lambda x: x["t"]), "\n").alias("html"), F.max_by("slug", F.struct("points", "team_id")).alias("winner"), F.min_by("slug", F.struct("points", "team_id")).alias("loser"), F.max("points").alias("winner_score"), F.min("points").alias("loser_score"))


def schedule_documents(games: DataFrame) -> DataFrame:
    """A json schedule for each team and season with its games as events; scores are objects, texts or absent."""
    k = F.col("order_key")
    score = lambda c, alt: F.when(k % 3 == 0, F.format_string('{"value":%d.0}', c)).when(k % 3 == 1, F.format_string('"%d"', c)).otherwise(F.lit(alt))
    side = lambda t, c: F.concat(F.lit('{"team":{"id":"'), F.col(t).cast("string"), F.lit('"},"score":'), score(c, "null"), F.lit("}"))
    note = F.when(k % 7 == 0, '[{"headline":"NCAA Tournament - East"}]').when(k % 7 == 1, '[{"headline":"NIT - First Round"}]').when(k % 7 == 2, '[{"headline":"Big Conference Tournament"}]').otherwise("[]")
    sides = F.when(k % 11 == 0, side("team_id", "pts")).otherwise(F.concat(side("team_id", "pts"), F.lit(","), side("opp", "opp_pts")))
    event = F.concat(F.lit('{"id":"'), F.concat_ws("-", "order_key", F.least("team_id", "opp"), F.greatest("team_id", "opp"), F.least("pts", "opp_pts")), F.lit('","date":"'), F.date_format("game_date", "yyyy-MM-dd"), F.lit('T00:00Z","notes":'), note, F.lit(',"competitions":[{"competitors":['), sides, F.lit("]}]}"))
    kind = F.when(F.month("game_date").between(3, 4), 3).otherwise(2).alias("kind")
    docs = games.groupBy("team_id", "season", kind).agg(F.concat(F.lit('{"events":['), F.array_join(F.sort_array(F.collect_list(event)), ","), F.lit("]}")).alias("value"))
    return docs


def record_documents(snapshot: DataFrame) -> DataFrame:
    """snapshot (team_id, w, l) as json documents: the total among other items, or only a summary, or nothing."""
    k = F.col("team_id") % 4
    stats = F.format_string('"stats":[{"name":"losses","value":%d.0},{"name":"wins","value":%d.0}]', "l", "w")
    total = F.concat(F.lit('{"team":{"record":{"items":[{"type":"home","summary":"1-1"},{"type":"total",'), stats, F.lit("}]}}}"))
    other = F.concat(F.lit('{"team":{"record":{"items":[{"description":"Overall Record",'), stats, F.lit("}]}}}"))
    summary = F.format_string('{"team":{"record":{"items":[{"type":"any","summary":"%d-%d"}]}}}', "w", "l")
    return snapshot.select("team_id", F.when(k == 0, total).when(k == 1, summary).when(k == 2, other).otherwise('{"team":{}}').alias("value"))


def game_logs(games: DataFrame, teams: DataFrame) -> DataFrame:
    """A json document for each file: teams by id, some as a list of games, some as an object with games and slug."""
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))  # noqa: E731  days, digits and letters: nothing to escape
    fields = {"date": text(F.col("game_date").cast("date")), "opp": F.when(F.col("order_key") % 4 != 0, text(F.col("opp"))), "loc": text(F.col("loc")), "w": F.col("pts") > F.col("opp_pts"), "pts": F.col("pts"), "opp_pts": F.col("opp_pts")}
    # as to_json() has it, without nulls, in a fraction of its time
    game = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), c.cast("string")) for name, c in fields.items())), F.lit("}"))
    per = games.groupBy("team_id").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(game)), ","), F.lit("]")).alias("list")).join(teams.select("team_id", "slug"), "team_id")
    entry = F.concat(F.lit('"'), F.col("team_id").cast("string"), F.lit('":'), F.when(F.col("team_id") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"slug":"'), F.col("slug"), F.lit('","games":'), F.col("list"), F.lit("}"))))
    return per.select(F.col("team_id").alias("file"), F.concat(F.lit("{"), entry, F.lit("}")).alias("value"))


def event_lines(events: DataFrame) -> DataFrame:
    """events as the lines of a server-sent stream, with comments, blanks and a closing mark."""
    line = F.when(F.col("event_id") % 10 == 0, ": ping").when(F.col("event_id") % 10 == 1, "").when(F.col("event_id") % 10 == 2, "data: [DONE]").when(F.col("event_id") % 10 == 3, "data: {broken").otherwise(F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("delta").alias("type"), F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user")).alias("delta")))))
    return events.select("event_id", line.alias("value"))
