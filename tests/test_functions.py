import datetime as dt

from pyspark.sql import functions as F

from tipoff.functions import names
from tipoff.functions import seasons as S
from tipoff.operators import ingest, matchup, ratings, sync


def test_season_rules(spark):
    rows = spark.createDataFrame([(dt.date(1999, 11, 2),), (dt.date(2000, 5, 31),), (dt.date(2000, 7, 1),), (None,)], "d date")
    out = rows.select(S.season_key(S.start_year(F.col("d"))).alias("a"), S.start_year(F.col("d"), 10).alias("b")).collect()
    assert [r.a for r in out] == ["1999-00", "1999-00", "2000-01", None]
    assert [r.b for r in out] == [1999, 1999, 1999, None]


def test_half_rounds_up(spark):
    out = spark.range(1).select(S.round_up(F.lit(-2.5), 0).alias("a"), S.round_up(F.lit(2.345), 1).alias("b")).first()
    assert (out.a, out.b) == (-2.0, 2.3)


def test_tournament_results_in_order(spark):
    texts = ["Won NCAA Tournament National Final*", "Lost NCAA Tournament Regional Final (Final Four)", "Lost NCAA Tournament Regional Final", "odd", None, ""]
    out = [tuple(r.r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.tournament_result(F.col("t")).alias("r")).collect()]
    assert out == [("champion", 15.0), ("final_four", 5.0), ("elite_eight", 3.0), ("unknown_tourney", 0.0), ("none", -2.0), ("none", -2.0)]


def test_win_probability_of_known_matchups(spark):
    known = [(136.08, 88.92, 123.45, 84.55, 73, 65, 78.01), (129.42, 90.58, 123.36, 88.64, 73, 67, 65.5), (122.31, 92.69, 125.16, 84.84, 70, 67, 16.4), (123.57, 88.43, 122.52, 87.48, 67, 65, 50.37), (133.3, 91.7, 123.65, 88.35, 73, 67, 72.71), (130.98, 89.02, 129.42, 90.58, 73, 73, 62.39), (124.52, 87.48, 119.57, 100.43, 67, 73, 94.18), (125.01, 94.99, 121.97, 90.03, 73, 67, 42.59), (127.8, 87.2, 123.36, 88.64, 70, 67, 70.99), (124.5, 87.5, 126.59, 88.41, 67, 70, 45.52)]
    rows = spark.createDataFrame(known, "a double, b double, c double, d double, e int, f int, p double")
    out = rows.select((S.win_probability(*(F.col(c) for c in "abcdef")) * 100).alias("q"), "p").collect()
    assert all(abs(r.q - r.p) < 0.006 for r in out)


def test_adjusted_ratings_balance(spark):
    rows = [("s", a, b, "N", m > 0, float(m), 100.0 + m, 100.0) for a, b, m in ((1, 2, 10), (2, 1, -10), (2, 3, 5), (3, 2, -5))]
    games = spark.createDataFrame(rows, "season string, team_id long, opp_id long, loc string, won boolean, margin double, off double, def double")
    out = ratings.season_ratings(games).orderBy("rank").collect()
    assert [r.team_id for r in out] == [1, 2, 3]
    assert all(abs(r.oe - r.de - r.em) < 1e-9 for r in out)
    assert [(r.wins, r.losses, r.t1w, r.t1l) for r in out] == [(1, 0, 1, 0), (1, 1, 1, 1), (0, 1, 0, 1)]


def test_deltas_keep_any_rise(spark):
    old = spark.createDataFrame([(1, 5, 5), (2, 5, 5), (3, 1, 1), (5, 5, 5)], "team_id long, w long, l long")
    new = spark.createDataFrame([(1, 6, 5), (2, 4, 6), (3, 1, 1), (4, 1, 0), (5, 4, 5)], "team_id long, w long, l long")
    assert sorted(tuple(r) for r in sync.deltas(old, new).collect()) == [(1, 1, 0), (2, -1, 1)]


def test_texts_of_matchups(spark):
    texts = ["1972 UCLA", "Duke 1999-00", "2014-2015 Kentucky", "  North Carolina   1957 ", "Gonzaga", "1999-00"]
    out = [tuple(r.p) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(matchup.parsed(F.col("t")).alias("p")).collect()]
    assert out == [("1971-72", 1972, "UCLA", None), ("1999-00", 2000, "Duke", None), ("2014-15", 2015, "Kentucky", None), ("1956-57", 1957, "North Carolina", None), (None, None, "Gonzaga", "no year"), ("1999-00", 2000, "", None)]


def test_teams_resolve_in_order(spark):
    teams = spark.createDataFrame([(1, "Duke", "Duke Blue Devils", "duke"), (2, "North Carolina", "North Carolina Tar Heels", "north-carolina"), (3, "North Carolina State", "North Carolina State Wolfpack", "nc-state"), (4, "Ohio", "Ohio Bobcats", "ohio"), (5, "Ohio State", "Ohio State Buckeyes", "ohio-state")], "team_id long, school string, name string, slug string")
    short = spark.createDataFrame([("unc", "North Carolina")], "abbr string, meant string")
    asked = ["Duke", "UNC", "Carolina", "ohio state university", "nc state", "Ohio State Buckeyes", "nowhere", "io"]
    got = {r["query"]: r.team_id for r in matchup.resolved(spark.createDataFrame([(a,) for a in asked], "query string"), teams, short).collect()}
    assert got == {"Duke": 1, "UNC": 2, "Carolina": 2, "ohio state university": 5, "nc state": 3, "Ohio State Buckeyes": 5, "nowhere": None, "io": 4}


def test_names(spark):
    rows = spark.createDataFrame([("UConn Huskies",), ("North Carolina Tar Heels",), ("Penn State Nittany Lions",), ("Marshall Thundering Herd",), ("Texas A&M Aggies",), ("Saint Mary's Gaels",)], "n string")
    out = [tuple(r) for r in rows.select(names.short_name(F.col("n")), names.suggested_slug(F.col("n")), names.slug(F.col("n"))).collect()]
    assert [o[0] for o in out] == ["UConn", "North Carolina", "Penn State", "Marshall", "Texas A&M", "Saint Mary's"]
    assert out[2][1] == "penn-state" and out[4][1] == "texas-am" and out[5][1] == "saint-marys-gaels" and out[4][2] == "texas-a-m-aggies"


def test_words_wrap(spark):
    text = "one two three four five sixsixsixsixsix seven"
    out = spark.createDataFrame([(text,)], "t string").select(matchup.wrapped(F.col("t"), 10).alias("l")).first().l
    assert out == ["one two", "three four", "five", "sixsixsixsixsix", "seven"]


def test_merge_leaves_existing_keys_alone(spark):
    old, new = (spark.createDataFrame(r, "team_id long, g long") for r in ([(1, 1), (1, 2), (2, 3)], [(2, 9), (3, 4)]))
    assert sorted(tuple(r) for r in sync.merged(old, new).collect()) == [(1, 1), (1, 2), (2, 3), (3, 4)]


def test_clocks_dates_and_cells(spark):
    rows = spark.createDataFrame([("31:40", "Mon, Nov 6, 2023"), ("31:29", "Nov 6, 2023"), ("31", "soon"), ("DNP", None), (None, "Sat, Feb 30, 2023")], "m string, d string")
    out = [tuple(r) for r in rows.select(ingest.minutes(F.col("m")), ingest.day_of(F.col("d"))).collect()]
    assert [o[0] for o in out] == [32, 31, 31, 0, 0]
    assert [str(o[1]) for o in out] == ["2023-11-06", "2023-11-06", "None", "None", "None"]


def test_story_of_a_known_matchup(spark):
    sides = {"Offense": "A", "Coaching": "A", "Defense": "B", "Pace": "B", "Talent": "B", "Clutch": "B", "HTSS": "A"}
    row = (1, "A", 7, 1972, 2015, "UCLA Bruins", "Kentucky Wildcats", "John Wooden", "John Calipari", [(n, "", "", "", s) for n, s in sides.items()])
    schema = "matchup int, winner string, lead int, spring_a int, spring_b int, name_a string, name_b string, coach_a string, coach_b string, factors array<struct<name:string,team_a:string,team_b:string,edge:string,side:string>>"
    story = matchup.narrated(spark.createDataFrame([row], schema)).first().story
    assert story.startswith("1972 UCLA's elite offense and John Wooden pedigree give them the edge in a competitive but ultimately decisive game.")
    assert story.endswith("2015 Kentucky's suffocating defense, pace advantage, NBA-caliber talent, and close-game toughness keep it interesting, but UCLA pulls away down the stretch.")
