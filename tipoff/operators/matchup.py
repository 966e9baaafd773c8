"""Cross-era matchups: texts like "1972 UCLA" to season and team, profiles of both sides, prediction, factors and a report.

All of it works on a table of matchups; a side that cannot be resolved keeps nulls and says why in `error`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tipoff.functions import seasons as S
from tipoff.functions.names import short_name

#: Average points per 100 possessions, divisor of the logistic, bounds of scores, the least lead that is no toss-up, and the
#: mean and deviation of close-game scores where no ranking gives them.
AVERAGE, LOGISTIC, SCORES, TOSS_UP, CLOSE_MEAN, CLOSE_SD = 100, 4.5, (40, 120), 3, 0.5, 0.15
#: How a side's strong points are called, and leads that make a game one-sided or clear.
STRONG = {"Offense": "elite offense", "Defense": "suffocating defense", "Pace": "pace advantage", "Talent": "NBA-caliber talent", "Clutch": "close-game toughness"}
ONE_SIDED, CLEAR = 10, 5
LISTED = 100


def parsed(text: Column) -> Column:
    """struct(season, spring, query, error) of a text with a season (1999-00) or the year in which one ends, and a team."""
    t = F.trim(text)
    season, year = F.regexp_extract(t, r"(\d{4}-\d{2,4})", 1), F.regexp_extract(t, r"\b(\d{4})\b", 1)
    start = F.substring(season, 1, 4).try_cast("int")
    spring = year.try_cast("int")
    at = lambda p: F.call_function("instr", t, p)
    first = lambda p: F.trim(F.concat(F.substring(t, F.lit(1), at(p) - 1), F.substring(t, at(p) + F.length(p), F.length(t))))  # noqa: E731  without its first occurrence
    from_season = F.struct(F.concat(F.substring(season, 1, 4), F.lit("-"), F.right(season, F.lit(2))).alias("season"), (start + 1).alias("spring"), first(season).alias("query"), F.lit(None).cast("string").alias("error"))
    from_year = F.struct(S.season_key(spring - 1).alias("season"), spring.alias("spring"), first(year).alias("query"), F.lit(None).cast("string").alias("error"))
    none = F.struct(F.lit(None).cast("string").alias("season"), F.lit(None).cast("int").alias("spring"), t.alias("query"), F.lit("no year").alias("error"))
    return F.when(season != "", from_season).when(year != "", from_year).otherwise(none)


def _grams(text: Column) -> Column:
    """All substrings of one to three characters: the beginnings that a text inside this one may have."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def resolved(queries: DataFrame, teams: DataFrame, short: DataFrame) -> DataFrame:
    """queries (query) with team_id: for the name that an abbreviation (abbr, meant) stands for, then for the text itself, a school or full
    name that equals it, else the one of nearest length that holds it or is held by it, else a slug. The least id of equals.

    A text holds another only if it holds its first three characters, so texts meet by these and not each with each."""
    asked = queries.select("query").distinct().withColumn("t", F.trim(F.lower("query")))
    meant = asked.join(short.select(F.lower("abbr").alias("t"), F.lower("meant").alias("term")), "t").select("query", "term", F.lit(0).alias("turn"))
    terms = meant.unionByName(asked.select("query", F.col("t").alias("term"), F.lit(1).alias("turn"))).filter("term <> ''")
    known = teams.select("team_id", F.lower("school").alias("school"), F.lower("name").alias("name"), "slug")
    exact = terms.join(known.select("team_id", F.explode(F.array_distinct(F.array("school", "name"))).alias("term")), "term").select("query", "turn", F.lit(0).alias("way"), F.lit(0).alias("far"), "team_id")
    far = F.abs(F.length("school") - F.length("term")).alias("far")
    inside = terms.withColumn("g", F.substring("term", 1, 3)).join(known.select("team_id", "school", F.explode(_grams(F.col("school"))).alias("g")), "g").filter(F.col("school").contains(F.col("term")))
    around = terms.withColumn("g", F.explode(_grams(F.col("term")))).join(known.select("team_id", "school", F.substring("school", 1, 3).alias("g")), "g").filter(F.col("term").contains(F.col("school")))
    part = [d.select("query", "turn", F.lit(1).alias("way"), far, "team_id") for d in (inside, around)]
    by_slug = terms.join(known.select("team_id", F.explode(F.array("slug", F.replace("slug", F.lit("-"), F.lit(" ")))).alias("term")), "term").select("query", "turn", F.lit(2).alias("way"), F.lit(0).alias("far"), "team_id")
    every = exact.unionByName(part[0]).unionByName(part[1]).unionByName(by_slug)
    best = every.groupBy("query").agg(F.min(F.struct("turn", "way", "far", "team_id")).alias("b")).select("query", "b.team_id")
    return queries.join(best, "query", "left")


def october_close(games: DataFrame) -> DataFrame:
    """Close games of each team and season by the October rule."""
    gap, won = F.abs(F.col("pts") - F.col("opp_pts")), F.col("pts") > F.col("opp_pts")
    rows = games.withColumn("season", S.season_key(S.start_year(F.col("game_date"), 10)))
    kinds = {"close": gap <= 5, "clutch": gap <= 3}
    return rows.groupBy("team_id", "season").agg(*(F.count_if(t & (won if s == "wins" else ~won)).alias(f"{k}_{s}") for k, t in kinds.items() for s in ("wins", "losses")))


def profiles(sides: DataFrame, teams: DataFrame, ratings: DataFrame, ranked: DataFrame, seasons: DataFrame, games: DataFrame, close_score: Column) -> DataFrame:
    """sides (team_id, season, spring, ...) with name, ratings, record, coach, polls, score and rank; components only of the first LISTED,
    close games else from the games themselves."""
    key = ["team_id", "season"]
    wanted = sides.select(*key).filter(F.col("team_id").isNotNull()).distinct()
    rated = ratings.select(*key, "em", "oe", "de", F.concat_ws("-", "wins", "losses").alias("rated_record"))
    scored = ranked.select(*key, "score", "rank", *(F.when(F.col("rank") <= LISTED, F.col(c)).alias(c) for c in ("coaching", "draft", "close_game")))
    record = F.concat_ws("-", "wins", "losses").alias("season_record")
    positive = lambda c: F.nullif(F.col(c), F.lit(0))
    own = seasons.select(*key, record, "coach", F.coalesce(positive("ap_final"), positive("ap_high"), positive("ap_pre")).alias("ap_rank"), "seed", "tourney")
    close = october_close(games.join(wanted.select("team_id").distinct(), "team_id", "left_semi")).select(*key, S.round_up((close_score - CLOSE_MEAN) / CLOSE_SD, 3).alias("own_close"))
    info = wanted.join(teams.select("team_id", "name"), "team_id").join(rated, key, "left").join(scored, key, "left").join(own, key, "left").join(close, key, "left")
    info = info.select(*key, "name", "em", "oe", "de", F.coalesce("rated_record", "season_record").alias("record"), "coach", "ap_rank", "seed", "tourney", "score", "rank", "coaching", "draft", F.coalesce(positive("close_game"), "own_close").alias("clutch"))
    return sides.join(info, key, "left")


def facing(sides: DataFrame) -> DataFrame:
    """Profiles of sides a and b (letter) -> one row for each matchup, with columns of both."""
    columns = ("team_id", "season", "spring", "name", "oe", "de", "em", "record", "coach", "ap_rank", "seed", "score", "rank", "coaching", "draft", "clutch")
    return sides.groupBy("matchup").agg(*(F.max(F.when(F.col("letter") == x, F.col(c))).alias(f"{c}_{x}") for x in "ab" for c in columns))


def predicted(both: DataFrame, seed: int | None = None) -> DataFrame:
    """Possessions, expected points, win probability and a final score. With a `seed` scores move by up to two points and toss-ups are drawn;
    without, scores are the expected ones and a toss-up goes to the likelier side by a point."""
    pace = lambda s: S.pace(F.col(f"spring_{s}"))
    df = both.withColumn("pace_a", pace("a")).withColumn("pace_b", pace("b")).withColumn("possessions", (F.col("pace_a") + F.col("pace_b")) / 2)
    points = lambda x, y: (F.col(f"oe_{x}") + F.col(f"de_{y}") - AVERAGE) * (F.col("possessions") / 100)
    df = df.withColumn("points_a", points("a", "b")).withColumn("points_b", points("b", "a"))
    df = df.withColumn("prob_a", 1 / (1 + F.exp(-(F.col("points_a") - F.col("points_b")) / LOGISTIC)))
    rand = lambda k: F.lit(0.0) if seed is None else (F.rand(seed + k) - 0.5) * 4
    final = lambda s, k: F.greatest(F.lit(SCORES[0]), F.least(F.lit(SCORES[1]), S.round_up(F.col(f"points_{s}") + rand(k), 0).cast("int")))
    known = F.col("points_a").isNotNull() & F.col("points_b").isNotNull()
    df = df.withColumn("score_one", F.when(known, final("a", 0))).withColumn("score_two", F.when(known, final("b", 1)))
    toss = F.abs(F.col("score_one") - F.col("score_two")) < TOSS_UP
    draw = F.lit(0.5) if seed is None else F.rand(seed + 2)
    df = df.withColumn("winner", F.when(F.when(toss, draw < F.col("prob_a")).otherwise(F.col("score_one") > F.col("score_two")), "A").when(known, "B"))
    more = F.lit(1) if seed is None else F.ceil(F.rand(seed + 3) * 3).cast("int")
    lift = lambda w, mine, other: F.when((F.col("winner") == w) & (F.col(mine) <= F.col(other)), F.col(other) + more).otherwise(F.col(mine))
    df = df.withColumn("final_a", lift("A", "score_one", "score_two")).withColumn("final_b", lift("B", "score_two", "score_one"))
    return df.drop("score_one", "score_two").withColumn("lead", F.abs(F.col("final_a") - F.col("final_b")))


def plain_number(x: Column) -> Column:
    """A number as text, without a fraction of zero."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def factors(df: DataFrame) -> DataFrame:
    """Adds factors: name, what each side has, the name of the side that it favours, and A or B (null where neither)."""
    r1 = lambda c: plain_number(S.round_up(F.col(c), 1))
    gap = lambda c: S.round_up(F.col(f"{c}_a") - F.col(f"{c}_b"), 2)
    more = lambda c: F.when(F.col(f"{c}_a") > F.col(f"{c}_b"), "A").when(F.col(f"{c}_b") > F.col(f"{c}_a"), "B")
    both = lambda c: F.col(f"{c}_a").isNotNull() & F.col(f"{c}_b").isNotNull()

    def factor(name: str, text, which: Column, neither) -> Column:
        edge = F.when(which == "A", F.col("name_a")).when(which == "B", F.col("name_b")).otherwise(neither)
        return F.struct(F.lit(name).alias("name"), text("a").alias("team_a"), text("b").alias("team_b"), edge.alias("edge"), which.alias("side"))

    even = F.lit("Even")
    unknown = lambda c: F.when(both(c), even).otherwise(F.lit("N/A"))
    rank = lambda s: F.coalesce(F.col(f"rank_{s}").cast("string"), F.lit("?"))
    out = [
        factor("Offense", lambda s: F.concat(r1(f"oe_{s}"), F.lit(" adjOE")), F.when(gap("oe") > 1, "A").when(gap("oe") < -1, "B"), even),
        factor("Defense", lambda s: F.concat(r1(f"de_{s}"), F.lit(" adjDE")), F.when(gap("de") < -1, "A").when(gap("de") > 1, "B"), even),
        factor("Pace", lambda s: F.concat(F.col(f"pace_{s}").cast("string"), F.lit(" era avg")), F.when(F.col("pace_a") > F.col("pace_b"), "B").when(F.col("pace_a") < F.col("pace_b"), "A"), F.lit("Neutral")),
        factor("Coaching", lambda s: F.coalesce(F.col(f"coach_{s}"), F.lit("Unknown")), more("coaching"), unknown("coaching")),
        factor("Talent", lambda s: F.coalesce(F.concat(F.lit("Draft score: "), r1(f"draft_{s}")), F.lit("N/A")), more("draft"), unknown("draft")),
        factor("Clutch", lambda s: F.coalesce(r1(f"clutch_{s}"), F.lit("N/A")), more("clutch"), unknown("clutch")),
        factor("HTSS", lambda s: F.concat(r1(f"score_{s}"), F.lit(" (#"), rank(s), F.lit(")")), F.when(both("score"), F.when(F.col("score_a") > F.col("score_b"), "A").otherwise("B")), F.lit(None)),
    ]
    return df.withColumn("factors", F.filter(F.array(*out), lambda f: (f["name"] != "HTSS") | f["side"].isNotNull()))


def _listed(parts: Column) -> Column:
    n = F.size(parts)
    return F.when(n == 0, "overall balance").when(n <= 2, F.array_join(parts, " and ")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(parts, -1)))


def narrated(df: DataFrame) -> DataFrame:
    """Adds story: who wins by what, in one of three tones. The sentences are fixed values."""
    won, lost = F.col("winner"), F.when(F.col("winner") == "A", "B").otherwise("A")
    of = lambda c, w: F.when(w == "A", F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))

    def strong(w: Column) -> Column:
        names = F.create_map(*(F.lit(x) for kv in STRONG.items() for x in kv))
        mine = F.filter("factors", lambda f: (f["side"] == w) & (f["name"] != "HTSS"))
        coach = F.concat(F.coalesce(of("coach", w), F.lit("coaching")), F.lit(" pedigree"))
        return F.transform(mine, lambda f: F.when(f["name"] == "Coaching", coach).otherwise(names[f["name"]]))

    who = lambda w: F.concat(of("spring", w).cast("string"), F.lit(" "), short_name(of("name", w)))
    df = df.withColumn("_w", who(won)).withColumn("_l", who(lost)).withColumn("_ws", short_name(of("name", won))).withColumn("_wp", strong(won)).withColumn("_lp", strong(lost))
    w, l, ws, wp, lp = (F.col(c) for c in ("_w", "_l", "_ws", "_wp", "_lp"))
    one = lambda p, a, b: F.when(F.size(p) == 1, a).otherwise(b)
    some = F.size(lp) > 0
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    far = text(w, "'s ", _listed(wp), " would overwhelm ", l, " in a convincing victory. ", F.when(some, text(l, "'s ", _listed(lp), one(lp, " isn't", " aren't"), " enough to overcome the gap in overall quality.")).otherwise("The talent and efficiency gap is simply too wide to overcome."))
    clear = text(w, "'s ", _listed(wp), one(wp, " gives", " give"), " them the edge in a competitive but ultimately decisive game. ", F.when(some, text(l, "'s ", _listed(lp), one(lp, " keeps", " keep"), " it interesting, but ", ws, " pulls away down the stretch.")).otherwise(text(l, " battles hard but can't match ", ws, "'s firepower.")))
    near = text("This one goes down to the wire — ", w, " barely edges ", l, " in an instant classic. ", F.when(some, text(l, "'s ", _listed(lp), " nearly ", one(lp, "steals", "steal"), " the game, but ", ws, "'s ", _listed(wp), one(wp, " proves", " prove"), " decisive in the final minutes.")).otherwise(text("Both teams trade blows, but ", ws, " makes one more play when it matters most.")))
    return df.withColumn("story", F.when(F.col("lead") >= ONE_SIDED, far).when(F.col("lead") >= CLEAR, clear).otherwise(near)).drop("_w", "_l", "_ws", "_wp", "_lp")


def wrapped(text: Column, width: int = 76) -> Column:
    """Lines of at most `width` characters, broken at spaces; a longer word has a line of its own."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"))

    def step(a, word):
        full = (F.length(a["now"]) + F.length(word) + 1 > width) & (F.length(a["now"]) > 0)
        lines = F.when(full, F.concat(a["lines"], F.array(a["now"]))).otherwise(a["lines"])
        now = F.when(full | (a["now"] == ""), word).otherwise(F.concat(a["now"], F.lit(" "), word))
        return F.struct(lines.alias("lines"), now.alias("now"))

    return F.aggregate(F.split(text, " "), start, step, lambda a: F.when(a["now"] != "", F.concat(a["lines"], F.array(a["now"]))).otherwise(a["lines"]))


def report_line(rank: Column, score: Column, season: Column, name: Column) -> Column:
    """One line of a fixed-width listing."""
    return F.concat(F.lpad(rank.cast("string"), 4, " "), F.lit(" "), F.lpad(F.format_number(score, 2), 6, " "), F.lit("  "), F.rpad(season, 8, " "), F.lit(" "), F.rpad(name, 30, " "))


def found(matchups: DataFrame, text: str) -> DataFrame:
    """The first matchup whose text holds this."""
    return matchups.filter(F.lower("matchup").contains(text.lower())).orderBy("matchup").limit(1)
