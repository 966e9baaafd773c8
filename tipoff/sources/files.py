"""Files in and out: keyed json, delimited text, resume-if-there, json and text sinks, the site map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tipoff.sources import keyed

QUADS = "rank int, team string, q1w int, q1l int, q2w int, q2l int, q3w int, q3l int, q4w int, q4l int"


def whole_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, value: each file's whole text; paths that are not there are skipped."""
    out = None
    for path in paths:
        try:
            one = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "file string, value string") if out is None else out


def keyed_json(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """A json object of records by id -> id and the record's fields by the schema `entry`; what does not fit is null."""
    rows = keyed.entries(spark, [path]).filter(F.col("key") != "_metadata")
    return rows.select(F.col("key").alias("id"), F.from_json("value", f"struct<{entry}>").alias("r")).select("id", "r.*")


def quads(spark: SparkSession, path: str) -> DataFrame:
    """Headerless text with bars: a team's wins and losses in four classes of opponents."""
    return spark.read.csv(path, sep="|", schema=QUADS)


def resumed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What an earlier run wrote, or an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def with_metadata(df: DataFrame, count_of: str) -> DataFrame:
    """One row of metadata beside the rows: what a reader of the whole document wants to know first."""
    return df.agg(F.count("*").alias("count"), F.max(count_of).alias("last"))


def append_log(spark: SparkSession, lines: DataFrame, path: str) -> None:
    """lines (at, message) appended as text."""
    lines.select(F.format_string("[%s] %s", F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "message").alias("value")).write.mode("append").text(path)


def site_map(teams: DataFrame, base: str, pages: tuple[str, ...] = ("bracket", "rankings", "teams", "coaches")) -> DataFrame:
    """loc and priority of the home page, the fixed pages and each team's page, with its place in the list."""
    spark = teams.sparkSession
    fixed = spark.createDataFrame([(0, "", base, "1.0"), *((1, f"{k}", f"{base}?view={p}", "0.6") for k, p in enumerate(pages))], "part int, key string, loc string, priority string")
    own = teams.select(F.lit(2).alias("part"), F.col("name").alias("key"), F.concat(F.lit(f"{base}?team="), "slug").alias("loc"), F.lit("0.8").alias("priority"))
    return fixed.unionByName(own)


def site_map_lines(urls: DataFrame, day: str) -> DataFrame:
    """value: the lines of each url's entry, sorted as the map lists them."""
    entry = F.concat(F.lit("  <url>\n    <loc>"), "loc", F.lit(f"</loc>\n    <lastmod>{day}</lastmod>\n    <priority>"), "priority", F.lit("</priority>\n  </url>"))
    return urls.orderBy("part", "key").select(entry.alias("value"))


def clipped_json(df: DataFrame, most: int = 4000) -> DataFrame:
    """Each row as json of at most `most` characters."""
    return df.select(F.substring(F.to_json(F.struct("*")), 1, most).alias("value"))


def meta_tags(info: DataFrame) -> DataFrame:
    """Title and description that a team's page shows elsewhere, escaped for attributes."""
    from tipoff.functions.names import escaped

    n = F.col("titles")
    titles = F.when(n > 0, F.concat(n.cast("string"), F.lit(" National Championship"), F.when(n > 1, "s").otherwise(""))).otherwise("No National Championships")
    text = F.concat(F.col("all_wins").cast("string"), F.lit("-"), F.col("all_losses").cast("string"), F.lit(" all-time | "), titles, F.lit(" | "), F.coalesce("conf", F.lit("")))
    return info.select("team_id", escaped(F.col("name")).alias("title"), escaped(text).alias("description"))


def _name_of(slug: Column, name: Column) -> Column:
    """A known team's name, else the slug as a title."""
    from tipoff.functions.names import title_of_slug

    return F.coalesce(name, title_of_slug(slug))


def comparison_tags(pairs: DataFrame, site: str) -> DataFrame:
    """pairs (key, name_a, name_b) -> key, type, title, description of a page that compares two teams; nothing where one is unknown."""
    known = pairs.filter(F.col("name_a").isNotNull() & F.col("name_b").isNotNull())
    return known.select("key", F.lit("website").alias("type"), F.concat("name_a", F.lit(" vs "), "name_b", F.lit(f" — {site}")).alias("title"), F.lit(f"Head-to-head comparison on {site}").alias("description"))


def champion_tags(pages: DataFrame, site: str) -> DataFrame:
    """pages (key, year, slug, name: null if unknown) -> the tags of a title's page."""
    name, year = _name_of(F.col("slug"), F.col("name")), F.col("year").cast("string")
    story = F.concat(F.lit("Relive "), name, F.lit("'s "), year, F.lit(" championship run. Full tournament path, box scores, highlights, and the story of how they cut down the nets."))
    return pages.select("key", F.lit("article").alias("type"), F.concat(name, F.lit(" — "), year, F.lit(f" National Champions | {site}")).alias("title"), story.alias("description"))


def game_tags(pages: DataFrame, site: str) -> DataFrame:
    """pages (key, path: `year/winner-vs-loser`, winner, loser: names or null) -> the tags of a game's page; other paths have none."""
    year, slugs = F.regexp_extract("path", "^([^/]*)/", 1), F.regexp_extract("path", "^[^/]*/(.*)$", 1)
    at = F.locate("-vs-", slugs)
    won, lost = _name_of(F.substring(slugs, F.lit(1), at - 1), F.col("winner")), _name_of(F.substring(slugs, at + 4, F.length(slugs)), F.col("loser"))
    title = F.concat(won, F.lit(" Upsets "), lost, F.lit(" — "), year, F.lit(f" NCAA Tournament | {site}"))
    story = F.concat(F.lit("Relive the Moment: "), won, F.lit(" defeats "), lost, F.lit(" in the "), year, F.lit(" NCAA Tournament. Box score, highlights, and why this upset mattered."))
    return pages.filter(F.col("path").contains("/") & (at > 0)).select("key", F.lit("article").alias("type"), title.alias("title"), story.alias("description"))
