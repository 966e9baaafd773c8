import datetime as dt

import pytest
from pyspark.sql import functions as F

from tipoff.operators import ratings
from tipoff.plans import registry
from tipoff.sources import domain, files
from tipoff.streaming.limiter import limited, limited_stream

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


def test_ratings_of_a_thin_schedule(spark):
    """A part of the schedule in which teams have few games a season."""
    thin = ratings.per_100(domain.games(spark, SF).filter(F.col("order_key") % 23 == 1))
    assert ratings.season_ratings(thin, steps=4).count() == ratings.team_means(thin).count()


@pytest.mark.parametrize("name", ["season_efficiency", "adjusted_efficiency", "coach_careers", "parsed_schedules", "parsed_box_scores", "upset_summary", "rate_limited"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("supplier", "nation", "region", "lineitem", "orders", "customer", "events", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    rel = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    want = sorted(repr(tuple(plain(v) for v in row)) for row in rel.fetchall())
    got = sorted(repr(tuple(plain(v) for v in row)) for row in registry.queries()[name](spark, SF).select(*columns).collect())
    assert got == want


def test_limiter_streams_as_in_batch(spark, tmp_path):
    """Files out of order inside the delay, one a batch: the stream allows what the batch form does, and once the watermark has passed all
    windows only the last file's own event is left in the state."""
    import random

    at, rng = dt.datetime(2024, 1, 1), random.Random(1)
    rows = [(k % 3, k, at + dt.timedelta(seconds=20 * k)) for k in range(240)] + [(7, 1000 + k, at + dt.timedelta(seconds=40 * (k // 4))) for k in range(80)]
    rows.sort(key=lambda r: r[2] + dt.timedelta(seconds=rng.randint(0, 500)))
    last = (99, 5000, at + dt.timedelta(hours=9))
    schema = "user_id long, event_id long, ts timestamp"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query, states = None, []
    for part in (rows[:100], rows[100:200], rows[200:], [last]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = limited_stream(source, most=4, seconds=300).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        states += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    batch = limited(spark.createDataFrame(rows, schema), most=4, seconds=300)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
    assert max(states) > 5 and states[-1] <= 3, states


def test_limiter_against_a_walk(spark):
    import random

    rng, at = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(rng.choice([None, 1, 2, 3]), k, at + dt.timedelta(seconds=rng.randint(0, 4000) // 5 * 5) if k % 50 else None) for k in range(2000)]
    want, state = [], {}
    for user, event, ts in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2], r[1])):
        opened, n = state.get(user, (None, 0))
        opened, n = (ts, 1) if opened is None or (ts - opened).total_seconds() > 300 else (opened, n + 1)
        state[user] = opened, n
        want.append((user, event, n <= 20))
    got = limited(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp"), most=20, seconds=300)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"1": {"wins": 3, "name": "x"}, "_metadata": {"wins": 9}, "2": {"wins": 4}}')
    got = sorted(tuple(r) for r in files.keyed_json(spark, str(tmp_path / "a.json"), "wins:int,name:string").collect())
    assert got == [("1", 3, "x"), ("2", 4, None)]
    assert files.whole_texts(spark, [str(tmp_path / "a.json"), str(tmp_path / "none.json")]).count() == 1
    assert files.whole_texts(spark, [str(tmp_path / "none.json")]).count() == 0
    (tmp_path / "q.txt").write_text("1|Duke|9|1|3|0|2|0|8|0\n2|Kansas|8|2|3|1|2|0|7|0\n")
    assert [tuple(r) for r in files.quads(spark, str(tmp_path / "q.txt")).select("team", "q1w", "q4l").collect()] == [("Duke", 9, 0), ("Kansas", 8, 0)]
    assert files.resumed(spark, str(tmp_path / "out"), "id int").count() == 0
    files.write_json(spark.createDataFrame([(1,), (2,)], "id int"), str(tmp_path / "out"))
    files.write_json(spark.createDataFrame([(3,)], "id int"), str(tmp_path / "out"), "append")
    assert files.resumed(spark, str(tmp_path / "out"), "id int").count() == 3
    assert tuple(files.with_metadata(files.resumed(spark, str(tmp_path / "out"), "id int"), "id").first()) == (3, 3)
    log = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), "done")], "at timestamp, message string")
    files.append_log(spark, log, str(tmp_path / "log"))
    files.append_log(spark, log, str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["[2024-01-02 03:04:05] done"] * 2
    teams = spark.createDataFrame([("B", "b"), ("A", "a")], "name string, slug string")
    lines = [r.value for r in files.site_map_lines(files.site_map(teams, "https://example.org/"), "2024-01-02").collect()]
    assert len(lines) == 7 and lines[5].startswith("  <url>\n    <loc>https://example.org/?team=a</loc>")
    assert files.clipped_json(teams, 10).first().value == '{"name":"B'


def test_patterns_of_box_scores_are_searched_once(spark):
    """No filter repeats the search that it stands over."""
    plan = registry.queries()["parsed_box_scores"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all") <= 8
