"""Pages of landed documents as a stream, and snapshots that grow by batches: restarts, replays, retries."""

import json

from pyspark.sql import functions as F

from tipoff.sources import store
from tipoff.streaming import paged


def _land(spark, path, ids, status=200, attempt=1):
    rows = [(f"{attempt}-{i:04d}.json", str(i), attempt, status, json.dumps({"n": i})) for i in ids]
    assert paged.land(spark.createDataFrame(rows, "name string, id string, attempt int, status int, body string"), path) == len(rows)


def test_each_file_once_over_restarts(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    pages = []
    for ids in (range(25), range(25, 31), range(0), range(31, 32)):
        if ids:
            _land(spark, landing, ids)
        rows = paged.documents(spark, landing).withColumn("page", F.spark_partition_id())
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        pages.append(spark.read.parquet(out).count())
    got = spark.read.parquet(out)
    assert pages == [25, 31, 31, 32] and got.select("id").distinct().count() == 32
    assert sorted(r["count"] for r in got.filter("int(id) < 25").groupBy("page").count().collect()) == [5, 10, 10]


def test_growth_ledger_and_replay(spark, tmp_path):
    root = str(tmp_path / "s")
    batch = lambda *ids: spark.createDataFrame([(str(i), i * 2) for i in ids], "id string, v int")
    ids = lambda: sorted(int(r.id) for r in store.snapshot(spark, root, "id string, v int").collect())
    assert not paged.grow(batch(1, 2, 3), 0, root, "id", 5) and ids() == []
    assert not paged.grow(batch(1, 2, 3), 0, root, "id", 5)  # the same batch again
    assert paged.grow(batch(3, 4, 5), 1, root, "id", 5) and set(ids()) == {1, 2, 3, 4, 5}
    assert not paged.grow(batch(3, 4, 5), 1, root, "id", 5) and not paged.grow(batch(1, 2, 3), 0, root, "id", 5)
    assert not paged.grow(batch(6, 1), 2, root, "id", 5) and store.manifest(spark, root)["notes"] == {"batch": 1}
    assert paged.grow(batch(7, 8, 9, 10), 3, root, "id", 5) and set(ids()) == set(range(1, 11))


def test_outcomes_and_next_round(spark, tmp_path):
    landing = str(tmp_path / "in")
    _land(spark, landing, [1, 2], 200)
    _land(spark, landing, [3], 404)
    _land(spark, landing, [4, 5], 429)
    _land(spark, landing, [4], 200, attempt=2)
    _land(spark, landing, [6], 503, attempt=4)
    _land(spark, landing, [7], 403)
    (tmp_path / "in" / "9-bad.json").write_text("no json")
    query = paged.outcomes(paged.documents(spark, landing, 2)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    seen = spark.table("seen")
    got = sorted((r.id, r.attempt, r.outcome, r.body) for r in seen.collect() if r.id)
    one = lambda n: json.dumps({"n": n})
    assert got == [("1", 1, "done", one(1)), ("2", 1, "done", one(2)), ("3", 1, "gone", "{}"), ("4", 1, "again", None), ("4", 2, "done", one(4)), ("5", 1, "again", None), ("6", 4, "failed", None), ("7", 1, "failed", None)]
    wanted = spark.range(1, 10).select(F.col("id").cast("string"))
    assert sorted(map(tuple, paged.to_ask(wanted, seen).collect())) == [("5", 2), ("8", 1), ("9", 1)]
