"""Published snapshots, merges and syncs: audits, writers that die, conflicts, sweeping; ratings by tables against ratings by task."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tipoff.operators import ratings, sync
from tipoff.sources import domain, store

RECORDS = "team_id long, w long, l long"


def test_publish_and_reject(spark, tmp_path):
    root = str(tmp_path / "s")
    one = spark.range(10)
    assert store.manifest(spark, root) is None and store.snapshot(spark, root, "id long").count() == 0
    assert store.publish(one, root)["observed"] == {"rows": 10}
    fewer = lambda seen, last: "fewer" if seen["rows"] < last["observed"]["rows"] else None
    with pytest.raises(store.Rejected):
        store.publish(spark.range(3), root, fewer)
    old = store.snapshot(spark, root, "")
    made = store.publish(spark.range(12), root, fewer, {"most": F.max("id")}, notes={"why": "test"})
    assert made["observed"] == {"rows": 12, "most": 11} and made["notes"] == {"why": "test"}
    assert store.snapshot(spark, root, "").count() == 12 and old.count() == 10 and store.snapshot(spark, root, "", 0).count() == 10


def test_a_killed_writer_changes_nothing(spark, tmp_path):
    """Rows that fail while they are written, and rows written without a manifest, are never read; the sweep takes what is left behind."""
    root = str(tmp_path / "s")
    store.publish(spark.range(5), root)
    with pytest.raises(Exception, match="killed"):
        store.publish(spark.range(100).filter(F.when(F.col("id") == 77, F.raise_error(F.lit("killed")).cast("boolean")).otherwise(True)), root)
    spark.range(50).write.parquet(f"{root}/data/orphan")
    (tmp_path / "s" / "manifests" / ".half").write_text('{"data": ')
    assert store.snapshot(spark, root, "").count() == 5
    assert store.swept(spark, root) == 0 and store.swept(spark, root, older_than_ms=0) >= 1
    assert store.snapshot(spark, root, "").count() == 5 and store.publish(spark.range(6), root)["number"] == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    store.publish(spark.range(5), root)
    renamed = store._renamed

    def late(spark, root, number, text):
        monkeypatch.setattr(store, "_renamed", renamed)
        store.publish(spark.range(7), root)  # another writer comes first
        renamed(spark, root, number, text)

    monkeypatch.setattr(store, "_renamed", late)
    with pytest.raises(store.Conflict):
        store.publish(spark.range(6), root)
    assert store.snapshot(spark, root, "").count() == 7


def test_merge_into(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    rows = lambda *ids: spark.createDataFrame([(i, k) for i in ids for k in range(3)], "team_id long, n long")
    sync.merge_into(root, rows(1, 2))
    assert sync.merge_into(root, rows(2, 3))["observed"] == {"rows": 9, "old": 6}
    # a reader that loses rows of existing keys must not be published
    whole = store.snapshot
    monkeypatch.setattr(store, "snapshot", lambda *a: whole(*a).filter("n < 2"))
    with pytest.raises(store.Rejected, match="6 rows of existing keys, 9 before"):
        sync.merge_into(root, rows(4))
    monkeypatch.undo()
    assert store.snapshot(spark, root, "").count() == 9


def test_sync_runs(spark, tmp_path):
    root = str(tmp_path / "s")
    table = lambda *rows: spark.createDataFrame(rows, RECORDS)
    assert sync.synced(root, table((1, 3, 0), (2, 1, 1))).count() == 0
    assert [tuple(r) for r in sync.synced(root, table((1, 4, 0), (2, 1, 1), (3, 9, 9))).collect()] == [(1, 1, 0)]
    for bad in (table((1, 5, 5)), table((1, 5, 5), (1, 6, 6), (2, 1, 1)), table((1, 5, 5), (2, 1, 1), (None, 1, 1))):
        with pytest.raises(store.Rejected):
            sync.synced(root, bad)
    assert sync.synced(root, table((1, 4, 2), (2, 1, 1), (3, 9, 9))).first() == (1, 0, 2)


def test_ratings_by_tables(spark):
    """A part of the schedule, in two large seasons: what does not fit a task by itself is spread; the columns are those of the other form."""
    games = domain.games(spark, "/root/testdata/sf0.001").filter("order_key % 7 = 1").withColumn("season", F.concat(F.lit("y"), (F.col("start_year") % 2).cast("string")))
    rated = ratings.per_100(games)
    one, two = ({(r.season, r.team_id): r for r in df.collect()} for df in (ratings.season_ratings(rated), ratings.season_ratings_by_tables(rated)))
    assert one.keys() == two.keys() and len(one) > 10
    for k, a in one.items():
        for c in a.asDict():
            assert two[k][c] == pytest.approx(a[c], abs=1e-6), (k, c)


@pytest.mark.parametrize("task_games", [0, 1500, 10**9])
def test_ratings_of_large_and_small_seasons(spark, task_games, monkeypatch):
    """All seasons by joins, the larger one, or none: the same ratings, and steps are written only for those that do not fit a task."""
    games = domain.games(spark, "/root/testdata/sf0.001").filter("order_key % 7 = 1").withColumn("season", F.concat(F.lit("y"), (F.col("start_year") % 4 == 0).cast("string")))
    rated = ratings.per_100(games)
    counts = [r["count"] for r in rated.groupBy("season").count().collect()]
    written = []
    monkeypatch.setattr(ratings, "shared_path", lambda s, name, f=ratings.shared_path: (written.append(name), f(s, name))[1])
    one, two = ({(r.season, r.team_id): r for r in df.collect()} for df in (ratings.season_ratings(rated), ratings.season_ratings_by_tables(rated, task_games=task_games)))
    assert one.keys() == two.keys() and len(one) > 10
    for k, a in one.items():
        for c in a.asDict():
            assert two[k][c] == pytest.approx(a[c], abs=1e-6), (k, c)
    assert bool(written) == any(n > task_games for n in counts), counts


def test_memory_of_a_large_season():
    """A season of 600,000 pairs takes less than 150 bytes a pair, batches and results included."""
    rng, pairs, teams = np.random.default_rng(1), 600_000, 20_000
    columns = lambda n: {"season": pa.array(["1999-00"] * n), "team_id": pa.array(rng.integers(0, teams, n)), "opp_id": pa.array(rng.integers(0, teams, n), mask=rng.random(n) < 0.05), "home": pa.array(rng.random(n) < 0.5), **{c: pa.array(rng.normal(0, 30, n)) for c in ("margin", "off", "def")}, "n": pa.array(np.ones(n, np.int64)), "won": pa.array(rng.integers(0, 2, n))}
    batches = (pa.RecordBatch.from_pydict(columns(10_000)) for _ in range(pairs // 10_000))
    tracemalloc.start()
    rows = sum(b.num_rows for b in ratings._solve("1999-00", ratings._runs(batches), None))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == teams and most < 150 * pairs, most / pairs


def _pairs(team, opp, rng):
    n = len(team)
    return pa.RecordBatch.from_pydict({"team_id": pa.array(team), "opp_id": pa.array(opp, pa.int64()), "home": pa.array(rng.random(n) < 0.5), **{c: pa.array(rng.normal(0, 30, n)) for c in ("margin", "off", "def")}, "n": pa.array(np.ones(n, np.int64)), "won": pa.array(rng.integers(0, 2, n))})


def test_memory_of_a_larger_season():
    """A season of 1,200,000 pairs takes less than 50 bytes a pair, with its last batches and results: no floating values of pairs are kept."""
    rng, pairs, teams = np.random.default_rng(2), 1_200_000, 20_000
    batches = (_pairs(rng.integers(0, teams, 10_000), rng.integers(0, teams, 10_000), rng) for _ in range(pairs // 10_000))
    tracemalloc.start()
    rows = sum(b.num_rows for b in ratings._solve("1999-00", ratings._runs(batches), 5))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == teams and most < 50 * pairs, most / pairs


def test_opponents_that_come_late_or_never(monkeypatch):
    """Opponents that are teams in a later run, in none, or null: the same ratings whatever the runs."""
    rng = np.random.default_rng(3)
    team = np.sort(rng.integers(0, 40, 3000))
    opp = [None if k % 11 == 0 else int(x) for k, x in enumerate(rng.integers(-5, 50, 3000))]
    whole = _pairs(team, opp, rng)
    solved = lambda: pa.Table.from_batches(ratings._solve("s", ratings._runs(whole.slice(k, 100) for k in range(0, 3000, 100)), 9)).to_pydict()
    one = solved()
    monkeypatch.setattr(ratings, "RUN", 300)
    monkeypatch.setattr(ratings, "READ", 100)
    two = solved()
    assert one["team_id"] == list(range(40)) and sum(one["t1w"]) > 0
    met = [k for k, o in enumerate(opp) if o is not None and 0 <= o < 40]
    assert sum(sum(one[c]) for c in ratings.TIER_COUNTS) == len(met)
    for c in one:
        assert one[c] == (pytest.approx(two[c], abs=1e-9) if c in ("em", "oe", "de", "sos") else two[c]), c
