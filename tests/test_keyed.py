"""Large json objects: the same entries whatever the splits, and what is written is read."""

import json
import random
import tracemalloc

import pyarrow as pa
import pytest

from tipoff.plans import stores
from tipoff.plans.registry import Tables
from tipoff.sources import files, keyed


def made(seed, n):
    """Objects with braces, commas, quotes and escapes inside keys and texts, nested deep and flat."""
    rng = random.Random(seed)
    odd = ['}', '{"a":[', '\\', '"', ',', '\\"', 'é日本😀', '\n', '":', ']', 'plain', '\\\\', "\t"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 6)))

    def value(depth):
        kind = rng.randrange(6)
        if kind < 2 and depth < 5:
            return {text() + str(k): value(depth + 1) for k in range(rng.randint(0, 4))}
        if kind == 2 and depth < 5:
            return [value(depth + 1) for _ in range(rng.randint(0, 4))]
        return rng.choice([text(), 3, -1.5, True, None])

    return {f"{text()}{k}": value(0) for k in range(n)}


@pytest.mark.parametrize("size", [61, 500, 1 << 27])
@pytest.mark.parametrize("indent", [None, 1])
def test_any_splits(spark, tmp_path, size, indent):
    """Splits of a few bytes fall inside texts, escapes and characters; an entry of some hundred bytes spans many of them."""
    few = size == 61
    data = made(1, 3 if few else 60) | {"long": {"list": ["x}{,\\\"" * 20] * (2 if few else 30)}}
    for k, one in enumerate((data, made(2, 5), {}, {"only": 1})):
        (tmp_path / f"{k}.json").write_text(json.dumps(one, indent=indent, ensure_ascii=k % 2 == 0), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        rows = keyed.entries(spark, [str(tmp_path / "*.json"), str(tmp_path / "none.json")]).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    for k, one in enumerate((data, made(2, 5), {}, {"only": 1})):
        got = [(r.key, json.loads(r.value)) for r in rows if r.file.endswith(f"/{k}.json")]
        assert len(got) == len(one) and dict(got) == one
    assert len(rows) == sum(map(len, (data, made(2, 5), {"only": 1})))


def test_nothing_there(spark, tmp_path):
    assert keyed.entries(spark, [str(tmp_path / "none.json")]).count() == 0


def test_written_and_read(spark, tmp_path):
    rows = [(f'k"{k}', json.dumps({"n": k, "s": "}" * (k % 5)})) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, value string")
    keyed.write_entries(df, str(tmp_path / "out"), files.with_metadata(df, "key"), parts=3)
    read = keyed.entries(spark, [str(tmp_path / "out")])
    got = {(r.key, r.value) for r in read.collect()}
    assert {x for x in got if x[0] != "_metadata"} == set(rows)
    assert {json.loads(v)["count"] for k, v in got if k == "_metadata"} == {200}
    assert files.keyed_json(spark, str(tmp_path / "out"), "n int, s string").count() == 200
    for part in (tmp_path / "out").glob("part-*"):
        json.loads(part.read_text())


@pytest.mark.parametrize("metadata", [False, True])
def test_objects_of_any_number(spark, tmp_path, metadata):
    """More objects than entries: each is valid, also an empty one and the first entry of one without metadata."""
    rows = [('a"\\\n', "1"), ("é", '"x"'), ("c", "[2]")]
    df = spark.createDataFrame(rows, "key string, value string")
    keyed.write_entries(df, str(tmp_path / "out"), files.with_metadata(df, "key") if metadata else None, parts=7)
    read = [json.loads(part.read_text(encoding="utf-8")) for part in (tmp_path / "out").glob("part-*")]
    assert len(read) == 7 and all(("_metadata" in x) == metadata for x in read)
    assert {k: json.dumps(v) for x in read for k, v in x.items() if k != "_metadata"} == dict(rows)


def test_stored_logs_grow_in_number(spark, tmp_path, monkeypatch):
    """The objects, so the tasks that write them, grow with the order lines; what is read stays."""
    t = lambda: Tables(spark, "/root/testdata/sf0.001")
    few = stores._stored_logs(t()).drop("file")
    monkeypatch.setattr(stores, "ORDER_LINES", 600)
    path = tmp_path / "logs"
    monkeypatch.setattr(stores, "shared_path", lambda *_: str(path))
    many = stores._stored_logs(t()).drop("file")
    assert len(list(path.glob("part-*"))) == t().read("lineitem").count() // 600 > 3
    assert many.exceptAll(few).count() == few.exceptAll(many).count() == 0


def test_pieces_are_read_as_runs(spark):
    """A batch of pieces is one run of bytes for each split: an entry of 20,000 games costs no objects for its pieces."""
    game = '{"date":"1999-01-01","opp":"12","w":true}'
    text = '{"1":[' + ",".join([game] * 20_000) + '],"2":[]}'
    pieces = [x + "}" for x in text.split("}")]
    batch = pa.RecordBatch.from_pydict({"value": pieces, "file": ["f"] * len(pieces), "block": [0] * len(pieces), "in_text": [False] * len(pieces), "depth": [0] * len(pieces)})
    tracemalloc.start()
    rows = [r for b in keyed._runs(iter([batch])) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["key"], len(r["value"])) for r in rows if r["part"] == 1] == [("1", len(game) * 20_000 + 20_001), ("2", 2)]
    assert most < 40 * len(text)
