"""Landed documents as a stream of pages, and snapshots that grow by micro-batches.

A fetcher lands a file for each id, named so that later ones sort later: json with status and body. The source's offset is the last name that was
planned, so a restart reads each file once; a batch is planned as pages of PAGE files, a partition each. What a file says is data: rows
of a status to try again go to the attempts of the next round, an id that is gone gets a placeholder and is not asked for again.

growing() gathers batches and publishes a new snapshot once `least` new keys have come. The manifest is the ledger: it names the last batch
that it holds, so a batch that is replayed after a crash changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tipoff.sources import store
from tipoff.sources.staged import file_system

PAGE = 10
#: Statuses after which an id is asked for again, and the most attempts.
AGAIN, MOST_ATTEMPTS = (429, 500, 502, 503, 504), 4


@dataclass
class Page(InputPartition):
    names: tuple[str, ...]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, page: int):
        self.path, self.page = path, page

    def _names(self) -> list[str]:
        from pyarrow import fs

        system, root = _open(self.path)
        return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.endswith(".json"))

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        names = [n for n in self._names() if start["after"] < n <= end["after"]]
        return [Page(tuple(names[k : k + self.page])) for k in range(0, len(names), self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        system, root = _open(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{root}/{name}") as stream:
                try:
                    d = json.loads(stream.read())
                    yield name, d.get("id"), d.get("attempt", 1), d.get("status"), None if d.get("body") is None else json.dumps(d["body"])
                except (ValueError, AttributeError):
                    yield name, None, None, None, None  # not json, or no object: no status, so it is a failure


class PagedDocuments(DataSource):
    """Option path: the landing folder; page: files a partition."""

    @classmethod
    def name(cls) -> str:
        return "paged_documents"

    def schema(self) -> str:
        return "name string, id string, attempt int, status int, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("page", PAGE)))


def documents(spark: SparkSession, path: str, page: int = PAGE) -> DataFrame:
    """Stream of name, id, attempt, status, body."""
    spark.dataSource.register(PagedDocuments)
    return spark.readStream.format("paged_documents").option("path", path).option("page", page).load()


def outcomes(rows: DataFrame) -> DataFrame:
    """id, attempt, outcome, body: done; gone (with the placeholder `{}`); again; failed once MOST_ATTEMPTS are used up."""
    again = F.coalesce(F.col("status").isin(*AGAIN), F.lit(True))
    outcome = F.when(F.col("status") == 200, "done").when(F.col("status") == 404, "gone").when(again & (F.col("attempt") < MOST_ATTEMPTS), "again").otherwise("failed")
    return rows.select("id", "attempt", outcome.alias("outcome"), F.when(F.col("status") == 200, F.col("body")).when(F.col("status") == 404, "{}").alias("body"))


def to_ask(wanted: DataFrame, seen: DataFrame) -> DataFrame:
    """wanted (id), seen (id, attempt, outcome) -> id, attempt: ids never seen, and ids whose last outcome asks for another attempt."""
    last = seen.groupBy("id").agg(F.max("attempt").alias("last"), F.max_by("outcome", "attempt").alias("outcome"))
    return wanted.join(last, "id", "left").filter(F.col("outcome").isNull() | (F.col("outcome") == "again")).select("id", (F.coalesce("last", F.lit(0)) + 1).alias("attempt"))


def grow(batch: DataFrame, number: int, root: str, key: str, least: int) -> bool:
    """Takes one batch in; whether it led to a new snapshot. Rows of keys that the snapshot has are left alone."""
    spark = batch.sparkSession
    last = store.manifest(spark, root)
    held = -1 if last is None else last["notes"]["batch"]
    if number <= held:
        return False  # replayed: the snapshot has it
    batch.write.mode("overwrite").parquet(f"{root}/waiting/{number:09d}")
    waiting = spark.read.schema(batch.schema).parquet(*_waiting(spark, root, held))
    before = store.snapshot(spark, root, batch.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    fresh = waiting.join(before.select(key).distinct(), key, "left_anti").select(*batch.columns)
    if fresh.select(key).distinct().count() < least:
        return False
    store.publish(before.unionByName(fresh), root, notes={"batch": number})
    for path in _waiting(spark, root, held):
        where, system = file_system(spark, path)
        system.delete(where, True)
    return True


def _waiting(spark: SparkSession, root: str, held: int) -> list[str]:
    where, system = file_system(spark, f"{root}/waiting")
    names = sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []
    return [f"{root}/waiting/{n}" for n in names if int(n) > held]


def growing(rows: DataFrame, root: str, key: str, least: int = 10):
    """A writer of the stream `rows` into the snapshot at `root`; give it a trigger and start it."""
    return rows.writeStream.foreachBatch(lambda df, number: grow(df, number, root, key, least) and None).option("checkpointLocation", f"{root}/progress")


def land(rows: DataFrame, path: str) -> int:
    """rows (name, id, attempt, status, body: json) as files; each is written aside and renamed, so a task that is run again writes the same."""

    def run(batches):
        import pyarrow as pa

        system, root = _open(path)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                text = json.dumps({"id": r["id"], "attempt": r["attempt"], "status": r["status"], "body": None if r["body"] is None else json.loads(r["body"])})
                with system.open_output_stream(f"{root}/.{r['name']}") as out:
                    out.write(text.encode())
                system.move(f"{root}/.{r['name']}", f"{root}/{r['name']}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("name", "id", "attempt", "status", "body").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
