"""Snapshots that are published whole: rows are written to a folder of their own, audited by what was observed while they were written, and
become the snapshot with one rename of a manifest. Readers see the last manifest's rows; a writer that dies or fails its audit changes nothing.

root/data/<id>: the rows of a version; root/manifests/<number>.json: its count, schema, observed values and notes. Two writers of one number
cannot both rename; the later one gets Conflict. The folder must be in a file system whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tipoff.sources.staged import file_system, removed


class Rejected(ValueError):
    """The audit's reason."""


class Conflict(RuntimeError):
    """Another writer has published since."""


def _numbers(spark: SparkSession, root: str) -> list[int]:
    where, system = file_system(spark, f"{root}/manifests")
    if not system.exists(where):
        return []
    names = [s.getPath().getName() for s in system.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    """The manifest of the last version, or of the one asked for; None where there is none."""
    numbers = _numbers(spark, root)
    if not numbers or number is not None and number not in numbers:
        return None
    number = numbers[-1] if number is None else number
    where, system = file_system(spark, f"{root}/manifests/{number:09d}.json")
    stream = system.open(where)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return json.loads(text) | {"number": number}


def snapshot(spark: SparkSession, root: str, schema: str, number: int | None = None) -> DataFrame:
    """The published rows, or none of `schema`. A version's files never change, so the rows stay readable while others publish."""
    found = manifest(spark, root, number)
    if found is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{root}/{found['data']}")


def publish(rows: DataFrame, root: str, audit: Callable[[dict, dict | None], str | None] = lambda seen, before: None, observed: dict[str, Column] | None = None, notes: dict | None = None, drop: tuple[str, ...] = ()) -> dict:
    """Write, audit and publish `rows`; gives the new manifest. observed: aggregates taken while writing, beside `rows`, their count; columns
    of `drop` are for these only. audit(observed, last manifest) gives a reason not to publish, or None."""
    spark = rows.sparkSession
    before = manifest(spark, root)
    seen, data = Observation(), f"data/{uuid.uuid4().hex}"
    rows.observe(seen, F.count("*").alias("rows"), *(c.alias(n) for n, c in (observed or {}).items())).drop(*drop).write.parquet(f"{root}/{data}")
    values = dict(seen.get)
    if (reason := audit(values, before)) is not None:
        removed(spark, f"{root}/{data}")
        raise Rejected(reason)
    number = 0 if before is None else before["number"] + 1
    made = {"data": data, "schema": json.loads(rows.drop(*drop).schema.json()), "observed": values, "notes": notes or {}}
    _renamed(spark, root, number, json.dumps(made))
    return made | {"number": number}


def _renamed(spark: SparkSession, root: str, number: int, text: str) -> None:
    jvm = spark._jvm
    part, system = file_system(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    stream = system.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    whole = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{number:09d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(part, whole, options)  # without OVERWRITE: fails where the number is taken
    except Exception as error:
        system.delete(part, False)
        if system.exists(whole):
            raise Conflict(f"version {number} was published by another writer") from error
        raise


def swept(spark: SparkSession, root: str, keep: int = 2, older_than_ms: int = 86_400_000) -> int:
    """Removes manifests but the last `keep`, and data that no manifest names and that is old enough not to be a running writer's. How many folders went."""
    numbers = _numbers(spark, root)
    for n in numbers[:-keep]:
        where, system = file_system(spark, f"{root}/manifests/{n:09d}.json")
        system.delete(where, False)
    named = {manifest(spark, root, n)["data"] for n in numbers[-keep:]}
    where, system = file_system(spark, f"{root}/data")
    gone = 0
    for status in system.listStatus(where) if system.exists(where) else []:
        if f"data/{status.getPath().getName()}" not in named and spark._jvm.System.currentTimeMillis() - status.getModificationTime() >= older_than_ms:
            system.delete(status.getPath(), True)
            gone += 1
    return gone
