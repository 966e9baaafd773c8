"""Shared helpers of the training-data operators: reading, typed Arrow maps, shared-folder tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. A session on one machine may leave it unset; a cluster may not."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tipoff-ckpt-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back, so that nothing above it runs twice or after a lost executor."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(the table written, its path), for a table that is removed once nothing reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of written_at()."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with per-task set-up: `make()` runs once in each task and gives the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def chunks(texts: list, most: int = 1_000_000):
    """Slices of about `most` characters."""
    start, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= most:
            yield texts[start : k + 1]
            start, n = k + 1, 0
    if start < len(texts):
        yield texts[start:]


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def bucket_of(doc_id, n: int):
    """crc32(doc_id as text) mod n, as a column: the fold rule of the labelled queries."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
