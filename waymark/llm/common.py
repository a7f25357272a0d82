"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import ship
from waymark.shared import shared_dir

#: Operators get Spark's Arrow batches in slices of at most so many rows, and bytes of strings unless one row has more.
SLICE_ROWS, SLICE_BYTES = 2048, 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def set_for(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """For jobs that run inside it, a setting of the session; the one before is put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its work is done once, its lineage is cut, and a lost executor can't lose it.

    The shuffle files that it took go when it's written, rather than when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with set_for(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices bounded in rows and in bytes of strings, so a worker's memory doesn't follow the texts' length."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
            to = max(at + 1, min(at + SLICE_ROWS, full))
            yield batch.slice(at, to - at)
            at = to


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """For jobs that run inside it, Arrow batches of fewer rows, on Spark's side too; the session's setting is put back."""
    with set_for(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship.ensure(df.sparkSession)
    return df.mapInArrow(lambda batches: fn(in_slices(batches)), schema)


def spread_out(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores dealt over all cores, as a file of one row group would else be one task.

    No result depends on it; the names of the files are what Spark's own listing has on the driver.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def plain_documents(docs: DataFrame, *columns: str, spread: bool = True) -> DataFrame:
    """Only the named columns, with the types that operators work on; other columns of docs, whatever their names, don't matter."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"}
    docs = spread_out(docs) if spread else docs
    return docs.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in columns))


@contextmanager
def co_located(df: DataFrame, key: str, buckets: int, label: str) -> Iterator[DataFrame]:
    """df as a table in the shared folder, dealt by key to so many buckets, so that joins on key move only the other side.

    The catalog's entry goes when the block ends; read what is made of the table inside it.
    """
    spark = df.sparkSession
    name = f"waymark_{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(max(1, buckets), key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
