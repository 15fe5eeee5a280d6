"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few short columns that a join may broadcast: some 30 MB.
FEW_ROWS = 300_000


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; without one, a local session gets a folder of the warehouse, and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or spark.conf.get('spark.sql.warehouse.dir').rstrip('/') + '/_shared'}/{name}-{uuid4().hex}"


@contextmanager
def _short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what is run within when it ends, and not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: what made it (a model, say) runs once, a lost executor costs no repetition, and the shuffles that made it leave the disks."""
    path = folder(df.sparkSession, name)
    with _short_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task remembers, to send no repeats of them.
REMEMBERED = 1 << 16


def without_repeats(df: DataFrame, hashes: tuple[str, str], order: tuple[str, ...] = ()) -> DataFrame:
    """df without rows that repeat both hashes of another row of their task that isn't later by ``order`` (two columns of integers, if any); repeats that are far apart in a task, or in different ones, stay.

    This is what a partial aggregate does, but it leaves to the caller by what rows are dealt; a row that very many have is sent some times by each task.
    """
    columns = [df.columns.index(c) for c in (*hashes, *order)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, low = (np.zeros(REMEMBERED, dtype=np.int64) for _ in range(3))
        high = np.full(REMEMBERED, np.iinfo(np.int64).max)
        for batch in rows:
            a, b, *places = (batch.column(k).to_numpy().astype(np.int64) for k in columns)
            hi, lo = places or (np.zeros(len(a), dtype=np.int64),) * 2
            by = np.lexsort((lo, hi, b, a))
            first = by[np.append(True, (np.diff(a[by]) != 0) | (np.diff(b[by]) != 0))[: len(by)]]
            at = (a[first] ^ b[first]) & (REMEMBERED - 1)
            later = (hi[first] > high[at]) | ((hi[first] == high[at]) & (lo[first] >= low[at]))
            first = first[~((one[at] == a[first]) & (two[at] == b[first]) & later)]
            at = (a[first] ^ b[first]) & (REMEMBERED - 1)
            one[at], two[at], high[at], low[at] = a[first], b[first], hi[first], lo[first]
            yield batch.take(pa.array(np.sort(first)))

    return df.mapInArrow(run, df.schema)


def few(rows: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """rows, marked for a broadcast if a count shows that they are few; the join with more of them is by a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key over all cores, for work on each row that is dear; a stream as well.

    How many partitions a table comes in tells nothing: Parquet is cut by bytes but read by row groups, so all rows of a large file may be in one of them.
    Where Spark has shuffle partitions for all cores, it may put small ones together.
    """
    cores, own = df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(key) if own >= cores else df.repartition(cores, key)
