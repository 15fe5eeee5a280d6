"""What several operators share: text preparation, durable intermediate tables, fixed-size filters and components."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: str | Column) -> Column:
    """Maximal runs of other characters than SPACES; an empty array for null and blank texts."""
    col = F.col(text) if isinstance(text, str) else text
    bare = F.btrim(F.coalesce(col, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; without one, a local session gets a folder of the warehouse, and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def durable(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: lineage is cut as by durable(), and later steps read only the columns that they use."""
    spark = df.sparkSession
    set_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffles of finished steps now: it does so when the driver's garbage collector finds that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Arrow batches of about this size for what runs within: a batch of texts is held by the JVM and by a worker, in every core, and Spark lets it grow to 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows with one or two short keys that a join may broadcast: some 30 MB.
FEW_KEYS = 300_000


def few(rows: DataFrame, most: int = FEW_KEYS) -> DataFrame:
    """Durable rows, marked for a broadcast if a count shows that they are few; the join with more of them is by a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


# --- fixed-size filters -------------------------------------------------------------------------------------------

#: Bits of a filter: 2^26 are 8 MB, whatever the number of keys.
FILTER_BITS = 26
_PAGE = 32768


def key_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Which values of ``hash mod 2^bits`` occur among the 64-bit keys, as packed bits of a fixed size.

    The tasks build it as bitmaps of 4 KB, of which at most 2^bits / 32768 reach the driver, so its size does not grow
    with the data. A key that is present always hits; with more keys the filter only lets more others through.
    """
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    pages = (
        keys.where(F.col(column).isNotNull())
        .select(slot.alias("slot"))
        .groupBy((F.col("slot") / F.lit(_PAGE)).cast("long").alias("page"))
        .agg(F.bitmap_construct_agg((F.col("slot") % F.lit(_PAGE)).cast("long")).alias("bitmap"))
    )
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in pages.toLocalIterator():
        at = row["page"] * (_PAGE // 8)
        out[at : at + _PAGE // 8] = np.frombuffer(bytes(row["bitmap"]), dtype=np.uint8)
    return out


def hits(filter_bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Mask of the unsigned 64-bit keys that the filter may hold."""
    bits = (len(filter_bits) * 8).bit_length() - 1
    slot = keys >> np.uint64(64 - bits)
    return (filter_bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


# --- hashes ----------------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words, from the hashes of the words."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ word_hashes[i : i + n]
        out = out * np.uint64(0xD6E8FEB86659FD93) + (out >> np.uint64(29))
    return mix(out)


def signed(x: Iterable[int] | np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


# --- connected components --------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected edges (a, b); isolated nodes don't occur.

    Every round lets each node point at its smallest neighbour, doubles the pointers until they all end at a node that has no
    smaller neighbour, and contracts the edges to those ends; at most half of the nodes with edges are left. So both
    loops take a number of steps that grows with the logarithm of the graph, also on long paths. Minima are combined
    before the shuffle, so that hubs cost no more than other nodes; in the joins of pointers the side with one row per
    node is small, and Spark splits the other one where many nodes point at a hub. Each step ends in a checkpoint.
    """
    edges = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = durable(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("x"), F.least("a", "low").alias("p"))
        jump, moving = durable(up.withColumnRenamed("p", "q")), True
        while moving:
            far = jump.select(F.col("x").alias("q"), F.col("q").alias("end"))
            step = durable(jump.join(far, "q").select("x", "q", "end"))
            moving, jump = not step.where("q <> end").isEmpty(), step.select("x", F.col("end").alias("q"))
        labels = durable(
            labels.join(jump, labels["root"] == jump["x"], "left").select("node", F.coalesce("q", "root").alias("root"))
        )
        a = edges.join(jump.withColumnsRenamed({"x": "a", "q": "a2"}), "a").select("a2", "b")
        b = a.join(jump.withColumnsRenamed({"x": "b", "q": "b2"}), "b").select("a2", "b2")
        edges = durable(b.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a < b").distinct())
        del both, up, jump, far, step, a, b
        free(edges.sparkSession)
    return labels


def batches(rows: Iterator, *names: str) -> Iterator[tuple]:
    """The named columns of each Arrow batch as Python lists."""
    for batch in rows:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
