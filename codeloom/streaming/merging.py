"""Streams whose results change as input arrives: tables that are updated by key, merged items, and files with their status.

Every batch writes what it changes into a folder of its own, named by the batch's number. A batch that is repeated after a failure
overwrites its folder, so each change counts once; reading takes the last change of each key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from codeloom.functions import text as T
from codeloom.operators import chains, items, storage

#: log2 of a sketch's buckets: its estimates are off by 1.04 / sqrt(2^12), some 1.6 %, on average.
SKETCH = 12


# --- tables that are updated by key ---------------------------------------------------------------------------------


def upsert(stream: DataFrame, to: str, name: str = "rows") -> None:
    """Run a stream in update mode to the end of what is there; each batch's changed rows go to ``to``/name/batch=N."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{to}/{name}/batch={batch}")

    stream.writeStream.option("checkpointLocation", f"{to}/_state").outputMode("update").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def latest(spark: SparkSession, to: str, *key: str, name: str = "rows") -> DataFrame:
    """The last change of each key of what upsert() has written."""
    rows = spark.read.parquet(f"{to}/{name}")
    others = [c for c in rows.columns if c not in (*key, "batch")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return last.select(*key, "r.*")


def factor_sources(docs: DataFrame) -> DataFrame:
    """(factor, frequency, sketch) so far: occurrences, and a sketch of the documents that have the factor.

    The state of a factor is a number and a sketch of bounded size, however many documents there are. Sketches of parts of a
    corpus can be merged (hll_union_agg); sources() turns them into numbers.
    """
    own = chains.occurrences(chains.annotate(storage.spread(docs, "doc_id"))).groupBy("factor")
    return own.agg(F.count("*").alias("frequency"), F.hll_sketch_agg("doc_id", SKETCH).alias("sketch"))


def sources(rows: DataFrame) -> DataFrame:
    """rows with sources, an estimate, in place of sketch."""
    return rows.withColumn("sources", F.hll_sketch_estimate("sketch")).drop("sketch")


# --- items merged across arriving chunks ------------------------------------------------------------------------------

_MERGED = "interview_id string, key string, turn long, sent long, excerpt string, pairs string, n_items long"


class MergeItems(StatefulProcessor):
    """One item for each excerpt of an interview, as operators.items.merged() makes it, whatever order its parts arrive in.

    State is one value, as each call of the state store is a message of its own: the first item's place and spelling, and each place of the (code, rationale) pairs that
    count, all of the first item's and the first one of others. With a time to live, what had no change for so long is forgotten.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", "item string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values: TimerValues) -> Iterator[Row]:
        held = self.item.get()
        first, before = json.loads(held[0]) if held else (None, [])
        start, places = (tuple(first) if first else None), {}
        new = sorted(((r.turn, r.sent, r.excerpt, [(q["code"], q["rationale"]) for q in r.pairs or ()]) for r in rows), key=lambda x: x[:2])
        for turn, sent, excerpt, _ in new:
            n = (start[3] if start else 0) + 1
            start = (turn, sent, excerpt, n) if start is None or (turn, sent) < start[:2] else (*start[:3], n)
        found = [((turn, sent, p), pair) for turn, sent, _, pairs in new for p, pair in enumerate(pairs)]
        for place, pair in [*((tuple(place), tuple(pair)) for place, pair in before), *found]:
            own = places.setdefault(pair, set())
            own.add(place)
        # of each pair its first place, and all of its places in the first item
        kept = sorted(((place, pair) for pair, own in places.items() for place in own if place[:2] == start[:2] or place == min(own)), key=lambda x: (x[0], str(x[1])))
        self.item.update((json.dumps([start, kept]),))
        text = "|".join(f"{code}={why}" for _, (code, why) in kept if code is not None and why is not None)
        yield Row(interview_id=key[0], key=key[1], turn=start[0], sent=start[1], excerpt=start[2], pairs=text, n_items=start[3])

    def close(self) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State that may outgrow memory, and that state variables need: streams that start in this context keep it in RocksDB."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def merged_items(conversations: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(interview_id, key, turn, sent, excerpt, pairs, n_items) of items that arriving turns add to or make; pairs as text. Needs update mode and the RocksDB state store."""
    rows = items.annotate(conversations)
    own = F.when(T.fingerprint(F.col("excerpt")) == "", F.concat_ws(":", F.lit("\0"), "turn", "sent")).otherwise(T.fingerprint(F.col("excerpt")))
    keyed = rows.select("interview_id", own.alias("key"), F.col("turn").cast("long").alias("turn"), F.col("sent").cast("long").alias("sent"), "excerpt", "pairs")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return keyed.groupBy("interview_id", "key").transformWithState(MergeItems(ttl_ms), outputStructType=_MERGED, outputMode="Update", timeMode=mode)


# --- files with their status ------------------------------------------------------------------------------------------


def _stem() -> Column:
    """A file's name without its ending."""
    return F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")


#: Bytes of files that a batch takes in: a batch has a fixed cost, so small files must not cost one for each few of them.
BATCH_BYTES = 256 << 20


def ingest_files(spark: SparkSession, path: str, to: str, files: int | None = None, name: Column | None = None) -> None:
    """Transcripts of the .txt files in a folder into ``to``/transcripts, and a row for each file, good or bad, into ``to``/log.

    A file fails if it is blank or isn't valid UTF-8; its row of the log says why, and the others go on. Files without a byte are
    passed over by Spark's sources and have no row. Files are read as bytes, so that a bad one can't end the job. Both tables get a folder for each batch: a repeated batch overwrites both, so after a restart every file is in
    them once. read_ingested() reads them. Interviews are called by ``name``, an expression of the column path, or else as the files are. A batch takes so
    many files, or without a number those of BATCH_BYTES.
    """
    kind = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "*.txt").option(*(("maxBytesPerTrigger", BATCH_BYTES) if files is None else ("maxFilesPerTrigger", files))).load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    error = F.when(F.col("transcript").isNull(), "not valid UTF-8").when(F.trim(F.regexp_replace("transcript", r"\s+", " ")) == "", "blank file")
    rows = source.select(F.url_decode(_stem() if name is None else name).alias("interview_id"), text.alias("transcript"), "length").withColumn("error", error)

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        df.where("error is null").select("interview_id", "transcript").write.mode("overwrite").parquet(f"{to}/transcripts/batch={batch}")
        status = F.when(F.col("error").isNull(), "processed").otherwise("failed")
        df.select("interview_id", status.alias("status"), "error", F.col("length").alias("bytes")).write.mode("overwrite").parquet(f"{to}/log/batch={batch}")
        df.unpersist()

    rows.writeStream.option("checkpointLocation", f"{to}/_state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def read_ingested(spark: SparkSession, to: str) -> tuple[DataFrame, DataFrame]:
    """(transcripts, log) that ingest_files() has written so far."""
    return spark.read.parquet(f"{to}/transcripts").drop("batch"), spark.read.parquet(f"{to}/log").drop("batch")
