"""The same data work on arriving input, as Structured Streaming jobs.

Budgets are windows under a watermark: in append mode a window is written when it closes and its state is dropped. Where rows have
no time, state grows with the result: factor_counts() keeps a row per factor, first_pairs() one per distinct pair. With a
time column, first_pairs() keeps pairs only as long as its watermark says. Every job takes a streaming DataFrame and
gives one; run() drives it to the end of what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import budget, chains, items, storage


def parquet(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def transcripts(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """(interview_id, transcript) of .txt files as they arrive; the checkpoint remembers those done."""
    rows = spark.readStream.option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files).text(path, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("interview_id"), F.col("value").alias("transcript"))


def budgets(events: DataFrame, late: str = "10 minutes", window: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """(key, start, requests, in_used, out_used) in sliding windows; windows older than the latest time less ``late`` are closed."""
    log = budget.request_log(events.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", late)
    used = log.groupBy(F.window("ts", window, slide).alias("w"), "key").agg(
        F.count("*").alias("requests"), F.sum("in_tokens").alias("in_used"), F.sum("out_tokens").alias("out_used")
    )
    return used.select("key", F.col("w.start").alias("start"), "requests", "in_used", "out_used")


def factor_counts(docs: DataFrame) -> DataFrame:
    """(factor, frequency) so far; a row of state per factor."""
    return chains.occurrences(chains.annotate(storage.spread(docs, "doc_id"))).groupBy("factor").agg(F.count("*").alias("frequency"))


def first_pairs(conversations: DataFrame, time: str | None = None, late: str = "1 day") -> DataFrame:
    """(interview_id, excerpt_key, code, rationale): coded pairs, each the first time that it arrives; with a time column, the first time within ``late``."""
    from codeloom.functions import text as T

    keep = [time] if time else []
    rows = items.annotate(conversations, *keep).select("interview_id", *keep, T.fingerprint(F.col("excerpt")).alias("excerpt_key"), F.explode("pairs").alias("p"))
    pairs, key = rows.select("interview_id", "excerpt_key", "p.code", "p.rationale", *keep), ["interview_id", "excerpt_key", "code", "rationale"]
    return pairs.withWatermark(time, late).dropDuplicatesWithinWatermark(key).drop(time) if time else pairs.dropDuplicates(key)


def run(stream: DataFrame, to: str, mode: str = "append") -> None:
    """Process everything that is there into Parquet at ``to``; complete results overwrite what was there."""
    writer = stream.writeStream.option("checkpointLocation", f"{to}/_state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{to}/rows").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{to}/rows")).start()
    query.awaitTermination()
