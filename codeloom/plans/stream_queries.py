"""Queries that run a stream over a table to its end, and give what it has written."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import items, memory, storage
from codeloom.plans.base import BLOCKS, blocks, query, table
from codeloom.plans.project_queries import _LOG
from codeloom.plans.text_queries import ITEMS, MERGED, SQUEEZE
from codeloom.streaming import jobs, merging


def _run(spark, d, name, job, mode="append", files=4):
    path, to = f"{d}/{name}[.]parquet", storage.folder(spark, "stream")  # a glob, as a table may be one file
    jobs.run(job(jobs.parquet(spark, path, table(spark, d, name).schema, files)), to, mode)
    return spark.read.parquet(f"{to}/rows")


@query("select 'doc' || doc_id as interview_id, text as transcript from documents")
def g1_incremental_ingest(spark, d):
    return _run(spark, d, "documents", lambda s: s.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("interview_id"), F.col("text").alias("transcript")))


@query(_LOG + """, w as (select *, unnest(range(6)) as k, (floor(epoch(ts) / 10) * 10)::BIGINT as s from log)
select key, make_timestamp((s - k * 10) * 1000000) as start, count(*) as requests, sum(in_tokens)::BIGINT as in_used, sum(out_tokens)::BIGINT as out_used from w
where epoch(ts) - (s - k * 10) < 60 and (s - k * 10 + 60) * 1000 <= (select epoch_ms(max(ts)) from log) - 600000 group by 1, 2""")
def g2_stream_budgets(spark, d):
    """Windows that the watermark has closed. The table is replayed in one batch, as its files may hold events in any order."""
    return _run(spark, d, "events", jobs.budgets, files=1_000_000).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(BLOCKS + "select factor, count(*) as frequency from occ group by 1")
def g3_stream_factor_counts(spark, d):
    return _run(spark, d, "documents", jobs.factor_counts, "complete")


@query(ITEMS + f"select distinct interview_id, lower({SQUEEZE.format('excerpt')}) as excerpt_key, code, rationale from pairs")
def g4_stream_first_pairs(spark, d):
    return _run(spark, d, "conversations", jobs.first_pairs)


def _upserted(spark, d, name, job, *key):
    path, to = f"{d}/{name}[.]parquet", storage.folder(spark, "stream")
    merging.upsert(job(jobs.parquet(spark, path, table(spark, d, name).schema)), to)
    return merging.latest(spark, to, *key)


#: How far an estimate may be off: five times the sketches' mean error, and one document.
_NEAR = f"{5 * 1.04 / 2 ** (merging.SKETCH / 2):.6f}"


@query(BLOCKS + "select factor, count(*) as frequency, count(distinct doc_id) as sources, true as near from occ group by 1")
def g3_stream_factor_sources(spark, d):
    """Counts and sketches of sources as documents arrive, updated by factor; with the exact number of sources, which the estimate must be near."""
    got = merging.sources(_upserted(spark, d, "documents", merging.factor_sources, "factor")).withColumnRenamed("sources", "estimate")
    exact = memory.frequency(blocks(spark, d)).select("factor", "sources")
    near = F.abs(F.col("estimate") - F.col("sources")) <= F.col("sources") * F.lit(float(_NEAR)) + 1
    return got.join(exact, "factor").select("factor", "frequency", "sources", near.alias("near"))


@query(BLOCKS + "select factor, count(distinct doc_id) as sources, true as near from occ group by 1")
def a2_approximate_sources(spark, d):
    """Sources of each factor by sketches that are merged, beside the exact number."""
    b = blocks(spark, d)
    near = F.abs(F.col("estimate") - F.col("sources")) <= F.col("sources") * F.lit(float(_NEAR)) + 1
    return memory.approximate_sources(b).withColumnRenamed("sources", "estimate").join(memory.frequency(b), "factor").select("factor", "sources", near.alias("near"))


@query(MERGED)
def g4_stream_merged_items(spark, d):
    """Items merged across arriving turns by state; at the end the same as the batch operator's."""
    with merging.rocksdb(spark):
        out = _upserted(spark, d, "conversations", merging.merged_items, "interview_id", "key")
    return out.select("interview_id", F.col("turn").cast(table(spark, d, "conversations").schema["turn"].dataType).alias("turn"), F.col("sent").cast("int").alias("sent"), "excerpt", "pairs", "n_items")


@query("""with t as (select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn, text) as t from conversations group by 1)
select 'conv' || conv_id as interview_id, case when conv_id % 10 = 3 then 'failed' else 'processed' end as status, case when conv_id % 10 = 3 then 'blank file' end as error, case when conv_id % 10 <> 3 then md5(t) end as digest from t""")
def g1_file_status(spark, d):
    """Transcripts as files, every tenth one blank, taken in with a status for each; the job is started twice, as after a stop."""
    path, to = storage.folder(spark, "files"), storage.folder(spark, "stream")
    bad = F.regexp_extract("interview_id", r"(\d+)$", 1).cast("long") % 10 == 3
    rows = items.transcripts(table(spark, d, "conversations"))
    rows.select("interview_id", F.when(bad, " ").otherwise(F.col("transcript")).alias("value")).repartition("interview_id").write.partitionBy("interview_id").text(path)
    for _ in range(2):
        merging.ingest_files(spark, f"{path}/*", to, name=F.regexp_extract("path", "interview_id=([^/]+)/", 1))
    texts, log = merging.read_ingested(spark, to)
    return log.join(texts, "interview_id", "left").select("interview_id", "status", "error", F.md5(F.regexp_replace("transcript", "\n$", "")).alias("digest"))
