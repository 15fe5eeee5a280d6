"""A training corpus from raw documents, in five stages, each of which is an operator of codeloom.llm.

Every stage judges rows, each for itself: rows that share a doc_id, or have none, don't decide for one another unless a stage says so. Null texts
are empty ones. An empty table gives an empty table. Further columns are carried along, whatever their names, until the last stage.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, mixing, quality_rules, simhash, token_output
from codeloom.llm.common import read, set_checkpoint_dir


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the risk-controlled quality rules reject.

    Null, empty and short texts (under 20 words) fail the base rules and go. Repeated rows share their verdict. Without labels, or where a language
    has too few of them to bound its false rejections, the base rules alone decide.
    """
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: that with the smallest doc_id.

    Of repeated rows one stays. Rows with a null doc_id stay, as they have no class to speak for. Texts without words are one class.
    """
    return simhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain a test item.

    Texts and items with fewer than five words have no shingles, so such documents stay and such items are in none; without a benchmark all stay.
    """
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh the same, shuffled globally; their numbers follow the Poisson distribution, so one may have no copy.

    A null source is a source of its own. Rows that share a doc_id and a source, or have no doc_id, get the same number of copies each.
    """
    return mixing.replicate(docs, marks=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: where each document's ids start, how many there are, and their checksum.

    A row for every row of docs, in the order of doc_id (null first) and then of texts; an empty text has the end id alone.
    """
    return token_output.digest(token_output.encode(docs))


STAGES = [("quality rules", rules), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("mixing sources", mix), ("token output", tokens)]

#: Fingerprints and token ids have no SQL form; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each stage's rows are written as Parquet in the shared folder and read again."""
    set_checkpoint_dir(spark)
    folder, docs = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}", read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
