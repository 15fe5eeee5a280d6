"""From texts to coded tables through a model: chunks, answers, validation, parsing, and one result for each text.

``call`` is a function (id, scope, text) -> text, as in annotator.annotate(). Its answers are written before anything
else is done with them, so that a model is asked once for each chunk. Chunks whose calls fail are in the log and are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import annotator, chunking, items, storage, tagged

Call = Callable[[str, str, str], str]


def _part_id(ref: str, part: str, parts: str):
    return F.concat(F.col(ref), F.when(F.col(parts) > 1, F.concat(F.lit("_part"), F.col(part).cast("string"))).otherwise(F.lit("")))


def code_documents(docs: DataFrame, call: Call, max_chars: int = chunking.MAX_CHARS) -> tuple[DataFrame, DataFrame]:
    """(ref, tagged) of documents(doc_id, text), and the log (ref, part, status, error) of their chunks.

    A long document is asked for in chunks of whole sentences; the chunks' blocks follow each other under the header of the
    first, with the document's own reference.
    """
    cut = chunking.chunks(docs, max_chars).withColumn("ref", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    asked = cut.select(_part_id("ref", "part", "n_parts").alias("id"), F.lit("").alias("scope"), "part", F.col("chunk").alias("text"))
    answers = storage.written(annotator.annotate(asked, call), "answers")
    ref = F.regexp_replace("id", r"_part\d+$", "")
    sound = tagged.validated(answers.where("status = 'ok'").select(F.col("id").alias("ref"), "part", F.coalesce("output", F.lit("")).alias("answer")))
    bodies = F.transform(F.regexp_extract_all("output", F.lit(tagged.BLOCK), F.lit(1)), lambda b: F.concat(F.lit("[-begin-]"), b, F.lit("[-end-]")))
    heads = F.regexp_extract("output", r"(?s)^.*?\[-end_header-\]", 0)
    parts = sound.select(F.regexp_replace("ref", r"_part\d+$", "").alias("doc_id"), "part", heads.alias("header"), bodies.alias("blocks"))
    whole = tagged.combine(parts)
    text = F.concat("header", F.lit("\n\n"), F.array_join("blocks", "\n\n"))
    return whole.select(F.col("doc_id").alias("ref"), text.alias("tagged")), answers.select(ref.alias("ref"), "part", "status", "error")


def code_interviews(transcripts: DataFrame, call: Call, scopes: list[str], max_chars: int = 18_000, overlap: int = chunking.OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(interview_id, turn, sent, excerpt, pairs, n_items) of transcripts(interview_id, transcript), and the log of their windows.

    Every window is asked for once in each scope, and the scopes' items are put together. Items with the same excerpt become one;
    those whose excerpt doesn't stand in the transcript are left out. turn is the window's number in its scope, sent the item's in its answer.
    """
    windows = chunking.overlapping(transcripts.select(F.col("interview_id").alias("doc_id"), F.col("transcript").alias("text")), max_chars, overlap)
    scoped = windows.select("doc_id", "part", "chunk", F.posexplode(F.array(*map(F.lit, scopes))).alias("k", "scope"))
    asked = scoped.select(F.concat("doc_id", F.lit("_part"), F.col("part").cast("string")).alias("id"), "scope", (F.col("k") * F.lit(1 << 20) + F.col("part")).cast("int").alias("part"), F.col("chunk").alias("text"))
    answers = storage.written(annotator.annotate(asked, call), "answers")
    own = F.regexp_replace("id", r"_part\d+$", "")
    rows = answers.where("status = 'ok'").select(own.alias("own"), "part", T.without_part(F.coalesce("output", F.lit("")), own).alias("syn"))
    found = items.parse(rows.select(F.struct("own", "part").alias("interview_id"), "syn"))
    flat = found.select(F.col("interview_id.own").alias("interview_id"), F.col("interview_id.part").alias("turn"), F.col("item_seq").alias("sent"), "excerpt", "pairs")
    held = items.literal(items.merged(items.checked(flat).where("accepted").select(*flat.columns)), transcripts)
    return held.where("is_valid").drop("is_valid", "score"), answers.select(own.alias("interview_id"), "scope", "part", "status", "error")
