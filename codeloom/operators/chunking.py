"""Cutting texts to a size: sentence packing, token budgets, and overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T

MODEL_LIMIT, OUTPUT_LIMIT = 200_000, 8_000
MAX_CHARS, OVERLAP = 30_000, 5_000


def pack_sentences(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Chunks of whole sentences, packed greedily; the blank that joins two sentences isn't counted against the limit.

    A sentence over the limit is a chunk of its own. A text within the limit is one chunk.
    """
    t = F.coalesce(text, F.lit(""))
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc, s):
        over, some = F.length(acc["cur"]) + F.length(s) > max_chars, acc["cur"] != ""
        return F.struct(
            F.when(over & some, F.concat(acc["out"], F.array(acc["cur"]))).when(over, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"),
            F.when(over & some, s).when(over, F.lit("")).when(some, F.concat(acc["cur"], F.lit(" "), s)).otherwise(s).alias("cur"),
        )

    packed = F.aggregate(
        T.sentences(t), state, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"])
    )
    return F.when(F.length(t) <= max_chars, F.array(t)).otherwise(packed)


def chunks(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, part, n_parts, chunk), parts from 1."""
    own = docs.select("doc_id", pack_sentences(F.col("text"), max_chars).alias("c"))
    return own.select("doc_id", F.size("c").alias("n_parts"), F.posexplode("c").alias("k", "chunk")).select(
        "doc_id", (F.col("k") + 1).alias("part"), "n_parts", "chunk"
    )


def truncate(docs: DataFrame, budget: int) -> DataFrame:
    """(doc_id, text, tokens): leading sentences while the sum of their token estimates stays within the budget.

    The whole text is kept if its own estimate fits. All work is in the row: the sentences are folded to how many fit.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), T.sentences(F.col("text")).alias("s"), T.tokens_by_words(F.col("text")).alias("all"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(acc, n):
        full = acc["full"] | (acc["used"] + n > budget)
        return F.struct(F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.when(full, acc["used"]).otherwise(acc["used"] + n).alias("used"), full.alias("full"))

    folded = own.withColumn("k", F.aggregate(F.transform("s", lambda x: T.tokens_by_words(x)), start, step))
    fits = F.col("all") <= budget
    head = F.array_join(F.slice("s", F.lit(1), F.col("k.n")), " ")
    return folded.select("doc_id", F.when(fits, F.col("text")).otherwise(head).alias("text"), F.when(fits, F.col("all")).otherwise(F.col("k.used")).cast("long").alias("tokens"))


def transcript_budget(static: Column, output: int = OUTPUT_LIMIT, limit: int = MODEL_LIMIT) -> Column:
    """Tokens left for a transcript after prompt, output and a tenth for safety; 5,000 at least."""
    return F.greatest(F.lit(limit - output - int(limit * 0.1)) - static, F.lit(5000))


def window_bounds(text: str, max_chars: int, overlap: int = OVERLAP, mode: str = "parity") -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows of a text.

    A window ends after the last sentence end within its reach, else at the last blank, else at its full length. Mode
    ``parity`` steps back by the overlap only where the text left over is no longer than what lies behind (as it comes out: after the first window
    and near the end); ``uniform`` steps back after every window.
    """
    n, out, start = len(text), [], 0
    if n <= max_chars:
        return [(0, n)]
    while start < n:
        stop = start + max_chars
        if stop >= n:
            out.append((start, n))
            break
        cut = max(text.rfind(a + b, start, stop) for a in ".!?" for b in " \n") - start
        if cut > 0:
            stop = start + cut + 2
        else:
            blank = text.rfind(" ", start, stop)
            stop = blank if blank > start else stop
        out.append((start, stop))
        width, begin = stop - start, stop - overlap
        if begin <= start or (mode == "parity" and len(out) > 1 and begin <= n - width):
            begin = stop  # an overlap that makes no progress is left out
        start = begin
    return out


def _windows(max_chars: int, overlap: int, mode: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, parts, starts, ends, texts = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (a, b) in enumerate(window_bounds(text or "", max_chars, overlap, mode), 1):
                    ids.append(doc)
                    parts.append(k)
                    starts.append(a)
                    ends.append(b)
                    texts.append((text or "")[a:b])
            yield pa.record_batch(
                {"doc_id": pa.array(ids, batch.column(0).type), "part": pa.array(parts, pa.int32()), "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64()), "chunk": pa.array(texts, pa.string())}
            )

    return run


def overlapping(docs: DataFrame, max_chars: int = 18_000, overlap: int = OVERLAP, mode: str = "parity") -> DataFrame:
    """(doc_id, part, start, end, chunk) of every document's windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_windows(max_chars, overlap, mode), f"doc_id {kind}, part int, start long, end long, chunk string")
