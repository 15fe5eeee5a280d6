"""Importance resampling towards a target text: documents whose words are more usual in the target than in the corpus are drawn more often.

Features are the runs of one to ``longest`` consecutive words of a text; a feature's bucket is the CRC-32 of its bytes. The distinct
words of a block of texts, with a delimiter on either side, are an Aho-Corasick dictionary with the word's CRC-32 and its length as
payloads. One scan of the block emits the payload of each word in order; the CRC of a run is composed from the payloads of neighbours,
as that of two joined strings follows from theirs and the length of the second. So no run of words is ever built as a string.
Blocks have a bounded size (a longer text is a block of its own), and so has their dictionary.

The buckets of each document are written once. Their counts in the corpus and in the target, a table of fixed size, give each bucket a gain,
the rounded logarithm of its smoothed likelihood ratio. A document's weight is the mean gain of its features. With Gumbel noise that a
hash of doc_id gives, the documents of highest score are a draw without replacement by weight. Scores are whole numbers of a bounded range,
so their histogram gives the lowest drawn score, and how many documents stand above each score; only drawn ones are sorted, each
score for itself.

Null texts have no words. A null doc_id hashes like the text "null", and comes last among ties. Rows that repeat a doc_id are documents each, and tie in any order where their
scores agree. Empty tables are allowed on both sides: without a target text all gains come from the corpus. Further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import written

LONGEST, BUCKETS, SEED = 1, 10_000, 2024
#: Documents of fewer words aren't drawn; percent of the others that are.
LEAST_WORDS, PERCENT = 20, 10
#: Bytes of text in a block.
BLOCK = 6 << 20

#: Lower case for A to Z; a space for the other ASCII characters that words don't have.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_POLYNOMIAL = np.uint32(0xEDB88320)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, whose bits are kept in reverse order (the highest stands for 1)."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLYNOMIAL, np.uint32(0))
    return out


def _powers(lengths: np.ndarray) -> np.ndarray:
    """x to the power of 8 * length, for each length."""
    out, square = np.full(len(lengths), 1 << 31, dtype=np.uint32), np.array([1 << 23], dtype=np.uint32)
    for bit in range(int(lengths.max(initial=0)).bit_length()):
        out = np.where(lengths >> bit & 1, _product(out, np.broadcast_to(square, out.shape)), out)
        square = _product(square, square)
    return out


def joined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of strings put together, from those of both parts and the bytes of the right one."""
    values, which = np.unique(lengths, return_inverse=True)
    return _product(left, _powers(values)[which]) ^ right


class Dictionary:
    """The distinct words of a block, each between two spaces, with their CRC-32 and length."""

    def __init__(self, block: bytes):
        words = list(set(block.split()))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        self.automaton.make_automaton()
        self.crc = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
        self.length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))

    def scan(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, CRC-32, length) of each word of the block, in order."""
        if not len(self.crc):
            return np.zeros(0, dtype=np.int64), self.crc, self.length
        ends, which = zip(*self.automaton.iter(block.decode("latin-1")), strict=True)
        which = np.array(which, dtype=np.int64)
        return np.array(ends, dtype=np.int64), self.crc[which], self.length[which]


def block_features(texts: list[bytes], longest: int = LONGEST) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for runs of one word, two words and so on the number of its text and its CRC-32 for each run."""
    block = b" " + b" ".join(texts) + b" "
    ends, crc, length = Dictionary(block).scan(block)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), ends, side="left")
    runs, of, tail = [(text, crc)], text, crc
    for k in range(1, longest):  # one word more at the end of each run, if it is in the same text
        same = of[: len(crc) - k] == text[k:]
        spaced = joined(tail[: len(same)], np.full(len(same), zlib.crc32(b" "), dtype=np.uint32), np.ones(len(same), dtype=np.int64))
        tail = joined(spaced, crc[k:], length[k:])
        of = np.where(same, text[k:], -1)
        runs.append((of[same], tail[same]))
    return np.bincount(text, minlength=len(texts)), runs


def _blocks(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes]]]:
    """Neighbouring rows with folded texts of ``size`` bytes in all, or with one longer text."""
    ids, texts, held = [], [], 0
    for batch in rows:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            folded = (text.as_py() or "").encode("utf-8").translate(_FOLD)
            if held and held + len(folded) > size:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc_id)
            texts.append(folded)
            held += len(folded) + 1
    if ids:
        yield ids, texts


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the buckets of a text's features as little-endian uint32, each run's as often as it occurs."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(rows, BLOCK):
            n_words, runs = block_features(texts, longest)
            of, crc = (np.concatenate(x) for x in zip(*runs, strict=True))
            order = np.argsort(of, kind="stable")
            n = np.bincount(of, minlength=len(texts))
            found = (crc[order] % np.uint32(buckets)).astype("<u4").tobytes()
            ends = 4 * np.concatenate(([0], np.cumsum(n)))
            kept = pa.array([found[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(n, pa.int64()), "buckets": kept})

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets that occur; a task sends a row for each of them at most."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in rows:
            for x in batch.column(0):
                n += np.bincount(np.frombuffer(x.as_py(), dtype="<u4"), minlength=buckets)
        found = np.flatnonzero(n)
        yield pa.record_batch({"bucket": pa.array(found.astype(np.int32)), "n": pa.array(n[found])})

    return featured.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Whole thousandths of the logarithm of each bucket's likelihood ratio, from the counts of both sides; one row for each bucket comes to the driver."""
    both = corpus.withColumn("t", F.lit(0)).withColumnRenamed("n", "s").unionByName(target.withColumn("s", F.lit(0)).withColumnRenamed("n", "t"))
    counts = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toPandas()
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[counts["bucket"]], t[counts["bucket"]] = counts["s"], counts["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """featured without its buckets, but with weight: the mean gain of its features, rounded down."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sums = np.array([int(gain[np.frombuffer(x.as_py(), dtype="<u4")].sum()) for x in batch.column(3)], dtype=np.int64)
            n = batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.record_batch([*batch.columns[:3], pa.array(np.where(n > 0, sums // np.maximum(n, 1), 0))], names=["doc_id", "n_words", "n_features", "weight"])

    return featured.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """weighed with score: the weight and thousandths of Gumbel noise from a hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u))))


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (a written table) with rank: 1 for the highest score among texts of enough words, up to so many percent of them; null for the others."""
    spark, fit = rows.sparkSession, F.col("n_words") >= least_words
    counts = rows.where(fit).groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False, ignore_index=True)
    above = counts["n"].cumsum() - counts["n"]
    take = int(counts["n"].sum()) * percent // 100
    drawn = counts[["score"]].assign(above=above)[above < take].astype("int64")
    known = spark.createDataFrame(list(drawn.itertuples(index=False, name=None)), "score long, above long")
    marked = rows.withColumn("_fit", F.when(fit, F.col("score"))).join(F.broadcast(known.withColumnRenamed("score", "_fit")), "_fit", "left")  # as many rows as scores have values
    ties = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    place = F.col("above") + F.row_number().over(ties)
    first = marked.where("above is not null").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    rest = marked.where("above is null").withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document of docs (doc_id, text); target has text."""
    featured = written(features(docs, longest, buckets), "features")
    goal = features(target.select(F.lit(None).alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(featured, buckets), bucket_counts(goal, buckets), buckets)
    return draw(written(scored(weigh(featured, gain), seed), "features"), percent, least_words)
