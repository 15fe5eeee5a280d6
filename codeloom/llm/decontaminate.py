"""Benchmark decontamination: documents that contain test items, by size-partitioned MinHash containment search.

An item is contained in a document if the document has at least the share THRESHOLD of the item's distinct five-word
shingles; words are runs of letters and digits in lower case, so that punctuation and white space don't matter. Jaccard
similarity between a short item and a long document says nothing, so the search is one-sided: items are partitioned
by size (powers of two of their shingle counts), and each size class has a sketch length s: an item keeps the s shingles
that come first, those that few items have before others, by hash among equals (its bottom-s MinHash). s is the largest q - ceil(THRESHOLD q) + 1
among the class's sizes q. A document that contains the item misses at most q - ceil(THRESHOLD q) of its shingles, so it has
s - q + ceil(THRESHOLD q) of the sketch at least, which is one or more: documents that meet fewer of a sketch's shingles are
no candidates, and no others are compared.

Tasks find documents that may meet a sketch with a filter of fixed size made from the sketches, and emit the shingles that a
second such filter, of all the items' shingles, lets pass. Joins on sketch hashes give the candidate pairs of document and item; the distinct
shingles in common are counted, by their texts, for these pairs alone. So a phrase that many items and documents have
makes no pairs by itself, and neither the benchmark nor a document is ever held whole in one place.

Nulls and texts with fewer than five words have no shingles: such items are in no document, such documents contain none.
Rows that repeat a doc_id are treated as one document that has the shingles of all of them, repeated item ids likewise.
A null doc_id or item_id takes part like any other value. Empty tables give an empty result. Further columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import durable, few, hits, key_filter, shingle_hashes, signed

WIDTH, THRESHOLD = 5, 0.8
_WORD = re.compile(r"[^\W_]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashes(w: list[str]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    return shingle_hashes(h, WIDTH)


def _item_shingles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids, hs, texts = [], [], []
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = _words(x)
            h = _hashes(w)
            ids += [i] * len(h)
            hs.append(signed(h))
            texts += [" ".join(w[k : k + WIDTH]) for k in range(len(h))]
        yield pa.record_batch({"item_id": pa.array(ids, pa.int64()), "h": pa.array(np.concatenate(hs) if hs else [], pa.int64()), "shingle": pa.array(texts, pa.string())})


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, size_class, needed, h): the sketch of every item, as long as its size class takes, and how many of it a document must have.

    The first shingles of an item are found by one sort of its own distinct shingles, that is of one test item.
    """
    common = shingles.groupBy("h").agg(F.floor(F.log2(F.count_distinct("item_id") + 1)).cast("int").alias("common"))
    by_item = shingles.join(common, "h").groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct("common", "h"))).alias("hs"))
    sized = by_item.withColumn("size_class", F.floor(F.log2(F.size("hs"))).cast("int"))
    misses = lambda q: F.floor(q * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")
    # the longest sketch that a size 2^c .. 2^(c+1) - 1 needs
    kept = F.slice("hs", F.lit(1), misses(F.pow(F.lit(2.0), F.col("size_class") + 1) - 1) + 1)
    needed = F.size("kept") - misses(F.size("hs"))
    return sized.withColumn("kept", kept).select("item_id", "size_class", needed.alias("needed"), F.explode("kept").alias("k")).select("item_id", "size_class", "needed", "k.h")


def _shared(sketch_filter: np.ndarray | None, all_filter: np.ndarray, kind: pa.DataType):
    """The shingles of each row that items may have; without a sketch filter also of rows that don't meet a sketch themselves."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys, hs, texts, flags = [], [], [], []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = _words(x)
                if len(w) < WIDTH:
                    continue
                h = _hashes(w)
                sketched = np.zeros(len(h), dtype=bool) if sketch_filter is None else hits(sketch_filter, h)
                if sketch_filter is not None and not sketched.any():
                    continue
                at = np.flatnonzero(hits(all_filter, h))
                own = dict(zip((" ".join(w[k : k + WIDTH]) for k in at), zip(signed(h)[at].tolist(), sketched[at].tolist(), strict=True), strict=True))
                keys += [key] * len(own)
                texts += own
                hs += [v for v, _ in own.values()]
                flags += [f for _, f in own.values()]
            yield pa.record_batch({"key": pa.array(keys, kind), "h": pa.array(hs, pa.int64()), "shingle": pa.array(texts, pa.string()), "sketched": pa.array(flags, pa.bool_())})

    return run


def _contained(texts: DataFrame, items: DataFrame, threshold: float, one_text: bool = False) -> DataFrame:
    """(key, item_id, n_shared, n_shingles) of every contained item, exactly, for texts(key, text); keys are numbers or strings.

    ``one_text`` says that rows of the same key have the same text. Else the other rows of a key whose row meets a sketch are
    read as well, as the item may be spread over them; which keys repeat is counted from the keys alone.
    """
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    shingles = durable(own.mapInArrow(_item_shingles, "item_id long, h long, shingle string").distinct())
    chosen = durable(sketches(shingles, threshold))
    kind = texts.schema["key"].dataType.simpleString()
    arrow, columns, of_items = pa.string() if kind == "string" else pa.int64(), f"key {kind}, h long, shingle string, sketched boolean", key_filter(shingles, "h")
    shared = durable(texts.mapInArrow(_shared(key_filter(chosen, "h"), of_items, arrow), columns).distinct())
    if not one_text:
        repeated = texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("again"))
        spread = durable(shared.select("key").distinct().join(repeated, F.col("key").eqNullSafe(F.col("again"))).select("again"))
        if not spread.isEmpty():
            rest = texts.join(few(spread), F.col("key").eqNullSafe(F.col("again")), "left_semi").mapInArrow(_shared(None, of_items, arrow), columns)
            shared = durable(shared.unionAll(rest).groupBy("key", "h", "shingle").agg(F.max("sketched").alias("sketched")))
    met = shared.where("sketched").join(chosen, "h").groupBy("key", "item_id").agg(F.count("*").alias("met"), F.first("needed").alias("needed")).where("met >= needed")
    pairs = met.select(F.col("key").alias("doc"), F.col("item_id").alias("item"))
    both = pairs.join(shared.select("key", "shingle"), F.col("doc").eqNullSafe(F.col("key")))
    of_item = shingles.select(F.col("item_id"), F.col("shingle").alias("text")).distinct()
    same = both.join(of_item, F.col("item").eqNullSafe(F.col("item_id")) & (F.col("shingle") == F.col("text")))
    counted = same.groupBy("doc", "item").agg(F.count("*").alias("n_shared"))
    sizes = of_item.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    out = counted.join(sizes, F.col("item").eqNullSafe(F.col("item_id"))).select(F.col("doc").alias("key"), "item_id", "n_shared", "n_shingles")
    return out.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9)))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every contained item, exactly.

    docs has doc_id and text, items has item_id and text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    share = (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    return _contained(texts, items, threshold).select(F.col("key").alias("doc_id"), "item_id", "n_shared", "n_shingles", share)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text contains an item.

    Each row is judged by its own text, known by its digest: rows that share an id, or have none, don't reject one another.
    The digests of rejected texts are broadcast if they are few, and else joined by a shuffle.
    """
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = docs.select(digest.alias("key"), F.col("text").cast("string").alias("text"))
    leaks = durable(_contained(texts, items, threshold, one_text=True).select(F.col("key").alias("leak")).distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest.alias("digest"))  # one column: no name can clash
    return rows.join(few(leaks), F.col("digest") == F.col("leak"), "left_anti").select("row.*")
