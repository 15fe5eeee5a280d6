"""SimHash near-duplicate classes, found with pivot distance tables.

A document's fingerprint has 64 bits: bit i is set if it is set in more than half of the hashes of the document's
three-word shingles. Two fingerprints link if at most two bits differ; classes are the connected components.

The table holds each fingerprint's Hamming distances to many pivots (reference fingerprints). The pivots come in
families: all pivots of family g agree outside the g-th segment of the bits, so their distances, less the distance to
the zero pivot, depend on that segment alone. Two differing bits touch at most two of the four segments; hence linked
fingerprints have equal relative distances in at least two families, and an equi-join on the distances of two families,
for each of the six choices, meets every linked pair. The table's 49 coordinates go with each fingerprint, as bytes in seven longs: of what the join
meets, pairs with a coordinate that differs by more than two are discarded (triangle inequality), seven coordinates by a subtraction, and
the rest are verified by the Hamming distance itself.

A cell with more fingerprints than PAIR_CELL is divided by further pivots: its fingerprints agree in two of four segments, and
each half of the other two gets a family of its own, of which linked fingerprints again agree in two of four. So cells
agree in 32, 48, 56 and at last 60 of 64 bits, when at most 16 distinct fingerprints are left in one; no link is lost and
no large cell is squared.

Nulls and texts without words have fingerprint zero; a null doc_id keeps its row, and never becomes a class id unless
its class has no other. Repeated rows count once for a class and are all returned. An empty table gives an empty result. Further
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import components, durable, few, small_batches

SEED, WIDTH, RADIUS = 42, 3, 2
FAMILIES, PIVOTS = 4, 12
#: Fingerprints of a cell that are compared pair by pair; larger cells are divided by further pivots.
PAIR_CELL = 32
#: Coordinates (each at most 64) of a long of the table, a byte each; the eighth byte stays free, so sums can't overflow.
PACKED = 7

_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(WIDTH)), strict=False)) if len(w) >= WIDTH else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)
    lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]
    ones = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        yield pa.record_batch({"doc_id": batch.column(0), "digest": batch.column(2), "fp": pa.array([fingerprint(x) for x in batch.column(1).to_pylist()], pa.int64())})


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: Column | None = None) -> DataFrame:
    """(doc_id, digest, fp) for every row of docs; digest is what is given."""
    given = F.lit(None).cast("string") if digest is None else digest
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), given.alias("digest"))
    return own.mapInArrow(_fingerprints, "doc_id long, digest string, fp long")


def _pivots() -> list[list[int]]:
    """The families of pivots; the zero pivot is apart."""
    rng, width = np.random.default_rng(SEED), 64 // FAMILIES
    return [[int(x) << (g * width) for x in rng.choice(1 << width, PIVOTS, replace=False)] for g in range(FAMILIES)]


def _distance(fp: str | Column, pivot: int) -> Column:
    fp = F.col(fp) if isinstance(fp, str) else fp
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot - (1 << 64) if pivot >> 63 else pivot).cast("long"))).cast("int")


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, d0, d): distances to the zero pivot and, by family, to the other pivots."""
    return fps.select("fp", _distance("fp", 0).alias("d0"), F.array(*(F.array(*(_distance("fp", p) for p in f)) for f in _pivots())).alias("d"))


#: The table's columns: its 1 + FAMILIES * PIVOTS coordinates, PACKED to a long.
_LONGS = [f"t{k}" for k in range(-(-(1 + FAMILIES * PIVOTS) // PACKED))]


def _packed() -> list[Column]:
    """_LONGS of a row of pivot_table(): d0 and then the families' distances."""
    coordinates = [F.col("d0"), *(F.get(F.get("d", F.lit(g)), F.lit(k)) for g in range(FAMILIES) for k in range(PIVOTS))]
    of = lambda k: [F.call_function("shiftleft", x.cast("long"), F.lit(8 * i)) for i, x in enumerate(coordinates[k * PACKED : (k + 1) * PACKED])]
    return [reduce(Column.bitwiseOR, of(k)).alias(c) for k, c in enumerate(_LONGS)]


def _lanes(byte: int) -> Column:
    return F.lit(sum(byte << (8 * i) for i in range(PACKED))).cast("long")


def _near(left: str, right: str) -> Column:
    """No coordinate of two rows of the table differs by more than RADIUS (triangle inequality), nor do more bits.

    A byte of x - y + 128 + RADIUS is in 128 .. 135 only if x - y is in -RADIUS .. 7 - RADIUS; x - y and y - x both are only if they differ by at most RADIUS.
    """
    above = lambda x, y: (F.col(x) + _lanes(128 + RADIUS) - F.col(y)).bitwiseAND(_lanes(0xF8)) == _lanes(128)
    within = [above(f"{x}.{c}", f"{y}.{c}") for c in _LONGS for x, y in ((left, right), (right, left))]
    return reduce(Column.__and__, within) & (F.bit_count(F.col(f"{left}.fp").bitwiseXOR(F.col(f"{right}.fp"))) <= RADIUS)


_TWO = list(combinations(range(FAMILIES), FAMILIES - RADIUS))


def _halves(starts: list[Column], taken: tuple[int, int], width: int) -> Column:
    """Where the halves of the segments start that are not taken."""
    return F.array(*(s + half for k, s in enumerate(starts) if k not in taken for half in (F.lit(0), F.lit(width // 2))))


def _divided(cells: DataFrame, width: int) -> DataFrame:
    """(fp, the table's longs, cell, starts) of the cells' next division: families of pivots on the segments (of so many bits) that start at ``starts``."""
    pivots = np.random.default_rng(SEED + width).permutation(np.arange(1, 1 << width))[:PIVOTS].tolist()
    shifted = lambda p, k: F.call_function("shiftleft", F.lit(p).cast("long"), F.get("starts", F.lit(k)))
    relative = [F.array(*(F.bit_count(F.col("fp").bitwiseXOR(shifted(p, k))) - F.bit_count("fp") for p in pivots)) for k in range(FAMILIES)]
    starts = [F.get("starts", F.lit(k)) for k in range(FAMILIES)]
    parts = F.array(*(F.struct(F.xxhash64("cell", F.lit(i), relative[i], F.lit(j), relative[j]).alias("cell"), _halves(starts, (i, j), width).alias("starts")) for i, j in _TWO))
    return cells.select("fp", *_LONGS, F.explode(parts).alias("p")).select("fp", *_LONGS, "p.cell", "p.starts")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the classes of the distinct fingerprints fps(fp)."""
    table, width = pivot_table(fps), 64 // FAMILIES
    relative = lambda g: F.transform(F.col("d")[g], lambda x: x - F.col("d0"))
    table = table.select("fp", *_packed(), *(F.xxhash64(relative(g)).alias(f"k{g}") for g in range(FAMILIES)))
    starts = [F.lit(g * width) for g in range(FAMILIES)]
    first = F.array(*(F.struct(F.xxhash64(F.lit(i), F.col(f"k{i}"), F.lit(j), F.col(f"k{j}")).alias("cell"), _halves(starts, (i, j), width).alias("starts")) for i, j in _TWO))
    cells, out = table.select("fp", *_LONGS, F.explode(first).alias("p")).select("fp", *_LONGS, "p.cell", "p.starts"), []
    while True:
        width //= 2
        sizes = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
        shared = durable(cells.join(sizes, "cell"))
        small = shared if width < 2 else shared.where(F.col("size") <= PAIR_CELL)
        left, right = F.col("l.fp"), F.col("r.fp")
        met = small.alias("l").join(small.alias("r"), (F.col("l.cell") == F.col("r.cell")) & (left < right) & _near("l", "r"))
        out.append(met.select(left.alias("a"), right.alias("b")))
        crowded = shared.where(F.col("size") > PAIR_CELL)
        if width < 2 or crowded.isEmpty():
            return reduce(DataFrame.unionByName, out)
        cells = _divided(crowded, width)


def _with_classes(fps: DataFrame) -> DataFrame:
    """Durable fps(doc_id, digest, fp) with root, which names the class, and component_id, which two classes share if rows of one id are in both."""
    distinct = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = durable(rooted.join(lowest, "root").select("fp", "root", "component_id"))  # one row for a fingerprint: Spark splits the other side where many rows have it
    return fps.join(of, "fp")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    with small_batches(docs.sparkSession):
        fps = durable(fingerprints(docs, text, doc_id))
    out = _with_classes(fps)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each class: of those with the smallest id the one whose text has the smallest digest.

    Rows are known by their id and their text's digest, so rows that share an id but not a class don't drop one another. Rows with a null
    id have no class to speak for and stay. What is dropped is broadcast if it is little, and else joined by a shuffle.
    """
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    with small_batches(docs.sparkSession):
        fps = durable(fingerprints(docs, text, doc_id, digest))
    found = _with_classes(fps).where("doc_id is not null")
    # tables of their own, so that Spark can split the join where one class has very many rows
    one = durable(found.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "root", "component_id").agg(F.count("*").alias("n")))
    first = durable(one.where("id = component_id").groupBy("root").agg(F.min("of").alias("first")))
    known = one.join(first, "root").withColumn("stays", (F.col("id") == F.col("component_id")) & (F.col("of") == F.col("first")))
    verdicts = durable(known.where("not stays or n > 1").select("id", "of", "stays"))
    # whole rows as one column, so that no name of theirs can clash
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).cast("long").alias("_id"), digest.alias("_of"))
    judged = held.join(few(verdicts), (F.col("_id") == F.col("id")) & (F.col("_of") == F.col("of")), "left")
    again = judged.where("stays").dropDuplicates(["_id", "_of"])
    return judged.where("stays is null").select("row.*").unionByName(again.select("row.*"))
