"""A quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated scores.

Random indexing gives every word a sparse vector of a few random signs, fixed by its hash; a word's context vector is the
sum of the sparse vectors of its neighbours over all occurrences in the corpus. Words are hashed into BUCKETS rows, so the
table has a fixed size; next to each word stands its shape (letter case, digits, signs), as words of rare spelling
share shapes, and whether it repeats the word before. All documents count: each task sums its part of the table, Spark adds the parts,
and as the sums are whole numbers the table doesn't depend on the order.

A document is the mean of its words' vectors, with the spread of them. A network with one hidden layer is trained in
numpy on at most 2 * PER_CLASS labelled documents (those of each class with the smallest hashes of their ids: a stated
bound); a part of the sample that training doesn't see gives the temperature that divides its outputs, so that scores are calibrated probabilities.

Null and empty texts are pooled to zero. Repeated rows get the same score each. Without labels of both classes all scores
are 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import durable
from codeloom.llm.toxicity import fold, labelled_sample

BUCKETS, SHAPES, DIMENSION, SIGNS = 1 << 15, 1 << 11, 32, 4
REPEAT = BUCKETS + SHAPES
ROWS = BUCKETS + SHAPES + 2
PER_CLASS, HIDDEN, EPOCHS = 4000, 32, 60
CACHE_WORDS = 300_000
#: Words whose contexts are added in one pass.
TOGETHER = 50_000


def _kind(c: str) -> str:
    return "d" if c.isdigit() else ("X" if c.isupper() else "x") if c.isalpha() else c


_LATIN = {k: _kind(chr(k)) for k in range(256)}
_RUN = re.compile(r"(.)\1{2,}", re.DOTALL)


def shape(word: str) -> str:
    """The word with capitals as X, other letters as x and digits as d; of equal signs in a row two stay."""
    kinds = word.translate(_LATIN)
    if not kinds.isascii():
        kinds = "".join(map(_kind, word))
    return _RUN.sub(r"\1\1", kinds)


class Reader:
    """Rows of the table for the words of a text."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words, and of their shapes with the repeat marks."""
        w = (text or "").encode("utf-8", "surrogatepass").split()
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for x in set(w).difference(known):
            known[x] = (crc32(x) % BUCKETS) * SHAPES + crc32(shape(x.decode("utf-8", "replace")).encode()) % SHAPES
        if not w:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, kind = np.divmod(np.fromiter(map(known.__getitem__, w), dtype=np.int64, count=len(w)), SHAPES)
        same = np.zeros(len(w), dtype=np.int64)
        same[1:] = row[1:] == row[:-1]
        return row, np.concatenate((BUCKETS + kind, REPEAT + same))


@cache
def sparse_signs() -> np.ndarray:
    """The random index vectors: SIGNS entries of +1 or -1 for each row; made once for each worker process, as that takes as long as some MB of text."""
    out = np.zeros((ROWS, DIMENSION), dtype=np.int64)
    rng = np.random.default_rng(20240601)
    for r in range(ROWS):
        out[r, rng.choice(DIMENSION, SIGNS, replace=False)] = rng.choice((-1, 1), SIGNS)
    out.flags.writeable = False  # shared
    return out


def add_contexts(table: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> None:
    """Add each word's neighbours, two to either side and the shape at its place, to its row, its shape's and its repeat mark's.

    Some texts at a time, with two empty places (row ROWS, a zero vector) after each, so that no word is a neighbour of another text's.
    """
    if not texts:
        return
    gap = np.full(2, ROWS, dtype=np.int64)
    rows = np.concatenate([x for r, _ in texts for x in (r, gap)])
    shapes = np.concatenate([x for r, e in texts for x in (e[: len(r)], gap)])
    repeats = np.concatenate([x for r, e in texts for x in (e[len(r) :], gap)])
    n = len(rows)
    near = np.zeros((n + 4, DIMENSION), dtype=np.int32)
    own = signs[rows]
    for k in (0, 1, 3, 4):
        near[k : k + n] += own
    near = near[2 : n + 2] + signs[shapes]
    for at in (rows, shapes):
        at = at.astype(np.uint16)  # ROWS fits, and so short numbers are sorted by their digits
        order = np.argsort(at, kind="stable")
        found = at[order]
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        found, sums, counts = found[first], np.add.reduceat(near[order], first, axis=0), np.diff(np.append(first, n))
        table[found, :DIMENSION] += sums
        table[found, DIMENSION] += counts
    # a word that doesn't repeat the one before has the other mark: what all words have, less those that do
    words, same = found != ROWS, repeats == REPEAT + 1
    again, times = near[same].sum(axis=0), np.count_nonzero(same)
    table[REPEAT + 1, :DIMENSION] += again
    table[REPEAT + 1, DIMENSION] += times
    table[REPEAT, :DIMENSION] += sums[words].sum(axis=0) - again
    table[REPEAT, DIMENSION] += counts[words].sum() - times


def _indexer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, reader = np.zeros((ROWS + 1, DIMENSION + 1), dtype=np.int64), Reader()
    signs = np.concatenate((sparse_signs(), np.zeros((1, DIMENSION), dtype=np.int64))).astype(np.int32)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in rows:
        for x in batch.column(0).to_pylist():
            r, e = reader(x)
            if len(r):
                held.append((r, e))
                size += len(r)
            if size > TOGETHER:
                add_contexts(table, held, signs)
                held, size = [], 0
    add_contexts(table, held, signs)
    used = np.flatnonzero(table[:ROWS, DIMENSION])
    cols = {"row": pa.array(used, pa.int64())} | {f"v{k}": pa.array(table[used, k], pa.int64()) for k in range(DIMENSION + 1)}
    yield pa.record_batch(cols)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vectors of all rows, over all documents: ROWS x DIMENSION numbers, whatever the corpus."""
    names = [f"v{k}" for k in range(DIMENSION + 1)]
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_indexer, "row long, " + ", ".join(f"{n} long" for n in names))
    sums = parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names))
    table = np.zeros((ROWS, DIMENSION + 1))
    for r in sums.collect():  # at most ROWS rows
        table[r["row"]] = r[1:]
    mean = table[:, :DIMENSION] / np.maximum(table[:, DIMENSION:], 1)
    mean += 0.5 * sparse_signs()  # the word's own mark beside its company
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(reader: Reader, vectors: np.ndarray, text: str | None) -> np.ndarray:
    """A document's features: means and spreads of its words' and its shapes' vectors, and its length."""
    r, e = reader(text)
    if not len(r):
        return np.zeros(4 * DIMENSION + 1, dtype=np.float32)
    w, s = vectors[r], vectors[e]
    return np.concatenate((w.mean(axis=0), w.std(axis=0), 2 * s.mean(axis=0), s.std(axis=0), [np.log1p(len(r)) / 8])).astype(np.float32)


def _pooler(vectors: np.ndarray):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in rows:
            out = [pool(reader, vectors, x).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "features": pa.array(out, pa.binary())})

    return run


def pooled(docs: DataFrame, vectors: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, features as float32 bytes) for every row of docs."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_pooler(vectors), "doc_id long, features binary")


class Network:
    """Two layers, a temperature, and the scaling of the inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0):
        rng = np.random.default_rng(seed)
        held = rng.random(len(y)) < 0.2
        if not 0 < y[held].sum() < held.sum():
            held[:] = False
        self.mean, self.spread = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
        z, t = (x[~held] - self.mean) / self.spread, y[~held].astype(np.float64)
        weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9))
        self.p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature, m, v, step = 1.0, [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(t))
            for k in range(0, len(t), 64):
                b, step = order[k : k + 64], step + 1
                h = np.maximum(z[b] @ self.p[0] + self.p[1], 0)
                d = weight[b] * (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -50, 50))) - t[b]) / len(b)
                dh = np.outer(d, self.p[2]) * (h > 0)
                grads = [z[b].T @ dh + 1e-3 * self.p[0], dh.sum(axis=0), h.T @ d + 1e-3 * self.p[2], np.array([d.sum()])]
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - 2e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if held.any():
            out, t = self.output(x[held]), y[held]
            weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
            loss = lambda temperature: (weight * np.logaddexp(0, np.where(t == 1, -out, out) / temperature)).mean()
            self.temperature = float(min(np.geomspace(0.2, 20, 100), key=loss))

    def output(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.spread @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(x) / self.temperature, -50, 50)))


def _scorer(network: Network | None):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1)
            scores = np.full(batch.num_rows, 0.5) if network is None or not batch.num_rows else network.score(x.astype(np.float64))
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64())})

    return run


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out=None, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs, by a model of the labelled documents outside the held-out fold."""
    held_out = fold("doc_id", 3) == 1 if held_out is None else held_out
    vectors = word_vectors(docs)
    features = durable(pooled(docs, vectors))
    sample = labelled_sample(features.withColumnRenamed("features", "text"), labels, label, held_out, per_class, "binary").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["text"])))
    y = np.array([r["y"] for r in sample])
    x = np.array([np.frombuffer(r["text"], dtype=np.float32) for r in sample], dtype=np.float64)
    network = Network(x, y) if len(y) and 0 < y.sum() < len(y) else None
    out = features.mapInArrow(_scorer(network), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
