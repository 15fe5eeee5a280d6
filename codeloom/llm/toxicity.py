"""Toxicity scores from subword bags: n-gram embeddings averaged into a linear softmax, trained jointly.

A word is the mean of the embeddings of its character 3- to 5-grams and of itself (all hashed into BUCKETS rows), a
passage is the mean of its distinct words, and a linear softmax over two classes scores the passage; a document is as toxic as its most toxic
passage, so that one insult in a long document isn't averaged away. Embeddings and softmax are trained together, by
gradient steps with momentum on whole batches, from at most 2 * PER_CLASS labelled documents (those of each class with the smallest hashes of
their ids: a stated bound). As unseen misspellings share most n-grams with the words they come from, they share their vectors.

A share of the sample is kept out of training and sets scale and offset of the scores (Platt's method).

With two classes the softmax depends on one direction of the embeddings only; after training each word has one
number, and a document is scored with a lookup for each word.

Null and empty texts have the score of a passage without words. Repeated rows get the same score each; labels without a
document, with null, or for repeated ids are counted as they are. Without labels of both classes all scores are 0.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import durable
from codeloom.llm.simhash import fingerprint

BUCKETS, DIMENSION = 1 << 17, 8
GRAMS = (3, 4, 5)
#: Words of a passage; its mean is over its distinct words, at least over FLOOR (else a repeated word counts undiluted).
PASSAGE, FLOOR = 96, 16
PER_CLASS, STEPS, EVERY = 1500, 60, 5
#: Longest steps of embeddings, softmax and offsets; documents that must have an n-gram for it to get an embedding; prior count.
RATES, LEAST, PRIOR = (0.1, 0.02, 0.05), 4, 2.0
#: Fingerprints of the sample's near copies differ by so many bits at most; those of unrelated texts by 32 on average.
NEAR_BITS = 10
CACHE_WORDS = 300_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str) -> list[int]:
    """Buckets of the word's n-grams and of the word itself; of words over 64 characters, each stretch of 64."""
    if len(word) > 64:
        return [g for k in range(0, len(word), 64) for g in grams(word[k : k + 64])]
    w = f"<{word}>"
    out = [crc32(w[k : k + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in GRAMS for k in range(len(w) - n + 1)]
    return [*out, crc32(f"={word}".encode("utf-8", "surrogatepass")) % BUCKETS]


def passages(n: int) -> np.ndarray:
    """Starts of the passages of a text of n words: every half passage."""
    return np.arange(0, max(n - PASSAGE // 2, 1), PASSAGE // 2)


@dataclass
class Model:
    direction: np.ndarray  # the embeddings times the difference of the softmax's columns
    bias: float
    scale: float = 1.0
    offset: float = 0.0
    known: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def logit(self, text: str | None) -> float:
        known, w = self.known, words(text)
        if len(known) > CACHE_WORDS:
            known.clear()
        for x in w:
            if x not in known:
                known[x] = float(self.direction[grams(x)].mean())
        parts = (set(w[a : a + PASSAGE]) for a in passages(len(w)))
        return max(sum(known[x] for x in part) / max(len(part), FLOOR) for part in parts) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.logit(text) + self.offset, -50, 50))))


def train(texts: list[str | None], labels: np.ndarray, steps: int = STEPS, seed: int = 0) -> Model | None:
    """A model of the labels (0 or 1), or None if a class is missing."""
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    # word table with its n-grams, passages with their words
    index: dict[str, int] = {}
    word_of, passage_of, doc_of, sizes = [], [], [], []
    for d, text in enumerate(texts):
        ids = np.array([index.setdefault(x, len(index)) for x in words(text)], dtype=np.int64)
        for a in passages(len(ids)):
            part = np.unique(ids[a : a + PASSAGE])
            word_of.append(part)
            passage_of.append(np.full(len(part), len(sizes)))
            doc_of.append(d)
            sizes.append(max(len(part), FLOOR))
    word_of, passage_of, doc_of, sizes = np.concatenate(word_of), np.concatenate(passage_of), np.array(doc_of), np.array(sizes)
    flat, sizes_of = array("q"), array("q")  # not lists: a word's n-grams are a dozen numbers
    for x in index:
        own = grams(x)
        flat.extend(own)
        sizes_of.append(len(own))
    gram, counts, n_words = np.array(flat, dtype=np.int64), np.array(sizes_of, dtype=np.int64), len(index)
    gram_word = np.repeat(np.arange(n_words), counts)
    del flat, sizes_of, index
    share = 1.0 / np.maximum(counts, 1)
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    weight = 1.0 / copies(texts) * ~held
    for c in (0, 1):
        weight[y == c] *= 0.5 / max(weight[y == c].sum(), 1e-9)
    # start: along one direction the log odds of the documents with an n-gram, noise in the others
    once = 1.0 / copies(texts) * ~held
    in_toxic, in_clean = (_in_documents(gram, gram_word, word_of, doc_of[passage_of], once * (y == c)) for c in (1, 0))
    n_toxic, n_clean = (once * (y == 1)).sum(), (once * (y == 0)).sum()
    odds = np.log((in_toxic + PRIOR) / (n_toxic + 2 * PRIOR)) - np.log((in_clean + PRIOR) / (n_clean + 2 * PRIOR)) - np.log((n_clean + 2 * PRIOR) / (n_toxic + 2 * PRIOR)) * (in_toxic + in_clean == 0)
    odds[in_toxic + in_clean < LEAST] = 0
    emb, soft, bias = rng.normal(0, 0.01, (BUCKETS, DIMENSION)), rng.normal(0, 0.1, (DIMENSION, 2)), np.zeros(2)
    emb[:, 0] += odds
    soft[0] = -2, 2
    known = in_toxic + in_clean >= LEAST
    starts = np.flatnonzero(np.diff(doc_of, prepend=-1))

    def logits(emb, soft, bias):
        word = np.bincount(gram_word, (emb @ (soft[:, 1] - soft[:, 0]))[gram], minlength=n_words) * share
        return np.bincount(passage_of, word[word_of], minlength=len(sizes)) / sizes + bias[1] - bias[0]

    def top(z):
        """The most toxic passage of each document."""
        order = np.lexsort((z, doc_of))
        return order[np.append(starts[1:], len(z)) - 1]

    speed = [np.zeros_like(p) for p in (emb, soft, bias)]
    can_check, kept = 0 < y[held].sum() < held.sum(), (np.inf, 0, None, 0.0, 1.0, 0.0)
    for t in range(steps):
        z = logits(emb, soft, bias)
        # a clean document has no toxic passage: all of its passages teach; a toxic one has at least one
        best = top(z)
        if can_check and t % EVERY == 0:
            fit = _platt(z[best][held], y[held])
            if (loss := _loss(fit[0] * z[best][held] + fit[1], y[held])) < kept[0]:
                kept = (loss, t, emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]), *fit)
        g = np.zeros(len(z))
        p1 = 1 / (1 + np.exp(-np.clip(z[best], -50, 50)))
        g[best] = weight * (p1 - y)
        clean = (y[doc_of] == 0) & (weight[doc_of] > 0)
        per_doc = np.bincount(doc_of, minlength=len(y))[doc_of]
        g[clean] += weight[doc_of[clean]] / per_doc[clean] / (1 + np.exp(-np.clip(z[clean], -50, 50)))
        by_word = np.bincount(word_of, (g / sizes)[passage_of], minlength=n_words) * share
        by_gram = np.bincount(gram, by_word[gram_word], minlength=BUCKETS) * known
        d_soft = by_gram @ emb
        grads = (np.outer(by_gram, soft[:, 1] - soft[:, 0]), np.stack((-d_soft, d_soft), axis=1), np.array([-g.sum(), g.sum()]))
        # one step length for each group: rare n-grams must not move like frequent ones
        for p, grad, v, rate in zip((emb, soft, bias), grads, speed, RATES, strict=True):
            v *= 0.8
            v += rate * grad / (np.abs(grad).max() + 1e-12)
            p -= v
    if can_check:  # the step after which the texts kept out fitted best: later ones learn wrong labels by heart
        return Model(*kept[2:])
    return Model(emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    """Logistic loss with both classes weighing the same."""
    v = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    return float((v * np.logaddexp(0, np.where(y == 1, -z, z))).sum())


def copies(texts: list[str | None]) -> np.ndarray:
    """How many of the sample's texts (itself included) are near copies of each: they share one weight, and one label's error."""
    fp = np.array([fingerprint(x) for x in texts], dtype=np.int64).view(np.uint64)
    return np.array([(np.bitwise_count(fp ^ x) <= NEAR_BITS).sum() for x in fp])


def _in_documents(gram: np.ndarray, gram_word: np.ndarray, word_of: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weight of the documents in which each bucket is found; counted for some documents at a time, to bound the memory."""
    first = np.searchsorted(gram_word, np.arange(gram_word.max() + 2 if len(gram_word) else 1))
    out, starts = np.zeros(BUCKETS), np.searchsorted(doc, np.arange(0, len(weight) + 100, 100))  # doc is in order
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        d, w = doc[lo:hi], word_of[lo:hi]
        pairs = np.unique(d[weight[d] > 0] * (len(first) + 1) + w[weight[d] > 0])
        d, w = pairs // (len(first) + 1), pairs % (len(first) + 1)
        n = first[w + 1] - first[w]
        at = np.repeat(first[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(np.repeat(d, n) * BUCKETS + gram[at])
        out += np.bincount(both % BUCKETS, weight[both // BUCKETS], minlength=BUCKETS)
    return out


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Scale and offset that make sigmoid(scale * z + offset) fit y, with both classes weighing the same (Newton's method)."""
    v = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    target = np.where(y == 1, 0.99, 0.01)
    x, p = np.stack((z, np.ones_like(z)), axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -50, 50)))
        h = (x * (v * s * (1 - s))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (v * (s - target)))
        p = p - step / max(1.0, np.abs(step).max() / 2)
    return float(max(p[0], 1e-3)), float(p[1])


def fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, per_class: int, kind: str = "string") -> DataFrame:
    """(doc_id, text, y): of each class at most per_class labelled documents, by the smallest hashes of their ids.

    The ids are chosen from the labels alone; at most 2 * per_class of them then pick their rows out of docs.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull())
    rows = rows.where(~held_out)
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = durable(rows.where("y = 0").orderBy(*by).limit(per_class).unionAll(rows.where("y = 1").orderBy(*by).limit(per_class)))
    ids = chosen.withColumnRenamed("doc_id", "_id")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast(kind).alias("text"))
    return own.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")  # bounded by per_class


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out=None, per_class: int = PER_CLASS) -> Model | None:
    """A model of the labelled documents outside the held-out fold."""
    held_out = fold("doc_id", 5) == 0 if held_out is None else held_out
    rows = sorted(labelled_sample(docs, labels, label, held_out, per_class).collect(), key=lambda r: (r["doc_id"], r["y"], r["text"] or ""))
    return train([r["text"] for r in rows], np.array([r["y"] for r in rows]))


def _scorer(model: Model | None):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            scores = [0.0 if model is None else model.score(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64())})

    return run


def score(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) for every row of docs."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = own.mapInArrow(_scorer(model), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
