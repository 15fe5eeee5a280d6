"""Personal data: stated patterns, and a semi-Markov conditional random field over whole spans.

The patterns (email, ip, card, phone) are the base and always stay. The model scores segments, not single tokens:
a candidate of up to MAX_TOKENS tokens and a type gets the sum of the weights of features of the whole span (its shape, its
numbers of digits and dots, whether the digits pass Luhn's test, what stands before and after it), and everything
outside candidates is scored 0. A dynamic program over boundaries, whose inner step is bounded by MAX_TOKENS, sums over all
segmentations (for training and for posteriors) or finds the best one. A segment of the best segmentation is added if
its posterior is at least SURE and no base span overlaps it.

Candidates hold an @ or four digits at least, so the program runs on the stretches of text around those alone; other text can't hold a
segment, and its score is constant.

The weights are learned, by stochastic gradients in numpy, from at most SAMPLE distinct stretches of up to LONGEST characters (those with the smallest hashes,
out of about DOCUMENTS distinct texts chosen by their hashes: stated bounds). The labels are the base spans, and the same spans written as
the patterns do not read them: numbers without their plus sign or with other separators, addresses with blanks around the
@ sign or in brackets, cards with dots. So the model has to go by the features of whole spans and their surroundings, and
adds what the patterns leave out; numbers, dates and amounts in the stretches are its counterexamples.

Null and empty texts have no spans. Each row is scanned alone, so repeated rows get equal results; without any stretch to learn from
nothing is added, and an empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, REACH = 24, 6
SAMPLE, DOCUMENTS, LONGEST, EPOCHS, FEATURES = 3000, 4000, 2000, 4, 1 << 13
SURE = 0.95

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANCHOR = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\W\d_]+|.", re.DOTALL)

_SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("base", pa.bool_()), ("posterior", pa.float64())])


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from their @ signs, in time linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Stated patterns by kind and start; matches that fail their kind's test are dropped."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


# --- candidates and their features -------------------------------------------------------------------------------


def stretches(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(first token, last token + 1, all tokens as (start, end)) of each part of the text that may hold candidates."""
    lo = hi = -1
    if not _ANCHOR.search(text):
        return
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    anchors = [k for k, (a, _) in enumerate(tokens) if text[a] == "@" or "0" <= text[a] <= "9"]
    for k in anchors:
        if lo >= 0 and k - REACH <= hi:
            hi = k + REACH
        else:
            if lo >= 0:
                yield max(lo, 0), min(hi + 1, len(tokens)), tokens
            lo, hi = max(k - REACH, 0), k + REACH
    if lo >= 0:
        yield lo, min(hi + 1, len(tokens)), tokens


def _char_class(c: str) -> str:
    return "d" if "0" <= c <= "9" else "w" if c.isalpha() else "s" if c.isspace() else c


def _bucket(n: int, *edges: int) -> int:
    return sum(n >= e for e in edges)


def segment_features(text: str, a: int, b: int, shape: str) -> list[int]:
    """Hashed features of the span text[a:b]."""
    span = text[a:b]
    d, dots = digits(span), span.count(".")
    before, after = _char_class(text[a - 1]) if a else "^", _char_class(text[b]) if b < len(text) else "$"
    parts = [p for p in span.split(".") if p.isascii() and p.isdigit()]
    tail = span.rsplit(".", 1)[-1]
    facts = (
        "bias", f"shape {shape}", f"digits {_bucket(len(d), 1, 4, 7, 8, 10, 12, 16, 20)}", f"at {min(span.count('@'), 2)}", f"dots {min(dots, 5)}",
        f"plus {span[0] == '+'} {_bucket(len(d), 8, 16)}", f"luhn {16 <= len(d) <= 19 and luhn(d)} {d and len(d) >= len(span) - span.count(' ') - span.count('-')}",
        f"octets {len(parts) == dots + 1 == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)}", f"before {before}{_char_class(span[0])}",
        f"after {_char_class(span[-1])}{after}", f"blanks {min(span.count(' '), 4)}", f"tail {tail.isalpha() and 2 <= len(tail) <= 6} {'@' in span}",
    )
    return [crc32(f"{k} {x}".encode()) % FEATURES for k, x in enumerate(facts)]


def candidates(text: str, lo: int, hi: int, tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Segments (first token, last token + 1) of a stretch, with the features of each."""
    kinds = [_char_class(text[tokens[k][0]]) for k in range(lo, hi)]
    at, feats = [], []
    for i in range(lo, hi):
        if kinds[i - lo] in "s.,;:!?":
            continue
        n_digits = n_at = 0
        shape: list[str] = []
        for j in range(i, min(hi, i + MAX_TOKENS)):
            a, b = tokens[j]
            kind = kinds[j - lo]
            if kind == "s" and (b - a > 1 or text[a] != " ") or kind not in "dws" and kind not in "@.+-()%_":
                break  # no kind of personal data here goes over this
            n_digits += (b - a) * (kind == "d")
            n_at += kind == "@"
            shape.append(kind)
            if (n_at or n_digits >= 4) and kind not in "s.(+%":
                at.append((i, j + 1))
                feats.append(segment_features(text, tokens[i][0], b, re.sub(r"(w[._%+-]|d[._%+-])(?=.*@)", "w", "".join(shape)) if n_at else "".join(shape)))
    return at, np.array(feats, dtype=np.int64)


# --- the model ---------------------------------------------------------------------------------------------------


def _log_add(x: list[float]) -> float:
    m = max(x)
    return m if len(x) == 1 else m + log(sum(exp(v - m) for v in x))


def forward_backward(lo: int, hi: int, at: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Posterior of each candidate and kind, and the log of the sum over all segmentations."""
    whole = np.logaddexp.reduce(scores, axis=1)
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(at):
        ending.setdefault(j, []).append(k)
        starting.setdefault(i, []).append(k)
    alpha, beta = {lo: 0.0}, {hi: 0.0}
    for p in range(lo + 1, hi + 1):
        alpha[p] = _log_add([alpha[p - 1], *(alpha[at[k][0]] + whole[k] for k in ending.get(p, ()))])
    for p in range(hi - 1, lo - 1, -1):
        beta[p] = _log_add([beta[p + 1], *(beta[at[k][1]] + whole[k] for k in starting.get(p, ()))])
    base = np.array([alpha[i] + beta[j] for i, j in at]) - alpha[hi]
    return np.exp(base[:, None] + scores), alpha[hi]


def best_segments(lo: int, hi: int, at: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """(candidate, kind) of the segments of the best segmentation."""
    ending: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(at):
        ending.setdefault(j, []).append(k)
    top, best, back = scores.max(axis=1), {lo: 0.0}, {}
    for p in range(lo + 1, hi + 1):
        best[p], back[p] = best[p - 1], -1
        for k in ending.get(p, ()):
            if (s := best[at[k][0]] + top[k]) > best[p]:
                best[p], back[p] = s, k
    out, p = [], hi
    while p > lo:
        if back[p] < 0:
            p -= 1
        else:
            out.append((back[p], int(scores[back[p]].argmax())))
            p = at[back[p]][0]
    return out[::-1]


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights (FEATURES, kinds) from (text, gold spans); gold spans that are no candidates are left out."""
    w, seen = np.zeros((FEATURES, len(KINDS))), np.full((FEATURES, len(KINDS)), 1e-2)
    ready = []
    for text, gold in examples:
        for lo, hi, tokens in stretches(text):
            at, feats = candidates(text, lo, hi, tokens)
            if at:
                spans = {(tokens[i][0], tokens[j - 1][1]): k for k, (i, j) in enumerate(at)}
                y = np.zeros((len(at), len(KINDS)))
                for kind, a, b in gold:
                    if (a, b) in spans:
                        y[spans[a, b], KINDS.index(kind)] = 1
                ready.append((lo, hi, at, feats, y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(ready)):
            lo, hi, at, feats, y = ready[k]
            scores = w[feats].sum(axis=1) - 2.0  # a prior against segments, as most text has none
            p, _ = forward_backward(lo, hi, at, scores)
            step = y - p
            hot = np.abs(step).max(axis=1) > 1e-3
            if hot.any():
                rows = feats[hot].ravel()
                g = np.repeat(step[hot], feats.shape[1], axis=0)
                grad = np.zeros_like(w[:0], shape=(len(u := np.unique(rows)), len(KINDS)))
                np.add.at(grad, np.searchsorted(u, rows), g)
                seen[u] += grad**2
                w[u] += 0.3 * grad / np.sqrt(seen[u]) - 1e-5 * w[u]
    return w


def model_spans(text: str, w: np.ndarray, base: list[tuple[str, int, int]], sure: float = SURE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, posterior) of the segments that the model adds to the base spans."""
    out = []
    for lo, hi, tokens in stretches(text):
        at, feats = candidates(text, lo, hi, tokens)
        if not at:
            continue
        scores = w[feats].sum(axis=1) - 2.0
        if scores.max() <= 0:
            continue  # the best segmentation has no segment
        chosen = best_segments(lo, hi, at, scores)
        p, _ = forward_backward(lo, hi, at, scores)
        for k, kind in chosen:
            a, b = tokens[at[k][0]][0], tokens[at[k][1] - 1][1]
            if p[k, kind] >= sure and not any(x < b and a < y for _, x, y in base):
                out.append((KINDS[kind], a, b, float(p[k, kind])))
    return out


# --- the jobs ------------------------------------------------------------------------------------------------------


def rewritten(text: str, gold: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its gold spans in forms that the patterns don't read, and these spans; the form goes by a hash of the span."""
    out, spans, done = "", [], 0
    for kind, a, b in sorted(gold, key=lambda s: s[1]):
        if a < done:
            continue  # within another span
        span, form = text[a:b], crc32(text[a:b].encode("utf-8", "surrogatepass"))
        d = digits(span)
        if kind == "email":
            span = span.replace("@", (" @ ", "(@)", " (@) ", "@ ")[form % 4])
        elif kind == "card":
            span = (".", "- ", " .")[form % 3].join(d[k : k + 4] for k in range(0, len(d), 4))
        elif kind == "phone":
            tail = ("-", " ", ".")[form % 3].join((d[-10:-7] or d[:1], d[-7:-4], d[-4:]))
            span = (tail, f"({tail[:3]}) {tail[4:]}", f"00{d[:-10]} {tail}" if d[:-10] else tail)[form // 3 % 3]
        else:
            span = (" . ", ". ", " .")[form % 3].join(span.split("."))
        out += text[done:a] + span
        spans.append((kind, len(out) - len(span), len(out)))
        done = b
    return out + text[done:], spans


def _examples(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches cut out of the texts, to learn from."""
    for batch in rows:
        texts = []
        for x in batch.column(0).to_pylist():
            for lo, hi, tokens in stretches(x):
                a, b = tokens[lo][0], tokens[hi - 1][1]
                if b - a <= LONGEST:
                    texts.append(x[a:b])
        yield pa.record_batch({"stretch": pa.array(texts, pa.string())})


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, documents: int = DOCUMENTS) -> np.ndarray:
    """Weights learned from at most ``sample`` stretches of some ``documents`` texts that have a digit or an @ sign.

    The share of texts that is needed follows from an estimate of how many there are, so what reaches the driver doesn't grow with them.
    """
    own = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    n = own.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, documents / max(n, 1))
    chosen = own.where(F.pmod("h", F.lit(1_000_000)) < F.lit(int(np.ceil(share * 1_000_000)))).select("text").distinct()
    cut = chosen.mapInArrow(_examples, "stretch string").distinct()
    rows = sorted(cut.orderBy(F.xxhash64("stretch"), "stretch").limit(sample).collect())
    examples = [(r["stretch"], base_spans(r["stretch"])) for r in rows]
    return train(examples + [rewritten(x, gold) for x, gold in examples if gold])


def _scanner(w: np.ndarray, sure: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            spans = []
            for x in batch.column(1).to_pylist():
                base = base_spans(x or "")
                found = [(*b, x[b[1] : b[2]], True, None) for b in base]
                found += [(kind, a, b, x[a:b], False, p) for kind, a, b, p in model_spans(x or "", w, base, sure)]
                found.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                spans.append([dict(zip(("kind", "start", "end", "text", "base", "posterior"), s, strict=True)) for s in found])
            yield pa.record_batch({"doc_id": batch.column(0), "spans": pa.array(spans, pa.list_(_SPAN_TYPE))})

    return run


def find_personal_data(docs: DataFrame, weights: np.ndarray | None = None, sure: float = SURE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) for every row of docs, spans by kind and start; the model is fitted on docs if no weights are given."""
    w = fit(docs, text) if weights is None else weights
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = "struct<kind:string, start:long, end:long, text:string, base:boolean, posterior:double>"
    return own.mapInArrow(_scanner(w, sure), f"doc_id long, spans array<{kind}>")


