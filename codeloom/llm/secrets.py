"""Secret scans: stated patterns, and random strings that a tokenizer packs badly.

The patterns (assignments to password-like names, access key ids, long hexadecimal runs) are the base. The method adds
strings whose characters per token under a tiktoken vocabulary are few: pieces of a learned vocabulary cover words
and names with few tokens, but random keys fall apart into pieces of one or two characters. Candidates are runs of 20
or more key characters that have both letters and digits, or letters that change case four times at least; known digests (hexadecimal runs of the lengths of MD5 and the
SHA family) and identifiers (UUIDs; parts joined by -, _, / or = that are each all letters or all digits, and don't change case so) are left out, and so is what
overlaps a base span. Runs that are not exposed as a whole are tested in parts of ten characters or more, as keys stand at the ends of paths
and tokens consist of parts; parts that are exposed make one string with what short parts stand between them, and with short parts after them that have digits or capitals, from 20 characters on.

Null texts have no spans. Each row is scanned alone, so repeated rows get equal results; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Random base-62 and base-64 strings have 1.3 to 1.9 characters per token here, invented words 2.5, English 4.
RATIO, SHORTEST = 2.1, 20
#: Characters of a part of a run that is tested by itself, and changes of case in one without digits.
SHORTEST_PART, CASE_CHANGES = 10, 4

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=.-]{{{SHORTEST},}}")
_PART = re.compile(r"[A-Za-z0-9+]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"[0-9A-Fa-f]+")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_PARTS = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/=+]+(?:[A-Za-z]+|[0-9]+))*[-_/=+]*")

SPAN = "kind string, start long, end long, text string, base boolean, ratio double"
_SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("base", pa.bool_()), ("ratio", pa.float64())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Stated patterns: the leftmost matches that don't overlap, per kind; those that fail the length test are dropped."""
    out, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def is_known(run: str) -> bool:
    """A digest or an identifier, not a secret."""
    parts = _PARTS.fullmatch(run) and not any(map(_mixed, re.split(r"[-_/=+]", run)))
    return bool(_UUID.fullmatch(run) or parts or _DIGEST.fullmatch(run) and len(run) in _DIGEST_LENGTHS)


def _mixed(run: str) -> bool:
    """Letters with digits, or letters that change between upper and lower case again and again, as names and words don't."""
    if any(map(str.isdigit, run)):
        return any(map(str.isalpha, run))
    upper = [c.isupper() for c in run if c.isalpha()]
    return sum(x != y for x, y in zip(upper, upper[1:])) >= CASE_CHANGES


def random_spans(text: str, base: list[tuple[str, int, int]], encode, ratio: float = RATIO) -> list[tuple[int, int, float]]:
    """(start, end, characters per token) of the strings that the token-efficiency test exposes.

    A run is tested as a whole, if it has no dots. If it passes, it is cut at the characters that join parts of paths, names and tokens, and
    parts that each fail the test count as one string from SHORTEST characters on.
    """

    def packed(s: str) -> float:  # one text with a very long run: pieces of 4,096 characters keep the tokenizer's work in proportion
        return len(s) / sum(len(encode(s[k : k + 4096])) for k in range(0, len(s), 4096))

    def exposed(s: str) -> bool:
        return _mixed(s) and not is_known(s) and packed(s) <= ratio

    out = []
    for m in _RUN.finditer(text):
        if not _mixed(m.group()) or _UUID.fullmatch(m.group()):
            continue
        found, bridge = [[m.start(), m.end()]], False  # bridge: only short parts since the last exposed one
        if "." in m.group() or not exposed(m.group()):
            found = []
            for p in _PART.finditer(text, m.start(), m.end()):
                short = len(p.group()) < SHORTEST_PART
                if not short and exposed(p.group()):
                    if bridge:
                        found[-1][1] = p.end()
                    else:
                        found.append([p.start(), p.end()])
                    bridge = True
                elif bridge and short and p.start() - found[-1][1] == 1 and re.search("[0-9A-Z]", p.group()):
                    found[-1][1] = p.end()
                else:
                    bridge = bridge and short
        for start, end in found:
            if end - start >= SHORTEST and not any(a < end and start < b for _, a, b in base):
                out.append((start, end, packed(text[start:end])))
    return out


_encodings: dict = {}


def encoding(path: str):
    """The tiktoken encoding of a vocabulary file, built once for each worker process."""
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _scanner(path: str, ratio: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in rows:
            spans = []
            for x in batch.column(1).to_pylist():
                base = base_spans(x or "")
                found = [(*b, x[b[1] : b[2]], True, None) for b in base]
                found += [("random", a, b, x[a:b], False, r) for a, b, r in random_spans(x or "", base, encode, ratio)]
                found.sort(key=lambda s: (s[1], (*KINDS, "random").index(s[0])))
                spans.append([dict(zip(("kind", "start", "end", "text", "base", "ratio"), s, strict=True)) for s in found])
            yield pa.record_batch({"doc_id": batch.column(0), "spans": pa.array(spans, pa.list_(_SPAN_TYPE))})

    return run


def find_secrets(docs: DataFrame, vocabulary: str | None = None, ratio: float = RATIO, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) for every row of docs; spans are ordered by start and then by kind."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_scanner(vocabulary, ratio), f"doc_id long, spans array<struct<{SPAN.replace(' ', ':').replace(',:', ', ')}>>")


def joined(spans: str | Column, base_only: bool = False) -> Column:
    """kind:start:end of the spans in their order, joined by commas."""
    col = F.col(spans) if isinstance(spans, str) else spans
    kept = F.filter(col, lambda s: s["base"]) if base_only else col
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["base"] & (s["kind"] == kind))).cast("long")
