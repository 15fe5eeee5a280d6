"""Byte-level BPE by prefix dynamic programming: encoding, decoding, exact appends, and re-encoding near edits.

Merging pairs by rank gives every prefix of a piece exactly one encoding, and the encoding of a prefix is that of the prefix before
its last token, followed by that token. So it is enough to store the last token of each prefix: it is the one token that ends
there and may follow the last token of the prefix before it. A token may follow another if merging the bytes of both gives
the two again, which their edges tell: the tokens that stood at the right edge of the first and at the left edge of the second
while they grew, and from which to which rank; no two of them that stood side by side may have a merge that was due.
A prefix depends on earlier ones alone. So bytes appended to a piece continue its table; after an edit the table is valid
up to it, and from where the last LONGEST entries agree with the old ones again.

Texts are cut into pieces by the pattern of the vocabulary, and pieces met before come from a table of a bounded size. The time
for a piece grows linearly with its length, however long. For stored ids, ``amend`` re-encodes the stretch around an edit between places where the
pattern always cuts (before white space that follows other characters).

Null texts are empty and have no ids. Each row is encoded alone, so repeated rows get equal results; only doc_id and text are
read, whatever other columns there are. An empty table gives an empty result. Ids that the vocabulary lacks are an error.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces, and pairs of tokens, that an encoder remembers; pieces over 64 characters aren't kept.
CACHE_PIECES, CACHE_PAIRS, LONGEST_KEPT = 400_000, 1_000_000, 64
#: Rows that are encoded at a time.
ROWS = 500
_NEVER = 1 << 60


class Vocabulary:
    """Tokens by rank, an automaton that finds those which end at each byte, and the edges that tell which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {t: b for b, t in ranks.items()}
        self.longest = max(map(len, ranks))
        self.follows: dict[int, dict[int, bool]] = {t: {} for t in self.bytes_of}
        self.automaton = ahocorasick.Automaton()  # of characters that stand for bytes
        for b, t in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (self.follows[t], t, len(b)))
        self.automaton.make_automaton()
        self.halves, self.edges, self.pairs = {}, ({}, {}), 0

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a byte, and for a token that merging can't reach."""
        if token not in self.halves:
            data, ranks = self.bytes_of[token], self.ranks
            parts = [data[k : k + 1] for k in range(len(data))]
            while len(parts) > 2:
                k = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], _NEVER))
                if parts[k] + parts[k + 1] not in ranks:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.halves[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.split(token) is not None

    def edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """(bytes, from, to): what stood at the left (0) or right (1) edge of the token while it grew, and between which merges."""
        known = self.edges[side]
        if token not in known:
            out, until, t = [], _NEVER, token
            while True:
                halves = self.split(t)
                out.append((self.bytes_of[t], t if halves else -1, until))
                if not halves:
                    break
                until, t = t, halves[side]
            known[token] = out
        return known[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Does merging the bytes of a (-1 for none) and b give a and b again? Of equal merges the one further left comes first."""
        known = self.follows[b]
        if a not in known:
            self.pairs += 1
            if self.pairs > CACHE_PAIRS:
                self.pairs = 0
                for x in self.follows.values():
                    x.clear()
            ranks = self.ranks
            known[a] = self.reachable(b) and not any(
                from_x <= to_y and from_y < to_x and (m := ranks.get(x + y)) is not None and m < to_x and m <= to_y
                for x, from_x, to_x in (self.edge(a, 1) if a >= 0 else ())
                for y, from_y, to_y in self.edge(b, 0)
            )
        return known[a]

    def last_tokens(self, data: bytes, last: list[int], begin: int = 0, enough: Callable[[int], bool] | None = None) -> None:
        """Fill in the last token of each prefix longer than ``begin``, where last[k] belongs to the prefix of k bytes; ``enough`` is asked after each length."""
        offset, done = max(begin - self.longest, 0), begin
        last += [-1] * (len(data) + 1 - len(last))
        for at, (follows, token, length) in self.automaton.iter(data[offset:].decode("latin-1")):
            end = at + offset + 1
            if end > done:
                before = last[end - length]
                fits = follows.get(before)
                if self.may_follow(before, token) if fits is None else fits:
                    last[end], done = token, end
                    if enough is not None and enough(end):
                        return

    def read_back(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding of all data, from the last tokens of its prefixes."""
        out, end = [], len(data)
        while end:
            if last[end] < 0:
                raise ValueError(f"no token of the vocabulary ends with byte {data[end - 1]}")
            out.append(last[end])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """The ids of a piece; one that is a token as a whole is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.last_tokens(data, last)
        return self.read_back(data, last)


class Prefixes:
    """A growing piece with the last token of each of its prefixes (last[0] is none)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """More bytes at the end; what is known stays."""
        begin = len(self.data)
        self.data += data
        self.vocabulary.last_tokens(self.data, self.last, begin)

    def replace(self, at: int, removed: int, inserted: bytes) -> int:
        """Other bytes in place of data[at : at + removed]; how many prefixes had to be worked out again."""
        old, shift, same, reached = self.last, len(inserted) - removed, 0, at
        self.data = self.data[:at] + inserted + self.data[at + removed :]
        self.last = old[: at + 1]

        def enough(end: int) -> bool:
            nonlocal same, reached
            reached = end
            same = same + 1 if end > at + len(inserted) and self.last[end] == old[end - shift] else 0
            return same >= self.vocabulary.longest

        self.vocabulary.last_tokens(self.data, self.last, at, enough)
        self.last[reached:] = old[reached - shift :] if reached < len(self.data) else self.last[reached:]
        return reached - at

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        return [whole] if whole is not None else self.vocabulary.read_back(self.data, self.last)


class Encoder(dict):
    """Ids of pieces as little-endian int32, worked out when a piece is first met; encode() looks the pieces of a text up here.

    Of a full table the pieces that are met again move to the next one, the others are forgotten with it.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.vocabulary, self.find, self.before = Vocabulary(ranks), regex.compile(pattern).findall, {}
        self.id_bytes = {t: t.to_bytes(4, "little") for t in ranks.values()}
        # the bytes of all tokens one after the other, where each begins, and how many it has
        count = max(ranks.values()) + 1
        in_order = [self.vocabulary.bytes_of.get(t, b"") for t in range(count)]
        self.flat, self.lengths = np.frombuffer(b"".join(in_order), dtype=np.uint8), np.fromiter(map(len, in_order), dtype=np.int64, count=count)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = b"".join(map(self.id_bytes.__getitem__, self.vocabulary.encode(piece.encode("utf-8"))))
        if len(piece) <= LONGEST_KEPT:
            self[piece] = ids
        return ids

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text as little-endian int32."""
        if len(self) > CACHE_PIECES:
            self.before = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.find(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and how many each stands for."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.lengths) and (lengths := self.lengths[ids]).all()):
            raise ValueError("an id that the vocabulary lacks")
        if not len(ids):
            return self.flat[:0], self.lengths[:0]
        ends, begins = np.cumsum(lengths), self.begins[ids]
        steps = np.ones(int(ends[-1]), dtype=np.int64)  # from byte to byte, and jumps where a token begins
        steps[0] = begins[0]
        steps[ends[:-1]] = begins[1:] - begins[:-1] - lengths[:-1] + 1
        return self.flat[np.cumsum(steps)], lengths

    def amend(self, text: str, ids: list[int], at: int, removed: int, inserted: str) -> tuple[str, list[int], int]:
        """(text, ids, characters encoded again) after ``inserted`` takes the place of text[at : at + removed]."""
        cuts = [0, *(m.start() + 1 for m in regex.finditer(r"\S\s", text)), len(text)]
        lo, hi = np.searchsorted(cuts, at, side="left") - 1, np.searchsorted(cuts, at + removed, side="right")
        start, stop = cuts[max(lo, 0)], cuts[hi] if hi < len(cuts) else len(text)
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        first, end = (int(np.searchsorted(ends, len(text[:k].encode("utf-8")))) for k in (start, stop))
        between = text[start:at] + inserted + text[at + removed : stop]
        return text[:start] + between + text[stop:], ids[:first] + self.encode(between) + ids[end:], len(between)


@lru_cache(maxsize=2)  # kept between the tasks of a worker process
def encoder(path: str) -> Encoder:
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, PATTERN)


def vocabulary_path(vocabulary: str | None) -> str:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return vocabulary


def _id_lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def _parts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text)."""
    path = vocabulary_path(vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_bytes
        for part in _parts(rows):
            yield pa.record_batch({"doc_id": part.column(0), "ids": _id_lists([encode(t) for t in part.column(1).to_pylist()])})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of encoded (doc_id, ids): the bytes that the ids stand for."""
    path = vocabulary_path(vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).decode
        for part in _parts(rows):
            of_row = part.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            text, lengths = decode(part.column(1).flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(of_row)))].astype(np.int32)
            decoded = pa.Array.from_buffers(pa.binary(), len(of_row), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(text))])
            yield pa.record_batch({"doc_id": part.column(0), "ids": part.column(1), "decoded": decoded})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def amend(encoded: DataFrame, edits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text, ids, encoded_again) after edits (doc_id, at, removed, inserted), at most one for a document, of encoded (doc_id, text, ids).

    Places are in code points; an append is an edit at the text's length. Documents without an edit stay as they are, edits without a
    document are ignored, and null numbers and insertions are zero and empty.
    """
    path = vocabulary_path(vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = encoder(path).amend
        for part in _parts(rows):
            new = [
                again(r["text"] or "", r["ids"] or [], min(r["at"] or 0, len(r["text"] or "")), r["removed"] or 0, r["inserted"] or "") if r["edited"] else (r["text"], r["ids"] or [], 0)
                for r in part.to_pylist()
            ]
            text, ids, n = zip(*new, strict=True) if new else ((), (), ())
            yield pa.record_batch({"doc_id": part.column(0), "text": pa.array(text, pa.string()), "ids": pa.array(ids, pa.list_(pa.int32())), "encoded_again": pa.array(n, pa.int64())})

    edits = edits.select("doc_id", "at", "removed", "inserted", F.lit(True).alias("edited"))
    rows = encoded.select("doc_id", "text", "ids").join(edits, "doc_id", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "ids", "at", "removed", "inserted", "edited")
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>, encoded_again long")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what decode() returns."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
