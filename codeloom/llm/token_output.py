"""Token ids as binary shards, compressed with Re-Pair grammars and readable at random.

Documents are dealt by ranges of doc_id, encoded in their partition, and cut into shards of a bounded number of ids.
Each shard is a row of a Parquet table (so Spark writes it to any store, and commits it whole), with

* ``lengths``: ids of each document, as little-endian uint32;
* ``symbols``: the compressed ids, as uint16; values below ``base`` are ids, value base + r stands for rule r;
* ``rules``: two uint16 for each rule, the symbols that it stands for;
* ``spans``: uint32, the number of ids that each rule expands to, which finds a position in the shard without expanding
  what comes before it: expand() skips whole symbols by their spans.

Re-Pair replaces frequent pairs of symbols by new ones. As in its batch form, each round counts the pairs of the shard and
replaces many frequent ones (LEAST occurrences or more): where occurrences overlap, the more frequent pair goes first (the smaller one
among equals, and from the left in a run of one symbol), so that copies of a passage are replaced alike wherever they stand. Rounds
end when no pair is frequent, or when the MAX_RULES rules are used up.

Null texts are empty; every document gets the end id, so an empty one has one id. Rows that repeat a doc_id follow each
other in the order of their texts; null ids come first. An empty table gives no shards and no rows. Only doc_id and text are read. A
vocabulary with ids from BASE on is refused.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import durable, set_checkpoint_dir

VOCABULARY, END_ID = "word_bpe_49k.json", 2
SHARD_IDS = 2_000_000
#: Shards (rows of about 200 bytes) whose starts may be broadcast; the starts of more are joined by a shuffle.
FEW_SHARDS = 50_000
BASE, MAX_RULES = 49_408, 16_000
#: A pair is frequent from so many occurrences in a shard on.
LEAST = 32
#: Words and pieces that an encoder keeps.
CACHE_WORDS, CACHE_PIECES = 300_000, 500_000

SCHEMA = "doc_ids array<bigint>, first_id long, n_ids long, lengths binary, symbols binary, rules binary, spans binary"


# How the vocabulary file cuts text, and the same for lower-case text of the Latin-1 range: endings after an
# apostrophe, letters, single digits, other signs.
_CUTTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_LETTER, _DIGIT = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\x09-\x0d\x20\x85\xa0{_LETTER}{_DIGIT}]+")
_LATIN = re.compile(r"[\x00-\x1b\x20-\xff]*")  # without the separators that Python takes for white space
_END_OF_WORD = "</w>"


def _visible_bytes() -> dict[int, int]:
    """Byte-level vocabularies write a byte as itself if it is printable in Latin-1, and else as the next code point from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class WordEncoder:
    """encode() of the tokenizers library, by words: this vocabulary never joins what ASCII white space separates.

    Words that were met before come from a table. Of new words in Latin-1 only the pieces that are new go to the
    library's model; other texts, and texts with signs of special tokens, go through the library word by word. A vocabulary file
    that cuts text otherwise is used by the library alone, for whole texts. Ids must be below BASE, else ValueError.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > BASE:
            raise ValueError(f"{path} has ids from {BASE} on, which stand for rules in a shard")
        given = json.loads(self.tokenizer.to_str())
        self.by_words = all(given[k] == v for k, v in _CUTTING.items()) and given["model"].get("end_of_word_suffix") == _END_OF_WORD
        self.model, self.known, self.pieces, self.whole = self.tokenizer.model, {}, {}, {}
        self.visible, self.id_bytes = _visible_bytes(), [i.to_bytes(2, "little") for i in range(1 << 16)]

    def _learn(self, words: set[str]) -> None:
        """Ids of new lower-case words in Latin-1."""
        known, pieces, find, id_bytes = self.known, self.pieces, _PIECE.findall, self.id_bytes
        for w in words:
            parts = find(w)
            for p in parts:
                if p not in pieces:
                    tokens = self.model.tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.visible))
                    pieces[p] = b"".join([id_bytes[t.id] for t in tokens])
            known[w] = pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _other(self, text: str) -> bytes:
        """Ids of a text that isn't plain Latin-1."""
        whole, out = self.whole, []
        for w in text.encode("utf-8").split():
            if w not in whole:
                whole[w] = self._encode(w.decode("utf-8"))
            out.append(whole[w])
        return b"".join(out)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint16 ids of each text."""
        if not self.by_words:
            return [self._encode(t or "") for t in texts]
        for table, most in ((self.known, CACHE_WORDS), (self.whole, CACHE_WORDS), (self.pieces, CACHE_PIECES)):
            if len(table) > most:
                table.clear()
        out, get = [], self.known.__getitem__
        for text in texts:
            if text and (not _LATIN.fullmatch(text) or "<|" in text):
                out.append(self._other(text))
                continue
            words = (text or "").lower().split()
            if new := set(words).difference(self.known):
                self._learn(new)
            out.append(b"".join(map(get, words)))
        return out


_SLOTS = 20
#: How often a round goes over overlapping occurrences; what is left open then waits for the next round.
_PASSES = 4


def _slot(pair: np.ndarray) -> np.ndarray:
    return (pair * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs that start at ``at`` (ascending) are replaced: none that overlaps another, those of higher rank first."""
    taken, left = np.zeros(len(at), dtype=bool), np.arange(len(at))
    for _ in range(_PASSES):
        if not len(left):
            break
        own, of = at[left], rank[left]
        touches = np.diff(own, prepend=-2) == 1
        # a run of one symbol: every second start
        starts = np.flatnonzero(~(touches & (np.diff(of, prepend=-1) == 0)))
        even = (np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))) % 2 == 0
        left, own, of = left[even], own[even], of[even]
        touches = np.diff(own, prepend=-2) == 1
        rises = np.diff(of, prepend=-1) > 0
        best = ~touches | rises  # above the one before
        best[:-1] &= ~touches[1:] | ~rises[1:]  # and above the one after
        taken[left[best]] = True
        beside = np.zeros(len(own) + 2, dtype=bool)
        beside[1:-1] = best
        near = (touches & beside[:-2]) | (np.append(touches[1:], False) & beside[2:])
        left = left[~best & ~near]
    return taken


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, spans) of the ids (uint16), in which no pair of symbols occurs ``least`` times, unless MAX_RULES rules are used up.

    Only pairs that were frequent, or that stand beside a symbol of the last round, can be frequent: replacing never makes
    two old symbols neighbours. So each round counts these alone.
    """
    x, rules, spans = ids.astype(np.uint16), [np.zeros((0, 2), dtype=np.uint32)], np.ones(1 << 16, dtype=np.uint32)
    live, n = np.arange(max(len(x) - 1, 0)), 0  # where pairs start that may be frequent
    while len(live) and n < MAX_RULES:
        pair = (x[live].astype(np.uint32) << np.uint32(16)) | x[live + 1]
        slot = _slot(pair)
        often = (np.bincount(slot, minlength=1 << _SLOTS) >= least)[slot]  # leaves out most of the rare ones
        live, pair, slot = live[often], pair[often], slot[often]
        values, counts = np.unique(pair, return_counts=True)
        values, counts = values[counts >= least], counts[counts >= least]
        if not len(values):
            break
        values = values[np.argsort(-counts, kind="stable")][: MAX_RULES - n][::-1]
        # a slot stands for one pair, the most frequent of those that fall on it; the others stay for another round
        rule_at = np.full(1 << _SLOTS, -1, dtype=np.int32)
        rule_at[_slot(values)] = np.arange(len(values))
        rule = rule_at[slot]
        hit = np.flatnonzero(rule >= 0)
        hit = hit[values[rule[hit]] == pair[hit]]
        at, rule = live[hit], rule[hit]
        apart = _apart(at, rule)
        at, rule = at[apart], rule[apart]
        uses = np.bincount(rule, minlength=len(values))
        number = np.where(uses > 1, np.cumsum(uses > 1) - 1, 0)
        at, rule = at[uses[rule] > 1], rule[uses[rule] > 1]
        if not len(at):  # below four occurrences a run of one symbol may give a single one
            break
        values = values[uses > 1]
        both = np.stack((values >> np.uint32(16), values & np.uint32(0xFFFF)), axis=1)
        spans[BASE + n : BASE + n + len(both)] = spans[both[:, 0]] + spans[both[:, 1]]
        x[at] = (BASE + n + number[rule]).astype(np.uint16)
        rules.append(both)
        n += len(both)
        keep = np.ones(len(x), dtype=bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        again = np.zeros(int(place[-1]) + 1, dtype=bool)
        again[place[live[keep[live]]]] = True
        again[place[at]] = True
        again[np.maximum(place[at] - 1, 0)] = True
        x, live = x[keep], np.flatnonzero(again[:-1])
    return x, np.concatenate(rules).astype(np.uint16), spans[BASE : BASE + n]


def expand(symbols: np.ndarray, rules: np.ndarray, spans: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids at positions start to stop (default: all); only symbols that reach into that range are expanded."""
    x = symbols.astype(np.uint16)
    if start or stop is not None:
        width = np.ones(1 << 16, dtype=np.int64)
        width[BASE : BASE + len(spans)] = spans
        ends = np.cumsum(width[x])
        stop = int(ends[-1]) if stop is None and len(ends) else (stop or 0)
        lo, hi = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[lo - 1]) if lo else 0
        return expand(x[lo:hi], rules, spans)[start - before : stop - before]
    # what each symbol stands for, one after the other: an id for itself, a rule for what its two symbols stand for
    of_rule: list[bytes] = []
    part = lambda s: s.to_bytes(2, "little") if s < BASE else of_rule[s - BASE]
    for one, two in rules.tolist():
        of_rule.append(part(one) + part(two))
    flat = np.concatenate((np.arange(BASE, dtype=np.uint16), np.frombuffer(b"".join(of_rule), dtype="<u2")))
    width = np.concatenate((np.ones(BASE, dtype=np.int32), spans.astype(np.int32)))
    first = np.cumsum(width, dtype=np.int32) - width
    own = width[x]
    ends = np.cumsum(own, dtype=np.int32)
    at = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.int32)  # steps of one, and jumps where a symbol starts
    begin = first[x]
    at[ends[:-1]] = begin[1:] - begin[:-1] - own[:-1] + 1
    at[:1] = begin[:1]
    return flat[np.cumsum(at, dtype=np.int32)]


def _shard(ids: list, parts: list[bytes]) -> pa.RecordBatch:
    lengths = np.array([len(p) // 2 for p in parts], dtype="<u4")
    symbols, rules, spans = compress(np.frombuffer(b"".join(parts), dtype="<u2"))
    row = {
        "doc_ids": [ids], "first_id": [ids[0]], "n_ids": [int(lengths.sum(dtype=np.int64))], "lengths": [lengths.tobytes()],
        "symbols": [symbols.astype("<u2").tobytes()], "rules": [rules.astype("<u2").tobytes()], "spans": [spans.astype("<u4").tobytes()],
    }
    kinds = dict(zip(row, (pa.list_(pa.int64()), pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True))
    return pa.record_batch({k: pa.array(v, kinds[k]) for k, v in row.items()})


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _writer(path: str, end_id: int, shard_ids: int):
    end = int(end_id).to_bytes(2, "little")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ids, parts, held = _encoder(path), [], [], 0
        for batch in rows:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for doc_id, x in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    if held and held + len(x) // 2 + 1 > shard_ids:
                        yield _shard(ids, parts)
                        ids, parts, held = [], [], 0
                    ids.append(doc_id)
                    parts.append(x + end)
                    held += len(x) // 2 + 1
        if parts:
            yield _shard(ids, parts)

    return run


def write_shards(docs: DataFrame, to: str, vocabulary: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs (doc_id, text) into shards of ascending doc_id, at the path ``to``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the start of the text divides the rows of an id that repeats; whole texts order them
    dealt = texts.repartitionByRange(F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_writer(vocabulary, end_id, shard_ids), SCHEMA).write.parquet(to)


def _reader(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for shard in batch.to_pylist():
            lengths = np.frombuffer(shard["lengths"], dtype="<u4").astype(np.int64)
            rules = np.frombuffer(shard["rules"], dtype="<u2").reshape(-1, 2)
            ids = expand(np.frombuffer(shard["symbols"], dtype="<u2"), rules, np.frombuffer(shard["spans"], dtype="<u4")).astype("<u4")
            ends = np.cumsum(lengths)
            own = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
            yield pa.record_batch(
                {
                    "doc_id": pa.array(shard["doc_ids"], pa.int64()),
                    "start": pa.array(shard["start"] + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids": pa.array([x.tobytes() for x in own], pa.binary()),
                }
            )


#: Files whose starts are summed in one task.
FILES_TOGETHER = 1000


def _starts(shards: DataFrame) -> DataFrame:
    """(file, row, start): the ids before each shard, as running sums within files, over the files of a thousand, and over thousands."""
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("part")  # files and rows follow doc_id
    meta = shards.select("n_ids", "file", "row", part)
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = durable(meta.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("group", F.floor(F.col("part") / FILES_TOGETHER)))
    groups = files.groupBy("group").agg(F.sum("ids").alias("ids")).select("group", before("ids", Window.orderBy("group")).alias("of_groups"))
    of_files = files.withColumn("of_files", before("ids", Window.partitionBy("group").orderBy("part"))).join(groups, "group")
    own = meta.withColumn("own", before("n_ids", Window.partitionBy("part").orderBy("file", "row")))
    return own.join(of_files, "part").select("file", "row", (F.col("own") + F.col("of_files") + F.col("of_groups")).alias("start"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian uint32; start counts the ids of all documents before.

    The running sums are over the shards' metadata alone: a row for SHARD_IDS ids.
    """
    shards = spark.read.parquet(path).withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
    starts = durable(_starts(shards))
    # a row for each shard: sent to all tasks as long as there are few, so that the shards stay where they are read
    placed = shards.join(F.broadcast(starts) if starts.count() <= FEW_SHARDS else starts, ["file", "row"])
    return placed.select("doc_ids", "start", "lengths", "symbols", "rules", "spans").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")


def encode(docs: DataFrame, vocabulary: str | None = None, to: str | None = None) -> DataFrame:
    """Write docs as shards and read them back; ``to`` defaults to a new folder of the shared checkpoint folder."""
    spark = docs.sparkSession
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    if to is None:
        set_checkpoint_dir(spark)
        to = f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid4().hex}"
    write_shards(docs, to, vocabulary)
    return read_shards(spark, to)


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_shards() returns."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
