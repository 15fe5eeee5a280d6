"""The filter audit, byte-level BPE and importance resampling against brute force, the tiktoken library, and odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from codeloom.llm import byte_bpe, filter_audit, importance, queries
from tests.llm.test_llm import DOCS, SPLIT, docs, labels, none, odd, texts  # noqa: F401  fixtures

# --- filter audit ----------------------------------------------------------------------------------------------------


def test_intervals_are_where_each_mask_is_removed():
    removed = {}
    for mask, step, start, stop in filter_audit.intervals():
        for k in range(start, stop):
            assert removed.setdefault((mask, k), step) == step
    orders = list(permutations(range(5)))
    assert [filter_audit.rank(o) for o in orders] == list(range(120))
    assert removed == {(m, k): next(s for s, f in enumerate(o, 1) if m >> f & 1) for k, o in enumerate(orders) for m in range(1, 32)}


def brute_audit(rows, marks):
    good, toxic = {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, t in marks if t == 1 and i is not None}
    seen = []
    for r in rows:
        t = r["text"] or ""
        w = SPLIT.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = r["doc_id"] is not None and any((o["text"] or "") == t and o["doc_id"] is not None and o["doc_id"] < r["doc_id"] for o in rows)
        seen.append((r["lang"] or "", {f for f, bad in fails.items() if bad}, r["doc_id"] in good, r["doc_id"] in toxic))
    out, over = {}, Counter()
    for part in {s[0] for s in seen}:
        of = [s[1:] for s in seen if s[0] == part]
        for order in permutations("ABCDE"):
            left = of
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                failing = sum(f in x[0] for x in of)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x[0] == {f} for x in of), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                over[part, f] += len(gone)
    return {k: (*v, over[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit_of_odd_rows(spark, odd, labels, none):
    """Nulls in each column, copies of the empty text, repeated ids and labels; columns called like the operator's own."""
    more = spark.createDataFrame([(2, 1, 0), (2, 0, 1), (8, 0, 1)], labels.schema).unionAll(labels)
    clash = odd.withColumns({c: F.lit("clash") for c in ("part", "mask", "n", "good", "toxic", "digest", "rank", "step")})
    assert audited(filter_audit.audit(clash, more)) == brute_audit(odd.collect(), [tuple(r) for r in more.collect()])
    assert filter_audit.audit(none, labels).count() == 0 and filter_audit.audit(odd, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_copies(spark, labels):
    """Groups of copies over parts and marks, with repeated and missing ids."""
    rng = random.Random(3)
    bodies = ["a b c", "", None, "A B C #", " ".join(f"w{k}" for k in range(210)), "one two " * 120]
    rows = [(rng.choice([None, *range(40)]), rng.choice(bodies), rng.choice(["en", "fr", "", None]), "s", 0) for _ in range(160)]
    marks = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(50)]
    df = spark.createDataFrame(rows, DOCS)
    assert audited(filter_audit.audit(df, spark.createDataFrame(marks, labels.schema))) == brute_audit(df.collect(), marks)


# --- byte-level BPE --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.encoder(byte_bpe.vocabulary_path(None))


@pytest.fixture(scope="module")
def library(coder):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.vocabulary.ranks, special_tokens={})


def test_byte_bpe_query_agrees_with_the_library(spark, sf, texts, library):  # noqa: F811
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_byte_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = {}
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == want


def test_tokens_follow_as_merges_say(coder, library):
    v, rng = coder.vocabulary, random.Random(0)
    for k in range(20_000):
        a, b = (rng.randrange(3000), rng.randrange(3000)) if k % 2 else (rng.randrange(len(v.ranks)), rng.randrange(len(v.ranks)))
        got = library._encode_single_piece(v.bytes_of[a] + v.bytes_of[b])
        assert len(got) == 1 or v.may_follow(a, b) == (got == [a, b])


def test_appends_and_edits_are_exact(coder, library):
    v, rng = coder.vocabulary, random.Random(1)
    for k in range(600):
        s = bytes(rng.choice(b"ab cdxee  thein'sz\n\t!!") if k % 3 else rng.randrange(256) for _ in range(rng.randrange(1, 300)))
        grown = byte_bpe.Prefixes(v)
        for at in range(0, len(s), 17):
            grown.append(s[at : at + 17])
            assert grown.ids() == library._encode_single_piece(s[: at + 17])
        at = rng.randrange(len(s) + 1)
        removed, inserted = rng.randrange(len(s) - at + 1), bytes(rng.choice(b"abc ") for _ in range(rng.randrange(6)))
        grown.replace(at, removed, inserted)
        assert grown.last == byte_bpe.Prefixes(v, s[:at] + inserted + s[at + removed :]).last


def test_an_edit_touches_only_what_is_near(coder, library):
    long = byte_bpe.Prefixes(coder.vocabulary, b"abcde" * 20_000)
    assert long.replace(50_000, 1, b"xy") < 1_000 and long.ids() == library._encode_single_piece(long.data)
    rng = random.Random(2)
    for _ in range(600):
        t = "".join(rng.choice("ab 'slre  \n!é日") for _ in range(rng.randrange(80)))
        at = rng.randrange(len(t) + 1)
        removed, inserted = rng.randrange(len(t) - at + 1), "".join(rng.choice("ab 'sl \né") for _ in range(rng.randrange(5)))
        text, ids, _ = coder.amend(t, coder.encode(t), at, removed, inserted)
        assert text == t[:at] + inserted + t[at + removed :] and ids == library.encode_ordinary(text)


def test_amend_table(spark, docs, library):  # noqa: F811
    stored = byte_bpe.encode(docs).join(docs.select("doc_id", "text"), "doc_id")
    edits = docs.where("doc_id % 3 = 0").select("doc_id", (F.length("text") / 2).cast("int").alias("at"), F.lit(3).alias("removed"), F.lit(" new words").alias("inserted"))
    edits = edits.unionAll(spark.createDataFrame([(1, 1 << 30, None, "'ll"), (2, None, None, None), (-5, 0, 0, "x")], "doc_id long, at int, removed int, inserted string"))
    out, was = {r["doc_id"]: r for r in byte_bpe.amend(stored, edits).collect()}, {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, r in out.items():
        old = was[i]
        at = len(old) // 2
        assert r["text"] == (old[:at] + " new words" + old[at + 3 :] if i % 3 == 0 else old + "'ll" if i == 1 else old)
        assert r["ids"] == library.encode_ordinary(r["text"]) and (r["encoded_again"] < 300 or len(old) < 1000)


def test_byte_bpe_of_odd_rows(odd, none, library):  # noqa: F811
    got = sorted(((r["doc_id"], bytes(r["decoded"]), r["ids"]) for r in byte_bpe.decode(byte_bpe.encode(odd)).collect()), key=str)
    assert got == sorted(((r["doc_id"], (r["text"] or "").encode(), library.encode_ordinary(r["text"] or "")) for r in odd.collect()), key=str)
    assert byte_bpe.decode(byte_bpe.encode(none)).count() == 0
    with pytest.raises(Exception, match="vocabulary lacks"):
        byte_bpe.decode(byte_bpe.encode(odd).withColumn("ids", F.array(F.lit(60_000)))).collect()


# --- importance resampling -------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_runs(text, longest):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute_resample(rows, target, longest, buckets, percent=10, least=20, seed=2024):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    runs = [(r["doc_id"], *brute_runs(r["text"], longest)) for r in rows]
    s, t = Counter(bucket(x) for _, _, f in runs for x in f), Counter(bucket(x) for y in target for x in brute_runs(y, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, n, f in runs:
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[5] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 500, 35), (2, 1 << 20, 100)])
def test_resampling_agrees_with_strings(spark, sf, docs, longest, buckets, percent):  # noqa: F811
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = importance.resample(docs, bench, longest, buckets, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(docs.collect(), [r["text"] for r in bench.collect()], longest, buckets, percent)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_resampling_of_odd_rows(spark, odd, none, monkeypatch, block):  # noqa: F811
    monkeypatch.setattr(importance, "BLOCK", block)
    target = spark.createDataFrame([(None, 1), ("Ünïcödé WORD long-long", 2), ("", 3), ("--", 4)], "text string, item_id int")
    got = sorted(map(tuple, importance.resample(odd, target, 2, percent=50).collect()), key=str)
    assert got == brute_resample(odd.collect(), [r["text"] for r in target.collect()], 2, 10_000, 50)
    assert importance.resample(none, target).count() == 0
    assert sorted(map(tuple, importance.resample(odd, target.limit(0)).collect()), key=str) == brute_resample(odd.collect(), [], 1, 10_000)


def test_joined_checksums():
    import numpy as np

    rng = random.Random(0)
    left, right = ([bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 300, 70_000]))) for _ in range(40)] for _ in range(2))
    crc = lambda x: np.array([zlib.crc32(y) for y in x], dtype=np.uint32)
    assert (importance.joined(crc(left), crc(right), np.array([len(y) for y in right])) == crc([a + b for a, b in zip(left, right)])).all()


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, 30, 30, 0, s) for i, s in [(5, 7), (3, 7), (9, 7), (None, 7), (1, 6), (2, 8), (4, 7)]] + [(7, 10, 10, 0, 99)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    assert {(r["doc_id"], r["rank"]) for r in importance.draw(df, percent=60).collect()} == {(2, 1), (3, 2), (4, 3), (5, 4), (9, None), (None, None), (1, None), (7, None)}
