"""The training-data operators against brute force, round trips, held-out accuracy, and odd tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as S

from codeloom.llm import common, decontaminate, mixing, pii, quality_model, quality_rules, queries, secrets, simhash, substring_dedup, token_output, toxicity
from tests.conftest import rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t", "en", "a", 4), (4, "word", "en", None, 4), (4, "word", "en", None, 4), (None, "no id at all", "en", "a", 9),
    (5, "the same line\n" * 40, None, "b", 1), (6, "Ünïcödé ß 日本語 😀 ́x", "xx", "b", 1), (7, "long " * 30_000, "en", "b", 1), (8, "x" * 70_000, "en", "b", 1), (9, "1" * 5_000 + " @@@ +++ 1.2.3", "en", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, very long texts, repeated rows, and further columns with names that the operators use."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("fp", "key", "copy", "score", "spans", "start", "h", "_rows", "kept", "item_id")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


# --- results ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(name, spark, duck, sf):
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPLIT.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    ids, parent = list(fps), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for x in ids:
        groups[find(x)].append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_simhash_agrees_with_all_pairs(spark, sf, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, sf).collect()}
    low = brute_classes(fps)
    assert got == {i: (f"{fps[i]:016x}", low[i]) for i in texts}


@pytest.mark.parametrize("cell", [2, 32])
def test_simhash_links_random_fingerprints(spark, monkeypatch, cell):
    """Chains of fingerprints one and two bits apart, by pairs and by the path of crowded cells."""
    monkeypatch.setattr(simhash, "PAIR_CELL", cell)
    rng, fps = np.random.default_rng(0), []
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in set(fps)], "fp long")
    got = {(r["node"] % (1 << 64)): r["root"] for r in common.components(simhash.links(df)).collect()}
    want = brute_classes(dict(zip(set(fps), set(fps))))
    assert len({got.get(x, ("alone", x)) for x in set(fps)}) == len(set(want.values()))
    assert all((got.get(a, ("alone", a)) == got.get(b, ("alone", b))) == (want[a] == want[b]) for a in list(want)[:60] for b in list(want)[:60])


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(200, 260)} == {5}


def test_token_files_give_back_what_the_library_encodes(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = sorted(map(tuple, queries.op6_token_output(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    for (i, text), row in zip(sorted(texts.items()), got, strict=True):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert row == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("text", ["İstanbul ΣΑΣ ς", "<|endoftext|> x", "don't DON'T we'll", "½²³ 12", "a b\u0085c \x1c", "日本語 😀", "\x00 \xad", ""])
def test_word_encoder_on_odd_texts(text):
    import public_tokenizers

    enc = token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(enc([text])[0], dtype="<u2").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 5_000, 60_000])
def test_grammar_round_trip_and_random_access(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(max=49_000).astype(np.uint16)
    ids[: n // 3] = 7  # runs of one id overlap themselves
    x, rules, spans = token_output.compress(ids, least=4)
    assert (token_output.expand(x, rules, spans) == ids).all() and len(x) <= n
    for a, b in ((0, 1), (n // 2, n // 2 + 17), (n - 3, n)):
        if 0 <= a < b <= n:
            assert (token_output.expand(x, rules, spans, a, b) == ids[a:b]).all()


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


EMAIL, IP, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_pii(t):
    d = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(EMAIL, t)]
    out += [("ip", *m.span()) for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d(m)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d(m)[::-1])) % 10 == 0]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, t) if 8 <= len(d(m)) <= 15]


TRICKY = ["a@b.c@d.e f@g", "@x.y a@-.-", "1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (555) 010-9999. +12", "x.y+z@mail.example.com,1.1.1.1", "00255.1.1.1"]


def test_personal_data_keeps_the_stated_patterns(spark, sf, texts):
    for t in TRICKY:
        assert pii.base_spans(t) == brute_pii(t), t
    for r in queries.op4_pii(spark, sf).collect():
        own = brute_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(own) and [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, *_ in own) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in own} <= set(filter(None, r["spans"].split(",")))


def test_segment_model_learns_spans_and_sums_to_one():
    rng = np.random.default_rng(0)
    ip = lambda: ".".join(map(str, rng.integers(0, 256, 4)))
    names = ["ann", "bob", "cy", "dora", "eve"]
    texts = [f"see {ip()} or 12345 and {names[k % 5]}@{names[k % 3]}host.org there" for k in range(150)] + [f"total of {k}99999 pieces, 7.5.3" for k in range(80)]
    w = pii.train([(t, pii.base_spans(t)) for t in texts])
    found = pii.model_spans("ask 10.20.30.40 or me@there.org for 1234567", w, [])
    assert {(k, a, b) for k, a, b, _ in found} >= {("ip", 4, 15), ("email", 19, 31)} and not any(k in ("card", "phone") for k, *_ in found)
    (lo, hi, tokens), *_ = pii.stretches("ip 1.2.3.4 x")
    at, feats = pii.candidates("ip 1.2.3.4 x", lo, hi, tokens)
    scores = np.random.default_rng(1).normal(size=(len(at), 4))
    best = pii.best_segments(lo, hi, at, scores)
    p, total = pii.forward_backward(lo, hi, at, scores)
    brute = brute_segmentations(lo, hi, at, scores)
    assert np.isclose(total, np.logaddexp.reduce([s for s, _ in brute])) and np.isclose(sum(scores[k, y] for k, y in best), max(s for s, _ in brute))
    assert np.isclose(p[0].sum(), sum(np.exp(s - total) for s, used in brute if 0 in used))
    assert len(feats) == len(at)


def brute_segmentations(p, hi, at, scores):
    if p == hi:
        return [(0.0, ())]
    out = brute_segmentations(p + 1, hi, at, scores)
    for k, (i, j) in enumerate(at):
        if i == p:
            for s, used in brute_segmentations(j, hi, at, scores):
                out += [(s + scores[k, y], (k, *used)) for y in range(4)]
    return out


def brute_secrets(t):
    word = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    out = [("assign", *m.span()) for m in re.finditer(rf"({word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m.group(2)) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets_keep_the_stated_patterns(spark, sf, texts):
    key = 'x API_KEY: "abcd1234efgh" Token=short passwd = ' + "a" * 9 + " AKIA" + "Z" * 12 + " " + "0f" * 20 + " toKen='ſecret'"
    assert sorted(secrets.base_spans(key), key=lambda s: (s[1], secrets.KINDS.index(s[0]))) == brute_secrets(key)
    for r in queries.op7_secrets(spark, sf).collect():
        own = brute_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(own) and [r[f"n_{k}"] for k in secrets.KINDS] == [sum(x == k for x, *_ in own) for k in secrets.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in own} <= set(filter(None, r["spans"].split(",")))


def test_random_strings_are_found_and_known_ones_left(spark):
    import public_tokenizers

    random = "xK9f2LqPz7Rw4VbN8mTyHd3s"
    encode = secrets.encoding(public_tokenizers.path(secrets.VOCABULARY)).encode_ordinary
    text = f"go {random} and 550e8400-e29b-41d4-a716-446655440000 and release-2024-01-02-final and D41D8CD98F00B204E9800998ECF8427E and internationalization-of-things-2"
    assert [text[a:b] for a, b, _ in secrets.random_spans(text, [], encode)] == [random]


def test_containment_agrees_with_all_pairs_on_edited_items(spark):
    rng = np.random.default_rng(3)
    item = [f"w{k}" for k in rng.integers(0, 500, 40)]
    filler = lambda n: [f"f{k}" for k in rng.integers(0, 5000, n)]
    docs, items = [], [(k, " ".join(item[k : k + 12 + k])) for k in range(12)] + [(90, "too short"), (91, None)]
    for k in range(60):
        own = list(item)
        for at in rng.choice(40, k % 5, replace=False):
            own[at] = "edited"
        docs.append((k, " ".join([*filler(300), *own, *filler(200)])))
    sh = lambda t: {tuple(x) for x in zip(*((t or "").split()[i:] for i in range(5)))}
    want = {(i, j) for i, t in docs for j, u in items if sh(u) and len(sh(t) & sh(u)) >= 0.8 * len(sh(u))}
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 100


def test_items_spread_over_the_rows_of_a_document(spark):
    """Rows of one doc_id, ids that are missing among them, have the shingles of all of them, also where one row alone meets no sketch."""
    rng = np.random.default_rng(5)
    items, docs = [], []
    for k in range(60):
        w = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(12, 40)))]
        items.append((k, " ".join(w)))
        cut = int(rng.integers(6, len(w) - 5))
        for part in (w[: cut + 4], w[cut:]):  # each shingle is in one of the two
            docs.append((k if k else None, " ".join([*(f"f{x}" for x in rng.integers(0, 5000, 50)), *part])))
    docs += [(1000 + k, " ".join(f"f{x}" for x in rng.integers(0, 5000, 50))) for k in range(60)]
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_shared"] == r["n_shingles"]) for r in got.collect()} == {(k if k else None, k, True) for k in range(60)}


def test_compact_windows_agree_with_their_definition():
    for seed in range(6):
        x = np.random.default_rng(seed).integers(1, 40 if seed % 2 else 1 << 37, 90).astype(np.uint64) << np.uint64(26)
        got = {(int(a), int(c), int(b)) for a, c, b in zip(*substring_dedup.compact_windows(x, 11))}
        want = set()
        for c in range(90):
            a, b = c, c
            while a and x[a - 1] > x[c]:
                a -= 1
            while b + 1 < 90 and x[b + 1] >= x[c]:
                b += 1
            if b - a + 1 >= 11:
                want.add((a, c, b))
        assert got == want


def test_repeated_passages_are_found_and_no_others(spark, sf, texts):
    w = {i: substring_dedup.words_of(t) for i, t in texts.items()}
    runs = defaultdict(set)
    for i, x in w.items():
        for k in range(len(x) - 49):
            runs[" ".join(x[k : k + 50])].add(i)
    exact = {i for s in runs.values() if len(s) > 1 for i in s}
    got = {r["doc_id"]: r["class_id"] for r in queries.op2_substring_dedup(spark, sf).collect()}
    assert exact <= set(got) and all(len({got[i] for i in s}) == 1 for s in runs.values() if len(s) > 1)
    grams = {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} for i, x in w.items()}
    for i in set(got) - exact:  # nearly repeated: much in common with another of the class
        assert max(len(grams[i] & grams[j]) for j in got if j != i and got[j] == got[i]) >= 36


def test_planted_passages_with_edits(spark):
    rng = np.random.default_rng(5)
    fill = lambda n: [f"f{k}" for k in rng.integers(0, 10**6, n)]
    passage, rows_ = [f"p{k}" for k in range(80)], []
    for k in range(30):
        own = list(passage)
        if k % 3 == 1:
            own[40] = f"edit{k}"
        if k % 3 == 2:
            own.insert(30, "inserted")
        rows_.append((k, " ".join(fill(150) + own + fill(90))))
    rows_ += [(100 + k, " ".join(fill(300))) for k in range(30)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(30)) and {r["class_id"] for r in got} == {0}


def test_short_passages_in_many_surroundings(spark):
    rng = np.random.default_rng(11)
    fill = lambda n: [f"f{k}" for k in rng.integers(0, 10**6, n)]
    rows_ = [(p * 1000 + k, " ".join(fill(30) + [f"p{p}x{i}" for i in range(50)] + fill(30))) for p in range(120) for k in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i // 1000 * 1000 for i, _ in rows_}


def test_passages_with_words_put_in(spark):
    rng = np.random.default_rng(2)
    fill = lambda n: [f"f{k}" for k in rng.integers(0, 10**6, n)]
    rows_ = []
    for k in range(24):
        one, more = [f"p{k}x{i}" for i in range(80)], 5 + k % 6
        two = one[:40] + [f"in{k}x{i}" for i in range(more)] + one[40:]
        rows_ += [(2 * k, " ".join(fill(60) + (two if k % 4 < 2 else one) + fill(60))), (2 * k + 1, " ".join(fill(60) + (one if k % 4 < 2 else two) + fill(60)))]
    want = {i for i, _ in rows_ if 72 >= 0.8 * (80 + 5 + i // 2 % 6)}  # 72 shingles in common of 76 and 76 + the words put in + 4
    got = {r["doc_id"]: r["class_id"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert len(set(got) & want) >= 0.8 * len(want) and all(c == i // 2 * 2 for i, c in got.items())


def test_binomial_bound(spark):
    from math import comb

    df = spark.createDataFrame([(n, x) for n in (1, 5, 50, 400) for x in (0, 1, 4) if x <= n], "n long, x long")
    for r in df.select("n", "x", quality_rules.binomial_tail(F.col("n"), F.col("x"), 0.03).alias("p")).collect():
        want = sum(comb(r["n"], i) * 0.03**i * 0.97 ** (r["n"] - i) for i in range(r["x"] + 1))
        assert abs(r["p"] - want) < 1e-10


def test_cutoffs_bound_false_rejections(spark):
    text = lambda k: "word " * 30 + "#" * (200 if k % 2 else 0)
    docs = spark.createDataFrame([(k, text(k), "en", "s", 1) for k in range(6000)], DOCS).withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    docs = docs.withColumn("text", F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), i, F.col("doc_id"))), " "), F.when(F.col("doc_id") % 2 == 1, F.lit(" " + "# " * 99)).otherwise("")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    out = quality_rules.judged(docs, labels).groupBy((F.col("doc_id") % 2).alias("bad")).agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()
    assert {r["bad"]: r["kept"] for r in out} == {0: 3000, 1: 0}


def test_mixing_meets_its_targets(spark):
    docs = spark.createDataFrame([(k, "t", "en", "big" if k % 10 else "small", 1) for k in range(20_000)], DOCS)
    got = {r["source"]: r["n"] for r in mixing.replicate(docs, {"big": 1, "small": 3}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["small"] - 15_000) < 600 and abs(got["big"] - 5_000) < 400
    again = mixing.replicate(docs, {"big": 1, "small": 3})
    assert rows(again.toPandas()) == rows(mixing.replicate(docs.repartition(7), {"big": 1, "small": 3}).toPandas())
    assert mixing.replicate(docs, {"big": 1}).select("source").distinct().count() == 1 and mixing.replicate(docs, {}).count() == 0


def test_toxicity_on_the_held_out_fold(spark):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "li", "mu", "ne") for b in ("ra", "so", "ti", "vu") for c in ("", "n", "st", "el")]
    text = lambda bad: " ".join([*rng.choice(words, 60), *(["blorkface"] if bad else []), *rng.choice(words, 60)])
    y = np.arange(400) % 4 == 0
    model = toxicity.train([text(b) for b in y], y.astype(int))
    assert np.mean([model.score(text(True)) > 0.5 for _ in range(50)]) > 0.9 and np.mean([model.score(text(False)) < 0.5 for _ in range(50)]) > 0.9
    plain = text(False)
    assert model.score(plain + " blorkfaces") > model.score(plain)  # shares n-grams with what it has seen


def test_quality_on_the_held_out_fold(spark, docs):
    from pyspark.sql import Row

    labels = docs.select("doc_id", (F.length(F.regexp_replace("text", "[^#$%&*|!]", "")) < F.length("text") / 50).cast("int").alias("quality"))
    got = quality_model.classify(docs, labels).join(labels, "doc_id").where(toxicity.fold("doc_id", 3) == 1).collect()
    assert isinstance(got[0], Row) and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9


# --- odd tables --------------------------------------------------------------------------------------------------------


def test_odd_rows(spark, odd, labels):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "the same line the same line the same"), (3, "word")], "item_id long, text string")
    n = len(ODD)
    assert simhash.classes(odd).count() == n and quality_rules.judged(odd, labels).count() == n and secrets.find_secrets(odd).count() == n and pii.find_personal_data(odd).count() == n
    empty = {r["doc_id"]: r for r in simhash.classes(odd).collect()}
    assert empty[1]["fingerprint"] == "0" * 16 and empty[3]["component_id"] == 1
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contained(odd, items).collect()] == [(5, None)]
    assert token_output.digest(token_output.encode(odd)).count() == n
    tokens = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_output.encode(odd).collect())
    assert tokens[0][1] is None and [s for s, *_ in tokens] == list(np.cumsum([0] + [k for *_, k in tokens])[:-1]) and {k for _, i, k in tokens if i in (1, 2, 3)} == {1}
    assert substring_dedup.repeated_passages(odd).count() == 0
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == n and quality_model.classify(odd, labels).count() == n
    assert {r["doc_id"] for r in mixing.replicate(odd).collect()} <= {r[0] for r in ODD}


def test_stages_keep_the_columns(spark, odd, labels):
    items = spark.createDataFrame([(1, "the same line the same line the same")], "item_id long, text string")
    for out in (simhash.deduplicate(odd), quality_rules.keep_good(odd, labels), decontaminate.decontaminate(odd, items)):
        assert out.columns == odd.columns
        out.collect()
    kept = [r["doc_id"] for r in simhash.deduplicate(odd).collect()]
    assert kept.count(4) == 1 and kept.count(1) == 1 and None in kept and 2 not in kept
    assert 5 not in {r["doc_id"] for r in decontaminate.decontaminate(odd, items).collect()}


def test_null_ids_do_not_reject_others(spark, labels):
    good = " ".join(f"w{k}" for k in range(60))  # xxhash64 of a null is 42
    docs = spark.createDataFrame([(42, good, "en", "s", 1), (None, None, "en", "s", 1), (None, good + " x", "en", "s", 1)], DOCS)
    assert sorted((r["doc_id"] is None, r["text"]) for r in quality_rules.keep_good(docs, labels).collect()) == [(False, good), (True, good + " x")]


def test_empty_tables(spark, none, labels):
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        simhash.classes(none), simhash.deduplicate(none), decontaminate.contained(none, items), quality_rules.judged(none, labels.limit(0)), mixing.replicate(none),
        token_output.encode(none), secrets.find_secrets(none), pii.find_personal_data(none), substring_dedup.repeated_passages(none),
        toxicity.score(none, toxicity.fit(none, labels.limit(0))), quality_model.classify(none, labels.limit(0)),
    ):
        assert df.count() == 0 and isinstance(df.schema, S.StructType)


def test_pipeline_agrees_with_brute_force(spark, sf, texts):
    import corpus_pipeline as P

    got = sorted(map(tuple, P.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    judged = queries.op3_quality_rules(spark, sf).collect()
    own = {r["doc_id"]: texts[r["doc_id"]] for r in judged if r["kept"]}
    low = brute_classes({i: brute_fingerprint(t) for i, t in own.items()})
    own = {i: t for i, t in own.items() if low[i] == i}
    sh = lambda t: {" ".join(x) for x in zip(*(re.findall(r"[^\W_]+", t.lower())[k:] for k in range(5)))}
    items = [sh(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = {i: t for i, t in own.items() if not any(s and len(s & sh(t)) >= 0.8 * len(s) for s in items)}
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = defaultdict(int)
    for i in own:
        n[source[i]] += 1
    out, start = [], 0
    enc = token_output._encoder(__import__("public_tokenizers").path("word_bpe_49k.json")).tokenizer
    for i in sorted(own):
        rate = len(own) / len(n) / n[source[i]]
        u, term, cdf, times = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52, np.exp(-rate), 0.0, 0
        while (cdf := cdf + term) <= u:
            times += 1
            term *= rate / times
        ids = np.array([*enc.encode(own[i], add_special_tokens=False).ids, 2], dtype="<u4")
        for _ in range(times):
            out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert got == out


# --- rows, columns and folders --------------------------------------------------------------------------------------------


def test_mixing_keeps_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(k, "t", "en", None if k % 3 else "s", 1) for k in range(300)], DOCS).withColumn("copy", F.concat(F.lit("c"), F.col("doc_id") % 5)).withColumn("mix_key", F.lit("mine"))
    out = mixing.replicate(docs)
    assert out.columns == [*docs.columns, "_copy", "_mix_key"] and {r["mix_key"] for r in out.collect()} == {"mine"}
    assert {r["copy"] for r in out.collect()} == {f"c{k}" for k in range(5)} and {r["source"] for r in out.collect()} == {None, "s"}
    keys = [r["_mix_key"] for r in out.collect()]
    assert keys == sorted(keys)  # dealt and sorted over all partitions


@pytest.mark.parametrize("rate", [0.3, 5.0, 700.0, 20_000.0])
def test_poisson_counts(spark, rate):
    """One document of a rare source: its count is that of the distribution function at its number."""
    docs = spark.createDataFrame([(k, "t", "en", f"s{k}", 1) for k in range(40)], DOCS)
    table = mixing.rates(docs, {f"s{k}": 1.0 for k in range(40)}).withColumn("_rate", F.lit(rate))
    assert table.select(F.max(F.size("_cdf"))).first()[0] < 100
    big = spark.createDataFrame([(0, "t", "en", "rare", 1)] + [(k, "t", "en", "many", 1) for k in range(1, 40)], DOCS)
    weights = {"rare": rate / 40, "many": 1 - min(rate / 40, 0.9)} if rate < 40 else {"rare": 1.0}
    r = mixing.rates(big, weights).where("_source = 'rare'").first()
    low, cdf, mean = r["_low"], r["_cdf"], r["_rate"]
    total, term = 0.0, None
    from math import exp, lgamma, log

    for k in range(low, low + len(cdf)):
        total += exp(k * log(mean) - mean - lgamma(k + 1))
        assert abs(cdf[k - low] - total) < 1e-9
    assert term is None and cdf[-1] > 1 - 1e-12


def test_large_rates_have_short_tables(spark):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "rare").otherwise("many").alias("source"))
    r = {x["_source"]: x for x in mixing.rates(docs).collect()}
    assert len(r["rare"]["_cdf"]) < 24 * 317 + 100 and abs(r["rare"]["_rate"] - 100_000) < 1e-6 and r["rare"]["_low"] > 90_000
    assert abs(r["rare"]["_cdf"][100_000 - r["rare"]["_low"]] - 0.5) < 0.01


def test_rows_are_judged_each_for_itself(spark, labels):
    good, item = " ".join(f"w{k}" for k in range(60)), "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, good, "en", "s", 1), (1, "short", None, "s", 1), (None, good + " x", "", "s", 1), (None, f"{good} {item} {good}", "en", "s", 1), (1, f"{item} {good}", "en", "s", 1)], DOCS)
    kept = sorted(r["text"] for r in quality_rules.keep_good(docs, labels).collect())
    assert kept == sorted([good, good + " x", f"{item} {good}"])  # the fourth repeats over 30 % of its words
    items = spark.createDataFrame([(9, item), (None, item)], "item_id long, text string")
    left = sorted(r["text"] for r in decontaminate.decontaminate(docs, items).collect())
    assert left == sorted([good, good + " x", "short"])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items).collect()} == {(1, 9), (1, None), (None, 9), (None, None)}


def test_one_row_of_each_class_stays(spark):
    a, b = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, b, "en", "s", 1), (2, b, "xx", "s", 1), (None, a, "en", "s", 1)], DOCS)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.deduplicate(docs).collect())
    assert got == sorted([(1, a), (2, b), (0, a)])


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.set_checkpoint_dir(Session())


# --- methods in substance -------------------------------------------------------------------------------------------------


def test_items_of_all_sizes_with_common_phrases(spark):
    """Items that share a phrase with many documents: the phrase alone makes no match, and whole items are found at every size."""
    rng = np.random.default_rng(8)
    head = "please answer the following question with a single word".split()
    items = [(k, " ".join(head + [f"i{k}x{j}" for j in range(1 + k)])) for k in range(40)]
    fill = lambda: [f"f{j}" for j in rng.integers(0, 9999, 80)]
    docs = [(k, " ".join([*fill(), *head, *fill(), *(items[k % 40][1].split() if k % 2 else []), *fill()])) for k in range(160)]
    sh = lambda t: {tuple(x) for x in zip(*(t.split()[i:] for i in range(5)))}
    want = {(i, j) for i, t in docs for j, u in items if len(sh(t) & sh(u)) >= 0.8 * len(sh(u))}
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 80


def test_near_copies_of_passages_are_found(spark):
    """Recall against the exact similarity of planted passages with random edits: at least 0.9 of those of similarity 0.8 or more."""
    rng = np.random.default_rng(21)
    fill = lambda n: [f"f{k}" for k in rng.integers(0, 10**6, n)]
    sh = lambda w: {tuple(x) for x in zip(*(w[i:] for i in range(5)))}
    rows_, wanted = [], set()
    for p in range(200):
        one = [f"p{p}x{k}" for k in range(int(rng.integers(60, 160)))]
        two = list(one)
        for _ in range(int(rng.integers(1, 5))):
            at = int(rng.integers(5, len(two) - 5))
            two[at : at + int(rng.integers(0, 2))] = [f"e{rng.integers(0, 10**6)}"] * int(rng.integers(0, 2))
        if len(sh(one) & sh(two)) >= 0.8 * len(sh(one) | sh(two)):
            wanted.add(p)
        rows_ += [(2 * p, " ".join(fill(70) + one + fill(70))), (2 * p + 1, " ".join(fill(70) + two + fill(70)))]
    got = {r["doc_id"]: r["class_id"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert len(wanted) > 100 and len([p for p in wanted if got.get(2 * p) == got.get(2 * p + 1) == 2 * p]) >= 0.9 * len(wanted)
    assert all(c == i // 2 * 2 for i, c in got.items())


def test_near_copies_among_shorter_shares_are_found(spark):
    """Neighbours in the sort order of a group are then mostly texts that share too little; the near copies stand apart, and are met by a second step."""
    rng = np.random.default_rng(8)
    fill = lambda n: [f"f{k}" for k in rng.integers(0, 10**6, n)]
    rows_ = []
    for p in range(80):
        one = [f"p{p}x{k}" for k in range(80)]
        two = [*one[:40], f"e{p}", *one[41:]]  # similarity 71 / 81
        rows_ += [(100 * p, " ".join(fill(70) + one + fill(70))), (100 * p + 50, " ".join(fill(70) + two + fill(70)))]
        for k in range(40):
            at = int(rng.integers(0, 37))
            rows_.append((100 * p + 1 + k, " ".join(fill(70) + one[at : at + 44] + [f"d{p}x{k}"] + fill(70))))
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    for df in (docs, docs.repartition(3)):
        got = {r["doc_id"]: r["class_id"] for r in substring_dedup.repeated_passages(df).collect()}
        assert len([p for p in range(80) if got.get(100 * p) == got.get(100 * p + 50) == 100 * p]) >= 0.9 * 80
        assert all(i % 50 == 0 and c == i // 100 * 100 for i, c in got.items())


def test_spans_hold_all_exact_repeats_of_a_document(spark):
    """A short repeat stands between two long ones in the sort order of their minima: the long ones are reported whole, and not only what they share with their neighbour."""
    rng = np.random.default_rng(31)
    fill = lambda n: [f"f{k}" for k in rng.integers(0, 10**6, n)]
    rows_, want = [], {}
    for p in range(400):
        one = [f"p{p}x{k}" for k in range(62)]
        for k, part in enumerate((one, one[12:], one)):
            head, tail = " ".join(fill(70)), " ".join(fill(70))
            rows_.append((3 * p + k, f"{head} {' '.join(part)} {tail}"))
            want[3 * p + k] = len(head) + 1
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == set(want)
    assert not [r["doc_id"] for r in found if min(s["start"] for s in r["spans"]) > want[r["doc_id"]]]


def test_near_copies_that_only_their_surroundings_of_a_minimum_bring_together(spark):
    """Documents with the same 23 words beside a minimum are met in all pairs if their chain leaves them in different classes, also under one hash function alone."""
    rng = np.random.default_rng(4)
    fill = lambda n: [f"f{k}" for k in rng.integers(0, 10**6, n)]
    rows_ = []
    for p in range(150):
        one = [f"p{p}x{k}" for k in range(70)]
        two = [*one[:35], f"e{p}", *one[36:]]
        parts = [one, *(one[at : at + 30] for at in range(0, 41, 5)), two]
        rows_ += [(100 * p + k, " ".join(fill(60) + part + fill(60))) for k, part in enumerate(parts)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").select(F.col("doc_id").alias("doc"), "text")
    made = substring_dedup.candidates(docs).where("member is not null").select(F.col("doc").alias("key"), F.col("doc2").alias("doc"), "member")
    met = {(r["doc"], r["doc2"]) for r in substring_dedup.apart(docs, made, spark.createDataFrame([], "node long, root long")).collect()}
    beside = {d: {(k, b & 0xFFFFFFFF) for k, b in zip(*(substring_dedup.windows([d], [t])[c].tolist() for c in ("key", "beside")), strict=True)} for d, t in rows_ if d % 100 in (0, 10)}
    want = {(d, d + 10) for d in beside if d % 100 == 0 and beside[d] & beside[d + 10]}
    assert len(want) > 100 and want <= met and all(b == a + 10 and a % 100 == 0 for a, b in met)


def test_pairs_that_share_too_little_are_told_without_their_texts(spark, monkeypatch):
    """Documents whose repeated words are too few for a passage are met by their tokens: no text is sent for such a pair."""
    rng = np.random.default_rng(8)
    fill = lambda n: [f"f{k}" for k in rng.integers(0, 10**6, n)]
    rows_ = [(100 * p + k, " ".join(fill(70) + [f"p{p}x{i}" for i in range(38)] + fill(70))) for p in range(5) for k in range(60)]
    sent, verified = [], substring_dedup._verified
    monkeypatch.setattr(substring_dedup, "_verified", lambda pairs, every: (sent.append(pairs.count()), verified(pairs, every))[1])
    assert substring_dedup.repeated_passages(spark.createDataFrame(rows_, "doc_id long, text string")).count() == 0
    assert sum(sent) < 2 * len(rows_)  # neighbours; pairs are 30 for each


def test_grammar_ends_without_frequent_pairs():
    rng = np.random.default_rng(4)
    phrases = [rng.integers(0, 49_000, 12) for _ in range(40)]
    ids = np.concatenate([phrases[k] for k in rng.integers(0, 40, 4000)]).astype(np.uint16)
    x, rules, spans = token_output.compress(ids)
    pairs = (x[:-1].astype(np.int64) << 16) | x[1:]
    assert np.unique(pairs, return_counts=True)[1].max() < 2 * token_output.LEAST and len(x) < len(ids) / 8  # of a run of one symbol every second pair counts
    assert (token_output.expand(x, rules, spans) == ids).all() and spans.max() >= 12


@pytest.mark.parametrize("period", [2, 3, 256, 375])
def test_copies_are_replaced_in_phase(period):
    """Where occurrences overlap, the same ones are replaced in every copy, wherever it stands."""
    rng = np.random.default_rng(period)
    copy = rng.permutation(49_000)[:period].astype(np.uint16)
    ids = np.concatenate([np.tile(copy, 3000), *(np.append(copy, rng.integers(0, 49_000, k % 5)).astype(np.uint16) for k in range(1000))])
    x, rules, spans = token_output.compress(ids)
    assert (token_output.expand(x, rules, spans) == ids).all()
    assert len(x) < 100 + 3.2 * 1000 and len(rules) < 2 * period + 400  # the copies, and the ids between the last ones


@pytest.mark.parametrize("ids", [[], [5], [5, 5], [5] * 7, [5, 6] * 5, [5, 5, 6] * 9])
def test_grammar_of_few_ids(ids):
    for least in (2, 3, 32):
        x, rules, spans = token_output.compress(np.array(ids, dtype=np.uint16), least)
        assert token_output.expand(x, rules, spans).tolist() == ids


def test_starts_over_files_and_groups_of_files(spark, monkeypatch, tmp_path):
    """Starts are the running sum in the order of files and rows, however the files are grouped; rows of one id lie in several shards."""
    monkeypatch.setattr(token_output, "FILES_TOGETHER", 3)
    import public_tokenizers

    rows = [(k % 90 if k % 3 else 7, f"word{k} and some more of it {k * 7919 % 1000}" if k % 11 else None) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    token_output.write_shards(docs, str(tmp_path / "shards"), public_tokenizers.path(token_output.VOCABULARY), shard_ids=40)
    out = token_output.read_shards(spark, str(tmp_path / "shards")).toPandas().sort_values("start", kind="stable")
    assert len(out) == 900 and (out["start"].to_numpy() == np.append(0, np.cumsum(out["n_tokens"].to_numpy())[:-1])).all()
    assert (np.diff(out["doc_id"].to_numpy()) >= 0).all()


def test_another_vocabulary_goes_through_the_library(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    given = json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    given["normalizer"]["normalizers"] = given["normalizer"]["normalizers"][:2]  # keeps capitals
    (tmp_path / "other.json").write_text(json.dumps(given))
    enc, own = token_output.WordEncoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not enc.by_words
    assert np.frombuffer(enc(["Don't SHOUT at Me"])[0], dtype="<u2").tolist() == own.encode("Don't SHOUT at Me", add_special_tokens=False).ids
    given["model"]["vocab"] |= {f"extra{k}": 49_406 + k for k in range(300)}
    (tmp_path / "large.json").write_text(json.dumps(given))
    with pytest.raises(ValueError, match="ids from"):
        token_output.WordEncoder(str(tmp_path / "large.json"))


def test_personal_data_in_other_forms(spark):
    """Spans that the patterns don't read: how many the model finds, and how many it makes up."""
    rng = np.random.default_rng(2)
    names, hosts = ["ann", "bob.k", "cy_d", "dora", "eve99"], ["mail.org", "host.net", "firm.co.uk"]

    def luhn_card():
        d = rng.integers(0, 10, 15).tolist()
        return next(x for k in range(10) if pii.luhn(x := "".join(map(str, [*d, k]))))

    def spans(k):
        n = lambda a: "".join(map(str, rng.integers(0, 10, a)))
        c = luhn_card()
        base = (f"{names[k % 5]}@{hosts[k % 3]}", ".".join(map(str, rng.integers(0, 256, 4))), " ".join(c[i : i + 4] for i in (0, 4, 8, 12)), f"+1 {n(3)} {n(3)} {n(4)}")
        other = (f"{names[k % 5]} @ {hosts[k % 3]}", None, ".".join(c[i : i + 4] for i in (0, 4, 8, 12)), f"({n(3)}) {n(3)}-{n(4)}")
        return base, other

    plain = lambda: " ".join(rng.choice(["the", "order", "of", "12", "from", "2019", "pages", "3.5", "and", "7,200", "units", "in", "1998", "was"], 12))
    docs = [(k, f"{plain()} {spans(k)[0][k % 4]} {plain()}") for k in range(1200)] + [(5000 + k, plain()) for k in range(400)]
    w = pii.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    hit = made = n = 0
    for k in range(300):
        want = spans(k)[1][k % 4]
        if want:
            text = f"{plain()} {want} {plain()}"
            at = text.index(want)
            found = pii.model_spans(text, w, pii.base_spans(text))
            n += 1
            hit += any(a < at + len(want) and at < b and pii.KINDS[k % 4] == kind for kind, a, b, _ in found)
        made += len(pii.model_spans(plain(), w, []))
    assert hit >= 0.8 * n and made <= 6


def test_random_strings_are_found(spark):
    """Recall over planted keys of several alphabets and lengths, and what is marked of ordinary long words and names."""
    import public_tokenizers

    rng, encode = np.random.default_rng(6), secrets.encoding(public_tokenizers.path(secrets.VOCABULARY)).encode_ordinary
    sets = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    keys = ["".join(rng.choice(list(sets[k % 4]), int(rng.integers(24, 64)))) for k in range(400)]
    found = [k for k in keys if secrets.random_spans(f"set it to {k} now", [], encode)]
    assert len(found) >= 0.9 * len(keys)
    draw = lambda n, letters=sets[0]: "".join(rng.choice(list(letters), n))
    forms = {
        "path": lambda: (k := draw(32), f"see https://api.example.com/v1/items/{k} now"),
        "query": lambda: (k := draw(24), f"https://example.com/path/to/page?auth={k}&x=1"),
        "letters": lambda: (k := draw(24, sets[0][:52]), f"use {k} now"),
        "dotted": lambda: (k := ".".join(draw(14) for _ in range(3)), f"use {k} now"),
        "token": lambda: (k := f"eyJ{draw(33)}.eyJ{draw(60)}.{draw(43, sets[0] + '-_')}", f"Bearer {k} end"),
    }
    for name, form in forms.items():
        made = [form() for _ in range(200)]
        whole = sum(any(a <= t.index(k) and t.index(k) + len(k) <= b for a, b, _ in secrets.random_spans(t, [], encode)) for k, t in made)
        assert whole >= 180, name
    plain = ["getHTTPResponseCodeFromURL", "https://www.example.com/some/long/path/index.html", "com.example.project.module.ClassName", "2024-01-01T00:00:00.000Z", "a.b.c.d.e.f.g.h.i.j.k.l.m", "192.168.100.200.1.2.3.4.5",
             "someVeryLongCamelCaseVariableNameHere", "internationalization-and-localization-2024", "the_quick_brown_fox_jumps_over_13_dogs", "Donaudampfschifffahrtsgesellschaft1830", "https/example/path/to/resource/index2", "version-2024-10-01-release-candidate"]
    assert not any(secrets.random_spans(x, [], encode) for x in plain)


def _held_out(got, labels, fold, column):
    y = {r["doc_id"]: r[column] for r in labels if r[column] is not None}
    rows_ = [(r["score"], r["predicted"], y[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in y]
    good, bad = [s for s, _, t in rows_ if t == 1], [s for s, _, t in rows_ if t == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    return auc, np.mean([p for _, p, t in rows_ if t == 1]), np.mean([p for _, p, t in rows_ if t == 0]), len(rows_)


@pytest.mark.parametrize(("name", "column", "least"), [("op8_toxicity", "toxic", (0.85, 0.6, 0.2)), ("op10_quality_model", "quality", (0.85, 0.6, 0.3))])
def test_held_out_figures(spark, name, column, least):
    sf = "/root/testdata/sf0.1"  # below that the held-out fold has a handful of toxic documents
    got = queries.queries()[name](spark, sf).collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    auc, recall, marked, n = _held_out(got, labels, None, column)
    print(name, auc, recall, marked, n)
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert auc >= least[0] and recall >= least[1] and marked <= least[2]


def _clean(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(map(chr, rng.integers(97, 123, int(rng.integers(3, 9))))) for _ in range(n))


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_on_odd_tables(spark, odd, none, labels, tmp_path, empty):
    """Of the odd rows the base rules reject all; the clean ones beside them go through, whatever their ids, and only what a stage is for goes."""
    import corpus_pipeline as P

    item = _clean(9, 20)
    good = [(20, _clean(0)), (21, _clean(0)), (42, _clean(1)), (None, _clean(2)), (None, None), (23, f"{_clean(3)} {item} {_clean(4)}"), (24, _clean(5)), (24, _clean(6))]
    extra = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in good], DOCS).withColumns({c: F.lit("clash") for c in odd.columns[5:]})
    (none if empty else odd.unionByName(extra)).write.parquet(f"{tmp_path}/documents.parquet")
    (labels.limit(0) if empty else labels).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if empty else [(1, None), (2, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = P.read(spark, str(tmp_path), "documents")
    left = [[20, 21, 23, 24, 24, 42, None], [20, 23, 24, 24, 42, None], [20, 24, 24, 42, None]]  # after rules, copies, benchmark
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        if k < 3:
            docs = out.persist()
            assert sorted((r["doc_id"] for r in docs.collect()), key=lambda x: (x is None, x or 0)) == ([] if empty else left[k])
    mixed = sorted(str(r["doc_id"]) for r in out.collect())
    got = P.run(spark, str(tmp_path))
    assert set(got.columns) >= {"doc_id", "start", "n_tokens", "ids_crc32"} and sorted(str(r["doc_id"]) for r in got.collect()) == mixed
    assert empty == (not mixed)


def test_quality_contexts_are_those_of_a_loop_and_signs_are_made_once():
    from codeloom.llm import quality_model as q

    assert q.sparse_signs() is q.sparse_signs()
    signs = np.concatenate((q.sparse_signs(), np.zeros((1, q.DIMENSION), dtype=np.int64))).astype(np.int32)
    reader = q.Reader()
    texts = [reader(x) for x in ("a a a", "x", "One two two, three 4 one", "b")]
    got, want = (np.zeros((q.ROWS + 1, q.DIMENSION + 1), dtype=np.int64) for _ in range(2))
    q.add_contexts(got, texts, signs)
    for rows, marks in texts:
        n = len(rows)
        for k in range(n):
            near = sum((signs[rows[j]] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < n), signs[marks[k]].copy())
            for at in (rows[k], marks[k], marks[n + k]):
                want[at, :-1] += near
                want[at, -1] += 1
    assert (got[: q.ROWS] == want[: q.ROWS]).all()
