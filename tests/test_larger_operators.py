"""Operators that have more than one way to a result, or a state, against plain loops and across restarts."""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codeloom import plans
from codeloom.operators import budget, chains, codebook, graph, items, memory
from codeloom.sources import readers, writers
from codeloom.streaming import jobs, merging

QUERIES = plans.queries()


# --- phrases ---------------------------------------------------------------------------------------------------------

TEXTS = [(1, "New  York is new, York! new york-new york"), (1, "the new york"), (2, "a a a a"), (3, None), (4, ""), (5, "ÉTÉ d'été 日本 語 x"), (None, "New York")]
KEYWORDS = ["new york", "New-York", "york", "a a", "a", "été", "日本 語", "d été", "", "--", None, "absent words here", "york new york"]


def plain(t):
    return " ".join(re.findall(r"[^\W_]+", (t or "").lower()))


@pytest.mark.parametrize("few", [100_000, 0])
def test_phrases_are_found_by_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(codebook, "FEW_KEYWORDS", few)
    got = codebook.tag(spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string"))
    want = Counter()
    for i, t in TEXTS:
        for k in {plain(k) for k in KEYWORDS} - {""}:
            n = len(re.findall(rf"(?= {re.escape(k)} )", f" {plain(t)} "))
            want.update({(i, k): n} if n else {})
    assert {(r["doc_id"], r["keyword"]): r["n"] for r in got.collect()} == want
    none = codebook.tag(spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame([], "keyword string"))
    assert none.count() == 0


def test_phrases_of_a_large_index_agree_with_a_small_one(spark, sf, monkeypatch):
    small = {tuple(r) for r in QUERIES["j12_phrase_tags"](spark, sf).collect()}
    monkeypatch.setattr(codebook, "FEW_KEYWORDS", 0)
    assert {tuple(r) for r in QUERIES["j12_phrase_tags"](spark, sf).collect()} == small and len(small) > 1000


# --- budgets ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("key", ["key", None])
@pytest.mark.parametrize("seconds", [60, 600])
def test_rolling_sums_of_ties_edges_and_a_busy_key(spark, closed, key, seconds):
    rng = random.Random(7)
    rows = [(k, rng.choice(["busy"] * 8 + ["a", "b", None]), rng.choice([None, *range(-90, 4000)]), rng.randrange(50), rng.choice([None, 1, 2])) for k in range(500)]
    rows += [(500 + k, "busy", at, 1, 1) for k, at in enumerate([0, 60, 60, 600, 1200, 120])]  # exactly on the edges
    log = spark.createDataFrame(rows, "event_id long, key string, s long, in_tokens int, out_tokens int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: (r["requests"], r["in_used"], r["out_used"]) for r in budget.rolling(log, seconds, closed, key).collect()}
    for i, k, s, *_ in rows:
        own = [r for r in rows if (key is None or r[1] == k) and (r[2] is None if s is None else r[2] is not None and s - seconds + (not closed) <= r[2] <= s)]
        want = (len(own), sum(r[3] for r in own), sum(r[4] or 0 for r in own))
        assert (got[i][0], got[i][1], got[i][2] or 0) == want, (i, k, s)


# --- circles ---------------------------------------------------------------------------------------------------------


def brute_components(edges):
    out, inn = {}, {}
    for a, b in edges:
        if a != b and a is not None and b is not None:
            out.setdefault(a, set()).add(b)
            inn.setdefault(b, set()).add(a)

    def reach(start, step):
        seen, todo = {start}, [start]
        while todo:
            for x in step.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    return {v: (min(c), len(c)) for v in out if len(c := reach(v, out) & reach(v, inn)) > 1}


def test_circles_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(60):03}", f"n{rng.randrange(60):03}") for _ in range(45)] + [(f"m{rng.randrange(20):03}", f"m{rng.randrange(20):03}") for _ in range(40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "n001"), ("s", "s"), (None, "s"), ("s", None)]
    edges += [(f"p{k:03}", f"p{k + 1:03}") for k in range(25)] + [("p025", "p000"), ("p010", "q"), ("q", "r")]
    got = {r["node"]: (r["component"], r["size"]) for r in graph.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == brute_components(edges) and len(set(got.values())) > 2
    assert graph.strong_components(spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d")], "src string, dst string")).count() == 0


def test_circles_of_all_factors(spark, sf):
    got = {r["factor"]: (r["component"], r["size"]) for r in QUERIES["r8_circles"](spark, sf).collect()}
    out, inn = {}, {}
    for r in chains.edges(plans.base.blocks(spark, sf)).select("src", "dst").where("src <> dst").distinct().collect():
        out.setdefault(r[0], set()).add(r[1])
        inn.setdefault(r[1], set()).add(r[0])

    def reach(start, step):
        seen, todo = {start}, [start]
        while todo:
            new = step.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    left, want = set(out) & set(inn), {}
    while left:
        v = min(left)
        c = reach(v, out) & reach(v, inn)
        left -= c
        if len(c) > 1:
            want |= {x: (min(c), len(c)) for x in c}
    assert got == want and got


# --- similarity ------------------------------------------------------------------------------------------------------


def test_best_window_is_that_of_a_full_scan():
    rng = random.Random(0)
    words = ["alpha", "beta", "gamma", "the", "of", "é", "delta-", "a"]
    for k in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))
        n = rng.choice([0, 1, 5, 30, 60, 220])
        needle = text[5 : 5 + n] if k % 3 else " ".join(rng.choice([*words, "other"]) for _ in range(n // 4))
        if k % 3 == 1:
            needle = "".join(c if rng.random() > 0.15 else rng.choice("xyz ") for c in needle)
        full = max((SequenceMatcher(None, needle, text[i : i + len(needle)]).ratio() for i in range(len(text) - len(needle) + 1)), default=0.0) if needle else 0.0
        assert items.best_window(needle, text) == full


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity_by_edits(spark):
    rng = random.Random(4)
    pairs = [("", None), ("Ab  c", "a B C"), ("été", "ete"), (None, "x")] + [("".join(rng.choice("abé ") for _ in range(rng.randrange(30))), "".join(rng.choice("abé ") for _ in range(rng.randrange(30)))) for _ in range(60)]
    got = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").select("k", items.edit_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    norm = lambda t: re.sub(r"\s+", " ", t or "").strip(" ").lower()
    for r in got:
        a, b = map(norm, pairs[r["k"]])
        assert r["s"] == pytest.approx(1 - edits(a, b) / max(len(a), len(b)) if a or b else 1.0)


def test_nearest_codes_lose_no_pair(spark):
    rng = random.Random(5)
    codes = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 22))) for _ in range(150)] + ["aaaaaaaaaa", " 'Quoted' ", None]
    words = [w for c in codes if c for w in (c, "".join(x for x in c if rng.random() > 0.1), c[:3] + "x" + c[3:], c[::-1])] + ["", None]
    got = {r["word"]: (r["code"], r["is_valid"]) for r in items.nearest_codes(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(c,) for c in codes], "code string")).collect()}
    norm = lambda c: c.lower().strip(" ").strip("'\"")
    known = {norm(c) for c in codes if c is not None}
    for w in {w for w in words if w is not None}:
        s = norm(w)
        near = [(1 - e / max(len(s), len(c)), c) for c in known if (e := edits(s, c)) <= int(max(len(s), len(c)) * 0.2 + 1e-9)] if s not in known else []
        assert got[w] == ((s, True) if s in known else (max(near)[1], True) if near else (s, False)), w


# --- templates -------------------------------------------------------------------------------------------------------


def test_bundles_are_all_or_none(spark):
    values = [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "a", "again"), (3, "b", ""), (3, "a", None), (4, "c", "z"), (4, "b", "y"), (None, "a", "x"), (5, "other", "x")]
    df = spark.createDataFrame(values, "item_id long, field string, value string")
    bundles = spark.createDataFrame([(["a", "b"],), (["b", "c", "d"],)], "fields array<string>")
    got = {(r["item_id"], r["bundle"], "".join(r["given"]), "".join(r["missing"])) for r in codebook.broken_bundles(df, bundles).collect()}
    assert got == {(2, "a+b", "a", "b"), (1, "b+c+d", "b", "cd"), (4, "a+b", "b", "a"), (4, "b+c+d", "bc", "d"), (None, "a+b", "a", "b")}
    specs = spark.createDataFrame([("a", "TEXT", False, None, None, None)], "field string, type string, required boolean, allowed array<string>, low double, high double")
    assert {tuple(r) for r in codebook.violations(df, specs, bundles.limit(1)).collect()} == {(i, "a+b", "BUNDLE") for i in (2, 4, None)}


# --- places ----------------------------------------------------------------------------------------------------------


def test_place_keys_sort_as_their_parts_and_come_back(spark):
    big = (1 << 63) - 1
    rows = [(d, b) for d in (-big - 1, -5, -1, 0, 1, big) for b in (0, 1, (1 << 31) - 1)]
    df = spark.createDataFrame(rows, "doc_id long, block_seq int").withColumn("key", (chains.place_key() + F.lit(7).cast("decimal(19,0)")).cast("decimal(38,0)"))
    got = df.orderBy("key").select("doc_id", "block_seq", chains.place_of("key").alias("p")).collect()
    assert [(r["doc_id"], r["block_seq"]) for r in got] == sorted(rows)
    assert all((r["p"]["doc_id"], r["p"]["block_seq"], r["p"]["at"]) == (r["doc_id"], r["block_seq"], 7) for r in got)


def test_pairs_of_named_documents_agree_with_numbered_ones(spark, sf):
    b = plans.base.blocks(spark, sf).where("doc_id < 40")
    named = b.withColumn("doc_id", F.format_string("%09d", "doc_id"))
    tell = lambda df: {(r["factor"], r["co_factor"], r["n"], int(r["first_seen"]["doc_id"]), *tuple(r["first_seen"])[1:]) for r in df.collect()}
    assert tell(chains.co_occurrences(b)) == tell(chains.co_occurrences(named))


def test_contexts_of_repeated_and_missing_ids(spark):
    """Documents that share an id have blocks of the same numbers: each context is there once, whichever of them has it."""
    rows = [(1, "Aaa bbb ccc here. Ddd eee fff there."), (1, "Aaa bbb ccc here. Ggg hhh iii else."), (1, "aaa  BBB ccc here."), (None, "Aaa bbb jjj."), (2, "Ddd eee fff there."), (3, None), (4, "")]
    b = chains.annotate(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = {}
    for r in b.where("doc_id is not null").collect():
        for f in r["factors"]:
            seen.setdefault((f, " ".join(r["excerpt"].lower().split())), []).append((r["doc_id"], r["block_seq"]))
    got = memory.scored_contexts(b).collect()
    assert {(r["factor"], " ".join(r["summary"].lower().split())): (r["doc_id"], r["block_seq"]) for r in got} == {k: min(v) for k, v in seen.items()} and len(got) == len(seen)
    best = memory.best_contexts(b).collect()
    assert sorted((r["factor"], r["place"]) for r in best) == sorted((f, k + 1) for f in {f for f, _ in seen} for k in range(min(3, sum(x == f for x, _ in seen))))
    assert memory.frequency(b).count() == chains.occurrences(b).select("factor").distinct().count() and chains.co_occurrences(b).where("first_seen.doc_id is null").count() > 0


def test_hot_plans_keep_no_rows_in_order(spark, sf):
    """Counting pairs and finding contexts needs hash aggregates alone: tasks sort no rows for it."""
    for df in (chains.co_occurrences(plans.base.blocks(spark, sf)), memory.context_places(plans.base.blocks(spark, sf))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


# --- formats in parts ------------------------------------------------------------------------------------------------


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_large_item_file_is_read_by_several_tasks(spark, sf, tmp_path, small_splits):
    coded = items.annotate(spark.read.parquet(f"{sf}/conversations.parquet")).withColumn("interview_id", F.lit("all"))
    (tmp_path / "all.syn").write_text(items.documents(coded).first()["syn"] + "\n", encoding="utf-8")
    found = readers.items_in_parts(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 5
    whole, _ = readers.item_files(spark, str(tmp_path))
    parts = found.orderBy("place").collect()
    assert [(r["item_id"], r["excerpt"], r["pairs"]) for r in parts] == [(r["item_id"], r["excerpt"], r["pairs"]) for r in whole.orderBy("item_seq").collect()]
    assert {r["header"] for r in parts} == {"SOURCE @all\n    código: N/A\nEND SOURCE"}


def test_a_memory_in_parts_is_one_json_object(spark, sf, tmp_path, small_splits):
    built = memory.build(plans.base.blocks(spark, sf).where("doc_id < 30"))
    odd = built.limit(1).withColumn("factor", F.lit('Quo"te \\ {brace}\n    "é')).withColumn("contexts", F.array(F.lit('a "b": {\n    }, c')))
    df = built.unionByName(odd).persist()
    writers.memory_in_parts(df, f"{tmp_path}/m", "src", 5)
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(Path(f"{tmp_path}/m").glob("part-*")))
    one = json.loads(text)
    assert one["metadata"] == {"source_file": "src", "total_factors": df.count(), "total_relations": 5} and len(one["factors"]) == df.count()
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "memory.json").write_text(json.dumps(one, indent=2, ensure_ascii=False), encoding="utf-8")  # as other programs write it
    want = sorted(map(str, df.collect()))
    for path in (f"{tmp_path}/m", f"{tmp_path}/one"):
        found = readers.memory_in_parts(spark, path)
        assert found.rdd.getNumPartitions() > 5 and sorted(map(str, found.select(df.columns).collect())) == want
    with pytest.raises(ValueError, match="no factors"):
        writers.memory_in_parts(df.limit(0), f"{tmp_path}/none", "src", 0)
        readers.memory_in_parts(spark, f"{tmp_path}/none")


# --- streams ---------------------------------------------------------------------------------------------------------


def test_items_merge_whatever_order_they_arrive_in(spark, tmp_path):
    rows = [(1, 3, "user", "Same words here. Other one!"), (1, 1, "user", "same  WORDS here."), (1, 2, "system", "Same words here. abc abc"), (2, 1, "user", None), (1, 5, "user", ""), (2, 4, "user", "abc abc. abc abc.")]
    schema = "conv_id long, turn long, role string, text string"
    folder = tmp_path / "in"
    with merging.rocksdb(spark):
        for k, part in enumerate((rows[:1], rows[1:2], rows[2:])):  # the job stops and starts again between the parts
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
            merging.upsert(merging.merged_items(jobs.parquet(spark, str(folder), spark.createDataFrame([], schema).schema, 1)), f"{tmp_path}/out")
            df = spark.createDataFrame(sum((rows[:1], rows[1:2], rows[2:])[: k + 1], []), schema)
            cols = ["interview_id", "turn", "sent", "excerpt", "pairs", "n_items"]
            got = sorted(map(tuple, merging.latest(spark, f"{tmp_path}/out", "interview_id", "key").select(cols).collect()))
            text = F.expr("array_join(transform(pairs, p -> concat(p.code, '=', p.rationale)), '|')")
            assert got == sorted(map(tuple, items.merged(items.annotate(df)).withColumn("pairs", text).select(cols).collect()))


def test_bad_files_fail_alone_and_files_count_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in {"good": "été\nline two", "bad": b"\xff\xfe\x00bad", "empty": b"", "blank": " \n\t ", "two words": "text"}.items():
        (folder / f"{name}.txt").write_bytes(data.encode() if isinstance(data, str) else data)
    (folder / "other.md").write_text("not read")
    merging.ingest_files(spark, str(folder), f"{tmp_path}/out", files=2)
    (folder / "late.txt").write_text("late")
    for _ in range(2):
        merging.ingest_files(spark, str(folder), f"{tmp_path}/out", files=2)
    texts, log = merging.read_ingested(spark, f"{tmp_path}/out")
    assert sorted((r["interview_id"], r["status"], r["error"]) for r in log.collect()) == [
        ("bad", "failed", "not valid UTF-8"), ("blank", "failed", "blank file"), ("good", "processed", None), ("late", "processed", None), ("two words", "processed", None)
    ]
    assert sorted(map(tuple, texts.collect())) == [("good", "été\nline two"), ("late", "late"), ("two words", "text")]


def test_sources_by_sketches_are_near(spark):
    rows = [(d, k, "x", [f"F{d % 3}", "All"], ["enables"]) for d in range(3000) for k in range(2)]
    b = spark.createDataFrame(rows, "doc_id long, block_seq int, excerpt string, factors array<string>, relations array<string>")
    for r in memory.approximate_sources(b).join(memory.frequency(b).withColumnRenamed("sources", "exact"), "factor").collect():
        assert abs(r["sources"] - r["exact"]) <= 0.05 * r["exact"]
