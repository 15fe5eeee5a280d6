"""What grows with the input: which columns are sent or kept, and how many steps are made."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from codeloom.operators import chains, items, memory, rules, storage, tagged
from codeloom.sources import readers, writers
from codeloom.streaming import merging


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_convergence_sends_no_excerpts(spark, monkeypatch):
    """Edges are grouped without their excerpts, which are looked up for what was found."""
    seen, write = [], storage.written
    monkeypatch.setattr(storage, "written", lambda df, name="table": (seen.append(plan(df)), write(df, name))[1])
    words = "abc bbb ccc end. "
    docs = [(1, "aaa zzz bbb zzz ccc zzz ddd zzz eee zzz"), (1, "fff zzz ggg"), (2, words * 5), (None, "aaa zzz bbb zzz ccc zzz ddd zzz eee zzz"), (3, None)]
    b = chains.annotate(spark.createDataFrame(docs, "doc_id long, text string"))
    want = {}
    for e in chains.edges(b, "excerpt").where("doc_id is not null").collect():
        want.setdefault((e["doc_id"], e["excerpt"], e["dst"]), set()).add(e["src"])
    for least in (1, 2, 4):
        got = rules.convergence(b, least).collect()
        assert sorted(map(tuple, got)) == sorted((*k, len(v)) for k, v in want.items() if len(v) >= least)
    assert rules.convergence(b).count() == 1 and rules.convergence(b.where(F.lit(False))).count() == 0
    assert seen and all("SortAggregate" not in p and "first(excerpt" not in p for p in seen)


def test_merging_an_item_asks_the_state_once(spark):
    """A call of the state store is a message: one to read and one to write, however many pairs an item has."""
    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *x: calls.append(name)

    class Handle:
        def __getattr__(self, name):
            return lambda *x: Store()

    made = merging.MergeItems()
    made.init(Handle())
    pairs = [{"code": f"c{k}", "rationale": None if k == 7 else "user"} for k in range(50)]
    row = Row(interview_id="i", key="k", turn=1, sent=0, excerpt="x", pairs=pairs)
    out = list(made.handleInputRows(("i", "k"), iter([row, row]), None))
    assert len(calls) == 2 and out[0].n_items == 2 and out[0].pairs == "|".join(f"c{k}=user" for k in range(50) if k != 7)


def test_a_memory_is_sorted_before_it_is_rendered(spark, tmp_path, monkeypatch):
    """Ranges to sort by are found in rows that hold no JSON yet, and an entry's text is taken apart once when it is read."""
    from pyspark.sql import DataFrame

    b = chains.annotate(spark.createDataFrame([(1, "Aaa bbb ccc ddd here. Eee fff.")], "doc_id long, text string"))
    df, sort, seen = memory.build(b), DataFrame.orderBy, []
    monkeypatch.setattr(type(df), "orderBy", lambda self, *x, **k: (seen.append(plan(self)), sort(self, *x, **k))[1])
    writers.memory_in_parts(df, f"{tmp_path}/m", "src", 0)
    assert len(seen) == 1 and "to_json" not in seen[0]
    found = readers.memory_in_parts(spark, f"{tmp_path}/m")
    assert plan(found).count("regexp_replace") == 1 and sorted(map(str, found.select(df.columns).collect())) == sorted(map(str, df.collect()))


def test_contexts_and_pairs_send_no_more_than_they_need(spark):
    """Summaries are told apart by hash and not kept by a second shuffle; pairs are made without a function for each element, each two places once."""
    docs = [(1, "Aaa bbb ccc ddd here. Bbb aaa eee."), (1, "Ccc aaa bbb bbb there. Aaa bbb.")]
    b = chains.annotate(spark.createDataFrame(docs, "doc_id long, text string"))
    assert "first(summary" not in plan(memory.scored_contexts(b))
    df = chains.co_occurrences(b.drop("relations").localCheckpoint())
    assert "lambda" not in plan(df).split("Generate posexplode", 1)[1]
    want = {}
    for r in b.collect():
        for i, f in enumerate(r["factors"]):
            for j, g in enumerate(r["factors"]):
                if f != g:
                    want.setdefault((f, g), []).append((r["doc_id"], r["block_seq"], i, j))
    got = {(r["factor"], r["co_factor"]): (r["n"], tuple(r["first_seen"])) for r in df.collect()}
    assert got == {k: (len(v), min(v)) for k, v in want.items()}


def test_a_summary_builds_no_memory(spark, sf, monkeypatch):
    """What is counted about a memory is known without its pairs, targets and texts: nothing is written, and one row for each factor is sent."""
    from codeloom import plans

    monkeypatch.setattr(storage, "written", lambda *x: pytest.fail("a table was written"))
    assert plan(plans.queries()["a11_memory_summary"](spark, sf)).count("hashpartitioning(factor") == 1
    monkeypatch.undo()
    rows = [(1, 0, "Aaa bbb.", ["Aaa", "Bbb", None], ["r", "r", "r"]), (1, 1, " ", ["Ccc"], []), (None, 0, "x", ["Ddd", "Aaa"], ["r"]), (2, 0, None, ["Eee", "Fff"], ["r"]), (3, 0, "x", [], [])]
    b = spark.createDataFrame(rows, "doc_id long, block_seq int, excerpt string, factors array<string>, relations array<string>")
    for own in (b, b.where(F.lit(False))):
        assert memory.block_summary(own).first() == memory.summary(memory.build(own)).first()


def test_items_of_many_interviews_share_files(spark, tmp_path):
    """Files are as many as tasks, not as interviews, and each item has the header of the source that it names."""
    rows = [(k, 0, "user", f"Some words of number {k}. SOURCE @ is no header here.") for k in range(300)]
    coded = items.annotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1))
    writers.items_in_parts(coded, f"{tmp_path}/all")
    assert len(list((tmp_path / "all").rglob("part-*"))) <= 4
    found = readers.items_in_parts(spark, f"{tmp_path}/all", ".txt").collect()
    assert sorted((r["item_id"], r["excerpt"], r["header"]) for r in found) == sorted(
        (r["interview_id"], r["excerpt"], f"SOURCE @{r['interview_id']}\n    código: N/A\nEND SOURCE") for r in coded.collect()
    )


def test_small_files_are_taken_in_together(spark, tmp_path):
    """A batch has a fixed cost: small files are one batch and not one for each hundred."""
    (tmp_path / "in").mkdir()
    for k in range(230):
        (tmp_path / "in" / f"f{k}.txt").write_text(f"text {k}")
    merging.ingest_files(spark, str(tmp_path / "in"), f"{tmp_path}/out")
    assert len(list((tmp_path / "out" / "log").iterdir())) == 1 and merging.read_ingested(spark, f"{tmp_path}/out")[1].count() == 230


def test_a_table_of_one_row_group_is_annotated_by_all_cores(spark, tmp_path):
    """Parquet splits may be many and all but one empty, as rows are read by row groups: how many there are doesn't say that rows are dealt."""
    from codeloom.plans import base

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.md5(F.col("id").cast("string")), F.lit(" some more words here")).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, "20000")
    try:
        assert base.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() >= 4
        b = base.blocks(spark, str(tmp_path))
        assert b.select("doc_id").distinct().count() == 4000 and "hashpartitioning(doc_id" in plan(b)
        dealt = storage.spread(base.table(spark, str(tmp_path), "documents"), "doc_id")
        assert "hashpartitioning(doc_id" in plan(dealt) and dealt.count() == 4000
        assert plan(memory.frequency(b)).count("Exchange ") == 2  # texts are dealt, and a row for each factor of a task is sent
    finally:
        spark.conf.set(name, before)


def test_frequency_counts_documents_that_share_an_id_or_have_none(spark):
    rows = [(1, ["A", "A", "B"]), (1, ["A"]), (None, ["A", None]), (2, ["B"]), (3, [])]
    got = memory.frequency(spark.createDataFrame(rows, "doc_id long, factors array<string>"))
    assert sorted(map(tuple, got.collect()), key=str) == [("A", 4, 1), ("B", 2, 2), (None, 1, 0)]


def test_a_chain_is_cut_once(spark, sf):
    from codeloom import plans

    p = plan(plans.queries()["x33_chain_syntax"](spark, sf))
    assert p.count("split(trim") == 1


def test_contexts_are_sent_by_block(spark):
    """Blocks meet by fingerprint before they unfold to occurrences, each summary is worked out once, and no array twice for its explosion."""
    docs = [(1, "Aaa bbb ccc ddd  here\n. Eee fff."), (2, "aaa bbb ccc ddd here . Aaa aaa."), (None, "Ggg hhh iii.")]
    b = chains.annotate(spark.createDataFrame(docs, "doc_id long, text string"))
    for df in (memory.context_counts(b), memory.context_places(b)):
        p = plan(df)
        assert "hashpartitioning(h1" in p and "hashpartitioning(factor" not in p.split("hashpartitioning(h1", 1)[1]
        assert p.count("regexp_replace(") == 1 and p.count("[a-z]{3,5}") == 1
    want = {}
    for r in memory.context_places(b).collect():
        want[r["factor"]] = want.get(r["factor"], 0) + 1
    assert {r["factor"]: r["contexts"] for r in memory.context_counts(b).collect()} == want and want["Bbb"] == 1 and want["Aaa"] == 2


def test_tagged_blocks_are_read_as_the_patterns_say(spark):
    """Marks are found by whole strings where that is what the patterns find; odd texts give the same, and factors are found once."""
    import re

    texts = [
        "[-begin-]  [@a@][!x!y!][%d!%][#Aa#][&r&][#b c#][-end-]tail[-begin-][#Open#]", "[-begin-]one[-begin-][!a\nb!][!c!][#4th#][-end-][-end-][-begin-][!]!][#x\ny#][#AB#]\x0b[-end-]",
        "[-end-][-begin-][-end-][-begin-] \t[!a b!][%\r%][%e%][#co-op  é#][##][-end-]", "nothing", "[-begin-][!e[!f!][%g[-end-]",
    ]
    df = tagged.parse(spark.createDataFrame([(f"referencia_bibtex: r{k}\n{t}",) for k, t in enumerate(texts)], "tagged string"))
    first = lambda p, b: (re.search(p, b) or [None, ""])[1]
    any_in_line = r"([^\n\r\x85\u2028\u2029]*?)"
    title = lambda f: "".join(x[:1].upper() + x[1:].lower() for x in re.findall(r"[^\W\d_]+|[\W\d_]+", re.sub(r"\s+", " ", f).strip(" ")))
    want = []
    for k, t in enumerate(texts):
        for n, b in enumerate(re.findall(r"(?s)\[-begin-\][ \t\n\x0b\f\r]*(.*?)[ \t\n\x0b\f\r]*\[-end-\]", t)):
            factors = [title(f) for f in re.findall(rf"\[#{any_in_line}#\]", b)]
            if factors:
                want.append((f"r{k}", n, first(rf"\[!{any_in_line}!\]", b).strip(" "), first(rf"\[%{any_in_line}%\]", b), factors, re.findall(rf"\[&{any_in_line}&\]", b)))
    assert len(want) >= 3 and sorted(tuple(r) for r in df.collect()) == sorted(want)
    assert plan(df).count("[#(.*?)#") == 1


def test_places_and_texts_of_contexts_are_sent_once(spark):
    """Both are dealt by the fingerprint, and neither repeats of it nor the join need another shuffle; factors that hold the cut, or nulls, are sent as they are."""
    rows = [(1, 0, "Aaa bbb.", ["Aaa", "B\x01b", None], ["r"]), (1, 1, "aaa  bbb.", ["Aaa", "", "B\x01b"], ["r", "s"]), (2, 0, "Aaa bbb.", ["Aaa"], []), (3, 0, "Ccc.", [], []), (0, 5, "Ccc.", [""], ["ccc"])]
    b = spark.createDataFrame(rows, "doc_id long, block_seq int, excerpt string, factors array<string>, relations array<string>")
    df = memory.scored_contexts(b)
    assert plan(df).count("Exchange hashpartitioning") == 2
    got = sorted((("none" if r["factor"] is None else r["factor"], r["doc_id"], r["block_seq"], r["pos"], r["summary"]) for r in df.collect()))
    assert got == sorted([("Aaa", 1, 0, 0, "Aaa bbb."), ("B\x01b", 1, 0, 1, "Aaa bbb."), ("none", 1, 0, 2, "Aaa bbb."), ("", 1, 1, 1, "aaa bbb."), ("", 0, 5, 0, "Ccc.")])


def test_repeats_of_a_task_are_sent_once_from_the_first_place(spark):
    rows = [(k % 7, 5, 3 - k // 1000, 5000 - k) for k in range(4000)]
    df = spark.createDataFrame(rows, "a long, b long, x long, y int").coalesce(1)
    kept = storage.without_repeats(df, ("a", "b"), ("x", "y")).collect()
    first = {a: min((x, y) for k, _, x, y in rows if k == a) for a in range(7)}
    assert len(kept) == 7 and {r["a"]: (r["x"], r["y"]) for r in kept} == first
    assert storage.without_repeats(df, ("a", "b")).count() == 7 and storage.without_repeats(df, ("x", "y")).count() == 4000
    assert storage.without_repeats(df.where("a > 7"), ("a", "b")).count() == 0


def test_shuffles_of_written_tables_leave_the_disks(spark):
    """They end with the table, and don't wait for the driver's garbage collector."""
    import time

    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disks.getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    before = shuffles()
    b = chains.annotate(spark.createDataFrame([(1, "Aaa bbb ccc ddd here. Eee fff."), (2, "Aaa bbb.")], "doc_id long, text string"))
    held = [storage.written(b.repartition("doc_id")), storage.written(memory.relations(b))]
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffles() - before and [h.count() for h in held] == [3, 4]


def test_ranks_ask_for_no_documents_of_a_factor(spark):
    """A factor's frequency is a count; how many documents it has is another question, with a row sent for each of them."""
    b = spark.createDataFrame([(1, 0, ["A", "B"]), (2, 0, ["A", "B"]), (None, 0, ["A", "C"])], "doc_id long, block_seq int, factors array<string>")
    df = memory.ranked_co_factors(b)
    assert "hashpartitioning(doc_id" not in plan(df)
    assert {(r["factor"], r["co_factor"], r["n"], r["frequency"]) for r in df.collect()} == {("A", "B", 2, 3), ("B", "A", 2, 2), ("A", "C", 1, 3), ("C", "A", 1, 1)}
