"""How filters interact: what each of five filters removes in every order in which they may be applied.

A document fails some of the filters, which are the bits of its mask. In an order of the filters it is removed at the first
one that it fails. The orders, sorted as strings, have the ranks 0 to 119 (the rank's digits in factorial base are the order's
Lehmer code), and all orders with the same beginning have neighbouring ranks. So a mask's documents are removed at a step by
a filter in whole intervals of ranks: one for each beginning of filters that they pass, followed by one that they fail. Masks
are counted first; each interval adds its mask's counts where it begins and takes them off where it ends; running
sums over the 120 ranks then give what every order removes at every step. Apart from counting masks the work is the same
for any number of documents: INTERVALS rows for 31 masks, and 600 rows of result, for each part.

Everything is DataFrame expressions. Documents are reduced to a row of fixed size before any shuffle, and copies of a text are
counted before they meet. Null texts are empty, and a null part is the empty string. A row without doc_id isn't compared
with others' texts. Rows that repeat a doc_id count each, and with equal texts neither is the other's copy; a document with
several labels is good (toxic) if any of them says so, and labels of no document are ignored. An empty table gives
an empty result. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import words

FILTERS = "ABCDE"
#: Words that a text must have, percent of them that must differ, percent of characters that may be capitals, and characters that it may not hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
_DUPLICATE = 1 << FILTERS.index("E")


def rank(order: tuple[int, ...], of: int = len(FILTERS)) -> int:
    """The rank of the first order (of numbers below ``of``) that begins so, from the Lehmer code: how many smaller numbers are still unused at each place."""
    return sum(sum(x < f and x not in order[:k] for x in range(of)) * factorial(of - 1 - k) for k, f in enumerate(order))


def intervals(of: int = len(FILTERS)) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, stop): a mask's documents are removed at that step (from 1) in the orders of ranks start to stop - 1, and in no others at that step."""
    out = []
    for mask in range(1, 1 << of):
        passed = [f for f in range(of) if not mask >> f & 1]
        for k in range(len(passed) + 1):
            for before in permutations(passed, k):
                for f in range(of):
                    if mask >> f & 1:
                        start = rank((*before, f), of)
                        out.append((mask, k + 1, start, start + factorial(of - 1 - k)))
    return out


def failed(text: Column) -> Column:
    """The mask of the filters A to D that a text (not null) fails; _w must hold its words."""
    n = F.size("_w")
    tests = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct("_w")) < LEAST_DISTINCT * n,
        100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > MOST_CAPITALS * F.length(text),
        text.rlike(SIGNS),
    ]
    return sum((F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(tests)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask, and those labelled good and toxic among them."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_t"))
    rows = rows.select("doc_id", "part", "_t", words("_t").alias("_w"))
    rows = rows.select("doc_id", "part", failed(F.col("_t")).alias("mask"), F.unhex(F.sha2("_t", 256)).alias("digest"))
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = [F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")]
    rows = rows.join(known, "doc_id", "left").select("doc_id", "digest", "part", "mask", *marks)
    # a row for each doc_id and text, then one for each text, part and marks: equal texts have equal masks
    same = ["digest", "part", "mask", "good", "toxic"]
    ids = rows.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    texts = ids.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("n_ids"),
        F.min("doc_id").alias("low"),
        F.min_by("n", "doc_id").alias("n_low"),
    )
    first = F.col("low") == F.min("low").over(Window.partitionBy("digest"))
    texts = texts.withColumn("copies", F.col("n_ids") - F.when(first, F.col("n_low")).otherwise(0))
    both = F.array(
        F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct(F.col("mask").bitwiseOR(_DUPLICATE).alias("mask"), F.col("copies").alias("n"))
    )
    split = texts.select("part", "good", "toxic", F.explode(both).alias("_m")).select("part", "good", "toxic", "_m.*").where("n > 0")
    sums = [F.sum(F.when(F.col(m), F.col("n")).otherwise(0)).alias(m) for m in ("good", "toxic")]
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def orders(counted: DataFrame) -> DataFrame:
    """From masks(), what each filter removes at each step of each order; the columns of audit()."""
    spark, size = counted.sparkSession, factorial(len(FILTERS))
    table = spark.createDataFrame(intervals(), "mask int, step int, start int, stop int")
    ends = F.explode(F.array(F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign")))).alias("_e")
    steps = counted.join(F.broadcast(table), "mask").select("part", "step", "n", "good", "toxic", ends)
    change = steps.groupBy("part", "step", F.col("_e.rank").alias("rank")).agg(*(F.sum(F.col(c) * F.col("_e.sign")).alias(c) for c in ("n", "good", "toxic")))
    bits = [(f, F.col("mask").bitwiseAND(1 << k) != 0, F.col("mask") == 1 << k) for k, f in enumerate(FILTERS)]
    of_filter = lambda which: F.array(*(F.coalesce(F.sum(F.when(b[which], F.col("n"))), F.lit(0)) for b in bits))
    totals = counted.groupBy("part").agg(F.sum("n").alias("total"), of_filter(1).alias("fails"), of_filter(2).alias("alone"))
    names = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    grid = totals.select("*", F.posexplode(names).alias("rank", "filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    out = grid.join(change.where(F.col("rank") < size), ["part", "step", "rank"], "left").repartition("part")
    so_far = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({to: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for to, c in (("removed", "n"), ("good_lost", "good"), ("toxic_lost", "toxic"))})
    out = out.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))).withColumn("_k", F.instr(F.lit(FILTERS), F.col("filter")) - 1)
    along = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return out.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("removed").over(along)).alias("kept"),
        "removed",
        (F.get("fails", F.col("_k")) - F.col("removed")).alias("redundant"),
        F.get("alone", F.col("_k")).alias("unique_fails"),
        "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: documents kept after it, removed by it, failing its filter but removed before, failing its
    filter alone, labelled good and toxic among the removed, and removed by its filter over all orders."""
    return orders(masks(docs, labels, part))
