"""Quality rules whose cutoffs come with a guarantee: at most a stated share of good documents is rejected.

Each rule scores a document (higher is worse) and rejects it above a cutoff. The cutoffs are chosen from a grid fixed
beforehand. For each stratum (language), rule and grid cutoff, the labelled good documents give a count of false
rejections x out of n. The cutoff is safe if the exact binomial bound allows it, that is if P(Binomial(n, alpha) <= x) is
at most delta / tests: then the true rate of false rejections is below alpha, with all the tests made here holding
together with probability 1 - delta (Bonferroni over strata, rules and cutoffs). Of the safe cutoffs of a stratum and
rule the strictest is taken; alpha is the total false-rejection rate divided by the number of rules, so that the rules
together stay within the total. A stratum with too few labels for any guarantee gets no cutoff, and keeps its documents.

Everything is DataFrame expressions. Null texts count as empty; a null language is a stratum of its own; rows may repeat
and are judged each for itself (a label counts for each row with its id); labels without a document, or with a null
quality, are ignored. An empty table gives an empty result. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import SPACES, durable, few, words, written

TOTAL_RATE, DELTA = 0.05, 0.05
WINDOW = 8

#: The rules' scores, from the features of a document.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
}
#: Cutoffs that are tried for every rule: steps of 1/40.
GRID = 40
#: Strata whose cutoffs may be broadcast; those of more are joined by a shuffle.
FEW_STRATA = 10_000


def _count(text: Column, chars: str) -> Column:
    """Characters of text out of the class chars."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))).cast("long")


def window_hashes(h: str, window: int = WINDOW) -> Column:
    """A hash for each window of so many words, from the column h of the words' hashes.

    h must be a column and not an expression, which would be evaluated anew for each word of a window.
    """
    starts = F.slice(F.col(h), F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(F.col(h), i + k) for k in range(1, window))))


def features(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts that the rules use, one row for each row of docs."""
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.select(*keep, "_t", words("_t").alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_l"))
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), r"#*$%&|<>").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _count(F.col("_t"), "A-Z").alias("n_capitals"),
        _count(F.col("_t"), "!").alias("n_shouts"),
        F.when(F.size("_w") > WINDOW, F.transform("_w", lambda x: F.xxhash64(x))).alias("_g"),
    )
    df = df.withColumn("_h", window_hashes("_g")).drop("_g")
    # Words in windows found twice or more: sorting (hash, position) puts equal windows side by side; each of their
    # starts, in order, adds the words up to the next start, or a whole window.
    order = F.sort_array(F.transform(F.col("_h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), order)).drop("_h")
    twice = F.filter(
        F.transform(
            F.col("_s"),
            lambda x, k: F.when(
                (F.get(F.col("_s"), k - 1)["h"] == x["h"]) | (F.get(F.col("_s"), k + 1)["h"] == x["h"]), x["i"]
            ),
        ),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(twice))).drop("_s")
    gap = F.zip_with(F.col("_p"), F.slice(F.col("_p"), 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gap, F.lit(0), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, to about 1e-13."""
    x = n.cast("double") + 10
    series = (x + 0.5) * F.log(x) - x + F.lit(0.91893853320467274178) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    lower = sum((F.log(n.cast("double") + k) for k in range(2, 11)), F.log(n.cast("double") + 1))
    return series - lower


def binomial_tail(n: Column, x: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= x), over the terms that a double can hold beside the largest one."""
    from math import log, log1p

    mean = n * F.lit(rate)
    first = F.greatest(F.floor(mean - 40 * F.sqrt(mean) - 40), F.lit(0)).cast("long")
    term = lambda i: F.exp(
        log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * F.lit(log(rate)) + (n - i) * F.lit(log1p(-rate))
    )
    return F.when(x < first, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(first, F.greatest(x, first)), F.lit(0.0), lambda acc, i: acc + term(i))
    )


def scores() -> Column:
    """rule -> score as an array of structs."""
    return F.array(*(F.struct(F.lit(name).alias("rule"), F.expr(f"cast({rule} as double)").alias("score")) for name, rule in RULES.items()))


def cutoffs(feats: DataFrame, labels: DataFrame, stratum: str = "lang", total_rate: float = TOTAL_RATE, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the strictest safe cutoff of each stratum and rule that has one.

    ``labels`` has (doc_id, quality); quality 1 marks good documents, and only those are counted. They are summed to a
    histogram of GRID steps in each task, so that the shuffle carries counts alone.
    """
    rate = total_rate / len(RULES)
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_good"))
    held = feats.where(~base_failed()).join(good, F.col("doc_id") == F.col("_good"))
    # a score is above the cutoffs 0/GRID .. (step - 1)/GRID
    step = F.least(F.ceil(F.col("s.score") * GRID), F.lit(GRID)).cast("int")
    steps = (
        held.select(F.col(stratum).alias("stratum"), F.explode(scores()).alias("s"))
        .select("stratum", "s.rule", step.alias("step"))
        .groupBy("stratum", "rule", "step")
        .agg(F.count("*").alias("docs"))
    )
    grouped = durable(steps.groupBy("stratum", "rule").agg(F.collect_list(F.struct("step", "docs")).alias("hist"), F.sum("docs").alias("n")))
    tests = max(1, grouped.select("stratum").distinct().count()) * len(RULES) * GRID
    tried = grouped.select("stratum", "rule", "n", "hist", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("k"))
    rejected = F.aggregate(F.filter("hist", lambda h: h["step"] > F.col("k")), F.lit(0).cast("long"), lambda acc, h: acc + h["docs"])
    bound = tried.withColumn("x", rejected).where(F.col("x") <= F.col("n") * F.lit(rate)).withColumn("p", binomial_tail(F.col("n"), F.col("x"), rate))
    return (
        bound.where(F.col("p") <= F.lit(delta / tests))
        .groupBy("stratum", "rule")
        .agg((F.min("k") / F.lit(float(GRID))).alias("cutoff"))
    )


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", total_rate: float = TOTAL_RATE, delta: float = DELTA, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the stratum, the columns ``keep``, the features, base_failed, the rules that reject the document, and kept; a row for each row of docs."""
    # cast first: docs may hold other types or further columns of the names used here
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *keep)
    feats = written(features(base, "doc_id", "lang", *keep), "features")
    safe = cutoffs(feats, labels, "lang", total_rate, delta)
    by_stratum = durable(safe.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")))
    scored = feats.join(few(by_stratum, FEW_STRATA), F.col("lang").eqNullSafe(F.col("stratum")), "left")
    broken = F.transform(
        F.filter(scores(), lambda s: F.ceil(s["score"] * GRID) > F.round(F.coalesce(F.col("cutoffs")[s["rule"]], F.lit(1e9)) * GRID)),
        lambda s: s["rule"],
    )
    failed = base_failed()
    return scored.withColumn("base_failed", failed).withColumn("broken", broken).withColumn("kept", ~failed & (F.size("broken") == 0)).drop("stratum", "cutoffs")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject.

    Whole rows are carried beside their features as one column, so no text is shuffled, no name can clash, and each row is judged
    for itself: rows that share an id, or have none, don't reject one another.
    """
    rows = docs.select("doc_id", "lang", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return judged(rows, labels, keep=("_row",)).where("kept").select("_row.*")
