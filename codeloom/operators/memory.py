"""The semantic memory: what is known of each factor over all blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import chains, storage

#: Stands between factors that are sent as one string.
_CUT = "\x01"
SENTINELS = ("No Analysis", "Format Error", "Missing Analysis")


def frequency(blocks: DataFrame) -> DataFrame:
    """(factor, frequency, sources): occurrences, repeats in a block included, and distinct documents.

    Occurrences are counted by document first, which sends nothing where blocks are dealt by document; then a row for each factor of a task is sent.
    """
    by_document = chains.occurrences(blocks.select("doc_id", "factors")).groupBy("doc_id", "factor").agg(F.count("*").alias("n"))
    return by_document.groupBy("factor").agg(F.sum("n").alias("frequency"), F.count("doc_id").alias("sources"))


def approximate_sources(blocks: DataFrame, buckets: int = 12) -> DataFrame:
    """(factor, sketch, sources): about how many documents have a factor, from a mergeable sketch with 2^buckets buckets; off by 1.04 / sqrt(2^buckets) on average.

    Tasks send a sketch for each factor, where the exact count sends a row for each factor and document.
    """
    own = chains.occurrences(blocks).groupBy("factor").agg(F.hll_sketch_agg("doc_id", buckets).alias("sketch"))
    return own.withColumn("sources", F.hll_sketch_estimate("sketch"))


def relations(blocks: DataFrame) -> DataFrame:
    """(factor, rel, targets): the distinct targets, sorted."""
    return chains.edges(blocks).groupBy(F.col("src").alias("factor"), "rel").agg(F.sort_array(F.collect_set("dst")).alias("targets"))


def totals(blocks: DataFrame) -> DataFrame:
    """One row: distinct factors, and relations before duplicates are dropped."""
    n = F.greatest(F.least(F.size("relations"), F.size("factors") - 1), F.lit(0))
    relations_all = blocks.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total_relations"))
    factors = chains.occurrences(blocks).agg(F.count_distinct("factor").alias("total_factors"))
    return factors.join(relations_all, F.lit(True))  # one row each


def ranked_co_factors(blocks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(factor, co_factor, n, rank, level): level is high, medium or null.

    Ranks go by count, then by first appearance. High: rank up to 10 and 30 % of the factor's frequency; medium: rank up to
    20, 15 %, not high, the first ten of these. Ranks over 20 can't count, so the window keeps 20 rows for each factor. ``only`` has
    a few factors with their frequency, if not all are wanted.
    """
    w = Window.partitionBy("factor").orderBy(F.desc("n"), "first_seen")
    top = chains.co_occurrences(blocks, None if only is None else only.select("factor")).withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    count = chains.occurrences(blocks.select("factors")).groupBy("factor").agg(F.count("*").alias("frequency"))  # documents aren't asked for
    both = top.join(count if only is None else F.broadcast(only), "factor")
    high = (F.col("rank") <= 10) & (F.col("n") >= F.col("frequency") * 0.3)
    level = F.when(high, "high").when(F.col("n") >= F.col("frequency") * 0.15, "medium")
    leveled = both.withColumn("level", level)
    in_level = F.row_number().over(Window.partitionBy("factor", "level").orderBy("rank"))
    return leveled.withColumn("place", in_level).withColumn("level", F.when(F.col("place") <= 10, F.col("level")))


def co_factors(blocks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(factor, high, medium): names in the order of their ranks."""
    named = lambda level: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct("rank", "co_factor")))), lambda x: x["co_factor"]
    ).alias(level)
    return ranked_co_factors(blocks, only).groupBy("factor").agg(named("high"), named("medium"))


def context_places(blocks: DataFrame) -> DataFrame:
    """(factor, h1, h2, key, score, spelling): for each distinct context of each factor, by hash, where it stands first (as a place key), and its score and its summary's hash there.

    Summary, fingerprint and mentions are worked out once for each block. Of blocks of a task that agree in all of it but their place later ones are left out, and those of a
    fingerprint meet in one task before they unfold to occurrences: what is sent, once, are blocks, without their texts, and a line that many documents share is some rows of each task.
    Blocks of documents without an id have no place, and no contexts.
    """
    rows = _texts(blocks, F.col("doc_id").cast("decimal(38,0)").cast("long").alias("doc_id"), "block_seq", "factors", "relations")
    near = F.transform("factors", lambda f: F.contains(F.col("low"), F.lower(f)))
    rows = rows.select("doc_id", "block_seq", "factors", near.alias("near"), T.context_base(F.col("summary"), F.col("low"), F.col("relations")).alias("base"), "h1", "h2", "spelling")
    # factors are sent as one string where that can be cut again, as an array is some times as long: where it has a cut between each two of them, and one more for each null
    rows = rows.select("*", "base.verbs", "base.penalty", F.array_join("factors", _CUT, _CUT).alias("flat")).drop("base")
    cuts = F.octet_length("flat") - F.octet_length(F.replace(F.col("flat"), F.lit(_CUT), F.lit("")))
    rows = rows.withColumn("flat", F.when(cuts == F.size("factors") - 1, F.col("flat"))).withColumn("factors", F.when(F.col("flat").isNull(), F.col("factors")))
    rows = rows.withColumn("kind", F.xxhash64("h2", "spelling", "flat", "factors", F.size("factors"), "near", "verbs", "penalty"))
    rows = storage.without_repeats(rows, ("kind", "h1"), ("doc_id", "block_seq")).drop("kind").repartition("h1", "h2").withColumn("key", chains.place_key())
    rows = rows.withColumn("factors", F.coalesce(F.split("flat", _CUT), "factors")).withColumn("named", F.size(F.array_remove("near", F.lit(False))))
    own = chains.occurrences(rows)
    mentioned = F.get("near", F.col("pos"))
    same = F.size("factors") - F.size(F.array_remove("factors", F.col("factor")))
    score = T.context_total(F.struct("verbs", "penalty"), mentioned, F.col("named") - F.when(mentioned, same).otherwise(0))
    own = own.select("factor", "h1", "h2", "spelling", (F.col("key") + F.col("pos").cast("decimal(19,0)")).cast("decimal(38,0)").alias("key"), score.alias("score"))
    return own.groupBy("factor", "h1", "h2").agg(F.min("key").alias("key"), F.min_by("score", "key").alias("score"), F.min_by("spelling", "key").alias("spelling"))


def _texts(blocks: DataFrame, *keep: str | Column) -> DataFrame:
    """(summary, low, h1, h2, spelling) and the columns ``keep`` of the blocks that have contexts: low is the summary's fingerprint; the hashes are of it, and of the summary."""
    rows = blocks.where((F.trim("excerpt") != "") & F.col("doc_id").isNotNull()).select(*keep, T.squeeze(F.col("excerpt")).alias("clean"))
    rows = rows.select("*", T.summary_of(F.col("clean")).alias("summary")).drop("clean").withColumn("low", F.lower("summary"))  # a summary's white space is collapsed
    return rows.select("*", F.xxhash64("low").alias("h1"), F.xxhash64("low", F.lit(1)).alias("h2"), F.xxhash64("summary").alias("spelling"))


def context_counts(blocks: DataFrame) -> DataFrame:
    """(factor, contexts): how many different contexts each factor has. As in context_places(), blocks are sent, and not their occurrences."""
    rows = _texts(blocks, "factors").select("h1", "h2", "factors").distinct().repartition("h1", "h2")
    return chains.occurrences(rows).select("factor", "h1", "h2").distinct().groupBy("factor").agg(F.count("*").alias("contexts"))


def _placed(contexts: DataFrame) -> DataFrame:
    """contexts with doc_id, block_seq and pos in place of their key."""
    return contexts.withColumn("p", chains.place_of("key")).drop("key").select("*", "p.doc_id", "p.block_seq", F.col("p.at").cast("int").alias("pos")).drop("p")


def scored_contexts(blocks: DataFrame) -> DataFrame:
    """(factor, doc_id, block_seq, pos, summary, score): the first context of each fingerprint. Document ids are numbers.

    A summary that a task has just seen isn't sent again. Places and texts are dealt by the fingerprint's hashes alone, so that the join needs no other shuffle.
    """
    blocks = storage.written(blocks, "blocks")
    texts = _texts(blocks).select("h1", "h2", "spelling", "summary", F.xxhash64("h1", "h2", "spelling").alias("kind"))
    texts = storage.without_repeats(texts, ("kind", "h2")).select("h1", "h2", "summary", F.col("spelling").alias("own")).repartition("h1", "h2").distinct()
    # no equality of two columns, as Spark would deal by these as well
    found = _placed(context_places(blocks)).join(texts, ["h1", "h2"]).where(F.col("spelling").bitwiseXOR(F.col("own")) == 0)
    return found.select("factor", "doc_id", "block_seq", "pos", "summary", "score")


def best_contexts(blocks: DataFrame, n: int = 3, durable: bool = False) -> DataFrame:
    """The n best contexts of each factor, by score and then by arrival; texts are looked up for these alone. ``durable`` says that blocks are a written table.

    They are written before that: where they are few, no block is sent for them, and otherwise those that hold one.
    """
    blocks = blocks if durable else storage.written(blocks, "blocks")
    w = Window.partitionBy("factor").orderBy(F.desc("score"), "key")
    best = storage.written(_placed(context_places(blocks).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)), "best")
    held = blocks.join(storage.few(best.select("doc_id", "block_seq").distinct()), ["doc_id", "block_seq"], "left_semi")
    found = _texts(held, "doc_id", "block_seq").join(storage.few(best), ["doc_id", "block_seq", "h1", "h2", "spelling"])
    return found.dropDuplicates(["factor", "h1", "h2"]).drop("h1", "h2", "spelling", "low")


def build(blocks: DataFrame, drop_sentinels: bool = False) -> DataFrame:
    """One row per factor: frequency, sources, relations, co_factors, contexts. All parts are keyed by factor, and join on it.

    The blocks are written once, so that what codes the texts runs once and not for each part. Pairs and relations are written as well, so that their shuffles leave the disks before the next part begins.
    """
    blocks = storage.written(blocks, "blocks")
    if drop_sentinels:
        blocks = blocks.where(~F.exists("factors", lambda f: f.isin(*SENTINELS)))
    rel = relations(blocks).groupBy("factor").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", "targets")))).alias("relations"))
    rel, co = storage.written(rel, "relations"), storage.written(co_factors(blocks), "co_factors")
    ctx = best_contexts(blocks, durable=True).groupBy("factor").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "summary"))), lambda x: x["summary"]).alias("contexts")
    )
    none = F.array().cast("array<string>")
    return (
        frequency(blocks)
        .join(rel, "factor", "left")
        .join(co, "factor", "left")
        .join(ctx, "factor", "left")
        .select(
            "factor", "frequency", "sources",
            F.coalesce("relations", F.create_map().cast("map<string,array<string>>")).alias("relations"),
            F.struct(F.coalesce("high", none).alias("high"), F.coalesce("medium", none).alias("medium")).alias("co_factors"),
            F.coalesce("contexts", none).alias("contexts"),
        )
    )


def summary(memory: DataFrame) -> DataFrame:
    """One row about the memory; shares are null if it is empty."""
    n, rel, ctx = F.count("*"), F.count_if(F.size("relations") > 0), F.count_if(F.size("contexts") > 0)
    share = lambda x: F.round(100 * x / F.nullif(n, F.lit(0)), 4)
    return memory.agg(
        n.alias("factors"), F.round(F.avg("frequency"), 6).alias("mean_frequency"), rel.alias("with_relations"), share(rel).alias("pct_relations"),
        ctx.alias("with_contexts"), share(ctx).alias("pct_contexts"),
    )


def block_summary(blocks: DataFrame) -> DataFrame:
    """summary() of the memory of the blocks, without building it: a factor has relations if an edge starts at it, and contexts if a block with an excerpt and a document's id holds it.

    Pairs, targets and contexts don't enter the summary, so one hash aggregate with a row of fixed width for each factor is all that it needs.
    """
    n_edges = F.least(F.size("relations"), F.size("factors") - 1)
    own = blocks.select("factors", n_edges.alias("n_edges"), ((F.trim("excerpt") != "") & F.col("doc_id").isNotNull()).alias("told"))
    marked = chains.occurrences(own).select("factor", (F.col("pos") < F.col("n_edges")).alias("source"), "told")
    named = F.col("factor").isNotNull()  # parts of a memory are joined by factor
    known = marked.groupBy("factor").agg(F.count("*").alias("frequency"), F.count_if(named & F.col("source")).alias("edges"), F.count_if(named & F.col("told")).alias("told"))
    one = lambda c: F.array_repeat(F.lit(1), F.least(c, F.lit(1)).cast("int"))
    return summary(known.select("factor", "frequency", one(F.col("edges")).alias("relations"), one(F.col("told")).alias("contexts")))


def top_factors(blocks: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent factors, ties by first appearance, with their strong co-factors; pairs are made for these alone."""
    blocks = storage.written(blocks, "blocks")
    first = F.min(F.struct("doc_id", "block_seq", "pos"))
    ranked = chains.occurrences(blocks).groupBy("factor").agg(F.count("*").alias("frequency"), F.count_distinct("doc_id").alias("sources"), first.alias("first_seen"))
    top = storage.written(ranked.orderBy(F.desc("frequency"), "first_seen").limit(n).drop("first_seen"), "top")
    high = co_factors(blocks, top.select("factor", "frequency")).select("factor", F.array_join("high", "|").alias("high"))
    return top.join(high, "factor", "left")


def profile(memory: DataFrame) -> DataFrame:
    """(factor, profile): a factor's entry as text for a reader or a model, with lists cut to their first members."""
    line = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    some = lambda a: F.size(a) > 0
    rel = F.transform(
        F.filter(F.map_entries("relations"), lambda e: some(e["value"])),
        lambda e: line("  - ", e["key"], ": ", F.array_join(F.slice(e["value"], 1, 5), ", ")),
    )
    co = F.filter(
        F.array(
            F.when(some(F.col("co_factors.high")), line("  - High co-occurrence: ", F.array_join(F.slice("co_factors.high", 1, 8), ", "))),
            F.when(some(F.col("co_factors.medium")), line("  - Medium co-occurrence: ", F.array_join(F.slice("co_factors.medium", 1, 8), ", "))),
        ),
        lambda x: x.isNotNull(),
    )
    ctx = F.transform(F.slice("contexts", 1, 3), lambda c, i: line("  ", (i + 1).cast("string"), '. "', c, '"'))
    part = lambda head, rows: F.when(some(rows), F.concat(F.array(F.lit(head)), rows, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    co_part = F.concat(F.array(F.lit("**Co-occurring Factors**:")), co, F.array(F.lit("")))
    rows = F.concat(
        F.array(
            line("## Factor: ", F.col("factor"), "\n"), line("**Frequency**: ", F.col("frequency").cast("string"), " occurrences"),
            line("**Sources**: ", F.col("sources").cast("string"), " documents\n"),
        ),
        part("**Relations**:", rel), co_part, part("**Usage Contexts**:", ctx),
    )
    return memory.select("factor", F.array_join(rows, "\n").alias("profile"))


def confidence(frequency: str = "frequency", sources: str = "sources"):
    """HIGH above 10 occurrences and 5 sources; MEDIUM at 5 to 10 occurrences or 3 to 5 sources; else LOW."""
    f, s = F.col(frequency), F.col(sources)
    return F.when((f > 10) & (s > 5), "HIGH").when(f.between(5, 10) | s.between(3, 5), "MEDIUM").otherwise("LOW")
