"""Rule-book checks and profiles over coded tables: each gives rows to look at, none changes the coding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.tables import CO_FACTOR_HINTS, KEEP_CUES, RELATIONS, REVERSE_CUES
from codeloom.operators import chains, memory, storage


def dimension(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A fixed table as a DataFrame; such tables are a few rows of literals, so joins may broadcast them."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def code_index(blocks: DataFrame) -> DataFrame:
    """(code, uses): one for each use as a factor, and one for each appearance at either end of an edge."""
    ends = chains.edges(blocks).select(F.explode(F.array("src", "dst")).alias("code"))
    used = chains.occurrences(blocks).select(F.col("factor").alias("code"))
    return used.unionAll(ends).groupBy("code").agg(F.count("*").alias("uses"))


def ontology_context(blocks: DataFrame) -> DataFrame:
    """(code, frequency, sources, as_subject, as_object, relations) of every code; co_codes() and examples() have the rest of its context."""
    own = memory.frequency(blocks).withColumnRenamed("factor", "code")
    sides = chains.edges(blocks).select(
        "rel", F.explode(F.array(F.struct(F.col("src").alias("code"), F.lit(True).alias("subject")), F.struct(F.col("dst").alias("code"), F.lit(False).alias("subject")))).alias("e")
    )
    used = sides.groupBy("e.code").agg(
        F.count_if("e.subject").alias("as_subject"), F.count_if(~F.col("e.subject")).alias("as_object"), F.array_join(F.sort_array(F.collect_set("rel")), "|").alias("relations")
    )
    return own.join(used, "code", "left")


def co_codes(blocks: DataFrame, n: int = 10) -> DataFrame:
    """(code, co_codes): the n codes that occur most often in blocks with a code, ties by first appearance."""
    w = Window.partitionBy("factor").orderBy(F.desc("n"), "first_seen")
    top = chains.co_occurrences(blocks).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "co_factor"))), lambda x: x["co_factor"])
    return top.groupBy(F.col("factor").alias("code")).agg(names.alias("co_codes"))


def examples(blocks: DataFrame, n: int = 3) -> DataFrame:
    """(code, examples): the first n blocks of each code, as structs of doc_id, block_seq and excerpt.

    Tasks keep n blocks for each code before they pass them on, and again what they receive, so a common code costs no more than another.
    """
    own = blocks.select("doc_id", "block_seq", "excerpt", F.explode(F.array_distinct("factors")).alias("code"))
    place = F.row_number().over(Window.partitionBy("code").orderBy("doc_id", "block_seq"))
    first = own.withColumn("place", place).where(F.col("place") <= n)
    lists = F.array_sort(F.collect_list(F.struct("place", "doc_id", "block_seq", "excerpt")))
    return first.groupBy("code").agg(F.transform(lists, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["block_seq"].alias("block_seq"), x["excerpt"].alias("excerpt"))).alias("examples"))


def repeated_factors(blocks: DataFrame) -> DataFrame:
    """Factors that a block has more than once, which hints at parallel pathways; found in the row."""
    times = F.transform(F.array_distinct("factors"), lambda f: F.struct(f.alias("factor"), F.size(F.filter("factors", lambda g: g == f)).cast("long").alias("times")))
    return blocks.select("doc_id", "block_seq", F.explode(F.filter(times, lambda t: t["times"] > 1)).alias("t")).select("doc_id", "block_seq", "t.*")


def relation_vocabulary(edges: DataFrame) -> DataFrame:
    known = dimension(edges, [(r, k + 1) for k, r in enumerate(RELATIONS)], "rel string, priority int")
    out = edges.groupBy("rel").agg(F.count("*").alias("edges")).join(known, "rel", "left")
    return out.select("rel", F.coalesce("priority", F.lit(0)).alias("priority"), "edges", F.when(F.col("priority").isNull(), F.col("edges")).otherwise(0).alias("unknown"))


def last_resort_share(edges: DataFrame, limit: float = 0.05) -> DataFrame:
    share = F.avg((F.col("rel") == "relates-to").cast("double"))
    return edges.groupBy("doc_id").agg(F.round(share, 6).alias("share"), (share >= limit).alias("too_many"))


def description_length(blocks: DataFrame) -> DataFrame:
    """Descriptions have at most 25 words, or 50 if they are marked as complex."""
    d = F.col("description")
    words, hard = F.size(F.split(T.squeeze(d), " ", -1)).cast("long"), F.contains(d, F.lit("*complex*"))
    return blocks.select(
        "doc_id", "block_seq", words.alias("words"), hard.alias("complex"), F.contains(d, F.lit("*borderline*")).alias("borderline"), (words <= F.when(hard, 50).otherwise(25)).alias("ok")
    )


def convergence(blocks: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, excerpt, dst, sources): outcomes on which so many factors of one excerpt converge.

    Excerpts are compared by hash (128 bits), and a block's factors are sent once, without its excerpt. The excerpts of what was found are
    looked up in the blocks of these documents alone, which the second reading of the blocks is cut down to.
    """
    hashes = [F.xxhash64("excerpt").alias("_h1"), F.xxhash64("excerpt", F.lit(1)).alias("_h2")]
    n, key = F.least(F.size("relations"), F.size("factors") - 1), ["doc_id", "_h1", "_h2"]
    sent = blocks.where((n > 0) & F.col("doc_id").isNotNull()).select("doc_id", *hashes, F.slice("factors", F.lit(1), n + 1).alias("f")).repartition(*key)
    ends = F.explode(F.zip_with(F.slice("f", F.lit(1), F.size("f") - 1), F.slice("f", F.lit(2), F.size("f") - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst"))))
    groups = sent.select(*key, ends.alias("e")).groupBy(*key, F.col("e.dst").alias("dst")).agg(F.count_distinct("e.src").alias("sources"))
    found = storage.written(groups.where(F.col("sources") >= least), "found")
    wanted = found.groupBy("doc_id").agg(F.collect_list(F.struct("_h1", "_h2", "dst", "sources")).alias("wanted"))
    texts = blocks.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "excerpt", *hashes).join(wanted, "doc_id")
    own = F.filter("wanted", lambda g: (g["_h1"] == F.col("_h1")) & (g["_h2"] == F.col("_h2")))
    rows = texts.select(*key, "excerpt", F.explode(own).alias("g")).groupBy(*key, "g.dst").agg(F.first("excerpt").alias("excerpt"), F.first("g.sources").alias("sources"))
    return rows.select("doc_id", "excerpt", "dst", "sources")


def chains_per_document(blocks: DataFrame) -> DataFrame:
    n = F.count("*")
    return blocks.groupBy("doc_id").agg(n.alias("chains"), n.between(3, 5).alias("ok"))


def vocabulary(frequency: DataFrame, most: int = 150) -> DataFrame:
    """Advice by reuse, and whether the vocabulary as a whole is small enough."""
    advice = F.when(F.col("sources") >= 5, "keep").when(F.col("sources") <= 2, "generalise").otherwise("review")
    size = frequency.agg((F.count("*") < most).alias("small_vocabulary"))
    return frequency.select("factor", "sources", advice.alias("advice")).join(F.broadcast(size), F.lit(True))  # size is one row


def circular(edges: DataFrame) -> DataFrame:
    """Pairs of factors with edges both ways, with the number of each."""
    forward = F.count_if(F.col("first") == F.col("lo"))
    both = edges.where("src <> dst").select(F.col("src").alias("first"), F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    out = both.groupBy(F.col("lo").alias("src"), F.col("hi").alias("dst")).agg(forward.alias("forward"), (F.count("*") - forward).alias("backward"))
    return out.where("forward > 0 and backward > 0")


def relation_profile(edges: DataFrame) -> DataFrame:
    """(factor, a count for each relation, target_share): how a factor acts, and how often it is acted on."""
    ends = edges.select(
        "rel", F.explode(F.array(F.struct(F.col("src").alias("factor"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("factor"), F.lit(0).alias("out")))).alias("e")
    )
    counts = [F.count_if((F.col("rel") == r) & (F.col("e.out") == 1)).alias(r.replace("-", "_")) for r in RELATIONS]
    share = F.round(F.count_if(F.col("e.out") == 0) / F.count("*"), 6)
    return ends.groupBy("e.factor").agg(*counts, share.alias("target_share"))


def dimension_votes(ranked: DataFrame) -> DataFrame:
    """(factor, dimension, votes): the dimension that most of a factor's co-factors hint at, ties to the smaller one."""
    hints = dimension(ranked, CO_FACTOR_HINTS, "word string, dimension int")
    votes = ranked.where("level is not null").join(hints, F.contains("word", F.lower("co_factor"))).groupBy("factor", "dimension").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("factor").orderBy(F.desc("votes"), "dimension")
    return votes.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def direction(sentences: DataFrame) -> DataFrame:
    """Whether a sentence's wording reverses the direction of its chain, keeps it, or says nothing."""
    any_of = lambda cues: F.lower("sentence").rlike(r"\b(" + "|".join(cues) + r")\b")
    verdict = F.when(any_of(REVERSE_CUES), "reverse").when(any_of(KEEP_CUES), "keep").otherwise("none")
    return sentences.withColumn("direction", verdict)
