"""Mixing sources to target weights by Poisson replication.

A source with share n_s / n of the documents and target weight w_s repeats each of its documents w_s * n / n_s times on
average. How often a given document is repeated is drawn from the Poisson distribution with that mean, by inverting its
distribution function at a uniform number that a hash of the seed and doc_id gives: the draw needs no state, survives
recomputation, and each task takes it alone. The copies are exploded, given a hashed position, and dealt over the
cluster by ranges of it: the order of the result is a global shuffle.

The rates' table has a row for each source, with the part of the distribution function that carries weight: some entries more than
twelve standard deviations to either side of the rate. It is broadcast while it has FEW entries at most, by count, and joined by a
shuffle beyond that. The hashed position also gives the partition, so the shuffle needs no sampling pass over the data.

A null source is a source of its own. Sources that ``weights`` doesn't name get weight 0 (no copies); without weights all
sources weigh the same. A null doc_id hashes like the text "null"; other columns, nulls in them included, are carried along. Repeated
rows get the same number of copies each. An empty table gives an empty result. Columns of docs that are called like the added ones stay, and
the added ones get underscores in front of their names. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import durable
from codeloom.llm.quality_rules import log_factorial

SEED = 20240601
#: Entries (8 bytes each) of a rates' table that may be broadcast.
FEW = 1_000_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source") -> DataFrame:
    """(_source, _docs, _rate, _low, _cdf): _cdf[k] is P(Poisson(rate) <= _low + k), as far as a uniform number of 52 bits can reach."""
    counts = durable(docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_docs")))
    if weights is None:
        weight = F.lit(1.0)
    elif weights:
        named = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, float(w))))
        weight = F.coalesce(named[F.col("_source")], F.lit(0.0))
    else:
        weight = F.lit(0.0)
    weighed = counts.withColumn("_weight", weight)
    docs_all, weight_all = weighed.agg(F.sum("_docs"), F.sum("_weight")).first()
    rate = F.col("_weight") / F.lit(weight_all) * F.lit(docs_all) / F.col("_docs") if weight_all else F.lit(0.0)
    rated = weighed.withColumn("_rate", rate.cast("double"))
    reach = 12 * F.sqrt("_rate") + 30
    low, last = F.greatest(F.floor(F.col("_rate") - reach), F.lit(0)).cast("long"), F.ceil(F.col("_rate") + reach).cast("long")
    log_term = lambda acc, k: acc["log"] + F.log("_rate") - F.log(k)
    step = lambda acc, k: F.struct(
        log_term(acc, k).alias("log"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(log_term(acc, k)))).alias("cdf")
    )
    log_low = F.when(F.col("_low") == 0, -F.col("_rate")).otherwise(F.col("_low") * F.log("_rate") - F.col("_rate") - log_factorial(F.col("_low")))
    start = F.struct(log_low.alias("log"), F.array(F.exp(log_low)).alias("cdf"))
    cdf = F.when(F.col("_rate") > 0, F.aggregate(F.sequence(F.col("_low") + 1, last), start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))
    return rated.withColumn("_low", low).select("_source", "_docs", "_rate", "_low", cdf.alias("_cdf"))


def _free(name: str, taken: list[str]) -> str:
    """The name, with underscores in front of it as long as it is taken."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def replicate(
    docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = SEED, source: str = "source", doc_id: str = "doc_id", marks: bool = True
) -> DataFrame:
    """docs, each row as often as drawn, dealt and sorted by a hashed key; with ``marks`` also the columns ``copy`` (from 1) and ``mix_key``."""
    rated = durable(rates(docs, weights, source))
    entries = rated.agg(F.coalesce(F.sum(F.size("_cdf") + 8), F.lit(0))).first()[0]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source).alias("source"), F.col(doc_id).cast("string").alias("id"))  # no name can clash
    drawn = rows.join(F.broadcast(rated) if entries <= FEW else rated, F.col("source").eqNullSafe(F.col("_source"))).withColumn("u", uniform(seed, F.col("id")))
    below = F.size(F.filter("_cdf", lambda c: c <= F.col("u")))
    times = F.when(below > 0, F.col("_low") + below).otherwise(F.lit(0))
    copies = drawn.select("row", "id", times.alias("times")).where("times > 0").select("row", "id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("id", F.lit("null")), F.col("copy").cast("string")))
    # the first 32 bits of the key are uniform: equal parts of their range are partitions of equal size, in the keys' order
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)).cast("int")
    dealt = copies.select("row", "copy", key.alias("mix_key")).repartitionById(parts, place).sortWithinPartitions("mix_key")
    added = [F.col(c).alias(_free(c, docs.columns)) for c in ("copy", "mix_key")] if marks else []
    return dealt.select("row.*", *added)
