"""Request budgets and costs: what calls use in any minute, and what a corpus would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.tables import DEFAULT_PRICE, PRICES
from codeloom.operators.rules import dimension

REQUESTS, INPUT, OUTPUT, SECONDS, MARGIN = 50, 30_000, 8_000, 60, 0.85
#: Slices of a window: a window of 60 seconds has slices of one.
SLICES = 60


def request_log(events: DataFrame) -> DataFrame:
    """(key, ts, in_tokens, out_tokens): events as calls."""
    value = F.coalesce("value", F.lit(0.0))
    return events.select("event_id", F.col("user_id").alias("key"), "ts", F.floor(value).cast("int").alias("in_tokens"), F.floor(value / 4).cast("int").alias("out_tokens"))


def rolling(log: DataFrame, seconds: int = SECONDS, closed: bool = False, key: str | None = "key") -> DataFrame:
    """Calls and tokens in the time before each call, itself included: of its key, or of all calls if ``key`` is None.

    ``closed`` counts a call that is just so old as well. Calls at the same time see each other; those without a time see those without one;
    tokens that aren't known count as none.

    Time is cut into slices of 1 / SLICES of the window. The window of a call then has the begin of its own slice, whole slices, and the end of
    the slice one window before. The whole ones are added up from a table with a row for each slice; single calls are only looked at together with those of the two slices at the
    edges, so neither a busy key nor a single limit for everything ends in one task.
    """
    keys, width = [key] if key else [], seconds * 1_000_000 // SLICES
    used = ["requests", "in_used", "out_used"]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.select("event_id", "key", us.alias("us"), F.floor(us / width).alias("slice"), F.lit(1).cast("long").alias("requests"), *(F.coalesce(F.col(f"{x}_tokens").cast("long"), F.lit(0)).alias(f"{x}_used") for x in ("in", "out")))
    # slices: each run of SLICES of them with the run before it, of which the last ones belong to its windows
    totals = rows.where("us is not null").groupBy(*keys, "slice").agg(*(F.sum(c).alias(c) for c in used))
    run = F.floor(F.col("slice") / SLICES)
    placed = totals.select("*", F.explode(F.array(run, run + 1)).alias("run"))
    whole = Window.partitionBy(*keys, "run").orderBy("slice").rangeBetween(1 - SLICES, -1)
    between = placed.select(*keys, "slice", "run", *(F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"{c}_whole") for c in used)).where(run == F.col("run")).drop("run")
    # calls: each slice with the one a window before it
    mine = F.struct(F.col("slice").alias("at"), F.lit(True).alias("own"))
    earlier = F.when(F.col("us").isNotNull(), F.struct((F.col("slice") + SLICES).alias("at"), F.lit(False).alias("own")))
    both = rows.select("*", F.explode(F.array_compact(F.array(mine, earlier))).alias("p")).select("event_id", "key", "us", *used, F.col("p.at").alias("slice"), F.col("p.own").alias("own"))
    edges = Window.partitionBy(*keys, "slice").orderBy("us").rangeBetween(-width * SLICES + (0 if closed else 1), 0)
    seen = both.select("event_id", "key", "slice", "own", *(F.sum(c).over(edges).alias(c) for c in used)).where("own")
    there = between.select(*(F.col(k).alias("_key") for k in keys), F.col("slice").alias("_slice"), *(f"{c}_whole" for c in used))
    same = F.col("slice") == F.col("_slice")
    out = seen.join(there, same & F.col("key").eqNullSafe(F.col("_key")) if keys else same, "left")
    return out.select("event_id", "key", *((F.col(c) + F.coalesce(f"{c}_whole", F.lit(0))).alias(c) for c in used))


def reached(used: DataFrame, requests: int = REQUESTS, tokens_in: int = INPUT, tokens_out: int = OUTPUT, margin: float = MARGIN) -> DataFrame:
    """used with over: whether a limit, the whole part of the quota's margin, is reached, so that a client would wait."""
    at = lambda c, most: F.col(c) >= int(most * margin)
    return used.withColumn("over", at("requests", requests) | at("in_used", tokens_in) | at("out_used", tokens_out))


def over_limit(used: DataFrame, requests: int = REQUESTS, tokens_in: int = INPUT, tokens_out: int = OUTPUT, margin: float = 1.0) -> DataFrame:
    over = (F.col("requests") > requests * margin) | (F.col("in_used") > tokens_in * margin) | (F.col("out_used") > tokens_out * margin)
    return used.withColumn("over", over)


def priced(rows: DataFrame, model: str = "model") -> DataFrame:
    """rows with price_in and price_out of their model, or the default prices."""
    table = dimension(rows, PRICES, f"{model} string, price_in double, price_out double")
    return rows.join(table, model, "left").fillna({"price_in": DEFAULT_PRICE[0], "price_out": DEFAULT_PRICE[1]})


def cost(static: Column, tokens: Column, price_in: Column, price_out: Column, max_output: int = 8_000, dual: bool = False) -> Column:
    """US dollars for a transcript: prompt and text in, half the text out up to the limit; twice that for two scopes."""
    once = (static + tokens) / 1e6 * price_in + F.least(F.lit(float(max_output)), tokens * 0.5) / 1e6 * price_out
    return F.round(once * (2 if dual else 1), 8)


def costs(docs: DataFrame, model: Column, static: int = 3000, dual: bool = False) -> DataFrame:
    """(doc_id, model, cost) of every document; ``dual`` asks for both scopes."""
    own = priced(docs.select("doc_id", model.alias("model"), T.tokens_by_words(F.col("text")).alias("tokens")))
    return own.select("doc_id", "model", cost(F.lit(static), F.col("tokens"), F.col("price_in"), F.col("price_out"), dual=dual).alias("cost"))


def run_summary(log: DataFrame) -> DataFrame:
    """One row from log(file, status, duration, estimated_cost): totals by status, cost and time."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"files_{s}")
    return log.agg(
        F.count("*").alias("files_total"), n("processed"), n("failed"), n("skipped"), F.round(F.sum("estimated_cost"), 6).alias("total_cost"), F.round(F.sum("duration"), 6).alias("duration")
    )
