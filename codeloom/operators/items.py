"""Items of interviews: an excerpt with (code, rationale) pairs; parsing, completing, merging, checking and counting them."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from codeloom.functions import text as T
from codeloom.functions.tables import EXPECTED_CODES
from codeloom.operators import storage

LITERAL, CLOSE = 0.95, 0.8
#: Needles (texts of a few words) that may be broadcast.
FEW_NEEDLES = 50_000


def transcripts(conversations: DataFrame) -> DataFrame:
    """(interview_id, transcript): the turns of each conversation, in order, a line each."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda t: F.coalesce(t["text"], F.lit(""))), "\n")
    return turns.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("interview_id"), text.alias("transcript"))


def annotate(conversations: DataFrame, *keep: str) -> DataFrame:
    """(interview_id, turn, sent, excerpt, pairs) and the columns ``keep``: the default annotator makes an item of each sentence, with its short words as codes."""
    rows = conversations.select("conv_id", "turn", "role", *keep, F.posexplode(T.sentences(F.col("text"))).alias("sent", "excerpt"))
    codes = F.regexp_extract_all(F.lower("excerpt"), F.lit(r"([a-z]{3,5})"), F.lit(1))
    pairs = F.transform(codes, lambda c: F.struct(c.alias("code"), F.col("role").alias("rationale")))
    return rows.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("interview_id"), "turn", "sent", "excerpt", pairs.alias("pairs"), *keep)


def render(item_id: Column, excerpt: Column, pairs: Column) -> Column:
    """An item as text."""
    pair = lambda p: F.concat(F.lit("    ordem_2a: "), p["code"], F.lit('\n    justificativa_interna: "'), p["rationale"], F.lit('"'))
    return F.concat(F.lit("ITEM @"), item_id, F.lit('\n    ordem_1a: "'), excerpt, F.lit('"\n'), F.array_join(F.transform(pairs, pair), "\n\n"), F.lit("\nEND ITEM"))


def source_header(source_id: Column) -> Column:
    return F.concat(F.lit("SOURCE @"), source_id, F.lit("\n    código: N/A\nEND SOURCE"))


def documents(items: DataFrame) -> DataFrame:
    """(interview_id, syn): the source header and the items of an interview, in order."""
    text = render(F.col("interview_id"), F.col("excerpt"), F.col("pairs"))
    rows = items.select("interview_id", "turn", "sent", text.alias("item")).groupBy("interview_id").agg(F.array_sort(F.collect_list(F.struct("turn", "sent", "item"))).alias("i"))
    return rows.select("interview_id", F.concat(source_header(F.col("interview_id")), F.lit("\n\n"), F.array_join(F.transform("i", lambda x: x["item"]), "\n\n")).alias("syn"))


def bare(x: Column) -> Column:
    """Without blanks and then quotes at the ends."""
    return F.btrim(F.btrim(F.btrim(x, F.lit(" \t\n\r")), F.lit('"')), F.lit("'"))


def parse(texts: DataFrame, text: str = "syn") -> DataFrame:
    """(interview_id, item_seq, item_id, excerpt, pairs) of all ITEM blocks; of delimited blocks if there is no other."""
    # The marks and field names of the item format, here and in render().
    plain = F.regexp_extract_all(text, F.lit(r"(?is)ITEM @(.*?)END ITEM"), F.lit(1))
    delimited = F.regexp_extract_all(text, F.lit(r"(?s)\[-begin_item-\](.*?)\[-end_item-\]"), F.lit(1))
    rows = texts.select("interview_id", F.posexplode(F.when(F.size(plain) > 0, plain).otherwise(delimited)).alias("item_seq", "b"))
    excerpt = F.regexp_extract("b", r"""(?is)ordem_1a:\s*["']?(.*?)["']?\s*(?:ordem_2a:|\z)""", 1)
    parts = F.split("b", r"(?im)^\s*ordem_2a:\s*", -1)
    code = lambda p: bare(F.regexp_extract(p, r"""(?is)^["']?(.*?)["']?\s*(?:justificativa_interna:|END ITEM|\z|\n)""", 1))
    why = lambda p: bare(F.regexp_extract(p, r"""(?im)^\s*justificativa_interna:\s*["']?(.*?)["']?\s*$""", 1))
    pairs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(code(p).alias("code"), why(p).alias("rationale")))
    return rows.select("interview_id", "item_seq", F.regexp_extract("b", r"^(\S+)", 1).alias("item_id"), bare(excerpt).alias("excerpt"), pairs.alias("pairs"))


def line_anchored(text: Column) -> Column:
    """The ITEM blocks that start and end at the start of a line, as they stand; what else names items is passed over."""
    return F.regexp_extract_all(text, F.lit(r"(?ms)^ITEM\s+@\S+.*?^END ITEM"), F.lit(0))


def header(text: Column) -> Column:
    """The SOURCE block of a text, or of the tagged header in it; empty if there is none."""
    inner = F.regexp_extract(text, r"(?s)\[-begin_header-\](.*?)\[-end_header-\]", 1)
    own = lambda t: F.regexp_extract(t, r"(?s)SOURCE @.*?END SOURCE", 0)
    return F.when(own(text) != "", own(text)).otherwise(own(inner))


def completed(pairs: Column) -> Column:
    """Pairs with a code, blanks in codes as underscores, and a stated rationale where there is none."""
    code = lambda p: F.when(F.contains(p["code"], F.lit(" ")), F.lower(F.replace(p["code"], F.lit(" "), F.lit("_")))).otherwise(p["code"])
    stated = lambda p: F.concat(F.lit("Evidência textual de "), p["code"], F.lit(" encontrada no trecho literal."))
    why = lambda p: F.when(F.coalesce(p["rationale"], F.lit("")) != "", p["rationale"]).otherwise(stated(p))
    return F.transform(F.filter(pairs, lambda p: F.coalesce(p["code"], F.lit("")) != ""), lambda p: F.struct(code(p).alias("code"), why(p).alias("rationale")))


def checked(items: DataFrame) -> DataFrame:
    """Items with completed pairs, accepted, and the reasons against them."""
    missing, none = F.coalesce("excerpt", F.lit("")) == "", F.size("pairs") == 0
    no_code = F.transform(
        F.filter(F.transform("pairs", lambda p, i: F.struct(p["code"].alias("code"), i.alias("i"))), lambda x: F.coalesce(x["code"], F.lit("")) == ""),
        lambda x: F.concat(F.lit("missing code["), (x["i"] + 1).cast("string"), F.lit("]")),
    )
    done = completed(F.col("pairs"))
    reasons = F.concat(
        F.array_compact(F.array(F.when(missing, F.lit("missing excerpt")), F.when(none, F.lit("missing pairs")))), no_code,
        F.when((F.size(done) == 0) & ~none, F.array(F.lit("no complete pair"))).otherwise(F.array().cast("array<string>")),
    )
    return items.withColumn("reasons", reasons).withColumn("accepted", ~missing & (F.size(done) > 0)).withColumn("pairs", done)


def merged(items: DataFrame) -> DataFrame:
    """Items of one interview with the same excerpt (up to case and blanks) as one.

    Id and spelling come from the first; its pairs all stay, later pairs are added unless the same (code, rationale) was there. Items
    without an excerpt stay apart.
    """
    own = F.when(T.fingerprint(F.col("excerpt")) == "", F.concat_ws(":", F.lit("\0"), "turn", "sent")).otherwise(T.fingerprint(F.col("excerpt")))
    rows = items.withColumn("key", own)
    first = rows.groupBy("interview_id", "key").agg(
        F.min(F.struct("turn", "sent", "excerpt")).alias("f"), F.count("*").alias("n_items")
    )
    pairs = rows.select("interview_id", "key", "turn", "sent", F.posexplode("pairs").alias("p", "pair"))
    same = Window.partitionBy("interview_id", "key", "pair.code", "pair.rationale").orderBy("turn", "sent", "p")
    numbered = pairs.withColumn("k", F.row_number().over(same))
    held = numbered.join(first.select("interview_id", "key", F.struct("f.turn", "f.sent").alias("start")), ["interview_id", "key"])
    kept = held.where((F.col("k") == 1) | (F.struct("turn", "sent") == F.col("start")))
    lists = kept.groupBy("interview_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "sent", "p", "pair"))), lambda x: x["pair"]).alias("pairs"))
    none = F.array().cast("array<struct<code:string,rationale:string>>")
    return first.join(lists, ["interview_id", "key"], "left").select(
        "interview_id", F.col("f.turn").alias("turn"), F.col("f.sent").alias("sent"), F.col("f.excerpt").alias("excerpt"), F.coalesce("pairs", none).alias("pairs"), "n_items"
    )


def code_counts(items: DataFrame) -> DataFrame:
    """(interview_id, code, n), codes in lower case."""
    return items.select("interview_id", F.explode("pairs").alias("p")).groupBy("interview_id", F.lower("p.code").alias("code")).agg(F.count("*").alias("n"))


def statistics(items: DataFrame) -> DataFrame:
    """(interview_id, items, pairs, codes) of each interview."""
    n = items.groupBy("interview_id").agg(F.count("*").alias("items"), F.sum(F.size("pairs")).alias("pairs"))
    codes = code_counts(items).groupBy("interview_id").agg(F.count("*").alias("codes"))
    return n.join(codes, "interview_id", "left").withColumn("codes", F.coalesce("codes", F.lit(0)))


def top_codes(items: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("interview_id").orderBy(F.desc("n"), "code")
    return code_counts(items).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def expected(items: DataFrame, codes: list[str] = EXPECTED_CODES) -> DataFrame:
    """(interview_id, found, missing): which of the expected codes an interview uses, in their stated order."""
    own = code_counts(items).groupBy("interview_id").agg(F.collect_set("code").alias("own"))
    all_codes = F.array(*map(F.lit, codes))
    interviews = items.select("interview_id").distinct().join(own, "interview_id", "left")
    have = F.coalesce("own", F.array().cast("array<string>"))
    return interviews.select("interview_id", F.array_intersect(all_codes, have).alias("found"), F.array_except(all_codes, have).alias("missing"))


def coverage(items: DataFrame) -> DataFrame:
    """Whether an interview has 80 items, 200 to 400 pairs, 5 pairs per item on average, and how many items have 3 to 10 pairs."""
    n = F.size("pairs")
    return items.groupBy("interview_id").agg(
        F.count("*").alias("items"), F.sum(n).alias("pairs"), (F.count("*") >= 80).alias("enough_items"), F.sum(n).between(200, 400).alias("enough_pairs"),
        F.count_if(n.between(3, 10)).alias("items_in_range"), (F.avg(n) >= 5).alias("dense"),
    )


# --- similarity ---------------------------------------------------------------------------------------------------


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-block similarity of two strings."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def text_similarity(a: Column, b: Column) -> Column:
    return ratio(T.fingerprint(a), T.fingerprint(b))


def common_characters(needle: str, text: str) -> np.ndarray:
    """For each stretch of the text as long as the needle, how many characters both have in common, in any order."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    out = np.zeros(len(text) - len(needle) + 1, dtype=np.int64)
    for c, n in Counter(needle).items():
        seen = np.concatenate(([0], np.cumsum(code == ord(c))))
        out += np.minimum(seen[len(needle) :] - seen[: -len(needle)], n)
    return out


def common_order(places: dict[str, int], n: int, text: str) -> int:
    """How many characters of the text stand in the same order in the needle (their longest common subsequence), given the places of its n characters as bits."""
    ends = full = (1 << n) - 1  # a cleared bit ends a subsequence that is longer by one
    for c in text:
        here = ends & places.get(c, 0)
        ends = ((ends + here) | (ends - here)) & full
    return n - ends.bit_count()


#: Characters of a piece of the needle whose exact places in the text are looked at first.
PIECE = 12


def best_window(needle: str, text: str) -> float:
    """The best similarity of the needle with a stretch of its length: what comparing it with every stretch would give.

    Where a piece of the needle stands in the text is compared first, as a similar stretch has most of its pieces unchanged. Two numbers then bound a
    stretch's similarity: its characters in common with the needle, and those of them in the same order. Stretches are taken by the first bound, the
    highest first, until it is no better than what was found, and only compared if the second is better as well.
    """
    n = len(needle)
    if n > len(text) or not n:
        return 0.0
    score = lambda at: SequenceMatcher(None, needle, text[at : at + n]).ratio()
    best, tried = 0.0, set()
    for k in range(0, n, PIECE):
        found = text.find(needle[k : k + PIECE])
        if found >= 0 and (at := min(max(found - k, 0), len(text) - n)) not in tried:
            tried.add(at)
            best = max(best, score(at))
    bound = common_characters(needle, text)
    order = np.flatnonzero(bound > best * n)
    places: dict[str, int] = {}
    for k, c in enumerate(needle):
        places[c] = places.get(c, 0) | 1 << k
    for at in order[np.argsort(-bound[order], kind="stable")].tolist():
        if bound[at] <= best * n:
            break
        if at not in tried and common_order(places, n, text[at : at + n]) > best * n:
            best = max(best, score(at))
    return best


#: Items of an interview that one call searches for, on average.
TOGETHER = 50


def literal(items: DataFrame, texts: DataFrame, threshold: float = LITERAL) -> DataFrame:
    """Items with is_valid and score: whether the excerpt stands in the transcript, literally or nearly so.

    The score is the best similarity of the excerpt with a stretch of the transcript, 1 for an exact hit, and 0 for an excerpt longer than
    the transcript; white space and case don't count. Items without an excerpt pass. Items meet the transcript in groups of a bounded number, exact hits are found by expressions, and only
    the others go to Python. Items of an interview without a transcript have no row.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def search(needles: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([[best_window(x, b) for x in a] for a, b in zip(needles, text, strict=True)])

    one = F.struct(*(F.col(f"`{c}`") for c in items.columns)).alias("item")
    rows = items.select("interview_id", F.struct(T.fingerprint(F.coalesce("excerpt", F.lit(""))).alias("e"), one).alias("i"))
    groups = rows.groupBy("interview_id").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).alias("groups"))
    dealt = rows.join(groups, "interview_id").withColumn("group", F.pmod(F.xxhash64("i.e"), F.col("groups")))
    own = dealt.groupBy("interview_id", "group").agg(F.collect_list("i").alias("all"))
    met = own.join(texts.select("interview_id", T.fingerprint(F.col("transcript")).alias("t")), "interview_id")
    hit = lambda x: F.contains(F.col("t"), x["e"])
    met = met.select("t", F.filter("all", hit).alias("exact"), F.filter("all", lambda x: ~hit(x)).alias("rest"))
    met = met.withColumn("scores", F.when(F.size("rest") > 0, search(F.transform("rest", lambda x: x["e"]), F.when(F.size("rest") > 0, F.col("t")).otherwise(""))))
    scored = lambda x, score: F.struct(x["item"].alias("item"), score.alias("score"))
    near = F.transform("rest", lambda x, k: scored(x, F.get("scores", k)))
    out = met.select(F.explode(F.concat(F.transform("exact", lambda x: scored(x, F.lit(1.0))), near)).alias("o"))
    return out.select("o.item.*", "o.score").withColumn("is_valid", F.col("score") >= threshold)


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id): needles(item_id, text) that occur in texts(doc_id, text), up to case and white space.

    A needle of five words or more shares its second to fourth words with the text; an equi-join on three words finds the
    candidates, and the texts are compared for these alone. The needles' words are broadcast if they are few by count, so that
    the texts' words need no shuffle. Shorter needles may stand within words and are compared with every text, if there are any.
    """
    w = lambda c: F.split(T.fingerprint(F.col(c)), " ", -1)
    short = needles.where(F.size(w("text")) < 5).select("item_id", T.fingerprint(F.col("text")).alias("n"))
    long = needles.where(F.size(w("text")) >= 5).select("item_id", T.fingerprint(F.col("text")).alias("n"), F.array_join(F.slice(w("text"), 2, 3), " ").alias("key"))
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)))
    body = texts.select("doc_id", T.fingerprint(F.col("text")).alias("t"))
    grams = body.select("doc_id", "t", F.split("t", " ", -1).alias("w")).select("doc_id", F.explode(F.array_distinct(keys)).alias("key"))
    pairs = storage.written(grams.join(storage.few(long, FEW_NEEDLES), "key").select("doc_id", "item_id", "n"), "pairs")
    found = storage.few(pairs, FEW_NEEDLES).join(body, "doc_id").where(F.contains("t", "n")).select("item_id", "doc_id")
    if short.isEmpty():
        return found
    return found.unionByName(storage.few(short, FEW_NEEDLES).join(body, F.contains("t", "n")).select("item_id", "doc_id"))


def closest_codes(words: DataFrame, codebook: DataFrame, cutoff: float = CLOSE) -> DataFrame:
    """(word, code, is_valid): each word's code, or the most similar one from the cutoff on (ties: the greater string), or itself.

    Words similar to that degree share two adjacent characters, and their lengths differ by a bounded factor; a join on both
    meets every candidate, and of these only pairs with enough characters in common are compared.
    """
    norm = lambda c: F.btrim(F.trim(F.lower(c)), F.lit("'\""))
    own, codes = words.select("word", norm("word").alias("w")).distinct(), codebook.select(norm("code").alias("code")).distinct()
    pairs_of = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(2))))
    shared = lambda a, b: F.size(F.filter(F.split(F.col(a), ""), lambda c: (c != "") & F.contains(F.col(b), c)))  # noqa: E731  bounds the matching characters
    # 2 * shorter >= cutoff * (shorter + longer)
    lengths = lambda c: F.sequence(F.ceil(F.length(c) * F.lit(cutoff / (2 - cutoff)) - 1e-9).cast("int"), F.floor(F.length(c) * F.lit((2 - cutoff) / cutoff) + 1e-9).cast("int"))
    exact = own.join(codes, F.col("w") == F.col("code")).select("word", "code", F.lit(True).alias("is_valid"))
    rest = own.join(codes, F.col("w") == F.col("code"), "left_anti")
    met = (
        rest.select("word", "w", F.explode(pairs_of("w")).alias("g"), F.explode(lengths("w")).alias("n"))
        .join(codes.select("code", F.length("code").alias("n"), F.explode(pairs_of("code")).alias("g")), ["g", "n"])
        .where(2 * F.least(F.length("w"), F.length("code")) >= cutoff * (F.length("w") + F.length("code")))
        .select("word", "w", "code")
        .distinct()
        .where(2 * F.least(shared("w", "code"), shared("code", "w")) >= cutoff * (F.length("w") + F.length("code")))
    )
    scored = met.withColumn("score", ratio("code", "w")).where(F.col("score") >= cutoff)
    best = scored.groupBy("word").agg(F.max(F.struct("score", "code")).alias("b")).select("word", F.col("b.code").alias("code"))
    found = rest.join(best, "word", "left").select("word", F.coalesce("code", "w").alias("code"), F.col("code").isNotNull().alias("is_valid"))
    return exact.unionByName(found)


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the edits between two texts (up to case and white space) per character of the longer one; 1 for two empty ones."""
    x, y = T.fingerprint(F.coalesce(a, F.lit(""))), T.fingerprint(F.coalesce(b, F.lit("")))
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longer)


def nearest_codes(words: DataFrame, codebook: DataFrame, cutoff: float = CLOSE) -> DataFrame:
    """(word, code, is_valid) as closest_codes() gives them, but by edits per character of the longer string, and without Python.

    A string of n characters (two marks around it make n + 1 pairs of neighbours) has at most n (1 - cutoff) / cutoff edits, k, to a similar one. An edit spoils two
    pairs, so of the 2 k + 1 pairs that come first in any order both strings have one at least: the rarest ones, by how many strings have
    them. The join on these meets few candidates, and the edits of candidates are counted up to the bound only. All pairs are counted in tables of
    distinct strings, whose number is that of a vocabulary.
    """
    norm = lambda c: F.btrim(F.trim(F.lower(c)), F.lit("'\""))
    own = words.select("word", norm("word").alias("s")).where("s is not null").distinct()
    codes = codebook.select(norm("code").alias("s")).where("s is not null").distinct()
    exact = own.join(codes.withColumnRenamed("s", "code"), F.col("s") == F.col("code"))
    rest = storage.written(own.join(codes, "s", "left_anti"), "words")
    most = lambda n: F.floor(n * F.lit((1 - cutoff) / cutoff) + F.lit(1e-9)).cast("int")
    marked = F.concat(F.lit("\u0001"), F.col("s"), F.lit("\u0002"))
    pair = lambda i: F.substring(marked, i, F.lit(2))
    # a pair that a string has twice counts as two
    pairs = F.transform(F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.concat(pair(i), F.size(F.filter(F.sequence(F.lit(1), i), lambda j: pair(j) == pair(i))).cast("string")))
    grams = lambda df: df.select("s").distinct().select("s", F.explode(pairs).alias("g"))
    both = storage.written(grams(rest).withColumn("code", F.lit(False)).unionAll(grams(codes).withColumn("code", F.lit(True))), "pairs")
    common = both.groupBy("g").agg(F.count("*").alias("n"))
    ranked = both.join(storage.few(common), "g").groupBy("s", "code").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("gs"))
    prefix = storage.written(ranked.select("s", "code", F.explode(F.slice("gs", F.lit(1), 2 * most(F.length("s")) + 1)).alias("x")).select("s", "code", "x.g"), "pairs")
    left, right = prefix.where("not code").select(F.col("s").alias("w"), "g"), prefix.where("code").select(F.col("s").alias("code"), "g")
    longer = F.greatest(F.length("w"), F.length("code"))
    bound = F.floor(longer * F.lit(1 - cutoff) + F.lit(1e-9)).cast("int")
    met = left.join(right, "g").where(F.abs(F.length("w") - F.length("code")) <= bound).select("w", "code").distinct()
    # levenshtein() takes a bound that is the same for all rows; what is over a row's own is left out after it
    widest = int(met.agg(F.coalesce(F.max(bound), F.lit(0))).first()[0])
    near = met.withColumn("edits", F.levenshtein("w", "code", widest)).where((F.col("edits") >= 0) & (F.col("edits") <= bound))
    best = near.groupBy("w").agg(F.max(F.struct((1 - F.col("edits") / longer).alias("score"), "code")).alias("b")).select("w", F.col("b.code").alias("code"))
    found = rest.join(best, rest["s"] == best["w"], "left").select("word", F.coalesce("code", "s").alias("code"), F.col("code").isNotNull().alias("is_valid"))
    return exact.select("word", "code", F.lit(True).alias("is_valid")).unionByName(found)
