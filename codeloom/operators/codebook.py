"""Codebooks: reading them from text, keywords of definitions, tagging, scopes, and checks against a project's template."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.tables import STOP_WORDS
from codeloom.operators import storage

# The two scopes, by short and by full name.
SCOPES = {"exploratorios": "fatores_exploratorios", "classificatorios": "fatores_classificatorios"}


def scopes_of(mode: Column) -> Column:
    """Scopes that a scan mode selects: both for dual, one by its short or full name, none for everything else."""
    m = F.lower(F.trim(mode))
    out = F.when(m == "dual", F.array(*map(F.lit, SCOPES)))
    for short, full in SCOPES.items():
        out = out.when(m.isin(short, full), F.array(F.lit(short)))
    return out.otherwise(F.array().cast("array<string>"))


def parse(lines: DataFrame) -> DataFrame:
    """(file, scope, code, definition) from lines(file, line_no, line) of indented ``key: "definition"`` listings.

    The scope is the last key without indentation of the same file; comments after // or # outside quotes are left out.
    """
    clean = F.regexp_replace(F.regexp_replace("line", r"^((?:[^\"]*\"[^\"]*\")*[^\"]*?)(//|#).*$", "$1"), "\t", "    ")
    rows = lines.select("file", "line_no", clean.alias("l"))
    root = F.when(F.col("l").rlike(r"^[A-Za-z0-9_]+:"), F.regexp_extract("l", r"^([A-Za-z0-9_]+):", 1))
    scoped = rows.withColumn("scope", F.last(root, ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no")))
    leaf = r"""^[ \t]*([A-Za-z0-9_]+):\s*["'](.*)["']\s*$"""
    return scoped.where(F.col("l").rlike(leaf)).select("file", "scope", F.regexp_extract("l", leaf, 1).alias("code"), F.regexp_extract("l", leaf, 2).alias("definition"))


def valid_codes(texts: DataFrame, text: str = "text") -> DataFrame:
    """(code): keys with a quoted definition, and single-quoted lower-case words over three characters; distinct, in lower case."""
    keys = F.regexp_extract_all(text, F.lit(r"""(?m)^[ \t]*([A-Za-z0-9_]+):\s*["']"""), F.lit(1))
    quoted = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"'([a-z_]+)'"), F.lit(1)), lambda w: F.length(w) > 3)
    return texts.select(F.explode(F.concat(F.transform(keys, lambda k: F.lower(k)), quoted)).alias("code")).distinct()


def keywords(definition: Column, most: int = 5) -> Column:
    """A definition's keywords: quoted text, examples after Ex: and e.g., then key terms; terms of 4 to 49 characters, the first few."""
    listed = F.concat(
        F.regexp_extract_all(definition, F.lit(r'"([^"]+)"'), F.lit(1)),
        F.regexp_extract_all(definition, F.lit(r"(?i)Ex[.:]\s*([^;.]+)"), F.lit(1)),
        F.regexp_extract_all(definition, F.lit(r"(?i)e\.g\.\s*([^;.]+)"), F.lit(1)),
    )
    terms = F.filter(F.flatten(F.transform(listed, lambda m: F.transform(F.split(F.trim(m), "[,;]", -1), lambda t: F.lower(F.trim(t))))), lambda t: F.length(t).between(4, 49))
    letters = "a-záàâãéèêíïóôõöúçñ"
    key = F.slice(F.regexp_extract_all(F.lower(definition), F.lit(rf"(?U)\b([{letters}]{{4,}}(?:\s+[{letters}]{{3,}}){{0,2}})\b"), F.lit(1)), 1, 3)
    plain = F.filter(key, lambda t: ~F.exists(F.array(*map(F.lit, STOP_WORDS)), lambda s: F.contains(t, s)))
    return F.slice(F.concat(terms, plain), 1, most)


def keyword_index(codebook: DataFrame) -> DataFrame:
    """(keyword, code, ord): the codes that each keyword stands for, with their place in the codebook; a row for each, as a keyword may have any number."""
    rows = codebook.select("ord", "code", F.explode(keywords(F.col("definition"))).alias("keyword"))
    return rows.groupBy("keyword", "code").agg(F.min("ord").alias("ord"))


def first_keywords(index: DataFrame, n: int = 50, codes: int = 4) -> DataFrame:
    """(keyword, codes): the first n keywords, each with its first codes in the codebook's order.

    The keywords come first, and only their rows go on; of these tasks keep a few for each keyword before they pass them on.
    """
    first = index.select("keyword").distinct().orderBy("keyword").limit(n)
    own = index.join(F.broadcast(first), "keyword")  # n rows
    place = F.row_number().over(Window.partitionBy("keyword").orderBy("ord", "code"))
    some = own.withColumn("k", place).where(F.col("k") <= codes)
    return some.groupBy("keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "code"))), lambda x: x["code"]).alias("codes"))


#: Keywords, and characters of them in all, that a matcher may hold: its automaton takes some hundred bytes for a character.
FEW_KEYWORDS, FEW_CHARS = 100_000, 2_000_000
#: What may stand between words.
_GAP = r"[^\p{L}\p{N}]+"


def plain(text: Column) -> Column:
    """A text as its words (runs of letters and digits) in lower case, with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _GAP, " "))


def tag(units: DataFrame, index: DataFrame, unit: str = "doc_id") -> DataFrame:
    """(unit, keyword, n): how often keywords of one word or several occur in units(unit, text), overlapping occurrences counted each.

    A keyword stands where its words follow each other, whatever separates them. Keywords are compared in their plain form and named by it; those
    without a word never occur. Each text is read once: by a matcher of all keywords if a count and the sum of their lengths
    show that it is small, else by joins on the keywords' first words. Units that repeat an id count together.
    """
    keywords = storage.written(index.select(plain(F.col("keyword")).alias("keyword")).where("keyword <> ''").distinct(), "keywords")
    n, chars = keywords.agg(F.count("*"), F.coalesce(F.sum(F.length("keyword")), F.lit(0))).first()
    texts = units.select(unit, plain(F.col("text")).alias("text"))
    found = _matched(texts, keywords, unit) if n <= FEW_KEYWORDS and chars <= FEW_CHARS else _joined(texts, keywords, unit)
    return found.groupBy(unit, "keyword").agg(F.sum("n").alias("n"))


def _matched(texts: DataFrame, keywords: DataFrame, unit: str) -> DataFrame:
    """By an automaton of all keywords, each between blanks, which finds them in one pass over a text."""
    sent = texts.sparkSession.sparkContext.broadcast([r["keyword"] for r in keywords.toLocalIterator()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher(sent.value)
        for batch in batches:
            counts = [Counter(find(t)) for t in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            words = pa.array([w for c in counts for w in c], pa.string())
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), words, pa.array([x for c in counts for x in c.values()], pa.int64())], names=[unit, "keyword", "n"])

    kind = texts.schema[unit].dataType.simpleString()
    return texts.mapInArrow(run, f"`{unit}` {kind}, keyword string, n long")


def matcher(keywords: list[str]) -> Callable[[str], Iterator[str]]:
    """A function that gives the keywords (in plain form) at each place of a plain text where they stand."""
    if not keywords:
        return lambda text: iter(())
    automaton = ahocorasick.Automaton()
    for k in keywords:
        automaton.add_word(f" {k} ", k)
    automaton.make_automaton()
    return lambda text: (k for _, k in automaton.iter(f" {text} "))


def _joined(texts: DataFrame, keywords: DataFrame, unit: str) -> DataFrame:
    """By equi-joins: a word that some keyword begins with gives a run of words for each length of such keywords, and the runs meet the keywords."""
    size = lambda c: F.size(F.split(F.col(c), " ", -1))
    first = F.substring_index("keyword", " ", 1)
    begin = keywords.groupBy(first.alias("w")).agg(F.collect_set(size("keyword")).alias("lengths"))
    longest = keywords.agg(F.coalesce(F.max(size("keyword")), F.lit(1))).first()[0]
    words = texts.where("text <> ''").select(unit, F.split("text", " ", -1).alias("ws"))
    at = F.transform(F.col("ws"), lambda w, i: F.struct(w.alias("w"), F.slice(F.col("ws"), i + 1, F.lit(longest)).alias("run")))
    starts = words.select(unit, F.explode(at).alias("s")).select(unit, "s.*").join(storage.few(begin, FEW_KEYWORDS), "w")
    runs = starts.select(unit, F.explode(F.filter(F.transform("lengths", lambda k: F.when(F.size("run") >= k, F.array_join(F.slice("run", F.lit(1), k), " "))), lambda r: r.isNotNull())).alias("keyword"))
    return runs.groupBy(unit, "keyword").agg(F.count("*").alias("n")).join(storage.few(keywords, FEW_KEYWORDS), "keyword", "left_semi").select(unit, "keyword", "n")


# --- projects ----------------------------------------------------------------------------------------------------


def by_scope(specs: DataFrame) -> DataFrame:
    """(scope, fields): how many fields of a template belong to SOURCE, ITEM and ONTOLOGY."""
    return specs.groupBy("scope").agg(F.count("*").alias("fields"), F.count_if("required").alias("required"))


def chain_relations(specs: DataFrame) -> DataFrame:
    """(relation, meaning) of the first CHAIN field in ITEM scope, by declaration order (column ord)."""
    own = specs.where("type = 'CHAIN' and scope = 'ITEM'").agg(F.min_by("relations", "ord").alias("r"))
    return own.select(F.explode("r").alias("relation", "meaning"))


def broken_bundles(items: DataFrame, bundles: DataFrame) -> DataFrame:
    """(item_id, bundle, given, missing) for values(item_id, field, value) that give some fields of bundles(fields), but not all of them.

    An item's fields of a bundle are the bits of a mask, put together by an aggregate, so that values come in any order and number
    (the same field twice is one bit) and tasks send a number for each item and bundle. Empty and null values give nothing. A bundle has 63 fields at most.
    """
    own = bundles.select("fields", F.array_join("fields", "+").alias("bundle"), F.posexplode("fields").alias("bit", "field"))
    given = items.where(F.coalesce("value", F.lit("")) != "").select("item_id", "field")
    masks = given.join(storage.few(own.select("bundle", "field", "bit")), "field").groupBy("item_id", "bundle").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    names = storage.few(bundles.select("fields", F.array_join("fields", "+").alias("bundle")).distinct())
    full = F.expr("shiftleft(1L, size(fields)) - 1")
    split = lambda on: F.filter("fields", lambda f, k: (F.getbit("mask", k) == 1) == on)
    return masks.join(names, "bundle").where(F.col("mask") != full).select("item_id", "bundle", split(F.lit(True)).alias("given"), split(F.lit(False)).alias("missing"))


def violations(items: DataFrame, specs: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """(item_id, field, kind) for values(item_id, field, value) that break the template, and for required fields without one.

    Kinds: REQUIRED, VALUES (not in the list), SCALE (outside the range), CHAIN (even number of elements, or a relation
    that isn't allowed), DATE; and BUNDLE, with the bundle's fields joined by +, where bundles(fields) are given.
    """
    if bundles is not None:
        own = broken_bundles(items, bundles).select("item_id", F.col("bundle").alias("field"), F.lit("BUNDLE").alias("kind"))
        return violations(items, specs).unionByName(own)
    given = items.where(F.coalesce("value", F.lit("")) != "")
    known = given.join(F.broadcast(specs), "field")  # a template is a short list
    parts = F.split(F.trim("value"), r"\s*->\s*")
    odd = (F.size(parts) % 2 == 0) | F.exists(F.filter(parts, lambda x, i: i % 2 == 1), lambda r: ~F.coalesce(F.array_contains("allowed", r), F.lit(False)))
    number = F.try_to_number("value", F.lit("S999999999D999999")).cast("double")
    kind = (
        F.when(F.col("type").isin("ENUMERATED", "ORDERED") & ~F.coalesce(F.array_contains("allowed", F.col("value")), F.lit(False)), "VALUES")
        .when((F.col("type") == "SCALE") & ~F.coalesce(number.between(F.col("low"), F.col("high")), F.lit(False)), "SCALE")
        .when((F.col("type") == "CHAIN") & odd, "CHAIN")
        .when((F.col("type") == "DATE") & ~T.is_iso_date(F.col("value")), "DATE")
    )
    broken = known.select("item_id", "field", kind.alias("kind")).where("kind is not null")
    need = items.select("item_id").distinct().select("item_id").join(F.broadcast(specs.where("required").select("field")), F.lit(True))
    missing = need.join(given.select("item_id", "field"), ["item_id", "field"], "left_anti").withColumn("kind", F.lit("REQUIRED"))
    return broken.unionByName(missing)


def acceptable(items: DataFrame, errors: DataFrame) -> DataFrame:
    """Items whose only errors, if any, are orphans."""
    return items.join(errors.where("kind <> 'OrphanItem'"), "item_id", "left_anti")


def orphans(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items whose source isn't there."""
    return items.join(sources, "source_id", "left_anti")
